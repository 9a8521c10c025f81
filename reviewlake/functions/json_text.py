"""JSON text of a typed value, with nulls written and absent fields left out.

Spark's own writer either drops every null or writes every one; documents need
``line: null`` next to an absent ``suggestion``.  The expression is put together
as SQL text and parsed once.
"""

from itertools import count

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fields that are left out when they have no value; any other NULL is written.
OPTIONAL_FIELDS = {"suggestion", "model", "author", "verification", "detection", "timings"}

_names = count()


def _text_of(value: str) -> str:
    """A quoted string: the only element of a JSON list, without its brackets."""
    listed = f"to_json(array({value}))"
    return f"substr({listed}, 2, length({listed}) - 2)"


def _number_of(value: str) -> str:
    """Whole numbers without a fraction, whatever their type."""
    whole = f"{value} = rint({value}) and abs({value}) < 1e15"
    return f"if({whole}, cast(cast({value} as bigint) as string), cast({value} as string))"


def _wrapped(open_: str, close: str, items: str, empty: str, indent: int | None) -> str:
    if indent is None:
        return f"concat('{open_}', {items}, '{close}')"
    return f"if({empty}, '{open_}{close}', concat('{open_}\n', {items}, '\n{' ' * indent}{close}'))"


def _json(value: str, of: T.DataType, indent: int | None) -> str:
    deeper = None if indent is None else indent + 2
    pad = "" if deeper is None else " " * deeper
    between = "," if indent is None else ",\n"
    if isinstance(of, T.StructType):
        colon = ":" if indent is None else ": "
        members = []
        for field in of:
            child = f"{value}.{field.name}"
            member = f"concat('{pad}\"{field.name}\"{colon}', {_json(child, field.dataType, deeper)})"
            members.append(f"if({child} is null, null, {member})" if field.name in OPTIONAL_FIELDS else member)
        text = _wrapped("{", "}", f"concat_ws('{between}', {', '.join(members)})", "false", indent)
    elif isinstance(of, T.ArrayType):
        item = f"j{next(_names)}"
        items = f"transform({value}, {item} -> concat('{pad}', {_json(item, of.elementType, deeper)}))"
        text = _wrapped("[", "]", f"array_join({items}, '{between}')", f"size({value}) = 0", indent)
    elif isinstance(of, T.StringType):
        text = _text_of(value)
    elif isinstance(of, (T.DoubleType, T.FloatType)):
        text = _number_of(value)
    else:
        text = f"cast({value} as string)"
    return f"if({value} is null, 'null', {text})"


def json_of(value: str, ddl: str, indent: int | None = None) -> Column:
    """JSON of a column of the given type: compact, or laid out from ``indent`` columns on."""
    return F.expr(_json(value, T.DataType.fromDDL(ddl), indent))
