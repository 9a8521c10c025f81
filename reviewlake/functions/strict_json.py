"""Strict JSON on string columns, and shape checks on VARIANT values.

``from_json`` coerces, ignores trailing text and cannot tell an absent key
from a null one, so texts are parsed to VARIANT and the checks look at that.
A check finds the path of the first bad field, or of all of them; checks nest,
and run in the order the fields are declared.
"""

from collections.abc import Callable
from itertools import count
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from reviewlake.functions.text import _col
from reviewlake.schemas import SAFE_INTEGER

Check = Callable[["Value", str, "Fold"], str]

_END = "\x7fend-of-value\x7f"


def _bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body``, however often that uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def parse_listed(text) -> Column:
    """A JSON text as a VARIANT list whose first element it is, or NULL unless
    the text is exactly one JSON value.

    The parser stops after the first value, so the text goes into a list in
    front of an end mark; the mark must come out as the second and last
    element.  A text that holds the mark itself gets a mark longer than it.
    The list is handed on as it is, since taking the value out copies it.
    """
    x = _col(text)
    mark = F.when(F.contains(x, F.lit(_END)), F.repeat(F.lit("~"), F.length(x) + 1)).otherwise(
        F.lit(_END)
    )
    listed = F.try_parse_json(F.concat(F.lit("["), x, F.lit(',"'), mark, F.lit('"]')))

    def if_whole(v):
        closed = F.try_variant_get(v, "$[1]", "string") == mark
        single = F.try_variant_get(v, "$[2]", "variant").isNull()
        return F.when(closed & single, v)

    return _bind(listed, if_whole)


def parse_strict(text) -> Column:
    """A JSON text as VARIANT, or NULL unless it is exactly one JSON value."""
    return F.try_variant_get(parse_listed(text), "$[0]", "variant")


def object_text(text) -> Column:
    """From the first ``{`` to the last ``}``; NULL when there is no such span."""
    x = _col(text)
    first = F.instr(x, "{")
    last = F.length(x) - F.instr(F.reverse(x), "}") + 1
    found = (first > 0) & F.contains(x, F.lit("}")) & (last > first)
    return F.when(found, F.substr(x, first, last - first + 1))


# --- checks -----------------------------------------------------------------
#
# A check takes a value, its path as SQL text and a way to fold what it finds, and gives SQL text: in FIRST, NULL for a
# good value, else the path of the first bad field; in ALL, a list of every bad path.  Text, because a document
# needs hundreds of expressions and one parse is far cheaper than building each.


class Fold(NamedTuple):
    """How the findings of parts make that of a whole."""

    nothing: str
    unless: Callable[[str, str], str]  # a condition and the path that is bad without it
    within: Callable[[str, str, list[str]], str]  # the same, and what is looked at only if it holds
    each: Callable[[str], str]  # over a list of findings


class Value(NamedTuple):
    """SQL of a VARIANT and a place inside it."""

    variant: str
    place: str = "$"

    def read(self, kind: str) -> str:
        return f"try_variant_get({self.variant}, '{self.place}', '{kind}')"

    @property
    def sql(self) -> str:
        return self.variant if self.place == "$" else self.read("variant")

    @property
    def type(self) -> str:
        return f"schema_of_variant({self.sql})"


_names = count()


def _at(path: str, step: str) -> str:
    return f"concat_ws('.', {path}, {step})"


def _unless(ok: str, path: str) -> str:
    return f"if(coalesce({ok}, false), null, coalesce({path}, ''))"


_NO_PATHS = "cast(array() as array<string>)"
FIRST = Fold(
    "null",
    _unless,
    lambda ok, path, parts: f"coalesce({_unless(ok, path)}, {', '.join(parts)})",
    lambda found: f"get(filter({found}, p -> p is not null), 0)",
)
ALL = Fold(
    _NO_PATHS,
    lambda ok, path: f"if(coalesce({ok}, false), {_NO_PATHS}, array(coalesce({path}, '')))",
    lambda ok, path, parts: f"if(coalesce({ok}, false), concat({', '.join(parts)}), array(coalesce({path}, '')))",
    lambda found: f"flatten({found})",
)


def _let(value: str, body: Callable[[str], str]) -> str:
    """SQL that evaluates ``value`` once and names it."""
    name = f"v{next(_names)}"
    return f"get(transform(array({value}), {name} -> {body(name)}), 0)"


def text() -> Check:
    return lambda value, path, fold: fold.unless(f"{value.type} = 'STRING'", path)


def one_of(values: list[str]) -> Check:
    """One of some plain words."""
    listed = ", ".join(f"'{v}'" for v in values)

    def check(value, path, fold):
        return fold.unless(f"{value.type} = 'STRING' and {value.read('string')} in ({listed})", path)

    return check


def _is_number(value: Value) -> str:
    return f"{value.type} rlike '^(BIGINT|DECIMAL|DOUBLE)'"


def number() -> Check:
    """A finite number."""

    def check(value, path, fold):
        finite = f"abs({value.read('double')}) <= 1.7976931348623157E308D"
        return fold.unless(f"{_is_number(value)} and {finite}", path)

    return check


def integer() -> Check:
    """A number without a fraction, within the range doubles hold exactly."""

    def check(value, path, fold):
        n = value.read("double")
        whole = f"{_is_number(value)} and {n} = rint({n}) and abs({n}) <= {SAFE_INTEGER}D"
        plain = f"{value.read('bigint')} between -{SAFE_INTEGER} and {SAFE_INTEGER}"
        return fold.unless(f"if({value.type} = 'BIGINT', {plain}, {whole})", path)

    return check


def equals(constant: int) -> Check:
    def check(value, path, fold):
        return fold.unless(f"{_is_number(value)} and {value.read('double')} = {constant}D", path)

    return check


def nullable(inner: Check) -> Check:
    """JSON null is fine; an absent key is not."""

    def check(value, path, fold):
        return f"if(coalesce(is_variant_null({value.sql}), false), {fold.nothing}, {inner(value, path, fold)})"

    return check


def optional(inner: Check) -> Check:
    """An absent key is fine; JSON null is not."""
    return lambda value, path, fold: f"if({value.sql} is null, {fold.nothing}, {inner(value, path, fold)})"


def list_of(inner: Check) -> Check:
    def check(value, path, fold):
        item, i = f"v{next(_names)}", f"i{next(_names)}"
        of_item = inner(Value(item), _at(path, f"cast({i} as string)"), fold)

        def found(items):
            return fold.within(f"{items} is not null", path, [fold.each(f"transform({items}, ({item}, {i}) -> {of_item})")])

        return _let(value.read("array<variant>"), found)

    return check


def fields(**checks: Check) -> Check:
    """An object with the given fields; other keys are ignored.

    The object is taken apart once, into a map; looking every field up in the
    VARIANT would decode its keys again and again.
    """

    def check(value, path, fold):
        def found(members):
            parts = [
                one(Value(f"try_element_at({members}, '{name}')"), _at(path, f"'{name}'"), fold)
                for name, one in checks.items()
            ]
            return fold.within(f"{members} is not null", path, parts)

        return _let(value.read("map<string,variant>"), found)

    return check


def first_bad_path(value: Value, check: Check) -> Column:
    """Path of the first bad field ('' is the value itself), NULL when all is well."""
    return F.expr(check(value, "cast(null as string)", FIRST))


def bad_paths(value: Value, check: Check) -> Column:
    """Paths of all bad fields, in the order they are declared; what lies below a bad one is not looked at."""
    return F.expr(check(value, "cast(null as string)", ALL))
