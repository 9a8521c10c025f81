"""Text functions on columns: lines, templates, test titles, file names.

Everything here is a composition of built-in functions, so it stays on the JVM
side and needs no shuffle.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The characters JavaScript counts as white space, and the ones
# its "." does not match.
JS_SPACE = r"\t\n\x0B\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
JS_SPACE_CHARS = "".join(
    map(chr, [9, 10, 11, 12, 13, 32, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF])
)
JS_LINE_END = r"\n\r\u2028\u2029"

# The patterns of test titles, issue tags and placeholders.
CASE_TITLE = rf"(?<![A-Za-z0-9_])it\([{JS_SPACE}]*(['\"`])([^{JS_LINE_END}]+?)\1"
ISSUE_TAG = r"\[(E[0-9]+)\]"
PLACEHOLDER = r"\{\{([A-Za-z0-9_]+)\}\}"
UNICODE_PLACEHOLDER = r"\{\{([\p{L}\p{N}_]+)\}\}"
NO_VALUE = "–"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def split_lines(text) -> Column:
    """Lines of a text; a trailing newline leaves an empty last line."""
    return F.split(_col(text), "\n", -1)


def normalise_eol(text) -> Column:
    """CRLF to LF; a lone CR is kept."""
    return F.replace(_col(text), F.lit("\r\n"), F.lit("\n"))


def to_lines(df: DataFrame, text: str, *, keep: list[str] | None = None) -> DataFrame:
    """One row per line, with a 1-based ``line_no`` and the ``line`` itself."""
    kept = [c for c in df.columns if c != text] if keep is None else keep
    exploded = df.select(*kept, F.posexplode(split_lines(text)).alias("_pos", "line"))
    return exploded.select(*kept, (F.col("_pos") + 1).cast("bigint").alias("line_no"), "line")


def number_lines(text) -> Column:
    """The text with every line prefixed by ``<n>| ``."""
    numbered = F.transform(
        split_lines(text),
        lambda line, i: F.concat((i + 1).cast("string"), F.lit("| "), line),
    )
    return F.array_join(numbered, "\n")


def _substitute(template: Column, values: Column, pattern: str, fallback) -> Column:
    # Odd pieces are the placeholders, even pieces the text around them; each
    # is put in once, so braces inside a value are never expanded again.
    keys = F.regexp_extract_all(template, F.lit(pattern), F.lit(1))
    filled = F.transform(
        keys, lambda key: F.coalesce(F.try_element_at(values, key), fallback(key))
    )
    joined = F.zip_with(
        F.split(template, pattern, -1),
        filled,
        lambda piece, value: F.concat(piece, F.coalesce(value, F.lit(""))),
    )
    return F.array_join(joined, "")


def render_template(template, values) -> Column:
    """Replace ``{{key}}`` from a map column; unknown keys stay as they are."""
    return _substitute(
        _col(template),
        _col(values),
        PLACEHOLDER,
        lambda key: F.concat(F.lit("{{"), key, F.lit("}}")),
    )


def fill_placeholders(template, values) -> Column:
    """Replace ``{{key}}`` from a map column; unknown keys become a dash."""
    return _substitute(
        _col(template), _col(values), UNICODE_PLACEHOLDER, lambda key: F.lit(NO_VALUE)
    )


def case_titles(test_code) -> Column:
    """Titles of every ``it('...')`` in a test file, in order."""
    return F.regexp_extract_all(_col(test_code), F.lit(CASE_TITLE), F.lit(2))


def issue_tag(name) -> Column:
    """First ``[E<digits>]`` tag of a test title, or NULL."""
    return F.nullif(F.regexp_extract(_col(name), ISSUE_TAG, 1), F.lit(""))


def extract_cases(df: DataFrame, test_code: str, *keys: str) -> DataFrame:
    """One row per test title: ``pos``, ``name`` and the ``issue_id`` it guards."""
    titles = df.select(*keys, F.posexplode(case_titles(test_code)).alias("pos", "name"))
    return titles.select(
        *keys, F.col("pos").cast("bigint").alias("pos"), "name", issue_tag("name").alias("issue_id")
    )


def trim_js(text) -> Column:
    """Trim every character JavaScript's ``trim`` removes; looks at the ends only."""
    return F.btrim(_col(text), F.lit(JS_SPACE_CHARS))


def js_length(text) -> Column:
    """Length in UTF-16 units, which is what JavaScript limits count."""
    return F.floor(F.length(F.encode(_col(text), "UTF-16BE")) / 2).cast("bigint")


def forward_slashes(path) -> Column:
    return F.replace(_col(path), F.lit("\\"), F.lit("/"))


def file_name_parts(path) -> tuple[Column, Column]:
    """Base name without extension, and extension with its dot ('' when none)."""
    base = F.element_at(F.split(forward_slashes(path), "/", -1), -1)
    ext = F.regexp_extract(base, r"(?s)\A.+(\.[^.]*)\z", 1)
    return F.left(base, F.length(base) - F.length(ext)), ext


def language_of(ext) -> Column:
    return F.when(_col(ext) == ".ts", "typescript").otherwise("javascript")


def file_meta(df: DataFrame, path: str) -> DataFrame:
    """Add ``name``, ``ext``, ``language`` and ``file_name`` derived from a path."""
    name, ext = file_name_parts(path)
    return df.withColumns(
        {
            "name": name,
            "ext": ext,
            "language": language_of(ext),
            "file_name": forward_slashes(path),
        }
    )


def parse_iso(text) -> Column:
    """ISO-8601 string to TIMESTAMP; NULL when it is not one."""
    return F.try_to_timestamp(_col(text))


def iso_time(ts) -> Column:
    """TIMESTAMP to ``yyyy-MM-ddTHH:mm:ss.SSSZ``; the session zone is UTC."""
    return F.date_format(_col(ts), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
