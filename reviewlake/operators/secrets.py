"""Scan source texts for lines that look like credentials."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlake.functions.text import to_lines

# Fixed value: the pattern a line is searched for.
SECRET_PATTERN = r"(?i)(api[_-]?key|secret|token|password|bearer|apikey)\s*[:=]"


def _scanned(path: Column, text: Column) -> Column:
    # A file with a NUL anywhere is binary; notes and the sample environment
    # file are exempt.
    binary = F.contains(text, F.lit("\x00"))
    return ~binary & ~path.endswith(".md") & (path != ".env.example")


def scan_secrets(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """files(path, text, ...) to one row per suspicious line: path, ``line_no``, ``line``.

    The whole text is searched first, so only files with a match are split.
    """
    hits = files.filter(_scanned(F.col(path), F.col(text)) & F.col(text).rlike(SECRET_PATTERN))
    return to_lines(hits, text).filter(F.col("line").rlike(SECRET_PATTERN))
