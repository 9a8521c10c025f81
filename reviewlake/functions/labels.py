"""Display labels of a report card.

Durations are rounded exactly (decimal, half up; half even for whole seconds),
never through a binary fraction.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from reviewlake.functions.text import NO_VALUE, _col

MINUTE_MS = 60_000


def _ms(ms) -> Column:
    return _col(ms).cast("decimal(24,3)")


def _dec(value) -> Column:
    return F.lit(value).cast("decimal(6,0)")


def fmt_secs(ms) -> Column:
    """Milliseconds as seconds with one decimal, e.g. ``12.3s``."""
    return F.concat(F.round(_ms(ms) / _dec(1000), 1).cast("decimal(24,1)").cast("string"), F.lit("s"))


def fmt_time(ms) -> Column:
    """Minutes with one decimal from a minute on, else whole seconds."""
    minutes = F.round(_ms(ms) / _dec(MINUTE_MS), 1).cast("decimal(24,1)").cast("string")
    seconds = F.bround(_ms(ms) / _dec(1000), 0).cast("bigint").cast("string")
    return (
        F.when(_col(ms).isNull(), "1 task")
        .when(_col(ms) >= MINUTE_MS, F.concat(minutes, F.lit(" min")))
        .otherwise(F.concat(seconds, F.lit("s")))
    )


def or_dash(value) -> Column:
    return F.coalesce(_col(value).cast("string"), F.lit(NO_VALUE))


def caught_label(caught, expected) -> Column:
    return F.concat(_col(caught).cast("string"), F.lit("/"), _col(expected).cast("string"))


def missed_label(missed) -> Column:
    """``missed: a, b`` or ``none missed`` from an array of bug ids."""
    ids = _col(missed)
    return F.when(F.size(ids) > 0, F.concat(F.lit("missed: "), F.array_join(ids, ", "))).when(
        ids.isNotNull(), "none missed"
    )


def before_after_label(before, after) -> Column:
    return F.concat(_col(before).cast("string"), F.lit(" → "), _col(after).cast("string"))


def severity_label(high, medium, low) -> Column:
    parts = [
        F.concat(_col(c).cast("string"), F.lit(word))
        for c, word in ((high, " high"), (medium, " medium"), (low, " low"))
    ]
    return F.concat_ws(" · ", *parts)


def guard_label(issue_id) -> Column:
    """``guards E1`` for a tagged case, else ``edge / happy path``."""
    tagged = F.coalesce(_col(issue_id), F.lit("")) != ""
    return F.when(tagged, F.concat(F.lit("guards "), _col(issue_id))).otherwise("edge / happy path")
