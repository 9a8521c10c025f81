"""Nest child rows into one ordered list per parent.

A list is one cell of its parent's row, as the document it belongs to is one row by definition.  Whatever can be
counted, filtered or flattened is taken from the child rows instead; nothing here depends on their number.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F


def ordered_list(item: Column, pos: str, keep: Column | None = None) -> Column:
    """Aggregate: the items of the rows to keep, ordered by their unique position."""
    placed = F.struct(F.col(pos).alias("p"), item.alias("v"))
    listed = F.sort_array(F.collect_list(placed if keep is None else F.when(keep, placed)))
    return F.transform(listed, lambda e: e["v"])
