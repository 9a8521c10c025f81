"""Operator 6: fuzzy line dedup by MinHash, with DataFrame functions only.

A line's shingles are all runs of `size` characters, spaces included.  They are dealt into parts by their hash; signatures
are minima of one seeded hash each within a part, banded for high recall.  Lines of a crowded bucket meet by their rarest
shingles, of which similar lines always share one.  Lines that meet are verified by the exact Jaccard similarity of their
shingles; connected lines form a component, of which the first line stays.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reviewlake.llm.common import bucket_links, components, forget, id_and_text, in_company, matching, settle, swept

SIZE, SIMILARITY = 9, 0.8
# Shingles are dealt into parts by their hash; each part has bands of its own.
PARTS, BANDS, ROWS = 4, 2, 3
# Seeds of a part's minima: a minimum is the hash that differs from its seed in no higher bit than all others.
SEEDS = [0x12345678, -0x5A5A1111, 0x3779B97F, -0x13579BDF, 0x6B43A9B5, -0x7C1E2F03]
# In buckets of more lines than this, those lines meet that share one of their rarest shingles.
CROWD = 16
# Against rounding, in bounds that leave pairs out.
SLACK = 1e-6


def shingles(line: Column, size: int) -> Column:
    """All runs of `size` characters, repeated ones too; a shorter line is one shingle."""
    return F.regexp_extract_all(line, F.lit(rf"(?s)(?=(.{{{size}}}|^.{{1,{size - 1}}}\z))."), F.lit(1))


def split_lines(docs: DataFrame) -> DataFrame:
    """doc_id, row, line_no, norm, a, b: every line that is not blank; a and b are 128 bits that name its lower-cased text."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.split("text", "\n").alias("lines"))
    rows = rows.select("row", "doc_id", F.posexplode("lines").alias("line_no", "line"))
    rows = rows.select("row", "doc_id", "line_no", F.lower(F.btrim("line", F.lit(" \t\r\x0b\x0c"))).alias("norm")).filter("norm <> ''")
    return rows.withColumns({"a": F.xxhash64("norm"), "b": F.xxhash64(F.lit("line"), "norm")})


def signatures(lines: DataFrame, size: int) -> DataFrame:
    """a, b, part, m0, m1, ...: a row per distinct line and part that has shingles; a minimum is taken of hashes turned by its own seed.

    Shingles become rows and are folded by a compiled aggregation before the shuffle.  They are cut from four bytes a
    character, where each has a known place.
    """
    wide = lines.select("a", "b", F.encode("norm", "UTF-32").alias("wide"))
    last = F.greatest(F.shiftright(F.octet_length("wide"), 2) - size, F.lit(0))
    each = wide.select("a", "b", "wide", F.explode(F.sequence(F.lit(0), last)).alias("at"))
    each = each.select("a", "b", F.xxhash64(F.substring("wide", F.col("at") * 4 + 1, F.lit(4 * size))).alias("h"))
    part = F.col("h").bitwiseAND(F.lit(PARTS - 1)).cast("int").alias("part")
    each = each.select("a", "b", part, F.shiftright("h", 32).cast("int").alias("high"))
    return each.groupBy("a", "b", "part").agg(*(F.min(F.col("high").bitwiseXOR(F.lit(seed))).alias(f"m{i}") for i, seed in enumerate(SEEDS)))


def candidates(signed: DataFrame) -> DataFrame:
    """band, a, b: the buckets each line is in; lines of a bucket are candidates."""
    bands = F.array(*(F.xxhash64("part", F.lit(i), *(f"m{i * ROWS + j}" for j in range(ROWS))) for i in range(BANDS)))
    return signed.select(F.explode(bands).alias("band"), "a", "b")


def in_pairs(lines: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """id, a, b, norm, n: a number, the text and the number of different shingles of the lines whose a, b are given."""
    texts = matching(lines.select("a", "b", "norm"), ids, ["a", "b"], "left_semi").distinct()
    n = F.size(F.array_distinct(shingles(F.col("norm"), size)))
    return texts.select(F.monotonically_increasing_id().alias("id"), "a", "b", "norm", n.alias("n"))


def marked(place: Column) -> Column:
    """What a bucket knows of a line: its number of shingles, and how many of them are none of any line it is similar to."""
    return F.struct((place / F.col("n")).alias("early"), place.cast("int").alias("place"), F.col("n"))


def likely(similarity: float) -> Callable[[str, str], Column]:
    """Can lines of these marks be similar?  They have no more in common than either has left behind its place."""

    def enough(x: str, y: str) -> Column:
        left = F.least(F.col(f"{x}.n") - F.col(f"{x}.place"), F.col(f"{y}.n") - F.col(f"{y}.place"))
        return left >= F.lit(similarity / (1 + similarity)) * (F.col(f"{x}.n") + F.col(f"{y}.n")) - F.lit(SLACK)

    return enough


def rarest(texts: DataFrame, size: int, similarity: float) -> DataFrame:
    """band, id, mark: lines by their rarest shingles, as many as two similar lines need to share one for certain.

    A line that is similar to one of n shingles has at least n times the similarity in common with it, so one of any
    other n - ceil(n * similarity) + 1 is too.  All lines order their shingles by the lines they are in, so of what two
    have in common the first is among these in both, and all before it are in one of them only.
    """
    each = texts.select("id", "n", F.explode(F.array_distinct(shingles(F.col("norm"), size))).alias("shingle"))
    each = each.select("id", "n", F.xxhash64("shingle").alias("band"))
    counts = each.groupBy("band").agg(F.count("*").alias("lines"))
    ordered = Window.partitionBy("id").orderBy("lines", "band")
    placed = each.join(counts, "band").withColumn("place", F.row_number().over(ordered) - 1)
    few = F.col("place") <= F.floor(F.col("n") * F.lit(1 - similarity) + F.lit(SLACK))
    return placed.filter(few & (F.col("lines") > 1)).select("band", "id", marked(F.col("place")).alias("mark"))


def meetings(shared: DataFrame, texts: DataFrame, size: int, similarity: float) -> DataFrame:
    """band, id, mark: lines by their buckets, and those of crowded buckets by their rarest shingles instead."""
    rows = settle(shared.join(texts.select("a", "b", "id", "n"), ["a", "b"]).select("band", "id", "n"))
    counts = rows.groupBy("band").agg(F.count("*").alias("lines"))
    small = rows.join(counts.filter(F.col("lines") <= CROWD), "band").select("band", "id", marked(F.lit(0)).alias("mark"))
    crowd = settle(rows.join(counts.filter(F.col("lines") > CROWD), "band").select("id").distinct())
    out = settle(small.union(rarest(matching(texts, crowd, "id", "left_semi"), size, similarity)))
    forget(rows, crowd)
    return out


def verified(pairs: DataFrame, texts: DataFrame, size: int, similarity: float) -> DataFrame:
    """The pairs whose shingles have the similarity at least; texts has id, norm, n of every line in a pair."""
    both = pairs.join(texts.select(F.col("id").alias("x"), F.col("norm").alias("p"), F.col("n").alias("of_x")), "x")
    both = both.join(texts.select(F.col("id").alias("y"), F.col("norm").alias("q"), F.col("n").alias("of_y")), "y")
    # The smaller set is all they can have in common.
    both = both.filter(F.least("of_x", "of_y") >= F.lit(similarity) * F.greatest("of_x", "of_y"))
    common = F.size(F.array_intersect(shingles(F.col("p"), size), shingles(F.col("q"), size)))
    # Exploded, so that a filter does not count the common ones anew for each use.
    both = both.select("x", "y", "of_x", "of_y", F.explode(F.array(common)).alias("common"))
    return both.filter(F.col("common") >= F.lit(similarity) * (F.col("of_x") + F.col("of_y") - F.col("common"))).select("x", "y")


def deduplicate(
    docs: DataFrame, size: int = SIZE, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, row, line_no, keep_doc_id, keep_line_no, group_size, kept of every line that is not blank.

    Lines are compared lower-cased and without white space at their ends.  Blank lines are no rows and are never dropped;
    NULL and empty texts have none.  A line shorter than a shingle is one shingle of its own.  The first line of a
    component by doc_id (NULL last), then row and line number, stays; repeated rows count each.
    """
    lines = split_lines(id_and_text(docs, id_col, text_col))
    # Most lines are alone in all their buckets and need no text.
    shared = settle(in_company(candidates(signatures(lines, size))))
    swept(docs.sparkSession)
    ids = settle(shared.select("a", "b").distinct())
    texts = settle(in_pairs(lines, ids, size))
    met = meetings(shared, texts, size, similarity)
    forget(shared, ids)
    swept(docs.sparkSession)
    links = bucket_links(met, lambda pairs: verified(pairs, texts, size, similarity), likely=likely(similarity))
    forget(met)
    swept(docs.sparkSession)
    named = texts.select(F.col("id").alias("root"), F.struct("a", "b").alias("name"))
    of = components(links, "x", "y").withColumnRenamed("node", "id").join(named, "root")
    of = settle(of.join(texts.select("id", "a", "b"), "id").select("a", "b", F.col("name").alias("root")))
    forget(links, texts)
    own = F.struct("a", "b")
    placed = lines.select("doc_id", "row", "line_no", "a", "b").join(of, ["a", "b"], "left")
    placed = settle(placed.select("doc_id", "row", "line_no", F.coalesce("root", own).alias("root")))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "line_no")
    # Written out, so that a component with very many lines can be split in the join.
    groups = placed.groupBy("root").agg(F.min(place).alias("first"), F.count("*").alias("group_size"))
    groups = settle(groups.filter("group_size > 1"))
    alone = F.col("group_size").isNull()
    return placed.join(groups, "root", "left").select(
        "doc_id",
        "row",
        "line_no",
        F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("keep_doc_id"),
        F.when(alone, F.col("line_no")).otherwise(F.col("first.line_no")).alias("keep_line_no"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (alone | ((F.col("row") == F.col("first.row")) & (F.col("line_no") == F.col("first.line_no")))).alias("kept"),
    )


def clean(docs: DataFrame, size: int = SIZE, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text of every row without the lines that were dropped; blank lines stay, and a NULL text is an empty one."""
    base = id_and_text(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id())
    drop = deduplicate(docs, size, similarity, id_col, text_col).filter("NOT kept")
    drop = drop.groupBy("row").agg(F.collect_list("line_no").alias("gone"))  # lines of one document
    kept = F.filter(F.split("text", "\n"), lambda line, i: ~F.array_contains(F.coalesce("gone", F.array()), i))
    return base.join(drop, "row", "left").select("doc_id", F.array_join(kept, "\n").alias("text"))
