"""Operator 5: mixing sources to target weights by min-cost flow.

Documents are aggregated by membership pattern, the set of sources they belong to.  A flow routes each pattern's
words to the quotas of its sources; the first copy of a pattern's words is free, each further one costs more
than the one before, so repetition is spread before it is deepened.  Then documents are picked in seeded order until
each pattern's flow is used up.
"""

from __future__ import annotations

import heapq
import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reviewlake.llm.common import WORDS, settle

# Patterns and sources pass through the driver: their number is that of distinct source sets, not of documents.
# The seeded order is searched so many hexadecimal digits at a time: 4096 slots for a pattern.
DIGITS = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def targets(sizes: dict, weights: dict, share: float, most: float) -> dict:
    """Words each source is to have: `share` of all sizes by weight, none above `most` times its own size.

    What a source cannot take is dealt again by weight among those that are not full.
    """
    total = share * sum(sizes.values())
    caps = {s: most * n for s, n in sizes.items()}
    # Sources fill up in the order of their room by weight.
    order = sorted(sizes, key=lambda s: (caps[s] / weights[s], str(s)))
    out, left, weight = {}, total, sum(weights.values())
    for s in order:
        if left * weights[s] / weight > caps[s]:
            out[s] = float(caps[s])
            left -= caps[s]
            weight -= weights[s]
        else:
            break
    return out | {s: left * weights[s] / weight for s in order if s not in out}


def min_cost_flow(supply: list[int], members: list[list[int]], quota: list[int], copies: int) -> list[int]:
    """Words each pattern gives, by successive shortest paths.

    supply[p]: words of pattern p; members[p]: its sources; quota[s]: words source s wants.  Copy c of a pattern's
    words costs c, counted from zero.
    """
    patterns, sources = len(supply), len(quota)
    start, end = 0, patterns + sources + 1
    graph: list[list[list[int]]] = [[] for _ in range(end + 1)]  # edges: to, room, cost, place of the reverse edge

    def edge(a: int, b: int, room: int, cost: int) -> None:
        graph[a].append([b, room, cost, len(graph[b])])
        graph[b].append([a, 0, -cost, len(graph[a]) - 1])

    for p in range(patterns):
        for c in range(copies):
            edge(start, 1 + p, supply[p], c)
        for s in members[p]:
            edge(1 + p, 1 + patterns + s, copies * supply[p], 0)
    for s in range(sources):
        edge(1 + patterns + s, end, quota[s], 0)
    potential = [0] * (end + 1)
    while True:
        far = [float("inf")] * (end + 1)
        far[start], come, queue = 0, [None] * (end + 1), [(0, start)]
        while queue:
            d, a = heapq.heappop(queue)
            if d > far[a]:
                continue
            for i, (b, room, cost, _) in enumerate(graph[a]):
                step = d + cost + potential[a] - potential[b]
                if room > 0 and step < far[b]:
                    far[b], come[b] = step, (a, i)
                    heapq.heappush(queue, (step, b))
        if come[end] is None:
            break
        potential = [p + (0 if d == float("inf") else int(d)) for p, d in zip(potential, far)]
        path, at = [], end
        while at != start:
            a, i = come[at]
            path.append((a, i))
            at = a
        push = min(graph[a][i][1] for a, i in path)
        for a, i in path:
            e = graph[a][i]
            e[1] -= push
            graph[e[0]][e[3]][1] += push
    # What left a pattern is the room its reverse edges to the start have gained.
    return [sum(e[1] for e in graph[1 + p] if e[0] == start) for p in range(patterns)]


def _placed(docs: DataFrame, seed: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """doc (all columns), _size (words), _pattern (its set of sources as text) and _place, its seeded place in the pattern."""
    kind = dict(docs.dtypes)[source_col]
    own = F.array_sort(F.array_distinct(docs[source_col])) if kind.startswith("array") else F.array(docs[source_col])
    none = F.coalesce(F.size(own), F.lit(0)) <= 0
    own = F.when(none, F.array(F.lit(None).cast("string"))).otherwise(own.cast("array<string>"))
    key = F.coalesce(docs[id_col].cast("string"), F.lit(""))
    return docs.select(
        F.struct(*docs.columns).alias("doc"),
        word_count(docs[text_col]).alias("_size"),
        F.to_json(F.struct(own.alias("s")), {"ignoreNullFields": "false"}).alias("_pattern"),
        F.md5(F.concat(F.lit(f"{seed}:"), key)).alias("_place"),
    )


def _plan(rows: DataFrame, weights: list[int] | dict, share: float, most: int) -> tuple[DataFrame, DataFrame]:
    """Per pattern: source_size, target, full copies and the rest; and where the rest ends.  As many rows as patterns."""
    spark = rows.sparkSession
    grouped = rows.groupBy("_pattern").agg(F.sum("_size").alias("size")).collect()
    patterns = [(tuple(json.loads(r._pattern)["s"]), int(r.size or 0), r._pattern) for r in grouped]
    patterns.sort(key=lambda p: [(s is None, s or "") for s in p[0]])
    names = sorted({s for p, _, _ in patterns for s in p}, key=lambda s: (s is None, s or ""))
    by_source = {s: sum(n for p, n, _ in patterns if s in p) for s in names}
    weight = weights if isinstance(weights, dict) else {s: weights[i % len(weights)] for i, s in enumerate(names)}
    # A word in several sources counts once in the share.
    total = sum(n for _, n, _ in patterns)
    target = targets(by_source, weight, share * total / max(1, sum(by_source.values())), most)
    place = {s: i for i, s in enumerate(names)}
    flow = min_cost_flow(
        [n for _, n, _ in patterns],
        [[place[s] for s in p] for p, _, _ in patterns],
        [round(target[s]) for s in names],
        most,
    )
    plan = [
        (key, by_source[p[0]], float(target[p[0]]), f // n if n else 0, f % n if n else 0)
        for (p, n, key), f in zip(patterns, flow)
    ]
    plan = spark.createDataFrame(plan, "_pattern string, source_size long, target double, full long, rest long")
    return plan, _ends(rows, plan)


def _ends(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Where each pattern's rest ends in seeded order: _pattern, prefix of the place, words left there, rows there.

    Sizes are summed per slot of the order; the slot a rest ends in is split further by the next digits, until it
    is one row or cannot be split.  No pattern's documents meet in one task.
    """
    live = plan.filter("rest > 0").select("_pattern", F.col("rest").alias("left"), F.lit("").alias("prefix"))
    sized = rows.filter("_size > 0").select("_pattern", "_place", "_size")
    found = []
    for cut in range(DIGITS, 32 + DIGITS, DIGITS):
        slots = (
            sized.join(F.broadcast(live), "_pattern")
            .filter(F.col("_place").startswith(F.col("prefix")))
            .groupBy("_pattern", "left", F.substring("_place", 1, cut).alias("slot"))
            .agg(F.sum("_size").alias("size"), F.count("*").alias("n"))
        )
        upto = F.sum("size").over(Window.partitionBy("_pattern").orderBy("slot"))  # 4096 slots at most
        ends = slots.withColumn("upto", upto).filter("upto >= left AND upto - size < left")
        ends = ends.select("_pattern", F.expr("left - (upto - size)").alias("left"), F.col("slot").alias("prefix"), "n")
        ends = settle(ends)
        whole = (F.col("n") == 1) | F.lit(cut >= 32)
        found.append(ends.filter(whole))
        live = ends.filter(~whole).drop("n")
        if not live.head(1):
            break
    return reduce(DataFrame.union, found)


def _taken(rows: DataFrame, plan: DataFrame, ends: DataFrame, most: int) -> DataFrame:
    """rows with source_size, target, taken and copies; a map, as both tables have one row per pattern."""
    joined = rows.join(F.broadcast(plan), "_pattern").join(F.broadcast(ends), "_pattern", "left")
    at = F.substring("_place", 1, F.length("prefix"))
    # Rows of one place are repeated rows of one id: they share what is left there.
    extra = (
        F.when((F.col("_size") == 0) | (F.col("rest") == 0), F.lit(0))
        .when(at < F.col("prefix"), F.col("_size"))
        .when(at == F.col("prefix"), F.least("_size", F.floor(F.col("left") / F.col("n"))))
        .otherwise(F.lit(0))
        .cast("long")
    )
    taken = F.col("full") * F.col("_size") + extra
    copies = F.when(F.col("_size") > 0, F.col("full") + (2 * extra >= F.col("_size")).cast("long")).otherwise(F.lit(0))
    joined = joined.withColumns({"taken": taken, "copies": copies.cast("long")})
    return joined.drop("_pattern", "_place", "full", "rest", "left", "prefix", "n")


def mix(
    docs: DataFrame,
    weights: list[int] | dict,
    share: float = 1.5,
    most: int = 2,
    seed: int = 42,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies of every row.

    source_col holds a source or an array of sources; NULL or no source is a source of its own.  `weights` are per
    source, or a list that repeats over the sources by code point, NULL last.  A document's size is its number of
    words; NULL and empty texts have none and are taken zero words (and no copy).  `taken` counts repeats and is never
    above `most` sizes; the one document of a pattern where its flow ends is taken in part, and copies rounds that
    part.  Repeated rows share one place in the order.  source_size and target are those of the first of a row's sources.
    """
    picked = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"), docs[source_col].alias("source"))
    rows = _placed(picked, seed, "doc_id", "text", "source")
    rows = settle(rows.select("doc.doc_id", "_size", "_pattern", "_place"))
    plan, ends = _plan(rows, weights, share, most)
    return _taken(rows, plan, ends, most).select(
        "doc_id", F.col("_size").alias("size"), "source_size", "target", "taken", "copies"
    )


def mixture(
    docs: DataFrame, weights: list[int] | dict, share: float = 1.5, most: int = 2, seed: int = 42,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """The rows of docs with all their columns, each as often as its copies."""
    placed = _placed(docs, seed, id_col, text_col, source_col)
    plan, ends = _plan(settle(placed.select("_size", "_pattern", "_place")), weights, share, most)
    rows = _taken(placed, plan, ends, most).filter("copies > 0")
    again = rows.select("doc", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return again.select("doc.*")


def oracle(weights: list[int], share: float = 1.5, most: int = 2, seed: int = 42) -> str:
    """The same mix of the table documents, each row in one source, in DuckDB's SQL."""
    return f"""
    WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
        md5('{seed}:' || doc_id) AS place FROM documents),
    s AS (SELECT source, sum(size)::BIGINT AS own, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM d GROUP BY source),
    r AS (SELECT *, ({weights})[(i % {len(weights)} + 1)::INT] AS w, {float(most)} * own AS cap FROM s),
    o AS (SELECT *, row_number() OVER (ORDER BY cap / w, coalesce(source, 'None')) AS k FROM r),
    f AS (SELECT *, {share} * sum(own) OVER () - coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room,
        sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest_w FROM o),
    b AS (SELECT *, min(k) FILTER (WHERE room * w / rest_w <= cap) OVER () AS open_k FROM f),
    t AS (SELECT source, own, CASE WHEN k < open_k THEN cap
        ELSE max(room) FILTER (WHERE k = open_k) OVER () * w / max(rest_w) FILTER (WHERE k = open_k) OVER () END::DOUBLE AS target FROM b),
    q AS (SELECT *, CASE WHEN own > 0 THEN round_even(target, 0)::BIGINT // own ELSE 0 END AS "full",
        CASE WHEN own > 0 THEN round_even(target, 0)::BIGINT % own ELSE 0 END AS rest FROM t),
    c AS (SELECT d.*, q.own, q.target, q."full", greatest(0, least(d.size,
        q.rest - (sum(d.size) OVER (PARTITION BY d.source ORDER BY place, d.doc_id ROWS UNBOUNDED PRECEDING) - d.size))) AS extra
        FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source)
    SELECT doc_id, size::BIGINT AS size, own AS source_size, target, ("full" * size + extra)::BIGINT AS taken,
        CASE WHEN size > 0 THEN "full" + (2 * extra >= size)::BIGINT ELSE 0 END::BIGINT AS copies FROM c"""
