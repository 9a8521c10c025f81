"""Operator 11: repeated byte strings by the common-prefix intervals of an enhanced suffix array.

Only suffixes that may repeat are sorted.  Every string of `least` bytes has one anchor, its run of ANCHOR bytes
of the smallest hash, at the same place wherever the string occurs.  Strings that begin near before their anchor have
twice as many bytes in common as the anchor has, and so have those that begin far before it: these are the keys of an
anchor's occurrence.  Texts lie in blocks; a block asks with its keys, 32 bits each, and is answered a bit for each: does
another text have it?  Strings whose key is in one text only are put aside; the rest are cut out as *cuts*: the bytes of
all strings that have one occurrence of an anchor.  Equal cuts become one row, and all cuts of an anchor meet in one
place, so every occurrence of a repeated string does.

There the suffixes that begin a string are sorted, the common prefixes of neighbours give the enhanced array, and a
stack scan gives its intervals: each is a string with all its occurrences.  An interval whose occurrences are all
preceded by one and the same interval, with no occurrence lost, is no group of its own but makes that one longer; those
with different left extensions begin a maximal repeat.  Maximal repeats that go on beyond a cut are joined in the
document of their first occurrence, by sums over their occurrences that do not depend on the place.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reviewlake.llm.common import bounded_batches, forget, freeing, id_and_text, matching, settle, slices, swept
from reviewlake.llm.wordhash import Hasher, mixed

ANCHOR = 16
# Bytes of a long text that are looked at together.
SEGMENT = 1 << 22
# Bytes of several texts that are looked at together: what is computed from them stays in the processor's cache.
PIECE = 1 << 18
# Bytes of the texts that are one block, at the most a segment's beyond it: fewer rows than its bits of a key count.
BLOCK = 1 << 22
# Keys that are compared together, at the most one part's beyond it.
KEYS = 1 << 20
# An anchor with more different cuts than this is cut into single strings, which meet only their equals.
MANY_CUTS = 4096
# Suffixes that are sorted together, at the most one anchor's beyond it.
SUFFIXES = 400_000
_PLACE = 24
# A key is the upper bits of its hash, the row of its text in a block takes the others; what is sent is 32 bits in a part.
_ROWS = 20
_PART = 32
_MASK = (1 << 62) - 1
# A span as one number; none is longer than two strings.
_SPAN = 1 << 20
# A row without doc_id comes after all others.
NO_ID = (1 << 63) - 1


def _hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the ANCHOR bytes from each place on; places past the last whole one are left out."""
    n = len(data) - ANCHOR + 1
    eight = np.empty(len(data) - 7, np.uint64)
    for i in range(min(8, len(eight))):
        own = eight[i::8]
        own[:] = np.frombuffer(data, "<u8", len(own), i)
    out = eight[:n] * np.uint64(0x9E3779B97F4A7C15)
    out ^= out >> np.uint64(29)
    out += eight[8 : n + 8]
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    out *= np.uint64(0x94D049BB133111EB)
    return out


def anchored(data: np.ndarray, ends: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and last start of the strings that share an anchor, its place, and the hashes of all places; no string crosses one of ends."""
    width = least - ANCHOR + 1
    none = np.zeros(0, np.int64)
    if len(data) < least:
        return none, none, none, np.zeros(0, np.uint64)
    hashes = _hashes(data)
    # Of equal hashes the first; the place is needed to find it again.
    least_of = hashes & ~np.uint64((1 << _PLACE) - 1)
    least_of |= np.arange(len(hashes), dtype=np.uint64)
    step = 1
    while 2 * step <= width:
        least_of = np.minimum(least_of[:-step], least_of[step:])
        step *= 2
    rest = width - step
    least_of = np.minimum(least_of[: len(least_of) - rest], least_of[rest:])
    new = np.empty(len(least_of), bool)
    new[0] = True
    np.not_equal(least_of[1:], least_of[:-1], out=new[1:])
    begins = np.r_[0, ends[:-1]]
    new[begins[begins < len(new)]] = True
    # No string begins where it would cross the end of its text.
    edges = np.zeros(len(new) + 1, np.int8)
    long = ends - begins >= least
    np.add.at(edges, begins[long], 1)
    np.add.at(edges, np.minimum(ends[long] - least + 1, len(new)), -1)
    first = np.flatnonzero(new & (np.cumsum(edges[:-1], dtype=np.int8) > 0))
    if not len(first):
        return none, none, none, hashes
    end = ends[np.searchsorted(ends, first, "right")]
    last = np.minimum(np.r_[first[1:], len(new)] - 1, end - least)
    anchor = (least_of[first] & np.uint64((1 << _PLACE) - 1)).astype(np.int64)
    return first, last, anchor, hashes


def halved(first: np.ndarray, last: np.ndarray, anchor: np.ndarray, hashes: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Twice, for the strings of each cut that begin near before its anchor and for those far before it: is there one, the first, the last, and a key.

    A key is a hash of bytes that all those strings have at one place beside the anchor, whatever the cut around them.
    """
    width = least - ANCHOR + 1
    half = (width + 1) // 2
    own = hashes[anchor]
    right, left = hashes[np.minimum(anchor + width - half, len(hashes) - 1)], hashes[np.maximum(anchor - half, 0)]
    yield anchor - last < half, np.maximum(first, anchor - half + 1), last, mixed(mixed(own) + right)
    yield anchor - first >= half, first, np.minimum(last, anchor - half), mixed(mixed(left) + own + np.uint64(1))


def gathered(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    """data[start : start + size] for each start, as binary values."""
    offsets = np.r_[0, np.cumsum(size)]
    at = np.arange(offsets[-1]) + np.repeat(start - offsets[:-1], size)
    buffers = [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data[at])]
    return pa.Array.from_buffers(pa.binary(), len(start), buffers)


def segments(block: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, bytes, ends of the texts in them, place of each text's first byte) in parts of bounded size."""
    place = np.asarray(block.column("place"))
    for first, some in slices(block.column("bytes"), PIECE):
        ends = np.cumsum([len(t) for t in some])
        yield first, np.frombuffer(b"".join(some), np.uint8), ends, place[first : first + len(some)]


def cut(block: pa.RecordBatch, least: int) -> Iterator[tuple]:
    """(row of the block, place in its text of the first byte of data, anchors' hashes, bytes, both halves of all cuts)."""
    for row, data, ends, place in segments(block):
        first, last, anchor, hashes = anchored(data, ends, least)
        if len(first):
            of = np.searchsorted(ends, first, "right")
            begin = np.r_[0, ends[:-1]][of]
            yield row + of, place[of] - begin, hashes[anchor].view(np.int64), data, list(halved(first, last, anchor, hashes, least))


def asked(cuts: list[tuple]) -> np.ndarray:
    """The keys of a block in order: once those of one text, twice those of several."""
    rest = np.uint64((1 << _ROWS) - 1)
    each = [key[there] & ~rest | row[there].astype(np.uint64) for row, _, _, _, halves in cuts for there, _, _, key in halves]
    keys = np.sort(np.concatenate(each)) if each else np.zeros(0, np.uint64)
    keys = keys[np.r_[True, keys[1:] != keys[:-1]][: len(keys)]] >> np.uint64(_ROWS)
    keep = np.ones(len(keys), bool)
    keep[2:] = keys[2:] != keys[:-2]
    return keys[keep]


def told(keys: np.ndarray, parts: np.ndarray, bits: list[bytes]) -> np.ndarray:
    """Those of the asked keys that another text has, as the answers (part, a bit for each of its keys) say."""
    bounds = np.searchsorted(keys >> np.uint64(_PART), np.r_[parts, parts + 1].astype(np.uint64)).reshape(2, -1)
    each = [keys[low:high][np.unpackbits(np.frombuffer(b, np.uint8), count=high - low).view(bool)] for low, high, b in zip(*bounds.tolist(), bits)]
    return np.sort(np.concatenate(each))


def compared(parts: np.ndarray, sizes: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of so many keys each, the keys' parts and lower bits: which rows have one that is here twice, where their bits end, and the bits."""
    keys = np.repeat(parts.astype(np.uint64), sizes) << np.uint64(_PART) | low
    order = np.argsort(keys, kind="stable")
    twice = keys[order[1:]] == keys[order[:-1]]
    shared = np.zeros(len(keys), bool)
    shared[order[1:][twice]] = True
    shared[order[:-1][twice]] = True
    some = np.add.reduceat(shared, np.cumsum(sizes) - sizes, dtype=np.int64) > 0
    # The bits of a row begin with a byte.
    room = np.where(some, (sizes + 7) // 8, 0)
    ends, keep = np.cumsum(room), np.repeat(some, sizes)
    at = np.arange(len(keys)) + np.repeat(8 * (ends - room) - (np.cumsum(sizes) - sizes), sizes)
    bits = np.zeros(8 * int(room.sum()), bool)
    bits[at[keep]] = shared[keep]
    return some, ends[some], np.packbits(bits)


def intervals(common: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """(depth, first, last) of the common-prefix intervals of at least that depth, inner ones before those around them.

    common[i] is the length of the common prefix of suffixes i - 1 and i in the sorted array; common[0] is unused.
    """
    deep = np.flatnonzero(common[1:] >= least) + 1
    if not len(deep):
        return
    breaks = np.flatnonzero(np.diff(deep) > 1)
    runs = zip(deep[np.r_[0, breaks + 1]].tolist(), deep[np.r_[breaks, len(deep) - 1]].tolist())
    values = common.tolist()
    for begin, end in runs:
        stack = [(values[begin], begin - 1)]
        for i in range(begin + 1, end + 1):
            depth, left = values[i], i - 1
            while stack and stack[-1][0] > depth:
                inner, left = stack.pop()
                yield inner, left, i - 1
            if not stack or stack[-1][0] < depth:
                stack.append((depth, left))
        while stack:
            inner, left = stack.pop()
            yield inner, left, end


def suffix_classes(data: np.ndarray, start: np.ndarray, size: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the cuts' strings of `least` bytes: cut, offset in it and class; equal strings are of one class.

    The suffixes of all cuts that begin a string are sorted to their cut's end.  An outermost interval of depth `least`
    or more holds all occurrences of one string; a suffix in no interval is a class of its own.
    """
    count = size - least + 1
    of = np.repeat(np.arange(len(start)), count)
    offset = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    classes = np.arange(len(of))
    # A string whose hash is here once is a class of its own; the others are sorted.
    hasher = Hasher()
    sums = hasher.sums(data)
    begin = start[of] + offset
    hashes = hasher.spans(sums, begin, begin + least)
    order = np.argsort(hashes)
    twice = hashes[order[1:]] == hashes[order[:-1]]
    may = np.zeros(len(of), bool)
    may[order[1:][twice]] = True
    may[order[:-1][twice]] = True
    at = np.flatnonzero(may)
    if not len(at):
        return of, offset, classes
    begin, left = begin[at], (size[of] - offset)[at]
    widest = int(left.max())
    padded = np.r_[data, np.zeros(widest, np.uint8)]
    rows = np.lib.stride_tricks.sliding_window_view(padded, widest)[begin]
    # Bytes beyond the cut's end are blanked.
    rows = np.where(np.arange(widest) < left[:, None], rows, np.uint8(0))
    order = np.argsort(np.ascontiguousarray(rows).view(f"S{widest}").ravel(), kind="stable")
    rows, left = rows[order], left[order]
    differ = rows[1:] != rows[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), widest)
    common = np.r_[0, np.minimum(common, np.minimum(left[1:], left[:-1]))]
    head = np.arange(len(order))
    for _, low, high in intervals(common, least):
        head[low : high + 1] = low  # the outermost comes last
    classes[at[order]] = at[head]
    return of, offset, classes


def grown(of: np.ndarray, classes: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Which strings go on the repeat of the string before them in their cut: it is the left extension of them all."""
    same = np.r_[False, of[1:] == of[:-1]]
    before = np.where(same, np.r_[-1, classes[:-1]], -1)
    low, high = np.full(len(classes), np.iinfo(np.int64).max), np.full(len(classes), -2)
    np.minimum.at(low, classes, before)
    np.maximum.at(high, classes, before)
    one = (low == high) & (low >= 0)
    one[one] &= count[low[one]] == count[one]
    return one[classes]


def _binary(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of binary values (first a zero) and their bytes."""
    values = column.combine_chunks()
    offsets = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1].astype(np.int64)
    return offsets - offsets[0], np.frombuffer(values.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]


def _whole(batches: Iterator[pa.RecordBatch], by: str, weight: Callable[[pa.RecordBatch], int], most: int) -> Iterator[pa.Table]:
    """The rows in tables of whole groups, which come in order, with little more weight than `most` but for one group's."""
    waiting: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        groups = np.asarray(batch.column(by))
        # Where the last group of the batch begins: it may go on in the next one.
        border = int(np.flatnonzero(groups != groups[-1])[-1]) + 1 if groups[0] != groups[-1] else 0
        if border == 0 and waiting and np.asarray(waiting[-1].column(by))[-1] != groups[0]:
            yield pa.Table.from_batches(waiting)
            waiting, size = [], 0
        size += weight(batch)
        if border and size > most:
            yield pa.Table.from_batches([*waiting, batch.slice(0, border)])
            waiting, size = [batch.slice(border)], 0
        else:
            waiting.append(batch)
    if waiting:
        yield pa.Table.from_batches(waiting)


def _blocks(rows: DataFrame, least: int) -> DataFrame:
    """block, data: the texts of rows (doc_id, text_key, text), some MB of them in a row of their own, compressed.

    Parts of a long text overlap, so that each string of it is in one of them.
    """
    names = ["doc_id", "text_key", "place", "bytes"]

    def closed(waiting: list[list]) -> pa.RecordBatch:
        block = pa.record_batch([pa.concat_arrays(column) for column in zip(*waiting)], names=names)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, block.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_batch(block)
        return pa.record_batch([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0
        for batch in batches:
            for first, some in slices(batch.column("text").cast(pa.binary())):
                ids, keys = (batch.column(c).slice(first, len(some)) for c in names[:2])
                if len(some) == 1 and len(some[0]) > SEGMENT:
                    parts = [(at, [some[0][at : at + SEGMENT + least - 1]]) for at in range(0, len(some[0]) - least + 1, SEGMENT)]
                else:
                    parts = [(0, some)]
                for at, texts in parts:
                    waiting.append([ids, keys, pa.array([at] * len(texts), pa.int64()), pa.array(texts, pa.binary())])
                    size += sum(map(len, texts))
                    if size >= BLOCK:
                        yield closed(waiting)
                        waiting, size = [], 0
        if waiting:
            yield closed(waiting)

    packed = rows.select("doc_id", "text_key", "text").mapInArrow(freeing(run), "data binary")
    return packed.select(F.monotonically_increasing_id().alias("block"), "data")


def _opened(data: pa.Scalar) -> pa.RecordBatch:
    return pa.ipc.open_stream(data.as_buffer()).read_next_batch()


def _asked(blocks: DataFrame, least: int) -> DataFrame:
    """part, block, keys: the keys of every block that are in a part, 32 bits each, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data in zip(batch.column("block"), batch.column("data")):
                keys = asked(list(cut(_opened(data), least)))
                parts = (keys >> np.uint64(_PART)).astype(np.int32)
                start = np.flatnonzero(np.r_[True, parts[1:] != parts[:-1]][: len(parts)])
                ends = pa.py_buffer((4 * np.r_[start, len(keys)]).astype(np.int32))
                values = pa.Array.from_buffers(pa.binary(), len(start), [None, ends, pa.py_buffer(keys.astype(np.uint32))])
                yield pa.record_batch([pa.array(parts[start]), pa.array([block.as_py()] * len(start), pa.int64()), values], names=["part", "block", "keys"])

    return blocks.mapInArrow(freeing(run), "part int, block long, keys binary")


def _answers(keys: DataFrame) -> DataFrame:
    """block, part, bits: of a block's keys in a part a bit each, whether another text has it; none if none has one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = lambda batch: int(pa.compute.sum(pa.compute.binary_length(batch.column("keys"))).as_py()) // 4
        for rows in _whole(batches, "part", weight, KEYS):
            offsets, data = _binary(rows.column("keys"))
            some, ends, bits = compared(np.asarray(rows.column("part")), np.diff(offsets) // 4, data.view(np.uint32))
            own = [rows.column(c).combine_chunks().filter(pa.array(some)) for c in ("block", "part")]
            values = pa.Array.from_buffers(pa.binary(), int(some.sum()), [None, pa.py_buffer(np.r_[0, ends].astype(np.int32)), pa.py_buffer(bits)])
            yield pa.record_batch([*own, values], names=["block", "part", "bits"])

    return keys.repartition("part").sortWithinPartitions("part").mapInArrow(freeing(run), "block long, part int, bits binary")


def _cuts(blocks: DataFrame, least: int) -> DataFrame:
    """gram, bytes, doc_id, text_key, at: the cuts of blocks (block, data, answers) of strings whose key another text has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, answers in zip(batch.column("data"), batch.column("answers")):
                block = _opened(data)
                ids, names = np.asarray(block.column("doc_id")), np.asarray(block.column("text_key"))
                cuts = list(cut(block, least))
                shared = told(asked(cuts), np.asarray(answers.values.field("part")), answers.values.field("bits").to_pylist())
                for row, place, gram, text, halves in cuts:
                    (near, near_first, last, _), (far, first, far_last, _) = halves
                    near, far = (there & _among(shared, key >> np.uint64(_ROWS)) for there, _, _, key in halves)
                    first, last = np.where(far, first, near_first), np.where(near, last, far_last)
                    keep = near | far
                    row, place, gram, first, last = row[keep], place[keep], gram[keep], first[keep], last[keep]
                    yield pa.record_batch(
                        [pa.array(gram), gathered(text, first, last - first + least), pa.array(ids[row]), pa.array(names[row]), pa.array(first + place)],
                        names=["gram", "bytes", "doc_id", "text_key", "at"],
                    )

    return blocks.mapInArrow(freeing(run), "gram long, bytes binary, doc_id long, text_key long, at long")


def _among(some: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys are among some, which are in order."""
    return some[np.minimum(np.searchsorted(some, keys), len(some) - 1)] == keys


def _single(cuts: DataFrame, least: int) -> DataFrame:
    """Each string of the cuts as a cut of its own, named by its whole bytes."""
    at = F.explode(F.sequence(F.lit(0), F.length("bytes") - least)).alias("i")
    each = cuts.select("bytes", "doc_id", "text_key", "at", at)
    own = F.substring("bytes", F.col("i") + 1, F.lit(least))
    return each.select(F.xxhash64(own, F.lit(1)).alias("gram"), own.alias("bytes"), "doc_id", "text_key", (F.col("at") + F.col("i")).alias("at"))


def _weight(salt: int) -> Column:
    """A number of 40 bits for a document's text."""
    return F.shiftrightunsigned(F.xxhash64("doc_id", "text_key", F.lit(salt)), 24)


def _modular(sums: Column) -> Column:
    return F.pmod(sums, F.lit(_MASK + 1).cast("decimal(38,0)")).cast("long")


def _classes(contents: DataFrame, least: int) -> DataFrame:
    """The maximal runs of strings of each content that repeat as one: h1, h2, start, strings and figures of their occurrences.

    contents: gram, bytes, and the figures of equal cuts.  All contents of a gram are in one task, in order.
    """
    wide = "first_at" in contents.columns
    figures = ["n", "s0", "s1", "s2"] if wide else []
    names = ["h1", "h2", "start", "strings", "least_doc", *(["least_key", "least_at", *figures] if wide else [])]
    u64 = lambda x: np.asarray(x).astype(np.uint64)

    def found(rows: pa.Table) -> pa.RecordBatch:
        offsets, data = _binary(rows.column("bytes"))
        of, offset, classes = suffix_classes(data, offsets[:-1], np.diff(offsets), least)
        low, high = np.asarray(rows.column("least_doc")), np.asarray(rows.column("most_doc"))
        n = len(classes)
        first, last = np.full(n, NO_ID), np.full(n, -(1 << 63))
        np.minimum.at(first, classes, low[of])
        np.maximum.at(last, classes, high[of])
        mass = np.zeros(n, np.int64)
        np.add.at(mass, classes, np.asarray(rows.column("n"))[of])
        repeated = (first < last)[classes]
        goes_on = grown(of, classes, mass) & np.r_[False, repeated[:-1]]
        head = np.flatnonzero(repeated & ~goes_on)
        ends = np.flatnonzero(~repeated | ~goes_on)
        until = np.r_[ends, n][np.searchsorted(ends, head, "right")]
        h = [rows.column(c).take(pa.array(of[head])).combine_chunks() for c in ("h1", "h2")]
        out = [*h, pa.array(offset[head]), pa.array(until - head), pa.array(first[classes[head]])]
        if wide:
            # The first occurrence of a class, and sums over all of them, counted from its start there.
            key, at = np.asarray(rows.column("first_key"))[of], np.asarray(rows.column("first_at"))[of] + offset
            order = np.lexsort((at, key, low[of], classes))
            lead = order[np.r_[True, np.diff(classes[order]) > 0]]
            least_key, least_at = np.zeros(n, np.int64), np.zeros(n, np.int64)
            least_key[classes[lead]], least_at[classes[lead]] = key[lead], at[lead]
            s0, s1, s2 = (u64(rows.column(c))[of] for c in ("s0", "s1", "s2"))
            shift = offset.astype(np.uint64)
            two = np.uint64(2)
            s2 = s2 + two * shift * s1 + shift * shift * s0
            s1 = s1 + shift * s0
            t0, t1, t2 = (np.zeros(n, np.uint64) for _ in range(3))
            for total, s in ((t0, s0), (t1, s1), (t2, s2)):
                np.add.at(total, classes, s)
            c = least_at.astype(np.uint64)
            t2 = t2 - two * c * t1 + c * c * t0
            t1 = t1 - c * t0
            pick = classes[head]
            out += [pa.array(least_key[pick]), pa.array(least_at[pick]), pa.array(mass[pick])]
            out += [pa.array((t[pick] & np.uint64(_MASK)).astype(np.int64)) for t in (t0, t1, t2)]
        return pa.record_batch(out, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = lambda batch: int(pa.compute.sum(pa.compute.binary_length(batch.column("bytes"))).as_py()) - (least - 1) * batch.num_rows
        yield from map(found, _whole(batches, "gram", weight, SUFFIXES))

    types = ", ".join(f"{n} long" for n in names)
    dealt = contents.repartition("gram").sortWithinPartitions("gram")
    return dealt.mapInArrow(freeing(run), types)


def _settled_cuts(rows: DataFrame, least: int) -> DataFrame:
    """The cuts of all strings whose key two rows of (doc_id, text_key, text) share, as a written table."""
    spark = rows.sparkSession
    # What is read again is the same blocks; they are compressed.
    blocks = settle(_blocks(rows, least), codec="uncompressed")
    answers = settle(_answers(_asked(blocks, least)))
    swept(spark)
    own = answers.groupBy("block").agg(F.collect_list(F.struct("part", "bits")).alias("answers"))
    # Neighbouring cuts overlap, so they take little room.
    cuts = settle(_cuts(blocks.join(own.hint("shuffle_hash"), "block").select("data", "answers"), least), codec="zstd")
    forget(blocks, answers)
    swept(spark)
    return cuts


def _contents(cuts: DataFrame, least: int, *figures: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Equal cuts as one row with those figures, the cuts themselves, both with two hashes of their bytes, and a table to forget.

    Anchors with very many different cuts are cut string by string in both.
    """
    by = ["gram", "bytes"]
    contents = settle(cuts.groupBy(*by).agg(*figures), codec="zstd")
    hot = settle(contents.groupBy("gram").agg(F.count("*").alias("n")).filter(f"n > {MANY_CUTS}").select("gram"))
    swept(cuts.sparkSession)
    if not hot.head(1):
        return _keyed(contents), _keyed(cuts), contents
    single = settle(_single(matching(cuts, hot, "gram", "left_semi"), least))
    cold = matching(cuts, hot, "gram", "left_anti")
    both = matching(contents, hot, "gram", "left_anti").unionByName(single.groupBy(*by).agg(*figures))
    return _keyed(both), _keyed(cold.unionByName(single)), contents


def _keyed(cuts: DataFrame) -> DataFrame:
    return cuts.withColumns({"h1": F.xxhash64("bytes"), "h2": F.xxhash64("bytes", F.lit(2))})


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """All rows as doc_id (without one: NO_ID), known, text, n_bytes, text_key."""
    return id_and_text(docs, id_col, text_col).select(
        F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), F.col("doc_id").isNotNull().alias("known"), "text",
        F.octet_length("text").cast("long").alias("n_bytes"), F.xxhash64("text").alias("text_key"),
    )


def repeat_groups(docs: DataFrame, least: int = 50, id_col="doc_id", text_col="text") -> DataFrame:
    """group_doc, group_at, length, occurrences, doc_id, at: every occurrence of every repeat, a row each.

    A repeat is a longest string whose strings of `least` bytes all have the same occurrences, in two documents at least; it
    is named by its first occurrence (smallest doc_id, then place).  So every repeated string is in exactly one repeat, with
    all its occurrences, and a longer common passage of which parts occur more often is several repeats side by side.  Places count bytes of UTF-8.  Equal texts take part with each of their ids; repeated rows (doc_id and
    text) count once, and texts of one doc_id are one document that occurs in several texts.  A NULL or empty text has no
    repeats; rows with a NULL id are one document, the last.  An empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    rows = _rows(docs, id_col, text_col).filter(f"n_bytes >= {least}").select("doc_id", "text_key", "text").distinct()
    cuts = _settled_cuts(rows, least)
    place = F.struct("doc_id", "text_key", "at")
    weight = _weight(0).cast("decimal(38,0)")
    contents, cuts, _ = _contents(
        cuts, least,
        F.count("*").alias("n"), F.min(place).alias("place"), F.max("doc_id").alias("most_doc"),
        *(_modular(F.sum(F.pmod((w * x).cast("decimal(38,0)"), F.lit(_MASK + 1).cast("decimal(38,0)")))).alias(s)
          for s, w, x in (("s0", weight, F.lit(1).cast("decimal(1,0)")), ("s1", _weight(0).cast("decimal(13,0)"), F.col("at").cast("decimal(11,0)")),
                          ("s2", _weight(0).cast("decimal(13,0)"), (F.col("at").cast("decimal(11,0)") * F.col("at").cast("decimal(11,0)")).cast("decimal(22,0)")))),
    )
    contents = contents.select(
        "gram", "bytes", "h1", "h2", "n", F.col("place.doc_id").alias("least_doc"), F.col("place.text_key").alias("first_key"),
        F.col("place.at").alias("first_at"), "most_doc", "s0", "s1", "s2",
    )
    runs = settle(_classes(contents, least))
    # Runs of one repeat follow each other where it first occurs and have the same sums.
    lead = runs.groupBy("least_doc", "least_key", "least_at").agg(*(F.first(c).alias(c) for c in ("strings", "n", "s0", "s1", "s2")))
    order = Window.partitionBy("least_doc", "least_key").orderBy("least_at")
    goes_on = (F.lag(F.col("least_at") + F.col("strings")).over(order) == F.col("least_at"))
    for c in ("n", "s0", "s1", "s2"):
        goes_on = goes_on & (F.lag(c).over(order) == F.col(c))
    lead = lead.withColumn("new", (~F.coalesce(goes_on, F.lit(False))).cast("long"))
    lead = lead.withColumn("number", F.sum("new").over(order))
    named = lead.groupBy("least_doc", "least_key", "number").agg(
        F.min("least_at").alias("least_at"), F.max("n").alias("occurrences"),
        (F.max(F.col("least_at") + F.col("strings")) - F.min("least_at") + least - 1).alias("length"),
    )
    starts = runs.select("h1", "h2", "start", "least_doc", "least_key", "least_at").join(named, ["least_doc", "least_key", "least_at"])
    out = cuts.select("h1", "h2", "doc_id", "at").join(starts, ["h1", "h2"])
    real = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return out.select(
        real("least_doc").alias("group_doc"), F.col("least_at").alias("group_at"), "length", "occurrences",
        real("doc_id").alias("doc_id"), (F.col("at") + F.col("start")).alias("at"),
    )


def repeated_spans(rows: DataFrame, least: int) -> DataFrame:
    """doc_id, text_key, spans (start * _SPAN + length): of rows (doc_id, text_key, text) what repeats a smaller doc_id."""
    cuts = _settled_cuts(rows, least)
    figures = F.count("*").alias("n"), F.min("doc_id").alias("least_doc"), F.max("doc_id").alias("most_doc")
    contents, cuts, written = _contents(cuts, least, *figures)
    runs = settle(_classes(contents, least))
    forget(written)
    swept(rows.sparkSession)
    found = cuts.select("h1", "h2", "doc_id", "text_key", "at").join(runs, ["h1", "h2"]).filter("least_doc < doc_id")
    span = (F.col("at") + F.col("start")) * _SPAN + F.col("strings") + least - 1
    spans = settle(found.groupBy("doc_id", "text_key").agg(F.collect_list(span).alias("spans")))
    forget(runs, cuts)
    swept(rows.sparkSession)
    return spans


def _marks(size: int, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    edges = np.zeros(size + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + lengths, -1)
    return np.cumsum(edges[:-1]) > 0


def remove_repeats(docs: DataFrame, least: int = 50, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes) of every row.

    Every byte covered by a string of `least` bytes that also starts in a document with a smaller doc_id goes.  Strings
    are judged on the input.  NULL and empty texts have no bytes; rows of one doc_id, repeated rows among them, do not
    take from each other; rows with a NULL doc_id come after all others and do not take from each other either.  A text
    that occurs again with a larger doc_id goes there as a whole.  An empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    rows = _rows(docs, id_col, text_col)
    # Rows whose text a smaller doc_id has go as a whole; the others are compared.
    sha = F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("sha")
    names = settle(rows.filter(f"n_bytes >= {least}").select("doc_id", "text_key", sha))
    many = names.groupBy("sha").agg(F.min("doc_id").alias("owner"), F.count("*").alias("n")).filter("n > 1")
    owners = settle(many.select("sha", "owner"))
    copies = names.join(owners, "sha").filter("owner < doc_id").select("doc_id", "text_key").distinct()
    copies = settle(copies.withColumn("copy", F.lit(True)))
    forget(names, owners)
    mine = matching(rows.filter(f"n_bytes >= {least}"), copies.drop("copy"), ["doc_id", "text_key"], "left_anti")
    spans = repeated_spans(mine.select("doc_id", "text_key", "text"), least)
    found = spans.unionByName(copies.select("doc_id", "text_key", F.lit(None).cast(spans.schema["spans"].dataType).alias("spans")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            removed, count, kept = [0] * n, [0] * n, [b""] * n
            lists, copy = batch.column("spans"), np.asarray(batch.column("copy"))
            sizes = pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            ends, flat = np.r_[0, np.cumsum(sizes)], lists.flatten()
            starts, lengths = np.divmod(np.asarray(flat), _SPAN)
            for first, texts in slices(batch.column("text").cast(pa.binary())):
                for i, text in enumerate(texts, first):
                    if copy[i]:
                        removed[i], count[i] = len(text), 1
                    elif sizes[i]:
                        own = slice(ends[i], ends[i + 1])
                        gone = _marks(len(text), starts[own], lengths[own])
                        removed[i] = int(gone.sum())
                        count[i] = int((gone & ~np.r_[False, gone[:-1]]).sum())
                        kept[i] = np.frombuffer(text, np.uint8)[~gone].tobytes()
                    else:
                        kept[i] = text
            digests = [hashlib.sha256(k).hexdigest() for k in kept]
            yield pa.record_batch(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array(removed, pa.int64()), pa.array(count, pa.int64()),
                 pa.array(digests), pa.array(kept, pa.binary())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    # Only rows that lose something meet their spans.
    keys = found.select("doc_id", "text_key")
    whole = matching(rows, keys, ["doc_id", "text_key"], "left_anti").select(
        "known", "doc_id", "text", "n_bytes", F.lit(False).alias("copy"), F.lit(None).cast(spans.schema["spans"].dataType).alias("spans")
    )
    cut_up = rows.join(found, ["doc_id", "text_key"]).select("known", "doc_id", "text", "n_bytes", F.col("spans").isNull().alias("copy"), "spans")
    marked = whole.unionByName(cut_up)
    shown = marked.select(F.when(F.col("known"), F.col("doc_id")).alias("doc_id"), "text", "n_bytes", "copy", "spans")
    return shown.mapInArrow(freeing(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
