"""Operator 9: FLAC media columns, written and read in numpy over all frames of a batch at once.

Streams are mono with a fixed block size and a seek point for every frame, so that a reader can begin at any
sample.  The decoder walks sample by sample through all frames of a batch side by side: Rice codes first, then
the predictors, then the checksums.  Streams of others without such a table are read frame after frame.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from reviewlake.llm.common import bounded_batches, freeing, id_and_text, slices

BLOCK = 576
PAD = 255
RATE = 8000
_ORDERS = (0, 1, 2)
_LARGEST_RICE = 8
# Fixed values of the format.
_BLOCK_CODES = {1: 192, 2: 576, 3: 1152, 4: 2304, 5: 4608} | {c: 256 << (c - 8) for c in range(8, 16)}
_SAMPLE_BITS = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24}
_CRC8, _CRC16 = 0x07, 0x8005
_FIXED_COEFFICIENTS = {0: (), 1: (1,), 2: (2, -1), 3: (3, -3, 1), 4: (4, -6, 4, -1)}


class BadStream(ValueError):
    """The bytes are no FLAC stream this reader knows, or a checksum differs."""


def _crc_table(polynomial: int, bits: int) -> np.ndarray:
    top, mask = 1 << (bits - 1), (1 << bits) - 1
    out = []
    for byte in range(256):
        value = byte << (bits - 8)
        for _ in range(8):
            value = ((value << 1) ^ polynomial if value & top else value << 1) & mask
        out.append(value)
    return np.array(out, np.uint16)


def crcs(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, polynomial: int, bits: int) -> np.ndarray:
    """Checksum of each run of bytes; all runs advance together, the longest first so that ended ones drop off."""
    table, shift = _crc_table(polynomial, bits), bits - 8
    order = np.argsort(-sizes, kind="stable")
    at, left = starts[order].astype(np.int64), sizes[order]
    out = np.zeros(len(starts), np.uint16)
    alive = np.searchsorted(-left, -np.arange(1, (left[0] if len(left) else 0) + 1), side="right")
    for step, n in enumerate(alive):
        now = out[:n]
        mixed = (now >> shift) ^ data[at[:n] + step]
        out[:n] = ((now << 8) if bits > 8 else 0) ^ table[mixed]
    result = np.empty_like(out)
    result[order] = out
    return result


def _coded_number(n: int) -> bytes:
    """A frame number the way the format writes it, like a UTF-8 character of up to 36 bits."""
    if n < 0x80:
        return bytes([n])
    tail, room = [], 0x40  # values the first byte can hold
    while n >= room:
        tail.append(0x80 | n & 0x3F)
        n >>= 6
        room = 0x20 >> (len(tail) - 1)
    lead = (0xFF00 >> (len(tail) + 1)) & 0xFF
    return bytes([lead | n, *reversed(tail)])


def _residuals(x: np.ndarray, order: int) -> np.ndarray:
    for _ in range(order):
        x = np.diff(x, axis=1)
    return x


def encode_frames(x: np.ndarray, numbers: list[int]) -> list[bytes]:
    """One frame of 8-bit samples per row: constant, verbatim, or the fixed predictor and Rice parameter that need least."""
    n, size = x.shape
    x = x.astype(np.int16)
    best = np.full(n, 8 * size)  # verbatim
    order, rice = np.full(n, -1), np.zeros(n, np.int64)
    folded = {}
    for o in _ORDERS:
        r = _residuals(x, o)
        folded[o] = u = ((r << 1) ^ (r >> 15)).view(np.uint16)
        for k in range(_LARGEST_RICE + 1):
            need = (u >> k).sum(1, dtype=np.int64) + (size - o) * (1 + k) + 8 * o + 10
            less = need < best
            best[less], order[less], rice[less] = need[less], o, k
    flat = (x == x[:, :1]).all(1)
    best[flat], order[flat] = 8, -2
    heads = [b"\xff\xf8\x20\x02" + _coded_number(i) for i in numbers]
    head = np.array([len(h) + 1 for h in heads])
    body = 1 + (best + 7) // 8
    whole = head + body + 2
    starts = np.concatenate([[0], np.cumsum(whole)])
    bits = np.zeros(8 * int(starts[-1]), np.uint8)
    first = 8 * (starts[:-1] + head + 1)  # of what follows the subframe's type
    for o in _ORDERS:
        of = np.flatnonzero(order == o)
        if not len(of):
            continue
        u, k = folded[o][of], rice[of]
        for b in range(4):
            bits[first[of] + 8 * o + 6 + b] = (k >> (3 - b)) & 1
        quotient = (u >> k[:, None].astype(np.uint16)).astype(np.int64)
        length = quotient + (1 + k)[:, None]
        end = np.cumsum(length, axis=1) + (first[of] + 8 * o + 10)[:, None]
        stop = end - (1 + k)[:, None]
        bits[stop.ravel()] = 1
        for b in range(int(k.max(initial=0))):
            deep = k > b
            bits[(end[deep] - 1 - b).ravel()] = ((u[deep] >> b) & 1).ravel()
    data = np.packbits(bits)
    raw = x.astype(np.int8).view(np.uint8)
    for i, h in enumerate(heads):
        data[starts[i] : starts[i] + len(h)] = np.frombuffer(h, np.uint8)
    after = starts[:-1] + head
    kinds = np.where(order == -2, 0, np.where(order == -1, 1, 8 + order))
    data[after] = kinds << 1
    data[after[order == -2] + 1] = raw[order == -2, 0]
    for i in np.flatnonzero(order == -1):
        data[after[i] + 1 : after[i] + 1 + size] = raw[i]
    for o in _ORDERS:
        of = np.flatnonzero(order == o)
        for j in range(o):
            data[after[of] + 1 + j] = raw[of, j]
    data[after - 1] = crcs(data, starts[:-1], head - 1, _CRC8, 8)
    sums = crcs(data, starts[:-1], whole - 2, _CRC16, 16)
    data[starts[1:] - 2], data[starts[1:] - 1] = sums >> 8, sums & 0xFF
    packed = data.tobytes()
    return [packed[a:b] for a, b in zip(starts[:-1].tolist(), starts[1:].tolist())]


def _block(kind: int, body: bytes, last: bool = False) -> bytes:
    return bytes([kind | 0x80 * last]) + len(body).to_bytes(3, "big") + body


# A metadata block holds less than 2**24 bytes; longer streams get as many seek tables as they need.
_POINTS = 900_000


def encode_streams(payloads: list[bytes]) -> list[bytes]:
    """Each payload, a positive multiple of 576 bytes, as a stream of 8-bit samples."""
    counts = [len(p) // BLOCK for p in payloads]
    x = (np.frombuffer(b"".join(payloads), np.uint8) ^ 0x80).view(np.int8).reshape(-1, BLOCK)
    frames = encode_frames(x, [i for c in counts for i in range(c)])
    out, at = [], 0
    for payload, count in zip(payloads, counts):
        own = frames[at : at + count]
        samples = x[at : at + count]
        at += count
        sizes = [len(f) for f in own]
        packed = (RATE << 44) | (0 << 41) | (7 << 36) | (count * BLOCK)
        info = struct.pack(">HH", BLOCK, BLOCK) + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big")
        info += packed.to_bytes(8, "big") + hashlib.md5(samples.tobytes()).digest()
        offset, points = 0, []
        for i, size in enumerate(sizes):
            points.append(struct.pack(">QQH", i * BLOCK, offset, BLOCK))
            offset += size
        tables = [b"".join(points[i : i + _POINTS]) for i in range(0, len(points), _POINTS)]
        blocks = [_block(3, t, i == len(tables) - 1) for i, t in enumerate(tables)]
        out.append(b"".join([b"fLaC", _block(0, info), *blocks, *own]))
    return out


def parse(media: bytes) -> dict:
    """Stream information, seek points and where the frames begin."""
    if media[:4] != b"fLaC":
        raise BadStream("no stream marker")
    at, out, points = 4, {}, []
    while True:
        if at + 4 > len(media):
            raise BadStream("ends within its metadata")
        kind, size = media[at], int.from_bytes(media[at + 1 : at + 4], "big")
        body = media[at + 4 : at + 4 + size]
        at += 4 + size
        if kind & 0x7F == 0:
            packed = int.from_bytes(body[10:18], "big")
            out |= {"block": int.from_bytes(body[2:4], "big"), "bits": (packed >> 36 & 31) + 1, "md5": body[18:34]}
            out |= {"channels": (packed >> 41 & 7) + 1, "samples": packed & (1 << 36) - 1}
        elif kind & 0x7F == 3:
            points += struct.iter_unpack(">QQH", body[: len(body) // 18 * 18])
        if kind & 0x80:
            break
    if "block" not in out:
        raise BadStream("no stream information")
    if out["channels"] != 1:
        raise BadStream("more than one channel")
    return out | {"points": [p for p in points if p[0] != (1 << 64) - 1], "frames": at}


def decode_frames(data: np.ndarray, starts: np.ndarray, size: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(samples by frame, end of each frame in bytes) of frames of `size` samples; data ends in 8 spare bytes."""
    n = len(starts)
    flat = np.unpackbits(data)
    ones = np.append(np.flatnonzero(flat), len(flat))
    before = np.zeros(len(flat) + 1, np.int32)
    np.cumsum(flat, dtype=np.int32, out=before[1:])
    wide = data.astype(np.uint32)
    window = np.zeros(len(data), np.uint32)
    window[:-4] = wide[:-4] << 24 | wide[1:-3] << 16 | wide[2:-2] << 8 | wide[3:-1]

    def read(at: np.ndarray, width) -> np.ndarray:
        """Up to 24 bits."""
        width = np.asarray(width, np.int64)
        return (window[at >> 3].astype(np.int64) >> (32 - (at & 7) - width)) & ((1 << width) - 1)

    if (data[starts] != 0xFF).any() or (data[starts + 1] != 0xF8).any():
        raise BadStream("no frame begins here")
    lead = data[starts + 4]
    extra = np.zeros(n, np.int64)
    for ones_in_lead in range(2, 8):
        extra[lead >= 0x100 - (1 << (8 - ones_in_lead))] = ones_in_lead - 1
    code = data[starts + 2] >> 4
    tail = np.where(code == 6, 1, np.where(code == 7, 2, 0))
    rate = data[starts + 2] & 15
    tail = tail + np.where(rate == 12, 1, np.where((rate == 13) | (rate == 14), 2, 0))
    head = 5 + extra + tail
    if (crcs(data, starts, head, _CRC8, 8) != data[starts + head]).any():
        raise BadStream("header checksum differs")
    kind = data[starts + head + 1]
    if (kind & 0x81).any():
        raise BadStream("reserved or wasted bits")
    kind = kind >> 1
    pos = 8 * (starts + head + 2).astype(np.int64)
    out = np.zeros((n, size), np.int64)

    def signed(at: np.ndarray, width: int) -> np.ndarray:
        value = read(at, width)
        return value - ((value >> (width - 1)) << width)

    constant, verbatim = kind == 0, kind == 1
    order = np.where((kind >= 8) & (kind <= 12), kind - 8, np.where(kind >= 32, kind - 31, 0)).astype(np.int64)
    if ((kind > 12) & (kind < 32) | (kind > 1) & (kind < 8)).any():
        raise BadStream("unknown subframe")
    out[constant] = signed(pos[constant], bits)[:, None]
    pos[constant] += bits
    if verbatim.any():
        out[verbatim] = signed(pos[verbatim, None] + bits * np.arange(size), bits)
        pos[verbatim] += bits * size
    coded = np.flatnonzero(~constant & ~verbatim)
    if len(coded):
        at, o = pos[coded], order[coded]
        for j in range(int(o.max())):
            more = o > j
            out[coded[more], j] = signed(at[more], bits)
            at[more] += bits
        most = int(o.max())
        coefficients, shift = np.zeros((len(coded), most), np.int64), np.zeros(len(coded), np.int64)
        for j in range(1, min(4, most) + 1):
            of = kind[coded] == 8 + j
            coefficients[of, :j] = _FIXED_COEFFICIENTS[j]
        lpc = kind[coded] >= 32
        if lpc.any():
            precision = read(at[lpc], 4) + 1
            raw = read(at[lpc] + 4, 5)
            shift[lpc] = raw - ((raw >> 4) << 5)
            at[lpc] += 9
            for j in range(most):
                more = lpc & (o > j)
                width = precision[o[lpc] > j]
                value = read(at[more], width)
                coefficients[more, j] = value - ((value >> (width - 1)) << width)
                at[more] += width
        long_rice = read(at, 2)
        if (long_rice > 1).any():
            raise BadStream("unknown residual coding")
        wide_parameter = 4 + long_rice
        parts = np.int64(1) << read(at + 2, 4)
        at += 6
        each = size // parts
        k = np.zeros(len(coded), np.int64)
        residual = np.zeros((size, len(coded)), np.int64)
        all_equal = bool((o == o[0]).all() and (parts == 1).all())
        for j in range(int(o.min()), size):
            begins = ((j % each) == 0) & (j >= o) | (j == o)
            if j < most + 1 or not all_equal and begins.any():
                k[begins] = read(at[begins], wide_parameter[begins])
                if (k[begins] == (1 << wide_parameter[begins]) - 1).any():
                    raise BadStream("unencoded residuals are not supported")
                at[begins] += wide_parameter[begins]
            stop = ones[before[at]]
            low = stop + 1
            u = (stop - at) << k | (window[low >> 3].astype(np.int64) >> (32 - (low & 7) - k)) & ((1 << k) - 1)
            value = (u >> 1) ^ -(u & 1)
            if j < most:
                read_now = j >= o
                residual[j] = np.where(read_now, value, 0)
                at = np.where(read_now, low + k, at)
            else:
                residual[j] = value
                at = low + k
        pos[coded] = at
        x = out[coded].T.copy()
        simple = ~lpc
        for j in range(most + 1):
            of = np.flatnonzero(simple & (o == j))
            if len(of):
                y = residual[:, of]
                warm = x[:j, of]
                for _ in range(j):
                    warm = np.diff(warm, axis=0, prepend=0)
                y[:j] = warm
                for _ in range(j):
                    y = np.cumsum(y, axis=0)
                x[:, of] = y
        of = np.flatnonzero(lpc)
        for j in range(int(o[of].min()) if len(of) else size, size):
            guess = np.zeros(len(of), np.int64)
            for i in range(min(most, j)):
                guess += coefficients[of, i] * x[j - 1 - i, of]
            new = residual[j, of] + (guess >> shift[of])
            x[j, of] = np.where(j >= o[of], new, x[j, of])
        out[coded] = x.T
    ends = (pos + 7) // 8
    if (ends + 2 > len(data) - 8).any():
        raise BadStream("ends within a frame")
    sums = crcs(data, starts, ends - starts, _CRC16, 16).astype(np.int64)
    if (sums != (data[ends].astype(np.int64) << 8 | data[ends + 1])).any():
        raise BadStream("frame checksum differs")
    return out, ends + 2


def decode_streams(media: list[bytes]) -> list[np.ndarray]:
    """The samples of each stream; raises BadStream if any is damaged.

    Streams of one block size whose seek tables name every frame are read together.
    """
    known = [parse(m) for m in media]
    out: list = [None] * len(media)
    groups: dict[tuple[int, int], list[int]] = {}
    for i, s in enumerate(known):
        if s["points"] and len(s["points"]) * s["block"] == s["samples"]:
            groups.setdefault((s["block"], s["bits"]), []).append(i)
        else:
            out[i] = _frame_by_frame(media[i], s)
    for (size, bits), members in groups.items():
        begin = np.cumsum([0, *(len(media[i]) for i in members)])
        data = np.frombuffer(b"".join([media[i] for i in members] + [bytes(8)]), np.uint8)
        starts = np.concatenate(
            [b + known[i]["frames"] + np.array([p[1] for p in known[i]["points"]]) for b, i in zip(begin, members)]
        )
        x, _ = decode_frames(data, starts.astype(np.int64), size, bits)
        at = 0
        for i in members:
            n = len(known[i]["points"])
            out[i] = x[at : at + n].ravel()
            at += n
    for s, x in zip(known, out):
        if s["md5"] != bytes(16) and s["bits"] == 8 and hashlib.md5(x.astype(np.int8).tobytes()).digest() != s["md5"]:
            raise BadStream("the samples' digest differs")
    return out


def _frame_by_frame(media: bytes, stream: dict) -> np.ndarray:
    data = np.frombuffer(media + bytes(8), np.uint8)
    at, left, parts = stream["frames"], stream["samples"], []
    while left:
        x, end = decode_frames(data, np.array([at]), min(stream["block"], left), stream["bits"])
        parts.append(x.ravel())
        left -= parts[-1].size
        at = int(end[0])
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def payload(text: bytes) -> bytes:
    """The text with bytes 255 up to a positive multiple of 576."""
    return text + bytes([PAD]) * (-len(text) % BLOCK or (0 if text else BLOCK))


def feature(x: np.ndarray) -> str:
    """Whole-number features of the samples: extremes, mean level, energy, changes of sign, largest step."""
    steps = np.abs(np.diff(x)).max(initial=0)
    turns = np.count_nonzero(np.diff(x >= 0))
    energy = int(np.dot(x, x)) // len(x)
    return f"min={x.min()};max={x.max()};mean={int(x.sum()) // len(x)};energy={energy};turns={turns};step={steps}"


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, media: every row's whole text as a FLAC stream; NULL and empty texts are one padded block."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in slices(batch.column("text").cast(pa.binary())):
                media = encode_streams([payload(t) for t in texts])
                keys = batch.column("doc_id").slice(first, len(texts))
                yield pa.record_batch([keys, pa.array(media, pa.binary())], names=["doc_id", "media"])

    return id_and_text(docs, id_col, text_col).mapInArrow(freeing(run), "doc_id long, media binary")


def pcm_blocks(media: DataFrame, samples: int = 64 * BLOCK, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """doc_id, sample_offset, n_samples, pcm (signed little-endian; one byte a sample for 8 bits, else four), error.

    A stream becomes blocks of `samples` samples, each with the number of its first one, so that a reader can
    seek by filtering on the offset.  A damaged, unknown or NULL stream gives one row with the reason and no samples.
    """
    bounded_batches(media.sparkSession)
    schema = "doc_id long, sample_offset long, n_samples long, pcm binary, error string"

    def rows(key: int | None, stream: bytes | None) -> Iterator[tuple]:
        try:
            x = decode_streams([stream or b""])[0]
            x = x.astype("<i1" if parse(stream or b"")["bits"] <= 8 else "<i4")
        except (BadStream, IndexError) as e:
            yield key, None, 0, None, str(e) or "damaged"
            return
        for at in range(0, len(x), samples):
            yield key, at, len(x[at : at + samples]), x[at : at + samples].tobytes(), None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
        names = ["doc_id", "sample_offset", "n_samples", "pcm", "error"]
        for batch in batches:
            for key, stream in zip(batch.column("doc_id").to_pylist(), batch.column("media").to_pylist()):
                out = list(rows(key, stream))
                if out:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    picked = media.select(media[id_col].cast("long").alias("doc_id"), media[media_col].alias("media"))
    return picked.mapInArrow(freeing(run), schema)


def store_and_read(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's text stored as FLAC and read back; digests of both forms and features of the samples read."""
    bounded_batches(docs.sparkSession)
    schema = (
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, "
        "media_bytes long, media_sha256 string, feature string"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        names = [c.split()[0] for c in schema.split(", ")]
        for batch in batches:
            # The decoder steps through all frames of a run at once, so longer runs cost less.
            for first, texts in slices(batch.column("text").cast(pa.binary()), 2 * 1024 * 1024):
                media = encode_streams([payload(t) for t in texts])
                rows = []
                for text, stream, x in zip(texts, media, decode_streams(media)):
                    back = (x.astype(np.int8).view(np.uint8) ^ 0x80).tobytes()
                    digest = hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:])
                    rows.append((len(text), len(back), *digest, len(stream), hashlib.sha256(stream).hexdigest(), feature(x)))
                keys = batch.column("doc_id").slice(first, len(texts))
                yield pa.record_batch([keys, *(pa.array(c, t) for c, t in zip(zip(*rows), types))], names=names)

    return id_and_text(docs, id_col, text_col).mapInArrow(freeing(run), schema)
