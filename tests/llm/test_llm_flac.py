"""FLAC: round trips, checksums, seeking, and frames of other encoders."""

import hashlib
import random
import zlib

import nasty
import numpy as np
import pytest

from reviewlake.llm import flac


def test_payload():
    assert [len(flac.payload(b"x" * n)) for n in (0, 1, 576, 577)] == [576, 576, 576, 1152]
    assert flac.payload(b"") == bytes([255]) * 576


def test_round_trip():
    rng = random.Random(1)
    texts = [b"", b"a" * 576, bytes(range(256)) * 9, rng.randbytes(5760), b"abc" * 40_000, bytes([0, 255]) * 288]
    texts += [" ".join(f"w{rng.randrange(99)}" for _ in range(300)).encode()]
    media = flac.encode_streams([flac.payload(t) for t in texts])
    for text, x, stream in zip(texts, flac.decode_streams(media), media):
        assert (x.astype(np.int8).view(np.uint8) ^ 0x80).tobytes() == flac.payload(text)
        # Without its seek table a stream is read frame after frame.
        assert (flac._frame_by_frame(stream, flac.parse(stream)) == x).all()
    assert len(media[1]) < 120  # constant


def test_every_flipped_bit_of_a_frame_is_noticed():
    stream = flac.encode_streams([flac.payload(b"some text to be stored " * 20)])[0]
    begin = flac.parse(stream)["frames"]
    rng = random.Random(2)
    for _ in range(200):
        at = rng.randrange(begin, len(stream))
        bad = bytearray(stream)
        bad[at] ^= 1 << rng.randrange(8)
        with pytest.raises((flac.BadStream, IndexError)):
            flac.decode_streams([bytes(bad)])


class Bits:
    def __init__(self):
        self.text = ""

    def put(self, value, width):
        self.text += format(value & (1 << width) - 1, f"0{width}b")

    def rice(self, value, k):
        u = value << 1 if value >= 0 else -value * 2 - 1
        self.text += "0" * (u >> k) + "1"
        if k:
            self.put(u, k)

    def bytes(self):
        self.text += "0" * (-len(self.text) % 8)
        return int(self.text, 2).to_bytes(len(self.text) // 8, "big")


def crc(data, polynomial, bits):
    value = 0
    for byte in data:
        value ^= byte << (bits - 8)
        for _ in range(8):
            value = (value << 1 ^ (polynomial if value >> (bits - 1) & 1 else 0)) & (1 << bits) - 1
    return value


@pytest.mark.parametrize("kind", ["lpc", "fixed4", "rice2"])
def test_frames_of_another_encoder(kind):
    """16 samples of 16 bits with predictors and partitions our encoder does not write."""
    x = [1000, 1100, 1250, 1400, 1500, 1450, 1300, 1000, 600, 100, -500, -900, -1000, -950, -700, -300]
    head = bytes([0xFF, 0xF8, 0x60, 0x08, 0x00, 15])
    head += bytes([crc(head, 0x07, 8)])
    bits = Bits()
    if kind == "lpc":
        coefficients, shift, order = [29, -14], 4, 2
        bits.put(0, 1), bits.put(32 + order - 1, 6), bits.put(0, 1)
        for v in x[:order]:
            bits.put(v, 16)
        bits.put(6 - 1, 4), bits.put(shift, 5)
        for c in coefficients:
            bits.put(c, 6)
        guess = lambda j: sum(c * x[j - 1 - i] for i, c in enumerate(coefficients)) >> shift
    else:
        order = 4 if kind == "fixed4" else 1
        bits.put(0, 1), bits.put(8 + order, 6), bits.put(0, 1)
        for v in x[:order]:
            bits.put(v, 16)
        guess = (lambda j: 4 * x[j - 1] - 6 * x[j - 2] + 4 * x[j - 3] - x[j - 4]) if order == 4 else (lambda j: x[j - 1])
    wide = kind == "rice2"
    bits.put(int(wide), 2), bits.put(1, 4)  # two partitions
    for part, k in ((range(order, 8), 5), (range(8, 16), 9)):
        bits.put(k, 5 if wide else 4)
        for j in part:
            bits.rice(x[j] - guess(j), k)
    frame = head + bits.bytes()
    frame += crc(frame, 0x8005, 16).to_bytes(2, "big")
    info = (16).to_bytes(2, "big") * 2 + bytes(6) + (8000 << 44 | 15 << 36 | 16).to_bytes(8, "big") + bytes(16)
    got = flac.decode_streams([b"fLaC" + bytes([0x80]) + len(info).to_bytes(3, "big") + info + frame])[0]
    assert got.tolist() == x


def test_tables(spark):
    docs = nasty.documents(spark)
    rows = flac.store_and_read(docs).collect()
    want = []
    for i, t, _, _ in nasty.ROWS:
        raw = (t or "").encode()
        p = flac.payload(raw)
        want.append((str(i), len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:])))
    got = [(str(r.doc_id), r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in rows]
    assert sorted(got) == sorted(want)
    by_text = {}
    for r in rows:
        by_text.setdefault(r.payload_sha256, set()).add((r.media_sha256, r.media_bytes, r.feature))
    assert all(len(v) == 1 for v in by_text.values())
    media = flac.store(docs)
    blocks = flac.pcm_blocks(media, samples=1000).collect()
    for i, t, _, _ in nasty.ROWS:
        own = sorted((b for b in blocks if b.doc_id == i), key=lambda b: b.sample_offset)
        if i not in (7, None):
            assert [b.sample_offset for b in own] == list(range(0, len(flac.payload((t or "").encode())), 1000))
            pcm = np.frombuffer(b"".join(b.pcm for b in own), np.uint8) ^ 0x80
            assert pcm.tobytes() == flac.payload((t or "").encode())
    assert flac.store_and_read(nasty.empty(spark)).count() == 0
    broken = spark.createDataFrame([(1, b"RIFF"), (2, None), (3, b"fLaC")], "doc_id long, media binary")
    assert all(b.error and b.n_samples == 0 for b in flac.pcm_blocks(broken).collect())
