import hashlib
import random
import zlib

import numpy as np
import pytest
from fixtures import edge_docs

from trigrove.llm import media


@pytest.mark.parametrize("size", [64, 128, 6400, media.MOST, media.MOST + 64, 5 * media.MOST])
def test_round_trip_of_all_bytes(size):
    data = random.Random(size).randbytes(size)
    images = media.decode(media.encode(data))
    assert b"".join(t.tobytes() for _, _, t in images) == data
    assert all(w == 512 and h == 8 * len(t) for w, h, t in images)


class Bits:
    """A plain reader of a scan, bit by bit."""

    def __init__(self, data):
        self.bits, self.at = "".join(f"{b:08b}" for b in data), 0

    def take(self, n):
        self.at += n
        assert self.at <= len(self.bits)
        return int(self.bits[self.at - n : self.at] or "0", 2)

    def symbol(self, codes):
        for n in range(1, 17):
            if (n, int(self.bits[self.at : self.at + n], 2)) in codes:
                self.at += n
                return codes[n, int(self.bits[self.at - n : self.at], 2)]
        raise AssertionError


def plain_dc(scan, dc, ac, blocks):
    r, dc, ac, last, out = Bits(scan.replace(b"\xff\0", b"\xff")), {k: v for v, k in media.huffman(*dc).items()}, {k: v for v, k in media.huffman(*ac).items()}, 0, []
    for _ in range(blocks):
        n = r.symbol(dc)
        x = r.take(n)
        last += x if not n or x >> (n - 1) else x - (1 << n) + 1
        out.append(last)
        k = 1
        while k < 64 and (s := r.symbol(ac)):
            r.take(s & 15)
            k += (s >> 4) + 1
    return out


DC, AC = (media._DC_COUNTS, media._DC_VALUES), (media._AC_COUNTS, media._AC_VALUES)


def made(rng, blocks, ac=True, high=2047):
    """Bits of random blocks, some with many coefficients."""
    dc, acs, bits, last = media.huffman(*DC), media.huffman(*AC), "", 0
    for _ in range(blocks):
        d = (rng.randrange(-high, high + 1) if rng.random() < 0.3 else rng.randrange(-20, 21))
        d = max(-high - last, min(high - last, d))
        last += d
        d = max(-2047, min(2047, d))
        c = abs(d).bit_length()
        bits += f"{dc[c][1]:0{dc[c][0]}b}" + (f"{d if d > 0 else d + (1 << c) - 1:0{c}b}" if c else "")
        k = 1
        while ac and k < 64 and rng.random() < 0.8:
            run = rng.choice([0, 0, 1, 5, 15])
            size = rng.randrange(1, 11)
            if rng.random() < 0.1:
                run, size = 15, 0
            if k + run + 1 > 64:
                break
            n, code = acs[run << 4 | size]
            bits += f"{code:0{n}b}" + (f"{rng.getrandbits(size):0{size}b}" if size else "")
            k += run + 1
        if k < 64:
            bits += f"{acs[0][1]:0{acs[0][0]}b}"
    bits += "1" * (-len(bits) % 8)
    return int(bits, 2).to_bytes(len(bits) // 8).replace(b"\xff", b"\xff\0")


@pytest.mark.parametrize(("ac", "piece"), [(True, 1 << 16), (True, 64), (False, 64)])
def test_tables_read_what_a_bitwise_reader_reads(monkeypatch, ac, piece):
    monkeypatch.setattr(media, "PIECE", piece)
    rng = random.Random(piece + ac)
    for blocks in (1, 7, 300):
        scan = made(rng, blocks, ac)
        got = media._dc_of(scan.replace(b"\xff\0", b"\xff"), [media.Component(0, 1, DC, AC)], blocks)[0]
        assert got.tolist() == plain_dc(scan, DC, AC, blocks)
        with pytest.raises(media.Broken):
            media._dc_of(scan.replace(b"\xff\0", b"\xff")[: len(scan) // 3], [media.Component(0, 1, DC, AC)], blocks)


def test_stored_samples_use_the_usual_tables():
    data = random.Random(1).randbytes(64 * 9)
    stored = media.encode(data)
    scan = stored[stored.index(media._SCAN) + len(media._SCAN) : -2]
    last = [x + 128 for x in plain_dc(scan, DC, AC, 64 * 9)]
    assert bytes(last) == data


def test_scans_of_one_component_each_and_bytes_after_the_end():
    rng, seg = random.Random(5), media._segment
    y, cb = made(rng, 5 * 3, high=100), made(rng, 3 * 2, high=100)
    frame = seg(0xC0, bytes([8, 0, 20, 0, 37, 2, 1, 0x22, 0, 2, 0x11, 0]))  # 37 x 20: 5 x 3 blocks of luminance
    scan = lambda c: seg(0xDA, bytes([1, c, 0, 0, 63, 0]))
    head = b"\xff\xd8" + media._QUANT + frame + media._TABLES
    want = np.clip(np.array(plain_dc(y, DC, AC, 15)).reshape(3, 5) + 128, 0, 255)
    for jpeg in (head + scan(1) + y + scan(2) + cb, head + scan(2) + cb + scan(1) + y):
        [(wide, high, thumb)] = media.decode(jpeg + b"\xff\xd9" + b"\0trailing\xff\xd8")
        assert (wide, high) == (37, 20) and (thumb == want).all()


def test_restarts_begin_anew():
    rng, seg = random.Random(6), media._segment
    parts = [made(rng, n, high=100) for n in (4, 4, 1)]
    frame = seg(0xC0, bytes([8, 0, 24, 0, 24, 1, 1, 0x11, 0]))
    scan = b"".join(p + bytes([0xFF, 0xD0 + k]) for k, p in enumerate(parts))[:-2]
    jpeg = b"\xff\xd8" + media._QUANT + frame + media._TABLES + seg(0xDD, b"\0\4") + media._SCAN + scan + b"\xff\xd9"
    want = [x for p, n in zip(parts, (4, 4, 1), strict=True) for x in plain_dc(p, DC, AC, n)]
    assert media.decode(jpeg)[0][2].ravel().tolist() == np.clip(np.array(want) + 128, 0, 255).tolist()


def test_colour_and_subsampling():
    """16 x 16, 4:2:0: luminance blocks 10, 20, 30, 40 quantiser steps over grey."""
    seg = media._segment
    two = lambda first, second: bytes([1, 1, *[0] * 14, first, second])  # codes 0 and 10
    tables = seg(0xC4, b"\0" + two(0, 4)) + seg(0xC4, b"\x10" + two(0, 1))
    frame = seg(0xC0, bytes([8, 0, 16, 0, 16, 3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0]))
    start = seg(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0]))
    # Each: a difference of 10 (four bits), an AC coefficient of one bit, end of block; then two flat blocks.
    bits = ("10" + "1010" + "10" + "1" + "0") * 4 + "00" * 2
    bits += "1" * (-len(bits) % 8)
    scan = int(bits, 2).to_bytes(len(bits) // 8).replace(b"\xff", b"\xff\0")
    jpeg = b"\xff\xd8" + seg(0xDB, b"\0" + bytes([8] + [1] * 63)) + frame + tables + start + scan + b"\xff\xd9"
    [(wide, high, thumb)] = media.decode(jpeg)
    assert (wide, high, thumb.tolist()) == (16, 16, [[138, 148], [158, 168]])


@pytest.mark.parametrize("harm", [lambda b: b[:-30], lambda b: b[1:], lambda b: b.replace(b"\xff\xc0", b"\xff\xc2"), lambda b: b"", lambda b: b"\xff\xd8\xff"])
def test_damage_is_reported(spark, harm):
    whole = media.encode(bytes(range(64)) * 2)
    got = media.thumbnails(spark.createDataFrame([(1, bytearray(harm(whole))), (2, bytearray(whole)), (3, None)], "doc_id long, media binary")).orderBy("doc_id").collect()
    assert got[0].error and got[2].error and got[0].thumb is None
    assert (got[1].width, got[1].height, bytes(got[1].thumb), got[1].error) == (512, 16, bytes(range(64)) * 2, None)


def test_features(spark):
    docs = edge_docs(spark)
    got = media.features(docs).collect()
    assert len(got) == 11
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id is not None}
    for r in got:
        if r.doc_id is None:
            continue
        raw = (texts[r.doc_id] or "").encode()
        body = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(body))
        assert r.payload_sha256 == hashlib.sha256(body).hexdigest() and r.tail_crc32 == zlib.crc32(body[-64:])
        assert r.media_sha256 == hashlib.sha256(media.encode(body)).hexdigest()
    assert len({r.feature for r in got if r.doc_id in (6, 7)}) == 1
    assert media.features(edge_docs(spark, empty=True)).count() == 0
    again = media.thumbnails(media.stored(docs)).collect()
    assert sorted(r.thumb_hash for r in again) == sorted(r.feature.split(":")[1] for r in got)
