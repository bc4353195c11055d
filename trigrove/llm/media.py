"""Baseline JPEG as a media column.

``decode`` parses the markers of a baseline (Huffman, 8-bit, sequential) JPEG, decodes
its scans, interleaved or not, and rebuilds the thumbnail that the DC coefficients of
the luminance give: one sample for each 8 x 8 block.  ``encode`` stores bytes as such
samples, with the usual Huffman tables of luminance.  With a DC quantiser of 8 a flat
block's coefficient is its sample less 128, so nothing is lost.

Decoding is by tables over the next 16 bits, for all bit positions of a piece of the
scan at once: numpy says how far a code that starts there goes, and only the walk from
block to block is a loop."""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..session import ship
from .common import plain

WIDE = 64  # samples of a row of the thumbnail
MOST = WIDE * 1024  # samples of one image
PIECE = 1 << 16  # bytes of a scan that are looked up at once
REACH = 512  # bytes that one block may go on

# The usual tables of luminance, codes by length and their values.
_DC_COUNTS = bytes([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0])
_DC_VALUES = bytes(range(12))
_AC_COUNTS = bytes([0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125])
_AC_VALUES = bytes.fromhex(
    "01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282090a161718191a25262728292a3435363738393a"
    + "434445464748494a535455565758595a636465666768696a737475767778797a838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aa"
    + "b2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae1e2e3e4e5e6e7e8e9eaf1f2f3f4f5f6f7f8f9fa"
)


def huffman(counts: bytes, values: bytes) -> dict[int, tuple[int, int]]:
    """value -> (length, code), canonical."""
    out, code, k = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out[values[k]] = length, code
            code, k = code + 1, k + 1
        code <<= 1
    return out


def _codes() -> tuple[np.ndarray, np.ndarray]:
    """For a difference + 255 the bits of its block, end of block included, and how
    many they are."""
    of, (end_size, end) = huffman(_DC_COUNTS, _DC_VALUES), huffman(_AC_COUNTS, _AC_VALUES)[0]
    bits, size = np.zeros(511, np.uint64), np.zeros(511, np.int64)
    for d in range(-255, 256):
        c = abs(d).bit_length()
        n, code = of[c]
        bits[d + 255] = ((code << c | (d if d >= 0 else d + (1 << c) - 1)) << end_size) | end
        size[d + 255] = n + c + end_size
    return bits, size


_BITS, _SIZE = _codes()


def _packed(bits: np.ndarray, size: np.ndarray) -> bytes:
    """Codes one after another, filled up with ones.  Codes don't overlap, so adding
    what each puts into a word of 32 bits puts them together."""
    ends = np.cumsum(size)
    start = ends - size
    word = start >> 5
    v = bits << (64 - size - (start & 31)).astype(np.uint64)
    many = int(ends[-1] >> 5) + 2
    whole = np.bincount(word, (v >> np.uint64(32)).astype(np.float64), many) + np.bincount(word + 1, (v & np.uint64(0xFFFFFFFF)).astype(np.float64), many)
    raw = bytearray(whole.astype(np.uint32).astype(">u4").tobytes()[: -(-int(ends[-1]) // 8)])
    raw[-1] |= (1 << (-int(ends[-1]) % 8)) - 1
    return bytes(raw)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


_QUANT = _segment(0xDB, b"\0" + bytes([8] + [1] * 63))
_TABLES = _segment(0xC4, b"\x00" + _DC_COUNTS + _DC_VALUES + b"\x10" + _AC_COUNTS + _AC_VALUES)
_SCAN = _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))
_JFIF = _segment(0xE0, b"JFIF\0\x01\x01\0\0\x01\0\x01\0\0")


def encode(samples: bytes) -> bytes:
    """Baseline JPEGs, one after another, whose thumbnails are ``samples``: a
    multiple of 64 bytes, 64 to a row."""
    if not samples or len(samples) % WIDE:
        raise ValueError("a positive multiple of 64 bytes is needed")
    out = []
    for at in range(0, len(samples), MOST):
        v = np.frombuffer(samples, np.uint8, min(MOST, len(samples) - at), at).astype(np.int16)
        d = np.diff(v, prepend=np.int16(128)) + 255
        scan = _packed(_BITS[d], _SIZE[d]).replace(b"\xff", b"\xff\0")
        frame = _segment(0xC0, struct.pack(">BHHBBBB", 8, len(v) // WIDE * 8, WIDE * 8, 1, 1, 0x11, 0))
        out += [b"\xff\xd8", _JFIF, _QUANT, frame, _TABLES, _SCAN, scan, b"\xff\xd9"]
    return b"".join(out)


class Broken(ValueError):
    """Not a baseline JPEG, or a damaged one."""


@lru_cache(256)
def _lookup(counts: bytes, values: bytes) -> tuple[np.ndarray, np.ndarray]:
    """By the next 16 bits: length of the code that they start with (0: none), value."""
    size, value = np.zeros(1 << 16, np.uint8), np.zeros(1 << 16, np.uint8)
    code = k = 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            a, z = code << (16 - length), (code + 1) << (16 - length)
            if z > 1 << 16 or k >= len(values):
                raise Broken("a Huffman table is wrong")
            size[a:z], value[a:z] = length, values[k]
            code, k = code + 1, k + 1
        code <<= 1
    return size, value


@lru_cache(64)
def _dc_table(counts: bytes, values: bytes) -> tuple[np.ndarray, np.ndarray]:
    """By the next 16 bits: bits of a DC difference (0: no such code) and the
    difference, or ``FAR`` if it ends beyond them."""
    size, c = _lookup(counts, values)
    need = np.where((size > 0) & (c <= 11), size + c, 0)
    n, cat = np.minimum(need, 16).astype(np.int64), c.astype(np.int64)
    x = (np.arange(1 << 16) >> (16 - n)) & ((1 << np.minimum(cat, 16)) - 1)
    diff = np.where((cat == 0) | (x >> np.maximum(cat - 1, 0) > 0), x, x - (1 << np.minimum(cat, 16)) + 1)
    return need.astype(np.uint8), np.where(need > 16, FAR, diff).astype(np.int32)


@lru_cache(64)
def _ac_table(counts: bytes, values: bytes) -> tuple[np.ndarray, np.ndarray]:
    """By the next 16 bits: bits of an AC code with its coefficient (0: no such code),
    and run and size."""
    size, rs = _lookup(counts, values)
    return np.where(size > 0, size + (rs & 15), 0).astype(np.uint8), rs


@lru_cache(64)
def _flat_table(dc_counts: bytes, dc_values: bytes, ac_counts: bytes, ac_values: bytes) -> np.ndarray:
    """By the next 16 bits: bits of a block without AC coefficients (0: it has some, or
    there is no such code; 255: they don't tell)."""
    (dc, _), (ac, rs) = _dc_table(dc_counts, dc_values), _ac_table(ac_counts, ac_values)
    w = np.arange(1 << 16)
    # What follows the difference, and ones: right if the end of block fits in.
    rest = (w << dc.astype(np.int64) | (1 << dc.astype(np.int64)) - 1) & 0xFFFF
    whole = dc.astype(np.int64) + ac[rest]
    return np.where(dc == 0, 0, np.where((dc <= 16) & (ac[rest] > 0) & (whole <= 16), np.where(rs[rest] == 0, whole, 0), 255)).astype(np.uint8)


FAR = 1 << 20


def _windows(data: bytes) -> np.ndarray:
    """The 16 bits from each bit on; ones after the end."""
    d = np.frombuffer(data + b"\xff\xff", np.uint8).astype(np.uint32)
    w = d[:-2] << 16 | d[1:-1] << 8 | d[2:]
    out = np.empty((len(w), 8), np.uint16)
    for o in range(8):
        out[:, o] = (w >> (8 - o)) & 0xFFFF
    return out.ravel()


def _dc_of(data: bytes, comps: list[Component], mcus: int) -> list[np.ndarray]:
    """DC differences of each component of a scan without restarts, added up."""
    end, bit, done = 8 * len(data), 0, 0
    out: list[list[np.ndarray]] = [[] for _ in comps]
    lone = len(comps) == 1 and comps[0].blocks == 1
    while done < mcus:
        if bit > end:
            raise Broken("the scan is too short")
        first = bit >> 3
        piece = data[first : first + PIECE + REACH]
        w = _windows(piece + b"\xff" * REACH)
        limit, at = 8 * min(PIECE, len(piece)), bit & 7
        tables = [(_dc_table(*c.dc), _ac_table(*c.ac)) for c in comps]
        if lone:
            walked, at, done = _walk(w, tables[0], (*comps[0].dc, *comps[0].ac), at, limit, done, mcus)
            places = [walked]
        else:
            far = [_far(w, t) for t in tables]
            seen: list[list[int]] = [[] for _ in comps]
            while done < mcus and at < limit:
                for c, comp in enumerate(comps):
                    for _ in range(comp.blocks):
                        seen[c].append(at)
                        at = _block(at, *far[c])
                        if at > 8 * len(piece) and at > limit + 4 * REACH:
                            raise Broken("the scan is too short")
                done += 1
            places = [np.array(x, np.int64) for x in seen]
        for c, p in enumerate(places):
            d = tables[c][0][1][w[p]]
            for k in np.flatnonzero(d == FAR).tolist():
                d[k] = _difference(piece, int(p[k]), comps[c])
            out[c].append(d)
        if at <= (bit & 7):
            raise Broken("the scan is too short")
        bit = 8 * first + at
    if bit > end:
        raise Broken("the scan is too short")
    return [np.cumsum(np.concatenate(d), dtype=np.int64) for d in out]


def _far(w: np.ndarray, tables: tuple) -> tuple[bytes, bytes, bytes]:
    (dc, _), (ac, rs) = tables
    return dc[w].tobytes(), ac[w].tobytes(), rs[w].tobytes()


def _walk(w: np.ndarray, tables: tuple, of: tuple[bytes, bytes, bytes, bytes], at: int, limit: int, done: int, mcus: int) -> tuple[np.ndarray, int, int]:
    """Where the blocks of one component start, from ``at`` up to ``limit``; where the
    next one starts; blocks done.  A block without AC coefficients is one step, and 16
    such steps in a row are one leap; only other blocks are read code by code."""
    (dc, _), (ac, rs) = tables
    step = _flat_table(*of)[w]
    beyond = np.flatnonzero(step == 255)
    size = dc[w[beyond]]
    after = w.take(beyond + size, mode="clip")
    step[beyond] = np.where((size > 0) & (rs[after] == 0) & (ac[after] > 0), size + ac[after], 0)
    leap, at_least = step.astype(np.uint16), np.flatnonzero(step)
    for _ in range(4):  # only few positions are a block's start, or look like it
        one, more = leap[at_least], leap.take(at_least + leap[at_least], mode="clip")
        leap[at_least] = np.where(more > 0, one + more, 0)
        at_least = at_least[more > 0]
    far = None
    seen: list[int] = []
    wide = bytearray()
    one, sixteen, see, mark = step.tobytes(), memoryview(leap), seen.append, wide.append
    while done < mcus and at < limit:
        see(at)
        if (n := sixteen[at]) and done + 16 <= mcus:
            mark(1)
            at += n
            done += 16
            continue
        mark(0)
        if n := one[at]:
            at += n
        else:
            far = far or _far(w, tables)
            at = _block(at, *far)
        done += 1
    many = np.frombuffer(wide, np.uint8) > 0
    count = np.where(many, 16, 1)
    first = np.cumsum(count) - count
    p, cur = np.empty(int(count.sum()), np.int64), np.array(seen, np.int64)
    p[first] = cur
    cur, first = cur[many], first[many]
    for k in range(1, 16):
        cur = cur + step[cur]
        p[first + k] = cur
    return p, at, done


def _block(at: int, dc: bytes, ac: bytes, rs: bytes) -> int:
    """Where the block that starts at a bit ends."""
    if not dc[at]:
        raise Broken("unknown code")
    at += dc[at]
    k = 1
    while k < 64:
        if at >= len(ac):
            raise Broken("the scan is too short")
        x = rs[at]
        if not ac[at]:
            raise Broken("unknown code")
        at += ac[at]
        if x == 0:
            break
        k += (x >> 4) + 1
    return at


def _difference(data: bytes, at: int, comp: Component) -> int:
    """A DC difference that ends beyond 16 bits."""
    size, value = _lookup(*comp.dc)
    bits = int.from_bytes((data[at >> 3 : (at >> 3) + 5] + b"\xff" * 5)[:5])
    head = bits >> (24 - (at & 7)) & 0xFFFF
    n, c = int(size[head]), int(value[head])
    x = bits >> (40 - (at & 7) - n - c) & ((1 << c) - 1)
    return x if x >> (c - 1) else x - (1 << c) + 1


@dataclass(frozen=True)
class Component:
    """Of a scan: its place in the frame, blocks of a unit, tables."""

    part: int
    blocks: int
    dc: tuple[bytes, bytes]
    ac: tuple[bytes, bytes]


_AFTER = re.compile(rb"\xff(?![\x00\xd0-\xd7])", re.S)
_RESTART = re.compile(rb"\xff[\xd0-\xd7]", re.S)


def decode_one(data: bytes, at: int = 0) -> tuple[int, int, np.ndarray, int]:
    """(width, height, luminance thumbnail, where the image ends).  The luminance is
    the frame's first component, in whichever scan it is."""
    if data[at : at + 2] != b"\xff\xd8":
        raise Broken("no start of image")
    at += 2
    quant: dict[int, int] = {}
    tables: dict[int, tuple[bytes, bytes]] = {}
    every, frame, luma = 0, None, None
    while True:
        if at + 2 > len(data) or data[at] != 0xFF:
            raise Broken("a marker is missing")
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if marker == 0xD9:
            at += 2
            break
        if at + 4 > len(data):
            raise Broken("a marker is missing")
        size = struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            k = 0
            while k < len(body):
                wide = body[k] >> 4
                quant[body[k] & 15] = struct.unpack_from(">H", body, k + 1)[0] if wide else body[k + 1]
                k += 65 + 64 * wide
        elif marker == 0xC4:
            k = 0
            while k < len(body):
                n = sum(body[k + 1 : k + 17])
                tables[body[k]] = body[k + 1 : k + 17], body[k + 17 : k + 17 + n]
                k += 17 + n
        elif marker == 0xC0:
            depth, high, wide, n = struct.unpack_from(">BHHB", body)
            if depth != 8 or not high or not wide or not n:
                raise Broken("not 8 bits, or no size")
            frame = (wide, high, [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)])
        elif 0xC1 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise Broken("not baseline")
        elif marker == 0xDD:
            every = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            if frame is None:
                raise Broken("no frame")
            end = _AFTER.search(data, at)
            if end is None:
                raise Broken("no end of image")
            got = _scan(data[at : end.start()], body, frame, tables, every)
            luma, at = (got if luma is None else luma), end.start()
    if frame is None or luma is None:
        raise Broken("no frame or no scan")
    wide, high, parts = frame
    tops = [max(p[1] for p in parts), max(p[2] for p in parts)]
    luma = luma[: -(-high * parts[0][2] // (8 * tops[1])), : -(-wide * parts[0][1] // (8 * tops[0]))]
    return wide, high, np.clip((luma * quant[parts[0][3]] + 4) // 8 + 128, 0, 255).astype(np.uint8), at


def _scan(raw: bytes, head: bytes, frame: tuple, tables: dict[int, tuple[bytes, bytes]], every: int) -> np.ndarray | None:
    """The DC values of the frame's first component, in rows; None if this scan has
    others only."""
    wide, high, parts = frame
    number = {p[0]: k for k, p in enumerate(parts)}
    chosen = [(number[head[1 + 2 * i]], head[2 + 2 * i]) for i in range(head[0])]
    if 0 not in [k for k, _ in chosen]:
        return None
    lone = len(chosen) == 1
    comps = [Component(k, 1 if lone else parts[k][1] * parts[k][2], tables[t >> 4], tables[0x10 | t & 15]) for k, t in chosen]
    tops = [max(p[1] for p in parts), max(p[2] for p in parts)]
    if lone:  # its own blocks in rows
        cols, rows = -(-wide * parts[0][1] // (8 * tops[0])), -(-high * parts[0][2] // (8 * tops[1]))
    else:
        cols, rows = -(-wide // (8 * tops[0])), -(-high // (8 * tops[1]))
    left, found, pieces = cols * rows, [], _RESTART.split(raw)
    for n, piece in enumerate(pieces):
        mcus = min(every or left, left)
        if not mcus:
            break
        if not every and n:
            raise Broken("a restart that isn't announced")
        got = _dc_of(piece.replace(b"\xff\0", b"\xff"), comps, mcus)
        found.append(got[[c.part for c in comps].index(0)])
        left -= mcus
    if left:
        raise Broken("the scan is too short")
    y = np.concatenate(found)
    h, v = (1, 1) if lone else parts[0][1:3]
    return y.reshape(rows, cols, v, h).transpose(0, 2, 1, 3).reshape(rows * v, cols * h)


def decode(data: bytes) -> list[tuple[int, int, np.ndarray]]:
    """All images that follow each other in ``data``; what follows the last is left."""
    out, at = [], 0
    while at < len(data) and (not at or data[at : at + 2] == b"\xff\xd8"):
        wide, high, thumb, at = decode_one(data, at)
        out.append((wide, high, thumb))
    return out


def average_hash(thumb: np.ndarray) -> str:
    """64 bits: which cells of an 8 x 8 grid are lighter than all on average."""
    rows = [int(i * thumb.shape[0] / 8) for i in range(8)]
    cols = [int(i * thumb.shape[1] / 8) for i in range(8)]
    t = thumb.astype(np.int64)
    t = np.stack([t[a : max(b, a + 1)].sum(axis=0) / max(b - a, 1) for a, b in zip(rows, [*rows[1:], len(t)], strict=True)])
    t = np.stack([t[:, a : max(b, a + 1)].sum(axis=1) / max(b - a, 1) for a, b in zip(cols, [*cols[1:], thumb.shape[1]], strict=True)], axis=1)
    return f"{int(''.join('1' if x else '0' for x in (t > t.mean()).ravel()), 2):016x}"


def payload(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes(max(WIDE, -(-len(raw) // WIDE) * WIDE) - len(raw)), len(raw)


COLUMNS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width long, height long"


def _rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    for pdf in batches:
        rows = []
        for doc, text in zip(pdf["doc_id"], pdf["text"], strict=True):
            body, n = payload(text)
            media = encode(body)
            images = decode(media)
            back = b"".join(x[2].tobytes() for x in images)
            wide, high = images[0][0], sum(x[1] for x in images)
            look = average_hash(np.concatenate([x[2] for x in images]))
            rows.append((doc, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), f"{wide}x{high}:{look}", wide, high))
        yield plain(pd.DataFrame(rows, columns=names))


def stored(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, media)``: each text as a JPEG (see ``encode``), its length
    in bytes in n_bytes.  Null texts are stored as empty ones."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [payload(t) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_bytes": [n for _, n in got], "media": [encode(b) for b, _ in got]})

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInPandas(run, "doc_id long, n_bytes long, media binary")


def thumbnails(media: DataFrame) -> DataFrame:
    """Rows of ``media(doc_id, media)`` with width, height, thumb (the DC-only
    luminance, row by row), thumb_hash and error (why it can't be read)."""
    ship(media.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, data in zip(pdf["doc_id"], pdf["media"], strict=True):
                try:
                    images = decode(bytes(data or b""))
                    if not images:
                        raise Broken("empty")
                    rows.append((doc, images[0][0], sum(x[1] for x in images), b"".join(x[2].tobytes() for x in images), average_hash(np.concatenate([x[2] for x in images])), None))
                except (Broken, KeyError, IndexError, struct.error, ValueError) as e:
                    rows.append((doc, None, None, None, None, str(e) or type(e).__name__))
            out = pd.DataFrame(rows, columns=["doc_id", "width", "height", "thumb", "thumb_hash", "error"])
            yield plain(out).astype({"width": "Int64", "height": "Int64"})

    return media.select("doc_id", "media").mapInPandas(run, "doc_id long, width long, height long, thumb binary, thumb_hash string, error string")


def features(docs: DataFrame) -> DataFrame:
    """Stores each text of ``docs(doc_id, text)`` as a JPEG, reads it back and
    describes it (``COLUMNS``), a row for each row.

    Null texts are empty ones; an empty text is 64 bytes 0.  Texts of any length
    are whole: beyond 65,536 bytes several images follow each other.  Equal
    texts give equal values, a null doc_id stays null, and other columns are
    ignored."""
    ship(docs.sparkSession)
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInPandas(_rows, COLUMNS)
