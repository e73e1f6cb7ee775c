"""Media columns as baseline JPEG: a numpy writer and reader of DC-only luminance.

The reader parses the markers of any baseline (SOF0) file, Huffman-decodes its scan, and
rebuilds the luminance thumbnail that has one sample per 8x8 block, from the DC terms
alone; AC terms are decoded only to be passed over. Restart segments of all files of an
Arrow batch are decoded side by side, a block of each at a time.

The writer stores bytes without loss: each byte is the value of one flat 8x8 block, and as
the quantiser of the DC term is 8, the stored DC term is the byte minus 128 exactly. An
image is 24 blocks wide with one restart segment per row of blocks; payloads of more rows
than an image can have become several images, one after the other.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidence_spark.llm.common import small_batches

UNIT = 576
WIDE = 24
#: Rows of blocks of one image: the height limit of 65535 in whole units.
MAX_ROWS = 65535 // 8 // (UNIT // WIDE) * (UNIT // WIDE)
#: Lanes (restart segments) decoded side by side.
LANES = 1 << 15

_CAT = np.array([int(abs(d)).bit_length() for d in range(-255, 256)], np.uint8)
_MASK = np.arange(16)[None, :] < np.arange(17)[:, None]


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _header(rows: int) -> bytes:
    counts_dc = bytes([0, 0, 0, 9, *[0] * 12])
    counts_ac = bytes([1, *[0] * 15])
    return (
        b"\xff\xd8"
        + _segment(0xDB, bytes([0, *[8] * 64]))
        + _segment(0xC0, struct.pack(">BHHBBBB", 8, 8 * rows, 8 * WIDE, 1, 1, 0x11, 0))
        + _segment(0xC4, b"\x00" + counts_dc + bytes(range(9)))
        + _segment(0xC4, b"\x10" + counts_ac + b"\x00")
        + _segment(0xDD, struct.pack(">H", WIDE))
        + _segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))
    )


def _scan(rows: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scan bytes of rows of blocks with the marker after each, and where each row ends.

    ``first`` is a row's number in its image; ``last`` tells that the image ends with it.
    """
    v = rows.astype(np.int16) - 128
    d = np.diff(v, axis=1, prepend=np.int16(0))
    cat = _CAT[d + 255].astype(np.uint16)
    bits = np.where(d < 0, d + (1 << cat.astype(np.int32)) - 1, d).astype(np.uint32)
    size = cat + 5  # 4 bits of category, its bits, and the end-of-block code 0
    word = (((cat.astype(np.uint32) << cat) | bits) << 1) << (16 - size)
    pad = (-size.sum(1, dtype=np.int64)) % 8
    word = np.concatenate([word, np.full((len(v), 1), 0xFFFF, np.uint32)], 1).astype(">u2")
    size = np.concatenate([size, pad[:, None]], 1)
    flags = np.unpackbits(word.view(np.uint8)).reshape(-1, 16)
    data = np.packbits(flags[_MASK[size.ravel()]])
    ends = np.cumsum(size.sum(1, dtype=np.int64) // 8)
    ff = data == 0xFF
    stuffed = np.cumsum(ff)
    row_of = np.repeat(np.arange(len(v)), np.diff(ends, prepend=0))
    at = np.arange(len(data)) + stuffed - ff + 2 * row_of
    end_at = ends + stuffed[ends - 1] + 2 * np.arange(1, len(v) + 1)
    out = np.zeros(int(end_at[-1]), np.uint8)
    out[at] = data
    out[end_at - 2] = 0xFF
    out[end_at - 1] = np.where(last, 0xD9, 0xD0 + first % 8)
    return out, end_at


def write_jpegs(payloads: list[bytes]) -> list[bytes]:
    """A file per payload (a positive multiple of UNIT bytes): one or more images."""
    images = [(k, s, min(MAX_ROWS, len(p) // WIDE - s)) for k, p in enumerate(payloads) for s in range(0, len(p) // WIDE, MAX_ROWS)]
    out = [b""] * len(payloads)
    batch: list[tuple[int, int, int]] = []

    def flush() -> None:
        if not batch:
            return
        rows = np.concatenate([np.frombuffer(payloads[k], np.uint8, n * WIDE, s * WIDE) for k, s, n in batch]).reshape(-1, WIDE)
        n = np.array([b[2] for b in batch])
        stop = np.cumsum(n)
        first = np.arange(len(rows)) - np.repeat(stop - n, n)
        last = np.zeros(len(rows), bool)
        last[stop - 1] = True
        data, ends = _scan(rows, first, last)
        raw, begin = data.tobytes(), 0
        for (k, _, m), e in zip(batch, ends[stop - 1].tolist(), strict=True):
            out[k] += _header(m) + raw[begin:e]
            begin = e
        batch.clear()

    total = 0
    for im in images:
        if total + im[2] > LANES:
            flush()
            total = 0
        batch.append(im)
        total += im[2]
    flush()
    return out


@dataclass
class _Image:
    width: int
    height: int
    comps: list[tuple[int, int, int, int, int]]  # h, v, quantiser of DC, DC table, AC table
    tables: dict[int, np.ndarray]
    interval: int
    scan: tuple[int, int]
    luma: np.ndarray | None = None


def _lookup(counts: bytes, symbols: bytes) -> np.ndarray:
    """16-bit prefix -> code length * 256 + symbol."""
    out = np.zeros(1 << 16, np.int32)
    code = k = 0
    for length in range(1, 17):
        for _ in range(counts[length - 1]):
            lo = code << (16 - length)
            out[lo : lo + (1 << (16 - length))] = length * 256 + symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return out


_LOOKUPS: dict[bytes, np.ndarray] = {}


def parse(data: bytes) -> list[_Image]:
    """The images of a file by their markers; ValueError for what is not baseline."""
    images, at = [], 0
    while at < len(data):
        if data[at : at + 2] != b"\xff\xd8":
            raise ValueError("no start of image")
        at += 2
        quant: dict[int, int] = {}
        tables: dict[int, np.ndarray] = {}
        interval, frame = 0, None
        while True:
            if at + 4 > len(data) or data[at] != 0xFF:
                raise ValueError("marker expected")
            marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
            body = data[at + 4 : at + 2 + size]
            at += 2 + size
            if marker == 0xDB:
                while body:
                    wide = 2 if body[0] >> 4 else 1
                    quant[body[0] & 15] = int.from_bytes(body[1 : 1 + wide], "big")
                    body = body[1 + 64 * wide :]
            elif marker == 0xC4:
                while body:
                    n = sum(body[1:17])
                    key = body[1 : 17 + n]
                    if key not in _LOOKUPS:
                        if len(_LOOKUPS) > 64:
                            _LOOKUPS.clear()
                        _LOOKUPS[key] = _lookup(key[:16], key[16:])
                    tables[body[0]] = _LOOKUPS[key]
                    body = body[17 + n :]
            elif marker == 0xDD:
                interval = int.from_bytes(body, "big")
            elif marker == 0xC0:
                height, width = struct.unpack(">HH", body[1:5])
                frame = {body[6 + 3 * i]: (body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])}
            elif 0xC1 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                raise ValueError("not baseline")
            elif marker == 0xDA:
                break
        if frame is None or body[0] != len(frame):
            raise ValueError("one interleaved scan expected")
        comps = [(*frame[body[1 + 2 * i]][:2], quant[frame[body[1 + 2 * i]][2]], body[2 + 2 * i] >> 4, 16 + (body[2 + 2 * i] & 15)) for i in range(body[0])]
        if len(comps) == 1:
            comps = [(1, 1, *comps[0][2:])]
        end = at
        while True:  # the scan ends at the first marker but restarts
            end = data.find(b"\xff", end)
            if end < 0 or end + 1 >= len(data):
                raise ValueError("no end of image")
            if data[end + 1] == 0xD9:
                break
            end += 2
        images.append(_Image(width, height, comps, tables, interval, (at, end)))
        at = end + 2
    return images


def _decode(kind: _Image, windows: np.ndarray, bitpos: np.ndarray, units: np.ndarray) -> np.ndarray:
    """DC terms of the first component of each lane: (lanes, blocks), in scan order.

    All lanes share tables and components. A step decodes one block of every lane.
    """
    order = [c for c, (h, v, *_) in enumerate(kind.comps) for _ in range(h * v)]
    most = int(units.max())
    luma = kind.comps[0][0] * kind.comps[0][1]
    out = np.zeros((len(bitpos), most * luma), np.int32)
    pred = np.zeros((len(kind.comps), len(bitpos)), np.int64)
    pos = bitpos.astype(np.int64)
    mask = (1 << 40) - 1
    k = 0
    for unit in range(most):
        live = units > unit
        whole = bool(live.all())
        for c in order:
            win = (windows[pos >> 3] << (pos & 7)) & mask
            e = kind.tables[kind.comps[c][3]][win >> 24]
            length, cat = e >> 8, e & 255
            bits = (win >> (40 - length - cat)) & ((1 << cat) - 1)
            diff = np.where(bits >> np.maximum(cat - 1, 0), bits, bits - (1 << cat) + 1)
            diff[cat == 0] = 0
            step = length + cat
            ac = kind.tables[kind.comps[c][4]]
            now = pos + step
            e = ac[((windows[now >> 3] << (now & 7)) & mask) >> 24]
            now += (e >> 8) + (e & 15)
            rest = np.flatnonzero((e & 255) != 0)
            if len(rest):
                index = np.zeros(len(pos), np.int64)
                index[rest] = 1 + ((e[rest] >> 4) & 15)
                rest = rest[index[rest] < 63]
                while len(rest):
                    p = now[rest]
                    e = ac[((windows[p >> 3] << (p & 7)) & mask) >> 24]
                    now[rest] = p + (e >> 8) + (e & 15)
                    index[rest] += 1 + ((e >> 4) & 15)
                    rest = rest[((e & 255) != 0) & (index[rest] < 63)]
            if not whole:
                diff[~live] = 0
                now = np.where(live, now, pos)
            pred[c] += diff
            pos = now
            if c == 0:
                out[:, k] = pred[0]
                k += 1
    return out


def read_jpegs(files: list[bytes]) -> list[list[_Image]]:
    """The images of each file, with ``luma``: the DC-only luminance thumbnail (uint8)."""
    parsed = [parse(f) for f in files]
    groups: dict[tuple, list[tuple[int, _Image]]] = {}
    for k, images in enumerate(parsed):
        for im in images:
            key = (tuple(im.comps), tuple(sorted((t, id(x)) for t, x in im.tables.items())))
            groups.setdefault(key, []).append((k, im))
    for members in groups.values():
        at = 0
        while at < len(members):
            part, lanes = [], 0
            while at < len(members) and (not part or lanes < LANES):
                part.append(members[at])
                im = members[at][1]
                lanes += -(-im.height // 8) if im.interval else 1
                at += 1
            _read_group(files, part)
    return parsed


def _read_group(files: list[bytes], part: list[tuple[int, _Image]]) -> None:
    raw = np.frombuffer(b"".join(files[k][im.scan[0] : im.scan[1]] + b"\xff\xd9" for k, im in part), np.uint8)
    ff = np.flatnonzero(raw[:-1] == 0xFF)
    follow = raw[ff + 1]
    gone = np.zeros(len(raw), bool)
    gone[ff[follow == 0] + 1] = True
    marks = ff[follow != 0]
    gone[marks] = gone[marks + 1] = True
    kept_before = np.cumsum(~gone)
    starts = np.concatenate([[0], kept_before[marks[:-1]]])
    data = np.concatenate([raw[~gone], np.full(16, 255, np.uint8)]).astype(np.int64)
    windows = (data[:-4] << 32) | (data[1:-3] << 24) | (data[2:-2] << 16) | (data[3:-1] << 8) | data[4:]
    kind = part[0][1]
    h, v = max(c[0] for c in kind.comps), max(c[1] for c in kind.comps)
    units = []
    for _, im in part:
        total = -(-im.width // (8 * h)) * -(-im.height // (8 * v))
        per = im.interval or total
        units += [min(per, total - s) for s in range(0, total, per)]
    units = np.array(units)
    if len(units) != len(starts):
        raise ValueError("restart markers do not fit the image")
    dc = _decode(kind, windows, starts * 8, units)
    lh, lv, q = kind.comps[0][:3]
    value = np.clip((dc * q + (8 * 128 + 4)) // 8, 0, 255).astype(np.uint8)
    lane = 0
    for _, im in part:
        across, down = -(-im.width // (8 * h)), -(-im.height // (8 * v))
        per = im.interval or across * down
        n = -(-across * down // per)
        blocks = value[lane : lane + n].reshape(-1, lv, lh)[: across * down] if per * n == across * down else np.concatenate([value[lane + i, : int(units[lane + i]) * lh * lv] for i in range(n)]).reshape(-1, lv, lh)
        lane += n
        luma = blocks.reshape(down, across, lv, lh).transpose(0, 2, 1, 3).reshape(down * lv, across * lh)
        im.luma = luma[: -(-im.height * lv // (8 * v)), : -(-im.width * lh // (8 * h))]


def thumbnail_hash(luma: np.ndarray) -> str:
    """Average and gradient hash of a thumbnail, 64 bits each, as hex."""
    rows = np.minimum(np.arange(9) * luma.shape[0] // 8, luma.shape[0] - 1)[:8]
    cols = np.minimum(np.arange(10) * luma.shape[1] // 9, luma.shape[1] - 1)[:9]
    grid = np.add.reduceat(np.add.reduceat(luma.astype(np.int64), rows, 0), cols, 1)
    area = np.outer(np.diff([*rows, luma.shape[0]]).clip(1), np.diff([*cols, luma.shape[1]]).clip(1))
    mean = grid / area
    average = np.packbits(mean[:, :8] >= mean[:, :8].mean()).tobytes().hex()
    return average + np.packbits(mean[:, 1:] > mean[:, :-1]).tobytes().hex()


def text_payload(text: str | None) -> tuple[bytes, int]:
    """UTF-8 bytes padded with 255 to a positive multiple of UNIT, and their own length."""
    raw = text.encode("utf-8", "surrogatepass") if text else b""
    return raw + b"\xff" * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw)), len(raw)


def media_features(docs: DataFrame) -> DataFrame:
    """Store every whole text as JPEG, read it back, and describe what was read.

    Columns: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, feature (width, height and number of images, thumbnail hashes), width,
    height. Null texts count as empty, which is one unit of padding. Rows repeat as given.
    """
    small_batches(docs.sparkSession, 500)
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64()]

    def run(batches):
        for b in batches:
            texts = b.column(1).to_pylist()
            files = write_jpegs([text_payload(t)[0] for t in texts])
            rows = []
            for doc, text, media, images in zip(b.column(0).to_pylist(), texts, files, read_jpegs(files), strict=True):
                luma = images[0].luma if len(images) == 1 else np.concatenate([im.luma for im in images])
                back = luma.tobytes()
                height = sum(im.height for im in images)
                rows.append((doc, text_payload(text)[1], len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), f"{images[0].width}x{height}x{len(images)}:{thumbnail_hash(luma)}", images[0].width, height))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 10, types, strict=True)], names)

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return src.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width int, height long")


def jpeg_columns(df: DataFrame, media: str, key: str) -> DataFrame:
    """Dimensions, thumbnail and its hash of a column of baseline JPEG files.

    One row per row of ``df``: key, width, height, thumbnail (binary, row by row),
    thumb_width, thumb_hash, error. A null file has nulls; a file that is not baseline
    JPEG has its error.
    """
    small_batches(df.sparkSession, 200)
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            rows = []
            for data in b.column(1).to_pylist():
                try:
                    im = read_jpegs([data])[0][0] if data is not None else None
                    rows.append((im.width, im.height, im.luma.tobytes(), im.luma.shape[1], thumbnail_hash(im.luma), None) if im else (None,) * 6)
                except (ValueError, IndexError, KeyError, struct.error) as e:
                    rows.append((None,) * 5 + (str(e) or type(e).__name__,))
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            types = (pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, t) for c, t in zip(cols, types, strict=True)]], [key, "width", "height", "thumbnail", "thumb_width", "thumb_hash", "error"])

    return df.select(key, F.col(media).cast("binary").alias("_media")).mapInArrow(run, f"`{key}` {kind}, width int, height int, thumbnail binary, thumb_width int, thumb_hash string, error string")
