"""TIFF as a media column: walk image directories, decode strips or tiles (PackBits, LZW, deflate, none), undo the
horizontal predictor, one row per page; and a writer for 8-bit grey images.

Nulls and files without a header give no pages. A page that is damaged, or whose samples aren't chunky and of 8 bits, is left
out and the others keep their numbers; after a damaged directory nothing more of a file is read (``strict=True`` raises
instead in all these cases). Bits are reversed where a page says so. Empty texts are one row of 64 zero bytes, texts of any
length go over as many pages as they need; equal bytes give equal rows, repeated rows repeated rows, an empty table none.
Further columns are not read, whatever their names."""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.shared import column, mapped, slices_by_bytes

WIDTH, PAGE_ROWS, STRIP_ROWS = 64, 2048, 256
NONE, LZW, DEFLATE, PACKBITS = 1, 5, 8, 32773
TYPES = {1: "B", 3: "H", 4: "I", 16: "Q"}


def packbits_decode(data: bytes) -> bytes:
    out, at, n = bytearray(), 0, len(data)
    while at < n:
        head = data[at]
        at += 1
        if head < 128:
            out += data[at : at + head + 1]
            at += head + 1
        elif head > 128:
            out += data[at : at + 1] * (257 - head)
            at += 1
    return bytes(out)


def packbits_encode(data: bytes) -> bytes:
    out, at, n = bytearray(), 0, len(data)
    while at < n:
        run = 1
        while run < 128 and at + run < n and data[at + run] == data[at]:
            run += 1
        if run > 2:
            out += bytes((257 - run, data[at]))
            at += run
            continue
        end = at + 1
        while end < n and end - at < 128 and data[end : end + 1] * 3 != data[end : end + 3]:
            end += 1
        out.append(end - at - 1)
        out += data[at:end]
        at = end
    return bytes(out)


def lzw_decode(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, highest bit first; the width grows one code early."""
    out: list[bytes] = []
    table: list[bytes] = []
    width, bits, held, last = 9, 0, 0, b""
    for byte in data:
        held, bits = (held << 8 | byte) & 0xFFFFFF, bits + 8
        while bits >= width:
            code = held >> (bits - width) & ((1 << width) - 1)
            bits -= width
            if code == 257:
                return b"".join(out)
            if code == 256:
                table, width, last = [bytes((i,)) for i in range(256)] + [b"", b""], 9, b""
                continue
            if not table:
                table = [bytes((i,)) for i in range(256)] + [b"", b""]
            if code < len(table):
                word = table[code]
            elif last and code == len(table):
                word = last + last[:1]
            else:
                raise ValueError("a code that isn't in the table")
            out.append(word)
            if last:
                table.append(last + word[:1])
            last = word
            size = len(table) + 1
            width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
    return b"".join(out)


def lzw_encode(data: bytes) -> bytes:
    held, bits, out = 0, 0, bytearray()

    def put(code: int, width: int) -> None:
        nonlocal held, bits
        held, bits = held << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 255)
        held &= (1 << bits) - 1

    fresh = {bytes((i,)): i for i in range(256)}
    table, following, width, word = dict(fresh), 258, 9, b""
    put(256, 9)
    for i in range(len(data)):
        longer = word + data[i : i + 1]
        if longer in table:
            word = longer
            continue
        put(table[word], width)
        table[longer] = following
        following += 1
        if following in (512, 1024, 2048):
            width += 1
        if following == 4094:
            put(256, width)
            table, following, width = dict(fresh), 258, 9
        word = data[i : i + 1]
    if word:
        put(table[word], width)
        following += 1
        if following in (512, 1024, 2048):
            width += 1
    put(257, width)
    if bits:
        out.append(held << (8 - bits) & 255)
    return bytes(out)


REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))
DECODE = {NONE: bytes, LZW: lzw_decode, DEFLATE: zlib.decompress, 32946: zlib.decompress, PACKBITS: packbits_decode}
ENCODE = {NONE: bytes, LZW: lzw_encode, DEFLATE: lambda b: zlib.compress(b, 1), PACKBITS: packbits_encode}


def directories(data: bytes):
    """Tags of each image directory, in the order of the chain; a chain that comes back to itself ends."""
    if data[:4] not in (b"II*\0", b"MM\0*"):
        raise ValueError("no TIFF header")
    end = "<" if data[:2] == b"II" else ">"
    at, seen = struct.unpack_from(end + "I", data, 4)[0], set()
    while at and at not in seen:
        seen.add(at)
        tags = {}
        for k in range(struct.unpack_from(end + "H", data, at)[0]):
            tag, kind, n = struct.unpack_from(end + "HHI", data, at + 2 + 12 * k)
            if kind not in TYPES:
                continue
            form = f"{end}{n}{TYPES[kind]}"
            place = at + 10 + 12 * k
            if struct.calcsize(form) > 4:
                place = struct.unpack_from(end + "I", data, place)[0]
            tags[tag] = struct.unpack_from(form, data, place)
        yield tags
        at = struct.unpack_from(end + "I", data, at + 2 + 12 * len_of(data, at, end))[0]


def len_of(data: bytes, at: int, end: str) -> int:
    return struct.unpack_from(end + "H", data, at)[0]


def page_pixels(data: bytes, tags: dict) -> np.ndarray:
    """rows x columns x samples of one page, 8 bits each, from strips or tiles."""
    one = lambda tag, default=None: tags.get(tag, (default,))[0]
    width, height, samples = one(256), one(257), one(277, 1)
    if any(b != 8 for b in tags.get(258, (8,))) or one(284, 1) != 1:
        raise ValueError("only chunky 8-bit samples are read")
    decode, predictor = DECODE[one(259, 1)], one(317, 1)
    turned = one(266, 1) == 2  # the lowest bit of a byte is the first
    tiled = 322 in tags
    across, down = (one(322), one(323)) if tiled else (width, min(one(278, height), height) or 1)
    places, sizes = (tags[324], tags[325]) if tiled else (tags[273], tags[279])
    out = np.zeros((height, width, samples), np.uint8)
    columns = -(-width // across) if across else 1
    for k, (place, size) in enumerate(zip(places, sizes, strict=True)):
        top, left = k // columns * down, k % columns * across
        rows = down if tiled else min(down, height - top)
        part = np.frombuffer(decode(data[place : place + size].translate(REVERSED) if turned else data[place : place + size]), np.uint8)[: rows * across * samples].reshape(rows, across, samples)
        if predictor == 2:
            part = np.cumsum(part, axis=1, dtype=np.uint8)
        room = out[top : top + rows, left : left + across]
        room[...] = part[: room.shape[0], : room.shape[1]]
    return out


def write_tiff(payload: bytes, compression: int = DEFLATE, predictor: int = 2, width: int = WIDTH, page_rows: int = PAGE_ROWS, strip_rows: int = STRIP_ROWS) -> bytes:
    """A grey image of 8-bit samples, width samples a row, in pages of at most page_rows rows."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    out, link = bytearray(b"II*\0\0\0\0\0"), 4
    encode = ENCODE[compression]
    for top in range(0, len(rows), page_rows):
        page = rows[top : top + page_rows]
        if predictor == 2:
            page = np.concatenate([page[:, :1], page[:, 1:] - page[:, :-1]], axis=1)
        places, sizes = [], []
        for at in range(0, len(page), strip_rows):
            strip = encode(page[at : at + strip_rows].tobytes())
            places.append(len(out))
            sizes.append(len(strip))
            out += strip
        out += b"\0" * (len(out) & 1)
        entries = [(256, 4, [width]), (257, 4, [len(page)]), (258, 3, [8]), (259, 3, [compression]), (262, 3, [1]), (273, 4, places), (277, 3, [1]), (278, 4, [strip_rows]), (279, 4, sizes), (317, 3, [predictor])]
        packed = []
        for tag, kind, values in entries:
            body = struct.pack(f"<{len(values)}{TYPES[kind]}", *values)
            if len(body) > 4:
                place = len(out)
                out += body
                body = struct.pack("<I", place)
            packed.append(struct.pack("<HHI", tag, kind, len(values)) + body.ljust(4, b"\0"))
        out += b"\0" * (len(out) & 1)
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(packed)) + b"".join(packed)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


FAULTS = (ValueError, KeyError, IndexError, TypeError, ZeroDivisionError, struct.error, zlib.error)


def numbered_pages(data: bytes | None, strict: bool = False) -> list[tuple[int, np.ndarray]]:
    """(number, pixels) of the pages that can be read."""
    out = []
    try:
        for k, tags in enumerate(directories(data) if data else ()):
            try:
                out.append((k, page_pixels(data, tags)))
            except FAULTS:
                if strict:
                    raise
    except FAULTS:
        if strict:
            raise
    return out


def decode_tiff(data: bytes | None, strict: bool = False) -> list[np.ndarray]:
    return [p for _, p in numbered_pages(data, strict)]


def pages(media: DataFrame, key: str = "doc_id", value: str = "media") -> DataFrame:
    """One row per page: key, page, width, height, samples, pixels (row by row)."""
    kind = media.schema[key].dataType
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField(key, kind), T.StructField("page", T.IntegerType()), T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("samples", T.IntegerType()), T.StructField("pixels", T.BinaryType())])

    def run(batches):
        for batch in slices_by_bytes(batches, value, 4 << 20):
            keys, found = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows = [(k, i, p.shape[1], p.shape[0], p.shape[2], p.tobytes()) for k, data in zip(keys, found, strict=True) for i, p in numbered_pages(data)]
            if rows:
                from pyspark.sql.pandas.types import to_arrow_schema

                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), to_arrow_schema(schema), strict=True)], schema=to_arrow_schema(schema))

    return media.select(key, value).transform(mapped, run, schema)


def to_payload(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0"), len(raw)


def encode_texts(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, n_bytes, media: each whole text as a TIFF file."""

    def run(batches):
        for batch in slices_by_bytes(batches, "text", 4 << 20):
            made = [to_payload(t) for t in column(batch, "text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for _, n in made], pa.int64()), pa.array([write_tiff(p) for p, _ in made], pa.binary())], names=[key, "n_bytes", "media"])

    return docs.select(key, "text").transform(mapped, run, f"{key} {docs.schema[key].dataType.simpleString()}, n_bytes long, media binary")


def features(payload: np.ndarray, n_pages: int) -> str:
    """Pages, rows, mean, deviation and entropy of the samples that were read back."""
    counts = np.bincount(payload, minlength=256)
    p = counts[counts > 0] / len(payload)
    mean = float((counts * np.arange(256)).sum()) / len(payload)
    spread = float((counts * (np.arange(256) - mean) ** 2).sum() / len(payload)) ** 0.5
    return f"pages={n_pages};rows={len(payload) // WIDTH};mean={mean:.4f};std={spread:.4f};entropy={float(-(p * np.log2(p)).sum()):.4f};top={int(counts.argmax())}"


def digests(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """Digests and features of stored media (key, n_bytes, media), all from the stored bytes."""

    def run(batches):
        for batch in slices_by_bytes(batches, "media", 4 << 20):
            rows = []
            for data in column(batch, "media").to_pylist():
                found = decode_tiff(data, strict=True)
                samples = np.concatenate([p.reshape(-1) for p in found])
                body = samples.tobytes()
                rows.append((len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-64:]), len(data), hashlib.sha256(data).hexdigest(), features(samples, len(found))))
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True))], names=[key, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return media.transform(mapped, run, f"{key} {media.schema[key].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def text_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature of every document."""
    return digests(encode_texts(docs)).select(F.col("doc_id"), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
