import hashlib
import os
import struct
import zlib

import pytest

from graphloom.llm import tiff


@pytest.mark.parametrize("compression", tiff.ENCODE)
@pytest.mark.parametrize("predictor", [1, 2])
def test_round_trip(compression, predictor):
    for n in (64, 320, 64 * 2100):
        for payload in (os.urandom(n), b"ab" * (n // 2), (b"hello world " * n)[:n], bytes(n)):
            found = tiff.decode_tiff(tiff.write_tiff(payload, compression, predictor), strict=True)
            assert b"".join(p.tobytes() for p in found) == payload
            assert len(found) == -(-n // 64 // tiff.PAGE_ROWS) or len(found) == 2


def test_known_codes():
    assert tiff.packbits_decode(bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA")) == bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22AAAAAAAAAAAAAAAAAAAA")
    codes = "".join(f"{c:09b}" for c in (256, 7, 258, 8, 259, 257))  # clear, 7, "7 7", 8, "7 7 8", end
    assert tiff.lzw_decode(int(codes.ljust(56, "0"), 2).to_bytes(7, "big")) == bytes([7, 7, 7, 8, 7, 7, 8])


def big_endian_tiles():
    """Two samples a pixel, 3 x 3 pixels in tiles of 2 x 2, uncompressed, most significant byte first."""
    pixels = [[(10 * y + x, 100 + 10 * y + x) for x in range(3)] for y in range(3)]
    tiles = []
    for top in (0, 2):
        for left in (0, 2):
            tiles.append(b"".join(bytes(pixels[y][x]) if y < 3 and x < 3 else b"\0\0" for y in (top, top + 1) for x in (left, left + 1)))
    out = bytearray(b"MM\0*" + struct.pack(">I", 0))
    places = []
    for t in tiles:
        places.append(len(out))
        out += t
    lists = {}
    for tag, values in ((324, places), (325, [8] * 4)):
        lists[tag] = len(out)
        out += struct.pack(">4I", *values)
    bits = struct.pack(">HH", 8, 8)
    entries = [(256, 3, 1, struct.pack(">HH", 3, 0)), (257, 3, 1, struct.pack(">HH", 3, 0)), (258, 3, 2, bits), (259, 3, 1, struct.pack(">HH", 1, 0)), (277, 3, 1, struct.pack(">HH", 2, 0)), (322, 3, 1, struct.pack(">HH", 2, 0)), (323, 3, 1, struct.pack(">HH", 2, 0)), (324, 4, 4, struct.pack(">I", lists[324])), (325, 4, 4, struct.pack(">I", lists[325]))]
    struct.pack_into(">I", out, 4, len(out))
    out += struct.pack(">H", len(entries)) + b"".join(struct.pack(">HHI", a, b, c) + v for a, b, c, v in entries) + bytes(4)
    return bytes(out), pixels


def test_tiles_and_big_endian():
    data, pixels = big_endian_tiles()
    (page,) = tiff.decode_tiff(data, strict=True)
    assert page.tolist() == [[list(p) for p in row] for row in pixels]


def test_query_rows(spark):
    rows = [(1, "héllo"), (2, None), (3, ""), (4, "x" * 64), (5, "long " * 60_000), (1, "héllo")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS media", "1 AS page")
    got = {r.doc_id: r for r in tiff.text_media(df).collect()}
    for d, t in rows:
        raw = (t or "").encode()
        payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        r = got[d]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert got[2].media_sha256 == got[3].media_sha256 and got[2].feature == got[3].feature
    pages = tiff.pages(tiff.encode_texts(df.select("doc_id", "text"))).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in pages} == {1: 2, 2: 1, 3: 1, 4: 1, 5: 3}
    assert tiff.text_media(df.limit(0)).count() == 0


def test_sound_pages_of_a_damaged_file_stay():
    payload = bytes(range(256)) * 64 * 64
    data = bytearray(tiff.write_tiff(payload, tiff.DEFLATE))
    whole = tiff.numbered_pages(bytes(data), strict=True)
    assert len(whole) > 2
    tags = list(tiff.directories(bytes(data)))
    at = tags[1][273][0]
    data[at : at + 8] = b"\xff" * 8
    left = tiff.numbered_pages(bytes(data))
    assert [k for k, _ in left] == [k for k, _ in whole if k != 1]


def test_reversed_bits():
    data = tiff.write_tiff(b"abc" * 64, tiff.NONE)
    (tags,) = tiff.directories(data)
    place, size = tags[273][0], tags[279][0]
    turned = data[:place] + data[place : place + size].translate(tiff.REVERSED) + data[place + size :]
    assert (tiff.page_pixels(turned, {**tags, 266: (2,)}) == tiff.page_pixels(data, tags)).all()


def test_damaged_files_give_no_page():
    assert tiff.decode_tiff(b"II*\0\xff\xff\0\0") == [] and tiff.decode_tiff(None) == [] and tiff.decode_tiff(b"nonsense") == []
    with pytest.raises(ValueError):
        tiff.decode_tiff(b"nonsense", strict=True)
