import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from terradelta.llm import tiff_media as t


def test_codecs_round_trip():
    rnd = random.Random(1)
    for n in (0, 1, 2, 3, 127, 128, 129, 130, 500, 9000, 60_000):
        for values in (256, 2, 1):
            data = bytes(rnd.randrange(values) for _ in range(n))
            assert t.unpack_bits(t.pack_bits(data), n) == data and t.unpack_lzw(t.pack_lzw(data), n) == data


def test_known_streams():
    # examples of the published specification and of hand-made codes
    assert t.unpack_bits(bytes([0xFE, 0xAA, 0x02, 0x80, 0x00, 0x2A, 0xFD, 0xAA, 0x03, 0x80, 0x00, 0x2A, 0x22, 0xF7, 0xAA]), 24) == bytes([0xAA] * 3 + [0x80, 0x00, 0x2A] + [0xAA] * 4 + [0x80, 0x00, 0x2A, 0x22] + [0xAA] * 10)
    codes = [256, 7, 258, 8, 8, 258, 6, 6, 257]
    bits = "".join(f"{c:09b}" for c in codes)
    assert t.unpack_lzw(bytes(int(bits[i : i + 8].ljust(8, "0"), 2) for i in range(0, len(bits), 8)), 10) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])


@pytest.mark.parametrize("kind", [t.NONE, t.LZW, t.ADOBE_DEFLATE, t.DEFLATE, t.PACKBITS])
def test_pages(kind):
    rng = np.random.default_rng(0)
    images = [rng.integers(0, 9, (37, 50), dtype=np.uint8), rng.integers(0, 256, (20, 33, 3), dtype=np.uint8)]
    for predictor in (1, 2):
        for tile in (None, (16, 32)):
            for order in "<>":
                got = list(t.pages(t.write(images, kind, predictor, tile, 11, order)))
                assert len(got) == 2 and all((a == b).all() for a, b in zip(images, got))


def test_damage_is_told(spark):
    good = t.write([np.zeros((3, 4), np.uint8)], t.ADOBE_DEFLATE)
    loop = bytearray(good)
    (at,) = struct.unpack_from("<I", good, 4)
    struct.pack_into("<I", loop, at + 2 + 12 * struct.unpack_from("<H", good, at)[0], at)
    assert len(list(t.pages(bytes(loop)))) == 1
    for bad in (b"", b"II", b"MM\0\x2b\0\0\0\x08", good[:30], good[:8] + b"\xff" * 40 + good[48:]):
        with pytest.raises(ValueError):
            list(t.pages(bad))
    files = spark.createDataFrame([(1, good, 0), (2, b"junk", 0), (3, None, 0)], "doc_id long, media binary, page int")
    rows = {r.doc_id: r for r in t.page_rows(files).collect()}
    assert rows[1].error is None and (rows[1].height, rows[1].width) == (3, 4) and rows[2].error and rows[3].error


def test_query(spark, tmp_path):
    texts = ["", None, "a", "é" * 288, "x" * 577, "longer " * 60_000] + [f"text {i} " * i for i in range(80)]
    rows = [(i, x) for i, x in enumerate(texts)] + [(900, "a")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in t.op9_tiff_media(spark, str(tmp_path)).collect()}
    for i, x in rows:
        raw = (x or "").encode()
        padded = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-32:]))
    assert tuple(got[2])[1:] == tuple(got[900])[1:] and got[0].media_sha256 == got[1].media_sha256
    media = t.media_column(spark.createDataFrame(rows, "doc_id long, text string"))
    assert t.page_rows(media).where("doc_id = 5").count() == 2
