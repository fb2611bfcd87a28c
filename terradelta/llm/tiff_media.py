"""TIFF media columns: image files in binary columns, one row per page.

``pages`` walks the chain of image directories of either byte order, gathers
the strips or tiles of each, undoes PackBits, LZW or deflate and the
horizontal predictor, and gives one 8-bit (or 16-bit) array per page.
``encode`` writes such files for texts: the UTF-8 bytes, padded with 255 to a
positive multiple of 576, become grey rows of 576 samples, at most ROWS rows
to a page.  PackBits, LZW, LZW with the predictor, deflate, and deflate in tiles
with the predictor take turns by the payload's checksum, whatever its size, so
equal texts give equal files.

Nothing is shuffled: each file is written, read back and described in the task
that read its row, one at a time.

Edge cases: a null or empty text is one row of 255; a damaged or unsupported
file raises ValueError in ``pages`` and gives one row with ``error`` set in
``page_rows``; a chain of directories that loops ends at the first repeat;
repeated rows give equal rows; an empty table an empty result; columns other
than doc_id and text pass by.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH = 576
ROWS = 512
STRIP_ROWS = 128
TILE = (64, 64)
PAD = 255

# fixed values of the TIFF 6.0 specification
NONE, LZW, ADOBE_DEFLATE, DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
IMAGE_WIDTH, IMAGE_LENGTH, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR, PREDICTOR = 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_COUNTS = 322, 323, 324, 325
#: Compression, predictor and tiles of the files that encode() writes.
LAYOUTS = ((PACKBITS, 1), (LZW, 1), (LZW, 2), (ADOBE_DEFLATE, 1), (ADOBE_DEFLATE, 2, TILE))
KINDS = {1: "B", 2: "B", 3: "H", 4: "I", 6: "b", 7: "B", 8: "h", 9: "i"}


def unpack_bits(data: bytes, size: int) -> bytes:
    out, i = bytearray(), 0
    while i < len(data) and len(out) < size:
        n = data[i]
        i += 1
        if n < 128:
            out += data[i : i + n + 1]
            i += n + 1
        elif n > 128:
            out += data[i : i + 1] * (257 - n)
            i += 1
    return bytes(out)


def pack_bits(data: bytes) -> bytes:
    out, i, plain = bytearray(), 0, 0
    n = len(data)
    while i < n:
        j = i + 1
        while j < n and j - i < 128 and data[j] == data[i]:
            j += 1
        if j - i >= 3 or j == n and plain == i:
            for a in range(plain, i, 128):
                b = min(i, a + 128)
                out.append(b - a - 1)
                out += data[a:b]
            out += bytes([257 - (j - i), data[i]]) if j - i > 1 else bytes([0, data[i]])
            plain = i = j
        else:
            i = j
    for a in range(plain, n, 128):
        b = min(n, a + 128)
        out.append(b - a - 1)
        out += data[a:b]
    return bytes(out)


def unpack_lzw(data: bytes, size: int) -> bytes:
    """Codes of 9 to 12 bits, high bit first, widened one code early."""
    out, table, last = bytearray(), [], b""
    width, hold, bits = 9, 0, 0
    for byte in data:
        hold, bits = (hold << 8 | byte) & 0xFFFFFF, bits + 8
        if bits < width:
            continue
        bits -= width
        code = hold >> bits & ((1 << width) - 1)
        if code == 257:
            break
        if code == 256:
            table, width, last = [bytes([i]) for i in range(256)] + [b"", b""], 9, b""
            continue
        if not table or code > len(table):
            raise ValueError("bad LZW code")
        entry = table[code] if code < len(table) else last + last[:1]
        out += entry
        if last:
            table.append(last + entry[:1])
            width = 9 + (len(table) >= 511) + (len(table) >= 1023) + (len(table) >= 2047)
        last = entry
        if len(out) >= size:
            break
    return bytes(out)


def pack_lzw(data: bytes) -> bytes:
    out, hold, bits, width = bytearray(), 0, 0, 9
    table: dict[bytes, int] = {}

    def put(code: int) -> None:
        nonlocal hold, bits
        hold, bits = hold << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(hold >> bits & 255)
        hold &= (1 << bits) - 1

    put(256)
    table, used, run = {bytes([i]): i for i in range(256)}, 258, b""
    for i in range(len(data)):
        longer = run + data[i : i + 1]
        if longer in table:
            run = longer
            continue
        put(table[run])
        table[longer], used = used, used + 1
        if used == 4094:
            put(256)
            table, used, width = {bytes([j]): j for j in range(256)}, 258, 9
        else:
            width = 9 + (used >= 512) + (used >= 1024) + (used >= 2048)
        run = data[i : i + 1]
    if run:
        put(table[run])
        used += 1
        width = 9 + (used >= 512) + (used >= 1024) + (used >= 2048)
    put(257)
    if bits:
        out.append(hold << (8 - bits) & 255)
    return bytes(out)


def _unpack(kind: int, data: bytes, size: int) -> bytes:
    if kind == NONE:
        found = data[:size]
    elif kind == PACKBITS:
        found = unpack_bits(data, size)
    elif kind == LZW:
        found = unpack_lzw(data, size)
    elif kind in (ADOBE_DEFLATE, DEFLATE):
        try:
            found = zlib.decompressobj().decompress(data, size)
        except zlib.error as e:
            raise ValueError(str(e)) from e
    else:
        raise ValueError(f"compression {kind} is not supported")
    if len(found) < size:
        raise ValueError("too few samples")
    return found[:size]


def _directory(data: bytes, order: str, at: int) -> tuple[dict[int, tuple[int, ...]], int]:
    try:
        (n,) = struct.unpack_from(order + "H", data, at)
        tags = {}
        for i in range(n):
            tag, kind, count, _ = struct.unpack_from(order + "HHII", data, at + 2 + 12 * i)
            if kind not in KINDS:
                continue
            size = struct.calcsize(KINDS[kind]) * count
            where = at + 10 + 12 * i if size <= 4 else struct.unpack_from(order + "I", data, at + 10 + 12 * i)[0]
            tags[tag] = struct.unpack_from(f"{order}{count}{KINDS[kind]}", data, where)
        (following,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)
    except struct.error as e:
        raise ValueError(f"bad directory: {e}") from e
    return tags, following


def _page(data: bytes, order: str, tags: dict[int, tuple[int, ...]]) -> np.ndarray:
    one = lambda tag, default: tags.get(tag, (default,))[0]
    width, height, samples, bits = one(IMAGE_WIDTH, 0), one(IMAGE_LENGTH, 0), one(SAMPLES, 1), one(BITS, 1)
    if bits not in (8, 16) or len(set(tags.get(BITS, (bits,)))) > 1:
        raise ValueError(f"{bits} bits are not supported")
    if one(PLANAR, 1) != 1 and samples > 1:
        raise ValueError("separate planes are not supported")
    if not width or not height:
        raise ValueError("an empty image")
    kind, predictor = one(COMPRESSION, NONE), one(PREDICTOR, 1)
    if predictor not in (1, 2):
        raise ValueError(f"predictor {predictor} is not supported")
    if TILE_WIDTH in tags:
        w, h = one(TILE_WIDTH, 0), one(TILE_LENGTH, 0)
        offsets, counts = tags.get(TILE_OFFSETS, ()), tags.get(TILE_COUNTS, ())
    else:
        w, h = width, min(one(ROWS_PER_STRIP, height), height)
        offsets, counts = tags.get(STRIP_OFFSETS, ()), tags.get(STRIP_COUNTS, ())
    across, down = -(-width // w), -(-height // h)
    if len(offsets) < across * down or len(counts) < across * down:
        raise ValueError("strips or tiles are missing")
    dtype = np.dtype(np.uint8 if bits == 8 else order + "u2")
    image = np.empty((height, width, samples), dtype.newbyteorder("="))
    for i in range(across * down):
        y, x = i // across * h, i % across * w
        rows = h if TILE_WIDTH in tags else min(h, height - y)
        raw = _unpack(kind, data[offsets[i] : offsets[i] + counts[i]], rows * w * samples * dtype.itemsize)
        block = np.frombuffer(raw, dtype).astype(image.dtype).reshape(rows, w, samples)
        if predictor == 2:
            block = np.cumsum(block, axis=1, dtype=image.dtype)
        image[y : y + rows, x : x + w] = block[: height - y, : width - x]
    return image[:, :, 0] if samples == 1 else image


def pages(data: bytes) -> Iterator[np.ndarray]:
    """The pages of a file, in the order of its directories."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2], "")
    if not order or len(data) < 8 or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    (at,) = struct.unpack_from(order + "I", data, 4)
    been = set()
    while at and at not in been:
        been.add(at)
        tags, following = _directory(data, order, at)
        yield _page(data, order, tags)
        at = following


def write(images: list[np.ndarray], kind: int, predictor: int = 1, tile: tuple[int, int] | None = None, strip_rows: int = STRIP_ROWS, order: str = "<") -> bytes:
    """A file of grey or multi-sample 8-bit pages."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    for image in images:
        image = image if image.ndim == 3 else image[:, :, None]
        height, width, samples = image.shape
        h, w = tile or (strip_rows, width)
        offsets, counts = [], []
        for y in range(0, height, h):
            for x in range(0, width, w):
                block = image[y : y + h, x : x + w]
                if tile:
                    block = np.pad(block, ((0, h - block.shape[0]), (0, w - block.shape[1]), (0, 0)))
                if predictor == 2:
                    block = np.diff(block, axis=1, prepend=np.zeros_like(block[:, :1]))
                raw = np.ascontiguousarray(block).tobytes()
                if kind == PACKBITS:
                    raw = b"".join(pack_bits(raw[a : a + w * samples]) for a in range(0, len(raw), w * samples))
                elif kind == LZW:
                    raw = pack_lzw(raw)
                elif kind in (ADOBE_DEFLATE, DEFLATE):
                    raw = zlib.compress(raw, 1)
                offsets.append(len(out))
                counts.append(len(raw))
                out += raw
        out += b"\0" * (len(out) % 2)
        tags = [(IMAGE_WIDTH, "I", [width]), (IMAGE_LENGTH, "I", [height]), (BITS, "H", [8] * samples), (COMPRESSION, "H", [kind]), (PHOTOMETRIC, "H", [1 if samples == 1 else 2]), (SAMPLES, "H", [samples]), (PLANAR, "H", [1]), (PREDICTOR, "H", [predictor])]
        tags += [(TILE_WIDTH, "I", [w]), (TILE_LENGTH, "I", [h]), (TILE_OFFSETS, "I", offsets), (TILE_COUNTS, "I", counts)] if tile else [(STRIP_OFFSETS, "I", offsets), (ROWS_PER_STRIP, "I", [h]), (STRIP_COUNTS, "I", counts)]
        entries = b""
        for tag, code, values in sorted(tags):
            raw = struct.pack(f"{order}{len(values)}{code}", *values)
            if len(raw) > 4:
                where, raw = len(out), raw
                out += raw + b"\0" * (len(raw) % 2)
                raw = struct.pack(order + "I", where)
            entries += struct.pack(order + "HHI", tag, {"H": 3, "I": 4}[code], len(values)) + raw.ljust(4, b"\0")
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(tags)) + entries
        link = len(out)
        out += struct.pack(order + "I", 0)
    return bytes(out)


def payload(text: str | None) -> bytes:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes([PAD]) * (-len(raw) % WIDTH or (0 if raw else WIDTH))


def encode(text: str | None) -> bytes:
    raw = np.frombuffer(payload(text), np.uint8).reshape(-1, WIDTH)
    check = zlib.crc32(raw.tobytes())
    images = [raw[a : a + ROWS] for a in range(0, len(raw), ROWS)]
    return write(images, *LAYOUTS[check % len(LAYOUTS)])


def feature(images: list[np.ndarray]) -> str:
    """Pages, rows, then mean (in hundredths), distinct values and busiest value of all samples."""
    counts = sum((np.bincount(x.ravel(), minlength=256) for x in images), np.zeros(256, np.int64))
    n = int(counts.sum())
    mean = int((counts * np.arange(256)).sum()) * 100 // n
    return f"pages={len(images)};rows={sum(len(x) for x in images)};mean={mean};distinct={int((counts > 0).sum())};top={int(counts.argmax())}"


def page_rows(files: DataFrame, media: str = "media", key: str = "doc_id") -> DataFrame:
    """(key, page, height, width, samples, pixels, error): one row for each page of a binary column."""
    kind = files.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [key, "page", "height", "width", "samples", "pixels", "error"]
        types = [batch_type, pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string()]
        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows, page = [], 0
                try:
                    for image in pages(data.as_py() or b""):
                        rows.append([k, page, image.shape[0], image.shape[1], 1 if image.ndim == 2 else image.shape[2], image.tobytes(), None])
                        page += 1
                except ValueError as e:
                    rows.append([k, page, None, None, None, None, str(e)])
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    from pyspark.sql.pandas.types import to_arrow_type

    batch_type = to_arrow_type(files.schema[key].dataType)
    return files.select(key, media).mapInArrow(run, f"{key} {kind}, page int, height int, width int, samples int, pixels binary, error string")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            text = text.as_py()
            media = encode(text)
            images = list(pages(media))
            read = b"".join(x.tobytes() for x in images)
            rows.append((doc, len((text or "").encode("utf-8", "surrogatepass")), len(read), hashlib.sha256(read).hexdigest(), zlib.crc32(read[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(images)))
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        columns = list(zip(*rows, strict=True)) or [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def _media(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array([doc], pa.int64()), pa.array([encode(text.as_py())], pa.binary())], names=["doc_id", "media"])


def media_column(docs: DataFrame) -> DataFrame:
    """(doc_id, media): the file of each text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_media, "doc_id long, media binary")


def op9_tiff_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(_digest, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
