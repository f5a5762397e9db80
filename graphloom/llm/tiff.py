"""TIFF media columns: image directories, PackBits, LZW and deflate strips and tiles, horizontal predictor; one row per page."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import id_type

# Fixed values of the format: tags, their types' sizes, and compressions.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIPS, SAMPLES, ROWS, COUNTS, PLANAR, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILES, TILE_COUNTS = 322, 323, 324, 325
_TYPES = {1: ("B", 1), 3: ("H", 2), 4: ("I", 4), 16: ("Q", 8)}
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773

#: How texts are stored: 64 RGB pixels (192 bytes) in a row, rows in a strip and on a page.
ROW_BYTES, STRIP_ROWS, PAGE_ROWS = 192, 64, 4096


#: Bytes of pixels that a page may declare; a file that claims more is taken for damaged.
PAGE_BYTES = 1 << 28


def unpack_bits(data: bytes, most: int = PAGE_BYTES) -> bytes:
    out, i = bytearray(), 0
    while i < len(data) and len(out) < most:
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += 2 + n
        elif n > 128:
            out += data[i + 1 : i + 2] * (257 - n)
            i += 2
        else:
            i += 1
    return bytes(out)


def pack_bits(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        j = i + 1
        while j < len(data) and j - i < 128 and data[j] == data[i]:
            j += 1
        if j - i > 1:
            out += bytes((257 - (j - i), data[i]))
        else:
            while j < len(data) and j - i < 128 and not (j + 1 < len(data) and data[j] == data[j + 1]):
                j += 1
            out += bytes((j - i - 1,)) + data[i:j]
        i = j
    return bytes(out)


def lzw_decode(data: bytes, most: int = PAGE_BYTES) -> bytes:
    """Variable-width codes, high bits first; 256 clears, 257 ends; a width grows one code early, as the format has it."""
    table = [bytes((i,)) for i in range(256)] + [b"", b""]
    out, width, bits, held, before, size = [], 9, 0, 0, b"", 0
    for byte in data:
        if size >= most:
            break
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & ((1 << bits) - 1)
        if code == 257:
            break
        if code == 256:
            del table[258:]
            width, before = 9, b""
            continue
        if code < len(table):
            entry = table[code]
        elif before and code == len(table):
            entry = before + before[:1]
        else:
            raise ValueError("LZW code out of range")
        out.append(entry)
        size += len(entry)
        if before:
            table.append(before + entry[:1])
        before = entry
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return b"".join(out)


def lzw_encode(data: bytes) -> bytes:
    codes, out, held, bits, size, width, word = {}, bytearray(), 0, 0, 258, 9, b""

    def put(code: int) -> None:
        nonlocal held, bits
        held, bits = held << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 255)
        held &= (1 << bits) - 1

    def code(word: bytes) -> int:
        return word[0] if len(word) == 1 else codes[word]

    put(256)
    for i in range(len(data)):
        longer = word + data[i : i + 1]
        if len(longer) == 1 or longer in codes:
            word = longer
            continue
        put(code(word))
        codes[longer], size, word = size, size + 1, data[i : i + 1]
        if size == 4094:
            put(256)
            codes, size, width = {}, 258, 9
        else:
            width = 9 if size < 511 + 1 else 10 if size < 1023 + 1 else 11 if size < 2047 + 1 else 12
    if word:
        put(code(word))
        size += 1
        width = 9 if size < 511 + 1 else 10 if size < 1023 + 1 else 11 if size < 2047 + 1 else 12
    put(257)
    if bits:
        out.append(held << (8 - bits) & 255)
    return bytes(out)


def _inflate(data: bytes, most: int) -> bytes:
    return zlib.decompressobj().decompress(data, most)


_DECODE = {NONE: lambda b, most: b[:most], LZW: lzw_decode, DEFLATE: _inflate, OLD_DEFLATE: _inflate, PACKBITS: unpack_bits}
_ENCODE = {NONE: bytes, LZW: lzw_encode, DEFLATE: lambda b: zlib.compress(b, 6), PACKBITS: pack_bits}


def directories(blob: bytes) -> Iterator[dict[int, tuple]]:
    """The image directories of a file (classic or 64-bit, either byte order), each as tag -> values. A chain that returns to itself is an error."""
    order = {b"II": "<", b"MM": ">"}.get(blob[:2])
    if order is None:
        raise ValueError("not a TIFF file")
    big = struct.unpack_from(order + "H", blob, 2)[0] == 43
    count, entry, offset, width = ("Q", 20, "Q", 8) if big else ("H", 12, "I", 4)
    at, seen = struct.unpack_from(order + offset, blob, 8 if big else 4)[0], set()
    while at:
        if at in seen:
            raise ValueError("image directories form a loop")
        seen.add(at)
        n = struct.unpack_from(order + count, blob, at)[0]
        at += struct.calcsize(order + count)
        tags = {}
        for i in range(n):
            tag, kind, values = struct.unpack_from(order + "HH" + offset, blob, at + i * entry)
            if kind in _TYPES:
                code, size = _TYPES[kind]
                place = at + i * entry + 4 + width
                if size * values > len(blob):
                    raise ValueError("a tag has more values than the file has bytes")
                if size * values > width:
                    place = struct.unpack_from(order + offset, blob, place)[0]
                tags[tag] = struct.unpack_from(f"{order}{values}{code}", blob, place)
        yield tags
        at = struct.unpack_from(order + offset, blob, at + n * entry)[0]


def pages(blob: bytes) -> Iterator[np.ndarray]:
    """The pages of a file of 8-bit samples, each as rows x columns x samples."""
    for tags in directories(blob):
        one = lambda tag, default=None: tags.get(tag, (default,))[0]
        width, height, samples, packing = one(WIDTH), one(HEIGHT), one(SAMPLES, 1), one(COMPRESSION, NONE)
        if set(tags.get(BITS, (1,))) != {8} or one(PLANAR, 1) != 1 or packing not in _DECODE:
            raise ValueError("only interleaved 8-bit samples in known compressions")
        if not (width and height and samples):
            raise ValueError("a page without pixels")
        if width * height * samples > PAGE_BYTES:
            raise ValueError("a page of too many bytes")
        tiled = TILES in tags
        across, down = (one(TILE_WIDTH), one(TILE_HEIGHT)) if tiled else (width, min(one(ROWS, height), height))
        if not (across and down) or across * down * samples > PAGE_BYTES:
            raise ValueError("strips or tiles of no or too many bytes")
        places = list(zip(tags[TILES if tiled else STRIPS], tags[TILE_COUNTS if tiled else COUNTS]))
        per_row = -(-width // across)
        if len(places) != per_row * -(-height // down):
            raise ValueError("strips or tiles don't cover the page")
        page = np.zeros((height, width, samples), np.uint8)
        for i, (at, size) in enumerate(places):
            y, x = i // per_row * down, i % per_row * across
            rows = down if tiled else min(down, height - y)
            part = np.frombuffer(_DECODE[packing](blob[at : at + size], rows * across * samples), np.uint8)[: rows * across * samples].reshape(rows, across, samples)
            if one(PREDICTOR, 1) == 2:
                part = np.cumsum(part, axis=1, dtype=np.uint8)
            page[y : y + rows, x : x + across] = part[: height - y, : width - x]
        yield page


def encode(images: list[np.ndarray], compression: int = DEFLATE, predictor: int = 2, strip_rows: int = STRIP_ROWS, tile: int | None = None, order: str = "<") -> bytes:
    """A classic TIFF file with one page for each image (rows x columns x samples, 8 bits)."""
    out, links = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0)), [4]
    for image in images:
        height, width, samples = image.shape
        parts = []
        if tile:
            for y in range(0, height, tile):
                for x in range(0, width, tile):
                    part = np.zeros((tile, tile, samples), np.uint8)
                    cut = image[y : y + tile, x : x + tile]
                    part[: cut.shape[0], : cut.shape[1]] = cut
                    parts.append(part)
        else:
            parts = [image[y : y + strip_rows] for y in range(0, height, strip_rows)]
        at, sizes = [], []
        for part in parts:
            if predictor == 2:
                part = np.diff(part, axis=1, prepend=np.zeros((part.shape[0], 1, samples), np.uint8))
            data = _ENCODE[compression](np.ascontiguousarray(part).tobytes())
            at.append(len(out))
            sizes.append(len(data))
            out += data
        tags = {WIDTH: [width], HEIGHT: [height], BITS: [8] * samples, COMPRESSION: [compression], PHOTOMETRIC: [2 if samples == 3 else 1], SAMPLES: [samples], PREDICTOR: [predictor]}
        tags |= {TILE_WIDTH: [tile], TILE_HEIGHT: [tile], TILES: at, TILE_COUNTS: sizes} if tile else {STRIPS: at, ROWS: [strip_rows], COUNTS: sizes}
        entries = b""
        for tag, values in sorted(tags.items()):
            data = struct.pack(f"{order}{len(values)}I", *values)
            if len(data) > 4:
                place = len(out)
                out += data
                data = struct.pack(order + "I", place)
            entries += struct.pack(order + "HHI", tag, 4, len(values)) + data
        out += b"\0" * (len(out) % 2)
        struct.pack_into(order + "I", out, links[-1], len(out))
        out += struct.pack(order + "H", len(tags)) + entries + b"\0" * 4
        links.append(len(out) - 4)
    return bytes(out)


def payload(text: bytes) -> bytes:
    """The text and as many spaces as fill whole rows, one row at least."""
    return text + b" " * (max(1, -(-len(text) // ROW_BYTES)) * ROW_BYTES - len(text))


def text_images(text: bytes) -> list[np.ndarray]:
    rows = np.frombuffer(payload(text), np.uint8).reshape(-1, ROW_BYTES // 3, 3)
    return [rows[i : i + PAGE_ROWS] for i in range(0, len(rows), PAGE_ROWS)]


def page_rows(blob: bytes) -> list[dict]:
    out = []
    for i, page in enumerate(pages(blob)):
        out.append({"page": i, "width": page.shape[1], "height": page.shape[0], "samples": page.shape[2], "pixels": page.tobytes(), "mean": float(page.mean()), "deviation": float(page.std()), "levels": int(np.count_nonzero(np.bincount(page.ravel(), minlength=256)))})
    return out


_PAGE = [("page", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("samples", pa.int32()), ("pixels", pa.binary()), ("mean", pa.float64()), ("deviation", pa.float64()), ("levels", pa.int32())]
_PAGES = "array<struct<page:int,width:int,height:int,samples:int,pixels:binary,mean:double,deviation:double,levels:int>>"
#: Rows of media that one Arrow batch of results holds; bounds the memory of pixels in flight.
CHUNK_BYTES = 4 << 20


def stored_as(text: bytes) -> dict:
    """Coding, predictor, layout and byte order of a text's file, by the checksum of the text: all that the reader knows occur in any corpus.

    Of 16 texts one is LZW, one PackBits, one plain and the rest deflated, since the first two are coded byte by byte.
    """
    kind = zlib.crc32(text) % 16
    coding = {0: LZW, 1: PACKBITS, 2: NONE}.get(kind, DEFLATE)
    return {"compression": coding, "predictor": 1 + (kind not in (1, 5)), "tile": 64 if kind in (1, 4, 5) else None, "order": ">" if kind in (0, 3) else "<"}


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, media``: every text stored as a TIFF file, coded by ``stored_as``. Null counts as empty; an empty text is one row of spaces."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [(t or "").encode() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in raw], pa.int64()), pa.array([encode(text_images(t), **stored_as(t)) for t in raw], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string")).mapInArrow(write, f"doc_id {id_type(docs, id_col)}, n_bytes long, media binary")


def decoded(media: DataFrame, media_col: str = "media") -> DataFrame:
    """``media`` with ``pages``: an array of the pages of each file, and ``error``.

    A null file has null pages. A file that is damaged or of another kind has null pages and the reason in ``error``; no row is lost.
    Columns ``pages`` and ``error`` of the input are replaced; all others stay.
    """
    kept = media.drop("pages", "error")
    at, fields = kept.columns.index(media_col), [f"_{i}" for i in range(len(kept.columns))]  # as Spark finds no dotted names here
    pages_type = pa.list_(pa.struct(_PAGE))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, size, found, errors = 0, 0, [], []

            def made(end: int):
                part = batch.slice(start, end - start)
                return pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pages_type), pa.array(errors, pa.string())], names=[*fields, "pages", "error"])

            for i, blob in enumerate(batch.column(at)):
                blob = blob.as_py()
                try:
                    found.append(None if blob is None else page_rows(blob))
                    errors.append(None)
                except (ValueError, KeyError, TypeError, IndexError, ArithmeticError, MemoryError, struct.error, zlib.error) as e:
                    found.append(None)
                    errors.append(str(e)[:200] or type(e).__name__)
                size += sum(len(p["pixels"]) for p in found[-1] or ())
                if size > CHUNK_BYTES:
                    yield made(i + 1)
                    start, size, found, errors = i + 1, 0, [], []
            if found or not batch.num_rows:
                yield made(batch.num_rows)

    ddl = ", ".join(f"{name} {f.dataType.simpleString()}" for name, f in zip(fields, kept.schema.fields))
    return kept.toDF(*fields).mapInArrow(read, f"{ddl}, pages {_PAGES}, error string").toDF(*kept.columns, "pages", "error")


def tiff_pages(media: DataFrame, media_col: str = "media") -> DataFrame:
    """One row per page: the columns of ``media`` but the file itself, and page, width, height, samples, pixels, mean, deviation, levels. Columns of ``media`` with one of these names,
    or named ``pages`` or ``error``, are replaced; all others may have any names. Null and damaged files have no pages and so no row here; ``decoded`` keeps them with the reason."""
    opened = decoded(media, media_col)
    own = {"pages", "error", media_col, *(n for n, _ in _PAGE)}
    rest = {f"_{i}": c for i, c in enumerate(opened.columns) if c not in own}
    row = F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`").alias(k) for k, c in rest.items()])
    return opened.select(row.alias("row"), F.explode("pages").alias("page")).select(*[F.col(f"row.{k}").alias(c) for k, c in rest.items()], "page.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = decoded(text_media(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    back = read.select(
        "doc_id", "n_bytes", "media", "pages",
        F.when(F.size("pages") == 1, F.col("pages")[0]["pixels"]).otherwise(F.unhex(F.array_join(F.transform("pages", lambda p: F.hex(p["pixels"])), ""))).alias("_payload"),
    )
    feature = F.array_join(F.transform("pages", lambda p: F.format_string("%dx%dx%d:%.4f:%.4f:%d", p["width"], p["height"], p["samples"], p["mean"], p["deviation"], p["levels"])), ";")
    return back.select(
        "doc_id", "n_bytes", F.octet_length("_payload").cast("long").alias("payload_bytes"), F.sha2("_payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(_payload, -16)")).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), feature.alias("feature"), F.size("pages").alias("n_pages"),
    )
