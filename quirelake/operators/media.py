"""What can be told of PDF and image files from their bytes: pages, sizes, orientation, limits."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The size that stands for an image that can't be read or is too narrow.
DUMMY = (32, 32)
#: Longer side over shorter side beyond which an image counts as unreadable.
MOST_ASPECT = 200
#: Bytes of one compressed PDF stream that are looked at.
MOST_STREAM = 64 << 20
_PAGE = re.compile(rb"/Type\s*/Page(?![A-Za-z])")
_OBJECT = re.compile(rb"(?<!\d)(\d{1,10})\s+\d{1,5}\s+obj\b")
_PACKED = re.compile(rb"/Type\s*/ObjStm\b")


def _entry(body: bytes, name: bytes) -> int | None:
    """The first number behind a name of a dictionary (of a reference, its object)."""
    found = re.search(rb"/" + name + rb"\s+(\d+)", body)
    return int(found[1]) if found else None


def _unpacked(body: bytes) -> Iterator[tuple[int, bytes]]:
    """Objects (number, body) of an object stream; none where it can't be read, as in encrypted files."""
    start = re.search(rb"\bstream\r?\n", body)
    try:
        held = zlib.decompressobj().decompress(body[start.end() :], MOST_STREAM)
        first, many = _entry(body, b"First"), _entry(body, b"N")
        numbers = list(map(int, held[:first].split()[: 2 * many]))
        places = [*numbers[1::2], len(held) - first]
    except (AttributeError, TypeError, ValueError, zlib.error):
        return
    for number, start, end in zip(numbers[::2], places, places[1:], strict=False):
        yield number, held[first + start : first + end]


def page_count(data: bytes | None) -> int | None:
    """Pages of a PDF; None if it is no PDF.

    Of an object that updates have written several times the last one counts. The page tree of the
    last root says how many pages there are; where it can't be followed (a damaged or encrypted
    file), the page objects are counted, each number once.
    """
    if not data or b"%PDF-" not in data[:1024]:
        return None
    objects: dict[int, bytes | tuple[int, int]] = {}  # plain ones as their place, so that nothing is copied
    starts = [(int(m[1]), m.start(), m.end()) for m in _OBJECT.finditer(data)]
    for k, (number, _, start) in enumerate(starts):
        behind = starts[k + 1][1] if k + 1 < len(starts) else len(data)  # an object ends where the next one begins, at the latest
        end = data.find(b"endobj", start, behind)
        place = objects[number] = start, end if end >= 0 else behind
        if _PACKED.search(data, place[0], min(place[1], place[0] + 1024)):
            objects |= _unpacked(data[place[0] : place[1]])
    body = lambda number: data[slice(*x)] if isinstance(x := objects.get(number, b""), tuple) else x
    roots = re.findall(rb"/Root\s+(\d+)", data)
    if roots and (top := _entry(body(int(roots[-1])), b"Pages")) is not None and (count := _entry(body(top), b"Count")) is not None:
        return count
    plain = sum(bool(_PAGE.search(data, *x) if isinstance(x, tuple) else _PAGE.search(x)) for x in objects.values())
    return plain if objects else len(_PAGE.findall(data))


@F.pandas_udf(T.IntegerType())
def pdf_page_count(content: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in content:
        yield pd.Series([page_count(None if c is None else bytes(c)) for c in batch], dtype="Int32")


def looks_like_pdf(content: Column) -> Column:
    """Whether ``%PDF-`` stands in the first 1024 bytes."""
    return F.instr(F.decode(F.substring(content, 1, 1024), "ISO-8859-1"), "%PDF-") > 0


def pdf_pages(files: DataFrame, first: int | None = None) -> DataFrame:
    """name, page_count, page_idx of every page of (name, content), or of the first ``first`` pages; files that are no PDF have none."""
    counted = files.where(looks_like_pdf(F.col("content"))).select("name", pdf_page_count("content").alias("page_count"))
    shown = F.col("page_count") if first is None else F.least(F.col("page_count"), F.lit(first))
    return counted.where(shown > 0).select("name", "page_count", F.explode(F.sequence(F.lit(0), shown - 1)).alias("page_idx"))


def upload_error(length: Column, pages: Column, most_bytes: int, most_pages: int) -> Column:
    """Name of the limit that an upload breaks, or null."""
    return F.when(length > most_bytes, "UploadTooLargeError").when(pages > most_pages, "PageLimitExceededError")


def image_header(data: bytes | None) -> tuple[str, int, int, int] | None:
    """(format, width, height, orientation) of a PNG, GIF, BMP, JPEG, WebP or TIFF image; only a JPEG's orientation is looked at."""
    if not data:
        return None
    try:
        if data.startswith(b"\x89PNG\r\n\x1a\n"):
            return ("png", *struct.unpack(">II", data[16:24]), 1)
        if data[:6] in (b"GIF87a", b"GIF89a"):
            return ("gif", *struct.unpack("<HH", data[6:10]), 1)
        if data.startswith(b"BM"):
            width, height = struct.unpack("<ii", data[18:26])
            return "bmp", width, abs(height), 1
        if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
            return _webp(data)
        if data[:4] in (b"II*\0", b"MM\0*"):
            return _tiff(data)
        return _jpeg(data) if data.startswith(b"\xff\xd8") else None
    except (struct.error, IndexError):
        return None


def _webp(data: bytes) -> tuple[str, int, int, int] | None:
    """A WebP image's first chunk tells its size: lossy, lossless, or the canvas of an extended file."""
    kind, body = data[12:16], data[20:30]
    if kind == b"VP8 " and body[3:6] == b"\x9d\x01\x2a":
        width, height = struct.unpack("<HH", body[6:10])
        return "webp", width & 0x3FFF, height & 0x3FFF, 1
    if kind == b"VP8L" and body[:1] == b"\x2f":
        (bits,) = struct.unpack("<I", body[1:5])
        return "webp", 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF), 1
    if kind == b"VP8X" and len(body) == 10:
        return "webp", 1 + int.from_bytes(body[4:7], "little"), 1 + int.from_bytes(body[7:10], "little"), 1
    return None


def _tiff(data: bytes) -> tuple[str, int, int, int] | None:
    """Width and height of a TIFF file's first directory, as short or long numbers."""
    order = "<" if data[:2] == b"II" else ">"
    (at,) = struct.unpack(order + "I", data[4:8])
    (n,) = struct.unpack(order + "H", data[at : at + 2])
    sizes = {}
    for k in range(n):
        tag, kind = struct.unpack(order + "HH", data[at + 2 + 12 * k : at + 6 + 12 * k])
        if tag in (0x0100, 0x0101) and kind in (3, 4):
            (sizes[tag],) = struct.unpack(order + ("H" if kind == 3 else "I"), data[at + 10 + 12 * k : at + (12 if kind == 3 else 14) + 12 * k])
    return ("tiff", sizes[0x0100], sizes[0x0101], 1) if len(sizes) == 2 else None


def _jpeg(data: bytes) -> tuple[str, int, int, int] | None:
    at, orientation = 2, 1
    while at + 4 <= len(data) and data[at] == 0xFF:
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        (size,) = struct.unpack(">H", data[at + 2 : at + 4])
        body = data[at + 4 : at + 2 + size]
        if marker == 0xE1 and body.startswith(b"Exif\0\0"):
            orientation = _orientation(body[6:])
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack(">HH", body[1:5])
            return "jpeg", width, height, orientation
        at += 2 + size
    return None


def _orientation(tiff: bytes) -> int:
    order = {b"II": "<", b"MM": ">"}.get(tiff[:2])
    if order is None:
        return 1
    (at,) = struct.unpack(order + "I", tiff[4:8])
    (n,) = struct.unpack(order + "H", tiff[at : at + 2])
    for k in range(n):
        tag, _, _, value = struct.unpack(order + "HHIH", tiff[at + 2 + 12 * k : at + 12 + 12 * k])
        if tag == 0x0112 and 1 <= value <= 8:
            return value
    return 1


_SIZE = T.StructType([T.StructField("format", T.StringType()), T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("orientation", T.IntegerType())])


@F.pandas_udf(_SIZE)
def image_size(content: pd.Series) -> pd.DataFrame:
    """format, width, height as shown (a JPEG turned as its orientation says) and orientation; nulls where it can't be read."""
    rows = []
    for c in content:
        found = image_header(None if c is None else bytes(c))
        if found is None:
            rows.append((None, None, None, None))
            continue
        kind, width, height, turned = found
        rows.append((kind, height, width, turned) if turned >= 5 else (kind, width, height, turned))
    return pd.DataFrame(rows, columns=["format", "width", "height", "orientation"]).astype({"width": "Int32", "height": "Int32", "orientation": "Int32"})


def data_uri_bytes(uri: Column) -> Column:
    """Bytes of a base64 data URI; null where it isn't one."""
    return F.when(uri.rlike(r"^data:image[^,]*,"), F.try_to_binary(F.regexp_extract(uri, r"(?s)^[^,]*,(.*)\z", 1), F.lit("base64")))


def loaded_size(width: Column, height: Column, least_pixels: int | None = None, least_side: int | None = None, most_pixels: int | None = None, most_side: int | None = None, doubled: bool = False) -> Column:
    """struct(width, height) of an image after loading: doubled, made larger by pixels then by its shorter side, smaller by pixels or else by its longer side.

    Fractions are cut off at every step. What can't be read, or is over 200 times as long as wide,
    becomes 32 x 32.
    """
    size = F.struct(width.cast("int").alias("width"), height.cast("int").alias("height"))

    def step(now: Column, when: Column, scale: Column) -> Column:
        grown = F.struct((now["width"] * scale).cast("int").alias("width"), (now["height"] * scale).cast("int").alias("height"))
        return F.when(when, grown).otherwise(now)

    def apply(value: Column, rule) -> Column:
        return F.transform(F.array(value), rule)[0]

    area = lambda s: s["width"].cast("long") * s["height"]
    shorter, longer = (lambda s: F.least(s["width"], s["height"])), (lambda s: F.greatest(s["width"], s["height"]))
    if doubled:
        size = apply(size, lambda s: F.struct((s["width"] * 2).alias("width"), (s["height"] * 2).alias("height")))
    if least_pixels:
        size = apply(size, lambda s: step(s, area(s) < least_pixels, F.sqrt(least_pixels / area(s))))
    if least_side:
        size = apply(size, lambda s: step(s, shorter(s) < least_side, F.lit(least_side) / shorter(s)))
    if most_pixels:
        small = apply(size, lambda s: step(s, area(s) > most_pixels, F.sqrt(most_pixels / area(s))))
        if most_side:
            small = apply(size, lambda s: F.when(area(s) > most_pixels, step(s, F.lit(True), F.sqrt(most_pixels / area(s)))).otherwise(step(s, longer(s) > most_side, F.lit(most_side) / longer(s))))
        size = small
    elif most_side:
        size = apply(size, lambda s: step(s, longer(s) > most_side, F.lit(most_side) / longer(s)))
    dummy = F.struct(F.lit(DUMMY[0]).alias("width"), F.lit(DUMMY[1]).alias("height"))
    bad = lambda s: s["width"].isNull() | s["height"].isNull() | (shorter(s) <= 0) | (longer(s) > MOST_ASPECT * shorter(s))
    return apply(size, lambda s: F.when(bad(s), dummy).otherwise(s))


def largest_component(mask: np.ndarray) -> int:
    """Cells of the largest group of set cells that touch at sides or corners."""
    left, best = {(int(y), int(x)) for y, x in np.argwhere(mask)}, 0
    while left:
        reached = [left.pop()]
        for y, x in reached:
            for near in [(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]:
                if near in left:
                    left.remove(near)
                    reached.append(near)
        best = max(best, len(reached))
    return best


def mask_component(cells: Column, width: int) -> Column:
    """Size of the largest group in a mask given as a flat array of booleans, row by row."""

    @F.pandas_udf(T.IntegerType())
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda m: largest_component(np.array(m, bool).reshape(-1, width)) if m is not None and len(m) else 0)

    return of(cells)


def overlay_pdf(pages: list[tuple[int, int, list[tuple[int, int, int, int, str]]]]) -> bytes:
    """A PDF with the boxes of each page (width, height, boxes) and their numbers and labels, without the page images."""
    streams = []
    for _, height, boxes in pages:
        drawn = []
        for k, (x1, y1, x2, y2, label) in enumerate(boxes):
            told = f"{k}: {label}".encode("latin-1", "replace").decode("latin-1").replace("\\", "\\\\").replace("(", "\\(").replace(")", "\\)")
            drawn.append(f"1 0 0 RG {x1} {height - y2} {x2 - x1} {y2 - y1} re S BT /F1 12 Tf {x1} {height - y1 + 2} Td ({told}) Tj ET")
        streams.append("\n".join(drawn).encode("latin-1"))
    kids = " ".join(f"{4 + 2 * k} 0 R" for k in range(len(pages)))
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", f"<< /Type /Pages /Kids [{kids}] /Count {len(pages)} >>".encode(), b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>"]
    for k, ((width, height, _), stream) in enumerate(zip(pages, streams, strict=True)):
        objects.append(f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 {width} {height}] /Resources << /Font << /F1 3 0 R >> >> /Contents {5 + 2 * k} 0 R >>".encode())
        objects.append(b"<< /Length %d >>\nstream\n" % len(stream) + stream + b"\nendstream")
    out, places = bytearray(b"%PDF-1.4\n"), []
    for k, body in enumerate(objects, 1):
        places.append(len(out))
        out += b"%d 0 obj\n" % k + body + b"\nendobj\n"
    table = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places)
    return bytes(out + b"trailer << /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, table))


def overlays(pages: DataFrame) -> DataFrame:
    """name, pdf: one overlay per document from (name, page_idx, width, height, boxes of x1, y1, x2, y2, label)."""

    def draw(rows: pd.DataFrame) -> pd.DataFrame:
        drawn = overlay_pdf([(w, h, [tuple(b[k] for k in ("x1", "y1", "x2", "y2", "label")) for b in boxes]) for w, h, boxes in rows.sort_values("page_idx")[["width", "height", "boxes"]].itertuples(index=False)])
        return pd.DataFrame({"name": [rows["name"].iloc[0]], "pdf": [drawn]})

    return pages.groupBy("name").applyInPandas(draw, "name string, pdf binary")
