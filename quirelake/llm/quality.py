"""Quality rules: base counts and compression bands (operator 8).

A text's zstandard ratio (compressed size over size, level 3) is held against limits for its
length, and the ratio of every fixed chunk and of as many last bytes against one band of its own. Below a lower limit a
text repeats itself or is padded with a small alphabet; above an upper one it is noise. The
limits are points on a line over the logarithm of the length.

Cases: a null or empty text has no words and fails the base rules with all counts 0; equal ids
and repeated rows are judged one by one; a text of any length is judged whole, in one pass of
memory proportional to it; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quirelake.llm.common import id_and_text

SYMBOLS = b"#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class Bands:
    """(bytes, lowest, highest) ratios of whole texts, and those of a chunk."""

    whole: tuple[tuple[int, float, float], ...] = (
        (64, 0.78, 1.25), (128, 0.70, 1.02), (256, 0.60, 0.88), (512, 0.515, 0.78), (1024, 0.475, 0.68), (2048, 0.452, 0.60),
        (4096, 0.430, 0.55), (8192, 0.416, 0.51), (16384, 0.404, 0.48), (32768, 0.391, 0.46), (65536, 0.383, 0.45),
    )
    chunk_bytes: int = 2048
    chunk: tuple[float, float] = (0.445, 0.66)
    level: int = field(default=3)

    def limits(self, size: int) -> tuple[float, float]:
        at, low, high = (np.array(c, dtype=float) for c in zip(*self.whole, strict=True))
        x = np.log2(max(size, 1))
        return float(np.interp(x, np.log2(at), low)), float(np.interp(x, np.log2(at), high))


def repeated_words(words: list[bytes], window: int = 8) -> int:
    """Words inside windows that occur twice or more in the text, the first occurrence included."""
    n = len(words)
    if n <= window:
        return 0
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], dtype=np.uint64)
    code = np.zeros(n - window + 1, dtype=np.uint64)
    for k in range(window):  # words are dense numbers here, so windows mix as 64-bit polynomials
        code = (code ^ (code >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + ids[k : n - window + 1 + k] + np.uint64(1)
    order = np.argsort(code)
    same = code[order[1:]] == code[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(len(code), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edges = np.zeros(n + 1, dtype=np.int64)
    starts = np.flatnonzero(twice)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + window, -1)
    return int((np.cumsum(edges)[:n] > 0).sum())


def base_counts(text: str, data: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = data.split()  # exactly the white space of \x20\x09-\x0D
    if not words:
        return 0, 0, len(data) - len(data.translate(None, SYMBOLS)), 0, 0
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    return (
        len(words),
        len(text) - sum(map(text.count, SPACES)),
        len(data) - len(data.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


class Compressor:
    def __init__(self, bands: Bands):
        import zstandard

        self._pack, self._bands = zstandard.ZstdCompressor(level=bands.level).compress, bands

    def verdict(self, data: bytes) -> tuple[float, float, float, bool]:
        """Ratio of the whole, lowest and highest of its chunks, and whether all lie in their bands.

        The last chunk ends with the text, so every byte of a text of at least a chunk is in one.
        """
        if not data:
            return 0.0, 0.0, 0.0, False
        size = self._bands.chunk_bytes
        whole = len(self._pack(data)) / len(data)
        low, high = self._bands.limits(len(data))
        kept = low <= whole <= high
        if len(data) < size:
            return whole, whole, whole, kept
        starts = list(range(0, len(data) - size + 1, size))
        if len(data) % size:
            starts.append(len(data) - size)
        chunks = [len(self._pack(data[k : k + size])) / size for k in starts]
        return whole, min(chunks), max(chunks), kept and self._bands.chunk[0] <= min(chunks) and max(chunks) <= self._bands.chunk[1]


FIELDS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, lowest_chunk double, highest_chunk double"


def quality_rules(docs: DataFrame, bands: Bands = Bands(), least_words: int = 20, most_repeated: int = 30) -> DataFrame:
    """One row per document: base counts, base_failed, kept, and the ratios behind the verdict."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        verdict, names = Compressor(bands).verdict, [f.split()[0] for f in FIELDS.split(", ")]
        types = [pa.int64()] * 6 + [pa.bool_()] * 2 + [pa.float64()] * 3
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                data = text.encode()
                n, chars, symbols, dup, repeated = base_counts(text, data)
                failed = n < least_words or 100 * repeated > most_repeated * n
                whole, low, high, inside = verdict(data)
                rows.append((doc_id, n, chars, symbols, dup, repeated, failed, inside and not failed, whole, low, high))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return id_and_text(docs).mapInArrow(run, FIELDS)


def op8_compression_bands(spark, sf_dir: str) -> DataFrame:
    """Base rules and compression bands over every whole document."""
    from quirelake.llm.common import documents

    return quality_rules(documents(spark, sf_dir))
