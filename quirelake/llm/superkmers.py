"""Removal of repeated word windows by super-k-mer partitioning (operator 7).

Consecutive windows that share a minimiser travel as one packed string to the bucket of that
minimiser, where sorting brings equal windows together and counts them. Strings that have an
earlier copy as a whole, and minimisers that only one string has, are settled before (see runs).

Cases: a null or empty text, and one of fewer words than a window, loses nothing; equal ids are
told apart by their texts and none is earlier than the other; repeated rows get equal results; a
null id counts as the least; very long texts are worked on alone; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelake.llm import runs

WINDOW = 50
GRAM = 6
#: Strings sorted together in a bucket.
TOGETHER = 8_000


def sort_windows(table: pa.Table, shape: runs.Shape) -> pa.RecordBatch:
    """Spans of windows that a smaller document has as well, among strings of whole minimisers."""
    packed = table.column("packed").to_pylist()
    data, offsets = np.frombuffer(b"".join(packed), np.uint8), np.cumsum([0, *map(len, packed)])
    own, nth, one, two = runs.string_windows(data, offsets, shape)
    docs, keys, begin = (table.column(c).to_numpy() for c in ("doc", "row_key", "start"))
    doc = docs[own]
    order = np.lexsort((doc, two, one))
    fresh = np.ones(len(order), dtype=bool)
    fresh[1:] = (one[order[1:]] != one[order[:-1]]) | (two[order[1:]] != two[order[:-1]])
    least = doc[order][np.flatnonzero(fresh)][np.cumsum(fresh) - 1] if len(order) else doc
    marked = order[doc[order] > least]
    return runs.marked_spans(doc[marked], keys[own[marked]], begin[own[marked]] + nth[marked], shape.window)


def remove_repeated_windows(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, text (kept words joined by one space), n_words, n_removed: one row per document."""
    keyed, spans = runs.removal_spans(docs, runs.Shape("words", window, gram), False, sort_windows, TOGETHER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts, removed = [], [], []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                words, gone = text.encode().split(), 0
                counts.append(len(words))
                for a, b in reversed(runs.union_of(spans)):
                    gone += b - a
                    del words[a:b]
                removed.append(gone)
                texts.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(removed, pa.int64())], ["doc_id", "text", "n_words", "n_removed"])

    joined = runs.spans_by_document(keyed, spans).select("doc_id", "text", "spans")
    return joined.mapInArrow(run, "doc_id long, text string, n_words long, n_removed long")


def op7_super_kmer_dedup(spark, sf_dir: str) -> DataFrame:
    """All documents without windows of 50 words that a smaller document has."""
    from quirelake.llm.common import documents

    kept = remove_repeated_windows(documents(spark, sf_dir))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
