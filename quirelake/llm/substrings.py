"""Removal of repeated byte strings by a column-wise suffix order of collections (operator 3).

Strings that share a minimiser form a collection. Its Burrows-Wheeler transform is built by
columns: round j inserts, for every string at once, the suffix of length j, that is one more
symbol per string. A suffix is its first symbol before the suffix one shorter, so its row follows
from that pair alone; pairs of all rows, in order, are the transform read backwards. In the final
order suffixes with a common prefix of the window's length are neighbours; all but the earliest
of such an interval are repeats.

The collections are bounded (see runs: whole copies are settled before, minimisers with very many
strings are compared window by window), so a collection's columns stay in memory and the external
files are Spark's sorted shuffle files, read once in order.

Cases: a null or empty text, and one shorter than a window, loses nothing; of equal ids the one
that starts at the smaller place is earlier, at equal places neither; repeated rows get equal
results; a null id counts as the least; very long texts are worked on alone; an empty table gives
an empty result; other columns are not read. What remains may cut a character, so it is binary.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelake.llm import runs

WINDOW = 100
GRAM = 24
#: Strings of one collection, as far as whole minimisers allow.
TOGETHER = 1_500


def suffix_order(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, suffix length, transform) in the order of all suffixes of the strings.

    The transform's entry is 1 + the symbol before the suffix, 0 at a string's start. Empty
    suffixes come first, in the order of the strings.
    """
    lengths = np.diff(offsets)
    many, longest = len(lengths), int(lengths.max(initial=0))
    # Narrow numbers where they fit: the rounds are bound by memory traffic.
    pair, shift = (np.uint32, 23) if len(data) + many < 1 << 23 else (np.uint64, 40)
    bits = longest.bit_length()
    name = np.uint32 if many << bits < 1 << 32 else np.uint64
    shift, bits, low = pair(shift), name(bits), pair((1 << shift) - 1)
    pairs = np.arange(many, dtype=pair)  # first symbol and row of the rest; empty suffixes by string
    names = np.arange(many, dtype=name) << bits  # string and suffix length
    row = np.arange(many, dtype=pair)  # of the longest suffix that each string has so far
    by_length = np.argsort(-lengths, kind="stable")
    active_in = np.searchsorted(-lengths[by_length], -np.arange(1, longest + 1), "right")
    for j, count in enumerate(active_in.tolist(), 1):
        active = by_length[:count]
        fresh = ((data[offsets[active + 1] - j].astype(pair) + pair(1)) << shift) | row[active]
        order = np.argsort(fresh)
        active, fresh = active[order], fresh[order]
        at = np.searchsorted(pairs, fresh)
        grown_by = np.zeros(len(pairs) + 1, dtype=pair)
        np.add.at(grown_by, at, pair(1))
        moved = np.cumsum(grown_by[:-1], dtype=pair)
        fresh += moved[fresh & low]
        new = at + np.arange(len(at))
        pairs[many:] += moved[pairs[many:] & low]  # the first rows are empty suffixes, which have no rest
        old = np.ones(len(pairs) + len(at), dtype=bool)
        old[new] = False
        grown, named = np.empty(len(old), dtype=pair), np.empty(len(old), dtype=name)
        grown[old], named[old] = pairs, names
        grown[new] = fresh
        named[new] = (active.astype(name) << bits) | name(j)
        pairs, names = grown, named
        row[active] = new
    transform = np.zeros(len(pairs), dtype=np.int16)
    transform[pairs[many:] & low] = pairs[many:] >> shift
    return (names >> bits).astype(np.int64), (names & name((1 << int(bits)) - 1)).astype(np.int64), transform


def equal_neighbours(data: np.ndarray, starts: np.ndarray, width: int, block: int = 20_000) -> np.ndarray:
    """Whether each stretch of ``width`` symbols equals the one before it in the list."""
    same = np.zeros(len(starts), dtype=bool)
    span = np.arange(width)
    for k in range(1, len(starts), block):
        upto = min(k + block, len(starts))
        same[k:upto] = (data[starts[k:upto, None] + span] == data[starts[k - 1 : upto - 1, None] + span]).all(axis=1)
    return same


def order_windows(table: pa.Table, shape: runs.Shape) -> pa.RecordBatch:
    """Spans of windows that start earlier as well, among strings of whole minimisers."""
    packed = table.column("packed").to_pylist()
    data, offsets = np.frombuffer(b"".join(packed), np.uint8), np.cumsum([0, *map(len, packed)])
    string, length, _ = suffix_order(data, offsets)
    long = length >= shape.window
    string, length = string[long], length[long]
    starts = offsets[string + 1] - length
    same = equal_neighbours(data, starts, shape.window)
    interval = np.cumsum(~same) - 1
    docs, keys, begin = (table.column(c).to_numpy() for c in ("doc", "row_key", "start"))
    place, doc = begin[string] + starts - offsets[string], docs[string]
    order = np.lexsort((place, doc, interval))
    head = np.ones(len(order), dtype=bool)
    head[1:] = interval[order[1:]] != interval[order[:-1]]
    first = order[np.flatnonzero(head)][np.cumsum(head) - 1] if len(order) else order
    marked = order[(doc[order] > doc[first]) | (place[order] > place[first])]
    return runs.marked_spans(doc[marked], keys[string[marked]], place[marked], shape.window)


def remove_repeated_strings(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, kept (bytes), n_bytes, n_removed, spans (start, stop in bytes): one row per document."""
    keyed, spans = runs.removal_spans(docs, runs.Shape("bytes", window, gram), True, order_windows, TOGETHER)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                data, gone = text.encode(), runs.union_of(spans)
                edges = [0, *(x for s in gone for x in s), len(data)]
                kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                rows.append((kept, len(data), len(data) - len(kept), [{"start": a, "stop": b} for a, b in gone]))
            if rows:
                kept, sizes, removed, lists = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(kept, pa.binary()), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(lists, kind)], ["doc_id", "kept", "n_bytes", "n_removed", "spans"])

    joined = runs.spans_by_document(keyed, spans).select("doc_id", "text", "spans")
    return joined.mapInArrow(run, "doc_id long, kept binary, n_bytes long, n_removed long, spans array<struct<start:int,stop:int>>")


def op3_column_wise_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """All documents without bytes covered by strings of 100 bytes that start earlier."""
    from quirelake.llm.common import documents

    kept = remove_repeated_strings(documents(spark, sf_dir))
    return kept.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
