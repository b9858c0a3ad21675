"""Windows shared between documents: runs of windows with one minimiser, and their first copies.

Operators 3 and 7 both ask, for every window of fixed length over a document's symbols (bytes or
words), whether the same window starts earlier. A window's minimiser, the least hash among its
k-grams, depends on the window alone, so equal windows have equal minimisers. Consecutive windows
with one minimiser form a run. The steps:

1. ``run_rows``: one short row per run (minimiser, hash of the run's symbols, place). A run whose
   string was met before in the same block of texts is settled at once and dealt anywhere.
2. ``settle``: rows are dealt by minimiser once and stream past in order. A run whose whole
   string has an earlier copy is settled; of the rest only those stay open whose minimiser has
   different strings. Up to ``HOT`` rows are held, however many a minimiser has.
3. ``fetch_strings``: the strings of those runs, taken from the texts.
4. the operator compares the windows of strings that share a minimiser, its own way; minimisers
   with more than ``HOT`` strings are compared window by window with ``compare_hot`` instead, so no
   task ever holds an unbounded group.
5. ``spans_by_document``: what to remove, per document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelake.llm.common import materialize

#: Strings of one minimiser that a task compares at most; beyond it windows are dealt singly.
HOT = 2_000
#: Bytes of text worked on at once (a longer text is worked on alone).
CHUNK = 1 << 20
#: Bytes up to which words are hashed together.
LONG_WORD = 64
_LANE = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 5)
_BASE2 = np.uint64(0xD6E8FEB86659FD93)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Hashes of any stretch of a symbol array from one running sum, modulo 2**64."""

    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, symbols: np.ndarray, base: np.uint64 = _BASE):
        up, self._down = self._tables(len(symbols) + 1, base)
        self._sums = np.zeros(len(symbols) + 1, dtype=np.uint64)
        np.cumsum(symbols * up[: len(symbols)], out=self._sums[1:])

    @classmethod
    def _tables(cls, n: int, base: np.uint64) -> tuple[np.ndarray, np.ndarray]:
        have = cls._powers.get(int(base))
        if have is None or len(have[0]) < n:
            inverse = np.uint64(pow(int(base), -1, 1 << 64))
            have = tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n, CHUNK + 2), b, np.uint64)])) for b in (base, inverse))
            cls._powers[int(base)] = have
        return have

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self._sums[ends] - self._sums[starts]) * self._down[starts])

    def grams(self, k: int) -> np.ndarray:
        return mix((self._sums[k:] - self._sums[:-k]) * self._down[: len(self._sums) - k])


def byte_symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, ends per document): every byte is a symbol."""
    return _BYTE[data], offsets


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word starts, word ends, words before each document border) of concatenated texts."""
    space = np.ones(len(data) + 2, dtype=bool)
    space[1:-1] = _SPACE[data]
    cut = np.zeros(len(data) + 1, dtype=bool)  # a document border parts words as well
    cut[offsets] = True
    starts = np.flatnonzero(~space[1:-1] & (space[:-2] | cut[:-1]))
    ends = np.flatnonzero(~space[1:-1] & (space[2:] | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_symbols(data: np.ndarray, offsets: np.ndarray, base: np.uint64 = _BASE) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, borders = word_bounds(data, offsets)
    return word_hashes(data, starts, ends, base), borders


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: np.uint64) -> np.ndarray:
    """A hash of each word, eight bytes at a time; words beyond ``LONG_WORD`` bytes get a keyed digest.

    A chain of mixing steps, so that no pattern of letters cancels out, as it does in a polynomial
    modulo a power of two.
    """
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    lanes = np.ndarray((len(data) + 1,), "<u8", buffer=padded, strides=(1,))
    sizes = ends - starts
    codes = mix(sizes.astype(np.uint64) + seed)
    own = np.arange(len(sizes))
    for at in range(0, LONG_WORD, 8):
        if at:
            own = np.flatnonzero(sizes > at)
        if not len(own):
            break
        codes[own] = mix(codes[own] ^ (lanes[starts[own] + at] & _LANE[np.minimum(sizes[own] - at, 8)]))
    for k in np.flatnonzero(sizes > LONG_WORD).tolist():
        digest = hashlib.blake2b(data[starts[k] : ends[k]], digest_size=8, key=int(seed).to_bytes(8, "little")).digest()
        codes[k] = np.uint64(int.from_bytes(digest, "little"))
    return codes


def window_minimum(x: np.ndarray, w: int) -> np.ndarray:
    """Least of every w neighbours, by doubling."""
    have = 1
    while 2 * have <= w:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (w - have)], x[w - have :]) if have < w else x


@dataclass(frozen=True)
class Shape:
    """What a window is: ``window`` symbols ("bytes" or "words"), minimisers over ``gram`` symbols, runs of ``longest`` windows at most."""

    symbols: str
    window: int
    gram: int

    @property
    def longest(self) -> int:
        return self.window

    def of(self, data: np.ndarray, offsets: np.ndarray, base: np.uint64 = _BASE) -> tuple[np.ndarray, np.ndarray]:
        return byte_symbols(data, offsets) if self.symbols == "bytes" else word_symbols(data, offsets, base)


def runs_of(data: np.ndarray, offsets: np.ndarray, shape: Shape) -> tuple[np.ndarray, ...]:
    """(document, start, windows, minimiser, string hash) of every run; places count from the document's start."""
    symbols, borders = shape.of(data, offsets)
    none = tuple(np.zeros(0, np.int64) for _ in range(5))
    n, w = len(symbols), shape.window
    if n < w:
        return none
    rolling = Rolling(symbols)
    grams = rolling.grams(shape.gram)
    least = window_minimum(grams, w - shape.gram + 1)
    lengths = np.diff(borders)
    owner = np.repeat(np.arange(len(lengths)), lengths)[: n - w + 1]
    valid = np.arange(n - w + 1) + w <= borders[owner + 1]
    fresh = np.ones(len(least), dtype=bool)
    # A run ends as well where the first of several equal minimisers leaves, so no window comes twice in a run.
    fresh[1:] = (least[1:] != least[:-1]) | (grams[: len(least) - 1] == least[:-1]) | (owner[1:] != owner[:-1]) | ~valid[:-1]
    first = np.flatnonzero(fresh & valid)
    if not len(first):
        return none
    stop = np.flatnonzero(valid & np.append(fresh[1:] | ~valid[1:], True)) + 1
    number = stop - first
    if number.max() > shape.longest:  # long runs are cut at fixed distances from their start
        pieces = -(-number // shape.longest)
        which = np.repeat(np.arange(len(first)), pieces)
        nth = np.arange(len(which)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        first, stop = first[which] + nth * shape.longest, np.minimum(stop[which], first[which] + (nth + 1) * shape.longest)
        number = stop - first
    own = owner[first]
    code = rolling.of(first, stop + w - 1)
    if shape.symbols == "words":  # words are few against bytes: two independent polynomials, so that no pattern of words cancels out
        code = mix(code ^ mix(Rolling(shape.of(data, offsets, _BASE2)[0], _BASE2).of(first, stop + w - 1) + np.uint64(1)))
    return own, first - borders[own], number, least[first].view(np.int64), code.view(np.int64)


def text_chunks(batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of pieces of a batch; offsets start at 0."""
    texts = batch.column(column)
    raw = [b"" if t is None else t for t in texts.cast(pa.large_binary()).to_pylist()]
    at = 0
    while at < len(raw):
        upto, held = at, 0
        while upto < len(raw) and (upto == at or held + len(raw[upto]) <= CHUNK):
            held += len(raw[upto])
            upto += 1
        yield at, np.frombuffer(b"".join(raw[at:upto]), np.uint8), np.cumsum([0, *map(len, raw[at:upto])])
        at = upto


def with_row_key(docs: DataFrame) -> DataFrame:
    """doc_id, text (null as empty), doc (doc_id, or the least number) and row_key, a hash of both.

    Rows are told apart by doc and row_key together, so unlike documents under ids of their own are
    never taken for one, whatever their hashes.
    """
    ready = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return ready.withColumns({"row_key": F.xxhash64("doc_id", "text"), "doc": F.coalesce("doc_id", F.lit(-(2**63)))})


def later_than(doc, start, first_doc, first_start, same_document: bool):
    """Whether a place comes after the first copy; within one document only if that counts."""
    return (doc > first_doc) | ((doc == first_doc) & (start > first_start)) if same_document else doc > first_doc


RUN = "deal long, code long, doc long, row_key long, start int, number int, settled boolean"


def run_rows(keyed: DataFrame, shape: Shape, same_document: bool) -> DataFrame:
    """One row per run; ``deal`` is its minimiser, or anything for a run that is settled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, docs = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("row_key", "doc"))
            for at, data, offsets in text_chunks(batch):
                own, start, number, least, code = runs_of(data, offsets, shape)
                if not len(own):
                    continue
                doc, key = docs[at + own], keys[at + own]
                order = np.lexsort((start, doc, code, least))
                head = np.ones(len(order), dtype=bool)
                head[1:] = (code[order[1:]] != code[order[:-1]]) | (least[order[1:]] != least[order[:-1]])
                first = order[np.flatnonzero(head)][np.cumsum(head) - 1]
                settled = np.zeros(len(order), dtype=bool)
                settled[order] = later_than(doc[order], start[order], doc[first], start[first], same_document)
                deal = np.where(settled, mix((key + start).view(np.uint64)).view(np.int64), least)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (deal, code, doc, key, start.astype(np.int32), number.astype(np.int32), settled)], ["deal", "code", "doc", "row_key", "start", "number", "settled"])

    return keyed.select("row_key", "doc", "text").mapInArrow(run, RUN)


class Settler:
    """Streams over runs in order of (deal, code, doc, start); keeps at most ``hot`` open runs of one minimiser."""

    fields = "minimiser long, strings long, doc long, row_key long, start int, number int"

    def __init__(self, same_document: bool, hot: int):
        self._same, self._hot = same_document, hot
        self._deal = self._code = self._doc = self._start = None
        self._codes, self._held, self._rows = 0, [], 0

    def feed(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Settled runs (strings 0) and the open ones of finished minimisers."""
        deal, code, doc, key, start, number, settled = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(7))
        if settled.any():
            yield self._batch(deal[settled], 0, doc[settled], key[settled], start[settled], number[settled])
            left = ~settled
            deal, code, doc, key, start, number = (x[left] for x in (deal, code, doc, key, start, number))
        n = len(deal)
        if not n:
            return
        goes_on = self._deal is not None and self._deal == deal[0]
        new_deal, head = np.ones(n, dtype=bool), np.ones(n, dtype=bool)
        new_deal[1:] = deal[1:] != deal[:-1]
        new_deal[0] = not goes_on
        head[1:] = new_deal[1:] | (code[1:] != code[:-1])
        head[0] = not (goes_on and self._code == code[0])
        if not goes_on:
            yield from self._finish()
        nth = np.cumsum(head) - 1
        first_doc, first_start = doc[head], start[head]
        if not head[0]:
            nth, first_doc, first_start = nth + 1, np.concatenate([[self._doc], first_doc]), np.concatenate([[self._start], first_start])
        later = later_than(doc, start, first_doc[nth], first_start[nth], self._same)
        if later.any():
            yield self._batch(deal[later], 0, doc[later], key[later], start[later], number[later])
        group = np.cumsum(new_deal) - (0 if goes_on else 1)
        codes = np.bincount(group, weights=head, minlength=int(group[-1]) + 1).astype(np.int64)
        codes[0] += self._codes if goes_on else 0
        last = group[-1]
        whole = ~later & (group < last) & (codes[group] > 1)
        if goes_on and last > 0:  # the minimiser carried over ends in this batch
            own = ~later & (group == 0)
            self._hold(deal[own], doc[own], key[own], start[own], number[own])
            self._codes = int(codes[0])
            yield from self._finish()
            whole &= group > 0
        if whole.any():
            counts = np.bincount(group[whole], minlength=int(last) + 1)
            yield self._batch(deal[whole], np.where(counts[group[whole]] > self._hot, self._hot + 1, counts[group[whole]]), doc[whole], key[whole], start[whole], number[whole])
        tail = ~later & (group == last)
        self._hold(deal[tail], doc[tail], key[tail], start[tail], number[tail])
        self._codes = int(codes[last])
        self._deal, self._code, self._doc, self._start = deal[-1], code[-1], first_doc[-1], first_start[-1]
        if self._rows > self._hot and self._codes > 1:
            yield from self._flush(self._hot + 1)
            self._rows = self._hot + 1  # whatever follows of this minimiser is hot as well

    def end(self) -> Iterator[pa.RecordBatch]:
        yield from self._finish()

    def _hold(self, *columns: np.ndarray) -> None:
        if len(columns[0]):
            self._held.append(columns)
            self._rows += len(columns[0])

    def _flush(self, strings: int) -> Iterator[pa.RecordBatch]:
        if self._held:
            deal, doc, key, start, number = (np.concatenate(c) for c in zip(*self._held, strict=True))
            yield self._batch(deal, strings, doc, key, start, number)
        self._held = []

    def _finish(self) -> Iterator[pa.RecordBatch]:
        if self._codes > 1:
            yield from self._flush(min(self._rows, self._hot + 1))
        self._codes, self._held, self._rows = 0, [], 0

    @staticmethod
    def _batch(deal: np.ndarray, strings, doc: np.ndarray, key: np.ndarray, start: np.ndarray, number: np.ndarray) -> pa.RecordBatch:
        count = np.broadcast_to(np.asarray(strings, dtype=np.int64), deal.shape)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (deal, count, doc, key, start, number)], ["minimiser", "strings", "doc", "row_key", "start", "number"])


def settle(runs: DataFrame, same_document: bool) -> DataFrame:
    """Settled runs (strings 0: an earlier copy exists) and open ones with the number of their minimiser's open runs."""
    hot = HOT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settler = Settler(same_document, hot)
        for batch in batches:
            yield from settler.feed(batch)
        yield from settler.end()

    return runs.repartition("deal").sortWithinPartitions("deal", "code", "doc", "start").mapInArrow(run, Settler.fields)


def fetch_strings(keyed: DataFrame, open_runs: DataFrame, shape: Shape) -> DataFrame:
    """minimiser, strings, doc, row_key, start and the packed string of every open run."""
    wanted = open_runs.distinct().groupBy("doc", "row_key").agg(F.collect_list(F.struct("minimiser", "start", "number", "strings")).alias("wanted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, keys, docs = batch.column("wanted"), batch.column("row_key").to_numpy(zero_copy_only=False), batch.column("doc").to_numpy(zero_copy_only=False)
            flat = lists.flatten()
            fields = {c: flat.field(c).to_numpy(zero_copy_only=False) for c in ("minimiser", "start", "number", "strings")}
            ends = np.cumsum([0, *(len(x) for x in lists)])
            for at, data, offsets in text_chunks(batch):
                rows = len(offsets) - 1
                pick = slice(int(ends[at]), int(ends[at + rows]))
                own = np.repeat(np.arange(rows), np.diff(ends[at : at + rows + 1]))
                start, number = fields["start"][pick], fields["number"][pick]
                text = data.tobytes()
                if shape.symbols == "bytes":
                    lo = offsets[own] + start
                    hi = lo + number + shape.window - 1
                else:
                    starts, stops, borders = word_bounds(data, offsets)
                    lo, hi = starts[borders[own] + start], stops[borders[own] + start + number + shape.window - 2]
                strings = [text[a:b] for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(fields["minimiser"][pick]), pa.array(fields["strings"][pick]), pa.array(docs[at + own]), pa.array(keys[at + own]), pa.array(start), pa.array(strings, pa.binary())],
                    ["minimiser", "strings", "doc", "row_key", "start", "packed"],
                )

    joined = keyed.select("row_key", "doc", "text").join(wanted, ["doc", "row_key"])
    return joined.select("row_key", "doc", "text", "wanted").mapInArrow(run, "minimiser long, strings long, doc long, row_key long, start int, packed binary")


def window_rows(strings: DataFrame, shape: Shape) -> DataFrame:
    """Every window of the strings by itself, as a hash of 128 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, keys, begin = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "row_key", "start"))
            for at, data, offsets in text_chunks(batch, "packed"):
                own, nth, one, two = string_windows(data, offsets, shape)
                yield pa.RecordBatch.from_arrays([pa.array(a) for a in (one, two, docs[at + own], keys[at + own], (begin[at + own] + nth).astype(np.int32))], ["one", "two", "doc", "row_key", "start"])

    return strings.select("doc", "row_key", "start", "packed").mapInArrow(run, "one long, two long, doc long, row_key long, start int")


def string_windows(data: np.ndarray, offsets: np.ndarray, shape: Shape) -> tuple[np.ndarray, ...]:
    """(string, window number, hash, second hash) of every window of concatenated strings."""
    codes = []
    for base in (_BASE, _BASE2):
        symbols, borders = shape.of(data, offsets, base)
        starts = np.concatenate([np.arange(a, b - shape.window + 1) for a, b in zip(borders[:-1], borders[1:], strict=True)] or [np.zeros(0, np.int64)]).astype(np.int64)
        codes.append(Rolling(symbols, base).of(starts, starts + shape.window).view(np.int64))
    own = np.searchsorted(borders, starts, "right") - 1
    return own, starts - borders[own], codes[0], codes[1]


def compare_hot(strings: DataFrame, shape: Shape, same_document: bool) -> DataFrame:
    """spans of windows with an earlier copy, by a plain aggregation that no hot group can stall."""
    singles = materialize(window_rows(strings, shape), "hot-windows")
    first = singles.groupBy("one", "two").agg(F.min(F.struct("doc", "start")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    later = F.struct("doc", "start") > F.col("first") if same_document else F.col("doc") > F.col("first.doc")
    return singles.join(first, ["one", "two"]).where(later).select("doc", "row_key", "start", (F.col("start") + shape.window).alias("stop"))


def whole_groups(batches: Iterator[pa.RecordBatch], most_rows: int, most_bytes: int = 64 << 20) -> Iterator[pa.Table]:
    """Regroups batches sorted by minimiser into tables that hold every minimiser's rows whole.

    Tables have about ``most_rows`` or ``most_bytes``, as far as whole minimisers allow.
    """
    held: list[pa.RecordBatch] = []
    rows = size = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        size += batch.nbytes
        if rows < most_rows and size < most_bytes:
            continue
        table = pa.Table.from_batches(held)
        codes = table.column("minimiser").to_numpy()
        cut = int(np.searchsorted(codes, codes[-1]))
        if cut:
            yield table.slice(0, cut)
            held, rows = table.slice(cut).to_batches(), table.num_rows - cut
            size = sum(b.nbytes for b in held)
    if held:
        yield pa.Table.from_batches(held)


def marked_spans(docs: np.ndarray, keys: np.ndarray, starts: np.ndarray, window: int) -> pa.RecordBatch:
    """Joins marked windows that follow each other in one document."""
    order = np.lexsort((starts, keys, docs))
    docs, keys, starts = docs[order], keys[order], starts[order]
    fresh = np.ones(len(keys), dtype=bool)
    fresh[1:] = (docs[1:] != docs[:-1]) | (keys[1:] != keys[:-1]) | (starts[1:] > starts[:-1] + window)
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(keys))[: len(first)] - 1
    return pa.RecordBatch.from_arrays([pa.array(docs[first]), pa.array(keys[first]), pa.array(starts[first].astype(np.int32)), pa.array((starts[last] + window).astype(np.int32))], ["doc", "row_key", "start", "stop"])


def removal_spans(docs: DataFrame, shape: Shape, same_document: bool, compare: Callable[[pa.Table, Shape], pa.RecordBatch], together: int) -> tuple[DataFrame, DataFrame]:
    """(keyed documents, spans doc/row_key/start/stop in symbols to remove).

    ``together`` is about the number of strings that one call of ``compare`` gets.
    """
    keyed = with_row_key(docs)
    settled = materialize(settle(run_rows(keyed, shape, same_document), same_document), "settled-runs", free=True)
    spans = settled.where("strings = 0").select("doc", "row_key", "start", (F.col("start") + F.col("number") + (shape.window - 1)).alias("stop"))
    strings = materialize(fetch_strings(keyed, settled.where("strings > 0"), shape), "strings-open", free=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, together):
            yield compare(table, shape)

    usual = strings.where(F.col("strings") <= HOT).repartition("minimiser").sortWithinPartitions("minimiser").mapInArrow(run, "doc long, row_key long, start int, stop int")
    return keyed, materialize(spans.unionByName(usual).unionByName(compare_hot(strings.where(F.col("strings") > HOT), shape, same_document)), "spans")


def spans_by_document(keyed: DataFrame, spans: DataFrame) -> DataFrame:
    """keyed documents with the sorted list of their spans (null where nothing goes)."""
    lists = spans.groupBy("doc", "row_key").agg(F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("spans"))
    return keyed.join(lists, ["doc", "row_key"], "left")


def union_of(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal runs covered by sorted spans."""
    out: list[tuple[int, int]] = []
    for s in spans or ():
        if out and s["start"] <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], s["stop"]))
        else:
            out.append((s["start"], s["stop"]))
    return out
