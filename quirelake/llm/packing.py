"""Bulk-synchronous best-fit packing of token sequences (operator 4).

Pieces longer than half a sequence open one each; what they leave is a gap. The others follow in
bands of length, longest first. A superstep of a band:

1. gaps offer slots: one where a single piece fits, several of equal size where more do;
2. pieces and slots are range-sorted by size together;
3. every range is swept from small to large: a slot takes the largest waiting piece, so that the
   slot is that piece's successor or the next one free (a stack matches the two);
4. pieces that no slot of their range took meet the slots that found no piece in ranges beyond.
   Which of them meet is settled by rank, from two counts per range; a join brings them together;
5. gaps shrink by what they took, and what is left of the band goes on to the next superstep.

Where slots no longer take a twentieth of a band, it opens as many sequences as hold the rest and
goes on. Bands and supersteps are few (a band ends after a handful), whatever the number of
pieces; only counts per range reach the driver.

Cases: a null or empty text is one piece with the end id alone; equal ids and repeated rows are
packed one by one; a text of any length is cut into pieces of the capacity with a shorter first
one; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirelake.llm.common import id_and_text, materialize
from quirelake.llm.tokens import encoder

CAPACITY = 1024
END_ID = 2
#: Lengths of a band differ by the first factor at most, those of up to an eighth of the capacity by the second.
BANDS = 2, 8
#: Sequences that bands open are numbered from here on; those that one long piece opens have its number.
OPENED = 1 << 62

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, piece_no long"
SWEPT = "kind int, piece_no long, sequence_id long, length int, part int, rank long"
#: Kinds of a sweep's rows.
MATCHED, WAITING, FREE = 0, 1, 2


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; only the first may be shorter than the capacity."""
    first = (n - 1) % capacity + 1
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def piece_rows(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece, numbered over all partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer, keeps_space=True).encode, np.array([end_id], dtype="<u4")
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            rows = []
            for doc_id, own in zip(ids, encode(texts), strict=True):
                packed = np.concatenate([own, end])
                for k, (start, length) in enumerate(cut(len(packed), capacity)):
                    rows.append((doc_id, k, start, length, zlib.crc32(packed[start : start + length]), number))
                    number += 1
            if rows:
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "piece_no"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return id_and_text(docs).mapInArrow(run, PIECES)


def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Matches the pieces (``slot`` false) and slots of one range, which come in ascending size, pieces first."""
    part, waiting, free = TaskContext.get().partitionId(), [], 0
    names = [f.split()[0] for f in SWEPT.split(", ")]

    def rows(kind: int, pieces: list, sequences: list, lengths: list, ranks: list) -> pa.RecordBatch:
        n = len(ranks)
        columns = ([kind] * n, pieces, sequences, lengths, [part] * n, ranks)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()), strict=True)], names)

    for batch in batches:
        matched, unused = [], []
        for size, slot, number in zip(*(batch.column(c).to_pylist() for c in ("size", "slot", "number")), strict=True):
            if not slot:
                waiting.append((number, size))
            elif waiting:
                piece, length = waiting.pop()
                matched.append((piece, number, length))
            else:
                unused.append(number)
        if matched:
            pieces, sequences, lengths = (list(c) for c in zip(*matched, strict=True))
            yield rows(MATCHED, pieces, sequences, lengths, [0] * len(pieces))
        if unused:
            yield rows(FREE, [None] * len(unused), unused, [0] * len(unused), list(range(free, free + len(unused))))
            free += len(unused)
    for k in range(0, len(waiting), 10_000):
        some = waiting[k : k + 10_000]
        yield rows(WAITING, [w[0] for w in some], [None] * len(some), [w[1] for w in some], list(range(k, k + len(some))))


def across_ranges(waiting: dict[int, int], free: dict[int, int]) -> list[tuple[int, int, int, int, int]]:
    """(range of pieces, first rank, range of slots, first rank, number): what meets beyond its own range.

    A range's waiting pieces are ranked from small to large and its free slots, all smaller than
    those pieces, in the order of the sweep; the nearest range's largest pieces go first.
    """
    plan, stack = [], []
    for part in sorted({*waiting, *free}):
        rank, left = 0, free.get(part, 0)
        while left and stack:
            other, number = stack.pop()
            take = min(left, number)
            plan.append((other, number - take, part, rank, take))
            if take < number:
                stack.append((other, number - take))
            rank, left = rank + take, left - take
        if waiting.get(part):
            stack.append((part, waiting[part]))
    return plan


def superstep(left: DataFrame, gaps: DataFrame, least: int, longest: int, many: int) -> tuple[DataFrame, DataFrame, dict]:
    """(placed piece_no/sequence_id/length, pieces still left, totals) after one sweep over all slots.

    Rooms up to ``least`` take no piece; ``longest`` is the greatest length left and ``many`` the
    most slots that a gap offers.
    """
    spark = left.sparkSession
    slots = F.least(F.greatest(F.floor(F.col("room") / longest), F.lit(1)), F.lit(many)).cast("int")
    offered = gaps.where(F.col("room") > least).withColumn("slots", slots).select(F.floor(F.col("room") / F.col("slots")).cast("int").alias("size"), F.lit(True).alias("slot"), F.col("sequence_id").alias("number"), F.explode(F.sequence(F.lit(1), "slots")).alias("nth"))
    together = left.select(F.col("length").cast("int").alias("size"), F.lit(False).alias("slot"), F.col("piece_no").alias("number"), F.lit(0).alias("nth")).unionByName(offered)
    ranges = together.repartitionByRange("size", "slot", "number", "nth").sortWithinPartitions("size", "slot", "number", "nth")
    swept = materialize(ranges.select("size", "slot", "number").mapInArrow(sweep, SWEPT), "swept")
    counts = swept.groupBy("part", "kind").agg(F.count(F.lit(1)).alias("n"), F.max("length").alias("longest")).collect()  # three rows for each range
    by_kind = {kind: {r["part"]: r["n"] for r in counts if r["kind"] == kind} for kind in (MATCHED, WAITING, FREE)}
    totals = {"placed": sum(by_kind[MATCHED].values()), "left": sum(by_kind[WAITING].values()), "longest": max([0, *(r["longest"] for r in counts if r["kind"] == WAITING)])}
    placed, waiting = swept.where(F.col("kind") == MATCHED).select("piece_no", "sequence_id", "length"), swept.where(F.col("kind") == WAITING)
    plan = across_ranges(by_kind[WAITING], by_kind[FREE])
    if plan:
        # At most as many rows as there are ranges, twice.
        meets, at, upto = [], 0, []
        for pieces, first, slot_range, slot_first, n in plan:
            meets += [(WAITING, pieces, first, first + n, at - first), (FREE, slot_range, slot_first, slot_first + n, at - slot_first)]
            at += n
        steps = F.broadcast(spark.createDataFrame(meets, "kind int, part int, lo long, hi long, shift long"))
        keyed = swept.where(F.col("kind") != MATCHED).join(steps, ["kind", "part"]).where((F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))).withColumn("pair", F.col("rank") + F.col("shift"))
        more = keyed.groupBy("pair").agg(F.max("piece_no").alias("piece_no"), F.max("sequence_id").alias("sequence_id"), F.max("length").alias("length"))
        more = materialize(more.select("piece_no", "sequence_id", "length"), "met")
        placed = placed.unionByName(more)
        waiting = materialize(waiting.join(more.select("piece_no"), "piece_no", "left_anti"), "waiting")
        totals["placed"], totals["left"] = totals["placed"] + at, totals["left"] - at
    return placed, waiting.select("piece_no", "length"), totals


def best_fit(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """piece_no, sequence_id, step of all pieces (piece_no, length) up to half the capacity; longer ones open sequences of their own number."""
    spark = pieces.sparkSession
    small = pieces.where(F.col("length") * 2 <= capacity).select("piece_no", F.col("length").cast("int").alias("length"))
    gaps = pieces.where((F.col("length") * 2 > capacity) & (F.col("length") < capacity)).select(F.col("piece_no").alias("sequence_id"), (F.lit(capacity) - F.col("length")).cast("long").alias("room"))
    tables, opened, most = [], OPENED, capacity // 2
    while most:
        least = most // BANDS[most * 8 <= capacity]
        left = small.where((F.col("length") > least) & (F.col("length") <= most))
        found = left.agg(F.count(F.lit(1)).alias("left"), F.max("length").alias("longest")).first().asDict()
        while found["left"]:
            usable = gaps.where(F.col("room") > least).count()
            if usable:
                before = found["left"]
                placed, left, found = superstep(left, gaps, least, found["longest"], -(-4 * before // usable))
                tables.append(placed.withColumn("step", F.lit(len(tables))))
                taken = placed.select("sequence_id", (-F.col("length")).cast("long").alias("room"))
                gaps = materialize(gaps.unionByName(taken).groupBy("sequence_id").agg(F.sum("room").alias("room")).where("room > 0"), "gaps")
                if not found["left"] or found["placed"] * 20 >= before:
                    continue
            need = -(-found["left"] // (capacity // found["longest"]))
            gaps = gaps.unionByName(spark.range(opened, opened + need).select(F.col("id").alias("sequence_id"), F.lit(capacity).cast("long").alias("room")))
            opened += need
        most = least
    none = spark.createDataFrame([], "piece_no long, sequence_id long, step int")
    for table in tables:
        none = none.unionByName(table.select("piece_no", "sequence_id", "step"))
    return none


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece."""
    pieces = materialize(piece_rows(docs, tokenizer, capacity, end_id), "pieces")
    placed = best_fit(pieces.select("piece_no", "length"), capacity)
    # At most ``capacity`` pieces lie in a sequence.
    before = Window.partitionBy("sequence_id").orderBy("step", "piece_no").rowsBetween(Window.unboundedPreceding, -1)
    joined = pieces.join(placed.hint("merge"), "piece_no", "left").withColumns({"sequence_id": F.coalesce("sequence_id", "piece_no"), "step": F.coalesce("step", F.lit(-1))})
    return joined.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0).cast("long"))).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op4_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 1024 ids of the byte-level vocabulary."""
    import public_tokenizers

    from quirelake.llm.common import documents

    return pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
