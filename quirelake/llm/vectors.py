"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables (operator 13).

1. Vectors that are equal, under one label, are one class from here on; its size counts.
2. Rotations are learned on a sample: the principal components of unit vectors are turned until
   their signs lose least (iterative quantisation), which gives balanced binary codes. Further
   rotations give further bits.
3. The code is cut into substrings, one per table. Classes of one label that agree in a whole
   substring meet in a bucket of its table. Substrings are as long as the logarithm of the largest
   label, so buckets stay short; tables are added until simulated neighbours at the threshold meet
   with a probability of ``TARGET``.
4. In a bucket, pairs further apart in Hamming distance than any simulated neighbours go, and so do
   those that met in an earlier table. Only classes that still have a partner fetch their vectors,
   and the exact cosine decides.
5. Tasks return counts of links and the links of a spanning forest, never all pairs.

A bucket of more than ``BLOCK`` classes is cut into blocks that meet two at a time, so a task's
memory has a bound; no pair is left out, and the number of such tasks grows with the square of the
bucket's blocks. Where no number of tables would do (vectors of a few components), substrings get
shorter, down to none, when all classes of a label meet.

Cases: null labels and vectors that are null, empty, zero or hold a null or non-finite component
link with nothing; vectors of different lengths never link; equal ids are separate rows; a null id
counts as the least and comes out null; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.llm import runs
from quirelake.llm.common import materialize
from quirelake.llm.components import components

#: Vectors (and bytes of them) that the rotations are learned on: those with the smallest hashes.
SAMPLE, SAMPLE_BYTES = 20_000, 64 << 20
#: Share of simulated neighbours at the threshold that some table must bring together; how many there are at least.
TARGET, SIMULATED = 0.9998, 10_000
#: Principal components that a rotation turns, rounds of its training, and most tables.
WIDEST, ROUNDS, MOST_TABLES = 64, 30, 128
#: Classes of a block, and pairs compared at once.
BLOCK, PAIRS = 1_000, 1 << 17
#: Hot buckets up to which they are broadcast (16 bytes each); beyond it they are joined.
MOST_HOT = 100_000
_NONE = -(2**63)


def unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt(np.einsum("ij,ij->i", scaled, scaled))[:, None]


def learned_rotation(turned: np.ndarray, random: np.random.Generator, rounds: int) -> np.ndarray:
    """The rotation that brings ``turned`` (centred, on principal axes) closest to its signs."""
    rotation = np.linalg.qr(random.normal(size=(turned.shape[1],) * 2))[0]
    for _ in range(rounds):
        signs = np.where(turned @ rotation >= 0, 1.0, -1.0)
        left, _, right = np.linalg.svd(turned.T @ signs)
        rotation = left @ right
    return rotation


@dataclass
class Codes:
    """Projection of unit vectors to bits, dealt into ``tables`` substrings of ``size`` bits."""

    projection: np.ndarray
    shift: np.ndarray
    size: int
    tables: int
    radius: int

    def of(self, units: np.ndarray) -> np.ndarray:
        """Substrings (one number each) of vectors that may be shorter than the projection's."""
        if not self.size:
            return np.zeros((len(units), 1), np.uint32)
        bits = units @ self.projection[: units.shape[1]] >= self.shift
        return bits.reshape(len(units), self.tables, self.size) @ (np.uint32(1) << np.arange(self.size, dtype=np.uint32))


def neighbours(units: np.ndarray, least: float, random: np.random.Generator) -> np.ndarray:
    """A unit vector at cosine ``least`` from each: every other one in the direction of some other vector."""
    aside = random.normal(size=units.shape)
    aside[::2] = units[random.permutation(len(units))][::2] + 1e-3 * aside[::2]
    aside -= np.einsum("ij,ij->i", aside, units)[:, None] * units
    aside /= np.maximum(np.sqrt(np.einsum("ij,ij->i", aside, aside)), 1e-300)[:, None]
    return least * units + math.sqrt(1 - least * least) * aside


def learned_codes(units: np.ndarray, wanted: int, least: float, seed: int = 13) -> Codes:
    """Codes fitted to ``units``, with substrings of ``wanted`` bits or fewer."""
    random = np.random.default_rng(seed)
    mean = units.mean(axis=0)
    spread, axes = np.linalg.eigh(np.cov(units.T, bias=True).reshape(units.shape[1], -1))
    axes = axes[:, spread > max(spread.max(), 0) * 1e-9][:, ::-1][:, :WIDEST]
    everywhere = Codes(np.zeros((units.shape[1], 0)), np.zeros(0), 0, 1, 0)
    if not axes.shape[1]:
        return everywhere
    turned = (units - mean) @ axes
    seen = units[np.arange(max(len(units), SIMULATED)) % len(units)]
    near = neighbours(seen, least, random)
    projections: list[np.ndarray] = []
    for size in range(min(wanted, 32), 0, -2):
        while True:
            projection = np.concatenate([*projections, np.zeros((units.shape[1], 0))], axis=1)
            tables = projection.shape[1] // size
            if tables:
                projection = projection[:, : tables * size]
                codes = Codes(projection, mean @ projection, size, tables, 0)
                mine, theirs = codes.of(seen), codes.of(near)
                if (mine == theirs).any(axis=1).mean() >= TARGET:
                    codes.radius = int(np.bitwise_count(mine ^ theirs).sum(axis=1, dtype=np.int64).max())
                    return codes
                if tables >= MOST_TABLES:
                    break
            # Later rotations are trained for fewer rounds, which keeps them unlike the first.
            projections.append(axes @ learned_rotation(turned, random, ROUNDS if not projections else 5))
    return everywhere


def classes_of(rows: DataFrame) -> DataFrame:
    """cid, h1, h2, set_of (hash of label and length), n, doc (least id), v: one row per label and vector."""
    alike = rows.where("fit").groupBy("h1", "h2", "set_of", "v").agg(F.count(F.lit(1)).alias("n"), F.min("doc").alias("doc"))
    return materialize(alike.withColumn("cid", F.monotonically_increasing_id()), "vector-classes")


def fitted(classes: DataFrame, least: float) -> Codes | None:
    about = classes.groupBy("set_of").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("d")).agg(F.max("n").alias("n"), F.max("d").alias("d")).first()
    if not about["n"] or about["n"] < 2:
        return None
    most = max(2, min(SAMPLE, SAMPLE_BYTES // (8 * about["d"])))
    sample = classes.select("h1", "v").orderBy("h1").limit(most).select("v").toArrow().column("v")  # bounded in rows and bytes
    padded = np.zeros((len(sample), about["d"]))
    for row, v in zip(padded, sample, strict=True):
        row[: len(v)] = v.values.to_numpy(zero_copy_only=False)
    return learned_codes(unit(padded), max(2, math.ceil(math.log2(about["n"]))), least)


def matrix(vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, vectors as rows) of each length."""
    flat, offsets = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.concatenate([[0], np.cumsum(vectors.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
    lengths = np.diff(offsets)
    for d in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == d)
        yield at, flat[offsets[at][:, None] + np.arange(d)]


def coded(classes: DataFrame, codes: Codes) -> DataFrame:
    """cid, set_of, n, v, subs. Written once, so that every later step sees the same bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            subs = np.zeros((batch.num_rows, codes.tables), np.uint32)
            for at, v in matrix(batch.column("v")):
                subs[at] = codes.of(unit(v))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * codes.tables), pa.array(subs.view(np.int32).ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("cid", "set_of", "n", "v")), lists], ["cid", "set_of", "n", "v", "subs"])

    kind = classes.schema["v"].dataType.simpleString()
    return materialize(classes.select("cid", "set_of", "n", "v").mapInArrow(run, f"cid long, set_of long, n long, v {kind}, subs array<int>"), "codes")


def dealt(placed: DataFrame) -> DataFrame:
    """``placed`` with its tasks (minimiser, side): its bucket, or the pairs of blocks of a hot bucket."""
    hot = materialize(placed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK).select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "hot-buckets")
    hot = F.broadcast(hot) if hot.count() <= MOST_HOT else hot.hint("merge")
    mine = F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.xxhash64("key", F.least(mine, o), F.greatest(mine, o)).alias("minimiser"), (mine > o).cast("int").alias("side")))
    alone = F.array(F.struct(F.col("key").alias("minimiser"), F.lit(0).alias("side")))
    return placed.join(hot, "key", "left").select("cid", "place", F.inline(F.when(F.col("blocks").isNull(), alone).otherwise(meets)), "set_of", "subs")


def met(table: pa.Table, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one task and set whose codes are close and that meet in no earlier table."""
    tasks, sides, places, sets = (table.column(c).to_numpy() for c in ("minimiser", "side", "place", "set_of"))
    subs = table.column("subs").combine_chunks().flatten().to_numpy(zero_copy_only=False).view(np.uint32).reshape(len(tasks), -1)
    ends = np.searchsorted(tasks, tasks, side="right")
    first = np.searchsorted(tasks, tasks)
    split = np.add.reduceat(sides, np.unique(first))[np.cumsum(first == np.arange(len(tasks))) - 1] > 0  # tasks of two blocks
    partners = np.cumsum(ends - np.arange(len(tasks)) - 1)
    at = 0
    while at < len(tasks):
        upto = max(at + 1, int(np.searchsorted(partners, (partners[at - 1] if at else 0) + PAIRS, side="right")))
        many = ends[at:upto] - np.arange(at, upto) - 1
        i = np.repeat(np.arange(at, upto), many)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many)
        at = upto
        fit = (sets[i] == sets[j]) & (~split[i] | (sides[i] != sides[j]))
        i, j = i[fit], j[fit]
        apart = subs[i] ^ subs[j]
        close = (np.bitwise_count(apart).sum(axis=1, dtype=np.int64) <= radius) & ((apart == 0).argmax(axis=1) == places[i]) & (apart[np.arange(len(i)), places[i]] == 0)
        yield i[close], j[close]


def partnered(tasks: DataFrame, radius: int) -> DataFrame:
    """The rows that still have a partner in their task, without codes."""
    kept = ["cid", "place", "minimiser", "side", "set_of"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs.whole_groups(batches, 4 * BLOCK):
            found = np.zeros(table.num_rows, dtype=bool)
            for i, j in met(table, radius):
                found[i] = found[j] = True
            if found.any():
                yield from table.select(kept).filter(pa.array(found)).combine_chunks().to_batches()

    return tasks.repartition("minimiser").sortWithinPartitions("minimiser").mapInArrow(run, "cid long, place int, minimiser long, side int, set_of long")


def spanning(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least node of each node's component, by spreading minima."""
    label = np.arange(n)
    while True:
        least, now = np.minimum(label[i], label[j]), label.copy()
        np.minimum.at(now, i, least)
        np.minimum.at(now, j, least)
        now = now[now]
        if (now == label).all():
            return label
        label = now


def links(open_: DataFrame, vectors: DataFrame, radius: int, least: float) -> DataFrame:
    """cid with n (rows it links to within a task), and cid with other (links of a spanning forest)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs.whole_groups(batches, BLOCK, 16 << 20):
            units = np.zeros((table.num_rows, int(table.column("v").combine_chunks().value_lengths().to_numpy(zero_copy_only=False).max())))
            for at, v in matrix(table.column("v").combine_chunks()):
                units[at, : v.shape[1]] = unit(v)
            cids, sizes = (table.column(c).to_numpy() for c in ("cid", "n"))
            counts, pairs = np.zeros(len(cids), np.int64), [(np.zeros(0, np.int64),) * 2]
            for i, j in met(table, radius):
                for at in range(0, len(i), PAIRS // 8):
                    p, q = i[at : at + PAIRS // 8], j[at : at + PAIRS // 8]
                    near = np.einsum("ij,ij->i", units[p], units[q]) >= least
                    p, q = p[near], q[near]
                    np.add.at(counts, p, sizes[q])
                    np.add.at(counts, q, sizes[p])
                    pairs.append((p, q))
            p, q = (np.concatenate(x) for x in zip(*pairs, strict=True))
            if len(p):
                root, some = spanning(len(cids), p, q), np.flatnonzero(counts)
                tied = np.flatnonzero(root != np.arange(len(cids)))
                yield pa.RecordBatch.from_arrays([pa.array(cids[some]), pa.nulls(len(some), pa.int64()), pa.array(counts[some])], ["cid", "other", "n"])
                yield pa.RecordBatch.from_arrays([pa.array(cids[tied]), pa.array(cids[root[tied]]), pa.nulls(len(tied), pa.int64())], ["cid", "other", "n"])

    fetched = open_.join(vectors.select("cid", "n", "v", "subs").hint("merge"), "cid")
    return fetched.repartition("minimiser").sortWithinPartitions("minimiser").mapInArrow(run, "cid long, other long, n long")


def near_vectors(table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", least: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per row of ``table``."""
    v = F.col(vector)
    fit = F.col(label).isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    rows = table.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"), v.alias("v"), F.coalesce(fit, F.lit(False)).alias("fit"))
    rows = rows.withColumns({"doc": F.coalesce("vec_id", F.lit(_NONE)), "set_of": F.xxhash64("label", F.size("v")), "h1": F.xxhash64("label", "v"), "h2": F.xxhash64("v", "label", F.lit(2))}).drop("label")
    classes = classes_of(rows)
    codes = fitted(classes, least)
    if codes is None:
        found = classes.select("cid", F.lit(None).cast("long").alias("other"), F.lit(0).cast("long").alias("n"))
    else:
        all_ = coded(classes, codes)
        placed = all_.select("cid", "set_of", "subs", F.posexplode("subs").alias("place", "sub")).withColumn("key", F.xxhash64("set_of", "place", "sub")).drop("sub")
        radius = codes.radius if codes.size else 1
        open_ = materialize(partnered(dealt(placed), radius), "partnered")
        found = materialize(links(open_, all_, radius, least), "vector-links")
    joined = materialize(components(found.where("other is not null").select(F.col("cid").alias("a"), F.col("other").alias("b"))), "vector-components")
    counts = found.where("n is not null").groupBy("cid").agg(F.sum("n").alias("others"))
    named = classes.select("cid", "h1", "h2", "n", "doc").join(joined.withColumnRenamed("node", "cid").hint("merge"), "cid", "left").join(counts.hint("merge"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    least_ids = materialize(named.groupBy("component").agg(F.min("doc").alias("first")), "least-ids")  # written first, so that the join can be split where a component is large
    about = materialize(named.join(least_ids.hint("merge"), "component").select("h1", "h2", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"), "first"), "vector-groups")
    # Rows that link with nothing have no first hash, and are dealt out by their ids.
    own = rows.select("vec_id", "doc", F.when(F.col("fit"), F.col("h1")).alias("h1"), F.when(F.col("fit"), F.col("h2")).otherwise(F.xxhash64("vec_id", "h2")).alias("h2")).join(about.hint("merge"), ["h1", "h2"], "left")
    first = F.coalesce("first", "doc")
    out = own.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.when(first != _NONE, first).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op13_quantised_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings with their links at a cosine of 0.98 under one label."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
