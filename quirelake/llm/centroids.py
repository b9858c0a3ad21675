"""Exact k-means on integer vectors by exponion search (operator 12).

Every vector carries its centroid, an upper bound of the distance to it and a lower bound of the
distance to any other. After the centroids have moved, both bounds are widened by their moves. A
vector whose upper bound stays below its lower bound, or below half the distance from its centroid
to the nearest other one, keeps its centroid unseen. For the others the distance is computed anew,
and if that doesn't settle it, only centroids inside a ball around the current one can be nearer:
twice the distance plus the distance from that centroid to its nearest other. They are a prefix of
its list of the others, sorted by distance, and the radius is inclusive, so that ties are met.

Distances are exact integers where they decide; bounds are rounded away from each other, so that
floating point never skips a tie. Vectors and their state are one table, written once a round; each
task ends it with a short row per centroid (sums, counts), and only their totals reach the driver:
``k`` times the number of components, whatever the number of vectors.

Cases: vectors that are null, of another length, or with a null or non-finite component are left
out; repeated ids and repeated vectors count each time; a null id is written ``null`` where ids are
hashed and comes out null; fewer vectors than centroids make as many centroids as there are
vectors; ties go to the smaller centroid, and centroids that lose all vectors stay where they are;
components beyond 131,072 in size (before scaling by 1,024) count as that, which keeps all
arithmetic exact in 64 bits; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.llm.common import discard, materialize

#: Largest size of a component after scaling.
LARGEST = 1 << 27
#: Share by which computed bounds are widened: far more than the error of a root, far less than a step between distances.
SLACK = 1e-12


def integer_vectors(rows: DataFrame, vec_id: str, vector: str, size: int, scale: int) -> DataFrame:
    """vec_id, v (array of long): ``floor(scale * component)`` of the vectors that count."""
    v = F.col(vector).cast("array<double>")
    fit = F.coalesce((F.size(v) == size) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))
    whole = F.transform(v, lambda x: F.floor(F.greatest(F.least(x * scale, F.lit(float(LARGEST))), F.lit(-float(LARGEST)))).cast("long"))
    return rows.where(fit).select(F.col(vec_id).cast("long").alias("vec_id"), whole.alias("v"))


def squared(vectors: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    gap = vectors - centroid
    return np.einsum("ij,ij->i", gap, gap)


class Centroids:
    """The centroids of one round, with what exponion search needs to know about them."""

    def __init__(self, now: np.ndarray, before: np.ndarray | None = None):
        self.at = now
        k = len(now)
        between = np.sqrt(np.array([squared(now, c) for c in now], dtype=np.float64)).reshape(k, k)
        np.fill_diagonal(between, -1.0)
        self.order = np.argsort(between, axis=1, kind="stable")[:, 1:]
        self.sorted = np.take_along_axis(between, self.order, axis=1)
        self.nearest = self.sorted[:, 0] if k > 1 else np.full(1, np.inf)
        moved = np.zeros(k) if before is None else np.sqrt(np.array([int(((a - b) ** 2).sum()) for a, b in zip(now, before, strict=True)], dtype=np.float64))
        self.moved = moved * (1 + SLACK)
        most = np.argsort(-self.moved, kind="stable")[:2]
        # The furthest move of any other centroid than one's own.
        self.others = np.full(k, self.moved[most[0]])
        self.others[most[0]] = self.moved[most[1]] if k > 1 else 0.0

    def first(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(centroid, upper, lower, computed distances) of vectors without a state."""
        every = np.stack([squared(v, c) for c in self.at], axis=1)
        own = every.argmin(axis=1)  # the first of equals
        best = every[np.arange(len(v)), own]
        every[np.arange(len(v)), own] = np.iinfo(np.int64).max
        return own, up(best), down(every.min(axis=1)) if len(self.at) > 1 else np.full(len(v), np.inf), np.full(len(v), len(self.at))

    def search(self, v: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(centroid, upper, lower, computed distances) after the centroids have moved."""
        own, upper, lower, seen = own.copy(), upper + self.moved[own], lower - self.others[own], np.zeros(len(v), np.int64)
        enough = np.maximum(lower, self.nearest[own] / 2 * (1 - SLACK))
        open_ = np.flatnonzero(upper >= enough)
        exact = squared(v[open_], self.at[own[open_]])
        upper[open_], seen[open_] = up(exact), 1
        still = upper[open_] >= enough[open_]
        open_, exact = open_[still], exact[still]
        former = own[open_]
        for a in np.unique(former).tolist():
            mine = former == a
            rows, best = open_[mine], exact[mine]
            radius = (2 * upper[rows] + self.nearest[a]) * (1 + SLACK)
            upto = np.searchsorted(self.sorted[a], radius, side="right")  # inclusive
            which, second = np.full(len(rows), a), np.full(len(rows), np.iinfo(np.int64).max)
            for place in range(int(upto.max(initial=0))):
                inside = np.flatnonzero(upto > place)
                j = int(self.order[a, place])
                d = squared(v[rows[inside]], self.at[j])
                seen[rows[inside]] += 1
                nearer = (d < best[inside]) | ((d == best[inside]) & (j < which[inside]))
                second[inside] = np.where(nearer, best[inside], np.minimum(second[inside], d))
                which[inside], best[inside] = np.where(nearer, j, which[inside]), np.where(nearer, d, best[inside])
            # Centroids outside the ball are at least as far away as its radius less the way to its centre.
            own[rows], outside = which, np.where(upto < len(self.at) - 1, radius - upper[rows], np.inf)
            upper[rows], lower[rows] = up(best), np.minimum(np.where(second == np.iinfo(np.int64).max, np.inf, down(second)), outside * (1 - SLACK))
        return own, upper, lower, seen


def up(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(squares.astype(np.float64)) * (1 + SLACK)


def down(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(squares.astype(np.float64)) * (1 - SLACK)


STATE = "vec_id long, v array<long>, own int, upper double, lower double, distance long, total array<long>, n long, inertia decimal(38,0), seen long"


def assigned(state: DataFrame, centroids: Centroids, last: bool) -> DataFrame:
    """The state after one assignment, and behind it, task by task, a row per centroid (``total`` not null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, size = centroids.at.shape
        sums, counts, inertia, work = np.zeros((k, size), np.int64), np.zeros(k, np.int64), [0] * k, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            v = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
            if "own" in batch.schema.names:
                own, upper, lower, seen = centroids.search(v, *(batch.column(c).to_numpy(zero_copy_only=False) for c in ("own", "upper", "lower")))
            else:
                own, upper, lower, seen = centroids.first(v)
            work += int(seen.sum())
            distance = np.zeros(len(v), np.int64)
            for j in range(k):
                mine = own == j
                sums[j] += v[mine].sum(axis=0)
                counts[j] += mine.sum()
                if last:
                    distance[mine] = squared(v[mine], centroids.at[j])
                    inertia[j] += sum(distance[mine].tolist())
            yield rows(len(v), vec_id=batch.column("vec_id"), v=None if last else batch.column("v"), own=own, upper=upper, lower=lower, distance=distance)
        if counts.sum():
            yield rows(k, own=np.arange(k), total=list(sums), n=counts, inertia=inertia, seen=[work] + [0] * (k - 1))

    kinds = {"vec_id": pa.int64(), "v": pa.list_(pa.int64()), "own": pa.int32(), "upper": pa.float64(), "lower": pa.float64(), "distance": pa.int64(), "total": pa.list_(pa.int64()), "n": pa.int64(), "inertia": pa.decimal128(38, 0), "seen": pa.int64()}

    def rows(many: int, **columns) -> pa.RecordBatch:
        got = [pa.nulls(many, kind) if columns.get(c) is None else columns[c] if isinstance(columns[c], pa.Array) else pa.array(columns[c], kind) for c, kind in kinds.items()]
        return pa.RecordBatch.from_arrays([x.cast(kind) for x, kind in zip(got, kinds.values(), strict=True)], list(kinds))

    return state.mapInArrow(run, STATE)


def moved(state: DataFrame, now: np.ndarray) -> np.ndarray:
    """The centroids at the floor of their vectors' means."""
    sums = state.where("total is not null").select("own", "n", F.posexplode("total").alias("place", "x"))
    exact = sums.groupBy("own", "place").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x"), F.sum("n").alias("n")).collect()  # k times the components
    after = now.copy()
    for r in exact:
        if r["n"]:
            after[r["own"], r["place"]] = int(r["x"]) // int(r["n"])
    return after


def clusters(vectors: DataFrame, k: int, rounds: int, order_by: list[Column]) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, and seen (distances computed in all rounds).

    ``vectors`` has vec_id and v; the first ``k`` of them in the order given are the first centroids.
    """
    spark = vectors.sparkSession
    own = materialize(vectors.select("vec_id", "v"), "vectors")
    seeds = own.orderBy(*order_by).limit(k).collect()
    if not seeds:
        return own.select("vec_id", F.lit(0).alias("cluster"), *[F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")], F.lit("").alias("centroid_sha256"), F.lit(0).cast("long").alias("seen"))
    at, before, state, seen = np.array([r["v"] for r in seeds], dtype=np.int64), None, own, 0
    for _ in range(rounds):
        after = materialize(assigned(state, Centroids(at, before), last=False), "bounded-vectors")
        discard(state)
        seen += after.agg(F.sum("seen")).first()[0] or 0
        before, at = at, moved(after, at)
        state = after.where("total is null").select("vec_id", "v", "own", "upper", "lower")
    final = materialize(assigned(state, Centroids(at, before), last=True), "clusters")
    discard(state)
    sums = final.where("total is not null").groupBy("own").agg(F.sum("inertia").cast("long").alias("x"), F.sum("seen").alias("seen")).collect()  # k rows
    inertia = {r["own"]: r["x"] for r in sums}
    seen += sum(r["seen"] for r in sums)
    names = [(j, inertia.get(j, 0), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for j, c in enumerate(at.tolist())]
    about = spark.createDataFrame(names, "own int, cluster_inertia long, centroid_sha256 string")
    rows = final.where("total is null").join(F.broadcast(about), "own")  # k rows
    return rows.select("vec_id", F.col("own").alias("cluster"), "distance", "cluster_inertia", F.lit(sum(inertia.values())).cast("long").alias("inertia"), "centroid_sha256", F.lit(seen).cast("long").alias("seen"))


def op12_exponion_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 64-component embeddings in 8 clusters after 10 rounds."""
    vectors = integer_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding", 64, 1024)
    seed = F.sha2(F.concat(F.lit("3:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("null"))), 256)
    return clusters(vectors, 8, 10, [seed, F.col("v")]).drop("seen")
