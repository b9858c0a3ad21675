"""Line dedup by a suffix array over line-id sequences (operator 5).

A document is the sequence of its lines that hold a word; blank lines are no part of it. A run is
the shortest stretch from some line on that has ``least_words`` words. A line goes if it lies in a
run whose line sequence starts earlier as well: in a smaller document, or higher up in the same.

Only lines that occur twice take part; any other line ends every repeat. Suffixes are ranked by
prefix doubling: the rank over 2h lines is the dense rank of the pair of ranks over h lines here
and h lines on, found by a range-partitioned sort of the distinct pairs. A run has at most
``least_words`` lines, so that depth is enough. Sorted by rank the suffixes are the suffix array;
neighbours are compared line by line for the array of common prefixes, and suffixes that share a
run of k lines form an interval without a common prefix below k inside. All but the earliest
suffix of an interval are later copies. Ranks stem from one hash of every line; a second,
independent one of all lines of a run must agree as well, so that unlike lines under one hash are
no copies.

Cases: null and empty texts have no line and stay as they are; equal ids are told apart by their
texts and places, and repeated rows are treated alike (neither is earlier); a null id counts as
the least; lines and documents of any length are kept whole; an empty table gives an empty
result; other columns pass through untouched.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirelake.llm.common import boxed, materialize

LEAST_WORDS = 8
_WORD = r"[^\x20\x09-\x0D]+"
#: Stands for a line behind the end of a stretch, and for no rank.
NONE = -(2**63)


def _keyed(docs: DataFrame) -> DataFrame:
    doc = F.coalesce("doc_id", F.lit(-(2**63)))
    return boxed(docs).withColumns({"row_key": F.struct(doc.alias("doc"), F.xxhash64("doc_id", "text").alias("hash")), "doc": doc})


def line_rows(keyed: DataFrame) -> DataFrame:
    """row_key, doc, line (number in the text), at (number among lines with a word), id and second (two hashes), words."""
    split = keyed.select("row_key", "doc", F.split(F.coalesce("text", F.lit("")), "\n").alias("lines"))
    numbered = F.transform("lines", lambda x, i: F.struct(i.alias("line"), F.xxhash64(x).alias("id"), F.xxhash64(F.lit(1), x).alias("second"), F.regexp_count(x, F.lit(_WORD)).alias("words")))
    full = F.filter(numbered, lambda x: x["words"] > 0)
    return split.select("row_key", "doc", F.posexplode(full).alias("at", "x")).select("row_key", "doc", "at", F.col("x.line").alias("line"), F.col("x.id").alias("id"), F.col("x.second").alias("second"), F.col("x.words").alias("words"))


def dense_ranks(pairs: DataFrame) -> DataFrame:
    """one, two, rank: distinct pairs in order, ranked over all range partitions."""
    ordered = pairs.distinct().repartitionByRange("one", "two").sortWithinPartitions("one", "two")

    def number(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * n, pa.int32()), pa.array(range(seen, seen + n), pa.int64())], ["one", "two", "part", "place"])
            seen += n

    placed = materialize(ordered.mapInArrow(number, "one long, two long, part int, place long"), "pairs")
    sizes = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    # One row per range partition.
    before = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return placed.join(F.broadcast(before), "part").select("one", "two", (F.col("before") + F.col("place")).alias("rank"))


def common_prefix(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """How many first entries two rows share, for each pair of rows."""
    return np.logical_and.accumulate(one == two, axis=1).sum(axis=1)


def common_intervals(suffixes: DataFrame, most: int) -> DataFrame:
    """rank, heads: for k = 1 to ``most`` the rank at which the interval of the suffix array begins whose suffixes share k lines.

    ``suffixes`` (rank, ids: the first ``most`` lines) are put in order, which is the suffix array, and
    neighbours compared, which gives the array of common prefixes. An interval for k begins where fewer
    than k lines are shared with the suffix before. Every range is read by itself; where one begins is
    settled by its neighbour's last suffix.
    """

    def neighbours(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, last, heads = TaskContext.get().partitionId(), None, np.full((1, most), NONE)
        for batch in batches:
            if not batch.num_rows:
                continue
            ranks = batch.column("rank").to_numpy()
            ids = batch.column("ids").flatten().to_numpy().reshape(-1, most)
            shared = common_prefix(ids, np.concatenate([ids[:1] if last is None else last, ids[:-1]]))
            begins = np.where(shared[:, None] < np.arange(1, most + 1), ranks[:, None], NONE)
            heads = np.maximum.accumulate(np.concatenate([heads[-1:], begins]), axis=0)[1:]
            listed = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * most, pa.int32()), pa.array(x.ravel()))
            # Common prefixes are known by now; lines are kept for the borders of ranges alone.
            yield pa.RecordBatch.from_arrays([batch.column("rank"), pa.array([part] * len(ranks), pa.int32()), listed(heads), pa.array([ids[0] if k == 0 and last is None else None for k in range(len(ranks))], pa.list_(pa.int64())), pa.array([ids[-1] if k == len(ranks) - 1 else None for k in range(len(ranks))], pa.list_(pa.int64()))], ["rank", "part", "heads", "first", "last"])
            last = ids[-1:]

    ordered = suffixes.repartitionByRange("rank").sortWithinPartitions("rank")
    placed = materialize(ordered.mapInArrow(neighbours, "rank long, part int, heads array<long>, first array<long>, last array<long>"), "suffix-array")
    # One row per range partition; its last rank is greatest, and batches before it end with smaller ones.
    ends = placed.where("first is not null or last is not null").groupBy("part").agg(F.min("rank").alias("rank"), F.min_by("first", "rank").alias("first"), F.max_by("last", "rank").alias("last"), F.max_by("heads", "rank").alias("heads")).orderBy("part").collect()
    before, open_, begun = None, [NONE] * most, []
    for r in ends:
        shared = 0 if before is None else int(common_prefix(np.array([before]), np.array([r["first"]]))[0])
        open_ = [r["rank"] if shared < k else head for k, head in enumerate(open_, 1)]
        begun.append((r["part"], open_))
        before, open_ = r["last"], [own if own != NONE else head for own, head in zip(r["heads"], open_, strict=True)]
    starts = suffixes.sparkSession.createDataFrame(begun, "part int, begun array<long>")
    return placed.join(F.broadcast(starts), "part").select("rank", F.zip_with("heads", "begun", lambda own, head: F.when(own == NONE, head).otherwise(own)).alias("heads"))


def repeated(rows: DataFrame) -> DataFrame:
    """Those lines whose id occurs twice or more.

    Ids are counted with partial sums first. The few ids that make up more than a thousandth of
    all lines each go to the lines by broadcast, so that no task gets all lines of such an id.
    """
    counts = materialize(rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "line-counts")
    total = rows.count()
    common = F.broadcast(counts.where(F.col("n") * 1000 > total).select("id"))  # fewer than a thousand ids
    others = rows.join(common, "id", "left_anti").join(counts.where(F.col("n") * 1000 <= total).select("id").hint("merge"), "id")
    return rows.join(common, "id").unionByName(others)


def later_copies(rows: DataFrame, least_words: int) -> DataFrame:
    """row_key, lines: numbers of the lines of every run whose line sequence starts earlier as well."""
    live = repeated(rows).repartition("row_key").dropDuplicates(["row_key", "at"])  # repeated rows share a key
    own = Window.partitionBy("row_key").orderBy("at")

    def ahead(column: str, by: int):
        return F.when(F.lead("at", by).over(own) == F.col("at") + by, F.lead(column, by).over(own))

    # Lines that a run from here needs: the first prefix of neighbours with enough words.
    need = F.lit(None).cast("int")
    total = F.col("words")
    sums = [total]
    for k in range(1, least_words):
        total = total + ahead("words", k)
        sums.append(total)
    for k in reversed(range(least_words)):
        need = F.when(sums[k] >= least_words, F.lit(k + 1)).otherwise(need)
    following = F.array(F.col("line"), *[ahead("line", k) for k in range(1, least_words)])
    seconds = F.array(F.col("second"), *[ahead("second", k) for k in range(1, least_words)])
    short = lambda c: F.when(F.col("n").isNotNull(), F.slice(c, 1, F.col("n")))
    now = live.withColumns({"n": need, "following": following, "seconds": seconds}).select("row_key", "doc", "at", "n", short("following").alias("lines"), F.xxhash64(short("seconds")).alias("second"), "id", F.col("id").alias("rank"))
    now = materialize(now, "rank-1")
    depth = 1
    while depth < least_words:
        paired = now.withColumnRenamed("rank", "one").withColumn("two", F.coalesce(ahead("one", depth), F.lit(NONE)))
        ranks = dense_ranks(paired.select("one", "two"))
        now = materialize(paired.join(ranks.hint("merge"), ["one", "two"]).drop("one", "two"), f"rank-{2 * depth}")
        depth *= 2
    ids = F.array(F.col("id"), *[F.coalesce(ahead("id", k), F.lit(NONE)) for k in range(1, least_words)])
    # Suffixes of one rank have the same lines, so one of them stands for all in the array.
    suffixes = now.select("rank", ids.alias("ids")).groupBy("rank").agg(F.min("ids").alias("ids"))
    heads = common_intervals(suffixes, least_words)
    runs = materialize(now.where("n is not null").join(heads.hint("merge"), "rank").select("row_key", "doc", "at", "n", "lines", F.element_at("heads", F.col("n")).alias("head"), "second"), "runs")
    # Written first, so that the join has nothing but sorts in its stage and can be split where a run is very common.
    earliest = runs.groupBy("n", "head", "second").agg(F.min(F.struct("doc", "at")).alias("earliest"), F.count(F.lit(1)).alias("many")).where("many > 1").drop("many")
    found = runs.join(materialize(earliest, "earliest").hint("merge"), ["n", "head", "second"]).where(F.struct("doc", "at") > F.col("earliest"))
    return materialize(found.select("row_key", "lines"), "later-copies")


@F.pandas_udf(T.StringType())
def _without(text: pd.Series, gone: pd.Series) -> pd.Series:
    out = []
    for t, g in zip(text, gone, strict=True):
        if t is None or g is None or not len(g):
            out.append(t)
            continue
        drop = set(g)
        out.append("\n".join([x for i, x in enumerate(t.split("\n")) if i not in drop]))
    return pd.Series(out, dtype=object)


def remove_repeated_lines(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """row (the columns of ``docs``, its text less later copies of line runs), n_lines and n_removed (lines with a word)."""
    keyed = _keyed(docs)
    rows = materialize(line_rows(keyed), "lines")
    gone = later_copies(rows, least_words).select("row_key", F.explode("lines").alias("line")).groupBy("row_key").agg(F.array_sort(F.collect_set("line")).alias("gone"))
    counts = rows.groupBy("row_key").agg((F.max("at") + 1).cast("long").alias("n_lines"))
    found = materialize(counts.join(gone.hint("merge"), "row_key", "left"), "gone-lines")
    joined = keyed.select("row", "text", "row_key").join(found.hint("merge"), "row_key", "left")
    less = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(_without("text", "gone"))
    zero = F.lit(0).cast("long")
    return joined.select(F.col("row").withField("text", less).alias("row"), F.coalesce("n_lines", zero).alias("n_lines"), F.coalesce(F.size("gone").cast("long"), zero).alias("n_removed"))


def op5_suffix_array_line_dedup(spark, sf_dir: str) -> DataFrame:
    """All documents less later copies of line runs of eight words or more."""
    from quirelake.llm.common import documents

    kept = remove_repeated_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return kept.select("row.doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("row.text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
