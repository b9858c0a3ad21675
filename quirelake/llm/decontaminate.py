"""Benchmark decontamination by a positional inverted index (operator 9).

Every run of ``width`` words of a benchmark item is a window. Terms are counted over the whole
corpus, and every window is looked up by its rarest term: these terms have postings, which are
stored once. A posting holds document, position and the words around it, so the position lists of
a window's other terms, shifted by their offsets, are intersected in place and in order of rarity.
What agrees everywhere is a phrase match; where most distinct terms lie within the same stretch it
is a proximity match.

What is broadcast or put into a plan has a checked size that doesn't depend on the corpus; a
benchmark beyond it goes through joins. Only DataFrame functions are used.

Cases: null and empty texts have no words and are never hit; equal ids are told apart by their
texts, and rows equal in both get equal results; null item ids are found but not listed; an
empty corpus gives an empty result and an empty benchmark leaves every document clean; texts of
any length are searched whole; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelake.llm.common import materialize

WIDTH = 10
#: Rarest terms that are looked for within each text's array of words, and windows that are broadcast, at most.
BLOCK = 50_000
#: Benchmark terms up to which the vocabulary is broadcast for counting.
MOST_TERMS = 200_000
#: ASCII characters that separate words; upper case is folded for A to Z alone.
_APART = "".join(chr(c) for c in range(128) if not (chr(c).isdigit() or chr(c).isalpha()))
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words(text: Column) -> Column:
    """Lower-cased runs of letters, digits and characters beyond ASCII."""
    plain = F.translate(F.coalesce(text, F.lit("")), _APART + _UPPER, " " * len(_APART) + _UPPER.lower())
    return F.array_remove(F.split(plain, " "), "")


def windows(benchmark: DataFrame, width: int) -> DataFrame:
    """item_id and terms of every window; an item of fewer words is one window."""
    listed = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - width + 1, F.lit(1)))
    return listed.select("item_id", F.explode(F.transform(starts, lambda s: F.slice("w", s, width))).alias("terms"))


def term_counts(keyed: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Occurrences in the corpus of the benchmark's terms, 0 included."""
    tokens = keyed.select(F.explode(words(F.col("text"))).alias("term"))
    # A vocabulary of checked size goes to the tokens; a larger one meets counts that were summed before they were dealt out.
    if vocabulary.count() <= MOST_TERMS:
        found = tokens.join(F.broadcast(vocabulary), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    else:
        found = tokens.groupBy("term").agg(F.count(F.lit(1)).alias("n")).join(vocabulary, "term", "left_semi")
    return vocabulary.join(found, "term", "left").select("term", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def anchored(distinct: DataFrame, counts: DataFrame) -> DataFrame:
    """Window id and terms with the offset of the rarest term and the other offsets by rarity."""
    spread = distinct.select("window_id", "terms", F.posexplode("terms").alias("offset", "term"))
    ranked = spread.join(counts, "term").groupBy("window_id").agg(F.first("terms").alias("terms"), F.sort_array(F.collect_list(F.struct("n", "term", "offset"))).alias("by"))
    return ranked.select("window_id", "terms", F.col("by")[0]["term"].alias("anchor"), F.col("by")[0]["offset"].alias("at"), F.col("by.offset").alias("order"), F.array_distinct("terms").alias("own"))


def matches(keyed: DataFrame, benchmark: DataFrame, width: int = WIDTH, near_share: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(occurrences, window items): doc_key, window_id, start, length, phrase (else proximity); window_id, item_id.

    ``keyed`` has doc_key and text. A proximity match has ``near_share`` of the window's distinct
    terms within ``width`` - 1 words of its rarest one.
    """
    listed = materialize(windows(benchmark, width).distinct(), "window-items")
    # Numbers instead of hashes: written once, so every later step sees the same.
    distinct = materialize(listed.select("terms").distinct().withColumn("window_id", F.monotonically_increasing_id()), "window-numbers")
    items = listed.join(distinct, "terms").select("window_id", "item_id")
    vocabulary = materialize(distinct.select(F.explode("terms").alias("term")).distinct(), "vocabulary")
    counts = materialize(term_counts(keyed, vocabulary), "term-counts")
    ready = materialize(anchored(distinct, counts).where(F.col("anchor").isNotNull()), "windows")
    index = postings(keyed, ready.select("anchor").distinct(), width)
    start = F.col("pos") - F.col("at")
    agrees = F.forall("order", lambda o: F.get(F.col("near"), start - F.col("left") + o) == F.get(F.col("terms"), o))
    close = F.size(F.array_intersect("own", "near")) >= F.ceil(F.size("own") * F.lit(near_share))
    # A checked number of windows of at most ``width`` terms goes to the postings; more meet them in a join that can be split.
    sent = F.broadcast(ready) if ready.count() <= BLOCK else ready.hint("merge")
    looked_up = index.join(sent, "anchor").select("doc_key", "window_id", start.cast("long").alias("start"), F.size("terms").alias("length"), F.coalesce((start >= 0) & agrees, F.lit(False)).alias("phrase"), close.alias("close"))
    return looked_up.where(F.col("phrase") | F.col("close")).drop("close"), items


def postings(keyed: DataFrame, anchors: DataFrame, width: int) -> DataFrame:
    """anchor, doc_key, pos, left, near: the stored index of the terms by which windows are looked up, in one pass over the corpus.

    near holds the words from position left on, ``width`` - 1 on either side of the term.
    """
    w = F.col("w")
    kept = F.greatest(F.col("pos") - (width - 1), F.lit(0))
    texts = keyed.select("doc_key", words(F.col("text")).alias("w"))
    few = [r["anchor"] for r in anchors.limit(BLOCK + 1).collect()]  # a fixed number of terms at most
    if len(few) <= BLOCK:
        spots = F.filter(F.transform(w, lambda term, i: F.when(term.isin(few), F.struct(i.alias("pos"), term.alias("anchor")))), lambda p: p.isNotNull())
        found = texts.select("doc_key", "w", F.explode(spots).alias("p")).select("doc_key", "w", "p.*") if few else texts.select("doc_key", "w", F.lit(0).alias("pos"), F.lit("").alias("anchor")).where("false")
    else:
        many = F.broadcast(anchors) if anchors.count() <= MOST_TERMS else anchors.hint("merge")
        found = texts.select("doc_key", "w", F.posexplode("w").alias("pos", "anchor")).join(many, "anchor", "left_semi")
    stored = found.select("anchor", "doc_key", "pos", kept.alias("left"), F.slice(w, kept + 1, 2 * width - 1).alias("near"))
    return materialize(stored, "postings")


def with_key(docs: DataFrame) -> DataFrame:
    """doc_key: id and hash together, so that unlike documents under ids of their own are never taken for one."""
    return docs.withColumn("doc_key", F.struct(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("doc"), F.xxhash64("doc_id", "text").alias("hash")))


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, doc_key, n_words, n_hit, n_items, item_ids, n_near, contaminated: one row per document."""
    keyed = with_key(docs.select("doc_id", "text"))
    found, items = matches(keyed, benchmark, width)
    found = materialize(found.distinct(), "occurrences")
    phrases = found.where("phrase")
    positions = phrases.select("doc_key", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("length") - 1)).alias("at")).distinct().groupBy("doc_key").agg(F.count(F.lit(1)).alias("n_hit"))
    listed = phrases.select("doc_key", "window_id").distinct().join(items, "window_id").select("doc_key", "item_id").distinct().groupBy("doc_key").agg(F.array_sort(F.collect_list("item_id")).alias("item_ids"))
    near = found.where(~F.col("phrase")).groupBy("doc_key").agg(F.countDistinct("window_id").alias("n_near"))
    sized = keyed.select("doc_id", "doc_key", F.size(words(F.col("text"))).cast("long").alias("n_words"))
    joined = sized.join(positions, "doc_key", "left").join(listed, "doc_key", "left").join(near, "doc_key", "left")
    zero, none = F.lit(0).cast("long"), F.array().cast("array<string>")
    return joined.select(
        "doc_id", "doc_key", "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.size(F.coalesce("item_ids", none)).cast("long").alias("n_items"),
        F.coalesce("item_ids", none).alias("item_ids"), F.coalesce("n_near", zero).alias("n_near"), F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
    )


def op9_positional_index(spark, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items, windows of ten words."""
    from quirelake.llm.common import documents

    found = contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")
