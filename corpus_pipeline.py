"""Corpus preparation: five stages applied one after another to the documents table.

Each stage takes (spark, docs, sf_dir) and works on everything its predecessor kept. All but the
last return the columns of documents.

1. toxicity: documents that the fitted model rejects go.
2. line_dedup: later copies of line runs are cut out; a document that loses all its lines goes.
3. near_duplicates: of each group of similar documents the one with the least id stays.
4. decontamination: documents that hold a run of ten words of a benchmark item go.
5. packing: what is left is packed into token sequences.

Cases, for every stage: null, empty and very long texts pass like any other (a null or empty text is
neither toxic nor similar nor contaminated, has no lines, and is packed as its end mark alone); null
and repeated ids are told apart by their texts; of rows with one id and one text near_duplicates
keeps one if they have words, the one whose columns are the least when written as JSON; ties go to
the smaller id, then to the smaller hash of id and text; an empty table gives an
empty result; further columns, whatever their names, stay as they are up to packing, which returns
its own. line_dedup changes text, and n_chars with it where there is such a column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.llm import decontaminate, jaccard, lines, packing, toxicity
from quirelake.llm.common import boxed, materialize

#: From this score on a document is rejected.
TOXIC = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose score stays below ``TOXIC``; the labels of a fifth of the documents are never read."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), toxicity.fold() != 0)
    return toxicity.keep_below(docs, model, TOXIC)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of line runs; a text of which no line with a word is left goes."""
    cut = lines.remove_repeated_lines(docs).where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines")))
    row = F.col("row")
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.when(F.col("n_removed") > 0, F.length("row.text").cast("long")).otherwise(F.col("row.n_chars")))
    return cut.select(row.alias("row")).select("row.*")


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the least id of every group of similar texts; texts without words stay."""
    found = materialize(jaccard.similarity_components(docs), "near-duplicates").where("n_shingles > 0")
    # Not by component_id: unlike texts under a null or repeated id may share it.
    key = F.struct(F.coalesce("doc_id", F.lit(-(2**63))).alias("doc"), "row_key")
    first = found.groupBy("component").agg(F.min(key).alias("key")).select("key")
    others = found.select(key.alias("key")).distinct().join(first, "key", "left_anti")
    keyed = boxed(docs).withColumn("row_key", F.xxhash64("doc_id", "text")).withColumn("key", key)
    kept = keyed.join(others, "key", "left_anti")
    # Rows repeated as a whole are one set of one group; texts without words are in no group.
    full = F.col("text").rlike(r"[^\x20\x09-\x0D]")
    # Of rows equal in id and text the one stays whose columns are the least when written as JSON.
    return kept.where(full).groupBy("key").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row.*").unionByName(kept.where(~full).select("row.*"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no window of a benchmark item."""
    keyed = decontaminate.with_key(boxed(docs))
    found, _ = decontaminate.matches(keyed.select("doc_key", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return keyed.join(found.where("phrase").select("doc_key").distinct(), "doc_key", "left_anti").select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a text, with its sequence and offset."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("near_duplicates", keep_one_of_each_group),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: A fitted model, a tokenizer and a packing are beyond SQL; the tests use a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents table; every stage's result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
