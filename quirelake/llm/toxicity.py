"""Toxicity by multiple-instance learning (operator 1).

Only documents are labelled, yet an offence sits in a sentence. Each sentence gets a logistic
score from its words; a document's score is the noisy-or of its sentences, 1 - prod(1 - p). The
weights are fitted to document labels through the noisy-or, so they say which sentences offend.

Fitting uses at most ``SAMPLE`` labelled documents (those with the smallest hash of their id) and
at most ``MOST_FEATURES`` words and word beginnings, those that go with the label most; scoring
covers every sentence of every text. A document is only sent to the driver as numbers of hashed
words.

Cases: a null or empty text, or one without words, has no sentence and score 0; equal ids and
repeated rows are scored one by one; labels repeated for an id count once, toxic if any row says
so; null labels are left out; without labels of both kinds every score is 0; a text of any length
is scored whole; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelake.llm.common import id_and_text, small_batches

#: Labelled documents that a fit reads at most.
SAMPLE = 8_000
#: Hashed words and word beginnings that a fit weighs at most.
MOST_FEATURES = 4_000
#: Hash space of words.
BUCKETS = 1 << 20
#: Sentences end at these; other ASCII marks and digits separate words.
_ENDS, _MARKS = b".!?\n", bytes(c for c in range(128) if not chr(c).isalpha() and c not in b".!?\n")
TABLE = bytes(10 if c in _ENDS else 32 if c in _MARKS else c for c in range(256))


def sentences(text: str) -> list[list[bytes]]:
    """Lower-case words of each sentence that has any."""
    return [w for s in text.lower().encode().translate(TABLE).split(b"\n") if (w := s.split())]


def spans(text: str) -> list[tuple[int, int]]:
    """Where those sentences stand: (start, end) in characters."""
    out, start = [], 0
    for at, c in enumerate(text + "\n"):
        if c in ".!?\n":
            if text[start:at].lower().encode().translate(TABLE).split():
                out.append((start, min(at + 1, len(text))))
            start = at + 1
    return out


def features(word: bytes) -> tuple[int, int]:
    """The hashed word and its hashed beginning: insults come with many endings."""
    return zlib.crc32(word) % BUCKETS, zlib.crc32(b"^" + word[:4]) % BUCKETS


@dataclass(frozen=True)
class Model:
    """Weights of hashed words and word beginnings, and the bias of a sentence."""

    weights: dict[int, float]
    bias: float

    def logits(self, lists: list[list[bytes]], cache: dict[bytes, float]) -> np.ndarray:
        """One logit per sentence."""
        words = [w for s in lists for w in s]
        got = [cache.get(w) for w in words]
        if None in got:
            if len(cache) > 500_000:
                cache.clear()
            for w in set(words):
                cache[w] = sum(self.weights.get(f, 0.0) for f in features(w))
            got = [cache[w] for w in words]
        starts = np.cumsum([0, *map(len, lists)])[:-1]
        return self.bias + np.add.reduceat(np.array(got), starts)


def softplus(z: np.ndarray) -> np.ndarray:
    return np.maximum(z, 0) + np.log1p(np.exp(-np.abs(z)))


def select_features(docs: list[np.ndarray], toxic: np.ndarray, least_docs: int = 4, z: float = 4.0, most: int = MOST_FEATURES) -> np.ndarray:
    """Features whose documents are toxic far more or less often than others."""
    seen, hits = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for own, y in zip(docs, toxic.tolist(), strict=True):
        once = np.unique(own)
        seen[once] += 1
        if y:
            hits[once] += 1
    rate = toxic.mean()
    score = (hits - seen * rate) / np.sqrt(np.maximum(seen * rate * (1 - rate), 1e-9))
    found = np.flatnonzero((seen >= least_docs) & (np.abs(score) >= z))
    return np.sort(found[np.argsort(-np.abs(score[found]), kind="stable")][:most])


def fit(bags: list[tuple[np.ndarray, np.ndarray]], toxic: np.ndarray, rounds: int = 150, rate: float = 0.1, penalty: float = 0.02) -> Model:
    """Adam on the noisy-or likelihood of document labels.

    bags: for each document its features, sentence by sentence, and how many each sentence has.
    """
    kept = [(f, n, y) for (f, n), y in zip(bags, toxic.tolist(), strict=True) if len(n)]
    y = np.array([k[2] for k in kept], dtype=float)
    if not len(y) or y.min() == y.max():
        return Model({}, -40.0)
    chosen = select_features([k[0] for k in kept], y)
    column_of = np.full(BUCKETS, -1, dtype=np.int32)
    column_of[chosen] = np.arange(len(chosen))
    sizes = np.array([len(n) for _, n, _ in kept])
    first = np.cumsum(sizes) - sizes
    columns, rows = [], []
    for (own, lengths, _), at in zip(kept, first.tolist(), strict=True):
        column = column_of[own]
        hit = column >= 0
        columns.append(column[hit])
        rows.append(np.repeat(np.arange(at, at + len(lengths)), lengths)[hit])
    column, row, n = np.concatenate(columns), np.concatenate(rows), int(sizes.sum())
    owner = np.repeat(np.arange(len(kept)), sizes)
    theta = np.zeros(len(chosen) + 1)
    theta[-1] = np.log(max(y.mean(), 1e-4) * len(y) / n)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, rounds + 1):
        z = theta[-1] + np.bincount(row, weights=theta[column], minlength=n)
        total = np.maximum(np.add.reduceat(softplus(z), first), 1e-9)
        slope = np.where(y > 0, -1 / np.expm1(np.minimum(total, 50)), 1.0)
        g = slope[owner] / (1 + np.exp(-z))
        grad = np.append(np.bincount(column, weights=g[row], minlength=len(chosen)) + penalty * theta[:-1], g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Model({int(w): float(x) for w, x in zip(chosen, theta[:-1], strict=True) if x}, float(theta[-1]))


def train(docs: DataFrame, labels: DataFrame, may_learn: Column, sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` labelled rows for which ``may_learn`` (of doc_id) holds."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & may_learn).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # At most ``sample`` rows of two numbers: a fixed bound, so the documents stay where they are.
    joined = id_and_text(docs).join(F.broadcast(chosen), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                lists = sentences(text)
                out.append((np.array([2 * len(s) for s in lists], "<u4").tobytes(), np.array([f for s in lists for w in s for f in features(w)], "<u4").tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic").cast(pa.int32()), *(pa.array(c, pa.binary()) for c in zip(*out, strict=True))], ["doc_id", "toxic", "lengths", "words"])

    table = joined.select("doc_id", "toxic", "text").mapInArrow(run, "doc_id long, toxic int, lengths binary, words binary").toArrow()
    ids, words, lengths, toxic = table.column("doc_id").to_pylist(), table.column("words"), table.column("lengths"), table.column("toxic").to_pylist()
    order = sorted(range(table.num_rows), key=lambda k: (ids[k], len(words[k].as_buffer()), toxic[k]))  # the same whatever the partitions
    bags = [(np.frombuffer(words[k].as_buffer(), "<u4"), np.frombuffer(lengths[k].as_buffer(), "<u4")) for k in order]
    return fit(bags, np.array([toxic[k] for k in order], dtype=float))


def score(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """doc_id, score, n_sentences and the offending sentences (start, end, score) of every document.

    ``least`` is the sentence score from which a sentence counts as offending.
    """
    fields = "doc_id long, score double, n_sentences long, offending array<struct<start:int,end:int,score:double>>"
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[bytes, float] = {}
        for batch in batches:
            texts, rows = batch.column("text").to_pylist(), []
            for text in texts:
                lists = sentences(text)
                if not lists:
                    rows.append((0.0, 0, []))
                    continue
                z = model.logits(lists, cache)
                p = 1 / (1 + np.exp(-z))
                bad = np.flatnonzero(p >= least)
                where = spans(text) if len(bad) else []
                rows.append((float(-np.expm1(-softplus(z).sum())), len(lists), [{"start": where[k][0], "end": where[k][1], "score": float(p[k])} for k in bad]))
            if rows:
                a, b, c = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(a, pa.float64()), pa.array(b, pa.int64()), pa.array(c, kind)], ["doc_id", "score", "n_sentences", "offending"])

    return id_and_text(docs).mapInArrow(run, fields)


def keep_below(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """Rows of ``docs``, with all their columns, whose score is below ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[bytes, float] = {}
        for batch in batches:
            kept = []
            for text in batch.column("text").to_pylist():
                lists = sentences(text or "")
                kept.append(not lists or float(-np.expm1(-softplus(model.logits(lists, cache)).sum())) < least)
            yield batch.filter(pa.array(kept, pa.bool_()))

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)


def fold(doc_id: str = "doc_id") -> Column:
    """The remainder of the id's checksum by which rows are held out (0) or learnt from."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5


def op1_noisy_or_toxicity(spark, sf_dir: str) -> DataFrame:
    """Score of every document; labels of the held-out fifth are never read by the fit."""
    from quirelake.llm.common import documents

    docs = documents(spark, sf_dir)
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), fold() != 0)
    return score(docs, model).select(
        "doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_sentences", F.size("offending").cast("long").alias("n_offending")
    )
