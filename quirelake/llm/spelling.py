"""Spelling variants: words one edit apart, found by an even-partition pigeonhole join (operator 11).

A word of length L is cut into two segments of lengths that depend on L alone, L // 2 and the rest.
Of two words one edit apart one segment of the shorter stays whole: the first at the start of the
other word, or the second at its end, moved by the difference of the lengths. So every word is
indexed under both its segments, and probes the segments of words of its own length and of one less
with its own beginning and its own, shifted, end. The edit then lies in the rest, which is cut in two
by the same rule, so that a key holds a segment and half of the rest: what meets agrees in three
quarters. It is verified by a banded edit distance inside the join, so that only links leave it; a
pair that meets at several places is taken at the first.

Cases: null and empty texts have no words; a null id is written as nothing before the colon;
repeated rows count each time; words are told apart as strings, whatever their accents; very long
texts and words are kept whole; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.llm.common import documents, materialize

#: Runs of letters; lower-casing touches A-Z alone.
RUN = r"[A-Za-zÀ-ÿ]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def slipped(doc_id: Column, run: Column, every: int) -> Column:
    """``run`` without one letter where ``every`` divides the checksum of id and run: slips as typists make them."""
    h = F.crc32(F.encode(F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), run), "UTF-8"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % every == 0, F.concat(run.substr(F.lit(1), at), run.substr(at + 2, F.length(run)))).otherwise(run)


def word_counts(docs: DataFrame, least_length: int = 5, least_count: int = 3, every: int = 97) -> DataFrame:
    """word, n: distinct words of at least ``least_length`` code points and ``least_count`` occurrences."""
    runs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.explode(F.expr(rf"regexp_extract_all(text, r'{RUN}', 0)")).alias("raw"))
    # A slip shortens a run by one letter, so shorter runs can't become words.
    long_enough = runs.where(F.length("raw") >= least_length).select("doc_id", F.translate("raw", _UPPER, _LOWER).alias("run"))
    words = long_enough.select(slipped(F.col("doc_id"), F.col("run"), every).alias("word")).where(F.length("word") >= least_length)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def _places(word: Column, size: Column) -> list[Column]:
    """What ``word`` shows at the four places where a word of length ``size`` may agree with it, one edit apart.

    The first segment stands at the beginning, the second one at the end, later by the difference of
    the lengths. Beside a segment that agrees lies the edit, so the rest is cut in two the same way.
    """
    cut, shift = F.floor(size / 2).cast("int"), F.length(word) - size
    first, second = word.substr(F.lit(1), cut), word.substr(cut + 1 + shift, size)
    found = []
    for whole, start, long in ((first, F.lit(0), cut), (second, cut, size - cut)):
        other_start, other_long = (cut, size - cut) if whole is first else (F.lit(0), cut)
        half = F.floor(other_long / 2).cast("int")
        found += [F.concat(whole, word.substr(other_start + 1, half)), F.concat(whole, word.substr(other_start + half + 1 + shift, other_long - half))]
    return found


def _listed(places: list[Column]) -> Column:
    return F.inline(F.array(*[F.struct(F.lit(k).alias("place"), p.alias("segment")) for k, p in enumerate(places)]))


def near_words(words: DataFrame) -> DataFrame:
    """word, n, other, other_n: every unordered pair of words one edit apart, once (``words`` has word and n, words distinct)."""
    word, other, size = F.col("word"), F.col("other"), F.col("size")
    indexed = words.withColumn("size", F.length("word")).select("word", "n", "size", _listed(_places(word, size)))
    asked = words.select(word.alias("other"), F.col("n").alias("other_n"), F.explode(F.array(F.length("word"), F.length("word") - 1)).alias("size")).where("size > 0")
    probes = asked.select("other", "other_n", "size", _listed(_places(other, size)))
    once = (F.length("other") > size) | (word < other)
    here = [x == y for x, y in zip(_places(word, size), _places(other, size), strict=True)]
    met_before = F.lit(False)
    for k in range(1, len(here)):
        met_before = F.when(F.col("place") >= k, met_before | here[k - 1]).otherwise(met_before)
    pair = indexed.hint("merge").join(probes, ["size", "place", "segment"])
    return pair.where(once & (F.levenshtein("word", "other", 1) == 1) & ~met_before).select("word", "n", "other", "other_n")


def with_roots(forms: DataFrame) -> DataFrame:
    """word, root: the end of the chain of forms (``forms`` has word and form, never null, without circles).

    Each round every word looks up the target of its target, so chains halve; they are no longer
    than the logarithm of the largest count, as every form is twice as frequent at least.
    """
    now = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = materialize(now.join(further.hint("merge"), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if not now.where("moved").limit(1).count():
            return now.select("word", "root")
        now = now.select("word", "root")


def spelling_groups(words: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n for a table of distinct words and their counts."""
    words = materialize(words.select("word", "n"), "words")
    pairs = near_words(words)
    # Either end is summed up before it is shuffled; the smaller word wins among equal counts.
    end = lambda word, n, other, other_n: F.struct(F.col(word).alias("word"), F.col(n).alias("n"), F.struct((-F.col(other_n)).alias("less"), F.col(other).alias("name")).alias("best"))
    ends = pairs.select(F.inline(F.array(end("word", "n", "other", "other_n"), end("other", "other_n", "word", "n"))))
    best = ends.groupBy("word", "n").agg(F.count(F.lit(1)).alias("n_near"), F.min("best").alias("best")).select("word", "n", "n_near", (-F.col("best.less")).alias("best_n"), F.col("best.name").alias("best"))
    found = materialize(best.select("word", "n_near", *[F.when(F.col("best_n") >= 2 * F.col("n"), F.col(c)).alias(a) for c, a in (("best", "form"), ("best_n", "form_n"))]), "near-words")
    roots = with_roots(found.where("form is not null"))
    named = words.join(found.hint("merge"), "word", "left").join(roots.hint("merge"), "word", "left")
    return named.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")


def op11_pigeonhole_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with their near words, forms and roots."""
    return spelling_groups(word_counts(documents(spark, sf_dir)))
