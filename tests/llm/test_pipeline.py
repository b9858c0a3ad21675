"""The stages one after another against brute-force checks of each on its own input."""

from collections import Counter

import pytest

import corpus_pipeline
from quirelake.llm.common import materialize
from tests.conftest import SF
from tests.llm.test_operators import BWORD, WORD, groups, lowered, order


@pytest.fixture(scope="module")
def results(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.unionByName(docs.limit(3)).unionByName(docs.limit(1).selectExpr("cast(null as long) doc_id", "cast(null as string) text", "lang", "source", "n_chars"))
    out = [("input", docs)]
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF), name)
        out.append((name, docs))
    return dict(out)


def rows(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


def test_stages_are_the_agreed_ones(results):
    assert list(results) == ["input", "toxicity", "line_dedup", "near_duplicates", "decontamination", "packing"]
    for name in ("toxicity", "line_dedup", "near_duplicates", "decontamination"):
        assert results[name].columns == results["input"].columns


def test_toxic_documents_go_and_others_stay(spark, results):
    kept, labels = rows(results["toxicity"]), {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    gone = rows(results["input"]) - kept
    assert not kept - rows(results["input"])
    assert gone and all(labels.get(i, 1) == 1 for i, _ in gone)


def test_later_copies_of_lines_go(results):
    """The rule restated: a line goes if it lies in the shortest stretch of eight words that starts earlier as well."""
    before = [(r.doc_id, r.text) for r in results["toxicity"].collect()]

    def stretches(t):
        own = [(k, x, len(WORD.findall(x))) for k, x in enumerate((t or "").split("\n")) if WORD.search(x)]
        for a in range(len(own)):
            total = 0
            for b in range(a, len(own)):
                total += own[b][2]
                if total >= 8:
                    yield a, tuple(x for _, x, _ in own[a : b + 1]), [k for k, _, _ in own[a : b + 1]]
                    break

    first = {}
    for i, t in before:
        for a, key, _ in stretches(t):
            at = (order(i), a)
            first[key] = min(first.get(key, at), at)
    want = Counter()
    for i, t in before:
        gone = {k for a, key, own in stretches(t) if first[key] < (order(i), a) for k in own}
        lines = (t or "").split("\n")
        left = [x for k, x in enumerate(lines) if k not in gone]
        if not gone or any(WORD.search(x) for x in left):
            want[i, "\n".join(left) if gone else t] += 1
    assert rows(results["line_dedup"]) == want
    assert all(r.n_chars == len(r.text) for r in results["line_dedup"].join(results["toxicity"].select("doc_id", results["toxicity"].text.alias("was")), "doc_id").where("text <> was").collect())


def test_one_of_each_group_stays(results):
    before = [(r.doc_id, r.text) for r in results["line_dedup"].collect()]
    seen, want = set(), Counter()
    for (i, t), (_, n, group) in sorted(zip(before, groups(before), strict=True), key=lambda r: (r[0][0] is not None, r[0][0] or 0)):
        if not n or group not in seen:
            want[i, t] += 1
        if n:
            seen.add(group)
    assert rows(results["near_duplicates"]) == want


def test_unlike_texts_of_one_id_stay_apart(spark):
    unlike = [" ".join(f"{w}{k}" for k in range(30)) for w in ("ant", "bee", "cow", "dog", "elk")]
    some = [(None, unlike[0]), (None, unlike[1]), (7, unlike[2]), (7, unlike[3]), (8, unlike[3] + " more"), (9, unlike[4])]
    docs = spark.createDataFrame(some, "doc_id long, text string")
    got = rows(corpus_pipeline.keep_one_of_each_group(spark, docs, SF))
    assert got == Counter(r for r in some if r[0] != 8)


def test_benchmark_text_goes(spark, results):
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = BWORD.findall(lowered(r.text or ""))
        windows |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9)) if w}
    sizes = {len(w) for w in windows}

    def dirty(t):
        w = BWORD.findall(lowered(t or ""))
        return any(tuple(w[k : k + n]) in windows for n in sizes for k in range(len(w) - n + 1))

    want = Counter({k: n for k, n in rows(results["near_duplicates"]).items() if not dirty(k[1])})
    assert rows(results["decontamination"]) == want


def test_everything_left_is_packed(results):
    ids = Counter(r.doc_id for r in results["decontamination"].collect())
    assert Counter(r.doc_id for r in results["packing"].collect() if r.piece == 0) == ids


def test_run_gives_the_same_rows(spark, results):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == results["packing"].columns and got.count() > 0


def test_stages_take_empty_tables_odd_rows_and_any_columns(spark, results, odd_docs, no_docs):
    for docs, any_left in ((no_docs, False), (odd_docs, True)):
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            docs = materialize(stage(spark, docs, SF), name)
            assert name == "packing" or docs.columns == columns
            assert (docs.count() > 0) is any_left
