"""Registered queries against their SQL on the smallest tables, and operators on hand-made rows."""

import json
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from quirelake.operators import curation, jobs
from quirelake.plans import registry
from quirelake.sources import files
from tests.conftest import SF


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"create view {name.split('.')[0]} as select * from '{SF}/{name}'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]
    frame = frame.astype(object).where(frame.notna(), None)
    return sorted(repr(tuple(float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in r)) for r in frame.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(registry.all_queries()))
def test_query_equals_its_sql(spark, duck, name):
    got = registry.all_queries()[name](spark, SF).toPandas()
    if sql := registry.all_oracles().get(name):
        assert rows(got) == rows(duck.sql(sql).df())
    else:
        assert len(got)


def test_expiry_is_strict_and_spares_protected(spark):
    w = spark.createDataFrame([("a", 480), ("b", 507), ("c", 500), ("d", 1)], "id string, mtime long")
    keep = spark.createDataFrame([("d",)], "id string")
    assert [r.id for r in jobs.expired(w, keep, F.lit(530), 30).collect()] == ["a"]


@pytest.mark.parametrize(("path", "safe"), [("../out.txt", False), ("/root/out.txt", False), ("a/../../b.txt", False), ("notes/x.txt", True), ("D:/x", False), ("v1..2/x", True)])
def test_safe_members(spark, path, safe):
    assert spark.createDataFrame([(path,)], "p string").select(jobs.safe_member(F.col("p")).alias("x")).first()["x"] is safe


def test_manifest_measures(spark):
    layers = spark.createDataFrame([("i", "base", 70), ("i", "own", 31)], "image string, digest string, size long")
    assert tuple(jobs.manifest_measures(layers, layers.where("digest = 'base'")).first()) == ("i", 101, 31, 2)


def test_checked_records(spark):
    table = "<table><tr><td>x</td></tr></table>"
    whole = {"images": ["p.png"], "id": 2**60, "share": 0.10, "messages": [{"role": "user", "content": [{"type": "image"}], "name": "n"}, {"role": "assistant", "content": table, "weight": None}, {"content": 3}], "meta": {"é": [1, {"a": False}]}}
    lines = [
        (1, json.dumps(whole, ensure_ascii=False)), (2, " "), (3, "{nope"), (4, "[1]"), (5, '{"messages":3}'), (6, '{"messages":[{"role":"user","content":"q"}]}'),
        (7, '{"messages":[{"role":"assistant"}]}'), (8, '{"messages":[1]}'), (9, None),
    ]
    got = {r.line: r for r in curation.checked_records(spark.createDataFrame(lines, "line long, value string")).collect()}
    kept = json.loads(got[1].record)
    assert got[1].error is None and "<fcel>x<nl>" in kept["messages"][1].pop("content") and list(kept) == list(whole)
    whole["messages"][1].pop("content")
    assert kept == whole and '"é"' in got[1].record
    errors = {3: "not a JSON text", 4: "not an object", 5: "no list of messages", 6: "no answer", 7: "an answer is not a text", 8: "a message is not an object"}
    assert {k: r.error for k, r in got.items() if k > 1} == errors and not any(got[k].record for k in errors)


def test_inputs_are_filtered_by_suffix(spark, tmp_path):
    for name in ("b.PDF", "a.jpg", "c.txt"):
        (tmp_path / name).write_bytes(b"x")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "d.png").write_bytes(b"x")
    assert [(r.name, r.stem, r.suffix) for r in files.list_inputs(spark, str(tmp_path)).collect()] == [("a.jpg", "a", "jpg"), ("b.PDF", "b", "pdf")]


def test_markdown_files_round_trip(spark, tmp_path):
    rows = [("0012", "# a\n\nb\n"), ("7.50", "c\n"), ("d2", "")]
    files.write_markdown(spark.createDataFrame(rows, "stem string, markdown string"), str(tmp_path / "md"))
    assert [tuple(r) for r in files.read_markdown(spark, str(tmp_path / "md")).collect()] == rows
    assert files.read_markdown(spark, str(tmp_path / "none")).count() == 0


def test_every_part_has_its_patch_positions(spark):
    got, want = {}, {}
    for r in registry.all_queries()["patch_positions"](spark, SF).collect():
        got.setdefault(r.p_partkey, []).append((r.patch, r.row, r.col))
    for r in spark.read.parquet(f"{SF}/part.parquet").collect():
        h, w = 4 + 2 * (r.p_size % 3), 6 + 2 * (r.p_size % 5)
        places = [(y + a, x + b) for y in range(0, h, 2) for x in range(0, w, 2) for a in (0, 1) for b in (0, 1)]
        want[r.p_partkey] = [(k, *p) for k, p in enumerate(places)]
    assert {k: sorted(v) for k, v in got.items()} == want


def _ends_repeated(t):
    return any(len(t) >= (n := 5 + 12 // k) * k and t.endswith(t[-k:] * n) for k in range(1, 251))


def test_repeated_endings_are_sought_in_whole_texts(spark, tmp_path):
    some = [(2, "ab cd " * 20 + "x" * 300), (3, "word %s " * 60 + "the end of it " * 9 + "c" * 50), (6, "y" * 290 + " and so on, over more than fifty characters, to its plain end"), (4, "z" * 250 + "q"), (5, "uvw" * 200), (7, None)]
    made = {2: lambda t: t, 3: lambda t: t, 0: lambda t: t + t[(i := 4) % 7 : i % 7 + 1 + i % 20] * (5 + i % 9), 1: lambda t: t + "ab" * 20 + t[:50]}
    spark.createDataFrame(some, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.whole, r.repetitive) for r in registry.all_queries()["repeated_endings"](spark, str(tmp_path)).collect()}
    want = {}
    for i, t in some:
        t = made[i % 4](t) if t else ""
        want[i] = (_ends_repeated(t), _ends_repeated(t) or len(t) > 50 and _ends_repeated(t[:-50]))
    assert want[2] == (True, True) and want[3] == (True, True) and want[6] == (False, False)
    assert got == want


def test_single_task_markdown_holds_whole_texts(spark, tmp_path):
    some = [(0, "abcdefg " * 100), (1, "né\U0001f600w\n" * 70), (2, "short"), (3, "x" * 40), (4, "x" * 41), (5, ""), (6, None)]
    spark.createDataFrame(some, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {}
    for i, t in some:
        pages = [(t or "")[k : k + 40].strip() for k in range(0, max(len(t or ""), 1), 40)]
        text = pages[0] if len(pages) == 1 else "\n\n".join(f"## Page {k + 1}\n\n{p}" for k, p in enumerate(pages)).strip()
        want[i] = text + "\n" if text else ""
    assert {r.doc_id: r.markdown for r in registry.all_queries()["single_task_markdown"](spark, str(tmp_path)).collect()} == want


def test_running_bytes_over_ranges(spark):
    """One archive with most members, one without a name, ties by name and members without a size."""
    rows = [("big", f"m{k:04d}", k % 7) for k in range(500)] + [(None, f"n{k}", 3) for k in range(20)] + [(f"a{k}", "x", k) for k in range(30)] + [("big", "z", None)]
    got = jobs.within_budget(spark.createDataFrame(rows, "archive string, member string, size long").repartition(5), "archive", "member", "size", 700).collect()
    want, sums = {}, {}
    for archive, member, size in sorted(rows, key=lambda r: (r[0] or "", r[1])):
        sums[archive] = sums.get(archive, 0) + (size or 0)
        want[archive, member] = sums[archive], sums[archive] <= 700
    assert {(r.archive, r.member): (r.running, r.fits) for r in got} == want and len(got) == len(rows)
