"""Spelling variants, clusters and near vectors against brute force, on odd and on empty tables."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirelake.llm import centroids, spelling, vectors

LETTERS = {chr(c) for c in [*range(65, 91), *range(97, 123), *range(0xC0, 0x100)]}


def letter_runs(text):
    run = ""
    for c in [*text, " "]:
        if c in LETTERS:
            run += c
        elif run:
            yield run
            run = ""


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def grouped(counts):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    forms = {w: min(near[w], key=lambda v: (-counts[v], v.encode())) for w in counts if near[w]}
    forms = {w: f for w, f in forms.items() if counts[f] >= 2 * counts[w]}
    out = {}
    for w, n in counts.items():
        root = w
        while root in forms:
            root = forms[root]
        out[w] = (forms.get(w), root, n, len(near[w]), counts.get(forms.get(w)))
    return out


def test_spelling_groups_of_odd_texts(spark, odd_docs, no_docs, texts):
    counts = Counter()
    for i, t in texts:
        for run in letter_runs(t or ""):
            run = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    want = grouped({w: n for w, n in counts.items() if len(w) >= 5 and n >= 3})
    got = {r[0]: tuple(r[1:]) for r in spelling.spelling_groups(spelling.word_counts(odd_docs)).collect()}
    assert got == want and any(r[0] for r in want.values())
    assert spelling.spelling_groups(spelling.word_counts(no_docs)).collect() == []


def test_spelling_groups_of_all_short_words(spark):
    """Every kind of edit at every place, chains of forms, ties, words of one letter and letters beyond ASCII."""
    rnd = random.Random(3)
    counts = {"".join(rnd.choice("abé") for _ in range(rnd.randint(1, 5))): rnd.choice([1, 2, 2, 4, 9, 20]) for _ in range(400)}
    table = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert {r[0]: tuple(r[1:]) for r in spelling.spelling_groups(table).collect()} == grouped(counts)
    assert "BroadcastNestedLoopJoin" not in (plan := spelling.near_words(table)._jdf.queryExecution().toString()) and "Cartesian" not in plan


def test_chains_of_forms_end_at_the_most_frequent(spark):
    chain = [("a" * 5 + "b" * k + "c" * (20 - k), 2**k) for k in range(21)]
    got = spelling.spelling_groups(spark.createDataFrame(chain, "word string, n long")).collect()
    assert {r["root"] for r in got} == {"a" * 5 + "b" * 20}


VECTORS = "vec_id long, embedding array<double>, label int, own int, total long, h1 long, v string, n long, distance long"


def table_of(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, "v", 4, 5) for r in rows], VECTORS).repartition(3)


@pytest.fixture(scope="module")
def odd_vectors():
    rnd = np.random.default_rng(5)
    base = rnd.normal(size=(30, 64))
    rows = [(i, (v / np.linalg.norm(v)).tolist(), i % 3) for i, v in enumerate(base)]
    rows += [(100 + i, (base[i % 5] + rnd.normal(size=64) * 0.14 * rnd.random()).tolist(), i % 5 % 3) for i in range(60)]
    rows += [(200 + i, rows[2][1], 2) for i in range(40)] + [(300, rows[2][1], 1), rows[3], rows[3], (3, rows[7][1], 1)]
    rows += [(400, [x * 1e-200 for x in rows[2][1]], 2), (401, [-x for x in rows[2][1]], 2), (402, [1e300] * 64, 0), (403, [1e300] * 64, 0)]
    rows += [(500, None, 0), (501, [], 0), (502, [0.0] * 64, 0), (503, [*rows[0][1][:63], None], 0), (504, [float("nan")] * 64, 0), (505, [float("inf"), *rows[0][1][:63]], 0)]
    rows += [(506, rows[2][1], None), (507, None, None), (None, rows[4][1], 1), (None, base[9].tolist(), 0), (508, rows[2][1][:32], 2), (509, rows[2][1][:32], 2)]
    return rows


def test_clusters_equal_plain_rounds(spark, odd_vectors):
    fit = [(i, [int(np.floor(np.clip(1024 * x, -(2.0**27), 2.0**27))) for x in v]) for i, v, _ in odd_vectors if v and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    for k, rounds in ((8, 10), (3, 1), (1, 2), (2, 0)):
        order = sorted(fit, key=lambda r: (hashlib.sha256(f"3:{'null' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
        at = [v for _, v in order[:k]]
        for r in range(rounds + 1):
            distances = [[sum((x - y) ** 2 for x, y in zip(v, c, strict=True)) for c in at] for _, v in fit]
            own = [d.index(min(d)) for d in distances]
            for j in range(k) if r < rounds else ():
                mine = [v for (_, v), o in zip(fit, own, strict=True) if o == j]
                at[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)] if mine else at[j]
        sums = Counter()
        for d, o in zip(distances, own, strict=True):
            sums[o] += d[o]
        want = Counter((i, o, d[o], sums[o], sum(sums.values()), hashlib.sha256(",".join(map(str, at[o])).encode()).hexdigest()) for (i, _), d, o in zip(fit, distances, own, strict=True))
        seed = F.sha2(F.concat(F.lit("3:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("null"))), 256)
        got = centroids.clusters(centroids.integer_vectors(table_of(spark, odd_vectors), "vec_id", "embedding", 64, 1024), k, rounds, [seed, F.col("v")]).drop("seen").collect()
        assert Counter(map(tuple, got)) == want
    empty = table_of(spark, odd_vectors[:0])
    assert centroids.clusters(centroids.integer_vectors(empty, "vec_id", "embedding", 64, 1024), 8, 10, [F.col("v")]).collect() == []


def test_exponion_search_keeps_ties_and_skips_work():
    """A grid of small integers is full of ties; well parted groups leave most centroids unseen."""
    grid = np.array([(x, y) for x in range(-6, 7) for y in range(-6, 7)], dtype=np.int64)
    parted = np.concatenate([np.random.default_rng(1).integers(-9, 10, (300, 2)) + (1000 * k, 700 * (k % 3)) for k in range(12)])
    for points, k, limit in ((grid, 6, 1.01), (parted, 12, 0.5)):
        at, before, state, work = points[:: len(points) // k][:k].copy(), None, None, 0
        for r in range(8):
            now = centroids.Centroids(at, before)
            *state, seen = now.first(points) if state is None else now.search(points, *state)
            assert (state[0] == np.stack([centroids.squared(points, c) for c in at], axis=1).argmin(axis=1)).all()
            work += seen.sum() if r else 0
            before, at = at, np.array([points[state[0] == j].sum(axis=0) // max(1, (state[0] == j).sum()) if (state[0] == j).any() else at[j] for j in range(k)])
        assert work <= limit * 7 * k * len(points)


def links_by_force(rows, least=0.98):
    units = {}
    for p, (_, v, label) in enumerate(rows):
        if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v) / np.abs(v).max()
            units[p] = x / np.linalg.norm(x)
    linked = defaultdict(set)
    for p in units:
        for q in units:
            if p != q and rows[p][2] == rows[q][2] and len(units[p]) == len(units[q]) and units[p] @ units[q] >= least:
                linked[p].add(q)
    out = []
    for p, (i, _, _) in enumerate(rows):
        seen, todo = {p}, [p]
        while todo:
            new = linked[todo.pop()] - seen
            seen |= new
            todo += new
        first = min((rows[q][0] for q in seen), key=lambda x: -(2**63) if x is None else x)
        out.append((i, len(linked[p]), first, i == first))
    return Counter(out)


def test_near_vectors_of_an_odd_table(spark, odd_vectors):
    got = vectors.near_vectors(table_of(spark, odd_vectors)).collect()
    assert Counter(map(tuple, got)) == links_by_force(odd_vectors)
    for few in (odd_vectors[:0], odd_vectors[:1], [r for r in odd_vectors if r[0] and 500 <= r[0] < 508]):
        assert Counter(map(tuple, vectors.near_vectors(table_of(spark, few)).collect())) == links_by_force(few)


def test_hot_buckets_lose_no_link(spark, monkeypatch):
    """One dense group that fills its buckets, cut into blocks of eight."""
    monkeypatch.setattr(vectors, "BLOCK", 8)
    rnd = np.random.default_rng(8)
    centre = rnd.normal(size=64)
    rows = [(i, (centre + 0.1 * rnd.normal(size=64)).tolist(), 1) for i in range(90)] + [(1000 + i, rnd.normal(size=64).tolist(), 1) for i in range(200)]
    for most in (100_000, 0):
        monkeypatch.setattr(vectors, "MOST_HOT", most)
        assert Counter(map(tuple, vectors.near_vectors(table_of(spark, rows)).collect())) == links_by_force(rows)


def test_recall_at_the_threshold(spark):
    """Pairs at a cosine of just over 0.98, many labels deep; at least 0.99 of them are found, and nothing else."""
    rnd = np.random.default_rng(9)
    units = vectors.unit(rnd.normal(size=(2000, 64)))
    near = vectors.neighbours(units, 0.9801, rnd)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(np.concatenate([units, near]))]
    got = {r["vec_id"]: r["component_id"] for r in vectors.near_vectors(table_of(spark, rows)).collect()}
    assert sum(got[i + 2000] == i for i in range(2000)) >= 0.99 * 2000
    assert all(c in (i, i % 2000) for i, c in got.items())


def test_few_components_need_shorter_substrings(spark):
    angles = np.random.default_rng(4).random(300) * 2 * np.pi
    rows = [(i, [float(np.cos(a)), float(np.sin(a))], 0) for i, a in enumerate(angles)]
    got = Counter(map(tuple, vectors.near_vectors(table_of(spark, rows)).collect()))
    want = links_by_force(rows)
    assert sum(n for _, n, _, _ in got) >= 0.99 * sum(n for _, n, _, _ in want)


def test_rotation_lowers_the_loss_of_signs():
    turned = np.random.default_rng(2).normal(size=(500, 8)) * np.linspace(1, 3, 8)
    turned -= turned.mean(axis=0)
    loss = lambda r: ((np.where(turned @ r >= 0, 1, -1) - turned @ r) ** 2).sum()
    rotations = [vectors.learned_rotation(turned, np.random.default_rng(6), n) for n in (0, 1, 5, 30)]
    assert all(np.allclose(r @ r.T, np.eye(8)) for r in rotations)
    assert [loss(r) for r in rotations] == sorted((loss(r) for r in rotations), reverse=True)
