"""Each operator on a small odd table against a brute-force version, and on an empty one."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quirelake.llm import components, decontaminate, jaccard, lines, packing, planes, quality, runs, sharding, substrings, superkmers, toxicity
from quirelake.llm.common import fresh_path
from quirelake.llm.tokens import ChunkEncoder

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(t):
    return t.translate({c: c + 32 for c in range(65, 91)})


def order(i):
    return -(2**63) if i is None else i


def test_sharding_counts_and_slots(spark, odd_docs, no_docs):
    from pyspark.sql import functions as F

    for rows in (odd_docs, no_docs):
        placed = sharding.bounded_ring(rows, F.col("doc_id"), shards=8, order_by=[F.col("doc_id"), F.col("text")])
        assert placed.select("row.*").columns == rows.columns  # whatever their names
        got = placed.collect()
        slots = defaultdict(list)
        for r in got:
            slots[r.shard].append(r.slot)
        assert len(got) == rows.count() and all(sorted(s) == list(range(len(s))) for s in slots.values())
        counts = [len(slots[s]) for s in range(8)]
        assert max(counts) - min(counts) <= 1


def test_ring_moves_little_with_slack():
    order8, order9 = sharding.ring_points(8, 64, 512), sharding.ring_points(9, 64, 512)
    counts = {c: 100 for c in range(512)}
    a, b = (dict(((c, r), s) for c, lo, hi, _, s, _ in sharding.walk(counts, o, sharding.capacities(51200, n, 0.25)) for r in range(lo, hi)) for o, n in ((order8, 8), (order9, 9)))
    assert sum(a[k] != b[k] for k in a) < 0.3 * len(a)


def test_walk_matches_inserting_keys_one_by_one():
    rnd = np.random.default_rng(2)
    order = sharding.ring_points(5, 16, 64)
    counts = Counter(rnd.integers(0, 64, 1000).tolist())
    room = sharding.capacities(1000, 5, 0.0)
    got = {(c, r): s for c, lo, hi, _, s, _ in sharding.walk(counts, order, room) for r in range(lo, hi)}
    left = list(room)
    for cell in range(64):
        for r in range(counts[cell]):
            s = next(s for s in order[cell] if left[s])
            left[s] -= 1
            assert got[cell, r] == s


@pytest.mark.parametrize(("name", "spaced", "kind"), [("byte_bpe_50k.json", True, "<u4"), ("word_bpe_49k.json", False, "<u2")])
def test_chunks_encode_like_whole_texts(texts, name, spaced, kind):
    whole = Tokenizer.from_file(public_tokenizers.path(name))
    some = [t or "" for _, t in texts] + ["a  b\n\n c \x1c d. \x1d\x85 e f\t\tg  ", "<|endoftext|> x<|endoftext|>y", "ΑΣ İx, é ́x 3²½ don't we'll DON'T 's　x​z", "x\r\ny\x0b\x0cz", "ÀÉ. Œuf ŒUF"]
    for t, ids in zip(some, ChunkEncoder(public_tokenizers.path(name), spaced, kind).encode(some), strict=True):
        assert np.frombuffer(ids, kind).tolist() == whole.encode(t, add_special_tokens=False).ids


def test_packing_is_whole_and_tight(spark, odd_docs, no_docs, texts):
    path = public_tokenizers.path("byte_bpe_50k.json")
    whole = Tokenizer.from_file(path)
    want = Counter()
    for i, t in texts:
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 2]
        first = (len(ids) - 1) % 1024 + 1
        for k, s in enumerate([0, *range(first, len(ids), 1024)]):
            n = first if k == 0 else 1024
            want[i, k, s, n, zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes())] += 1
    got = packing.pack(odd_docs, path).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(places) <= -(-sum(r.length for r in got) // 1024) + 1
    assert packing.pack(no_docs, path).count() == 0


def best_fit_decreasing(lengths, capacity):
    gaps = []
    for size in sorted(lengths, reverse=True):
        fit = [g for g in gaps if g >= size]
        g = min(fit) if fit else capacity
        if fit:
            gaps.remove(g)
        gaps.append(g - size)
    return len(gaps)


@pytest.mark.parametrize("top", [100, 40, 3, 1])
def test_supersteps_pack_like_best_fit_decreasing(spark, top):
    lengths = np.random.default_rng(4).integers(1, top + 1, 900).tolist()
    pieces = spark.createDataFrame(list(enumerate(lengths)), "piece_no long, length long")
    small = packing.best_fit(pieces, 100).collect()
    assert sorted(r.piece_no for r in small) == [k for k, n in enumerate(lengths) if n <= 50]
    loads = Counter({k: n for k, n in enumerate(lengths) if n > 50})
    for r in small:
        loads[r.sequence_id] += lengths[r.piece_no]
    assert max(loads.values()) <= 100
    assert len(loads) <= 1.03 * best_fit_decreasing(lengths, 100) + 1


def test_ranges_meet_by_rank():
    rnd = np.random.default_rng(8)
    waiting, free = {k: int(rnd.integers(0, 9)) for k in range(30)}, {k: int(rnd.integers(0, 9)) for k in range(30)}
    taken = defaultdict(set)
    for a, first, b, slot, n in packing.across_ranges(waiting, free):
        assert a < b and first + n <= waiting[a] and slot + n <= free[b] and n > 0
        for k in range(n):
            assert first + k not in taken["piece", a] and slot + k not in taken["slot", b]
            taken["piece", a].add(first + k)
            taken["slot", b].add(slot + k)
    stack = met = 0
    for k in range(30):
        use = min(stack, free[k])
        met, stack = met + use, stack - use + waiting[k]
    assert sum(len(v) for (kind, _), v in taken.items() if kind == "piece") == met


def test_planes_round_trip(spark, odd_docs, no_docs, texts):
    path = public_tokenizers.path("word_bpe_49k.json")
    whole, start, want = Tokenizer.from_file(path), 0, []
    for i, t in sorted(((i, t or "") for i, t in texts), key=lambda r: (order(r[0]), r[1].encode())):
        ids = [*whole.encode(t, add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    for kind in (8, 1):
        folder = fresh_path(spark, "planes-test")
        got = planes.read_back(planes.write_planes(odd_docs, path, folder, keeps_space=False, kind=kind), folder).collect()
        assert sorted((r.start, *r) for r in got) == sorted((w[1], *w) for w in want)
    folder = fresh_path(spark, "planes-test")
    assert planes.read_back(planes.write_planes(no_docs, path, folder, keeps_space=False), folder).count() == 0


def test_quality_counts(spark, odd_docs, no_docs, texts):
    want = Counter()
    for i, t in texts:
        t = t or ""
        w = WORD.findall(t)
        windows = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        covered = {x for k in range(len(w) - 7) if windows[tuple(w[k : k + 8])] > 1 for x in range(k, k + 8)}
        full = [x for x in t.split("\n") if WORD.search(x)]
        want[i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(full) - len(set(full)), len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w)] += 1
    got = quality.quality_rules(odd_docs).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    assert not any(r.kept and r.base_failed for r in got)
    assert quality.quality_rules(no_docs).count() == 0


def test_quality_bands_reject_what_repeats_or_is_noise():
    import base64

    verdict = quality.Compressor(quality.Bands()).verdict
    assert not verdict(b"all work and no play " * 300)[3]
    assert not verdict(base64.b85encode(np.random.default_rng(1).bytes(6000)))[3]
    assert not verdict(b"")[3]


def test_quality_bands_reach_the_last_byte():
    import base64

    rnd = np.random.default_rng(3)
    syllables = "ab ce di fo gu ha je ki lo mu na pe qui ro su ta ve wi xo yu za".split()
    lexicon = ["".join(rnd.choice(syllables, rnd.integers(1, 5))) for _ in range(6000)]
    data = " ".join(rnd.choice(lexicon, 6000)).encode()
    noise = base64.b85encode(rnd.bytes(1600))
    verdict = quality.Compressor(quality.Bands()).verdict
    for clean in (data[: 10 * 2048], data[: 2048 + 2000]):
        assert verdict(clean)[3]
        full = clean[: len(clean) // 2048 * 2048]
        _, _, high, kept = verdict(full + noise)
        assert high > 0.66 and not kept
        _, low, _, kept = verdict(full + b"na " * 660)
        assert low < 0.445 and not kept


@pytest.mark.parametrize("hot", [2000, 2])
def test_window_removal(spark, odd_docs, no_docs, texts, monkeypatch, hot):
    monkeypatch.setattr(runs, "HOT", hot)
    first = {}
    split = [(order(i), (t or "").encode().split()) for i, t in texts]
    for i, w in split:
        for k in range(len(w) - 49):
            key = tuple(w[k : k + 50])
            first[key] = min(first.get(key, i), i)
    want = Counter()
    for (i, _), (doc, w) in zip(texts, split, strict=True):
        gone = {x for k in range(len(w) - 49) if first[tuple(w[k : k + 50])] < doc for x in range(k, k + 50)}
        want[i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()] += 1
    got = superkmers.remove_repeated_windows(odd_docs).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.text) for r in got) == want
    assert sum(r.n_removed for r in got) > 500
    assert superkmers.remove_repeated_windows(no_docs).count() == 0


@pytest.mark.parametrize("hot", [2000, 2])
def test_string_removal(spark, odd_docs, no_docs, texts, monkeypatch, hot):
    monkeypatch.setattr(runs, "HOT", hot)
    first = {}
    data = [(order(i), (t or "").encode()) for i, t in texts]
    for i, b in data:
        for k in range(len(b) - 99):
            first[b[k : k + 100]] = min(first.get(b[k : k + 100], (i, k)), (i, k))
    want = Counter()
    for (i, _), (doc, b) in zip(texts, data, strict=True):
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - 99):
            if first[b[k : k + 100]] < (doc, k):
                gone[k : k + 100] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        want[i, len(b), int(gone.sum()), spans, bytes(x for k, x in enumerate(b) if not gone[k])] += 1
    got = substrings.remove_repeated_strings(odd_docs).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in got) == want
    assert substrings.remove_repeated_strings(no_docs).count() == 0


def test_suffix_order_matches_sorting():
    rnd = np.random.default_rng(7)
    some = [bytes(rnd.choice([97, 98], int(rnd.integers(0, 13))).tolist()) for _ in range(12)]
    string, length, transform = substrings.suffix_order(np.frombuffer(b"".join(some), np.uint8), np.cumsum([0, *map(len, some)]))
    want = sorted(((s[len(s) - n :], i, n) for i, s in enumerate(some) for n in range(len(s) + 1)), key=lambda r: r[0])
    assert [some[i][len(some[i]) - n :] for i, n in zip(string, length, strict=True)] == [w[0] for w in want]
    assert all(t == (some[i][len(some[i]) - n - 1] + 1 if n < len(some[i]) else 0) for i, n, t in zip(string, length, transform, strict=True))


def shingles(t):
    w = WORD.findall(lowered(t or ""))
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def groups(rows):
    """Least id reachable for each row, over all pairs."""
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
                root[max(find(a), find(b))] = min(find(a), find(b))
    least = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        least[find(k)].append(order(i))
    ids = [min(least[find(k)]) for k in range(len(rows))]
    return [(i, len(s), None if m == -(2**63) else m) for (i, _), s, m in zip(rows, sets, ids, strict=True)]


@pytest.mark.parametrize(("block", "exact"), [(2000, False), (3, False), (3, True), (2000, True)])
def test_similarity_components(spark, odd_docs, no_docs, texts, monkeypatch, block, exact):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    got = jaccard.similarity_components(odd_docs, exact=exact).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == Counter(groups(texts))
    assert jaccard.similarity_components(no_docs, exact=exact).count() == 0


def test_words_of_doubling_patterns_stay_apart(spark):
    """A polynomial hash modulo 2**64 takes such words for equal from some length on."""
    a, b = "a", "b"
    while len(a) < 2048:
        a, b = a + b, b + a
        if len(a) in (8, 64, 256, 512, 1024, 2048):
            data = f"{a} {b}".encode()
            one, two = runs.word_symbols(np.frombuffer(data, np.uint8), np.array([0, len(data)]))[0].tolist()
            assert one != two
    words = prose_words(60)
    docs = spark.createDataFrame([(1, " ".join([*words[:30], a, *words[30:]])), (2, " ".join([*words[:30], b, *words[30:]]))], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in superkmers.remove_repeated_windows(docs, window=40, gram=4).collect()} == {1: 0, 2: 0}
    short = spark.createDataFrame([(1, " ".join([*words[:2], a, *words[2:4]])), (2, " ".join([*words[:2], b, *words[2:4]]))], "doc_id long, text string")
    assert {r.component_id for r in jaccard.similarity_components(short).collect()} == {1, 2}


def prose_words(n):
    rnd = np.random.default_rng(21)
    return ["".join(rnd.choice(list("abcdefgh"), 6)) for _ in range(n)]


@pytest.mark.parametrize("crossing", [False, True])
def test_trees_lose_no_link(crossing):
    rnd = np.random.default_rng(9)
    sets = []
    for _ in range(25):
        base = rnd.integers(0, 2**63, int(rnd.integers(1, 300)), dtype=np.uint64)
        sets += [np.unique(np.concatenate([base[: len(base) - k], rnd.integers(0, 2**63, k, dtype=np.uint64)])) for k in (0, 1, len(base) // 9, len(base) // 5, len(base) // 8, len(base) // 7)]
    sides = [int(rnd.integers(0, 2)) if crossing else 0 for _ in sets]
    found = jaccard.tree_links(sets, sides, 75)
    links = {(a, b) for b in range(len(sets)) for a in range(b) if jaccard.linked(len(sets[a]), len(sets[b]), len(np.intersect1d(sets[a], sets[b])), 75) and (not crossing or sides[a] != sides[b])}
    assert links and {(min(p), max(p)) for p in found} <= links and len(found) < len(sets)
    root = list(range(len(sets)))

    def find(k):
        return k if root[k] == k else find(root[k])

    for p, q in found:
        root[find(p)] = find(q)
    assert all(find(p) == find(q) for p, q in links)


def test_large_group_of_near_copies_gives_links_in_proportion():
    rnd = np.random.default_rng(12)
    base = rnd.integers(0, 2**63, 150, dtype=np.uint64)
    sets = []
    for _ in range(400):
        own = base.copy()
        own[rnd.random(150) < rnd.random() * 0.3] = 0
        own = np.where(own == 0, rnd.integers(0, 2**63, 150, dtype=np.uint64), own)
        sets.append(np.unique(own))
    assert len(jaccard.tree_links(sets, [0] * len(sets), 75)) < 400


def test_components_of_chains(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 200), (200, 150), (7, 7)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 150: 100, 200: 100}


def test_a_tree_holds_its_bitmaps_packed():
    """Sets of a wide bitmap are not spread out to a byte per bit all at once."""
    import tracemalloc

    rnd, width = np.random.default_rng(3), 1 << 16
    sets = [np.unique(rnd.integers(0, 2**63, 300, dtype=np.uint64)) for _ in range(200)]
    tracemalloc.start()
    tree = jaccard.Tree(list(range(200)), sets, width)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 200 * width / 3
    for row, k in enumerate(tree.members):
        places = {int(x) % width for x in sets[k]}
        assert set(np.flatnonzero(np.unpackbits(tree.bits[0][row].view(np.uint8))).tolist()) == places and tree.excess[0][row] == len(sets[k]) - len(places)


def test_intervals_of_the_suffix_array(spark):
    """Intervals with common prefixes of 1 to 3 lines, in ranges whose borders fall inside of them."""
    rows = sorted({(a, b, c) for a in (-7, 2, 9) for b in range(-3, 9) for c in range(-2, 20) if (a * 5 + b * 3 + c) % 4})
    want = {10 * r: [10 * next(q for q in range(len(rows)) if rows[q][:k] == ids[:k]) for k in (1, 2, 3)] for r, ids in enumerate(rows)}
    frame = spark.createDataFrame([(10 * r, list(ids)) for r, ids in enumerate(rows)], "rank long, ids array<long>").repartition(3)
    sizes = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled"), spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
        assert {r["rank"]: r.heads for r in lines.common_intervals(frame, 3).collect()} == want
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", sizes[0])
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", sizes[1])
    assert lines.common_intervals(frame.limit(0), 3).count() == 0


def test_line_removal(spark, odd_docs, no_docs, texts):
    def full(t):
        return [(k, x) for k, x in enumerate((t or "").split("\n")) if WORD.search(x)]

    def runs_of(own):
        for a in range(len(own)):
            n = 0
            for b in range(a, len(own)):
                n += len(WORD.findall(own[b][1]))
                if n >= 8:
                    yield a, b, tuple(x for _, x in own[a : b + 1])
                    break

    first = {}
    for i, t in texts:
        for a, _, key in runs_of(full(t)):
            first[key] = min(first.get(key, (order(i), a)), (order(i), a))
    want = Counter()
    for i, t in texts:
        own = full(t)
        gone = {own[k][0] for a, b, key in runs_of(own) if first[key] < (order(i), a) for k in range(a, b + 1)}
        left = None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone)
        want[i, left, len(own), len(gone)] += 1
    got = lines.remove_repeated_lines(odd_docs)
    assert got.select("row.*").columns == odd_docs.columns
    assert Counter((r.row.doc_id, r.row.text, r.n_lines, r.n_removed) for r in got.collect()) == want
    assert lines.remove_repeated_lines(no_docs).count() == 0


BENCH = "item_id long, text string, extra int"
BWORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@pytest.mark.parametrize(("block", "terms"), [(50_000, 200_000), (5, 200_000), (5, 5)])
def test_contamination(spark, odd_docs, no_docs, texts, monkeypatch, block, terms):
    monkeypatch.setattr(decontaminate, "BLOCK", block)
    monkeypatch.setattr(decontaminate, "MOST_TERMS", terms)
    some = [(1, texts[40][1][60:260]), (2, texts[40][1][100:300]), (3, "ONE"), (4, None), (5, " .,; "), (None, texts[3][1]), (7, "nowhere to be found in any of these"), (8, "ab ab ab ab ab ab ab ab ab ab ab"), (1, texts[40][1][60:260])]
    found = defaultdict(set)
    for item, t in some:
        w = BWORD.findall(lowered(t or ""))
        for k in range(max(1, len(w) - 9) if w else 0):
            found[tuple(w[k : k + 10])].add(item)
    sizes = {len(k) for k in found}
    want = Counter()
    for i, t in texts:
        w, hit, items = BWORD.findall(lowered(t or "")), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (key := tuple(w[k : k + n])) in found:
                    hit.update(range(k, k + n))
                    items |= found[key]
        listed = sorted(str(x) for x in items if x is not None)
        want[i, len(w), len(hit), tuple(listed), bool(hit)] += 1
    bench = spark.createDataFrame([(*r, 0) for r in some], BENCH)
    got = decontaminate.contamination(odd_docs, bench).collect()
    assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(r.item_ids), r.contaminated) for r in got) == want
    assert sum(r.contaminated for r in got) > 10
    clean = decontaminate.contamination(odd_docs, bench.where("false")).collect()
    assert len(clean) == len(texts) and not any(r.contaminated for r in clean)
    assert decontaminate.contamination(no_docs, bench).count() == 0


def test_near_matches_are_told_from_phrases(spark):
    bench = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa", 0)], BENCH)
    docs = spark.createDataFrame([(1, "x alpha beta gamma delta epsilon zeta eta theta iota kappa y"), (2, "x beta alpha gamma delta epsilon zeta eta theta iota kappa y"), (3, "alpha beta")], "doc_id long, text string")
    got = {r.doc_id: (r.n_hit, r.n_near) for r in decontaminate.contamination(docs, bench).collect()}
    assert got == {1: (10, 0), 2: (0, 1), 3: (0, 0)}


def test_toxicity_learns_sentences_from_documents(spark, no_docs):
    rnd = np.random.default_rng(3)
    vocabulary = ["".join(rnd.choice(list("abcdefgh"), 5)) for _ in range(400)]
    rows, labels = [], []
    for i in range(600):
        said = [" ".join(rnd.choice(vocabulary, 8)) for _ in range(int(rnd.integers(1, 6)))]
        toxic = i % 4 == 0
        if toxic:
            said[int(rnd.integers(0, len(said)))] += " vermin" + "".join(rnd.choice(list("xyz"), 2))
        rows.append((i, ". ".join(said) + "."))
        labels.append((i, None, int(toxic)))
    labels += [(0, 1, None), (None, 1, 1), (8, 0, 0)]
    docs = spark.createDataFrame([*rows, (None, None), (9000, ""), (9001, "?!"), rows[0]], "doc_id long, text string").withColumn("score", toxicity.F.lit(1))
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, known, toxicity.fold() != 0)
    got = toxicity.score(docs, model).collect()
    assert len(got) == 604
    held = [(r.score >= 0.5, r.doc_id % 4 == 0) for r in got if r.doc_id is not None and r.doc_id < 9000 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(held) > 80 and sum(a == b for a, b in held) >= 0.97 * len(held)
    assert all(r.score == 0 for r in got if r.doc_id is None or r.doc_id >= 9000)
    by = {r.doc_id: r for r in got}
    text = dict(rows)
    for i in range(0, 600, 4):
        assert all("vermin" in text[i][s.start : s.end] for s in by[i].offending)
    kept = toxicity.keep_below(docs, model, 0.5)
    assert kept.columns == docs.columns and kept.where("doc_id = 9000").count() == 1
    assert toxicity.train(docs, known.where("toxic = 0"), toxicity.fold() != 0).weights == {}
    assert toxicity.score(no_docs, model).count() == 0


def test_row_hash_is_stable():
    data = "aé b\n".encode()
    assert runs.word_symbols(np.frombuffer(data, np.uint8), np.array([0, len(data)]))[0].tolist() == runs.word_symbols(np.frombuffer(b"z " + data, np.uint8), np.array([0, len(data) + 2]))[0].tolist()[1:]


def test_scores_restate_the_noisy_or(spark, odd_docs, texts):
    """Sentence by sentence from the weights themselves; long texts, nulls and further columns among the rows."""
    words = sorted({w for _, t in texts for s in toxicity.sentences(t or "") for w in s})
    rnd = np.random.default_rng(6)
    weights = {f: float(rnd.normal()) for w in words[::3] for f in toxicity.features(w)}
    model = toxicity.Model(weights, -2.0)
    want = Counter()
    for i, t in texts:
        clean, n = 1.0, 0
        for sentence in re.split(r"[.!?\n]", (t or "").lower()):
            own = re.findall(r"[a-z\x80-\U0010ffff]+", sentence)
            if own:
                z = model.bias + sum(weights.get(f, 0.0) for w in own for f in toxicity.features(w.encode()))
                clean *= 1 - 1 / (1 + np.exp(-z))
                n += 1
        want[i, n, round(1 - clean, 9)] += 1
    got = toxicity.score(odd_docs, model).collect()
    assert Counter((r.doc_id, r.n_sentences, round(r.score, 9)) for r in got) == want
    assert all(0 <= r.score <= 1 for r in got) and max(n for _, n, _ in want) > 500
    kept = toxicity.keep_below(odd_docs, model, 0.5)
    assert kept.columns == odd_docs.columns and kept.count() == sum(c for (_, _, x), c in want.items() if x < 0.5)


def prose_bytes(n, seed=3):
    rnd = np.random.default_rng(seed)
    syllables = "ab ce di fo gu ha je ki lo mu na pe qui ro su ta ve wi xo yu za".split()
    lexicon = ["".join(rnd.choice(syllables, rnd.integers(1, 5))) for _ in range(6000)]
    return " ".join(rnd.choice(lexicon, n))


def test_quality_keeps_prose_and_rejects_the_rest(spark):
    import base64

    noise = base64.b85encode(np.random.default_rng(1).bytes(6000)).decode()
    some = {
        **{k: (prose_bytes(n, k), True) for k, n in ((1, 60), (2, 300), (3, 1500), (4, 4000))},
        11: ("all work and no play " * 300, False), 12: (" ".join(noise[k : k + 9] for k in range(0, len(noise), 9)), False), 13: ("too short", False), 14: ("", False), 15: (None, False), 16: (prose_bytes(3000, 5) + " " + "ha " * 900, False),
    }
    rows = spark.createDataFrame([(k, t, 1) for k, (t, _) in some.items()], "doc_id long, text string, kept int")
    assert {r.doc_id: r.kept for r in quality.quality_rules(rows).collect()} == {k: v for k, (_, v) in some.items()}


def test_sharding_query(spark, tmp_path, texts):
    rows = spark.createDataFrame([*texts, *((7, "same") for _ in range(200))], "doc_id long, text string")
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    got = sharding.op10_bounded_ring_sharding(spark, str(tmp_path)).collect()
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in [*texts, *((7, "same") for _ in range(200))])
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    counts = Counter(r.shard for r in got)
    assert set(counts) == set(range(8)) and max(counts.values()) - min(counts.values()) <= 1
    assert {(r.law, r.grown_shard) for r in got} == {("rows", None)}
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(n)) for s, n in counts.items())


def test_toxicity_query_columns(spark):
    from tests.conftest import SF

    got = toxicity.op1_noisy_or_toxicity(spark, SF).collect()
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    for r in got:
        assert r.held_out is (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5)


def test_token_table_starts_anew_and_stays_right(monkeypatch):
    from quirelake.llm import tokens

    monkeypatch.setattr(tokens, "MOST", 50)
    monkeypatch.setattr(tokens, "BLOCK", 300)
    path = public_tokenizers.path("word_bpe_49k.json")
    whole, some = Tokenizer.from_file(path), [prose_bytes(40, k) + (" Straßenbahnhaltestellenverzeichnis, é." if k % 2 else "") for k in range(30)]
    encoder = ChunkEncoder(path, False, "<u2")
    for t, ids in zip(some, encoder.encode(some), strict=True):
        assert ids.tolist() == whole.encode(t, add_special_tokens=False).ids
    assert encoder._many < 1000
