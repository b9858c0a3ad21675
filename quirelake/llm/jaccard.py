"""Similarity join of word-shingle sets with signature trees (operator 2).

1. Every text becomes a set of hashed shingles; texts with the same set are one node from here on.
2. Sets are dealt into families: sets that share one of 60 keys of three minima each, directly or
   by way of others. A pair at the threshold of 0.75 shares no key with probability
   (1 - 0.75**3)**60 < 1e-14, more similar pairs with less. With ``exact`` there is one family of
   all sets instead, cut by size; then nothing rests on chance.
3. Every family gets signature trees: leaves are sets with bitmaps of their shingles, inner nodes
   hold OR-combined bitmaps and size ranges, and similar sets lie next to each other. A dual
   traversal goes down only where two nodes' greatest possible overlap reaches the threshold and
   they are not in one component yet. Leaves hold their whole sets, so a pair that arrives there
   is decided at once; a link is passed on only if it joins two components, one less than there
   are sets at most.
4. The links of all trees make the components.

A family of more than ``BLOCK`` sets, or of very long ones, is cut into blocks by size class and
hash; trees of two blocks at a time are traversed against each other, so a task's memory has a
bound. Sizes further apart than the threshold allows never meet. The number of such tasks grows
with the square of a family's blocks; nothing is left out to avoid that.

Cases: null and empty texts and texts of white space have an empty set and are linked with
nothing; texts of fewer words than a shingle have their whole sequence as one; equal ids are
separate rows, each with its set's component; a null id counts as the least and comes out null; a
very long text is one set; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelake.llm import runs
from quirelake.llm.common import materialize, small_batches
from quirelake.llm.components import components

SHINGLE = 5
#: Keys per set, and minima that make a key.
BANDS, ROWS = 60, 3
#: Sets, and bytes of shingles, that a task holds at most twice.
BLOCK, BLOCK_BYTES = 2_000, 24 << 20
#: Children of a tree node.
FANOUT = 16
#: Bits of the narrowest and the widest bitmap.
NARROW, WIDE = 64, 1 << 17
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RANDOM = np.random.default_rng(75)
_FLIPS, _FACTORS = (_RANDOM.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, borders): shingles of each text in order, repeats included."""
    symbols, borders = runs.word_symbols(_LOWER[data], offsets)
    counts = np.diff(borders)
    rolling = runs.Rolling(symbols)
    many = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    out = np.cumsum([0, *many])
    owner = np.repeat(np.arange(len(counts)), many)
    starts = borders[owner] + np.arange(len(owner)) - out[owner]
    return rolling.of(starts, np.minimum(starts + size, borders[owner + 1])), out


def set_rows(keyed: DataFrame, size: int) -> DataFrame:
    """row_key, doc, doc_id, n_shingles, one and two (hashes of the set, null for an empty one), bands."""
    fields = "row_key long, doc long, doc_id long, n_shingles long, one long, two long, bands array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, offsets in runs.text_chunks(batch):
                hashes, borders = shingle_hashes(data, offsets, size)
                full = np.flatnonzero(np.diff(borders))
                rows = len(offsets) - 1
                minima = np.empty((len(full), BANDS * ROWS), dtype=np.uint64)
                if len(full):
                    for k, (flip, factor) in enumerate(zip(_FLIPS, _FACTORS, strict=True)):
                        x = (hashes ^ flip) * factor
                        minima[:, k] = np.minimum.reduceat(x ^ (x >> np.uint64(32)), borders[full])
                keys = np.zeros((len(full), BANDS), dtype=np.uint64)
                for r in range(ROWS):
                    keys = runs.mix(keys ^ minima[:, r::ROWS]) + np.uint64(r + 1)
                keys = runs.mix(keys ^ np.arange(BANDS, dtype=np.uint64)).view(np.int64)
                counts, ones, twos, bands = [0] * rows, [None] * rows, [None] * rows, [None] * rows
                for j, i in enumerate(full.tolist()):
                    own = np.unique(hashes[borders[i] : borders[i + 1]])
                    counts[i], bands[i] = len(own), keys[j]
                    ones[i] = int((runs.mix(own ^ np.uint64(len(own))).sum(dtype=np.uint64)).view(np.int64))
                    twos[i] = int((runs.mix(runs.mix(own + _FLIPS[0]) ^ _FACTORS[0]).sum(dtype=np.uint64)).view(np.int64))
                part = batch.slice(at, rows)
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in ("row_key", "doc", "doc_id")] + [pa.array(counts, pa.int64()), pa.array(ones, pa.int64()), pa.array(twos, pa.int64()), pa.array(bands, pa.list_(pa.int64()))],
                    ["row_key", "doc", "doc_id", "n_shingles", "one", "two", "bands"],
                )

    return keyed.select("row_key", "doc", "doc_id", "text").mapInArrow(run, fields)


def linked(x: int, y: int, common: int, threshold: int) -> bool:
    """Whether 100 * common reaches threshold * union."""
    return 100 * common >= threshold * (x + y - common)


class Joined:
    """Components that grow together."""

    def __init__(self, n: int):
        self._above = list(range(n))

    def root(self, k: int) -> int:
        above = self._above
        while above[k] != k:
            above[k] = above[above[k]]
            k = above[k]
        return k

    def join(self, a: int, b: int) -> None:
        self._above[max(a, b)] = min(a, b)


class Tree:
    """A signature tree over some sets: level 0 has the leaves, every further level their parents.

    ``width`` is that of the bitmaps, a power of two of about eight bits a shingle. A node's bits
    are the OR of its children's; ``excess`` is the most shingles of a set below it beyond its bits.
    """

    def __init__(self, members: list[int], sets: list[np.ndarray], width: int):
        self.members = sorted(members, key=lambda k: sets[k][:3].tolist())  # least hashes first: similar sets are neighbours
        packed, bits = np.empty((len(members), width // 8), np.uint8), np.zeros(width, np.uint8)
        for row, k in enumerate(self.members):  # one set at a time is spread out to a byte per bit
            own = sets[k] & np.uint64(width - 1)
            bits[own] = 1
            packed[row] = np.packbits(bits)
            bits[own] = 0
        packed = packed.view(np.uint64)
        size = np.array([len(sets[k]) for k in self.members])
        self.bits, self.least, self.most, self.excess = [packed], [size], [size], [size - np.bitwise_count(packed).sum(axis=1, dtype=np.int64)]
        while len(self.bits[-1]) > 1:
            first = np.arange(0, len(self.bits[-1]), FANOUT)
            self.bits.append(np.bitwise_or.reduceat(self.bits[-1], first, axis=0))
            self.least.append(np.minimum.reduceat(self.least[-1], first))
            self.most.append(np.maximum.reduceat(self.most[-1], first))
            self.excess.append(np.maximum.reduceat(self.excess[-1], first))
        self.height = len(self.bits) - 1
        self._uniform: set[tuple[int, int]] = set()

    def children(self, level: int, node: int) -> range:
        return range(node * FANOUT, min((node + 1) * FANOUT, len(self.bits[level - 1])))

    def component(self, level: int, node: int, joined: Joined) -> int | None:
        """The component of all leaves below a node, if there is one."""
        if level == 0 or (level, node) in self._uniform:
            return joined.root(self.members[node * FANOUT**level])
        found = None
        for child in self.children(level, node):
            own = self.component(level - 1, child, joined)
            if own is None or found not in (None, own):
                return None
            found = own
        self._uniform.add((level, node))
        return found


def possible(a: Tree, x: range, b: Tree, y: range, at: tuple[int, int], threshold: int) -> np.ndarray:
    """Pairs of nodes (one of each range, on the levels ``at``) whose greatest possible overlap allows a link; best first."""
    p, q = slice(x.start, x.stop), slice(y.start, y.stop)
    i, j = at
    common = np.bitwise_count(a.bits[i][p, None] & b.bits[j][None, q]).sum(axis=2, dtype=np.int64)
    common += np.minimum(a.excess[i][p, None], b.excess[j][None, q])
    common = np.minimum(common, np.minimum(a.most[i][p, None], b.most[j][None, q]))
    # The sets that allow a link most are the smallest, but none is smaller than the overlap.
    fits = 100 * common >= threshold * (np.maximum(a.least[i][p, None], common) + np.maximum(b.least[j][None, q], common) - common)
    found = np.argwhere(fits)
    return found[np.argsort(-common[fits], kind="stable")] + (x.start, y.start)


def traverse(a: Tree, b: Tree, sets: list[np.ndarray], joined: Joined, threshold: int) -> Iterator[tuple[int, int]]:
    """Links between leaves of two trees (or of one with itself) that join two components."""
    stack = [(a.height, 0, b.height, 0)]
    while stack:
        i, x, j, y = stack.pop()
        same = a is b and i == j and x == y
        if i == j == 0:
            p, q = a.members[x], b.members[y]
            r, s = joined.root(p), joined.root(q)
            if r != s:
                one, two = (sets[p], sets[q]) if len(sets[p]) <= len(sets[q]) else (sets[q], sets[p])
                at = np.minimum(np.searchsorted(two, one), len(two) - 1)
                if linked(len(one), len(two), int((two[at] == one).sum()), threshold):
                    joined.join(r, s)
                    yield p, q
            continue
        one = a.component(i, x, joined)
        if one is not None and one == b.component(j, y, joined):
            continue
        down_a, down_b = i >= j, j >= i
        xs, ys = a.children(i, x) if down_a else range(x, x + 1), b.children(j, y) if down_b else range(y, y + 1)
        level = (i - down_a, j - down_b)
        found = possible(a, xs, b, ys, level, threshold).tolist()
        # The best pairs are taken from the stack first; a node is compared with itself before others.
        stack += [(level[0], p, level[1], q) for p, q in reversed(found) if not same or p < q]
        if same and level[0] > 0:
            stack += [(level[0], p, level[1], q) for p, q in reversed(found) if p == q]


def tree_links(sets: list[np.ndarray], sides: list[int], threshold: int) -> list[tuple[int, int]]:
    """Links that join all components among the sets of one side, or between sets of sides 0 and 1."""
    widths = [min(WIDE, max(NARROW, 1 << (8 * len(s) - 1).bit_length())) for s in sets]
    joined, found, crossing = Joined(len(sets)), [], len(set(sides)) > 1
    for width in sorted(set(widths)):
        # Sizes that can link differ by less than two, so widths by two at most; the wider are folded by the narrower tree's width.
        trees = {(w, side): Tree(own, sets, width) for w in (width, 2 * width) for side in (0, 1) if (own := [k for k, x in enumerate(widths) if x == w and sides[k] == side])}
        pairs = [((width, 0), (width, 1)), ((width, 0), (2 * width, 1)), ((width, 1), (2 * width, 0))] if crossing else [((width, s), (w, s)) for s in set(sides) for w in (width, 2 * width)]
        for p, q in pairs:
            if p in trees and q in trees:
                found += traverse(trees[p], trees[q], sets, joined, threshold)
    return found


def dealt(members: DataFrame, threshold: int) -> DataFrame:
    """doc, row_key, sid and the tasks (key, side) of each member (family, sid, doc, row_key, n_shingles).

    A family that one task holds is one task. Others are cut into size classes, these into blocks;
    a block meets the blocks of its own class and of the next.
    """
    ratio = math.log(100 / threshold)
    parts = lambda n, total: F.greatest(F.ceil(n / BLOCK), F.ceil(total * 8 / BLOCK_BYTES), F.lit(1)).cast("int")
    size = F.floor(F.log(F.col("n_shingles")) / ratio).cast("int")
    own = members.withColumn("class", size).groupBy("family", "class").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("total"))
    whole = own.groupBy("family").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.map_from_entries(F.collect_list(F.struct("class", parts(F.col("n"), F.col("total"))))).alias("blocks"))
    # Written first, so that the join can be split where a family is very large.
    plans = materialize(whole.where(parts(F.col("n"), F.col("total")) > 1).select("family", "blocks"), "family-blocks")
    placed = members.join(plans.hint("merge"), "family", "left").withColumn("class", size)
    at = lambda c: F.coalesce(F.element_at("blocks", c), F.lit(0))
    mine = F.pmod(F.xxhash64("sid"), F.greatest(at(F.col("class")), F.lit(1))).cast("int")
    empty = F.array().cast("array<int>")
    numbers = lambda n: F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))).otherwise(empty)
    task = lambda low, one, high, two, side: F.struct(F.xxhash64("family", low, one, high, two).alias("key"), side.cast("int").alias("side"))
    here, above, below = F.col("class"), F.col("class") + 1, F.col("class") - 1
    same = F.transform(numbers(at(here)), lambda o: task(here, F.least(F.col("mine"), o), here, F.greatest(F.col("mine"), o), F.col("mine") > o))
    up = F.transform(numbers(at(above)), lambda o: task(here, F.col("mine"), above, o, F.lit(False)))
    down = F.transform(numbers(at(below)), lambda o: task(below, o, here, F.col("mine"), F.lit(True)))
    alone = F.array(F.struct(F.xxhash64("family").alias("key"), F.lit(0).alias("side")))
    tasks = F.when(F.col("blocks").isNull(), alone).otherwise(F.concat(same, up, down))
    return placed.withColumn("mine", mine).select("doc", "row_key", "sid", tasks.alias("tasks"))


def family_links(keyed: DataFrame, members: DataFrame, size: int, threshold: int) -> DataFrame:
    """a, b: links that the trees of all families find. members: family, sid, doc, row_key, n_shingles."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sids, tasks = batch.column("sid").to_pylist(), batch.column("tasks").to_pylist()
            for at, data, offsets in runs.text_chunks(batch):
                hashes, borders = shingle_hashes(data, offsets, size)
                rows, held = [], 0
                for i in range(len(offsets) - 1):
                    own = np.unique(hashes[borders[i] : borders[i + 1]]).tobytes()
                    for task in tasks[at + i]:
                        rows.append((task["key"], task["side"], sids[at + i], own))
                        held += len(own)
                        if held > 8 << 20:
                            yield batch_of(rows)
                            rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.int64(), pa.int32(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["minimiser", "side", "sid", "shingles"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs.whole_groups(batches, BLOCK, BLOCK_BYTES):
            codes, sids, sides = (table.column(c).to_pylist() for c in ("minimiser", "sid", "side"))
            sets = [np.frombuffer(s.as_buffer(), np.uint64) for s in table.column("shingles")]
            cuts = [k for k in range(len(codes)) if k == 0 or codes[k] != codes[k - 1]] + [len(codes)]
            links = [(sids[a + p], sids[a + q]) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b - a > 1 for p, q in tree_links(sets[a:b], sides[a:b], threshold)]
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links, strict=True)], ["a", "b"])

    texts = keyed.select("doc", "row_key", "text").join(dealt(members, threshold).hint("merge"), ["doc", "row_key"]).dropDuplicates(["doc", "row_key"])
    sets = texts.select("sid", "tasks", "text").mapInArrow(spread, "minimiser long, side int, sid long, shingles binary")
    return sets.repartition("minimiser").sortWithinPartitions("minimiser", "sid").mapInArrow(join, "a long, b long")


def similarity_components(docs: DataFrame, size: int = SHINGLE, threshold: int = 75, exact: bool = False) -> DataFrame:
    """doc_id, row_key, n_shingles, component_id (least doc_id reachable), component: one row per document.

    Components may share a least doc_id (a null or repeated one); component (the least number of a set, null
    for an empty one) tells them apart. ``exact`` compares all sizes that can link instead of families
    that share a key: for measuring, and for tables of which that is affordable.
    """
    small_batches(docs.sparkSession)
    keyed = runs.with_row_key(docs)
    sets = materialize(set_rows(keyed, size), "sets")
    # Repeated sets collapse here, before anything is dealt out.
    alike = sets.where("one is not null").groupBy("one", "two").agg(F.min(F.struct("doc", "row_key", "n_shingles", "bands")).alias("r")).select("one", "two", "r.*")
    # Sets are numbered rather than named by a hash; written once, so every later step sees the same numbers.
    reps = materialize(alike.withColumn("sid", F.monotonically_increasing_id()), "set-reps")
    if exact:
        members = reps.select(F.lit(0).cast("long").alias("family"), "sid", "doc", "row_key", "n_shingles")
    else:
        placed = reps.select("sid", F.explode("bands").alias("key"))
        # Minima are summed up before they are dealt out, and written, so that a key of very many sets can be split.
        least = materialize(placed.groupBy("key").agg(F.min("sid").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "key-minima")
        near = placed.join(least.hint("merge"), "key").select(F.col("sid").alias("a"), "b").where("a <> b")
        families = materialize(components(near), "families")
        members = families.select(F.col("node").alias("sid"), F.col("component").alias("family")).join(reps.select("sid", "doc", "row_key", "n_shingles").hint("merge"), "sid")
    links = family_links(keyed, materialize(members, "family-members"), size, threshold)
    final = materialize(components(links), "components")
    named = reps.select("sid", "one", "two", "doc").join(final.withColumnRenamed("node", "sid").hint("merge"), "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    least = named.groupBy("component").agg(F.min("doc").alias("least"))
    by_set = named.join(least, "component").select("one", "two", "component", "least")
    own = F.coalesce(F.col("least"), F.col("doc"))
    return sets.drop("bands").join(by_set, ["one", "two"], "left").select("doc_id", "row_key", "n_shingles", F.when(own != -(2**63), own).alias("component_id"), "component")


def op2_signature_tree_join(spark, sf_dir: str) -> DataFrame:
    """All documents with the component of five-word shingle sets at a similarity of 0.75."""
    from quirelake.llm.common import documents

    return similarity_components(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")
