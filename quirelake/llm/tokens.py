"""Token ids of whole texts, through a table of the units between two borders.

Both public tokenizers used here cut a text at every border between a white-space character and
any other one before they merge, and between a letter and a closing mark that ends a word. The
ids of a text are therefore the ids of its units one after another. Units are found and looked up
for a whole block of texts with array operations: the table's keys are a unit's bytes themselves
(sixteen at most; longer units have a dictionary), its values are places in one flat array of
ids. Only units that the worker doesn't know go to the tokenizers library, each once, in batches.

What a worker keeps has a bound in bytes: a table of 2**21 places, ``MOST`` units and
``MOST_BYTES`` of ids and long units. Beyond that it starts anew.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np

#: Units that a worker keeps; the table has twice as many places.
MOST = 1 << 20
#: Bytes of ids and of long units (with what Python adds to each) that a worker keeps.
MOST_BYTES = 32 << 20
#: Characters of text whose units are looked up together (a longer text is looked up alone).
BLOCK = 1 << 20
#: Units handed to the tokenizers library at once.
BATCH = 20_000
#: White space besides space and newline, and the character that pads keys. A text with any goes to the library whole.
UNUSUAL = re.compile("[\\x00\\t\\x0b\\x0c\\r\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]")
#: So does, where white space is part of the ids, one with more than one of it in a row.
RUNS = ("  ", "\n\n", " \n", "\n ")
_KEY = 16
_BITS = 21
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)
_BYTES = np.arange(256, dtype=np.uint8)
_LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
_LETTER = (_LOWER >= 97) & (_LOWER <= 122)
_CLOSING = np.isin(_BYTES, np.frombuffer(b".,;:!?", np.uint8))
_SPACE = np.isin(_BYTES, np.frombuffer(b" \n", np.uint8))


class ChunkEncoder:
    """Encodes texts to ids of the given numpy type.

    ``keeps_space`` says that white space is part of the ids: a unit then carries the white space
    before it.
    """

    def __init__(self, path: str, keeps_space: bool, dtype: str = "<u4"):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._keeps_space, self._dtype = keeps_space, np.dtype(dtype)
        self._folds = not keeps_space and self._ids("AÉ") == self._ids("aé")
        self._forget()

    def _ids(self, text: str) -> list[int]:
        return self._tokenizer.encode(text, add_special_tokens=False).ids

    def _forget(self) -> None:
        self._one, self._two = np.zeros(1 << _BITS, np.uint64), np.zeros(1 << _BITS, np.uint64)
        self._slot = np.full(1 << _BITS, -1, np.int32)
        self._long: dict[bytes, int] = {}
        self._flat, self._used = np.empty(1 << 16, self._dtype), 0
        self._bounds, self._many = np.zeros(1 << 16, np.int64), 0  # slot s holds flat[bounds[s]:bounds[s + 1]]
        self._bytes = 0

    def encode(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """The ids of each text, in order."""
        block, held = [], 0
        for text in texts:
            block.append(text)
            held += len(text)
            if held >= BLOCK:
                yield from self._block(block)
                block, held = [], 0
        yield from self._block(block)

    def _block(self, texts: list[str]) -> list[np.ndarray]:
        out = [np.array(self._ids(t), self._dtype) if self._is_odd(t) else None for t in texts]
        regular = [k for k, ids in enumerate(out) if ids is None]
        if regular:
            for k, ids in zip(regular, self._regular([texts[k].encode() for k in regular]), strict=True):
                out[k] = ids
        return out

    def _is_odd(self, text: str) -> bool:
        if UNUSUAL.search(text):
            return True
        return self._keeps_space and (text[:1].isspace() or text[-1:].isspace() or any(r in text for r in RUNS))

    def _regular(self, raw: list[bytes]) -> list[np.ndarray]:
        """Ids of texts whose white space is single spaces and newlines, or is dropped anyway."""
        borders = np.cumsum([0, *map(len, raw)])
        size = int(borders[-1])
        data = np.zeros(size + _KEY, np.uint8)
        data[:size] = np.frombuffer(b"".join(raw), np.uint8)
        if self._folds:
            data = _LOWER[data]
        starts, ends, words = self._units(data[:size], borders)
        slots = self._slots(data, starts, ends)
        first, many = self._bounds[slots], self._bounds[slots + 1] - self._bounds[slots]
        upto = np.concatenate([[0], np.cumsum(many)])
        ids = self._flat[np.arange(upto[-1]) + np.repeat(first - upto[:-1], many)]
        cuts = upto[words].tolist()
        if self._many > MOST or self._bytes > MOST_BYTES:
            self._forget()
        return [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def _units(self, data: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts, ends, units before each text border)."""
        space = np.ones(len(data) + 2, bool)
        space[1:-1] = _SPACE[data]
        cut = np.zeros(len(data) + 1, bool)
        cut[borders] = True
        solid = ~space[1:-1]
        starts = np.flatnonzero(solid & (space[:-2] | cut[:-1]))
        ends = np.flatnonzero(solid & (space[2:] | cut[1:])) + 1
        before = np.searchsorted(starts, borders)
        closed = np.flatnonzero(_CLOSING[data[ends - 1]] & _LETTER[data[np.maximum(ends - 2, 0)]] & (ends - starts > 1))
        if self._keeps_space:  # the white space before a word is its own, but for the first of a text
            first = before[:-1][before[:-1] < before[1:]]
            own = np.ones(len(starts), bool)
            own[first] = False
            starts = starts - own
        if len(closed):
            marks = ends[closed] - 1
            ends = ends.copy()
            ends[closed] = marks
            starts, ends = np.insert(starts, closed + 1, marks), np.insert(ends, closed + 1, marks + 1)
            before = before + np.searchsorted(closed, before)
        return starts, ends, before

    def _slots(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        sizes = ends - starts
        lanes = np.ndarray((len(data) - 7,), "<u8", buffer=data, strides=(1,))
        one = lanes[starts] & _MASK[np.minimum(sizes, 8)]
        two = lanes[np.minimum(starts + 8, len(lanes) - 1)] & _MASK[np.clip(sizes - 8, 0, 8)]
        found = self._find(one, two)
        long = sizes > _KEY
        if long.any():
            places = np.flatnonzero(long)
            raw = data.tobytes()
            keys = [raw[a:b] for a, b in zip(starts[places].tolist(), ends[places].tolist(), strict=True)]
            new = list(dict.fromkeys(k for k in keys if k not in self._long))
            if new:
                at = self._many
                self._learn(new)
                self._long.update(zip(new, range(at, self._many), strict=True))
                self._bytes += sum(map(len, new)) + 190 * len(new)
            found[places] = [self._long[k] for k in keys]
        if len(open_ := np.flatnonzero((found < 0) & ~long)):
            order = open_[np.lexsort((two[open_], one[open_]))]
            fresh = np.ones(len(order), bool)
            fresh[1:] = (one[order[1:]] != one[order[:-1]]) | (two[order[1:]] != two[order[:-1]])
            heads = order[fresh]
            at = self._many
            self._learn([data[a:b].tobytes() for a, b in zip(starts[heads].tolist(), ends[heads].tolist(), strict=True)])
            self._place(one[heads], two[heads], np.arange(at, self._many))
            found[order] = at + np.cumsum(fresh) - 1
        return found

    @staticmethod
    def _home(one: np.ndarray, two: np.ndarray) -> np.ndarray:
        h = (one ^ (two * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(7))) * np.uint64(0x9E3779B97F4A7C15)
        return ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - _BITS)).astype(np.int64)

    def _find(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Slots of keys, -1 where there is none."""
        at = self._home(one, two)
        slot = self._slot[at].astype(np.int64)
        other = np.flatnonzero((slot >= 0) & ((self._one[at] != one) | (self._two[at] != two)))
        while len(other):  # the place is taken by another key: the next one
            at[other] = (at[other] + 1) & ((1 << _BITS) - 1)
            here = at[other]
            slot[other] = self._slot[here]
            other = other[(slot[other] >= 0) & ((self._one[here] != one[other]) | (self._two[here] != two[other]))]
        return slot

    def _place(self, one: np.ndarray, two: np.ndarray, slots: np.ndarray) -> None:
        if self._many > 3 * MOST // 2:  # one block of very many new units: they are used once and not kept
            return
        at = self._home(one, two)
        left = np.arange(len(at))
        while len(left):
            free = left[self._slot[at[left]] < 0]
            _, first = np.unique(at[free], return_index=True)
            winners = free[first]
            here = at[winners]
            self._one[here], self._two[here], self._slot[here] = one[winners], two[winners], slots[winners]
            placed = np.zeros(len(at), bool)
            placed[winners] = True
            left = left[~placed[left]]
            at[left] = (at[left] + 1) & ((1 << _BITS) - 1)

    def _learn(self, units: list[bytes]) -> None:
        """Appends the ids of units, in their order."""
        for k in range(0, len(units), BATCH):
            got = [e.ids for e in self._tokenizer.encode_batch_fast([u.decode() for u in units[k : k + BATCH]], add_special_tokens=False)]
            ids = np.fromiter(chain.from_iterable(got), self._dtype)
            while self._used + len(ids) > len(self._flat):
                self._flat = np.concatenate([self._flat, np.empty_like(self._flat)])
            while self._many + len(got) >= len(self._bounds):
                self._bounds = np.concatenate([self._bounds, np.zeros_like(self._bounds)])
            self._flat[self._used : self._used + len(ids)] = ids
            self._bounds[self._many + 1 : self._many + len(got) + 1] = self._used + np.cumsum([len(x) for x in got])
            self._used, self._many, self._bytes = self._used + len(ids), self._many + len(got), self._bytes + ids.nbytes


_ENCODERS: dict[tuple, ChunkEncoder] = {}


def encoder(path: str, keeps_space: bool, dtype: str = "<u4") -> ChunkEncoder:
    """The worker's own encoder, kept between tasks."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    key = (path, keeps_space, dtype)
    if key not in _ENCODERS:
        _ENCODERS[key] = ChunkEncoder(*key)
    return _ENCODERS[key]
