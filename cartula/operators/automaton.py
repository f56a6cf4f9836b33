"""An automaton of many surfaces in flat arrays, stepped for all texts of a batch at once.

The trie is built level by level: the nodes of a level are the distinct pairs of a parent and
a character, numbered in their order, and lie with that pair in a table of open addresses.
Failure links, and links to the nearest shorter surface, follow level by level as well.

To run it, the texts of a batch are laid end to end and cut into pieces of equal length, each
of which begins so much earlier that no surface which ends in it is missed. All pieces are
one column of states, and a step takes all of them one character on.
"""

from __future__ import annotations

import unicodedata

import numpy as np

#: Characters of a piece, at least.
PIECE = 512
_MIX = np.uint64(0x9E3779B97F4A7C15)


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Automaton:
    """Of distinct surfaces, none of which is empty."""

    def __init__(self, surfaces: list[str]):
        every, sizes = points("".join(surfaces)), np.array([len(s) for s in surfaces], np.int64)
        self.sizes, self.longest = sizes, int(sizes.max(initial=0))
        alphabet = np.unique(every)
        self._codes = np.zeros(int(alphabet.max(initial=0)) + 2, np.int32)  # 0: in no surface
        self._codes[alphabet] = np.arange(1, len(alphabet) + 1)
        self._width = len(alphabet) + 1
        coded, begins = self._codes[every], np.cumsum(sizes) - sizes
        node, count, keys, levels = np.zeros(len(surfaces), np.int64), 1, [], []
        for depth in range(self.longest):
            going = np.flatnonzero(sizes > depth)
            made, at = np.unique(node[going] * self._width + coded[begins[going] + depth], return_inverse=True)
            node[going] = count + at
            keys.append(made)
            levels.append(slice(count, count + len(made)))
            count += len(made)
        keys = np.concatenate([np.empty(0, np.int64), *keys])
        self._address(keys)
        self._first = np.zeros(self._width, np.int64)
        top = keys[: levels[0].stop - 1] if levels else keys
        self._first[top] = np.arange(1, len(top) + 1)
        #: The surface that ends at each node, or -1; the node of the longest one that ends inside of it, or 0.
        self.surface = np.full(count, -1, np.int64)
        self.surface[node] = np.arange(len(surfaces))
        self.shorter, self._fail = np.zeros(count, np.int64), np.zeros(count, np.int64)
        for level in levels[1:]:
            own = keys[level.start - 1 : level.stop - 1]
            to = self._fail[level] = self.step(self._fail[own // self._width], own % self._width)
            self.shorter[level] = np.where(self.surface[to] >= 0, to, self.shorter[to])
        self.ends = (self.surface >= 0) | (self.shorter > 0)

    def _address(self, keys: np.ndarray) -> None:
        """Puts the children of all nodes, by key, into the first free places from the keys' own on."""
        bits = max(4, int(4 * len(keys) + 1).bit_length())
        self._shift, self._mask = np.uint64(64 - bits), (1 << bits) - 1
        self._keys, self._nodes = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int64)
        left, at = np.arange(len(keys)), self._place(keys)
        while len(left):
            free = np.flatnonzero(self._keys[at] < 0)
            _, first = np.unique(at[free], return_index=True)
            put = free[first]
            self._keys[at[put]], self._nodes[at[put]] = keys[left[put]], left[put] + 1
            rest = np.setdiff1d(np.arange(len(left)), put)
            left, at = left[rest], (at[rest] + 1) & self._mask

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _MIX) >> self._shift).astype(np.int64)

    def _children(self, nodes: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The child of each node by a character, or -1; the root has itself for those it lacks."""
        keys = nodes * self._width + codes
        at = self._place(keys)
        met = self._keys[at]
        out = np.where(met == keys, self._nodes[at], -1)
        open_ = np.flatnonzero((met != keys) & (met >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & self._mask
            met = self._keys[at[open_]]
            hit = met == keys[open_]
            out[open_[hit]] = self._nodes[at[open_[hit]]]
            open_ = open_[~hit & (met >= 0)]
        return np.where(nodes == 0, self._first[codes], out)

    def step(self, nodes: np.ndarray, codes: np.ndarray) -> np.ndarray:
        out = self._children(nodes, codes)
        out[codes == 0] = 0
        open_ = np.flatnonzero(out < 0)
        while len(open_):
            nodes = self._fail[nodes[open_]] if len(nodes) == len(out) else self._fail[nodes]
            found = self._children(nodes, codes[open_])
            out[open_] = found
            left = found < 0
            open_, nodes = open_[left], nodes[left]
        return out

    def find(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where surfaces end in a text (code points), and which they are."""
        if not self.longest or not len(text):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        codes = self._codes[np.minimum(text, len(self._codes) - 1)]
        lead, piece = self.longest - 1, max(PIECE, 4 * self.longest)
        n = -(-len(codes) // piece)
        laid = np.zeros(lead + n * piece, np.int32)
        laid[lead : lead + len(codes)] = codes
        columns = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(laid, lead + piece)[::piece].T)
        nodes, at, met = np.zeros(n, np.int64), [], []
        begins = np.arange(n) * piece - lead
        for k in range(lead + piece):
            nodes = self.step(nodes, columns[k])
            if k >= lead:
                some = np.flatnonzero(self.ends[nodes])
                if len(some):
                    at.append(begins[some] + k)
                    met.append(nodes[some])
        if not at:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        at, met = np.concatenate(at), np.concatenate(met)
        places, found = [], []
        while len(at):  # the surface that ends here, and all shorter ones
            own = self.surface[met]
            places.append(at[own >= 0])
            found.append(own[own >= 0])
            met = self.shorter[met]
            at, met = at[met > 0], met[met > 0]
        return np.concatenate(places) + 1, np.concatenate(found)


_WORDY = np.full(0x110000, 2, np.uint8)


def wordy(text: np.ndarray) -> np.ndarray:
    """Which code points are part of words: letters, digits, marks and the underscore. What they are is looked up once for each 256."""
    for block in np.flatnonzero(np.bincount(text >> 8)) if len(text) else ():
        if _WORDY[block << 8] == 2:
            own = map(chr, range(block << 8, (block + 1) << 8))
            _WORDY[block << 8 : (block + 1) << 8] = [c.isalnum() or c == "_" or unicodedata.category(c)[0] in "MN" for c in own]
    return _WORDY[text].astype(bool)
