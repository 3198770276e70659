"""Levels of an n-gram trie in files that workers map into memory.

Level 1 holds the words, by sorted hash, with exact counts. A level above holds
n-grams as nodes: a parent (the node of the words before the last) and a child.
Parents are an Elias-Fano sequence with monotone pointers to their first nodes,
and the children of all parents form one rising sequence, each parent's going
on from the last one's. From level 3 on, a child is its place among the
successors of the context without its first word, which are few. Probabilities
and weights are quantised to 256 steps. A level is a row of files, split by
(parent, child), so no parent is too large for one.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs

from waymark.llm.eliasfano import EliasFano

_STEPS = 256


def _local(folder: str) -> str | None:
    parsed = urlparse(folder)
    return unquote(parsed.path) if parsed.scheme in ("", "file") else None


def save(folder: str, arrays: list[np.ndarray]) -> str:
    """Write arrays to a new file of the shared folder; return its place."""
    words, kinds = [], []
    for array in arrays:
        raw = np.ascontiguousarray(array)
        kinds.append((ord(raw.dtype.char), len(raw)))
        data = raw.tobytes()
        words.append(data + bytes(-len(data) % 8))
    head = np.array([len(arrays), *[x for k in kinds for x in k]], np.int64)
    place = f"{folder}/{uuid.uuid4().hex}.trie"
    path = _local(place)
    if path is not None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as out:
            out.write(head.tobytes())
            out.writelines(words)
    else:
        system, path = pafs.FileSystem.from_uri(place)
        system.create_dir(os.path.dirname(path), recursive=True)
        with system.open_output_stream(path) as out:
            out.write(head.tobytes())
            for data in words:
                out.write(data)
    return place


def load(place: str) -> list[np.ndarray]:
    """Arrays of a file, mapped where the shared folder is mounted."""
    path = _local(place)
    if path is not None:
        raw = np.memmap(path, np.uint8, "r")
    else:
        system, path = pafs.FileSystem.from_uri(place)
        with system.open_input_file(path) as source:
            raw = np.frombuffer(source.read(), np.uint8)
    count = int(raw[:8].view(np.int64)[0])
    head = raw[8 : 8 + 16 * count].view(np.int64)
    at, out = 8 + 16 * count, []
    for kind, n in zip(head[::2].tolist(), head[1::2].tolist()):
        size = np.dtype(chr(kind)).itemsize * n
        out.append(np.asarray(raw[at : at + size]).view(chr(kind)))
        at += size + -size % 8
    return out


def quantised(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes and the values of up to 256 steps, set at even quantiles."""
    book = np.unique(np.quantile(values, np.linspace(0, 1, _STEPS))) if len(values) else np.zeros(1)
    middles = (book[1:] + book[:-1]) / 2
    return np.searchsorted(middles, values).astype(np.uint8), book


def narrowed(counts: np.ndarray) -> np.ndarray:
    """Counts in the smallest type that holds the largest."""
    return counts.astype(np.min_scalar_type(int(counts.max(initial=0))))


def build_words(folder: str, keys: np.ndarray, counts: np.ndarray) -> str:
    return save(folder, [*EliasFano.build(keys), narrowed(counts)])


def build_nodes(
    folder: str,
    parents: np.ndarray,
    children: np.ndarray,
    counts: np.ndarray,
    scores: np.ndarray,
    weights: np.ndarray,
) -> str:
    """Write nodes sorted by parent and child; ``weights`` are of the parents."""
    begins = np.flatnonzero(np.append(True, parents[1:] != parents[:-1])[: len(parents)])
    held = parents[begins]
    pointers = np.append(begins, len(parents))
    most = np.maximum.reduceat(children, begins) + 1 if len(held) else begins
    bases = np.cumsum(most) - most
    rising = children + 1 + np.repeat(bases, np.diff(pointers))
    codes, book = quantised(scores)
    weight_codes, weight_book = quantised(weights[begins])
    return save(
        folder,
        [
            *EliasFano.build(held),
            *EliasFano.build(pointers),
            *EliasFano.build(rising),
            narrowed(counts),
            codes,
            book,
            weight_codes,
            weight_book,
        ],
    )


def encoded(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different values, in order of appearance, and which of them each is."""
    found = pa.array(values).dictionary_encode()
    return found.dictionary.to_numpy(), found.indices.to_numpy()


def ordered(parent: np.ndarray, child: np.ndarray) -> np.ndarray:
    """The order by parent and child."""
    wide = int(child.max(initial=0)) + 2
    if (int(parent.max(initial=0)) + 2) * wide >= 1 << 63:
        return np.lexsort((child, parent))
    return np.argsort((parent + 1) * wide + child)


def distinct(parent: np.ndarray, child: np.ndarray) -> tuple[np.ndarray, ...]:
    """The different pairs, in order, and which of them each pair is."""
    order = ordered(parent, child)
    parents, children = parent[order], child[order]
    new = np.append(True, (parents[1:] != parents[:-1]) | (children[1:] != children[:-1]))
    new = new[: len(parent)]
    of = np.empty(len(parent), np.int64)
    of[order] = np.cumsum(new) - 1
    return parents[new], children[new], of


@lru_cache(maxsize=256)
def _words(place: str) -> tuple[EliasFano, np.ndarray]:
    arrays = load(place)
    return EliasFano(arrays[:6]), arrays[6]


class _Nodes:
    def __init__(self, place: str):
        arrays = load(place)
        self.held = EliasFano(arrays[:6])
        self.pointers = EliasFano(arrays[6:12])
        self.rising = EliasFano(arrays[12:18])
        self.counts, self.codes, self.book, self.weight_codes, self.weight_book = arrays[18:]

    def find(self, parent: np.ndarray, child: np.ndarray):
        """Node, first node and weight of the parent; -1 and 0 if there is none.

        Parents are in order.
        """
        new = np.append(True, parent[1:] != parent[:-1])[: len(parent)]
        of = np.cumsum(new) - 1
        at = self.held.find(parent[new])
        found = at >= 0
        begin = np.full(len(at), -1, np.int64)
        base = np.zeros(len(at), np.int64)
        end = np.zeros(len(at), np.int64)
        weight = np.zeros(len(at))
        begin[found], end[found] = self.pointers.value_and_next(at[found])
        inner = begin > 0
        base[inner] = self.rising.value(begin[inner] - 1)
        weight[found] = self.weight_book[self.weight_codes[at[found]]]
        held, begin = np.flatnonzero(found[of]), begin[of]
        node = np.full(len(parent), -1, np.int64)
        node[held] = self.rising.find(base[of[held]] + child[held] + 1)
        node[(node < begin) | (node >= end[of])] = -1
        return node, begin, weight[of]

    def begin(self, parent: np.ndarray) -> np.ndarray:
        """The first node of each parent, or -1."""
        at = self.held.find(parent)
        at[at >= 0] = self.pointers.value(at[at >= 0])
        return at

    def pair(self, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Parent and child of each node of the file."""
        starts = self.pointers.value(np.arange(self.held.n + 1))
        group, of = np.unique(np.searchsorted(starts, node, "right") - 1, return_inverse=True)
        base = np.zeros(len(group), np.int64)
        inner = starts[group] > 0
        base[inner] = self.rising.value(starts[group[inner]] - 1)
        return self.held.value(group)[of], self.rising.value(node) - base[of] - 1

    def children(self, parent: int) -> int:
        """How many children of a parent are in this file."""
        at = int(self.held.find(np.array([parent]))[0])
        if at < 0:
            return 0
        return int(np.diff(self.pointers.value(np.array([at, at + 1])))[0])


@lru_cache(maxsize=256)
def _nodes(place: str) -> _Nodes:
    return _Nodes(place)


def _runs(part: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Each value of a rising sequence, and where it lies."""
    values, begins = np.unique(part, return_index=True)
    ends = np.append(begins[1:], len(part))
    for value, begin, end in zip(values.tolist(), begins.tolist(), ends.tolist()):
        yield value, slice(begin, end)


class WordLevel:
    """``parts`` are (first key, first id, place), in order."""

    def __init__(self, parts: list[tuple[int, int, str]], size: int):
        self.parts, self.size = parts, size
        self.first = np.array([p[0] for p in parts], np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Id and count of each key; -1 and 0 for an unknown word."""
        ids, counts = np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
        part = np.searchsorted(self.first, keys, "right") - 1
        for p in np.unique(part[part >= 0]).tolist():
            at = np.flatnonzero(part == p)
            sequence, held = _words(self.parts[p][2])
            found = sequence.find(keys[at])
            ok = found >= 0
            ids[at[ok]] = found[ok] + self.parts[p][1]
            counts[at[ok]] = held[found[ok]]
        return ids, counts

    def counts(self, ids: np.ndarray) -> np.ndarray:
        out = np.zeros(len(ids), np.int64)
        begins = np.array([p[1] for p in self.parts], np.int64)
        part = np.searchsorted(begins, ids, "right") - 1
        for p in np.unique(part[part >= 0]).tolist():
            at = np.flatnonzero(part == p)
            out[at] = _words(self.parts[p][2])[1][ids[at] - begins[p]]
        return out


class NodeLevel:
    """``parts`` are (first parent, first child, first node, place), in order."""

    def __init__(self, parts: list[tuple[int, int, int, str]], size: int):
        self.parts, self.size = parts, size
        self.parent = np.array([p[0] for p in parts], np.int64)
        self.child = np.array([p[1] for p in parts], np.int64)
        self.node = np.array([p[2] for p in parts], np.int64)

    def _part(self, parent: np.ndarray, child: np.ndarray) -> np.ndarray:
        """The file that would hold each pair; a parent may span several."""
        part = np.searchsorted(self.parent, parent, "right") - 1
        while True:
            back = (part > 0) & (self.parent[part] == parent) & (self.child[part] > child)
            if not back.any():
                return np.maximum(part, 0)
            part = part - back

    def find(self, parent: np.ndarray, child: np.ndarray):
        """Node, score and the parent's weight: -1, 0 and 0 where unknown."""
        if not self.parts:
            nothing = np.zeros(len(parent))
            return np.full(len(parent), -1, np.int64), nothing, nothing
        parent, child, of = distinct(parent, child)
        node = np.full(len(parent), -1, np.int64)
        score, weight = np.zeros(len(parent)), np.zeros(len(parent))
        # Pairs in order lie in files in order.
        for p, at in _runs(self._part(parent, child)):
            held = _nodes(self.parts[p][3])
            found, begin, weight[at] = held.find(parent[at], child[at])
            ok = found >= 0
            node[at][ok] = found[ok] + self.node[p]
            score[at][ok] = held.book[held.codes[found[ok]]]
            # A parent that this file ends before may begin the next one.
            if p + 1 < len(self.parts):
                late = at.start + np.flatnonzero((begin < 0) & (parent[at] == self.parent[p + 1]))
                if len(late):
                    after = _nodes(self.parts[p + 1][3])
                    weight[late] = after.find(parent[late], child[late])[2]
        return node[of], score[of], weight[of]

    def begin(self, parent: np.ndarray) -> np.ndarray:
        """The first node of each parent."""
        given, of = encoded(parent)
        order = np.argsort(given)
        parent = given[order]
        out = np.full(len(parent), -1, np.int64)
        part = self._part(parent, np.zeros(len(parent), np.int64))
        # The first child may lie in this file, or be the first of the next one.
        for step in (0, 1):
            open_ = np.flatnonzero(out < 0)
            for p, run in _runs(np.minimum(part[open_] + step, len(self.parts) - 1)):
                at = open_[run]
                first = _nodes(self.parts[p][3]).begin(parent[at])
                ok = first >= 0
                out[at[ok]] = first[ok] + self.node[p]
        own = np.empty_like(out)
        own[order] = out
        return own[of]

    def pair(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Parent and child of each node."""
        parent, child = np.zeros(len(nodes), np.int64), np.zeros(len(nodes), np.int64)
        part = np.searchsorted(self.node, nodes, "right") - 1
        for p in np.unique(part).tolist():
            at = np.flatnonzero(part == p)
            parent[at], child[at] = _nodes(self.parts[p][3]).pair(nodes[at] - self.node[p])
        return parent, child

    def children(self, parent: int) -> int:
        last = int(np.searchsorted(self.parent, parent, "right")) - 1
        found = 0
        while last >= 0:
            found += _nodes(self.parts[last][3]).children(parent)
            if self.parent[last] < parent:
                break
            last -= 1
        return found

    def counts(self, nodes: np.ndarray) -> np.ndarray:
        return self._each(nodes, lambda held, i: held.counts[i], np.int64)

    def scores(self, nodes: np.ndarray) -> np.ndarray:
        return self._each(nodes, lambda held, i: held.book[held.codes[i]], float)

    def _each(self, nodes: np.ndarray, read, kind) -> np.ndarray:
        out = np.zeros(len(nodes), kind)
        part = np.searchsorted(self.node, nodes, "right") - 1
        for p in np.unique(part).tolist():
            at = np.flatnonzero(part == p)
            out[at] = read(_nodes(self.parts[p][3]), nodes[at] - self.node[p])
        return out
