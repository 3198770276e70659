"""Language-model scores from an Elias-Fano n-gram trie.

Words and n-grams are counted by Spark over all training texts, level by level:
an n-gram can only be as frequent as its two shorter parts, so each level is
counted within the one below and kept from a least count on. A level takes one
shuffle: the counts of the level below tell key ranges of equally many tokens, a
counting task hands on, for each range, its sorted n-grams as one packed row, and
the task that holds a range adds them up and writes its file. A context with more
tokens than a range is cut into several; what its n-grams leave over is then
added up beforehand, from the counts of its ranges alone. Probabilities are
interpolated with absolute discounting down to add-one word probabilities, and
what the kept n-grams of a context leave over is its weight for shorter ones.
Each level is written as sorted files in the shared folder; scoring maps them
into memory and looks up each token among the successors of its context.

Edge cases: a null or empty text is its end alone; without training texts every
token has probability 1; a null doc_id is scored but never trained on; repeated
rows count each; further columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm.storage import dropped, shared_folder, written
from waymark.llm.trie import NodeLevel, WordLevel, build_nodes, build_words, distinct, encoded, narrowed
from waymark.llm.words import Words, slices

SLICE = 1 << 22
#: Tokens that a counting task sums up before it hands the counts on.
HELD_TOKENS = 4_000_000
#: Words of one file of the trie; training tokens of one file of n-grams.
PART_ENTRIES = 2_000_000
DISCOUNT = 0.75
END = (1 << 63) - 1


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training, by the checksum of its id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 7 == 2, F.lit(False))


@dataclass
class Tokens:
    """Tokens of a slice's texts one after another, each text's end included."""

    keys: np.ndarray
    bounds: np.ndarray

    @classmethod
    def of(cls, column: pa.Array) -> Tokens:
        words = Words.of(column, lower=True)
        keys = (words.hashes >> np.uint64(1)).astype(np.int64)
        ends = words.bounds[1:]
        return cls(
            np.insert(keys, ends, END),
            np.append(0, ends + np.arange(1, len(ends) + 1)),
        )

    def sums(self, values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values, self.bounds[:-1])


@dataclass
class Model:
    """The trie: places of its files, and the size of the training set."""

    words: WordLevel
    levels: list[NodeLevel]
    tokens: int
    texts: int

    @property
    def start(self) -> int:
        """The id of the context before a text's first word."""
        return self.words.size

    def word_score(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 1) / (self.tokens + self.words.size + 1))

    def occurrences(self, parents: np.ndarray) -> np.ndarray:
        """How often each context of the next level occurs in training."""
        if self.levels:
            return self.levels[-1].counts(parents)
        out = np.full(len(parents), self.texts, np.int64)
        inner = parents < self.start
        out[inner] = self.words.counts(parents[inner])
        return out

    def suffix(self, level: int, nodes: np.ndarray) -> np.ndarray:
        """The contexts that the nodes of a level are without their first word."""
        parent, child = self.levels[level].pair(nodes)
        if level == 0:
            return child
        return self.levels[level - 1].begin(self.suffix(level - 1, parent)) + child

    def successors(self, parent: int) -> int:
        """The children that a context of the next level has at most."""
        if not self.levels:
            return self.words.size
        shorter = self.suffix(len(self.levels) - 1, np.array([parent]))
        return self.levels[-1].children(int(shorter[0]))

    def chains(self, ids: np.ndarray, bounds: np.ndarray, levels: int):
        """Per level: parent, child, lower node, node, score and weight."""
        nodes, parents = ids, np.append(self.start, ids[:-1])
        parents[bounds[:-1]] = self.start
        shorter: np.ndarray | None = None
        for depth, level in enumerate(self.levels[:levels]):
            if depth == 0:
                child = nodes
            else:
                # The place among the successors of the context less its first word.
                begin = self.levels[depth - 1].begin(shorter)
                child = np.where((nodes >= 0) & (begin >= 0), nodes - begin, -1)
            found, score, weight = level.find(parents, child)
            yield parents, child, nodes, found, score, weight
            shorter = parents
            nodes = found
            parents = np.append(-1, found[:-1])
            parents[bounds[:-1]] = -1


class _Tally:
    """Counts of equal words, handed on when enough tokens are held."""

    def __init__(self):
        self.keys: list[np.ndarray] = []
        self.size = 0

    def add(self, keys: np.ndarray) -> None:
        self.keys.append(keys)
        self.size += len(keys)

    def batches(self, force: bool = False) -> Iterator[pa.RecordBatch]:
        if self.size == 0 or (self.size < HELD_TOKENS and not force):
            return
        keys, counts = _summed(np.concatenate(self.keys))
        self.keys, self.size = [], 0
        for at in range(0, len(keys), 1 << 16):
            part = slice(at, at + (1 << 16))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[part]), pa.array(counts[part])], ["key", "n"]
            )


def _summed(keys: np.ndarray, counts: np.ndarray | None = None):
    """The different keys, in order, and how often each occurs."""
    if counts is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    if counts is None:
        return keys[at], np.diff(np.append(at, len(keys)))
    return keys[at], np.add.reduceat(counts, at) if len(at) else counts


def pack(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Rising keys and their counts: differences by byte planes, compressed."""
    steps = np.diff(keys, prepend=0).astype("<u8")
    planes = steps.view(np.uint8).reshape(-1, 8).T
    wide = max(1, -(-int(steps.max(initial=0)).bit_length() // 8))
    small = narrowed(counts)
    body = np.ascontiguousarray(planes[:wide]).tobytes() + small.tobytes()
    head = np.array([len(keys), wide, small.itemsize, len(body)], "<i8").tobytes()
    return head + pa.compress(body, codec="zstd", asbytes=True)


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, wide, itemsize, size = np.frombuffer(data[:32], "<i8").tolist()
    body = pa.decompress(data[32:], decompressed_size=size, codec="zstd", asbytes=True)
    planes = np.zeros((8, n), np.uint8)
    planes[:wide] = np.frombuffer(body, np.uint8, wide * n).reshape(wide, n)
    steps = np.ascontiguousarray(planes.T).view("<u8").ravel()
    counts = np.frombuffer(body, f"u{itemsize}", n, wide * n)
    return np.cumsum(steps).astype(np.int64), counts.astype(np.int64)


def _merged(packed: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Packed counts added up, in rising order of keys."""
    sizes = [int(np.frombuffer(d.as_buffer(), "<i8", 1)[0]) for d in packed]
    keys, n = np.empty(sum(sizes), np.int64), np.empty(sum(sizes), np.int64)
    at = 0
    for data, size in zip(packed, sizes):
        keys[at : at + size], n[at : at + size] = unpack(data.as_py())
        at += size
    return _summed(keys, n)


@dataclass
class Ranges:
    """Where the ranges of (parent, child) begin, in order."""

    parent: np.ndarray
    child: np.ndarray

    @classmethod
    def of(cls, cuts: Iterable[tuple[int, int]], width: Callable[[int], int]) -> Ranges:
        """From parents that begin a range, and into how many each is cut."""
        begins = [
            (parent, width(parent) * piece // pieces if piece else 0)
            for parent, pieces in sorted(cuts)
            for piece in range(pieces)
        ]
        begins = sorted({(0, 0), *begins})
        return cls(*np.array(begins, np.int64).T)

    def place(self, parent: np.ndarray, child: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.parent, parent, "right") - 1
        while True:
            back = (self.parent[at] == parent) & (self.child[at] > child)
            if not back.any():
                return at
            at = at - back

    @property
    def shared(self) -> np.ndarray:
        """Parents that lie in several ranges."""
        return np.unique(self.parent[self.child > 0])


def cut_points(counts: np.ndarray, size: int) -> list[dict]:
    """Nodes of a file at which a range of ``size`` tokens of the next level begins.

    A node with more tokens than a range is a row of ranges of its own.
    """
    total = np.cumsum(counts)
    chunk = (total - counts) // size
    begins = np.flatnonzero(np.append(True, chunk[1:] != chunk[:-1])[: len(chunk)])
    large = np.flatnonzero(counts > size)
    at = np.unique(np.concatenate([begins, large, large + 1]))
    at = at[at < len(counts)]
    pieces = -(-counts[at] // size)
    return [{"node": int(k), "pieces": max(1, int(p))} for k, p in zip(at, pieces)]


def _gathered(batches: Iterable[pa.RecordBatch]) -> dict[str, np.ndarray] | None:
    table = [b for b in batches if b.num_rows]
    if not table:
        return None
    whole = pa.Table.from_batches(table)
    return {c: whole[c].to_numpy() for c in whole.column_names}


_CUTS = "cuts array<struct<node:long,pieces:long>>"


def _count_words(training: DataFrame) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = _Tally()
        for part in slices(batches, limit=SLICE):
            tally.add(Tokens.of(part.column("text")).keys)
            yield from tally.batches()
        yield from tally.batches(force=True)

    rows = training.select("text").mapInArrow(run, "key long, n long")
    return rows.groupBy("key").agg(F.sum("n").alias("n"))


def _write_words(counted: DataFrame, entries: int, folder: str) -> tuple[WordLevel, list]:
    """The level, and where ranges of pairs begin."""
    size = PART_ENTRIES

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _gathered(batches)
        if rows is not None:
            place = build_words(folder, rows["key"], rows["n"])
            row = {"first": int(rows["key"][0]), "many": len(rows["key"]), "place": place}
            yield pa.RecordBatch.from_pylist([{**row, "cuts": cut_points(rows["n"], size)}])

    parts = -(-entries // PART_ENTRIES)
    files = (
        counted.repartitionByRange(max(parts, 1), "key")
        .sortWithinPartitions("key")
        .mapInArrow(run, f"first long, many long, place string, {_CUTS}")
        .collect()
    )
    out, cuts, at = [], [], 0
    for row in sorted(files, key=lambda r: r.first):
        out.append((row.first, at, row.place))
        cuts += [(cut.node + at, cut.pieces) for cut in row.cuts]
        at += row.many
    return WordLevel(out, at), cuts


def _counts_of_pairs(parent: np.ndarray, child: np.ndarray) -> tuple[np.ndarray, ...]:
    """The different pairs, in order, and how often each occurs."""
    wide = int(child.max(initial=0)) + 1
    if (int(parent.max(initial=0)) + 1) * wide < 1 << 63:
        keys, n = _summed(parent * wide + child)
        return keys // wide, keys % wide, n
    parent, child, of = distinct(parent, child)
    return parent, child, np.bincount(of, minlength=len(parent))


def _counted(
    model: Model, training: DataFrame, ranges: Ranges, twice: bool = False
) -> DataFrame:
    """``part`` and packed counts of the n-grams of one more level, by range.

    A key is the parent, counted from the range's first, times the number of
    words, plus the child. Counts that are read ``twice`` are written first.
    """
    depth = len(model.levels)
    probe = Model(model.words, [*model.levels, NodeLevel([], 0)], model.tokens, model.texts)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            parent, child = (np.concatenate(c) for c in zip(*held))
            held.clear()
            parent, child, n = _counts_of_pairs(parent, child)
            place = ranges.place(parent, child)
            parts, begins = np.unique(place, return_index=True)
            for part, at, end in zip(parts.tolist(), begins, np.append(begins[1:], len(n))):
                keys = (parent[at:end] - ranges.parent[part]) * model.words.size + child[at:end]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part], pa.int64()), pa.array([pack(keys, n[at:end])], pa.binary())],
                    ["part", "data"],
                )

        for batch in slices(batches, limit=SLICE):
            tokens = Tokens.of(batch.column("text"))
            ids = _ids(model, tokens)[0]
            parent, child, *_ = list(probe.chains(ids, tokens.bounds, depth + 1))[-1]
            ok = (parent >= 0) & (child >= 0)
            held.append((parent[ok], child[ok]))
            size += len(held[-1][0])
            if size >= HELD_TOKENS:
                yield from flush()
                size = 0
        yield from flush()

    counted = training.select("text").mapInArrow(run, "part long, data binary")
    return written(counted, "lm-counts") if twice else counted


def _add_level(
    model: Model, training: DataFrame, least: int, folder: str, cuts: list
) -> tuple[NodeLevel, list]:
    """The next level, and where ranges of the one after it begin."""
    depth, size = len(model.levels), PART_ENTRIES
    ranges = Ranges.of(cuts, model.successors)

    def entries(rows: pa.Table) -> tuple[np.ndarray, ...]:
        """Parents, children and counts of a range's kept n-grams."""
        keys, n = _merged(rows["data"])
        if least > 1:
            keys, n = keys[n >= least], n[n >= least]
        first = ranges.parent[rows["part"][0].as_py()]
        return keys // model.words.size + first, keys % model.words.size, n

    def taken(parent: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The different parents, how many children each has, their mass."""
        begins = np.flatnonzero(np.append(True, parent[1:] != parent[:-1])[: len(parent)])
        sizes = np.diff(np.append(begins, len(parent)))
        return parent[begins], sizes, np.add.reduceat(n - DISCOUNT, begins)

    def weigh(rows: pa.Table) -> pa.Table:
        parent, _, n = entries(rows)
        if len(n) == 0:
            return pa.table({"parent": pa.array([], pa.int64()), "mass": pa.array([], pa.float64())})
        parents, _, mass = taken(parent, n)
        own = np.isin(parents, ranges.shared)
        return pa.table({"parent": parents[own], "mass": mass[own]})

    shared: dict[int, float] = {}
    if not len(ranges.shared):
        counted = _counted(model, training, ranges)
    else:
        counted = _counted(model, training, ranges, True)
        # One row for each range of a parent that lies in several.
        of = np.flatnonzero(np.isin(ranges.parent, ranges.shared)).tolist()
        for row in (
            counted.filter(F.col("part").isin(of))
            .groupBy("part")
            .applyInArrow(weigh, "parent long, mass double")
            .collect()
        ):
            shared[row.parent] = shared.get(row.parent, 0.0) + row.mass

    fields = f"parent long, child long, many long, place string, {_CUTS}"

    def write(rows: pa.Table) -> pa.Table:
        parent, child, n = entries(rows)
        out = []
        if len(n):
            parents, sizes, mass = taken(parent, n)
            for k in np.flatnonzero(np.isin(parents, list(shared))):
                mass[k] = shared[int(parents[k])]
            context = model.occurrences(parents)
            left = np.repeat(np.maximum(1 - mass / context, 1e-9), sizes)
            if depth == 0:
                shorter = model.word_score(model.words.counts(child))
            else:
                begin = model.levels[-1].begin(model.suffix(depth - 1, parents))
                shorter = model.levels[-1].scores(np.repeat(begin, sizes) + child)
            chance = (n - DISCOUNT) / np.repeat(context, sizes) + left * 10**shorter
            del shorter
            place = build_nodes(folder, parent, child, n, np.log10(chance), np.log10(left))
            row = {"parent": int(parent[0]), "child": int(child[0]), "many": len(n)}
            out.append({**row, "place": place, "cuts": cut_points(n, size)})
        cut = pa.list_(pa.struct([("node", pa.int64()), ("pieces", pa.int64())]))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), cut]
        names = ["parent", "child", "many", "place", "cuts"]
        return pa.Table.from_pylist(out, pa.schema(list(zip(names, kinds))))

    files = counted.groupBy("part").applyInArrow(write, fields).collect()
    if len(ranges.shared):
        dropped(counted)
    out, after, at = [], [], 0
    for row in sorted(files, key=lambda r: (r.parent, r.child)):
        out.append((row.parent, row.child, at, row.place))
        after += [(cut.node + at, cut.pieces) for cut in row.cuts]
        at += row.many
    return NodeLevel(out, at), after


def _ids(model: Model, tokens: Tokens) -> tuple[np.ndarray, np.ndarray]:
    keys, of = encoded(tokens.keys)
    ids, counts = model.words.find(keys)
    return ids[of], counts[of]


def train_model(training: DataFrame, least_counts: Sequence[int] = (2,)) -> Model:
    """Count all words of ``training`` and, for each of ``least_counts``, one
    more level of n-grams that occur at least so often."""
    folder = f"{shared_folder(training.sparkSession)}/trie-{uuid.uuid4().hex}"
    counted = written(_count_words(training), "lm-words")
    entries, tokens, texts = counted.agg(
        F.count("*"),
        F.coalesce(F.sum("n"), F.lit(0)),
        F.coalesce(F.sum(F.when(F.col("key") == END, F.col("n"))), F.lit(0)),
    ).first()
    words, cuts = _write_words(counted, entries, folder)
    dropped(counted)
    model = Model(words, [], tokens, texts)
    # The context before a first word follows the words.
    cuts.append((model.start, max(1, -(-texts // PART_ENTRIES))))
    for least in least_counts:
        level, cuts = _add_level(model, training, least, folder, cuts)
        model.levels.append(level)
    return model


def score_documents(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score and score of each whole text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, limit=SLICE):
            tokens = Tokens.of(part.column("text"))
            ids, counts = _ids(model, tokens)
            base = model.word_score(counts)
            score = base.copy()
            for *_, found, own, weight in model.chains(ids, tokens.bounds, len(model.levels)):
                score = np.where(found >= 0, own, score + weight)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array(np.diff(tokens.bounds)),
                    pa.array(tokens.sums((counts > 0).astype(np.int64))),
                    pa.array(tokens.sums(base)),
                    pa.array(tokens.sums(score)),
                ],
                ["doc_id", "n_tokens", "n_known", "base_score", "score"],
            )

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n_tokens long, n_known long, base_score double, score double"
    )


def score_corpus(documents: DataFrame, least_counts: Sequence[int] = (2,)) -> DataFrame:
    """Train on the documents that are not held out and score all of them."""
    training = documents.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    model = train_model(training, least_counts)
    return score_documents(documents, model).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )
