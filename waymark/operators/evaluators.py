"""User-written Python confirmation logic over points in track and time order."""

from __future__ import annotations

import pickle
from abc import ABC, abstractmethod
from collections import deque
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..columns import Columns, require_columns
from ..session import written

_STRETCH = "__stretch"
_CUT = "__cut"
_NULL = "__null_"
#: Rows that are put in order together at least; more stretches than one lie in them.
RANGE_ROWS = 100_000
_ROW_FOR_ROW = "Confirmation logic has to answer every row it is given, once."

# evaluator(config, points of one track in time order) -> path columns
TrackEvaluator = Callable[[dict[str, Any], pd.DataFrame], pd.DataFrame]
# The same for long tracks: batches of one track in, batches of paths out.
BatchEvaluator = Callable[
    [dict[str, Any], Iterator[pd.DataFrame]], Iterator[pd.DataFrame]
]


def row_evaluator(
    points: DataFrame,
    evaluator: TrackEvaluator,
    config: dict[str, Any],
    paths: Sequence[str],
) -> DataFrame:
    """Run logic that looks at one row at a time: no shuffle, no ordering."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield _with_paths(batch, evaluator(config, batch), paths)

    return points.mapInPandas(run, _schema(points, paths))


def batch_evaluator(
    points: DataFrame,
    evaluator: BatchEvaluator,
    config: dict[str, Any],
    paths: Sequence[str],
    columns: Columns = Columns(),
) -> DataFrame:
    """Run logic that depends on a track's history, one bounded batch at a time.

    The evaluator sees the batches of one track in time order and keeps what it
    needs between them, so a track of any length fits into memory. Such logic is
    sequential and stays on one task a track; :func:`mergeable_evaluator` is not.
    """
    require_columns(points, [columns.track, columns.time, columns.row])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unanswered: deque[pd.DataFrame] = deque()

        def feed() -> Iterator[pd.DataFrame]:
            for batch in batches:
                unanswered.append(batch)
                yield batch

        for result in evaluator(config, feed()):
            if not unanswered:
                raise ValueError(_ROW_FOR_ROW)
            yield _with_paths(unanswered.popleft(), result, paths)
        # Logic that skips a batch or stops early must not lose rows.
        if unanswered or next(iter(batches), None) is not None:
            raise ValueError(_ROW_FOR_ROW)

    return _by_track(points, columns).applyInPandas(
        _iterator_typed(run), _schema(points, paths)
    )


def track_evaluator(
    points: DataFrame,
    evaluator: TrackEvaluator,
    config: dict[str, Any],
    paths: Sequence[str],
    columns: Columns = Columns(),
    *,
    max_track_rows: int = 5_000_000,
) -> DataFrame:
    """Run logic that needs a whole track in one frame.

    A track longer than ``max_track_rows`` is refused with an error instead of
    exhausting a worker; such logic belongs into :func:`batch_evaluator`.
    """

    def whole(config: dict[str, Any], batches: Iterator[pd.DataFrame]):
        parts: list[pd.DataFrame] = []
        rows = 0
        for part in batches:
            rows += len(part)
            if rows > max_track_rows:
                raise ValueError(
                    f"A track has more than {max_track_rows} rows; "
                    "use a batch evaluator."
                )
            parts.append(part)
        result = evaluator(config, pd.concat(parts, ignore_index=True))
        if len(result) != rows:
            raise ValueError(_ROW_FOR_ROW)
        start = 0
        for part in parts:
            yield result.iloc[start : start + len(part)]
            start += len(part)

    return batch_evaluator(points, whole, config, paths, columns)


class MergeableLogic(ABC):
    """Logic over a track's history whose state can be put together from parts.

    A state is any picklable value. ``merge`` must be associative: the state of a
    stretch is the same however it was cut.
    """

    @abstractmethod
    def summary(self, config: dict[str, Any], points: pd.DataFrame) -> Any:
        """The state after a stretch of points, seen on its own."""

    @abstractmethod
    def merge(self, first: Any, then: Any) -> Any:
        """The state after two stretches, the second following the first."""

    @abstractmethod
    def paths(
        self, config: dict[str, Any], points: pd.DataFrame, before: Any | None
    ) -> pd.DataFrame:
        """Path columns of a stretch, given the state of all points before it."""


def mergeable_evaluator(
    points: DataFrame,
    logic: MergeableLogic,
    config: dict[str, Any],
    paths: Sequence[str],
    columns: Columns = Columns(),
    *,
    stretch_rows: int = 100_000,
) -> DataFrame:
    """Run mergeable logic so that one long track is the work of many tasks.

    Points are put in order, nulls last, and cut into stretches of ``stretch_rows``.
    Most tracks lie in one stretch: a task answers these one after another, batch by
    batch. Of a track that is cut, each stretch is summed up on its own, the few
    states are added up in order, and a second pass answers every stretch from the
    state before it.
    """
    require_columns(points, [columns.track, columns.time, columns.row])
    order = [columns.track, columns.time, columns.row]
    by = [F.col(c).asc_nulls_last() for c in order]
    ranges = max(1, -(-points.count() // max(stretch_rows, RANGE_ROWS)))
    # Ids rise within a range and differ widely between ranges.
    ordered = written(
        points.repartitionByRange(ranges, *by)
        .sortWithinPartitions(*by)
        .withColumn(_STRETCH, F.expr(f"monotonically_increasing_id() div {stretch_rows}")),
        "stretches",
    )
    # A cut belongs to one track, so there are at most as many as stretches.
    cut = F.broadcast(
        ordered.groupBy(F.col(columns.track).alias(_CUT))
        .agg(F.min(_STRETCH).alias("first"), F.max(_STRETCH).alias("last"))
        .filter("first < last")
        .select(_CUT)
    )
    of_cut = F.col(columns.track).eqNullSafe(F.col(_CUT))
    whole = ordered.join(cut, of_cut, "left_anti").repartition(ranges, _STRETCH)
    answered = _answer_tracks(
        whole.sortWithinPartitions(*by).drop(_STRETCH), logic, config, paths, columns
    )
    ordered = ordered.join(cut, of_cut, "left_semi")
    stretch = [columns.track, _STRETCH]
    kept = [f.name for f in points.schema]
    track_type = points.schema[columns.track].dataType.simpleString()
    states = f"`{columns.track}` {track_type}, {_STRETCH} long, state binary"

    def in_order(part: pd.DataFrame) -> pd.DataFrame:
        return part.sort_values(order, ignore_index=True)

    def row_of(part: pd.DataFrame, state: Any) -> pd.DataFrame:
        return part[stretch].iloc[:1].assign(state=[pickle.dumps(state)])

    def summarise(part: pd.DataFrame) -> pd.DataFrame:
        return row_of(part, logic.summary(config, in_order(part)[kept]))

    def add_up(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(_STRETCH, ignore_index=True)
        before, out = None, []
        for place in range(len(part)):
            own = pickle.loads(part["state"].iloc[place])
            out.append(pickle.dumps(before))
            before = own if before is None else logic.merge(before, own)
        return part.assign(state=out)

    def answer(part: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        part = in_order(part)[kept]
        before = pickle.loads(state["state"].iloc[0])
        found = _with_paths(part, logic.paths(config, part, before), paths)
        return found[[*[c for c in kept if c not in paths], *paths]]

    # A track has as many states as it has stretches.
    befores = (
        ordered.groupBy(*stretch)
        .applyInPandas(summarise, states)
        .groupBy(columns.track)
        .applyInPandas(add_up, states)
    )
    return answered.union(
        ordered.groupBy(*stretch)
        .cogroup(befores.groupBy(*stretch))
        .applyInPandas(answer, _schema(points, paths))
    )


def _answer_tracks(
    points: DataFrame,
    logic: MergeableLogic,
    config: dict[str, Any],
    paths: Sequence[str],
    columns: Columns,
) -> DataFrame:
    """Answer tracks that lie in order in their partitions, many to a batch.

    Nulls turn a batch's integers into floats and its booleans into objects. So
    they travel as flags beside such columns, and only a track that has nulls is
    given them.
    """
    schema = _schema(points, paths)
    kept = [f.name for f in points.schema]
    plain = [
        f.name
        for f in points.schema
        if f.nullable and isinstance(f.dataType, (T.IntegralType, T.BooleanType))
    ]
    boolean = {f.name for f in points.schema if isinstance(f.dataType, T.BooleanType)}

    def given(field: T.StructField):
        if field.name not in plain:
            return F.col(field.name)
        return F.coalesce(field.name, F.lit(0).cast(field.dataType)).alias(field.name)

    flagged = [*plain, *([] if columns.track in plain else [columns.track])]
    sent = points.select(
        *map(given, points.schema), *(F.col(c).isNull().alias(_NULL + c) for c in flagged)
    )

    def seen(part: pd.DataFrame, nulls: list[str]) -> pd.DataFrame:
        own = part[kept].reset_index(drop=True)
        for name in nulls:
            absent = part[_NULL + name].reset_index(drop=True)
            if absent.any():
                values = own[name].astype(object) if name in boolean else own[name]
                own[name] = values.mask(absent, None if name in boolean else float("nan"))
        return own

    def answer(batch: pd.DataFrame, begins: list[int]) -> pd.DataFrame:
        nulls = [c for c in plain if batch[_NULL + c].any()]
        found: dict[str, list[pd.Series]] = {path: [] for path in paths}
        for begin, end in zip(begins, [*begins[1:], len(batch)]):
            part = seen(batch.iloc[begin:end], nulls)
            for path, flags in _flags(part, logic.paths(config, part, None), paths).items():
                found[path].append(pd.Series(flags))
        out = {c: batch[c].reset_index(drop=True) for c in kept if c not in paths}
        for name in set(nulls) & set(out):
            kind = "boolean" if name in boolean else out[name].dtype.name.capitalize()
            extension = pd.array(out[name].to_numpy(), dtype=kind)
            extension[batch[_NULL + name].to_numpy()] = pd.NA
            out[name] = pd.Series(extension)
        return pd.DataFrame(out | {p: pd.concat(x, ignore_index=True) for p, x in found.items()})

    def begins_of(batch: pd.DataFrame) -> list[int]:
        track, absent = batch[columns.track], batch[_NULL + columns.track]
        before = track.shift(1, fill_value=track.iloc[0])
        new = (absent != absent.shift(1, fill_value=absent.iloc[0])) | (~absent & (track != before))
        new.iloc[0] = True
        return new.to_numpy().nonzero()[0].tolist()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # A batch may end within a track; a track is no longer than a stretch.
        rest: pd.DataFrame | None = None
        for batch in batches:
            if len(batch) == 0:
                continue
            if rest is not None:
                batch = pd.concat([rest, batch], ignore_index=True)
            *begins, last = begins_of(batch)
            rest = batch.iloc[last:]
            if begins:
                yield answer(batch.iloc[:last], begins)
        if rest is not None:
            yield answer(rest, [0])

    return sent.mapInPandas(run, schema)


def _by_track(points: DataFrame, columns: Columns):
    # The grouping below reuses this exchange and this order.
    ordered = points.repartition(columns.track).sortWithinPartitions(
        columns.track, columns.time, columns.row
    )
    return ordered.groupBy(columns.track)


def _iterator_typed(run: Callable) -> Callable:
    def stream(batches):
        yield from run(batches)

    stream.__annotations__ = {
        "batches": Iterator[pd.DataFrame],
        "return": Iterator[pd.DataFrame],
    }
    return stream


def _schema(points: DataFrame, paths: Sequence[str]) -> T.StructType:
    extra = [T.StructField(path, T.ByteType()) for path in paths]
    return T.StructType([f for f in points.schema if f.name not in paths] + extra)


def _flags(batch: pd.DataFrame, result: pd.DataFrame, paths: Sequence[str]) -> dict[str, Any]:
    if len(result) != len(batch):
        raise ValueError(_ROW_FOR_ROW)
    missing = sorted(set(paths) - set(result.columns))
    if missing:
        raise ValueError(f"The logic gave no column for the paths {missing}.")
    return {path: pd.array(result[path], dtype="Int8") for path in paths}


def _with_paths(
    batch: pd.DataFrame, result: pd.DataFrame, paths: Sequence[str]
) -> pd.DataFrame:
    return batch.assign(**_flags(batch, result, paths))
