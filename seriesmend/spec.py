"""The layout of a set of series in a table, and the windows and maps that operators share."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesmend.runtime import arrow_map

#: Rows that a kernel of many samples gets at once, at least.
TOGETHER = 8192


@dataclass(frozen=True)
class SeriesSpec:
    """A row is one time step of one sample: sample, t (0, 1, ... without gaps), timestamp, and features; null is missing. (sample, t) is unique."""

    features: tuple[str, ...] = ("col_1",)
    sample: str = "sample_id"
    t: str = "t"
    timestamp: str = "timestamp"

    @property
    def keys(self) -> list[str]:
        return [self.sample, self.t]

    @property
    def whole(self):
        """All rows of a sample."""
        return Window.partitionBy(self.sample)

    @property
    def ordered(self):
        return Window.partitionBy(self.sample).orderBy(self.t)

    def rows(self, before: int, after: int):
        """The frame of `before` rows before and `after` rows after the current one."""
        return self.ordered.rowsBetween(-before, after)


def clean_numbers(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """NaN and infinite features become null, once at ingest; all that follows knows one kind of missing value."""
    bad = lambda c: F.isnan(c) | (F.abs(c) == float("inf"))
    return df.withColumns({f: F.when(~bad(F.col(f).cast("double")), F.col(f).cast("double")) for f in spec.features})


def number_rows(df: DataFrame, spec: SeriesSpec, *order: str | Column) -> DataFrame:
    """t = place of the row in its sample by order, from 0; columns given by name have null last, as SQL has it. order must be unique in a sample."""
    order = [F.asc_nulls_last(o) if isinstance(o, str) else o for o in order]
    return df.withColumn(spec.t, (F.row_number().over(Window.partitionBy(spec.sample).orderBy(*order)) - 1).cast("long"))


def per_series(df: DataFrame, spec: SeriesSpec, kernel: Callable[[np.ndarray, np.ndarray], np.ndarray], out: list[str] | None = None, keep: list[str] | None = None, many: bool = False) -> DataFrame:
    """Apply kernel(values (T x D, NaN missing), times (T)) to each sample in order of t. What it returns (T x len(out) or T) goes to the columns `out` (default: the features,
    replaced). keep: further columns that stay. A sample is held by one task: for algorithms where a value needs the repaired one before it. Samples come sorted, as Arrow batches: a
    call for each sample costs no more than its kernel. The kernel gets a missing time as that of the row before it (at the start: the first known one, 0 without any); what comes out has it missing. many: kernel(lists of values and times) -> a list, for all samples
    of TOGETHER rows or more at once."""
    out = list(spec.features) if out is None else out
    kept = [spec.sample, spec.t, spec.timestamp, *(keep or []), *[f for f in spec.features if f not in out]]
    kept = [c for c in dict.fromkeys(kept) if c in df.columns]
    schema = T.StructType([*[df.schema[c] for c in kept], *[T.StructField(o, T.DoubleType()) for o in out]])
    features, timestamp = list(spec.features), spec.timestamp if spec.timestamp in kept else spec.t

    def solved(rows: pa.Table, ends: list[int]) -> dict:
        values = np.stack([_floats(rows[f]) for f in features], axis=1) if features else np.zeros((len(rows), 0))
        times = _floats(rows[timestamp])
        spans = list(zip([0, *ends], ends, strict=False))
        xs, ts = [values[a:b].copy() for a, b in spans], [_known(times[a:b]) for a, b in spans]
        got = kernel(xs, ts) if many else map(kernel, xs, ts)
        got = np.concatenate([np.asarray(g, float).reshape(len(x), len(out)) for g, x in zip(got, xs, strict=True)])
        return {**{c: rows[c] for c in kept}, **{o: pa.array(got[:, i], mask=~np.isfinite(got[:, i])) for i, o in enumerate(out)}}

    def ends_of(rows: pa.Table) -> list[int]:
        """Places where another sample begins; null is a sample like any other."""
        codes = rows[spec.sample].combine_chunks()
        codes = codes.chunk(0) if isinstance(codes, pa.ChunkedArray) else codes
        codes = codes.dictionary_encode(null_encoding="encode").indices.to_numpy()
        return (np.flatnonzero(codes[1:] != codes[:-1]) + 1).tolist()

    def run(batches):
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            ids = b.column(b.schema.get_field_index(spec.sample))
            going_on = held and held[0].column(held[0].schema.get_field_index(spec.sample))[-1].as_py() == ids[0].as_py() == ids[-1].as_py()
            held.append(b)
            if going_on or many and sum(len(h) for h in held) < TOGETHER:
                continue
            rows = pa.Table.from_batches(held)
            ends = ends_of(rows)
            if ends:
                yield solved(rows.slice(0, ends[-1]), ends)
                held = rows.slice(ends[-1]).combine_chunks().to_batches()
        if held:
            rows = pa.Table.from_batches(held)
            yield solved(rows, [*ends_of(rows), len(rows)])

    dealt = df.select(*dict.fromkeys([*kept, *features])).repartition(spec.sample).sortWithinPartitions(spec.sample, spec.t)
    return arrow_map(dealt, run, schema)


def _floats(column: pa.ChunkedArray) -> np.ndarray:
    """Doubles, NaN for null; timestamps in seconds."""
    if pa.types.is_timestamp(column.type):
        return column.cast(pa.timestamp("us", column.type.tz)).cast(pa.int64()).cast(pa.float64(), safe=False).to_numpy() / 1e6
    return column.cast(pa.float64(), safe=False).to_numpy()


def _known(times: np.ndarray) -> np.ndarray:
    """A copy with missing times filled."""
    good = np.flatnonzero(np.isfinite(times))
    return times[good[np.maximum(np.searchsorted(good, np.arange(len(times)), "right") - 1, 0)]] if len(good) else np.zeros(len(times))


def long_form(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """(sample, t, col, value) of every cell."""
    return df.select(*spec.keys, *[F.col(f).cast("double").alias(f) for f in spec.features]).unpivot(spec.keys, list(spec.features), "col", "value")


def wide_form(cells: DataFrame, spec: SeriesSpec, value: str = "value") -> DataFrame:
    """A column for each feature again."""
    return cells.groupBy(*spec.keys).pivot("col", list(spec.features)).agg(F.first(value))
