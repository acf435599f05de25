"""Histograms of wide rows: cells are counted in each partition, in Arrow batches, so that no row is made of each value.

A batch of rows is one array of cell numbers, counted at once; a partition
keeps one number and count for each cell that it has met. What leaves it is one
row a cell, added up by Spark. Cells beyond FLUSH leave before the partition ends.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: From so many features on, select_features counts this way.
WIDE, FLUSH = 24, 4_000_000
_WHOLE = ("tinyint", "smallint", "int", "bigint")


def whole(df: DataFrame, bins: str) -> bool:
    """Whether the column holds arrays of whole numbers: others are counted row by row."""
    kind = df.schema[bins].dataType
    return kind.typeName() == "array" and kind.elementType.simpleString() in _WHOLE


class Cells:
    """Counts of cells (feature, x, group), numbered feature by feature; spans of x and groups double as needed. Once a value is negative, values are folded: 0, -1, 1, -2, ..."""

    def __init__(self):
        self.spans, self.groups, self.folded = (16, 4), {}, False
        self.numbers, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def code(self, columns: list[list]) -> np.ndarray:
        """A number for each row's values of the other columns."""
        return np.array([self.groups.setdefault(g, len(self.groups)) for g in zip(*columns, strict=True)], np.int64)

    def parts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rest, group = np.divmod(self.numbers, self.spans[1])
        return *np.divmod(rest, self.spans[0]), group

    def add(self, feature: np.ndarray, x: np.ndarray, group: np.ndarray) -> None:
        """feature, x and group are as long as each other, or spread over rows and features."""
        if not x.size:
            return
        if not self.folded and x.min() < 0:
            f, v, g = self.parts()
            self.folded, self.spans = True, (2 * self.spans[0], self.spans[1])
            self.numbers = (f * self.spans[0] + 2 * v) * self.spans[1] + g
        if self.folded:
            x = (x << 1) ^ (x >> 63)
        spans = tuple(max(s, 1 << int(m).bit_length()) for s, m in zip(self.spans, (x.max(), max(len(self.groups) - 1, 0)), strict=True))
        if spans != self.spans:
            f, v, g = self.parts()
            self.spans, self.numbers = spans, (f * spans[0] + v) * spans[1] + g
        numbers = ((feature * spans[0] + x) * spans[1] + group).ravel()
        if numbers.max() <= 4 * len(numbers):
            counted = np.bincount(numbers)
            new = np.flatnonzero(counted)
            counts = counted[new]
        else:
            new, counts = np.unique(numbers, return_counts=True)
        every, place = np.unique(np.concatenate([self.numbers, new]), return_inverse=True)
        total = np.zeros(len(every), np.int64)
        total[place[: len(self.numbers)]] = self.counts
        np.add.at(total, place[len(self.numbers) :], counts)
        self.numbers, self.counts = every, total

    def batch(self, others: int) -> pa.RecordBatch:
        f, x, g = self.parts()
        keys = list(self.groups)
        columns = [pa.array([keys[i][k] for i in g.tolist()], pa.int64()) for k in range(others)]
        if self.folded:
            x = (x >> 1) ^ -(x & 1)
        return pa.record_batch([pa.array(f.astype(np.int32)), pa.array(x), *columns, pa.array(self.counts)], ["feature", "x", *[f"o{k}" for k in range(others)], "n"])


def _counter(others: int, keep: list[int] | None, skip: int | None):
    def wanted(feature: np.ndarray) -> np.ndarray:
        mask = np.ones(len(feature), bool) if keep is None else np.isin(feature, keep)
        return mask if skip is None else mask & (feature != skip)

    def of(batches):
        cells = Cells()
        for b in batches:
            lists, columns = b.column("bins"), [b.column(f"o{k}").to_pylist() for k in range(others)]
            lengths = np.asarray(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
            values = lists.flatten()
            group = cells.code(columns)
            if len(lengths) and not values.null_count and (lengths == lengths[0]).all():
                # a table of rows and features
                feature = np.flatnonzero(wanted(np.arange(lengths[0])))
                x = values.to_numpy().reshape(len(lengths), -1)
                x = (x if len(feature) == lengths[0] else x[:, feature]).astype(np.int64)
                cells.add(feature[None], x, group[:, None])
                if len(cells.numbers) > FLUSH:
                    yield cells.batch(others)
                    cells = Cells()
                continue
            ends = np.cumsum(lengths)
            feature = np.arange(len(values)) - np.repeat(ends - lengths, lengths)
            ok = np.asarray(values.is_valid().to_numpy(zero_copy_only=False), bool) & wanted(feature)
            x = values.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)[ok]
            cells.add(feature[ok], x, np.repeat(group, lengths)[ok])
            if len(cells.numbers) > FLUSH:
                yield cells.batch(others)
                cells = Cells()
        if len(cells.numbers):
            yield cells.batch(others)

    return of


def counted(df: DataFrame, bins: str, others: dict[str, Column], features: list[int] | None = None, skip: int | None = None) -> DataFrame:
    """(feature, x, *others, n) of rows with an array of whole numbers, others being whole numbers too: feature's value x beside them. features: these only; skip: not this."""
    kinds = {name: df.select(c.alias(name)).schema[name].dataType.simpleString() for name, c in others.items()}
    value = df.schema[bins].dataType.elementType.simpleString()
    rows = df.select(F.col(bins).alias("bins"), *[c.cast("bigint").alias(f"o{k}") for k, c in enumerate(others.values())])
    schema = "feature int, x bigint, " + "".join(f"o{k} bigint, " for k in range(len(others))) + "n bigint"
    cells = rows.mapInArrow(_counter(len(others), features, skip), schema)
    named = [F.col(f"o{k}").cast(kinds[name]).alias(name) for k, name in enumerate(others)]
    return cells.select("feature", F.col("x").cast(value).alias("x"), *named, "n").groupBy("feature", "x", *others).agg(F.sum("n").alias("n"))


def hist2(df: DataFrame, bins: str = "bins", features: list[int] | None = None) -> DataFrame:
    """info.hist2() of the rows' long form."""
    return counted(df, bins, {"y": F.col("y")}, features)


def hist3(df: DataFrame, pick: int, bins: str = "bins", features: list[int] | None = None) -> DataFrame:
    """info.hist3()."""
    rows = df.where(F.col(bins)[pick].isNotNull())
    return counted(rows, bins, {"y": F.col(bins)[pick], "z": F.col("y")}, features, pick)
