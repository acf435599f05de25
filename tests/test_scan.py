"""Prefix scans, columnar histograms, thresholds searched by halving."""

import bisect
import collections
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from featlens.functions import dense, info, scan
from featlens.operators import evaluate, mdlp, select
from featlens.operators.bins import Thresholds
from featlens.plans import queries


def test_below_is_bisect(spark):
    rng = random.Random(1)
    rows = [(sorted(rng.choices(range(50), k=rng.randrange(40))), rng.randrange(-2, 53)) for _ in range(300)]
    df = spark.createDataFrame([(a, float(v)) for a, v in ((list(map(float, a)), v) for a, v in rows)], "a array<double>, v double")
    got = df.select("a", "v", scan.below(F.col("a"), F.col("v"), 40).alias("k")).collect()
    assert all(r.k == bisect.bisect_left(r.a, r.v) for r in got)
    odd = spark.createDataFrame([([1.0, 2.0], math.nan), ([1.0, math.inf], math.inf), ([], 1.0)], "a array<double>, v double")
    assert [r.k for r in odd.select(scan.below(F.col("a"), F.col("v")).alias("k")).collect()] == [2, 1, 0]


@pytest.mark.parametrize("rows", [7, 50, 10_000])
def test_scan_is_the_loop(spark, rows):
    rng = random.Random(rows)
    table = [(g, v, rng.randrange(5)) for g, n in ((0, 700), (1, 30), (2, 1)) for v in [rng.randrange(n) / 4 for _ in range(n)]]
    df = spark.createDataFrame(table, "g int, v double, n int").repartition(5)
    dealt = scan.parts(df, ["g"], "v", rows)
    sizes = collections.Counter((r.g, r._part) for r in dealt.collect())
    assert max(sizes.values()) <= max(3 * rows, 12) and (rows > 1000 or len(sizes) > 700 / rows / 3)
    got = scan.running(dealt, ["g"], "v", {"n": "upto"}).collect()
    assert len(got) == len(table)
    assert all(r.upto == sum(n for g, v, n in table if g == r.g and v <= r.v) for r in got)
    once = df.select("g", "v").distinct().withColumn("w", F.col("v") * 2)
    places = collections.defaultdict(list)
    for g, v in sorted({(g, v) for g, v, _ in table}):
        places[g].append(v)
    for r in scan.beside(scan.parts(once, ["g"], "v", rows), ["g"], "v", ["w"]).collect():
        k = places[r.g].index(r.v)
        assert (r._before and tuple(r._before)) == ((places[r.g][k - 1], 2 * places[r.g][k - 1]) if k else None)
        assert (r._after and r._after.v) == (places[r.g][k + 1] if k + 1 < len(places[r.g]) else None)
    none = df.where("false")
    assert scan.running(scan.parts(none, ["g"], "v", rows), ["g"], "v", {"n": "upto"}).count() == 0


def test_one_feature_of_many_values_is_dealt_over_tasks(spark):
    """The same candidates and cumulative counts, while no task has more than a few parts' share."""
    df = spark.range(60_000).select((F.pmod(F.xxhash64("id"), F.lit(3)) == 0).cast("int").alias("y"), F.array((F.col("id") / 7).cast("float")).alias("features"))
    points = mdlp.point_hist(df)
    one, many = mdlp.candidates(points, 2), mdlp.candidates(points, 2, part_rows=1000)
    assert one.exceptAll(many).count() == 0 and one.count() == many.count() > 20_000
    share = collections.Counter(r._part for r in scan.parts(points.select("feature", "v").distinct(), ["feature"], "v", 1000).collect())
    assert len(share) == 60 and max(share.values()) < 2000


def test_cuts_do_not_depend_on_parts(spark, monkeypatch):
    rng = np.random.default_rng(3)
    v = rng.integers(0, 900, 5000)
    y = np.where(rng.random(5000) < 0.1, rng.integers(0, 3, 5000), v // 300)
    df = spark.createDataFrame([(int(b), [float(a), float(a % 13)]) for a, b in zip(v, y, strict=True)], "y int, features array<double>").persist()
    whole = [mdlp.fit(df, max_by_part=most).cuts for most in (100_000, 0)]
    monkeypatch.setattr(scan, "PART_ROWS", 40)
    assert [mdlp.fit(df, max_by_part=most).cuts for most in (100_000, 0)] == whole and whole[0] == whole[1]


def test_best_threshold_is_the_best(spark):
    rng = random.Random(4)
    rows = [(float(rng.random() < s / 40), float(s)) for s in (rng.randrange(40) for _ in range(500))]

    def f(cut):
        tp = sum(y for y, s in rows if s >= cut)
        return 2 * tp / (sum(s >= cut for _, s in rows) + sum(y for y, _ in rows))

    want = max(sorted({s for _, s in rows}), key=lambda c: (f(c), c))
    df = spark.createDataFrame(rows, "label double, score double")
    assert evaluate.best_threshold(df) == evaluate.best_threshold(df, part_rows=3) == want
    assert evaluate.best_threshold(df.where("false")) == 0.5


BINS = [(0, [1, -3, None]), (1, [1, 70_000, 2]), (0, [None, 0, 2]), (1, []), (0, [1, -3, None]), (2, [2**40, 5, 2])]


def as_set(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("kind", ["int", "bigint"])
def test_dense_histograms_are_the_exploded_ones(spark, kind):
    rows = [(y, [v if kind == "bigint" or v is None else min(v, 9) for v in b]) for y, b in BINS]
    df = spark.createDataFrame(rows, f"y int, bins array<{kind}>").repartition(2)
    assert dense.hist2(df).schema.simpleString() == info.hist2(info.long_form(df)).schema.simpleString()
    assert as_set(dense.hist2(df)) == as_set(info.hist2(info.long_form(df)))
    padded = df.where(F.size("bins") > 0)
    for features in (None, [0, 1]):
        assert as_set(dense.hist3(padded, 2, features=features)) == as_set(info.hist3(padded, 2, features=features))
    assert dense.hist2(df.where("false")).count() == 0


def test_dense_cells_leave_before_they_are_too_many(spark, monkeypatch):
    df = spark.range(3000).select((F.col("id") % 2).cast("int").alias("y"), F.array(*[((F.col("id") * (i + 1)) % 97).cast("int") for i in range(30)]).alias("bins"))
    want = as_set(info.hist2(info.long_form(df)))
    assert as_set(dense.hist2(df)) == want
    monkeypatch.setattr(dense, "FLUSH", 10)
    assert as_set(dense.hist2(df)) == want


def test_wide_selection_is_the_narrow_one(spark, monkeypatch):
    rows = queries.binned(spark, "/root/testdata/sf0.001").persist()
    monkeypatch.setattr(dense, "WIDE", 2)
    wide = [select.select_features(rows, c, 5).ranking for c in ("jmi", "mrmr")]
    monkeypatch.setattr(dense, "WIDE", 99)
    assert np.allclose(wide, [select.select_features(rows, c, 5).ranking for c in ("jmi", "mrmr")])


def test_thresholds_of_many_features(spark):
    """2,000 features: searched by one expression, as the unrolled one does; sparse rows by their entries."""
    rng = np.random.default_rng(7)
    cuts = [None if i % 11 == 0 else [] if i % 7 == 0 else sorted(float(np.float32(c)) for c in rng.normal(0.5, 1, i % 5 + 1)) for i in range(2000)]
    cuts[5] = [math.inf]
    t = Thresholds(cuts)
    values = [[None if rng.random() < 0.05 else math.nan if rng.random() < 0.02 else float(np.round(rng.normal(), 1)) for _ in range(2000)] for _ in range(4)]

    def bin_of(v, c):
        return None if v is None or math.isnan(v) else float(np.float32(v)) if not c else float(sum(x < np.float32(v) for x in c))

    df = spark.createDataFrame([(v,) for v in values], "features array<double>")
    assert [r.bins for r in t.transform(df).collect()] == [[bin_of(v, c) for v, c in zip(row, cuts, strict=True)] for row in values]
    sparse = [{i: v for i, v in enumerate(row) if v and not math.isnan(v) and i % 9 == 0} for row in values]
    entries = spark.createDataFrame([([(i, v) for i, v in row.items()],) for row in sparse], "entries array<struct<i: int, v: double>>")
    for keep in (False, True):
        zero = [0.0 if keep or not c else float(sum(x < 0 for x in c)) for c in cuts]
        want = [[(i, b) for i in range(2000) if (b := bin_of(row[i], cuts[i]) if i in row else zero[i])] for row in sparse]
        assert [list(map(tuple, r.entries)) for r in t.transform_sparse(entries, keep_zeros=keep).collect()] == want


def test_sparse_rows_are_validated(spark):
    def of(*rows):
        return select.check_entries(spark.createDataFrame([(list(r),) for r in rows], "entries array<struct<i: int, v: double>>"))

    assert of([(0, 1.0), (7, 2.0)], []) == 8 and of([]) == 0
    for bad in ([(0, 1.5)], [(0, -1.0)], [(0, None)]):
        with pytest.raises(ValueError, match="whole"):
            of(bad)
    for bad in ([(2, 1.0), (2, 1.0)], [(-1, 1.0)]):
        with pytest.raises(ValueError, match="twice"):
            of(bad)
    with pytest.raises(ValueError, match="empty"):
        of()


def test_parts_that_are_read_twice_are_the_same(spark):
    """The quantiles of a second reading may differ, as tasks' rows arrive in another order: they are taken once."""
    df = spark.range(1000).select(F.lit(0).alias("g"), F.col("id").cast("double").alias("v"), F.lit(1).alias("n"))
    sums = scan.running(scan.parts(df, ["g"], "v", 100), ["g"], "v", {"n": "upto"})
    assert "percentile_approx" not in sums._jdf.queryExecution().toString()
    assert sums.where("upto <> v + 1").count() == 0


def test_few_thresholds_of_sparse_entries_are_compared_not_searched(spark):
    """And bins are the same, however many thresholds decide how."""
    values = [-2.0, 0.0, 1.0, 1.5, 2.0, 9.0, math.nan]
    df = spark.createDataFrame([(i, [(0, v), (1, v), (2, v)]) for i, v in enumerate(values)], "k int, entries array<struct<i: int, v: double>>")
    few, many = [1.0, 2.0], [float(t) for t in range(20)]
    short = Thresholds([few, None, []]).transform_sparse(df)
    long = Thresholds([few, None, many]).transform_sparse(df)
    assert "sequence" not in short._jdf.queryExecution().toString() and "sequence" in long._jdf.queryExecution().toString()
    for a, b in zip(short.orderBy("k").collect(), long.orderBy("k").collect(), strict=True):
        one, other = ({e.i: e.v for e in r.entries if e.i < 2} for r in (a, b))
        assert str(one) == str(other)
        v = values[a.k]
        assert one.get(0, 0.0) == sum(math.isnan(v) or t < v for t in few)
