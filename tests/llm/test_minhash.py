import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from featlens.llm import minhash, queries
from featlens.llm.storage import join_many, join_split

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(doc):
    w = WORD.findall((doc or "").translate(LOWER))
    return {" ".join(w[i : i + 4]) for i in range(max(len(w) - 3, 1))} if w else set()


def brute(rows):
    """(doc_id, n_shingles, component_id) by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                root[find(i)] = find(j)
    names = collections.defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            names[find(i)].append(d)
    return sorted(((d, len(s), min(names[find(i)], default=None)) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, 3) for i, t in rows], "doc_id long, text string, row int, key int, seen int")


def found(spark, rows):
    return sorted(map(tuple, minhash.near_duplicates(frame(spark, rows)).collect()), key=str)


HARD = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "one two three"), (8, "one two three four"), (9, "one two three four five"), (8, "one two three four"), (None, "one two three"), (None, "only without an id here"), (10, "a\x00b c d e"), (11, "a b c d e"), (12, "É é e f"), (13, "é É e f"), (14, "x " * 5000), (15, "X\t" * 9000), (16, "one\x85two three four"), (8, "another text of the same id"), (None, None)]


def test_hard_rows(spark):
    assert found(spark, HARD) == brute(HARD)
    assert found(spark, []) == []


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = queries.op13_minhash(spark, SF)
    assert got.dtypes == [("doc_id", "bigint"), ("n_shingles", "bigint"), ("component_id", "bigint"), ("kept", "boolean")]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(((*r, r[0] == r[2]) for r in brute(rows)), key=str)


def edited(rng, words, share):
    return [rng.choice(WORDS) if rng.random() < share else w for w in words]


WORDS = [f"w{i}" for i in range(3000)]


@pytest.mark.parametrize(("share", "block"), [(0.02, 1024), (0.05, 7)])
def test_groups_of_near_copies_around_the_threshold(spark, share, block, monkeypatch):
    """Many near copies of one text, so that keys hold several components, also in small squares."""
    rng = random.Random(share)
    base = [rng.choice(WORDS) for _ in range(160)]
    rows = [(i, " ".join(edited(rng, base, share))) for i in range(120)]
    rows += [(200 + i, " ".join(rng.choice(WORDS) for _ in range(80))) for i in range(60)]
    rows += [(300 + i, rows[i][1].upper()) for i in range(20)]
    want = brute(rows)
    monkeypatch.setattr(minhash, "BLOCK", block)
    assert found(spark, rows) == want


def test_chain_whose_links_are_at_the_threshold(spark):
    """Each text shares exactly 80 of 100 shingles of the union with the next; the ends share none."""
    words = [f"c{i}" for i in range(200)]
    rows = [(k, " ".join(words[10 * k : 10 * k + 93])) for k in range(10)]
    a, b = shingles(rows[0][1]), shingles(rows[1][1])
    assert 100 * len(a & b) == 80 * len(a | b)
    assert {r[2] for r in found(spark, rows)} == {0}
    apart = [(k, " ".join(words[11 * k : 11 * k + 93])) for k in range(9)]
    assert {r[2] for r in found(spark, apart)} == set(range(9))


SKETCHES = {"coarse": minhash.COARSE, "fine": minhash.FINE}


def lanes(sketch, minima):
    return (minima >> np.uint64(32)) & np.uint64((1 << sketch.bits) - 1)


@pytest.mark.parametrize("name", SKETCHES)
def test_estimate_is_unbiased_and_as_wide_as_stated(name):
    sketch, rng = SKETCHES[name], np.random.default_rng(5)
    stated = (0.8 - sketch.least_estimate()) / minhash.SLACK
    for j in (0.2, 0.5, 0.8, 1.0):
        errors = []
        for _ in range(100):
            u = rng.integers(0, 1 << 63, 400, dtype=np.uint64) * np.uint64(2)
            same = round(800 * j / (1 + j))
            v = np.concatenate([u[:same], rng.integers(0, 1 << 63, 400 - same, dtype=np.uint64)])
            x, y = (lanes(sketch, sketch.minima(s)) for s in (u, v))
            c = 2.0**-sketch.bits
            errors.append((float(np.mean(x == y)) - c) / (1 - c) - same / (800 - same))
        assert abs(np.mean(errors)) < 0.4 * stated
        assert j != 0.8 or 0.7 * stated < np.std(errors) < 1.3 * stated
        assert j != 1.0 or not np.any(errors)


@pytest.mark.parametrize("name", SKETCHES)
def test_estimate_column_counts_lanes(spark, name):
    sketch = SKETCHES[name]
    s = np.random.default_rng(6).integers(0, 1 << 63, 300, dtype=np.uint64)
    both = [sketch.minima(s), sketch.minima(np.concatenate([s[:250], s[:50] + np.uint64(1)]))]
    c = 2.0**-sketch.bits
    want = (float(np.mean(lanes(sketch, both[0]) == lanes(sketch, both[1]))) - c) / (1 - c)
    df = spark.createDataFrame([tuple(sketch.packed(m).view(np.int64).tolist() for m in both)], "a array<bigint>, b array<bigint>")
    assert abs(df.select(sketch.estimate("a", "b").alias("e")).first().e - want) < 1e-12


def test_long_sets_are_minimised_in_steps(monkeypatch):
    s = np.random.default_rng(7).integers(0, 1 << 63, 9000, dtype=np.uint64)
    whole = minhash.COARSE.minima(s)
    monkeypatch.setattr(minhash, "STEP", 1000)
    assert (minhash.COARSE.minima(s) == whole).all()


def test_split_join_is_a_join(spark):
    many = spark.range(9000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"))
    few = many.groupBy("k").agg(F.count("*").alias("seen"), F.min("id").alias("v"))
    got = join_split(many, few, ["k"], "seen", 9000, "id")
    assert sorted(map(tuple, got.select("id", "k", "v").collect())) == sorted(map(tuple, many.join(few, "k").select("id", "k", "v").collect()))
    assert got.count() == 9000


def test_join_many_needs_no_anti_join(spark):
    """Hot keys are told by a hash; where there are none, one join is all."""
    many = spark.range(9000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), (F.col("id") % 2).alias("j"))
    few = many.groupBy("k", "j").agg(F.count("*").alias("seen"), F.min("id").alias("v")).where("k % 5 <> 1")
    want = sorted(map(tuple, many.join(few, ["k", "j"]).select("id", "k", "j", "v").collect()))
    for total, joins in ((9000, 2), (1 << 40, 1)):
        got = join_many(many, few, ["k", "j"], "seen", total)
        assert sorted(map(tuple, got.select("id", "k", "j", "v").collect())) == want
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "LeftAnti" not in plan and plan.count("Join Inner") == joins
