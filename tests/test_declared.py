"""Dictionaries, faults with lines and rows, rows from arrays, and descent with its options."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from featlens.operators import evaluate, gradient
from featlens.plans import experiment
from featlens.sources import declared, dictionary, faults

HEAD = ["@relation r", "@attribute a real [0, 10]", "@attribute b integer", "@attribute c {x, y}", "@attribute d {u, v}", "@inputs a, b, c", "@outputs d", "@data"]


def test_dictionary_is_dense_and_grows(spark, monkeypatch):
    rng = random.Random(1)
    words = [None, "", "é", "Z", *[f"w{rng.randrange(4000)}" for _ in range(5000)]]
    train = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, w string").repartition(6)
    test = spark.createDataFrame([(0, "w1"), (1, "new"), (2, "also new"), (3, None)], "i int, w string")
    known = dictionary.dictionary(train, "w")
    order = sorted({w for w in words if w is not None}, key=lambda w: w.encode())
    assert {r.value: r.code for r in known.collect()} == {w: k for k, w in enumerate(order)}
    more = dictionary.extended(known, test, "w")
    codes = {r.value: r.code for r in more.collect()}
    new = sorted({"w1", "new", "also new"} - set(order))
    assert codes == {w: k for k, w in enumerate([*order, *new])} and len(new) >= 2
    for most in (dictionary.BROADCAST_VALUES, 0):
        monkeypatch.setattr(dictionary, "BROADCAST_VALUES", most)
        coded = dictionary.coded(train, {"w": more})
        assert sorted(map(str, dictionary.decoded(coded, {"w": more}).collect())) == sorted(map(str, train.collect()))
    assert [r.w for r in dictionary.coded(test, {"w": known}).orderBy("i").collect()][1:] == [None, None, None]  # not extended
    assert dictionary.dictionary(train.where("false"), "w").count() == 0


def test_open_attributes_stay_open(spark, monkeypatch):
    monkeypatch.setattr(declared, "MAX_VALUES", 3)
    header = declared.parse_header(["@attribute a", "@attribute b", "@data"])
    df = spark.createDataFrame([(f"v{i}", f"w{i % 3}") for i in range(9)], "a string, b string")
    assert [a.values for a in declared.learned(df, header).attributes] == [(), ("w0", "w1", "w2")]


def test_lines_of_split_files_are_numbered(spark, tmp_path):
    rng = random.Random(3)
    want = {}
    for name in ("one", "two", "three"):
        lines = [f"{name} {i} " + "x" * rng.randrange(60) for i in range(rng.randrange(300, 900))]
        (tmp_path / name).write_text("\n".join(lines) + ("\n" if name == "two" else ""))
        want |= {v: (name, i + 1) for i, v in enumerate(lines)}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        got = faults.numbered_lines(spark, str(tmp_path)).collect()
        through = faults.numbered_lines(spark, str(tmp_path), through=True).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert {r.value: (r.file.rsplit("/", 1)[1], r.line) for r in got} == want and len(got) == len(want)
    assert sorted(r.line for r in through) == list(range(1, len(want) + 1))


def test_faults_have_their_place(spark, tmp_path):
    path = tmp_path / "t.data"
    path.write_text("\n".join([*HEAD, "1,1,x,u", "% comment", "", "11,1.5,z,u", "a,1,x", "1,q,x,?", " 2 , 3 , y , w ", "-1,2,x,v"]))
    header = declared.parse_header(HEAD)
    rows = faults.numbered_rows(faults.numbered_lines(spark, str(path)), part_rows=2)
    got = sorted((r.line, r.row, r.place, r.kind, r.attribute, r.direction, r.value) for r in faults.row_faults(rows, header).where("place IS NOT NULL").collect())
    assert got == [
        (12, 2, 0, "above maximum", "a", "input", "11"),
        (12, 2, 1, "integer expected", "b", "input", "1.5"),
        (12, 2, 2, "unknown nominal value", "c", "input", "z"),
        (14, 4, 1, "number expected", "b", "input", "q"),
        (14, 4, 3, "missing output", "d", "output", None),
        (15, 5, 3, "unknown nominal value", "d", "output", "w"),
        (16, 6, 0, "below minimum", "a", "input", "-1"),
    ]
    whole = faults.row_faults(rows, header).where("place IS NULL").collect()
    assert [(r.line, r.row, r.kind, r.value) for r in whole] == [(13, 3, "wrong number of values", "3")]
    kinds = sorted(r.kind for r in faults.row_faults(rows, header, test=True).collect())
    assert kinds == sorted(["number outside bounds in test"] * 2 + ["integer expected", "unknown nominal value in test", "wrong number of values", "number expected", "missing output", "unknown nominal output value in test"])


def test_header_faults():
    assert faults.header_faults(HEAD, HEAD) == []
    twice = ["@attribute a real", "@attribute a integer", "@inputs a, q", "@outputs p", "@data"]
    assert faults.header_faults(twice) == [("attribute defined twice", "a"), ("input of train not defined", "q"), ("output of train not defined", "p")]
    test = ["@attribute a real [0, 10]", "@attribute e integer", "@attribute d {u, v}", "@inputs a, e, g", "@outputs e, h", "@data"]
    got = faults.header_faults(HEAD, test)
    assert got == [("input of test not defined", "g"), ("output of test not defined", "h"), ("attribute not defined in train", "e"), *[("inputs of test differ", n) for n in "bceg"], *[("outputs of test differ", n) for n in "deh"]]


def test_rows_come_back_from_arrays(spark):
    header = declared.parse_header(HEAD)
    df = spark.createDataFrame([(1, 0.5, 3, "x", "v"), (2, None, None, None, "u")], "id int, a double, b bigint, c string, d string")
    coded = declared.coded(df, header).select(F.array("a", "b", "c", "d").alias("features"))
    assert [tuple(r) for r in faults.from_arrays(coded, header).collect()] == [(0.5, 3, "x", "v"), (None, None, None, "u")]
    odd = spark.createDataFrame([(7, [float("nan"), 2.4, 9.0, -1.0]), (8, [1.0])], "id int, features array<double>")
    assert [tuple(r) for r in faults.from_arrays(odd, header).collect()] == [(7, None, 2, None, None), (8, 1.0, None, None, None)]


@pytest.fixture(scope="module")
def separable(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(1500, 3))
    y = (x @ [1.0, -2.0, 0.5] + rng.normal(size=1500) * 0.3 > 0).astype(float)
    return spark.createDataFrame([(float(b), a.tolist(), k % 5 == 0) for k, (a, b) in enumerate(zip(x, y, strict=True))], "label double, features array<double>, held boolean").persist()


@pytest.mark.parametrize("loss", ["hinge", "logistic"])
def test_descent_lowers_the_loss(separable, loss):
    o = gradient.Options(iterations=15, step=1.0, reg=0.01)
    model = gradient.descend(separable, loss, o)
    assert model.losses[-1] < 0.55 * model.losses[0] and model.losses[0] == pytest.approx(1.0 if loss == "hinge" else np.log(2))
    # the same steps by numpy over all rows
    rows = separable.collect()
    x, y, w = np.array([r.features for r in rows]), np.array([r.label for r in rows]), np.zeros(3)
    for t in range(1, len(model.losses) + 1):
        rate = o.step / np.sqrt(t)
        w = w * (1 - rate * o.reg) - rate * (gradient.LOSSES[loss](x @ w, y)[1] @ x) / len(x)
    assert np.allclose(w, model.weights, atol=1e-9)
    some = gradient.descend(separable, loss, gradient.Options(iterations=15, reg=0.01, fraction=0.3, intercept=True))
    assert some.losses[-1] < 0.6 * some.losses[0] and abs(some.intercept) < 0.5
    assert np.array_equal(some.weights, gradient.descend(separable, loss, gradient.Options(iterations=15, reg=0.01, fraction=0.3, intercept=True)).weights)


def test_descent_classifies_held_out_rows(separable):
    predict = evaluate.CLASSIFIERS["svm_sgd"](separable.where("NOT held"), iterations=20, reg=0.01)
    exact = evaluate.CLASSIFIERS["svm"](separable.where("NOT held"), regParam=0.01)
    a, b = (evaluate.accuracy(p(separable.where("held"))).first().accuracy for p in (predict, exact))
    assert a > 0.9 and abs(a - b) < 0.05
    with pytest.raises(ValueError, match="empty"):
        gradient.descend(separable.where("false"))


def test_options_of_the_command_line():
    def of(*args):
        return experiment.classifier_of(experiment.parse(["--output-dir=o", *args]), {0: 3})

    sgd = of("--classifier=svm", "--cls-numIter=7", "--cls-stepSize=0.5", "--cls-miniBatchFraction=0.2")
    assert sgd.func is evaluate.CLASSIFIERS["svm_sgd"] and sgd.keywords == {"iterations": 7, "step": 0.5, "fraction": 0.2}
    assert of("--classifier=DT", "--cls-impurity=entropy", "--cls-maxDepth=3").keywords == {"impurity": "entropy", "maxDepth": 3, "arity": {0: 3}}
    assert of("--classifier=NB", "--cls-lambda=2").keywords == {"smoothing": 2.0} and of("--classifier=no") is None
    assert of("--classifier=other", "--cls-regParam=0.1").keywords == {"regParam": 0.1}
    assert experiment.arity_of(declared.parse_header(HEAD)) == {2: 2}


def test_equal_rows_are_one_row_of_a_step(spark, monkeypatch):
    """However often the rows are repeated, a step reads the different ones, and weighs them by their number."""
    once = [(float(i % 2), [float(i), 1.0]) for i in range(6)]
    table = once * 20 + once[:2] * 30
    df = spark.createDataFrame(table, "label double, features array<double>").repartition(3)
    read, real = [], gradient._batch
    monkeypatch.setattr(gradient, "_batch", lambda rows, t, o: read.append(rows.count()) or real(rows, t, o))
    model = gradient.descend(df, "logistic", gradient.Options(iterations=3, reg=0.01))
    assert read == [6, 6, 6]
    w, x, y = np.zeros(2), np.array([r[1] for r in table]), np.array([r[0] for r in table])
    for t in range(1, 4):
        rate = 1 / np.sqrt(t)
        w = w * (1 - rate * 0.01) - rate * (gradient.LOSSES["logistic"](x @ w, y)[1] @ x) / len(x)
    assert np.allclose(model.weights, w)
