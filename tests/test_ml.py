"""Stages of pipelines, their persistence, and nominal features."""

import random

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import NaiveBayes
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from featlens import ml
from featlens.operators import evaluate, mdlp, select
from featlens.operators.bins import ONE_BIN, Thresholds


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(9)
    made = []
    for _ in range(400):
        a, b = rng.random() * 10, rng.random()
        made.append((None if rng.random() < 0.02 else "high" if a > 6 else "low", [a, b, float(int(a))]))
    return spark.createDataFrame(made, "label string, features array<double>").persist()


@pytest.mark.parametrize("vectors", [False, True])
def test_pipeline_is_saved_and_loaded(spark, rows, vectors, tmp_path):
    df = rows.withColumn("y", F.when(F.col("label").isNotNull(), (F.col("label") == "low").cast("double")))
    if vectors:
        df = df.withColumn("features", array_to_vector("features"))
    stages = [ml.Discretizer(labelCol="label", maxBins=3), ml.FeatureSelector(labelCol="label", criterion="jmi", numTopFeatures=2)]
    if vectors:
        stages.append(NaiveBayes(featuresCol="selected", labelCol="y"))
    fitted = Pipeline(stages=stages).fit(df.where("label IS NOT NULL") if vectors else df)
    fitted.write().save(str(tmp_path / "m"))
    back = PipelineModel.load(str(tmp_path / "m"))
    assert back.stages[0].thresholds == fitted.stages[0].thresholds and back.stages[1].selection.ranking == fitted.stages[1].selection.ranking
    assert back.stages[0].uid == fitted.stages[0].uid and back.stages[0].getOrDefault("maxBins") == 3 and back.stages[1].getOrDefault("criterion") == "jmi"
    one, two = (sorted(map(str, m.transform(df).collect())) for m in (fitted, back))
    assert one == two and len(one) == 400
    out = back.transform(df)
    assert out.schema["selected"].dataType == out.schema["features"].dataType
    assert len(back.stages[1].selection.features) == 2


def test_fit_is_the_functions(spark, rows):
    coded = rows.where("label IS NOT NULL").select((F.col("label") == "low").cast("int").alias("y"), "features")
    assert ml.Discretizer().fit(rows).thresholds.cuts == mdlp.fit(coded).cuts
    some = ml.Discretizer(continuous=[0], maxBins=0, maxLevels=1).fit(rows)
    assert some.thresholds.cuts[1:] == [None, None] and len(some.thresholds.cuts[0]) == 1
    assert [r.bins[1] for r in some.transform(rows).limit(3).collect()] == pytest.approx([r.features[1] for r in rows.limit(3).collect()])


def test_estimators_are_saved_too(tmp_path):
    made = ml.FeatureSelector(criterion="mifs", beta=0.5, numTopFeatures=7).setOutputCol("kept")
    made.write().save(str(tmp_path / "e"))
    back = ml.FeatureSelector.load(str(tmp_path / "e"))
    assert (back.getOrDefault("beta"), back.getOutputCol(), back.getOrDefault("numTopFeatures")) == (0.5, "kept", 7)


def test_faults(spark, rows):
    with pytest.raises(ValueError, match="no rows"):
        ml.Discretizer().fit(rows.where("false"))
    with pytest.raises(ValueError, match="empty"):
        ml.FeatureSelector(featuresCol="features").fit(rows.where("label = 'none'"))
    with pytest.raises(ValueError, match="whole"):
        ml.FeatureSelector(featuresCol="features").fit(rows)
    one = spark.createDataFrame([("a", [5.0]), ("a", [6.0])], "label string, features array<double>")
    assert ml.Discretizer().fit(one).thresholds.cuts[0] in ([6.0], ONE_BIN)


@pytest.mark.parametrize("name", ["dt", "rf"])
def test_nominal_features_are_split_by_subsets(spark, name):
    """The label is in which categories a row is, of 16 in no order: one split of a tree tells it by subsets, none by order."""
    good = {0, 3, 4, 7, 9, 10, 13, 15}
    rng = random.Random(2)
    made = [(float(c in good), [float(c), rng.random()], k % 4 == 0) for k, c in enumerate(rng.randrange(16) for _ in range(1600))]
    df = spark.createDataFrame(made, "label double, features array<double>, held boolean")
    options = {"maxDepth": 1} | ({"numTrees": 5, "featureSubsetStrategy": "all"} if name == "rf" else {})

    def accuracy(**more):
        predict = evaluate.CLASSIFIERS[name](df.where("NOT held"), **options, **more)
        return evaluate.accuracy(predict(df.where("held"))).first().accuracy

    assert accuracy() < 0.75 and accuracy(arity={0: 16}) == 1.0


def test_a_fit_looks_for_labels_once(spark, monkeypatch):
    """What a fit reads is not made again for every reading: labels' codes are a table, and so are the selector's bins."""
    rows = spark.createDataFrame([(i % 3, [float(i % 3), float(i % 7)]) for i in range(200)], "label int, features array<double>")
    seen = []
    labelled, check = ml._Columns._labelled, select.check_bins
    monkeypatch.setattr(ml._Columns, "_labelled", lambda self, *a: seen.append(labelled(self, *a)) or seen[-1])
    monkeypatch.setattr(select, "check_bins", lambda df, *a: seen.append(df) or check(df, *a))
    ml.FeatureSelector(featuresCol="features", numTopFeatures=1, criterion="mim").fit(rows)
    codes, bins = (df._jdf.queryExecution().optimizedPlan().toString() for df in seen)
    assert "Window" not in codes and "Join" not in bins


def test_few_thresholds_are_compared_in_generated_code(spark):
    rows = spark.createDataFrame([(i, [v]) for i, v in enumerate([None, float("nan"), -1.0, 1.0, 1.5, 2.0, 9.0])], "id int, features array<double>")
    out = Thresholds([[1.0, 2.0]]).transform(rows)
    assert [r.bins[0] for r in out.orderBy("id").collect()] == [None, None, 0.0, 0.0, 1.0, 1.0, 2.0]
    assert "filter(" not in out._jdf.queryExecution().optimizedPlan().toString()
