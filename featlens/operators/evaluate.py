"""Classifiers behind one interface, and measures of (label, prediction) tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import classification as C
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featlens.functions import scan
from featlens.operators import gradient
from featlens.sources.files import stored


def accuracy(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("accuracy"))


def confusion(df: DataFrame) -> DataFrame:
    """(label, prediction, n)."""
    return df.groupBy("label", "prediction").agg(F.count("*").alias("n"))


def class_measures(df: DataFrame) -> DataFrame:
    """(class, precision, recall, f_measure); a class without predictions has precision 0."""
    cells = confusion(df)
    hit = cells.where("label = prediction").select(F.col("label").alias("class"), F.col("n").alias("tp"))
    real = cells.groupBy(F.col("label").alias("class")).agg(F.sum("n").alias("real"))
    said = cells.groupBy(F.col("prediction").alias("class")).agg(F.sum("n").alias("said"))
    t = real.join(hit, "class", "left").join(said, "class", "left").na.fill(0)
    p, r = F.when(F.col("said") > 0, F.col("tp") / F.col("said")).otherwise(0.0), F.col("tp") / F.col("real")
    return t.select("class", p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f_measure"))


def one_point_auc(df: DataFrame, positive: float = 1.0) -> DataFrame:
    """(auc): (1 + true positive rate - false positive rate) / 2."""
    said, real = (F.col("prediction") == positive).cast("double"), F.col("label") == positive
    return df.agg(((1 + F.avg(F.when(real, said)) - F.avg(F.when(~real, said))) / 2).alias("auc"))


def best_threshold(df: DataFrame, score: str = "score", positive: float = 1.0, part_rows: int | None = None) -> float:
    """The score from which on predicting positive gives the largest F-measure; of equals the largest."""
    per = df.groupBy(score).agg(F.sum((F.col("label") == positive).cast("bigint")).alias("hit"), F.count("*").alias("seen")).withColumn("_all", F.lit(0))
    per = stored(per, "scores")
    sums = scan.running(scan.parts(per, ["_all"], score, part_rows), ["_all"], score, {"hit": "hits", "seen": "all"})
    total = per.agg(F.sum("hit").alias("hit"), F.sum("seen").alias("seen")).first()
    if total.seen is None:
        return 0.5
    # from the score on: everything but what is below it
    tp, said = F.lit(total.hit) - F.col("hits") + F.col("hit"), F.lit(total.seen) - F.col("all") + F.col("seen")
    best = sums.select(F.max(F.struct((2 * tp / (said + total.hit)).alias("f"), F.col(score)))).first()[0]
    return float(best[score])


def fold_summary(df: DataFrame, value: str) -> DataFrame:
    """(mean, std) over folds; population standard deviation."""
    return df.agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


def rounded(df: DataFrame, features: str = "features", digits: int = 6) -> DataFrame:
    """Array features rounded half up."""
    return df.withColumn(features, F.transform(features, lambda v: F.round(v, digits)))


def _vectors(df: DataFrame, features: str, arity: dict[int, int] | None = None) -> DataFrame:
    """df with _x, the features as a vector; arity: the number of values of each feature that is nominal, its values being numbered from 0."""
    is_array = df.schema[features].dataType.typeName() == "array"
    column = array_to_vector(F.col(features).cast("array<double>")) if is_array else F.col(features)
    if not arity:
        return df.withColumn("_x", column)
    first = df.select(F.size(features) if is_array else F.size(vector_to_array(features))).first()
    width = first[0] if first else max(arity) + 1
    nominal = [{"idx": i, "name": f"x{i}", "vals": [str(v) for v in range(n)]} for i, n in sorted(arity.items())]
    numeric = [{"idx": i, "name": f"x{i}"} for i in range(width) if i not in arity]
    return df.withColumn("_x", column.alias("_x", metadata={"ml_attr": {"attrs": {"nominal": nominal, "numeric": numeric}, "num_attrs": width}}))


def _tuned(make: Callable) -> Callable:
    """Linear models predict class 1 from the score on that has the largest F-measure on the training rows."""

    def fit(train: DataFrame, features: str = "features", **options) -> Callable[[DataFrame], DataFrame]:
        model = make(options).setFeaturesCol("_x").setLabelCol("label").fit(_vectors(train, features))

        def scored(df: DataFrame) -> DataFrame:
            out = model.transform(_vectors(df, features))
            return out.withColumn("score", vector_to_array("rawPrediction")[1])

        cut = best_threshold(scored(train).select("label", "score"))
        return lambda df: scored(df).select("label", (F.col("score") >= cut).cast("double").alias("prediction"))

    return fit


def _plain(make: Callable) -> Callable:
    """arity: see _vectors; trees split nominal features by subsets of their values, of which maxBins must allow as many as any has."""

    def fit(train: DataFrame, features: str = "features", arity: dict[int, int] | None = None, **options) -> Callable[[DataFrame], DataFrame]:
        model = make(options).setFeaturesCol("_x").setLabelCol("label").fit(_vectors(train, features, arity))
        return lambda df: model.transform(_vectors(df, features, arity)).select("label", "prediction")

    return fit


def _descended(loss: str) -> Callable:
    """A linear model by gradient descent; from its margins on as _tuned()."""

    def fit(train: DataFrame, features: str = "features", **options) -> Callable[[DataFrame], DataFrame]:
        model = gradient.descend(train, loss, gradient.Options(**options), features)
        scored = lambda df: df.withColumn("score", model.margin(features))
        cut = best_threshold(scored(train).select("label", "score"))
        return lambda df: scored(df).select("label", (F.col("score") >= cut).cast("double").alias("prediction"))

    return fit


#: name -> fit(train rows (label, features), features, **options) -> predict(rows) -> (label, prediction).
CLASSIFIERS: dict[str, Callable] = {
    "svm": _tuned(lambda o: C.LinearSVC(**{"maxIter": 100, "regParam": 1.0} | o)),
    "lr": _tuned(lambda o: C.LogisticRegression(**{"maxIter": 100} | o)),
    "svm_sgd": _descended("hinge"),
    "lr_sgd": _descended("logistic"),
    "nb": _plain(lambda o: C.NaiveBayes(**{"smoothing": 1.0} | o)),
    "dt": _plain(lambda o: C.DecisionTreeClassifier(**{"maxDepth": 5, "maxBins": 32, "seed": 1} | o)),
    "rf": _plain(lambda o: C.RandomForestClassifier(**{"numTrees": 100, "maxDepth": 4, "maxBins": 100, "seed": 1} | o)),
}
