"""Experiments: load, discretize, select, classify and evaluate over folds; stages that are done are read back.

    python -m featlens.plans.experiment --output-dir=out --train-file=a.data --test-file=b.data --disc=mdlp --fs=yes --fs-criterion=mrmr --fs-nfeat=10 --classifier=NB
"""

from __future__ import annotations

import functools
import json
import sys
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featlens.functions import info
from featlens.operators import evaluate, evolve, mdlp, select
from featlens.operators.bins import Thresholds
from featlens.sources import declared, files

#: The command line's parameters and their defaults.
DEFAULTS = {
    "file-format": "declared", "data-format": "dense", "npart": "0", "disc": "none", "disc-nbins": "15", "disc-nchrom": "50", "disc-geval": "5000", "disc-mvfactor": "1", "disc-alpha": "0.7", "disc-srate": "0.1", "disc-vth": "100",
    "fs": "no", "fs-criterion": "mrmr", "fs-nfeat": "100", "fs-beta": "0", "classifier": "svm", "folds": "1",
}


#: The parameters of each classifier on the command line, and what they are called here.
CLASSIFIER_OPTIONS = {
    "svm": {"cls-numIter": ("maxIter", int), "cls-regParam": ("regParam", float)},
    "lr": {"cls-numIter": ("maxIter", int)},
    "sgd": {"cls-numIter": ("iterations", int), "cls-stepSize": ("step", float), "cls-regParam": ("reg", float), "cls-miniBatchFraction": ("fraction", float)},
    "nb": {"cls-lambda": ("smoothing", float)},
    "dt": {"cls-impurity": ("impurity", str), "cls-maxDepth": ("maxDepth", int), "cls-maxBins": ("maxBins", int)},
    "rf": {"cls-impurity": ("impurity", str), "cls-maxDepth": ("maxDepth", int), "cls-maxBins": ("maxBins", int), "cls-numTrees": ("numTrees", int), "cls-featureSubsetStrategy": ("featureSubsetStrategy", str)},
}


@dataclass
class Stages:
    """discretize: rows (row_id, y, features) -> Thresholds; choose: rows (y, bins) -> Selection; classify: a fit function of evaluate.CLASSIFIERS."""

    discretize: Callable[[DataFrame], Thresholds] | None = None
    choose: Callable[[DataFrame], select.Selection] | None = None
    classify: Callable | None = None


class Manifest:
    """What is done, in one Parquet table (fold, stage, seconds) for each stage of each fold."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _path(self, fold: int, stage: str) -> str:
        return f"{self.folder}/done/{stage}_{fold}"

    def seconds(self, fold: int, stage: str) -> float | None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self._path(fold, stage) + "/_SUCCESS")
        if not path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return None
        return self.spark.read.parquet(self._path(fold, stage)).first().seconds

    def record(self, fold: int, stage: str, seconds: float) -> None:
        self.spark.createDataFrame([(fold, stage, seconds)], "fold int, stage string, seconds double").coalesce(1).write.mode("overwrite").parquet(self._path(fold, stage))


def _timed(manifest: Manifest, fold: int, stage: str, make: Callable, load: Callable):
    """make()'s result, stored and timed; or load()'s if the stage is done."""
    done = manifest.seconds(fold, stage)
    if done is not None:
        return load(), done
    began = time.time()
    out = make()
    seconds = time.time() - began
    manifest.record(fold, stage, seconds)
    return out, seconds


def _with_codes(df: DataFrame, codes: DataFrame) -> DataFrame:
    return df.join(F.broadcast(codes), "label").withColumn("row_id", F.xxhash64("label", F.to_json(F.struct("features"))))


def run(spark: SparkSession, folds: list[tuple[DataFrame, DataFrame]], stages: Stages, folder: str) -> dict:
    """Report of an experiment over (train, test) tables (label, features); everything it learns is stored in folder."""
    manifest, report, tables = Manifest(spark, folder), {"folds": []}, {"train": None, "test": None}
    for number, (train, test) in enumerate(folds, 1):
        began = time.time()
        codes = info.label_codes(train)
        width = train.select(F.size("features").alias("n")).first().n
        seconds = {}
        if stages.discretize:
            path = f"{folder}/thresholds_{number}"

            def learn(train=train, codes=codes, path=path):
                found = stages.discretize(_with_codes(train, codes))
                files.write_thresholds(spark, found, path)
                return found

            cuts, seconds["discretize"] = _timed(manifest, number, "discretize", learn, lambda path=path, width=width: files.read_thresholds(spark, path, width))
            train, test = (cuts.transform(d, "features", "features") for d in (train, test))
        if stages.choose:
            path = f"{folder}/selection_{number}"

            def pick(train=train, codes=codes, path=path):
                rows = train.join(F.broadcast(codes), "label").select("y", F.transform("features", lambda v: v.cast("int")).alias("bins")).persist()
                found = stages.choose(rows)
                rows.unpersist()
                files.write_selection(spark, found, path)
                return found

            chosen, seconds["select"] = _timed(manifest, number, "select", pick, lambda path=path: files.read_selection(spark, path))
            train, test = (chosen.transform(d, "features") for d in (train, test))
        entry = {"fold": number}
        if stages.classify:
            path = f"{folder}/predictions_{number}"

            def predict(train=train, test=test, path=path, number=number):
                model = stages.classify(train)
                both = model(train).withColumn("side", F.lit("train")).unionByName(model(test).withColumn("side", F.lit("test")))
                files.write_table(both.withColumn("fold", F.lit(number)), path)

            _, seconds["classify"] = _timed(manifest, number, "classify", predict, lambda: None)
            said = spark.read.parquet(path)
            entry |= {f"accuracy_{r.side}": r.accuracy for r in evaluate.accuracy(said, "side").collect()}
            for side in tables:
                part = said.where(F.col("side") == side).select("label", "prediction")
                tables[side] = part if tables[side] is None else tables[side].unionByName(part)
        seconds["full"] = time.time() - began
        report["folds"].append(entry | {"seconds": seconds})
    report["mean_seconds"] = {k: sum(f["seconds"].get(k, 0) for f in report["folds"]) / len(folds) for k in ("discretize", "select", "classify", "full")}
    for side, said in tables.items():
        if said is None:
            continue
        values = spark.createDataFrame([(f[f"accuracy_{side}"],) for f in report["folds"]], "accuracy double")
        report[side] = evaluate.fold_summary(values, "accuracy").first().asDict() | {
            "confusion": [r.asDict() for r in evaluate.confusion(said).orderBy("label", "prediction").collect()],
            "classes": [r.asDict() for r in evaluate.class_measures(said).orderBy("class").collect()],
            "auc": evaluate.one_point_auc(said).first().auc,
        }
    for name, text in (("report", json.dumps(report, indent=1, default=str)), ("summary", rendered(report))):
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/{name}")
    return report


def rendered(report: dict) -> str:
    """A report for reading: mean times, accuracy by fold with mean and deviation, confusion with a row for each label, measures by class, and the area under the curve, training rows beside test rows."""
    lines = [f"{name}\t{seconds:.3f} s" for name, seconds in report["mean_seconds"].items()]
    sides = [s for s in ("train", "test") if s in report]
    if sides:
        table = [("accuracy", *sides)]
        table += [(f"fold {f['fold']}", *[f"{f[f'accuracy_{s}']:.6f}" for s in sides]) for f in report["folds"]]
        table += [(name, *[f"{report[s][name]:.6f}" for s in sides]) for name in ("mean", "std")]
        table += [("auc", *["-" if report[s]["auc"] is None else f"{report[s]['auc']:.6f}" for s in sides])]
        lines += ["", *["\t".join(row) for row in table]]
    for side in sides:
        cells = {(c["label"], c["prediction"]): c["n"] for c in report[side]["confusion"]}
        classes = sorted({k for pair in cells for k in pair})
        lines += ["", f"{side}: predicted", "\t".join(["label", *map(str, classes)])]
        lines += ["\t".join([str(a), *[str(cells.get((a, b), 0)) for b in classes]]) for a in classes]
        lines += ["\t".join(["class", "precision", "recall", "f_measure"])]
        lines += ["\t".join([str(c["class"]), *[f"{c[m]:.6f}" for m in ("precision", "recall", "f_measure")]]) for c in report[side]["classes"]]
    return "\n".join(lines)


def parse(args: list[str]) -> dict[str, str]:
    """--name=value arguments; values may hold = and --."""
    out = dict(DEFAULTS)
    for a in args:
        if not a.startswith("--") or "=" not in a:
            raise ValueError(f"--name=value expected: {a}")
        name, value = a[2:].split("=", 1)
        out[name] = value
    for name in ("output-dir",):
        if name not in out:
            raise ValueError(f"--{name} is required")
    return out


def classifier_of(p: dict[str, str], arity: dict[int, int] | None = None) -> Callable | None:
    """The classifier with its options. A step size or batch fraction asks linear models for gradient descent. arity: of nominal features, which trees split by subsets."""
    name = p["classifier"].lower()
    if name == "no":
        return None
    name = name if name in evaluate.CLASSIFIERS else "svm"
    if name in ("svm", "lr") and ("cls-stepSize" in p or "cls-miniBatchFraction" in p):
        name += "_sgd"
    known = CLASSIFIER_OPTIONS["sgd" if name.endswith("_sgd") else name]
    options = {to: kind(p[given]) for given, (to, kind) in known.items() if given in p}
    if name == "lr_sgd":
        options = {"reg": 0.0} | options
    if arity and name in ("dt", "rf"):
        options["arity"] = arity
    return functools.partial(evaluate.CLASSIFIERS[name], **options)


def stages_of(p: dict[str, str], arity: dict[int, int] | None = None) -> Stages:
    cut = choose = None
    if p["disc"] == "mdlp":
        cut = lambda d: mdlp.fit(d, max_bins=int(p["disc-nbins"]))
    elif p["disc"] == "ecpsd":
        o = evolve.Options(population=int(p["disc-nchrom"]), evaluations=int(p["disc-geval"]), alpha=float(p["disc-alpha"]), factor=int(p["disc-mvfactor"]), rate=float(p["disc-srate"]), votes=int(p["disc-vth"]))
        cut = lambda d: evolve.fit(d, partitions=max(int(p["npart"]), 1), options=o)
    if p["fs"] == "yes":
        choose = lambda d: select.select_features(d, p["fs-criterion"], min(int(p["fs-nfeat"]), select.check_bins(d)), float(p["fs-beta"]))
    # bins and selected features are other features than the header's
    return Stages(cut, choose, classifier_of(p, arity if not cut and not choose else None))


def arity_of(header: declared.Header) -> dict[int, int]:
    """The number of values of each input that declares them."""
    return {i: len(a.values) for i, a in enumerate(header.of(declared.INPUT)) if a.values}


def load(spark: SparkSession, p: dict[str, str], path: str) -> DataFrame:
    if p["file-format"].lower() == "libsvm":
        df = files.read_libsvm(spark, path, dense=True)
    else:
        rows, header = declared.read(spark, path, declared.read_header(spark, p["header-file"]) if "header-file" in p else None)
        df = declared.labelled(rows, declared.learned(rows, header)).where(F.col("label").isNotNull() & ~F.exists("features", lambda v: v.isNull()))
    return df.repartition(int(p["npart"])) if int(p["npart"]) else df


def main(args: list[str]) -> dict:
    p = parse(args)
    spark = SparkSession.builder.getOrCreate()
    paths = files.fold_paths(p["data-dir"], p.get("leaf", "fold"), int(p["folds"])) if "data-dir" in p else [(p["train-file"], p["test-file"])]
    return run(spark, [(load(spark, p, a), load(spark, p, b)) for a, b in paths], stages_of(p, arity_of(declared.read_header(spark, p["header-file"])) if "header-file" in p else None), p["output-dir"])


if __name__ == "__main__":
    print(json.dumps(main(sys.argv[1:]), default=str))
