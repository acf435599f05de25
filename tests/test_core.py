import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from featlens.functions import info
from featlens.functions.criteria import CRITERIA, criterion
from featlens.operators import evaluate, evolve, generate, mdlp, select
from featlens.operators.bins import ONE_BIN, Thresholds
from featlens.plans import experiment, queries
from featlens.sources import declared, files

SF = "/root/testdata/sf0.01"
#: Orders and scores of the planted fixture.
GOLD = {
    "mim": [(0, 1.1133), (1, 1.0065), (2, 0.2783), (4, 0.0003), (3, 0.0002)],
    "mifs": [(0, 1.1133), (2, 0.2750), (3, -0.0044), (4, -0.0078), (1, -2.3893)],
    "jmi": [(0, 1.1133), (2, 0.4707), (1, 0.5899), (4, 0.0028), (3, 0.0021)],
    "mrmr": [(0, 1.1133), (2, 0.2750), (3, -0.0021), (4, -0.0024), (1, 0.1575)],
    "cmim": [(0, 1.1133), (2, 0.2783), (4, 0.0003), (3, 0.0002), (1, 0.0)],
    "if": [(0, 1.1133), (2, 0.2783), (4, 0.0003), (3, 0.0002), (1, 0.0)],
    "icap": [(0, 1.1133), (2, 0.2783), (4, 0.0003), (3, 0.0002), (1, 0.0)],
}


@pytest.fixture(scope="module")
def rows(spark):
    return queries.binned(spark, SF).persist()


@pytest.mark.parametrize("name", GOLD)
def test_greedy_orders(rows, name):
    found = select.select_features(rows, name, 5, beta=1.0).ranking
    assert [f for f, _ in found] == [f for f, _ in GOLD[name]]
    assert np.allclose([s for _, s in found], [s for _, s in GOLD[name]], atol=1e-4)


def test_sparse_is_dense(rows):
    sparse = files.sparse_entries(rows, "bins")
    for name in ("jmi", "cmim"):
        assert np.allclose(select.select_features(sparse, name, 5, sparse=True).ranking, select.select_features(rows, name, 5).ranking)


def test_information_properties(spark, rows):
    same = rows.select("y", F.array("y", F.lit(1)).alias("bins"))
    mi = {r.feature: r.mi for r in info.relevance(same).collect()}
    h = info.entropy(info.hist2(info.long_form(same)), ["feature"], "x").where("feature = 0").first().h
    assert math.isclose(mi[0], h) and abs(mi[1]) < 1e-12
    assert all(r.mi >= -1e-12 and r.cmi >= -1e-12 for r in info.redundancy(rows, 2).collect())


def test_selection_faults(spark, rows):
    with pytest.raises(ValueError, match="criterion unknown"):
        criterion("nothing")
    with pytest.raises(ValueError, match="between"):
        select.select_features(rows, "mim", 6)
    with pytest.raises(ValueError, match="whole"):
        select.check_bins(spark.createDataFrame([(0, [0.5])], "y int, bins array<double>"))
    assert set(CRITERIA) == {"mim", "mifs", "jmi", "mrmr", "cmim", "if", "icap"}


def test_chi_square_ranks_by_statistic(spark):
    from pyspark.ml.functions import array_to_vector

    rng = np.random.default_rng(5)
    y = rng.integers(0, 2, 400)
    a = np.where(rng.random(400) < 0.56, y, 1 - y)
    b = rng.integers(0, 60, 400)
    df = spark.createDataFrame([(float(t), [float(u), float(v)]) for t, u, v in zip(y, a, b, strict=True)], "label double, f array<double>").select("label", array_to_vector("f").alias("features"))
    out = select.chi_square(df).collect()
    assert out[0].statistic >= out[1].statistic and out[0].feature == 1 and out[0].p_value > out[1].p_value
    assert select.chi_square_select(df, 1).features == [1]


@pytest.mark.parametrize(("values", "labels", "cuts"), [([5], [0], [5.0]), ([1, 2], [0, 0], [2.0]), ([1, 2, 3], [0, 0, 0], []), ([1, 2], [0, 1], [1.5, 2.0]), ([1, 1, 1, 1], [0, 1, 0, 1], []), (list(range(8)), [0] * 4 + [1] * 4, [3.5])])
def test_cut_edge_cases(spark, values, labels, cuts):
    df = spark.createDataFrame([(y, [float(v)]) for v, y in zip(values, labels, strict=True)], "y int, features array<double>")
    for most in (100, 0):
        assert mdlp.fit(df, max_by_part=most).cuts[0] == (cuts or ONE_BIN)


@pytest.mark.parametrize("max_bins", [1, 3, 15])
def test_levels_are_search(spark, max_bins):
    rng = np.random.default_rng(max_bins)
    v = rng.integers(0, 60, 600).astype(float)
    y = ((v // 10).astype(int) + (rng.random(600) < 0.1)) % 3
    df = spark.createDataFrame([(int(b), [float(a), float(a % 7)]) for a, b in zip(v, y, strict=True)], "y int, features array<double>")
    one, two = mdlp.fit(df, max_bins=max_bins), mdlp.fit(df, max_bins=max_bins, max_by_part=0)
    assert one.cuts == two.cuts and len(one.cuts[0]) <= max_bins + 1
    sparse = df.select("y", F.filter(F.transform("features", lambda x, i: F.struct(i.alias("i"), x.alias("v"))), lambda e: e["v"] != 0).alias("entries"))
    assert mdlp.fit(sparse, max_bins=max_bins, sparse=True).cuts == one.cuts


def test_bins_are_right_closed(spark):
    t = Thresholds([[0.0, 2.0], None])
    df = spark.createDataFrame([([-1.0, 7.5],), ([0.0, 1.0],), ([2.0, 1.0],), ([2.5, None],)], "features array<double>")
    assert [r.bins for r in t.transform(df).collect()] == [[0.0, 7.5], [0.0, 1.0], [1.0, 1.0], [2.0, None]]


def test_evolution_finds_the_cut(spark):
    rng = np.random.default_rng(2)
    v = rng.integers(0, 20, 800).astype(float)
    df = spark.createDataFrame([(i, int(x > 9), [float(x)]) for i, x in enumerate(v)], "row_id int, y int, features array<double>")
    # of two candidates one is half of all points: at the default alpha no cut is the best mask
    o = evolve.Options(evaluations=200, rate=0.5, alpha=0.2)
    one, two = (evolve.fit(df, partitions=2, options=o).cuts for _ in range(2))
    assert one == two and 9.5 in one[0]
    assert evolve.naive_bayes_error(np.array([[0], [0], [1], [1]]), np.array([0, 0, 1, 1]), 2) == 0


def test_generators(spark):
    df, tree = generate.discrete(spark, 500, 3, [0.0], 2, 4, seed=3)
    again = generate.discrete(spark, 500, 3, [0.0], 2, 4, seed=3)[0].repartition(3)
    out = df.orderBy("row_id").collect()
    assert out == again.orderBy("row_id").collect()
    assert all(tree.decide(r.bins) == r.y and r.bins[3] == r.bins[0] for r in out)
    assert tree.stats()["max_depth"] >= 1
    g = generate.gaussian(spark, 400, 3, 2, 1)
    means = g.groupBy("y").agg(F.array(*[F.avg(F.col("features")[i]) for i in range(3)]).alias("m")).collect()
    assert np.linalg.norm(np.subtract(means[0].m, means[1].m)) > 1.5


LINES = ["% c", "@relation r", "@attribute a real [0.0, 1.0]", "@attribute b integer [0, 9]", "@attribute c {x, y}", "@inputs a, b", "@outputs c", "@data", "0.5, 3, x", "", "?,<null>,y", "2.0,3.5,z", "q,1", "w,1,x", "0.1,1,?"]


def test_declared_tables(spark, tmp_path):
    df, header = declared.from_lines(spark, LINES)
    assert [a.direction for a in header.attributes] == ["input", "input", "output"] and df.count() == 6
    faults = declared.validate(declared.raw_rows(spark.createDataFrame([(x,) for x in LINES], "value string")), header)
    assert sorted(r.kind for r in faults.collect()) == sorted(["above maximum", "integer expected", "unknown nominal value", "wrong number of values", "number expected", "missing output"])
    good = spark.createDataFrame([(x,) for x in LINES[:11]], "value string")
    rows = declared.checked(declared.raw_rows(good), header)
    assert declared.normalized(rows, header).collect()[1][:] == (-1.0, -1.0, 1.0)
    assert declared.labelled(rows, header).first()[:] == (0.0, [0.5, 3.0])
    assert declared.parse_header(header.text().split("\n")) == header
    declared.write(rows, header, str(tmp_path / "t"))
    back, _ = declared.read(spark, str(tmp_path / "t"), declared.read_header(spark, str(tmp_path / "t.header")))
    assert sorted(map(str, back.collect())) == sorted(map(str, rows.collect()))
    assert header.without("a").of("undefined")[0].name == "a" and header.differs(header.without("a"))
    with pytest.raises(declared.DataFault):
        declared.checked(declared.raw_rows(spark.createDataFrame([(x,) for x in LINES], "value string")), header)
    with pytest.raises(ValueError, match="bounds"):
        declared.set_cell(rows, header, F.lit(True), "a", 3.0)
    assert declared.clamped(declared.typed(declared.raw_rows(spark.createDataFrame([("7,3,x",)], "value string")), header), header).first().a == 1.0


def test_measures_and_threshold(spark):
    df = spark.createDataFrame([(1.0, 0.9), (1.0, 0.6), (0.0, 0.7), (0.0, 0.1)], "label double, score double")
    assert evaluate.best_threshold(df) == 0.6
    said = df.select("label", (F.col("score") >= 0.6).cast("double").alias("prediction"))
    assert evaluate.one_point_auc(said).first().auc == 0.75


def test_experiment_resumes(spark, tmp_path):
    rows = generate.gaussian(spark, 300, 3, 1, 1, seed=4).select(F.col("y").cast("double").alias("label"), "features")
    p = experiment.parse([f"--output-dir={tmp_path}", "--disc=mdlp", "--fs=yes", "--fs-nfeat=2", "--classifier=NB"])
    one = experiment.run(spark, [(rows, rows)], experiment.stages_of(p), str(tmp_path))
    two = experiment.run(spark, [(rows, rows)], experiment.stages_of(p), str(tmp_path))
    assert one["test"]["mean"] > 0.8 and one["folds"][0]["seconds"]["select"] == pytest.approx(two["folds"][0]["seconds"]["select"], rel=0.2)
    summary = [r.value for r in spark.read.text(f"{tmp_path}/summary").collect()]
    assert summary == experiment.rendered(two).split("\n") and f"mean\t{two['train']['mean']:.6f}\t{two['test']['mean']:.6f}" in summary
    assert sum(int(n) for line in summary if line.startswith(("0.0\t", "1.0\t")) and "." not in line.split("\t", 1)[1] for n in line.split("\t")[1:]) == 600
    assert experiment.parse(["--output-dir=a=b"])["output-dir"] == "a=b"


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(-1.0, [0.0, 2.0]), (1.0, [1.0, 0.0])], "label double, features array<double>")
    files.write_libsvm(df, str(tmp_path / "l"))
    assert sorted(map(tuple, files.read_libsvm(spark, str(tmp_path / "l"), dense=True, n_features=2).collect())) == [(0.0, [0.0, 2.0]), (1.0, [1.0, 0.0])]
    (tmp_path / "d.csv").write_text("1,2,3\n0,5,6\n")
    assert files.read_delimited(spark, str(tmp_path / "d.csv"), 3).collect()[0][:] == (1.0, [2.0, 3.0])
    t = Thresholds([[1.5], None])
    files.write_thresholds(spark, t, str(tmp_path / "t"))
    assert files.read_thresholds(spark, str(tmp_path / "t"), 2).cuts == t.cuts
    assert files.fold_paths("a", "s-fold", 2)[1] == ("a/s-2tra.data", "a/s-2tst.data")


def test_running_histograms(spark, tmp_path):
    from featlens.streaming import histograms

    rows = queries.binned(spark, "/root/testdata/sf0.001")
    rows.write.parquet(str(tmp_path / "in"))
    query = histograms.running_hist2(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "running")
    try:
        query.processAllAvailable()
        got = {r.feature: r.mi for r in histograms.running_relevance(query).collect()}
    finally:
        query.stop()
    assert got == pytest.approx({r.feature: r.mi for r in info.relevance(rows).collect()})


def test_cuts_are_those_of_the_sql(spark, tmp_path):
    """More cuts than max_bins + 1, and halves that could be cut below the SQL's levels."""
    import duckdb
    import pyarrow as pa
    import pyarrow.parquet as pq

    rng = np.random.default_rng(4)
    quantity = rng.integers(1, 51, 600_000)
    table = {"l_orderkey": np.arange(len(quantity)), "l_linenumber": np.where(rng.random(len(quantity)) < quantity / 51, 7, 1).astype(np.int32), "l_quantity": quantity.astype(float), "l_extendedprice": 70_000 + quantity / 4}
    (tmp_path / "lineitem.parquet").mkdir()
    pq.write_table(pa.table(table), tmp_path / "lineitem.parquet" / "part.parquet")
    sql = duckdb.connect()
    sql.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    for name in ("mdlp_quantity", "mdlp_full", "mdlp_levels"):
        want = sorted(sql.execute(queries.ORACLE_SQL[name]).fetchall())
        assert len(want) > mdlp.MAX_BINS + 1
        assert sorted(map(tuple, queries.QUERIES[name](spark, str(tmp_path)).collect())) == want


def test_cuts_that_are_equal_as_floats(spark):
    rng = np.random.default_rng(6)
    # a cent apart above 65,536: neighbours as floats, so middles coincide
    k = rng.integers(0, 50, 4000)
    y = (rng.random(4000) < np.where(k < 25, 0.1, 0.9)).astype(int)
    df = spark.createDataFrame([(int(b), [float(70_000 + a / 100)]) for a, b in zip(k, y, strict=True)], "y int, features array<double>")
    cands = mdlp.candidates(mdlp.point_hist(df), 2).collect()
    assert len({r.cut for r in cands}) < len(cands)
    cum = mdlp.cumulative(mdlp.candidates(mdlp.point_hist(df), 2), 2)
    assert cum.groupBy("cut").agg(F.count_distinct("l0", "l1").alias("n")).where("n > 1").count() == 0
    for levels in (1, 3, None):
        one, two = (mdlp.fit(df, max_by_part=most, max_levels=levels).cuts[0] for most in (100_000, 0))
        assert one == two and len(set(one)) == len(one)
