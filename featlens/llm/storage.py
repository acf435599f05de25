"""Tables of a query, and written tables in the shared folder that cut lineage."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words, as a Java/DuckDB class; bytes.split() without arguments splits at the same six characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where it is unset, a folder of this machine, which only a local master may use."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return "file:///tmp/checkpoints/featlens"


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """Within it, the session's setting key is value."""
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def releasing(spark: SparkSession):
    """Within it, a write's shuffle files go as soon as its table is whole: nothing reads them again."""
    return setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """df as a Parquet table in the shared folder: its lineage ends there and survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    with releasing(df.sparkSession):
        df.write.parquet(path, compression=compression)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def written_apart(df: DataFrame, kind: str, name: str, compression: str = "snappy") -> tuple[DataFrame, DataFrame]:
    """Two tables as written() makes them, in one pass over df: its rows whose kind is 0, and those whose kind is 1, without that column."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    with releasing(df.sparkSession):
        df.write.partitionBy(kind).parquet(path, compression=compression)
    return _part(df, kind, path, 0), _part(df, kind, path, 1)


def _part(df: DataFrame, kind: str, path: str, value: int) -> DataFrame:
    spark, schema = df.sparkSession, df.drop(kind).schema
    folder = f"{path}/{kind}={value}"
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    # no row, no folder
    at.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(at)
    out = spark.read.schema(schema).parquet(folder)
    out._written_to = folder
    return out


def fresh(name: str, df: DataFrame) -> str:
    """name, made longer until df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def forget(*tables: DataFrame) -> None:
    """Removes tables that written() made, once all that is made of them is written itself."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._written_to)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def merging(df: DataFrame) -> DataFrame:
    """df as the other side of a join by sorting: Spark judges a table by its compressed files, and would take through the driver what is many times as large in memory."""
    return df.hint("merge")


#: Whole numbers that are broadcast at most: 8 MB of them.
BROADCAST_IDS = 1_000_000


def having(df: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of df whose number is in ids, a written table of one column of df. df stays where it is if ids are few, and is shuffled if not."""
    each = ids.distinct()
    few = each.count() <= BROADCAST_IDS
    return df.join(F.broadcast(each) if few else merging(each), ids.columns, "left_semi")


#: A key that holds more than one in so many rows is joined by broadcast: fewer keys than this can.
HOT_SHARE = 1000


def join_many(many: DataFrame, few: DataFrame, keys: list[str], seen: str, total: int) -> DataFrame:
    """many joined to few on keys, whose rows in many few counts in column seen (total in all; dropped).

    A key that holds over 1 / HOT_SHARE of all rows would make one task of
    them. At most HOT_SHARE keys do, whatever the input, so few's rows of these
    are broadcast, and many's rows of them stay where they are. They are told by
    a hash of the keys, which few's keys are collected as; where there are none,
    both are joined at once. Keys are not null.
    """
    place = F.xxhash64(*keys)
    hot = [r[0] for r in few.where(F.col(seen) * HOT_SHARE > F.lit(total)).select(place).distinct().collect()]
    if not hot:
        return many.join(merging(few.drop(seen)), keys)
    frequent = few.where(place.isin(hot)).drop(seen)
    seldom = few.where(~place.isin(hot)).drop(seen)
    return many.where(place.isin(hot)).join(F.broadcast(frequent), keys).unionByName(many.where(~place.isin(hot)).join(merging(seldom), keys))


#: Rows of one key that are joined in one place, at least.
SPLIT = 1000


def join_split(many: DataFrame, few: DataFrame, keys: list[str], seen: str, total: int, spread: str) -> DataFrame:
    """join_many() for a few whose rows may be large: instead of being broadcast, the row of a hot key is repeated, once for so many of many's rows, which column spread deals over the copies.

    All repeats together are at most HOT_SHARE more than few's rows; the keys
    of these, with their numbers of copies, are what is broadcast.
    """
    copies = F.ceil(F.col(seen) / F.lit(max(total / HOT_SHARE, float(SPLIT)))).cast("int")
    dealt = few.withColumn("_copies", copies)
    hot = F.broadcast(dealt.where("_copies > 1").select(*keys, "_copies"))
    place = F.pmod(F.xxhash64(spread), F.coalesce("_copies", F.lit(1))).cast("int")
    left = many.join(hot, keys, "left").withColumn("_copy", place).drop("_copies")
    right = dealt.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1))).drop("_copies", seen)
    return left.join(merging(right), [*keys, "_copy"]).drop("_copy")


def sampled(df: DataFrame, keys: list[str], rows: int, total: int) -> DataFrame:
    """About rows of total rows (all of them if there are no more), chosen by a hash of keys: reruns agree, and equal keys go together."""
    if total <= rows:
        return df
    return df.where(F.pmod(F.xxhash64(*keys, F.lit("sample")), F.lit(1_000_000)) < int(1_000_000 * rows / total))
