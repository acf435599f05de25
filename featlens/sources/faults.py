"""Faults of a declared table's files, each with its file, line, row and attribute.

Lines of split files are numbered by a count for each file block: the blocks'
counts are a small table, and a line's place in its block follows from the order
in which Spark reads it. Rows, which skip the header, comments and blank lines,
are numbered by a prefix scan over the lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from featlens.functions import scan
from featlens.sources import declared
from featlens.sources.declared import INPUT, NOMINAL, OUTPUT, Header
from featlens.sources.files import stored

#: Kinds of faults that headers have.
HEADER_ERRORS = ("attribute defined twice", "attribute not defined in train", "input of train not defined", "input of test not defined", "output of train not defined", "output of test not defined", "inputs of test differ", "outputs of test differ")


def numbered_lines(spark: SparkSession, path: str, through: bool = False) -> DataFrame:
    """(file, line, value) of text files: lines from 1 in each file, or, if through, on through all files in the order of their names."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    # written, so that each line keeps its place
    lines = stored(lines, "lines")
    blocks = lines.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    order = Window.orderBy("file", "block") if through else Window.partitionBy("file").orderBy("block")
    blocks = blocks.select("file", "block", "first", F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    placed = lines.join(F.broadcast(blocks), ["file", "block"])
    return placed.select("file", (F.col("before") + F.col("at") - F.col("first") + 1).alias("line"), "value")


def numbered_rows(lines: DataFrame, through: bool = False, part_rows: int | None = None) -> DataFrame:
    """(file, number, row, line, cells) of numbered lines: the data rows' line numbers, their own numbers from 1, and their texts and cells as declared.raw_rows() has them."""
    value = F.trim("value")
    marked = lines.withColumn("is_row", ((value != "") & ~value.startswith("%") & ~value.startswith("@")).cast("int")).withColumn("_all", F.lit(0))
    by = ["_all"] if through else ["file"]
    counted = scan.running(scan.parts(marked, by, "line", part_rows), by, "line", {"is_row": "row"}).where("is_row = 1")
    return declared.raw_rows(counted.select("value", "file", F.col("line").alias("number"), "row"))


def row_faults(rows: DataFrame, header: Header, test: bool = False) -> DataFrame:
    """(kind, file, line, row, attribute, place, direction, value): every fault of numbered rows, test rows' values outside the bounds among them. place: of the attribute in the header, from 0; null if the whole row is at fault."""
    found = declared.validate(rows, header, test, bounds_in_test=True)
    known = F.create_map(*[F.lit(x) for i, a in enumerate(header.attributes) for x in (a.name, i)])
    sides = F.create_map(*[F.lit(x) for a in header.attributes for x in (a.name, a.direction)])
    name = F.when(F.col("attribute") != "", F.col("attribute"))
    return found.select("kind", "file", F.col("number").alias("line"), "row", name.alias("attribute"), F.try_element_at(known, name).alias("place"), F.try_element_at(sides, name).alias("direction"), "value")


def header_faults(train: list[str], test: list[str] | None = None) -> list[tuple[str, str]]:
    """(kind, attribute) of what is wrong in the lines of a header, or of a training and a test header."""
    found, sides = [], []
    for side, lines in (("train", train), ("test", test)):
        if lines is None:
            continue
        names, directions = declared.header_parts(lines)
        seen: set[str] = set()
        for n in names:
            if n in seen:
                found.append((HEADER_ERRORS[0], n))
            seen.add(n)
        for direction, first in ((INPUT, 2), (OUTPUT, 4)):
            found += [(HEADER_ERRORS[first + (side == "test")], n) for n in directions.get(direction) or () if n not in seen]
        sides.append((list(dict.fromkeys(names)), directions))
    if test is not None:
        (names, a), (others, b) = sides
        found += [(HEADER_ERRORS[1], n) for n in others if n not in names]
        for direction, kind in ((INPUT, HEADER_ERRORS[6]), (OUTPUT, HEADER_ERRORS[7])):
            if direction in b and a.get(direction) != b[direction]:
                found += [(kind, n) for n in sorted(set(a.get(direction) or ()) ^ set(b[direction]))]
    return found


def from_arrays(df: DataFrame, header: Header, features: str = "features") -> DataFrame:
    """Typed rows of arrays with one number for each attribute: NaN and null are missing, nominal codes become the header's values, integers are rounded. A code without a value is missing. The way back from declared.coded()."""
    kinds = {declared.INTEGER: "bigint", declared.REAL: "double"}

    def one(i: int, a) -> F.Column:
        v = F.get(features, F.lit(i)).cast("double")
        v = F.when(~F.isnan(v), v)
        if a.kind != NOMINAL:
            return (F.round(v) if a.kind == declared.INTEGER else v).cast(kinds[a.kind]).alias(a.name)
        return F.get(F.array(*[F.lit(x) for x in a.values]), F.when(v >= 0, v).cast("int")).alias(a.name)

    return df.select(*[c for c in df.columns if c != features], *[one(i, a) for i, a in enumerate(header.attributes)])
