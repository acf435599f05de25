"""Tables with a declared header: attributes with types, bounds or value lists, and directions; then comma-separated rows.

    @relation r
    @attribute a real [0.0, 1.0]
    @attribute b integer [0, 9]
    @attribute c {x, y}
    @inputs a, b
    @outputs c
    @data
    0.5,3,x

Keywords ignore case, % starts a comment line, ? and <null> are missing. With
neither @inputs nor @outputs the last attribute is the output; with one of
them the rest is the other's.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NOMINAL, INTEGER, REAL = "nominal", "integer", "real"
INPUT, OUTPUT, UNDEFINED = "input", "output", "undefined"

#: Kinds of errors in a row or header.
ERRORS = ("wrong number of values", "number expected", "integer expected", "below minimum", "above maximum", "unknown nominal value", "missing output", "unknown nominal output value in test", "header differs", "unknown nominal value in test", "number outside bounds in test")


@dataclass(frozen=True)
class Attribute:
    name: str
    kind: str
    low: float | None = None
    high: float | None = None
    values: tuple[str, ...] = ()
    direction: str = INPUT

    @property
    def line(self) -> str:
        if self.kind == NOMINAL:
            return f"@attribute {self.name} {{{', '.join(self.values)}}}"
        number = (lambda v: str(int(v))) if self.kind == INTEGER else str
        bounds = f" [{number(self.low)}, {number(self.high)}]" if self.low is not None else ""
        return f"@attribute {self.name} {self.kind}{bounds}"


@dataclass(frozen=True)
class Header:
    relation: str
    attributes: tuple[Attribute, ...]

    def named(self, name: str) -> Attribute:
        return next(a for a in self.attributes if a.name == name)

    def of(self, direction: str) -> list[Attribute]:
        return [a for a in self.attributes if a.direction == direction]

    def has(self, kind: str) -> bool:
        return any(a.kind == kind for a in self.attributes if a.direction != UNDEFINED)

    def others(self, names: list[str]) -> list[str]:
        return [a.name for a in self.attributes if a.name not in names]

    def directed(self, inputs: list[str], outputs: list[str]) -> Header:
        side = {n: INPUT for n in inputs} | {n: OUTPUT for n in outputs}
        unknown = set(side) - {a.name for a in self.attributes}
        if unknown:
            raise ValueError(f"no such attributes: {sorted(unknown)}")
        return replace(self, attributes=tuple(replace(a, direction=side.get(a.name, UNDEFINED)) for a in self.attributes))

    def without(self, name: str) -> Header:
        """The attribute becomes undefined."""
        self.named(name)
        return replace(self, attributes=tuple(replace(a, direction=UNDEFINED) if a.name == name else a for a in self.attributes))

    def differs(self, other: Header) -> list[str]:
        """What stands in the way of using other as this table's test side."""
        a, b = {x.name: x for x in self.attributes}, {x.name: x for x in other.attributes}
        out = [f"{n}: only on one side" for n in sorted(a.keys() ^ b.keys())]
        for n in sorted(a.keys() & b.keys()):
            if (a[n].kind, a[n].values, a[n].direction) != (b[n].kind, b[n].values, b[n].direction):
                out.append(f"{n}: {a[n].kind} {list(a[n].values)} {a[n].direction}, {b[n].kind} {list(b[n].values)} {b[n].direction}")
        return out

    def text(self) -> str:
        lines = [f"@relation {self.relation}", *[a.line for a in self.attributes]]
        for word, side in (("inputs", INPUT), ("outputs", OUTPUT)):
            if names := [a.name for a in self.of(side)]:
                lines.append(f"@{word} {', '.join(names)}")
        return "\n".join([*lines, "@data"])


_ATTRIBUTE = re.compile(r"@attribute\s+('[^']*'|[^\s{\[]+)\s*(.*)$", re.IGNORECASE)


def parse_header(lines: list[str]) -> Header:
    relation, found, sides = "", [], {}
    for line in (x.strip() for x in lines):
        word = line.split(None, 1)[0].lower() if line else ""
        if not line or line.startswith("%"):
            continue
        if word == "@data":
            break
        if word == "@relation":
            relation = line.split(None, 1)[1].strip() if " " in line else ""
        elif word == "@attribute":
            m = _ATTRIBUTE.match(line)
            if not m:
                raise ValueError(f"not an attribute: {line}")
            found.append(_attribute(m[1].strip("'"), m[2].strip()))
        elif word in ("@inputs", "@input", "@outputs", "@output"):
            sides[word.rstrip("s")] = [n.strip() for n in line.split(None, 1)[1].split(",")]
        else:
            raise ValueError(f"unknown header line: {line}")
    header = Header(relation, tuple(found))
    names = [a.name for a in found]
    if len(set(names)) != len(names):
        raise ValueError("attributes share a name")
    ins, outs = sides.get("@input"), sides.get("@output")
    if ins is None and outs is None:
        ins, outs = names[:-1], names[-1:]
    elif outs is None:
        outs = header.others(ins)
    elif ins is None:
        ins = header.others(outs)
    return header.directed(ins, outs)


def header_parts(lines: list[str]) -> tuple[list[str], dict[str, list[str]]]:
    """Names of the attributes as they are declared, repeats too, and those that @inputs and @outputs name; nothing is checked."""
    names, sides = [], {}
    for line in (x.strip() for x in lines):
        word = line.split(None, 1)[0].lower() if line else ""
        if word == "@data":
            break
        if m := _ATTRIBUTE.match(line):
            names.append(m[1].strip("'"))
        elif word.rstrip("s") in ("@input", "@output") and " " in line:
            sides[word.rstrip("s")[1:]] = [n.strip() for n in line.split(None, 1)[1].split(",")]
    return names, sides


def _attribute(name: str, rest: str) -> Attribute:
    if rest.startswith("{"):
        return Attribute(name, NOMINAL, values=tuple(v.strip() for v in rest[1 : rest.rindex("}")].split(",")))
    word = re.split(r"[\s\[]", rest, maxsplit=1)[0].lower()
    if word not in (INTEGER, REAL):
        if rest:
            raise ValueError(f"unknown type of {name}: {rest}")
        return Attribute(name, NOMINAL)
    bounds = re.search(r"\[\s*([^,\]]+)\s*,\s*([^\]]+)\s*\]", rest)
    return Attribute(name, word, *([float(b) for b in bounds.groups()] if bounds else ()))


def read_header(spark: SparkSession, path: str, most: int = 100_000) -> Header:
    """The header of a file: the lines up to @data, in the file's order. A header that has no @data within so many lines is an error, not cut."""
    lines = [r.value for r in spark.read.text(path).limit(most + 1).collect()]
    if len(lines) > most and not any(x.strip().lower().startswith("@data") for x in lines):
        raise ValueError(f"no @data in the first {most} lines of {path}")
    return parse_header(lines)


def _data_lines(lines: DataFrame) -> DataFrame:
    value = F.trim("value")
    return lines.where((value != "") & ~value.startswith("%") & ~value.startswith("@"))


def raw_rows(lines: DataFrame) -> DataFrame:
    """(line, cells) of lines (value), and further columns as they are: trimmed cells, null where missing; the header's lines, comments and blank lines are left out."""
    cells = F.transform(F.split("value", ",", -1), lambda c: F.when(F.lower(F.trim(c)).isin("?", "<null>"), None).otherwise(F.trim(c)))
    return _data_lines(lines).select(*[c for c in lines.columns if c != "value"], F.col("value").alias("line"), cells.alias("cells"))


def typed(rows: DataFrame, header: Header) -> DataFrame:
    """One column for each attribute from (cells): string, bigint or double; what can't be parsed is null."""
    kinds = {NOMINAL: "string", INTEGER: "bigint", REAL: "double"}
    return rows.select(*[F.get("cells", F.lit(i)).try_cast(kinds[a.kind]).alias(a.name) for i, a in enumerate(header.attributes)])


def read(spark: SparkSession, path: str, header: Header | None = None) -> tuple[DataFrame, Header]:
    """(typed rows, header) of a file."""
    header = header or read_header(spark, path)
    return typed(raw_rows(spark.read.text(path)), header), header


def from_lines(spark: SparkSession, lines: list[str]) -> tuple[DataFrame, Header]:
    """The same of lines that are in memory; nothing is validated."""
    header = parse_header(lines)
    return typed(raw_rows(spark.createDataFrame([(x,) for x in lines], "value string")), header), header


def validate(rows: DataFrame, header: Header, test: bool = False, bounds_in_test: bool = False) -> DataFrame:
    """(kind, line, attribute, value) of every fault of raw rows, and their further columns. Test rows may leave the bounds, unless bounds_in_test reports it; unknown output values count as their own kind there, unknown input values too if bounds_in_test."""
    wide = F.size("cells") != len(header.attributes)
    faults = [F.when(wide, F.struct(F.lit(ERRORS[0]).alias("kind"), F.lit("").alias("attribute"), F.size("cells").cast("string").alias("value")))]
    for i, a in enumerate(header.attributes):
        cell = F.get("cells", F.lit(i))

        def fault(when: Column, kind: str, a=a, cell=cell) -> None:
            faults.append(F.when(~wide & when, F.struct(F.lit(kind).alias("kind"), F.lit(a.name).alias("attribute"), cell.alias("value"))))

        if a.direction == UNDEFINED:
            continue
        if a.direction == OUTPUT:
            fault(cell.isNull(), ERRORS[6])
        if a.kind == NOMINAL:
            if a.values:
                fault(cell.isNotNull() & ~cell.isin(*a.values), ERRORS[7] if test and a.direction == OUTPUT else ERRORS[9] if test and bounds_in_test else ERRORS[5])
            continue
        number = cell.try_cast("double")
        fault(cell.isNotNull() & number.isNull(), ERRORS[1])
        if a.kind == INTEGER:
            fault(number.isNotNull() & (number % 1 != 0), ERRORS[2])
        if a.low is not None and not test:
            fault(number < a.low, ERRORS[3])
            fault(number > a.high, ERRORS[4])
        elif a.low is not None and bounds_in_test:
            fault((number < a.low) | (number > a.high), ERRORS[10])
    more = [c for c in rows.columns if c not in ("line", "cells")]
    found = rows.select("line", *more, F.explode(F.filter(F.array(*faults), lambda x: x.isNotNull())).alias("x"))
    return found.select("x.kind", "line", "x.attribute", "x.value", *more)


class DataFault(ValueError):
    """Rows that don't fit their header; faults holds the first of them."""

    def __init__(self, faults: list):
        super().__init__("; ".join(f"{f.kind} ({f.attribute}: {f.value})" for f in faults[:5]))
        self.faults = faults


def checked(rows: DataFrame, header: Header, test: bool = False, shown: int = 100) -> DataFrame:
    """typed() rows, clamped to the bounds if test; raises if there are faults."""
    faults = validate(rows, header, test).limit(shown).collect()
    if faults:
        raise DataFault(faults)
    out = typed(rows, header)
    return clamped(out, header) if test else out


#: Values of a nominal attribute that learned() takes to the driver at most.
MAX_VALUES = 100_000


def learned(df: DataFrame, header: Header) -> Header:
    """header with the bounds and value lists that it doesn't declare, from training rows. Values are in order. An attribute of more than MAX_VALUES stays open: its values are a table's, see sources.dictionary."""
    aggs = []
    open_ = [a.name for a in header.attributes if a.kind == NOMINAL and not a.values]
    if open_:
        many = df.agg(*[F.count_distinct(n).alias(n) for n in open_]).first()
        open_ = [n for n in open_ if many[n] <= MAX_VALUES]
    for a in header.attributes:
        if a.kind != NOMINAL and a.low is None:
            aggs += [F.min(a.name).cast("double").alias(f"{a.name}:low"), F.max(a.name).cast("double").alias(f"{a.name}:high")]
        if a.name in open_:
            aggs.append(F.array_sort(F.collect_set(a.name)).alias(f"{a.name}:values"))
    if not aggs:
        return header
    row = df.agg(*aggs).first().asDict()
    return replace(header, attributes=tuple(replace(a, low=row.get(f"{a.name}:low", a.low), high=row.get(f"{a.name}:high", a.high), values=tuple(row.get(f"{a.name}:values", a.values))) for a in header.attributes))


def clamped(df: DataFrame, header: Header) -> DataFrame:
    """Numbers outside their bounds become the nearest bound."""
    return df.withColumns({a.name: F.when(F.col(a.name).isNotNull(), F.greatest(F.least(F.col(a.name), F.lit(a.high)), F.lit(a.low))).cast(df.schema[a.name].dataType) for a in header.attributes if a.low is not None and a.name in df.columns})


def unseen(test: DataFrame, train: DataFrame, name: str) -> DataFrame:
    """Values of a nominal attribute that only the test rows have."""
    values = lambda d: d.select(name).where(F.col(name).isNotNull()).distinct()
    return values(test).join(values(train), name, "left_anti")


def coded(df: DataFrame, header: Header) -> DataFrame:
    """Nominal values as their place in the header's list (double), numbers as double; unknown values are null."""
    def code(a: Attribute) -> Column:
        if a.kind != NOMINAL:
            return F.col(a.name).cast("double")
        place = F.array_position(F.array(*[F.lit(v) for v in a.values]), F.col(a.name))
        return F.when(place > 0, (place - 1).cast("double"))

    return df.select(*[code(a).alias(a.name) for a in header.attributes])


def labelled(df: DataFrame, header: Header) -> DataFrame:
    """(label, features): the output attribute's code, and the inputs' numbers in the header's order."""
    c = coded(df, header)
    return c.select(F.col(header.of(OUTPUT)[-1].name).alias("label"), F.array(*[F.col(a.name) for a in header.of(INPUT)]).alias("features"))


def normalized(df: DataFrame, header: Header) -> DataFrame:
    """Reals to (v - low) / (high - low), integers to v - low, nominals as they are coded; missing is -1."""
    c = coded(df, header)

    def one(a: Attribute) -> Column:
        v = F.col(a.name)
        if a.kind == REAL:
            v = (v - a.low) / (a.high - a.low) if a.high > a.low else v * 0.0
        elif a.kind == INTEGER:
            v = v - a.low
        return F.coalesce(v, F.lit(-1.0)).alias(a.name)

    return c.select(*[one(a) for a in header.attributes])


def class_means(df: DataFrame, label: str, numeric: list[str]) -> DataFrame:
    """(label, one column for each numeric attribute)."""
    return df.groupBy(label).agg(*[F.avg(n).alias(n) for n in numeric])


def class_modes(df: DataFrame, label: str, name: str, values: tuple[str, ...] = ()) -> DataFrame:
    """(label, mode, n): the commonest value of name in each class; of equals the first in values, else the smallest."""
    counts = df.where(F.col(name).isNotNull()).groupBy(label, name).agg(F.count("*").alias("n"))
    place = F.array_position(F.array(*[F.lit(v) for v in values]), F.col(name)) if values else F.lit(0)
    order = Window.partitionBy(label).orderBy(F.desc("n"), place, name)
    return counts.withColumn("_r", F.row_number().over(order)).where("_r = 1").select(label, F.col(name).alias("mode"), "n")


def set_cell(df: DataFrame, header: Header, where: Column, name: str, value) -> DataFrame:
    """df with value in the cells that where names; numbers must lie in the bounds, nominal values in the list."""
    a = header.named(name)
    if a.kind == NOMINAL and a.values and value not in a.values:
        raise ValueError(f"{name} has no value {value}")
    if a.kind != NOMINAL and a.low is not None and not a.low <= value <= a.high:
        raise ValueError(f"{value} lies outside the bounds of {name}")
    return df.withColumn(name, F.when(where, F.lit(value)).otherwise(F.col(name)).cast(df.schema[name].dataType))


def rendered(df: DataFrame, header: Header) -> DataFrame:
    """(value): rows as comma-separated lines; missing is <null>."""
    return df.select(F.concat_ws(",", *[F.coalesce(F.col(a.name).cast("string"), F.lit("<null>")) for a in header.attributes]).alias("value"))


def write(df: DataFrame, header: Header, path: str) -> None:
    """A folder of row files, and the header beside them as path + '.header'."""
    df.sparkSession.createDataFrame([(header.text(),)], "value string").coalesce(1).write.mode("overwrite").text(path + ".header")
    rendered(df, header).write.mode("overwrite").text(path)
