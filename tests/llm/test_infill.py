import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from featlens.llm import infill, queries

UNITS = {"line": re.compile(r"[^\n]*\n|[^\n]+"), "word": re.compile(r"[\x20\x09-\x0D]+|[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"), "char": re.compile(r"(?s:.)")}
SF = "/root/testdata/sf0.001"


def units(unit, doc):
    found = UNITS[unit].findall(doc)
    return found


def brute(doc_id, doc, style=infill.Style()):
    doc = doc or ""
    digest = hashlib.sha256(f"{style.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    parts = units(style.unit, doc)
    n = len(parts)
    lo, hi = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, m, s = "".join(parts[:lo]), "".join(parts[lo:hi]), "".join(parts[hi:])
    p, x, y = style.sentinels
    if not doc or any(t in doc for t in style.sentinels) or h[2] % 100 >= style.rate:
        return doc_id, n, "plain", None, None, doc
    if h[3] % 100 < style.spm:
        return doc_id, n, "spm", len(a), len(m), x + s + p + a + y + m
    return doc_id, n, "psm", len(a), len(m), p + a + x + s + y + m


TEXT = st.text(alphabet="ab \n\t\r\x00\x0b\x85é中🎉<PSM>", max_size=60)


@given(TEXT, st.sampled_from(sorted(UNITS)), st.integers(0, 2**32 - 1), st.integers(0, 2**32 - 1))
@settings(max_examples=400, deadline=None)
def test_cuts_are_where_a_pattern_puts_them(doc, unit, h1, h2):
    parts = units(unit, doc)
    data = doc.encode()
    n, i, j = infill.cut(data, unit, h1, h2)
    lo, hi = sorted((h1 % (len(parts) + 1), h2 % (len(parts) + 1)))
    assert n == len(parts)
    assert data[:i].decode() == "".join(parts[:lo]) and data[:j].decode() == "".join(parts[:hi])
    assert infill.chars(data, i) == len(data[:i].decode())


@given(st.integers(1, 2**200), st.integers(0, 300))
def test_select_finds_the_ranked_bit(bits, k):
    places = [i for i in range(bits.bit_length()) if bits >> i & 1]
    assert infill.select(bits, k % len(places)) == places[k % len(places)]


ROWS = [(1, None), (2, ""), (3, "\n"), (4, "one"), (5, "one\ntwo"), (6, "a\n\n\nb\n"), (7, "has <S> in it\nx\n"), (8, "é中🎉\r\n" * 40), (8, "é中🎉\r\n" * 40), (None, "no id\nat all\n"), (9, "<P" + "\n<" * 20), (10, "line with words \n" * 60_000), (11, "x" * 2_000_000)]


@pytest.mark.parametrize("style", [infill.Style(), infill.Style("word", 60, 20, 3), infill.Style("char", 100, 100, 1, "<|fim_prefix|>", "<|fim_suffix|>", "<|fim_middle|>")])
def test_transform_is_the_pattern_s_and_is_undone(spark, style):
    docs = spark.createDataFrame([(i, t, "k", "psm") for i, t in ROWS], "doc_id long, text string, output string, form string").repartition(3)
    made = infill.transform(docs, style).withColumn("back", infill.restored("output", "form", style)).collect()
    assert sorted(map(str, [tuple(r)[:6] for r in made])) == sorted(map(str, [brute(i, t, style) for i, t in ROWS]))
    assert sorted(r.back for r in made) == sorted(t or "" for _, t in ROWS)
    assert infill.transform(docs.where("false"), style).count() == 0


def test_sentinels_that_a_text_could_complete_are_refused():
    for bad in (("<P>", "<P>", "<M>"), ("", "<S>", "<M>"), ("<P>", "><S", "<M>"), ("aa", "b", "c"), ("<P>", "x<P>x", "<M>"), ("aba", "x", "y")):
        with pytest.raises(ValueError):
            infill.Style(prefix=bad[0], suffix=bad[1], middle=bad[2])
    with pytest.raises(ValueError):
        infill.Style("page")


def test_query(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = []
    for r in d:
        i, n, form, a, m, out = brute(r.doc_id, r.text)
        want.append((i, n, form, a, m, hashlib.sha256(out.encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    got = queries.op11_infill(spark, SF)
    assert [f.dataType.simpleString() for f in got.schema] == ["bigint", "bigint", "string", "bigint", "bigint", "string", "string"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert {w[2] for w in want} >= {"psm", "spm"}


def test_whole_texts_leave_no_python_rows(spark):
    """Only the operator's own stage runs Python: chances, digests and the way back are Spark's."""
    plan = queries.op11_infill(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Exchange" not in plan and "BatchEvalPython" not in plan
