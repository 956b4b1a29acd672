import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

pytest.importorskip("weft.llm.fill_middle")
from weft.llm.fill_middle import LINES, MARKS, checked_marks, count_units, ends_of, fill_in_middle, restore
from weft.llm.queries import QUERIES


def plain(doc_id, text, pattern=LINES, rate=100, suffix_first=50):
    """The transformation with a list of units."""
    text = text or ""
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    ends = [0] + [m.end() for m in re.finditer(pattern, text)]
    n = len(ends) - 1
    if not text or any(x in text for x in MARKS) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    a, b = (ends[k] for k in sorted((h[0] % (n + 1), h[1] % (n + 1))))
    p, m, s = text[:a], text[a:b], text[b:]
    return (n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < suffix_first else (n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


def test_query_against_lists_of_units(spark, db, sf):
    texts = dict(db.execute("SELECT doc_id, text FROM documents").fetchall())
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = {tuple(r) for r in QUERIES["op13_fill_in_middle"](spark, sf).collect()}
    want = {(i, *(w := plain(i, t))[:4], digest(w[4]), digest(t or "")) for i, t in texts.items()}
    assert got == want and {r[2] for r in got} >= {"spm", "psm"}


@pytest.mark.parametrize("pattern", [LINES, r"\S+", r"\w+|\s", "x?", "z"])
def test_ranks_of_any_pattern(spark, pattern):
    r = random.Random(3)
    texts = ["".join(r.choice("ab x\n日😀<PSM>") for _ in range(r.randint(0, 40))) for _ in range(300)] + [None, "", "\n", "a<P>b", "<P", "x" * 50_000 + "\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = fill_in_middle(df, units=pattern, rate=70, suffix_first=30).withColumn("back", restore(F.col("output"), F.col("form")))
    assert {tuple(x)[:6]: x.back for x in got.collect()} == {(i, *plain(i, t, pattern, 70, 30)): t or "" for i, t in enumerate(texts)}


def test_second_pass_keeps_no_units():
    text = "a\n" * 10 + "end"
    units = re.compile(LINES)
    assert count_units(units, text) == 11
    assert [ends_of(units, text, a, b) for a, b in [(0, 0), (0, 11), (3, 3), (2, 10), (11, 11)]] == [(0, 0), (0, 23), (6, 6), (4, 20), (23, 23)]


def test_awkward_rows(spark, awkward, none):
    rows = awkward.collect()
    got = fill_in_middle(awkward.withColumns({"output": F.lit(1), "a-b `c": F.lit(2)})).withColumn("back", restore(F.col("output"), F.col("form"))).collect()
    want = sorted((str((r.doc_id, *plain(r.doc_id, r.text))), r.text or "") for r in rows)
    assert sorted((str(tuple(x)[:6]), x.back) for x in got) == want
    assert fill_in_middle(none).count() == 0
    odd = spark.createDataFrame([("x", "a\nb")], "`id ``x` string, `t.t` string")
    assert [tuple(x) for x in fill_in_middle(odd, "id `x", "t.t").collect()] == [("x", *plain("x", "a\nb"))]


@pytest.mark.parametrize("marks", [("", "b", "c"), ("ab", "bc", "x"), ("a", "a", "b"), ("xyx", "m", "n"), ("abc", "b", "n")])
def test_marks_that_run_into_each_other(marks):
    with pytest.raises(ValueError):
        checked_marks(marks)
