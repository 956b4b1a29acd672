"""Fill-in-the-middle transformation: a text is cut at two units and its parts are dealt out anew.

A text is read twice and no array of its units is kept: the first pass counts the matches
of the unit pattern, the second advances one lazy match iterator to the two ranks drawn
and takes the ends of those matches. What a text needs beside itself and its output
doesn't grow with it. One narrow pass over the table, no shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from weft.llm.common import in_arrow, named, table

#: Lines with their ends.
LINES = r"[^\n]*\n|[^\n]+"
#: Marks of prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
#: Texts of 100 that are transformed, and of those, texts of 100 with the suffix first.
RATE, SUFFIX_FIRST = 100, 50
SEED = 7


def count_units(units: re.Pattern, text: str) -> int:
    """First pass."""
    return sum(1 for _ in units.finditer(text))


def ends_of(units: re.Pattern, text: str, first: int, second: int) -> tuple[int, int]:
    """Second pass: where the first `first` and the first `second` units end (first <= second), from one iterator."""
    matches = units.finditer(text)

    def end(steps: int, before: int) -> int:
        last = next(islice(matches, steps - 1, None), None) if steps else None
        return before if last is None else last.end()

    a = end(first, 0)
    return a, end(second - first, a)


def checked_marks(marks: tuple[str, str, str]) -> tuple[str, str, str]:
    """Marks that are found again in any output: no mark is within another, and none begins as one ends."""
    for i, x in enumerate(marks):
        for j, y in enumerate(marks):
            if not x or (i != j and x in y) or any(x[-k:] == y[:k] for k in range(1, min(len(x), len(y)) + (i != j))):
                raise ValueError(f"marks {x!r} and {y!r} can't be told apart in an output")
    return marks


def _transform(units: re.Pattern, marks: tuple[str, str, str], rate: int, suffix_first: int):
    p, s, m = marks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, forms, outputs, first, middle = [], [], [], [], []
            draws = zip(*(batch.column(i).to_pylist() for i in range(2, 6)), strict=True)
            for text, (h1, h2, h3, h4) in zip((batch.column(1)[i].as_py() or "" for i in range(batch.num_rows)), draws, strict=True):
                n = count_units(units, text)
                counts.append(n)
                if not text or any(x in text for x in marks) or h3 % 100 >= rate:
                    forms.append("plain")
                    outputs.append(text)
                    first.append(None)
                    middle.append(None)
                    continue
                x, y = sorted((h1 % (n + 1), h2 % (n + 1)))
                a, b = ends_of(units, text, x, y)
                spm = h4 % 100 < suffix_first
                forms.append("spm" if spm else "psm")
                outputs.append("".join((s, text[b:], p, text[:a], m, text[a:b]) if spm else (p, text[:a], s, text[b:], m, text[a:b])))
                first.append(a)
                middle.append(b - a)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(forms, pa.string()), pa.array(first, pa.int64()), pa.array(middle, pa.int64()), pa.array(outputs, pa.string())], names=["id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return run


def fill_in_middle(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", units: str = LINES, marks: tuple[str, str, str] = MARKS, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, seed: int = SEED
) -> DataFrame:
    """id_col, n, form, prefix_chars, middle_chars, output; one row per row of df.

    The draws of a row come from the SHA-256 of `seed:id` alone, so they don't depend on
    partitions, batches or other rows, and rows that share an id share their draws. n is the number of units,
    matched left to right over code points; the prefix ends after the smaller of two drawn
    ranks, the middle after the larger, and the suffix is the rest. What lies between two
    units belongs to the later one. form: plain (the output is the text) for an empty
    text, one that holds a mark, and those beyond `rate`; else spm (suffix, prefix, middle) for `suffix_first` of
    100, psm (prefix, suffix, middle) for the others. prefix_chars and middle_chars are
    null for plain ones. A null text is an empty one; a null id draws as an empty id. A
    text without any unit has an empty prefix and middle. Texts are cut whole, however long. An empty table gives no rows; other columns, whatever their
    names, are ignored. Marks that an output couldn't be split at again are an error.
    """
    pattern = re.compile(units)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(named(id_col).cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint").alias(f"h{i + 1}") for i in range(4)]
    rows = df.select(named(id_col).alias("id"), named(text_col).alias("text"), *draws)
    schema = StructType([StructField("id", rows.schema["id"].dataType), StructField("n", LongType()), StructField("form", StringType()), StructField("prefix_chars", LongType()), StructField("middle_chars", LongType()), StructField("output", StringType())])
    found = in_arrow(rows, _transform(pattern, checked_marks(marks), rate, suffix_first), schema)
    return found.select(F.col("id").alias(id_col), "n", "form", "prefix_chars", "middle_chars", "output")


def restore(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output and its form came from, as an expression."""
    p, s, m = checked_marks(marks)

    def parts(lead: str, then: str) -> tuple[Column, Column, Column]:
        body = F.substr(output, F.lit(len(lead) + 1))
        a = F.substring_index(body, then, 1)
        rest = F.substr(body, F.length(a) + len(then) + 1)
        b = F.substring_index(rest, m, 1)
        return a, b, F.substr(rest, F.length(b) + len(m) + 1)

    prefix, suffix, middle = parts(p, s)
    suffix_, prefix_, middle_ = parts(s, p)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(prefix_, middle_, suffix_)).otherwise(output)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


_DRAW = "CAST('0x' || substr(h, {at}, 8) AS BIGINT)"
SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('{SEED}:' || doc_id) AS h, regexp_extract_all(coalesce(text, ''), '{LINES}') AS u FROM documents),
c AS (SELECT *, CAST(len(u) AS BIGINT) AS n, {_DRAW.format(at=1)} % (len(u) + 1) AS x, {_DRAW.format(at=9)} % (len(u) + 1) AS y, {_DRAW.format(at=17)} AS h3, {_DRAW.format(at=25)} AS h4 FROM d),
p AS (
  SELECT doc_id, n, t, CASE WHEN t = '' OR {" OR ".join(f"contains(t, '{x}')" for x in MARKS)} OR h3 % 100 >= {RATE} THEN 'plain' WHEN h4 % 100 < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form,
    array_to_string(list_slice(u, 1, least(x, y)), '') AS a, array_to_string(list_slice(u, least(x, y) + 1, greatest(x, y)), '') AS b, array_to_string(list_slice(u, greatest(x, y) + 1, n), '') AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(a) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(b) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{MARKS[0]}' || a || '{MARKS[1]}' || s || '{MARKS[2]}' || b ELSE '{MARKS[1]}' || s || '{MARKS[0]}' || a || '{MARKS[2]}' || b END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p"""
