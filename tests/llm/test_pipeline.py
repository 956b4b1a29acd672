"""The pipeline against a brute-force version of what can be said plainly."""

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from tests.llm.test_others import hits
from weft.llm import language, sentencepiece


def trimmed(docs, n=100):
    seen, out = set(), {}
    for d, t in sorted(docs.items()):
        b = t.encode()
        gone = bytearray(len(b))
        for i in range(len(b) - n + 1):
            if b[i : i + n] in seen:
                gone[i : i + n] = b"\1" * n
            seen.add(b[i : i + n])
        kept = bytes(x for x, g in zip(b, gone) if not g)
        if kept or not b:
            out[d] = kept.decode("utf-8", "ignore")
    return out


def test_pipeline(spark, db, sf):
    docs = {d: t for d, t in db.execute("SELECT doc_id, text FROM documents").fetchall() if language.has_letter(t)}
    from tests.llm.test_similar import first_of  # five words, similarity 0.8

    of = first_of(sorted(docs.items()))
    docs = trimmed({d: t for d, t in docs.items() if of[d] == d})
    items = db.execute("SELECT item_id, text FROM benchmark").fetchall()
    docs = {d: t for d, t in docs.items() if not hits(t, items)[1]}
    got = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id: r.text for r in got} == docs
    decoded = sentencepiece.load().decoded
    assert all(sentencepiece.decode_ids(r.ids, decoded) == r.text and r.n_chars == len(r.text) for r in got)


CLASHING = "lang_pred score _text spans n_bytes kept kept_text no_text n_words item_ids ids n_tokens decoded block bytes data replies id k0 c0 c1 text_ _node _id node key component least n h lo more".split()


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_keep_the_columns(spark, awkward, none, sf, name):
    """Any other column keeps its name, type and values, whatever it is called; rows come and go whole."""
    from pyspark.sql import functions as F

    stage = dict(corpus_pipeline.STAGES)[name]
    docs = awkward.withColumnRenamed("h", "n_chars").withColumns({"row.no": F.monotonically_increasing_id(), **{c: F.concat(F.lit(c + " "), F.col("doc_id").cast("string")) for c in CLASHING}})
    nested = F.struct(F.col("doc_id").alias("a-b"), F.array(F.struct(F.col("lang").alias("x y"))).alias("`c"))
    docs = docs.withColumns({"nested": nested, "tick`ed": F.create_map(F.lit("k"), nested)})
    df = spark.createDataFrame(docs.collect(), docs.schema)
    got = stage(spark, df, sf)
    new = ["tokens_ids", "tokens_n_tokens"] if name == "sentencepiece" else []
    assert got.columns == [*df.columns, *new] and [got.schema[c].dataType for c in df.columns] == [f.dataType for f in df.schema]
    before = {r["row.no"]: r for r in df.collect()}
    rows = got.collect()
    assert rows and len({r["row.no"] for r in rows}) == len(rows)
    changed = ("text", "n_chars") if name == "suffix_array_dedup" else ()
    for r in rows:
        assert all(r[c] == before[r["row.no"]][c] for c in df.columns if c not in changed)
    kept = {r.doc_id for r in rows}
    if name in ("benchmark_decontamination", "sentencepiece"):
        assert len(rows) == df.count()
    if name == "language_id":
        assert kept == {1, 2, 6, 7, 8, None}
    if name == "suffix_array_dedup":
        assert {3, 4, 5, 8, 9} <= kept and [r.text for r in rows if r.doc_id == 3] == [None]
    empty = stage(spark, none.withColumnRenamed("h", "n_chars"), sf)
    assert empty.count() == 0 and empty.columns[: len(none.columns)] == [c if c != "h" else "n_chars" for c in none.columns]
