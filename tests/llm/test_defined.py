"""Cases that operators define beside their main ones: long texts, repeated rows, other columns."""

import pytest
from pyspark.sql import functions as F

pytest.importorskip("weft.llm.queries")
from weft.llm import chat, topk, url_filter

LONG = "x y " * 100_000


def test_preferences_of_long_and_repeated_turns(spark):
    rows = [(0, 0, "user", LONG), (0, 1, "assistant", "a"), (1, 0, "user", LONG), (1, 1, "assistant", LONG), (2, 0, "user", "q"), (2, 0, "user", "q"), (2, 1, "assistant", "z"), (3, 0, "user", "q"), (3, 1, "assistant", "z")]
    df = spark.createDataFrame([(*r, 1, "p") for r in rows], "conv_id bigint, turn bigint, role string, text string, pair_id int, `pro``mpt` string").withColumns({"c": F.lit(2), "side": F.lit("x")})
    got = {r.pair_id: r for r in chat.format_preferences(df, F.floor(F.col("conv_id") / 2), F.col("conv_id") % 2 == 0).collect()}
    assert got[0].prefix_turns == 1 and got[0].prompt == f"<|user|>\n{LONG}<|end|>\n" and got[0].rejected == f"<|assistant|>\n{LONG}<|end|>\n"
    assert got[0].rejected[got[0].rejected_spans[0].start : got[0].rejected_spans[0].end] == f"{LONG}<|end|>\n"
    assert got[1].prefix_turns == 1 and got[1].chosen == "<|user|>\nq<|end|>\n<|assistant|>\nz<|end|>\n" and got[1].rejected == "<|assistant|>\nz<|end|>\n"


def test_top_k_beside_other_columns(spark):
    df = spark.createDataFrame([(i, [float(i % 5), 1.0], "a", i) for i in range(8)], "vec_id bigint, embedding array<float>, score string, id bigint").withColumns({"vec": F.lit(0), "rank": F.lit(9), "task": F.lit("t")})
    want = [tuple(r) for r in topk.top_k(df.select("vec_id", "embedding"), F.col("vec_id") == 0, 3).orderBy("rank").collect()]
    assert [tuple(r) for r in topk.top_k(df, F.col("vec_id") == 0, 3).orderBy("rank").collect()] == want and len(want) == 3


def test_long_and_repeated_urls(spark):
    long = "http://www.example.com/en/" + "a/" * 200_000
    df = spark.createDataFrame([(1, long, "x"), (1, long, "x"), (2, "http://" + "s." * 20_000 + "net/fr/q", None)], "page_id bigint, url string, `ru``le.x` string")
    got = sorted(tuple(r) for r in url_filter.filter_urls(df.select("page_id", "url"), url_filter.RULES).select("page_id", "rule", "verdict").collect())
    assert got == [(1, "www.example.com/en/", "allow")] * 2 + [(2, "net/fr/", "block")]


def test_rules_of_a_table(spark, sf):
    """The same verdicts as from a list; twenty thousand rules, some without a token, against a plain search."""
    import random
    import time

    from weft.plans import inspect

    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url")
    table = lambda rules: spark.createDataFrame([(r.verdict, r.host, r.path) for r in rules], "verdict string, host string, path string")
    key = lambda d: sorted(map(tuple, d.select("page_id", "host", "path", "rule", "verdict").collect()), key=str)
    small = url_filter.filter_urls_by_table(pages, table(url_filter.RULES))
    assert key(small) == key(url_filter.filter_urls(pages, url_filter.RULES)) and not inspect.runs_python(small)
    r = random.Random(5)
    rules = {(f"h{r.randrange(9000)}.{r.choice(['com', 'net'])}", r.choice(["", "/", "/a/", "/q.e\\E/x", "/(b"])): r.choice(["allow", "block"]) for _ in range(20_000)} | {("", "/zz"): "block"}
    urls = [f"http://{s}h{r.randrange(9000)}.{r.choice(['com', 'net'])}{p}" for s in ("", "w.") for p in ("", "/", "/a/b", "/q.e\\E/x/y", "/(b)", "/zzz") for _ in range(40)] + ["x:///zz/", None, ""]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id bigint, url string").withColumn("_best", F.lit(1))
    began = time.time()
    found = url_filter.filter_urls_by_table(df, table([url_filter.Rule(v, h, p) for (h, p), v in rules.items()]))
    found._jdf.queryExecution().executedPlan()
    assert time.time() - began < 60 and found.columns == ["page_id", "url", "_best", "host", "path", "rule", "verdict"]

    def plain(u):
        host, path = "", ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            host, _, tail = rest.partition("/")
            path = "/" + tail if _ else ""
        parts = host.split(".")
        fits = [(h, p) for h in {".".join(parts[i:]) for i in range(len(parts))} | {host} for p in ("", "/", "/a/", "/q.e\\E/x", "/(b", "/zz") if (h, p) in rules and path.startswith(p)]
        best = max(fits, key=lambda x: (len(x[0] + x[1]), len(x[0])), default=None)
        return (best[0] + best[1], rules[best]) if best else (None, "allow")

    assert {x.page_id: (x.rule, x.verdict) for x in found.collect()} == {i: plain(u) for i, u in enumerate(urls)}
    assert url_filter.filter_urls_by_table(df.limit(0), table(url_filter.RULES)).count() == 0 and url_filter.filter_urls_by_table(df, table(url_filter.RULES).limit(0)).where("rule IS NULL").count() == len(urls)
