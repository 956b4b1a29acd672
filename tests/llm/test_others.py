import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.llm import chat, decontaminate, language, sentencepiece, sharding, topk, url_filter
from weft.llm.queries import QUERIES
from weft.plans import inspect

M = (1 << 64) - 1


# ---- sharding


def jump(key, n):
    key, b, j = key & M, -1, 0
    while j < n:
        b, key = j, (key * 2862933555777941757 + 1) & M
        j = int((b + 1) * (2**31 / ((key >> 33) + 1)))
    return b


def test_sharding(spark, db, sf):
    texts = dict(db.execute("SELECT doc_id, text FROM documents").fetchall())
    got = QUERIES["op9_sharding"](spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        own = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(own) + 1, zlib.crc32(own), "key")
        assert r["shard"] == jump(r.doc_id, 8) and r.grown_shard == jump(r.doc_id, 9) and r.grown_shard in (r["shard"], 8)
    for s in range(8):
        slots = sorted(r.slot for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))
    assert not inspect.runs_python(QUERIES["op9_sharding"](spark, sf))


def test_jump_hash_of_any_key(spark):
    keys = [0, 1, -1, 2**63 - 1, -(2**63), 123456789]
    df = spark.createDataFrame([(k,) for k in keys], "k bigint")
    for n in (1, 2, 8, 1000):
        assert [r[0] for r in df.select(sharding.jump_hash(F.col("k"), n)).collect()] == [jump(k, n) for k in keys]
    with pytest.raises(ValueError):
        sharding.jump_hash(F.col("k"), 0)


def test_sharding_of_awkward_rows(spark, awkward, none):
    got = sharding.assign_shards(awkward).collect()
    assert len(got) == awkward.count() and sharding.assign_shards(none).count() == 0
    for s in {r["shard"] for r in got}:
        assert sorted(r.slot for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    null = [r for r in got if r.doc_id is None][0]
    assert null["shard"] == jump(0, 8) and [r.size for r in got if r.doc_id == 3] == [1]


# ---- url filter


def test_url_rules(spark):
    rows = [
        ("http://A.Example.com/en/x", "example.com/en/", "block"), ("http://www.example.com/en/x", "www.example.com/en/", "allow"), ("http://www.example.com/enx", "com/", "allow"), ("http://x.net/es/", "net/es/", "block"), ("http://x.net/ES/", None, "allow"),
        ("http://notexample.com/en/", "com/", "allow"), ("http://example.com", None, "allow"), ("http://example.com?/en/", None, "allow"), ("x.com/", None, "allow"), (None, None, "allow"), ("", None, "allow"), ("a://b://com/", None, "allow"), ("//://com/en", "com/", "allow"),
    ]
    df = spark.createDataFrame([(i, u, "old") for i, (u, _, _) in enumerate(rows)], "page_id bigint, url string, verdict string")
    want = {i: (r, v) for i, (_, r, v) in enumerate(rows)}
    assert {r.page_id: (r.rule, r.verdict) for r in url_filter.filter_urls(df, url_filter.RULES).collect()} == want
    assert url_filter.filter_urls(df.limit(0), url_filter.RULES).count() == 0
    assert url_filter.filter_urls(df, []).where("rule IS NULL").count() == len(rows)
    assert not inspect.runs_python(url_filter.filter_urls(df, url_filter.RULES))


def test_many_rules(spark):
    """A thousand rules, one without a token, against a plain search of all."""
    r = np.random.default_rng(4)
    hosts = [f"{a}{b}.{t}" for a in "pqr" for b in range(60) for t in ("com", "net", "org")]
    rules = {(h, p): url_filter.Rule("block" if (len(h) + len(p)) % 2 else "allow", h, p) for h in hosts for p in r.choice(["", "/", "/a/", "/a/b", "/en/x/"], 2)}
    rules[("", "/zz")] = url_filter.Rule("block", "", "/zz")
    rules = list(rules.values())
    urls = [f"http://{s}{h}{p}" for h in r.choice(hosts, 150) for s in ("", "www.", "x") for p in ("", "/", "/a/", "/a/bc", "/zzz", "/en/x/y?/a/")]

    def plain(u):
        host, _, path = u.split("://")[1].partition("/")
        path = ("/" + path).split("?")[0] if _ else ""
        fits = [x for x in rules if (host == x.host or host.endswith("." + x.host) or not x.host and path.startswith(x.path) and host == "") and path.startswith(x.path)]
        best = max(fits, key=lambda x: (len(x.name), len(x.host)), default=None)
        return (best.name, best.verdict) if best else (None, "allow")

    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id bigint, url string")
    got = {x.page_id: (x.rule, x.verdict) for x in url_filter.filter_urls(df, rules).collect()}
    assert got == {i: plain(u) for i, u in enumerate(urls)}


def test_rules_lie_under_their_rarest_token():
    index = url_filter.index_rules(url_filter.RULES)
    assert {t: sorted(r.name for r in own) for t, own in index.items()} == {"com": ["com/"], "example": ["example.com/en/"], "www": ["www.example.com/en/"], "es": ["net/es/"], "fr": ["net/fr/"]}
    assert url_filter.index_rules([url_filter.Rule("block", "", "/pre")]) == {None: [url_filter.Rule("block", "", "/pre")]}


# ---- decontamination


def hits(text, items, window=10):
    words = lambda t: "".join(c if c.isascii() and c.isalnum() or not c.isascii() else " " for c in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")).split()
    own, mark, names = words(text), set(), set()
    for name, t in items:
        w = words(t)
        m = min(window, len(w))
        for p in {tuple(w[i : i + m]) for i in range(len(w) - m + 1)} if m else ():
            for i in range(len(own) - m + 1):
                if tuple(own[i : i + m]) == p:
                    mark.update(range(i, i + m))
                    names.add(str(name))
    return len(own), len(mark), sorted(names)


def test_decontamination(spark, monkeypatch):
    items = [(1, "a b c d e f g h i j k l"), (2, "only Three words"), (3, None), (4, "--"), (5, "ü"), (1, "again the same id under another text")]
    docs = ["x A, b. C d e f g h i j, k l m", "only three\nwords only three words", None, "", "--", "Ü ü", "a b c d e f g h i", "same id under another text again the same id under another text", "z " * 3000 + "only three words"]
    df = spark.createDataFrame([(i, t, 9) for i, t in enumerate(docs)], "doc_id bigint, text string, spans int")
    bench = spark.createDataFrame([*items, (None, "z z z")], "item_id bigint, text string")
    named = bench.where("item_id IS NOT NULL")
    for block in (decontaminate.ITEMS_BLOCK, 20):
        monkeypatch.setattr(decontaminate, "ITEMS_BLOCK", block)
        found = lambda b, **o: {r.doc_id: (r.n_words, sum(s.end - s.start for s in r.spans), r.item_ids) for r in decontaminate.find_contamination(df, b, **o).collect()}
        assert found(named) == found(bench, nameless=False) == {i: hits(t, items) for i, t in enumerate(docs)}
        all_ = {i: hits(t, [*items, (None, "z z z")]) for i, t in enumerate(docs)}  # an item without an id is found, but not named
        assert found(bench) == {i: (n, m, [x for x in ids if x != "None"]) for i, (n, m, ids) in all_.items()} and all_ != found(named)
    assert decontaminate.find_contamination(df, bench.limit(0)).where("size(spans) > 0").count() == 0
    assert decontaminate.find_contamination(df.limit(0), bench).count() == 0


def test_shift_table_skips():
    p = decontaminate.build([("i", b"a b c d e f g h i j")], 10)[0]
    assert p.shift.max() == 9 and (p.shift == 0).sum() == 1


# ---- top k


def test_top_k(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 5.0]), (2, [1.0, -5.0]), (3, [0.5, 1.0]), (100, [0.0, 1.0]), (4, None), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, [1.0]), (None, [1.0, 1.0]), (3, [0.5, 1.0]), (200, [1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = {}
    for r in topk.top_k(df, F.col("vec_id") % 100 == 0, 3).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert {k: sorted(v) for k, v in got.items()} == {
        0: [(1, 1, 1048576), (2, 2, 1048576), (3, 3, 524288)], 100: [(1, 1, 5 << 20), (2, 3, 1 << 20), (3, 3, 1 << 20)], 200: [(1, 8, 1048576)],
    }
    assert topk.top_k(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_top_k_in_blocks_and_tiles(spark, monkeypatch):
    r = np.random.default_rng(2)
    x = np.round(r.standard_normal((300, 4)), 1)
    x[50:200] = x[50]  # one vector is very common
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>").repartition(3)
    whole = sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 10 == 0).collect()))
    q = np.floor(1024 * x).astype(np.int64)
    for query in (0, 50, 290):
        want = sorted(((-int(q[query] @ q[c]), c) for c in range(300) if c != query))[:10]
        assert [(-s, c) for s, c in want] == [(s, c) for qid, rank, c, s in whole if qid == query]
    monkeypatch.setattr(topk, "QUERY_BLOCK", 200)
    assert sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 10 == 0).collect())) == whole


def test_products_beyond_doubles():
    q, c = np.array([[2.0**40, 1.0]]), np.array([[2.0**20, 1.0], [2.0**40, 0.0]])
    assert topk._products(q, c).tolist() == [[2**60 + 1, 2**63 - 1]]
    r = np.random.default_rng(6)
    q, c = r.standard_normal((5, 3)) * 10.0 ** r.integers(-2, 12, (5, 1)), r.standard_normal((40, 3)) * 10.0 ** r.integers(-2, 12, (40, 1))
    ints = lambda x: [[int(np.floor(1024 * v)) for v in row] for row in x]
    want = [[min(max(sum(a * b for a, b in zip(x, y)), -(2**63) + 1), 2**63 - 1) for y in ints(c)] for x in ints(q)]
    assert topk._products(q, c, 1024.0).tolist() == want


def test_top_k_of_huge_components(spark):
    df = spark.createDataFrame([(0, [1.0, 1.0]), (1, [1e306, 0.0]), (2, [-1e306, 5.0]), (3, [1.0, 2.0])], "vec_id bigint, embedding array<double>")
    got = [(r.vec_id, r.score) for r in topk.top_k(df, F.col("vec_id") == 0).orderBy("rank").collect()]
    assert got == [(1, 2**63 - 1), (3, 3 << 20), (2, -(2**63) + 1)]


def peak_mb(code: str) -> float:
    """Memory that a fresh Python process adds while it runs code after its first line."""
    import os
    import subprocess
    import sys

    setup, run = code.split("\n", 1)
    probe = "import resource\n" + setup + "\nm = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024\nb = m()\n" + run + "\nprint(m() - b)"
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    return float(subprocess.run([sys.executable, "-c", probe], capture_output=True, text=True, check=True, env=os.environ | {"PYTHONPATH": root, "OMP_NUM_THREADS": "1"}).stdout)


def test_full_blocks_stay_within_memory():
    queries = """import numpy as np; from types import SimpleNamespace; import pyspark, pyarrow as pa; from weft.llm import topk
n = topk.QUERY_BLOCK // 8 // 64
r = np.random.default_rng(0)
pyspark.TaskContext = SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0))
held = SimpleNamespace(value=[(64, np.arange(n), r.standard_normal((n, 64)))])
x = r.standard_normal((4096, 64)).ravel()
batch = pa.RecordBatch.from_arrays([pa.array(np.arange(4096)), pa.FixedSizeListArray.from_arrays(pa.array(x), 64).cast(pa.list_(pa.float64()))], names=["id", "vec"])
rows = sum(b.num_rows for b in topk._search(held, 10, 1024.0)(iter([batch])))
assert rows == 10 * n"""
    assert peak_mb(queries) < 450
    items = """import numpy as np; from weft.llm import decontaminate as d
r = np.random.default_rng(0)
n = d.ITEMS_BLOCK // 50
words = r.integers(0, 50_000, (n, 8))
p = d.build([(str(i), (" ".join(f"w{x}" for x in row) + " 12345").encode()) for i, row in enumerate(words.tolist())], 10)
assert sum(len(x.at) for x in p) == n"""
    assert peak_mb(items) < 450
    long = """import numpy as np; from weft.llm import decontaminate as d
r = np.random.default_rng(0)
text = (" ".join(f"w{x}" for x in r.integers(0, 50_000, d.ITEMS_BLOCK // 7).tolist())).encode()
p = d.build([("1", text)], 10)"""
    assert peak_mb(long) < 600


def test_words_that_collide():
    """Words whose polynomial hashes modulo 2**64 agree are still told apart."""
    from tests.llm.test_dedup import thue_morse

    a, b = (x.encode() for x in thue_morse(10))
    p = decontaminate.build([("one", b" ".join([a] * 10)), ("two", b" ".join([b] * 10))], 10)
    got = decontaminate.search_texts([b" ".join([a] * 11), b" ".join([b] * 10), b" ".join([a] * 9 + [b])], p, ["one", "two"])
    assert got == [(11, [(0, 11)], ["one"]), (10, [(0, 10)], ["two"]), (10, [], [])]
    v = sentencepiece.load()
    flat, count = sentencepiece.Automaton(v).encode([a, b, a])
    ids = np.split(flat, np.cumsum(count)[:-1])
    assert [sentencepiece.decode_ids(x.tolist(), v.decoded).encode() for x in ids] == [a, b, a]
    arr = np.frombuffer(b"abcxbcabc", np.uint8)
    pick, which = sentencepiece.distinct_runs(arr, np.array([0, 3, 6]), np.full(3, 3), np.zeros(3, np.uint64))
    assert pick[which].tolist() == [0, 1, 0]


# ---- language


def test_gradients():
    n = language.Network(["a", "b", "c"], hidden=4)
    n.p = {k: v.astype(np.float64) for k, v in n.p.items()}
    x, y = np.random.default_rng(0).integers(97, 110, (5, 6)), np.array([0, 1, 2, 1, 0])
    _, g = n.gradients(x, y)
    for k, w in n.p.items():
        at = np.unravel_index(np.abs(g[k]).argmax(), w.shape)
        old, sides = w[at], []
        for e in (1e-3, -1e-3):
            w[at] = old + e
            sides.append(n.gradients(x, y)[0])
        w[at] = old
        assert abs(g[k][at] - (sides[0] - sides[1]) / 2e-3) < 1e-4


def test_language_query(spark, db, sf):
    truth = dict(db.execute("SELECT doc_id, lang FROM documents").fetchall())
    got = QUERIES["op2_language_id"](spark, sf).collect()
    assert len(got) == len(truth)
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {d for d in truth if zlib.crc32(str(d).encode()) % 5 == 0}
    assert np.mean([truth[r.doc_id] == r.lang_pred for r in held]) >= 0.95
    assert all(0 <= r.score <= 1 for r in got)


def test_language_of_awkward_rows(spark, awkward, none):
    network = language.fit(awkward)
    assert language.fit(none) is None and network.labels == ["de", "en"]
    got = language.identify(awkward, network, keep=["doc_id", "lang"]).collect()
    assert len(got) == awkward.count()
    assert {r.doc_id for r in got if r.lang_pred == "und"} == {3, 4, 5, 9} and all(r.score == 0 for r in got if r.lang_pred == "und")
    assert language.identify(none, network).count() == 0
    assert {r.lang_pred for r in language.identify(awkward, None).collect()} == {"und"}
    assert not language.has_letter("²³ 12_") and language.has_letter("² x")


def sigmoid(x):
    return 1 / (1 + np.exp(-x))


def plain_label(n, text):
    """Language and score by the definition: one byte after another, chunk by chunk, in double precision."""
    buf, h = text.lower().encode(), n.h
    p = {k: w.astype(np.float64) for k, w in n.p.items()}

    def states(d, at):
        s, out = np.zeros(h), {}
        for i in at:
            a, b = p[d + "in"][buf[i]], s @ p[d + "rec"]
            z, r = np.split(sigmoid(a[: 2 * h] + b[: 2 * h]), 2)
            s = (1 - z) * np.tanh(a[2 * h :] + r * b[2 * h :]) + z * s
            out[i] = s
        return out

    total = np.zeros(len(n.labels))
    for start in range(0, len(buf), language.CHUNK):
        end = min(start + language.CHUNK, len(buf))
        forward = states("f", range(max(0, start - language.CONTEXT), end))
        back = states("b", range(min(len(buf), end + language.CONTEXT) - 1, start - 1, -1))
        for i in range(start, end):
            e = np.exp(np.concatenate((forward[i], back[i])) @ p["out"] + p["bias"])
            total += e / e.sum()
    return total / len(buf)


def test_labels_are_those_of_a_plain_pass(spark):
    """Every row of the query over whole texts, against the network run byte by byte."""
    small = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "lang")
    network = language.fit(docs.where("crc32(cast(cast(doc_id AS string) AS binary)) % 5 <> 0"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in QUERIES["op2_language_id"](spark, small).collect():
        if not language.has_letter(texts[r.doc_id]):
            assert (r.lang_pred, r.score) == ("und", 0)
            continue
        prob = plain_label(network, texts[r.doc_id])
        assert abs(prob.max() - r.score) < 1e-4 and prob[network.labels.index(r.lang_pred)] > prob.max() - 1e-4


def test_labels_do_not_depend_on_batches():
    network = language.Network(["a", "b"])
    texts = ["straße und haus", "x" * 1000, "", "one two", "日本" * 200, "a"]
    together = language.Labeller(network)(texts)
    apart = [language.Labeller(network)([t]) for t in texts]
    assert together[0] == [a[0][0] for a in apart] and np.allclose(together[1], [a[1][0] for a in apart])


# ---- sentencepiece


def best_split(text, v):
    """The split with the highest score by plain dynamic programming over characters."""
    ids = {p: i for i, p in enumerate(v.pieces) if p}
    unknown = min(s for p, s in zip(v.pieces, v.scores) if p is not None) - 10
    longest = max(len(p.decode()) for p in ids)
    text = " " + text
    n = len(text)
    best, back = [0.0] + [None] * n, [None] * (n + 1)
    for end in range(1, n + 1):
        for start in range(max(0, end - longest), end):
            p = ids.get(text[start:end].encode())
            if p is None and end - start > 1:
                continue
            score = best[start] + (unknown if p is None else v.scores[p])
            if best[end] is None or score > best[end]:
                best[end], back[end] = score, (start, p)
    out, end = [], n
    while end:
        start, p = back[end]
        out = ([v.raw[b] for b in text[start:end].encode()] if p is None else [p]) + out
        end = start
    return out


def test_encoding_is_the_best_split(db, sf):
    import random

    v = sentencepiece.load()
    a, r = sentencepiece.Automaton(v), random.Random(1)
    texts = ["a", "  hi  there ", "▁x ▁", "日本語 😀 x", "\n\n\t a", " ", "éàü" * 30, "x" * 600, "ab日" * 400]
    texts += ["".join(r.choice("the ing on▁日😀é\n ") for _ in range(r.randint(1, 60))) for _ in range(100)]
    texts += [t[:300] for (t,) in db.execute("SELECT text FROM documents LIMIT 20").fetchall() if t]
    flat, count = a.encode([t.encode() for t in texts])
    at = 0
    for t, n in zip(texts, count.tolist()):
        own = flat[at : at + n].tolist()
        at += n
        assert own == best_split(t, v)
        assert sentencepiece.decode_ids(own, v.decoded) == t


def test_encoding_query_gives_the_best_splits(spark):
    """Every row of the query, over whole texts."""
    small = "/root/testdata/sf0.001"
    v, texts = sentencepiece.load(), {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()}
    got = QUERIES["op7_sentencepiece"](spark, small).collect()
    assert len(got) == len(texts)
    for r in got:
        t = texts[r.doc_id]
        assert r.ids == (None if t is None else best_split(t, v) if t else []) and r.n_tokens == len(r.ids or []) and r.round_trip == (None if t is None else True)


def test_round_trip_of_awkward_rows(spark, awkward, none, db, sf):
    got = sentencepiece.decode(sentencepiece.encode(awkward)).collect()
    assert len(got) == awkward.count() and all(r.text == r.decoded for r in got)
    assert [r.ids for r in got if r.doc_id == 3] == [None] and [r.ids for r in got if r.doc_id == 4] == [[]]
    assert sentencepiece.encode(none, back=True).count() == 0
    assert all(r.round_trip for r in QUERIES["op7_sentencepiece"](spark, sf).collect())


# ---- preference formatting


def test_preferences(spark, none):
    rows = [
        (0, 0, "user", "hi"), (0, 1, "assistant", "yes"), (0, 2, "user", "why"), (1, 0, "user", "hi"), (1, 1, "assistant", "no"), (2, 0, "user", "q"), (2, 1, "assistant", "a"), (3, 1, "assistant", "a"), (3, 0, "user", "q"),
        (4, 0, "user", "alone"), (None, 0, "user", "x"), (6, None, None, None), (7, 0, "assistant", "b"),
    ]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = {r.pair_id: r for r in chat.format_preferences(df, F.floor(F.col("conv_id") / 2), F.col("conv_id") % 2 == 0).collect()}
    assert set(got) == {0, 1, 2, 3}
    r = got[0]
    assert (r.prefix_turns, r.prompt) == (1, "<|user|>\nhi<|end|>\n")
    assert r.chosen == "<|assistant|>\nyes<|end|>\n<|user|>\nwhy<|end|>\n" and r.rejected == "<|assistant|>\nno<|end|>\n"
    assert [r.chosen[s.start : s.end] for s in r.chosen_spans] == ["yes<|end|>\n"] and [r.rejected[s.start : s.end] for s in r.rejected_spans] == ["no<|end|>\n"]
    assert (got[1].prefix_turns, got[1].chosen, got[1].rejected) == (2, "", "")
    assert (got[2].prompt, got[2].rejected, got[2].chosen) == ("", None, "<|user|>\nalone<|end|>\n")
    assert (got[3].prefix_turns, got[3].chosen) == (0, "<||>\n<|end|>\n")
    assert chat.format_preferences(df.limit(0), F.col("conv_id"), F.col("conv_id") > 0).count() == 0


# ---- pipeline stages on tables that lack what they learn from or name


@pytest.mark.parametrize("labelled", [[], [d for d in range(1, 200) if zlib.crc32(str(d).encode()) % 5 == 0]])
def test_stage_keeps_lettered_texts_where_nothing_is_learned(spark, labelled):
    rows = [(d, t, "en" if d in labelled else None) for d, t in enumerate(["a clean text", "Ünïcode", "12 --", "", None, *["some words"] * 195])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = language.reject_unknown(spark, df, "")
    assert got.columns == df.columns
    assert sorted(r.doc_id for r in got.collect()) == [0, 1, *range(5, 200)]


def test_stage_drops_windows_of_items_without_id(spark, tmp_path):
    words = " ".join(f"w{i}" for i in range(12))
    items = spark.createDataFrame([(None, words), ("named", "other words " * 6), (None, None)], "item_id string, text string")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    df = spark.createDataFrame([(1, f"before {words} after"), (2, "other words " * 6), (3, "clean")], "doc_id bigint, text string")
    assert [r.doc_id for r in decontaminate.drop_contaminated(spark, df, str(tmp_path)).collect()] == [3]
    got = {r.doc_id: (len(r.spans), r.item_ids) for r in decontaminate.find_contamination(df, items, nameless=True).collect()}
    assert got == {1: (1, []), 2: (1, ["named"]), 3: (0, [])}
