import numpy as np
import xxhash

from weft.llm import simhash
from weft.llm.components import components
from weft.llm.queries import QUERIES


def fingerprint(text):
    w = (text or "").encode().lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(fps):
    up = {k: k for k in fps}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(fps)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {k: root(k) for k in fps}


def test_query(spark, db, sf):
    fps = {d: fingerprint(t) for d, t in db.execute("SELECT doc_id, text FROM documents").fetchall()}
    of = groups(fps)
    got = QUERIES["op10_simhash"](spark, sf).collect()
    assert len(got) == len(fps)
    for r in got:
        assert int(r.fingerprint, 16) == fps[r.doc_id] and r.component_id == of[r.doc_id]


def test_links_of_dense_clusters(spark, monkeypatch):
    """Many fingerprints a few bits around two centres, in tiles of eight."""
    monkeypatch.setattr(simhash, "TILE", 8)
    r = np.random.default_rng(1)
    fps = []
    for c in r.integers(0, 2**64, 2, dtype=np.uint64).tolist():
        fps += [c ^ sum(1 << int(b) for b in r.choice(64, r.integers(0, 5), replace=False)) for _ in range(60)]
    fps = list(dict.fromkeys(fps + r.integers(0, 2**64, 50, dtype=np.uint64).tolist()))
    df = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(fps)], "node bigint, fp bigint")
    found = {x.node: x.component for x in components(simhash.links(df)).collect()}
    assert {i: found.get(i, i) for i in range(len(fps))} == groups(dict(enumerate(fps)))


def test_awkward_rows(spark, awkward, none):
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(awkward).collect()]
    assert len(got) == awkward.count()
    zero = [g for g in got if g[0] in (3, 4, 5)]
    assert all(f == "0" * 16 and c == 3 for _, f, c in zero)
    assert [g for g in got if g[0] is None][0][2] is None and all(c is None for d, f, c in got if d == 1)
    assert simhash.near_duplicates(none).count() == 0


def test_components(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(30, 31), (31, 30), (40, 40)], "a bigint, b bigint")
    got = {r.node: r.component for r in components(chain).collect()}
    assert got == {**{i: 0 for i in range(21)}, 30: 30, 31: 30}
    assert components(chain.limit(0)).count() == 0


def test_pieces_of_long_texts():
    texts = [b"a b c " * 500, b"", None, b"x", b"x y", b"q " + b"w e " * 300]
    assert simhash.fingerprints(texts).tolist() == [fingerprint(None if t is None else t.decode()) for t in texts]
