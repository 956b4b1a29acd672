import glob
import os

import pytest

from weft.functions.hashing import node_id
from weft.operators.stored import Table
from weft.plans import inspect

NIDS = [node_id("127.0.0.1", 9000 + i) for i in range(4)]
ROWS = "gid string, key string, value string, seq bigint"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def files(table):
    """Data files by directory."""
    out = {}
    for f in glob.glob(f"{table.path}/rows/nid=*/bucket=*/*.parquet"):
        out.setdefault(os.path.dirname(f), set()).add(f)
    return out


@pytest.fixture
def table(spark, tmp_path):
    return Table.create(spark, str(tmp_path / "t"), "value string, seq bigint", NIDS[:3], buckets=4)


def log(spark, *made):
    return spark.createDataFrame(list(made), ROWS)


def test_put_get_delete(spark, table):
    assert rows(table.rows()) == []
    table.put(log(spark, ("g", "a", "1", 1), ("g", "a", "2", 2), ("g", "b", "x", 1), ("h", "a", "9", 1), (None, None, "v", 1)))
    assert [r[:3] for r in rows(table.rows().where("gid <> 'local'"))] == [("g", "a", "2"), ("g", "b", "x"), ("h", "a", "9")]
    assert table.rows().where("gid = 'local'").first().value == "v"
    table.put(log(spark, ("g", "a", "3", 0)))  # a later put overwrites, whatever its seq
    again = Table.open(spark, table.path)
    assert again == table and again.get("a", "g").first().value == "3" and again.get("a", "h").first().value == "9"
    assert rows(again.get(None, "g")) == [("a",), ("b",)]
    with pytest.raises(KeyError):
        again.get("zz", "g")
    assert rows(again.delete_key("a", "g")) == [("g", "a", "3", 0)]
    with pytest.raises(KeyError):
        again.delete_key("a", "g")
    again.delete(spark.createDataFrame([("g", "b"), ("h", "a"), ("no", "no")], "gid string, key string"))
    assert [r[0] for r in rows(again.rows())] == ["local"]
    assert again.put(log(spark).limit(0)) == [] and again.delete(spark.createDataFrame([], "gid string, key string")) == []


def test_only_touched_buckets_are_rewritten(spark, table):
    table.put(log(spark, *[("g", f"k{i}", str(i), 1) for i in range(60)]))
    before = files(table)
    (nid, bucket), = table.put(log(spark, ("g", "k7", "new", 1)))
    after = files(table)
    place = f"{table.path}/rows/nid={nid}/bucket={bucket}"
    assert {d for d in before if before[d] != after[d]} == {place} and set(before) == set(after) and len(before) > 6
    found = table.get("k7", "g")
    assert found.first().value == "new" and any("nid" in p and "bucket" in p for p in inspect.partition_filters(found))


def test_append(spark, tmp_path):
    held = Table.create(spark, str(tmp_path / "t"), "values array<string>", NIDS, "rendezvous", buckets=2)
    writes = lambda *made: spark.createDataFrame(list(made), "gid string, key string, values array<string>, seq bigint")
    held.append(writes(("g", "a", ["2"], 2), ("g", "a", ["1"], 1)))
    held.append(writes(("g", "a", ["3", "4"], 0), ("g", "b", [], 0), ("h", "a", ["x"], 0)))
    assert {(r.gid, r.key): list(r["values"]) for r in held.rows().collect()} == {("g", "a"): ["1", "2", "3", "4"], ("g", "b"): [], ("h", "a"): ["x"]}


@pytest.mark.parametrize("hasher,old,new", [("naive", 3, 4), ("naive", 3, 3), ("consistent", 3, 4), ("consistent", 4, 3), ("rendezvous", 4, 3)])
def test_reconf_moves_keys_to_their_nodes(spark, tmp_path, hasher, old, new):
    made = [("g", f"k{i}", str(i), 1) for i in range(40)]
    held = Table.create(spark, str(tmp_path / "t"), "value string, seq bigint", NIDS[:old], hasher, buckets=4)
    held.put(log(spark, *made))
    before = files(held)
    was = {r.key: (r.nid, r.bucket) for r in held.placed_rows().collect()}
    there, places = held.reconf(NIDS[:new])
    now = {r.key: (r.nid, r.bucket) for r in there.placed_rows().collect()}
    direct = Table.create(spark, str(tmp_path / "d"), "value string, seq bigint", NIDS[:new], hasher, buckets=4)
    direct.put(log(spark, *made))
    assert now == {r.key: (r.nid, r.bucket) for r in direct.placed_rows().collect()} and rows(there.rows()) == made_sorted(made)
    moved = {k for k in was if was[k] != now[k]}
    assert set(places) == {p for k in moved for p in (was[k], now[k])}
    after = files(there)
    rewritten = {f"{there.path}/rows/nid={n}/bucket={b}" for n, b in places}
    assert all(after[d] == before[d] for d in before if d not in rewritten) and (old != new or not places)
    assert Table.open(spark, there.path).nids == tuple(NIDS[:new]) and there.get("k3", "g").first().value == "3"


def made_sorted(made):
    return sorted(made)
