"""SimHash near-duplicates with pivot distance tables.

Equal fingerprints are one node. Nodes meet in a bucket if all but three of a
fingerprint's bit blocks agree, which any two within three bits do for some choice of
blocks. Within a bucket each node has a row of a distance table: its Hamming distances
to fixed reference fingerprints. By the triangle inequality a pair whose rows differ by
more than three in any coordinate is discarded; the nodes are sorted by the first
coordinate, so most pairs are never formed. Survivors are compared bit by bit. A bucket
beyond TILE nodes is dealt out in pairs of sub-blocks. Each task returns a spanning
forest of its links, not the links.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.common import LONG_MIN, cut, in_arrow, table
from weft.llm.components import components

BITS = 3
PIVOTS = 24
#: Nodes of a bucket that are compared in one task; larger ones are split.
TILE = 4096
#: Texts that are hashed together.
SLICE = 512
_LANES = np.uint64(0x0101010101010101)


def fingerprints(texts: list[bytes | None], shingle: int = 3) -> np.ndarray:
    """SimHash of each text: a bit is set if it is in over half the shingles' XXH64 (seed 42)."""
    hashes, counts = [], []
    for t in texts:
        own = shingles(t, shingle)
        hashes.extend(own)
        counts.append(len(own))
    return majority(np.array(hashes, dtype=np.uint64), np.array(counts, dtype=np.int64))


def shingles(text: bytes | None, shingle: int) -> list[int]:
    """XXH64 (seed 42) of each run of `shingle` words; of all words if there are fewer, none without words."""
    words, one = (text or b"").lower().split(), xxhash.xxh64_intdigest
    n = len(words)
    if n <= shingle:
        return [one(b" ".join(words), 42)] if n else []
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    begins = (ends[:-shingle] + 1).tolist()
    return [one(joined[a:b], 42) for a, b in zip([0, *begins], ends[shingle - 1 :].tolist(), strict=True)]


def majority(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For each run of n hashes of h the bits that over half of them have."""
    out = np.zeros(len(n), np.uint64)
    if not len(h):
        return out
    # bytes of a word count eight bits at a time; a run of 255 cannot overflow them
    full = np.flatnonzero(n)
    runs = -(-n[full] // 255)
    first = np.concatenate(([0], np.cumsum(n[full])))[:-1]
    at = np.repeat(first, runs) + 255 * (np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs))
    heads = np.cumsum(runs) - runs
    for j in range(8):
        lanes = np.add.reduceat((h >> np.uint64(j)) & _LANES, at).view(np.uint8).reshape(-1, 8)
        ones = np.add.reduceat(lanes.astype(np.int64), heads, axis=0)
        for byte in range(8):
            out[full] |= (2 * ones[:, byte] > n[full]).astype(np.uint64) << np.uint64(8 * byte + j)
    return out


def _hash_batches(shingle: int):
    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, SLICE):  # few shingles at a time
                part = b.slice(at, SLICE)
                texts = part.column(1).cast(pa.binary()).to_pylist()
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fingerprints(texts, shingle).view(np.int64))], names=["id", "fp"])

    return run


def masks(nodes: int) -> list[int]:
    """Bit masks of all choices of agreeing blocks; so many blocks that chance hardly fills a bucket twice."""
    blocks = next((b for b in range(5, 10) if nodes >> (64 * (b - BITS) // b) == 0), 10)
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    own = [((1 << cuts[i + 1]) - 1) ^ ((1 << cuts[i]) - 1) for i in range(blocks)]
    return [sum(c) for c in combinations(own, blocks - BITS)]


def pivots(count: int = PIVOTS) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(b"pivot %d" % i, 42) for i in range(count)], dtype=np.uint64)


class Forest:
    """Union of nodes 0 .. n - 1, many links at a time; the root is the smallest."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self, x: np.ndarray) -> np.ndarray:
        while True:
            y = self.up[x]
            if np.array_equal(x, y):
                return x
            x = y

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.roots(a), self.roots(b)
            keep = a != b
            a, b = a[keep], b[keep]
            np.minimum.at(self.up, np.maximum(a, b), np.minimum(a, b))


def near_pairs(group: np.ndarray, part: np.ndarray, fps: np.ndarray, mixed: np.ndarray, refs: np.ndarray, bits: int = BITS):
    """Index pairs of one group within `bits` bits; in a mixed group only pairs of different parts.

    Pairs are tried at growing distance in the order of the first pivot coordinate; a node drops out once
    that coordinate alone is too far. Yields arrays (i, j).
    """
    table_ = np.bitwise_count(fps[:, None] ^ refs[None, :]).astype(np.int8)
    order = np.lexsort((table_[:, 0], group))
    group, part, fps, mixed, table_ = group[order], part[order], fps[order], mixed[order], table_[order]
    i, step = np.arange(len(order)), 1
    while len(i):
        i = i[i + step < len(order)]
        j = i + step
        near = (group[i] == group[j]) & (table_[j, 0] - table_[i, 0] <= bits)
        i, j = i[near], j[near]
        a, b = i, j
        for p in range(1, table_.shape[1]):
            keep = np.abs(table_[a, p] - table_[b, p]) <= bits
            a, b = a[keep], b[keep]
            if not len(a):
                break
        keep = (np.bitwise_count(fps[a] ^ fps[b]) <= bits) & ~(mixed[a] & (part[a] == part[b]))
        if keep.any():
            yield order[a[keep]], order[b[keep]]
        step += 1


_KEYS = ("t", "bits", "lo", "hi")
#: Rows of buckets that a task holds at a time.
HELD = 1 << 18


def _link(batches):
    """A spanning forest of some buckets at a time; the rows come in the order of these."""
    held, count = [], 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        count += b.num_rows
        if count >= HELD:
            last = np.ones(b.num_rows, bool)
            for c in _KEYS:
                own = np.asarray(b.column(c))
                last &= own == own[-1]
            if not last.all():  # the last bucket may go on
                at = int(np.flatnonzero(~last)[-1]) + 1
                held[-1] = b.slice(0, at)
                yield from _linked(pa.Table.from_batches(held))
                held, count = [b.slice(at)], b.num_rows - at
    if held:
        yield from _linked(pa.Table.from_batches(held))


def _linked(got: pa.Table):
    col = {c: np.asarray(got.column(c).combine_chunks()) for c in got.column_names}
    keys = [col[c] for c in reversed(_KEYS)]
    order = np.lexsort(keys)
    head = np.zeros(len(order), bool)
    for k in keys:
        head[1:] |= k[order[1:]] != k[order[:-1]]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(head)
    use = np.flatnonzero(np.bincount(group)[group] > 1)
    nodes, at = np.unique(col["node"][use], return_inverse=True)
    forest = Forest(len(nodes))
    for i, j in near_pairs(group[use], col["part"][use], col["fp"][use].view(np.uint64), (col["lo"] != col["hi"])[use], pivots()):
        forest.link(at[i], at[j])
    roots = forest.roots(np.arange(len(nodes)))
    moved = np.flatnonzero(roots != np.arange(len(nodes)))
    for k in range(0, len(moved), 50_000):
        m = moved[k : k + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(nodes[m]), pa.array(nodes[roots[m]])], names=["a", "b"])


def links(nodes: DataFrame) -> DataFrame:
    """a, b: a spanning forest, by task, of the links between nodes (node bigint, fp bigint) within BITS bits."""
    chosen = masks(nodes.count())
    signed = [m - (1 << 64) if m >> 63 else m for m in chosen]
    keyed = nodes.select("node", "fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m).cast("bigint")) for m in signed])).alias("t", "bits"))
    counts = keyed.groupBy("t", "bits").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    held = keyed.join(counts, ["t", "bits"]).withColumn("g", F.ceil(F.col("n") / TILE).cast("int"))
    held = held.withColumn("part", F.pmod(F.xxhash64("fp"), F.col("g")).cast("int"))
    tiles = held.select("node", "fp", "t", "bits", "part", F.explode(F.sequence(F.lit(0), F.col("g") - 1)).alias("other"))
    tiles = tiles.select("node", "fp", "t", "bits", "part", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"))
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return in_arrow(tiles.repartition(n, *_KEYS).sortWithinPartitions(*_KEYS), _link, "a bigint, b bigint")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """One row per row of df: id, fingerprint (16 hex digits), component_id.

    Fingerprints link at BITS or fewer differing bits; component_id is the smallest id
    reachable. A null, empty or wordless text has fingerprint zero and links like any
    other. Equal texts, a third of all rows perhaps, are one node. A null id sorts
    first, as the least bigint, which is returned as null too. Repeated rows are returned each. An empty table gives no
    rows; other columns are ignored.
    """
    rows = df.select(F.coalesce(F.col(f"`{id_col}`").cast("bigint"), F.lit(LONG_MIN)).alias("id"), F.col(f"`{text_col}`").alias("text"))
    docs = cut(in_arrow(rows, _hash_batches(shingle), "id bigint, fp bigint"))
    nodes = docs.groupBy("fp").agg(F.min("id").alias("node"))
    found = components(links(nodes))
    label = nodes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component"))
    back = lambda c: F.when(F.col(c) != LONG_MIN, F.col(c))
    return docs.join(label, "fp").select(back("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), back("component").alias("component_id"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
