"""Sharding by jump consistent hashing, as Column expressions.

The key's bucket under n shards and under n + 1 differ only where the row moves to the
new shard, so appending a shard moves 1/(n + 1) of the rows and no others. No ring or
table is kept. (Lamping and Veach, "A Fast, Minimal Memory, Consistent Hash Algorithm".)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft.llm.common import cut, table

#: Multiplier of the generator: high and low 32 bits.
_MH, _ML = 2862933555777941757 >> 32, 2862933555777941757 & 0xFFFFFFFF
#: Slots are numbered in blocks of about this many rows.
SLOT_BLOCK = 50_000
#: Blocks of a shard at least, so that small tables spread too.
LEAST_BLOCKS = 128


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def _low16(c: Column) -> Column:
    return c.bitwiseAND(F.lit(0xFFFF))


def _times_mod32(x: Column, m: int) -> Column:
    """x * m, of which the low 32 bits are right, in under 50 bits."""
    return _low16(x) * F.lit(m) + F.shiftleft(_low16(F.shiftright(x, 16) * F.lit(m)), 16)


def _advance(hi: Column, lo: Column, then) -> Column:
    """The next state of the 64-bit generator, held as two unsigned halves so that no product leaves 63 bits."""
    t0 = _low16(lo) * F.lit(_ML) + F.lit(1)
    return _let(
        t0,
        lambda a: _let(
            F.shiftright(lo, 16) * F.lit(_ML) + F.shiftright(a, 16),
            lambda b: then(
                (F.shiftright(b, 16) + _times_mod32(hi, _ML) + _times_mod32(lo, _MH)).bitwiseAND(F.lit(0xFFFFFFFF)),
                F.shiftleft(_low16(b), 16).bitwiseOR(_low16(a)),
            ),
        ),
    )


def _jump(s: Column, shards: int) -> Column:
    def then(hi: Column, lo: Column) -> Column:
        return _let(
            F.struct(hi.alias("hi"), lo.alias("lo")),
            lambda n: F.struct(
                n["hi"].alias("hi"),
                n["lo"].alias("lo"),
                s["j"].alias("b"),
                F.floor((s["j"] + 1) * (F.lit(2147483648.0) / (F.shiftright(n["hi"], 1) + 1))).cast("bigint").alias("j"),
            ),
        )

    return F.when(s["j"] >= shards, s).otherwise(_advance(s["hi"], s["lo"], then))


def jump_hash(key: Column, shards: int) -> Column:
    """Shard 0 .. shards - 1 of a bigint key; null counts as key 0.

    Each jump raises j, so `shards` jumps always suffice. A short fold finishes nearly
    all keys, and the full one runs only for keys that it left unfinished.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    k = F.coalesce(key.cast("bigint"), F.lit(0).cast("bigint"))
    start = F.struct(F.shiftrightunsigned(k, 32).alias("hi"), k.bitwiseAND(F.lit(0xFFFFFFFF)).alias("lo"), F.lit(-1).cast("bigint").alias("b"), F.lit(0).cast("bigint").alias("j"))

    def fold(s: Column, steps: int) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), s, lambda acc, _: _jump(acc, shards))

    few = min(shards, 32)
    out = fold(start, few)
    if few < shards:
        out = _let(out, lambda s: F.when(s["j"] < shards, fold(s, shards)).otherwise(s))
    return out["b"].cast("int")


def assign_shards(df: DataFrame, key: str = "doc_id", text: str = "text", shards: int = 8) -> DataFrame:
    """One row per row of df: key, size, text_crc32, law, shard, slot, grown_shard.

    size: UTF-8 bytes of the text plus 1 (a null text has none). text_crc32: of the UTF-8
    bytes (a null text counts as empty). The law is 'key': the key and the number of
    shards decide. grown_shard is the shard with one more shard. slot numbers the rows of
    a shard from 0 without gaps: by block, then key, size and checksum; repeated rows get
    neighbouring slots. A null key counts as key 0. An empty table gives no rows. Other
    columns of df are ignored.

    No task holds a shard: rows fall into blocks by a hash of their key and position, each
    block is numbered by itself, and the blocks' row counts, summed in block order, give
    where each begins. A key that a third of the rows share spreads over all blocks of its shard.
    """
    body = F.coalesce(F.col(f"`{text}`").cast("binary"), F.lit(b""))
    slim = df.select(
        F.col(f"`{key}`").cast("bigint").alias("_key"),
        (F.length(body).cast("bigint") + 1).alias("size"),
        F.crc32(body).alias("text_crc32"),
        F.monotonically_increasing_id().alias("_at"),
    )
    # written once: the blocks of a row must be the same in both uses
    slim = cut(slim.select("*", jump_hash(F.col("_key"), shards).alias("shard"), jump_hash(F.col("_key"), shards + 1).alias("grown_shard")))
    blocks = max(LEAST_BLOCKS, -(-slim.count() // (shards * SLOT_BLOCK)))
    rows = slim.withColumn("_block", F.pmod(F.xxhash64("_key", "_at"), F.lit(blocks)).cast("int"))
    # a count per (shard, block): a few hundred rows a shard for each SLOT_BLOCK * LEAST_BLOCKS rows of it
    counts = rows.groupBy("shard", "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    begins = counts.select("shard", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_begin"))
    within = Window.partitionBy("shard", "_block").orderBy("_key", "size", "text_crc32", "_at")
    numbered = rows.withColumn("_within", F.row_number().over(within) - 1)
    return numbered.join(begins, ["shard", "_block"]).select(
        F.col("_key").alias(key), "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("_begin") + F.col("_within")).cast("bigint").alias("slot"), "grown_shard"
    )


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents").select("doc_id", "text"))
