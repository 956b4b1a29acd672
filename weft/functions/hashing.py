"""Content addresses and placement functions as Column expressions."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column
from pyspark.sql import functions as F


def content_id(value: Column) -> Column:
    """SHA-256 of the value's JSON text."""
    return F.sha2(_unwrap(F.to_json(F.struct(value.alias("v")))), 256)


def _unwrap(j: Column) -> Column:
    """{"v":x} -> x; a null field is left out."""
    return F.when(F.length(j) > 2, F.substring(j, F.lit(6), F.length(j) - 6)).otherwise(F.lit("null"))


def content_id_of(value) -> str:
    return hashlib.sha256(json.dumps(value, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def node_id(ip: str, port: int) -> str:
    return content_id_of({"ip": ip, "port": port})


def short_id(nid: str) -> str:
    return nid[:5]


def modulo(hex_id: Column, n: int) -> Column:
    """A hexadecimal number of up to 64 digits modulo n < 2**31."""
    full = F.lpad(hex_id, 64, "0")
    words = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.conv(F.substring(full, i * 8 + 1, F.lit(8)), 16, 10).cast("bigint"))
    return F.aggregate(words, F.lit(0).cast("bigint"), lambda a, x: (a * F.lit(4294967296) + x) % F.lit(n))


def naive_hash(kid: Column, nids: list[str]) -> Column:
    """The node at place kid mod n of the sorted list."""
    ordered = sorted(nids)
    return F.element_at(F.array(*[F.lit(n) for n in ordered]), (modulo(kid, len(ordered)) + 1).cast("int"))


def consistent_hash(kid: Column, nids: list[str]) -> Column:
    """The first node above kid on the ring, else the smallest. Ids are compared as numbers, whatever their lengths."""
    wide = sorted((n.rjust(64, "0"), n) for n in nids)
    full, out = F.lpad(kid, 64, "0"), F.lit(wide[0][1])
    for padded, nid in reversed(wide):
        out = F.when(full < padded, F.lit(nid)).otherwise(out)
    return out


def rendezvous_hash(kid: Column, nids: list[str]) -> Column:
    """The node with the highest id of kid || nid."""
    scored = [F.struct(F.sha2(F.concat(F.lit('"'), kid, F.lit(n), F.lit('"')), 256).alias("score"), F.lit(n).alias("nid")) for n in sorted(nids)]
    return F.array_max(F.array(*scored))["nid"]


HASHERS = {"naive": naive_hash, "consistent": consistent_hash, "rendezvous": rendezvous_hash}
