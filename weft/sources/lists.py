"""Small driver-side inputs: word lists, node lists, seed lists."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_words(spark: SparkSession, path: str, most: int = 100_000) -> list[str]:
    """Words of a text file, one a line, trimmed, blanks left out. A dictionary beyond `most` words is refused: it is used as a literal."""
    rows = spark.read.text(path).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"over {most} words")
    return list(dict.fromkeys(w for w in (r.value.strip() for r in rows) if w))


def word_table(spark: SparkSession, path: str) -> DataFrame:
    """(word) of a dictionary file of any size, for weft.operators.index.build_index: trimmed, without blanks and repeats."""
    return spark.read.text(path).select(F.trim("value").alias("word")).where("word <> ''").distinct()


def parse_nodes(text: str) -> list[dict]:
    """`ip:port,ip:port` -> nodes; an entry without an ip or with a port that is none is an error."""
    out = []
    for entry in filter(None, (e.strip() for e in text.split(","))):
        ip, _, port = entry.rpartition(":")
        if not ip or not port.isdigit() or not 0 < int(port) < 65536:
            raise ValueError(f"not a node: {entry}")
        out.append({"ip": ip, "port": int(port)})
    if not out:
        raise ValueError("no nodes")
    return out


def read_nodes(spark: SparkSession, path: str) -> list[dict]:
    """A JSON array of {ip, port}."""
    found = json.loads(spark.read.text(path, wholetext=True).first().value)
    if not isinstance(found, list) or not found:
        raise ValueError("nodes must be a non-empty array")
    for n in found:
        if not isinstance(n, dict) or not n.get("ip") or not isinstance(n.get("port"), int):
            raise ValueError(f"not a node: {n}")
    return [{"ip": n["ip"], "port": n["port"]} for n in found]


def seeds(spark: SparkSession, urls) -> DataFrame:
    if not isinstance(urls, (list, tuple)) or not urls:
        raise ValueError("urls must be a non-empty list")
    return spark.createDataFrame([(u,) for u in urls], "url string")
