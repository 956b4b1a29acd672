"""URL filter: host/path rules indexed by their rarest literal token.

Every rule becomes one regular expression and is filed under one literal token that
any matching url must contain: of the tokens the rule guarantees, the one that the
fewest rules share. The index is a literal hash table: a url's tokens each look up one
slot, the rules filed under these tokens are the candidates, and only those run their
expression. Everything is Column expressions, so a scan needs no shuffle and no Python.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.common import cut, fresh, named, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def regex(self) -> str:
        """Over host || path; the host may be a subdomain."""
        return rf"(?s)^(?:[^/]*\.)?{re.escape(self.host)}{re.escape(self.path)}" + ("" if self.path else "(?:/|$)")

    def tokens(self) -> set[str]:
        """Literal tokens that stand complete in every url that fits: a path may go on after its last letter."""
        out = set(re.findall(r"[A-Za-z0-9]+", self.host))
        out.update(re.findall(r"[A-Za-z0-9]+(?=[^A-Za-z0-9])", self.path))
        return out


#: The rule table of the query.
RULES = [
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
]


def index_rules(rules: list[Rule]) -> dict[str | None, list[Rule]]:
    """token -> rules; a rule without a guaranteed token is under None and always runs."""
    shared = Counter(t for r in rules for t in r.tokens())
    index: dict[str | None, list[Rule]] = {}
    for r in rules:
        token = min(r.tokens(), key=lambda t: (shared[t], -len(t), t), default=None)
        index.setdefault(token, []).append(r)
    return index


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def _tokens(place: Column) -> Column:
    return F.array_distinct(F.split(place, r"[^A-Za-z0-9]+"))


_RULE = "struct<token:string,regex:string,n:int,h:int,rule:string,verdict:string>"


def _literal(rows: list[tuple]) -> Column:
    """An array of rules as one literal."""
    made = [F.struct(*[F.lit(v).alias(n) for n, v in zip(("token", "regex", "n", "h", "rule", "verdict"), r, strict=True)]) for r in rows]
    return (F.array(*made) if made else F.array()).cast(f"array<{_RULE}>")


def _candidates(tokens: Column, rules: list[Rule]) -> Column:
    """The rules filed under one of the tokens, and those filed under none."""
    index = index_rules(rules)
    rows = {t: [(t, r.regex, len(r.name), len(r.host), r.name, r.verdict) for r in own] for t, own in index.items()}
    slots = 1 << max(4, (2 * len(index)).bit_length())
    table_: list[list[tuple]] = [[] for _ in range(slots)]
    for t, own in rows.items():
        if t is not None:
            table_[zlib.crc32(t.encode()) % slots] += own
    held = F.array(*[_literal(x) for x in table_])

    def under(t: Column) -> Column:
        slot = (F.crc32(t.cast("binary")) % slots).cast("int")
        return F.filter(F.get(held, slot), lambda r: r["token"] == t)

    found = F.flatten(F.transform(tokens, under))
    return F.concat(found, _literal(rows[None])) if None in rows else found


def filter_urls(df: DataFrame, rules: list[Rule], url: str = "url", default: str = "allow") -> DataFrame:
    """df with host, path, rule and verdict.

    The longest rule (host and path together) wins, of equally long ones that with the
    longer host. Where no rule fits, rule is null and the verdict is `default`. A null
    url, or one without ``://``, has an empty host and path and fits no rule. Rules
    must not repeat a (host, path). However many they are, a url looks up one slot a token.

    Very long urls are read whole; repeated rows are returned each; an empty table gives no
    rows. Columns of df named host, path, rule or verdict are replaced.
    """
    taken = [c for c in df.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    best, own = fresh("_best", df.columns), named(url)
    base = df.select(*[named(c) for c in taken], host_of(own).alias("host"), path_of(own).alias("path"))
    place = F.concat("host", "path")
    fits = F.filter(_candidates(_tokens(place), rules), lambda r: F.rlike(place, r["regex"]))
    longest = F.array_max(F.transform(fits, lambda r: F.struct(r["n"].alias("n"), r["h"].alias("h"), r["rule"].alias("rule"), r["verdict"].alias("verdict"))))
    return base.withColumn(best, longest).withColumns({"rule": F.col(f"{best}.rule"), "verdict": F.coalesce(F.col(f"{best}.verdict"), F.lit(default))}).drop(best)


#: Bytes of filed rules up to which they are broadcast.
FILED = 64 << 20
_ALWAYS = ""


def file_rules(rules: DataFrame) -> DataFrame:
    """(token, rule, verdict, regex, n, h) of a table of rules (verdict, host, path): each once, under the guaranteed token that the fewest rules share, or under "" if it has none."""
    r = rules.select("verdict", F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path")).groupBy("host", "path").agg(F.min("verdict").alias("verdict"))
    own = F.array_distinct(F.concat(F.regexp_extract_all("host", F.lit("([A-Za-z0-9]+)"), 1), F.regexp_extract_all("path", F.lit("([A-Za-z0-9]+)(?=[^A-Za-z0-9])"), 1)))
    each = r.select("host", "path", "verdict", F.explode_outer(own).alias("token"))
    shared = each.groupBy("token").agg(F.count(F.lit(1)).alias("shared"))
    least = F.min(F.when(F.col("token").isNotNull(), F.struct("shared", (-F.length("token")).alias("short"), "token")))
    filed = each.join(shared, each["token"].eqNullSafe(shared["token"])).drop(shared["token"]).groupBy("host", "path", "verdict").agg(least["token"].alias("token"))
    name = F.concat("host", "path")
    regex = F.concat(F.lit(r"(?s)^(?:[^/]*\.)?\Q"), F.replace(name, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"), F.when(F.col("path") == "", F.lit("(?:/|$)")).otherwise(F.lit("")))
    return filed.select(F.coalesce("token", F.lit(_ALWAYS)).alias("token"), name.alias("rule"), "verdict", regex.alias("regex"), F.length(name).alias("n"), F.length("host").alias("h"))


def filter_urls_by_table(df: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """filter_urls() with the rules as a table (verdict, host, path) of any size: the plan doesn't grow with them.

    Each url's tokens are joined with the tokens under which rules are filed; rules of up to FILED bytes are broadcast,
    more are joined by token. Only the rules met run their expression. Of rules that repeat a (host, path)
    the smallest verdict holds; null hosts and paths are empty.
    """
    taken = [c for c in df.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    row, best, own = fresh("_row", df.columns), fresh("_best", df.columns), named(url)
    base = df.select(*[named(c) for c in taken], host_of(own).alias("host"), path_of(own).alias("path")).withColumn(row, F.monotonically_increasing_id())
    filed = cut(file_rules(rules))
    size = filed.agg(F.coalesce(F.sum(F.octet_length("rule") * 2 + F.octet_length("token") + 64), F.lit(0))).first()[0]
    place = F.concat("host", "path")
    met = base.select(row, place.alias("place"), F.explode(F.array_union(_tokens(place), F.array(F.lit(_ALWAYS)))).alias("token"))
    met = met.join(F.broadcast(filed) if size <= FILED else filed.hint("merge"), "token").where(F.rlike("place", F.col("regex")))
    found = met.groupBy(row).agg(F.max(F.struct("n", "h", "rule", "verdict")).alias(best))
    out = base.join(found, row, "left").drop(row)
    return out.withColumns({"rule": F.col(f"{best}.rule"), "verdict": F.coalesce(F.col(f"{best}.verdict"), F.lit(default))}).drop(best)


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), RULES).select("page_id", "host", "path", "rule", "verdict")


def _sql() -> str:
    rule = ", ".join(f"('{r.name}', '{r.host}', '{r.path}', '{r.verdict}', {len(r.name)})" for r in RULES)
    return f"""
WITH parts AS (
  SELECT page_id, url,
    coalesce(translate(regexp_extract(url, '{_PARTS}', 1), '{UPPER}', '{LOWER}'), '') AS host,
    coalesce(regexp_extract(url, '{_PARTS}', 2), '') AS path FROM pages),
rules(rule, rhost, rpath, verdict, n) AS (VALUES {rule}),
fits AS (
  SELECT p.rowid_, max_by(rule, n) AS rule, max_by(verdict, n) AS verdict
  FROM (SELECT *, row_number() OVER () AS rowid_ FROM parts) p, rules
  WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY 1)
SELECT page_id, host, path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM (SELECT *, row_number() OVER () AS rowid_ FROM parts) p LEFT JOIN fits f USING (rowid_)"""


SQL = _sql()
