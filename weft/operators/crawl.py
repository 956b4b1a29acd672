"""Bounded breadth-first traversal over a table of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weft.plans.session import shared_folder


#: Bytes of a frontier's addresses up to which it is broadcast.
FRONTIER = 64 << 20


def pages_of(pages: DataFrame, frontier: DataFrame, size: int) -> DataFrame:
    """The pages of a frontier whose addresses take `size` bytes. A frontier of up to FRONTIER bytes is broadcast, so that no page moves."""
    asked = frontier.select("url")
    return pages.join(F.broadcast(asked) if size <= FRONTIER else asked.hint("shuffle_merge"), "url").select("url", "links", "indexed")


def traverse(pages: DataFrame, seeds: list[str], max_depth: int = 1, max_pages: int | None = 200, indexable: Column | None = None) -> DataFrame:
    """(url, depth, fetched, indexed) of every address that was visited.

    pages: (url string, links array<string>); links are expanded only below max_depth.
    A visited address without a page is not fetched. Addresses are visited by depth, then
    in the order in which they were found, and fetching stops at max_pages indexed pages or
    max(20 * max_pages, 4000) fetched ones; no more than 10 * max_pages + 1 addresses are
    visited. max_pages None lifts all three bounds. Seeds must be given; a level is cut
    off by checkpoint().
    """
    if not isinstance(seeds, (list, tuple)) or not seeds:
        raise ValueError("seeds must be a non-empty list")
    spark = pages.sparkSession
    shared_folder(spark)
    # parsed and dealt out by address once, not at every level
    pages = pages.withColumn("indexed", indexable if indexable is not None else F.lit(True)).repartition("url").checkpoint()
    frontier = spark.createDataFrame([(u, 0, i) for i, u in enumerate(dict.fromkeys(seeds))], "url string, depth int, ord bigint")
    docs_left = max_pages
    fetch_left = None if max_pages is None else max(20 * max_pages, 4000)
    visit_left = None if max_pages is None else 10 * max_pages + 1 - len(seeds)
    visited, levels, size = frontier.select("url"), [], sum(len(u or "") * 4 + 32 for u in seeds)
    for depth in range(max_depth + 1):
        level = frontier.join(pages_of(pages, frontier, size), "url", "left").select("url", "depth", "ord", "links", F.col("indexed").isNotNull().alias("fetched"), F.coalesce("indexed", F.lit(False)).alias("indexed"))
        if max_pages is not None:  # at most fetch_left rows are numbered
            before = Window.partitionBy(F.lit(0)).orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
            some = level.orderBy("ord").limit(10 * max_pages + 1 + len(seeds))
            some = some.withColumn("_d", F.coalesce(F.sum(F.col("indexed").cast("int")).over(before), F.lit(0))).withColumn("_f", F.coalesce(F.sum(F.col("fetched").cast("int")).over(before), F.lit(0)))
            go = (F.col("_d") < docs_left) & (F.col("_f") < fetch_left)
            level = some.withColumns({"fetched": F.col("fetched") & go, "indexed": F.col("indexed") & go}).drop("_d", "_f").checkpoint()
        levels.append(level.select("url", "depth", "fetched", "indexed"))
        if depth == max_depth:
            break
        if max_pages is not None:
            done = level.agg(F.sum(F.col("indexed").cast("int")), F.sum(F.col("fetched").cast("int"))).first()
            docs_left, fetch_left = docs_left - (done[0] or 0), fetch_left - (done[1] or 0)
        found = level.where("fetched").select("ord", F.posexplode("links").alias("pos", "url"))
        new = found.groupBy("url").agg(F.min(F.struct("ord", "pos")).alias("at")).join(visited, "url", "left_anti")
        if max_pages is not None:
            new = new.orderBy("at").limit(max(0, visit_left))
            new = new.withColumn("ord", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("at")).cast("bigint"))
        else:
            new = new.withColumn("ord", F.monotonically_increasing_id())
        frontier = new.select("url", F.lit(depth + 1).alias("depth"), "ord").checkpoint()
        count, size = frontier.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("url") + 32), F.lit(0))).first()
        if not count:
            break
        if visit_left is not None:
            visit_left -= count
        visited = visited.unionByName(frontier.select("url"))
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out


def crawl_summary(visits: DataFrame, pages: DataFrame, texts: DataFrame, terms: DataFrame, samples: int = 5, url: str = "url") -> DataFrame:
    """One row: pages_visited, pages_fetched, docs_indexed, text_chars, unique_terms, sample_docs (the first addresses indexed).

    visits: traverse(); pages: (url, ...); texts: (url, text); terms: (url, term, ...) of all pages.
    """
    done = visits.where("indexed").select("url")
    own = texts.select(F.col(url).alias("url"), "text").join(done, "url", "left_semi")
    seen = visits.agg(F.count(F.lit(1)).alias("pages_visited"), F.count_if("fetched").alias("pages_fetched"), F.count_if("indexed").alias("docs_indexed"))
    chars = own.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("text_chars"))
    words = terms.select(F.col(url).alias("url"), "term").join(done, "url", "left_semi").agg(F.count_distinct("term").alias("unique_terms"))
    some = done.orderBy("url").limit(samples).agg(F.array_sort(F.collect_list("url")).alias("sample_docs"))
    return seen.crossJoin(chars).crossJoin(words).crossJoin(some)  # one row each


def reverse_links(links: DataFrame) -> DataFrame:
    """(href, n_pages) of (page_id, href): how many pages link to it."""
    return links.distinct().groupBy("href").agg(F.count(F.lit(1)).alias("n_pages"))
