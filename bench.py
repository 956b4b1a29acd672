"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line with seconds a query."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from weft import catalog
from weft.plans.session import local_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = (
    "mr_max_per_key mr_char_freq mr_word_count mr_grep mr_avg_word_len html_to_text link_extract reverse_link_graph bfs_levels kv_put_last_wins kv_append hash_naive hash_rendezvous "
    "reconf_moved content_id stats_summary mr_generic search_single search_phrase search_multi ngram_counts search_workload mr_tfidf"
).split()


def laid_out(spark, files: int) -> str:
    """A folder with the tables of SF_DIR, documents as `files` files, as a corpus lies: the given file is one row group, which a single task would read."""
    folder = tempfile.mkdtemp(prefix="weft-tables-")
    for name in os.listdir(SF_DIR):
        if name != "documents.parquet":
            os.symlink(os.path.join(SF_DIR, name), os.path.join(folder, name))
    spark.read.parquet(f"{SF_DIR}/documents.parquet").repartition(files).write.parquet(f"{folder}/documents.parquet")
    return folder


def main() -> None:
    spark = local_session(CPUS, partitions=max(8, int(CPUS) * 2), name="bench")
    spark.sparkContext.setLogLevel("ERROR")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="weft-bench-"))
    tables = laid_out(spark, 2 * int(CPUS))
    catalog.QUERIES["mr_max_per_key"](spark, tables).write.format("noop").mode("overwrite").save()  # starts the session's workers
    took: dict[str, float] = {}
    for name in HEADLINE:
        began = time.perf_counter()
        catalog.QUERIES[name](spark, tables).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
        print(name, took[name], file=sys.stderr, flush=True)
    # searches of a written index: what a served query costs
    path = tempfile.mkdtemp(prefix="weft-index-")
    from weft.operators import index, search

    began = time.perf_counter()
    index.write_index(catalog.documents_index(spark, tables), path, shards=16)
    took["index_write"] = round(time.perf_counter() - began, 3)
    wanted = search.search_terms(catalog.MULTI)
    began = time.perf_counter()
    search.rank(index.read_index(spark, path, wanted), 20).collect()
    took["search_written_index"] = round(time.perf_counter() - began, 3)
    # the same search over posting blocks, of an index opened once: the middle of five
    from weft.operators import served

    path = tempfile.mkdtemp(prefix="weft-served-")
    began = time.perf_counter()
    served.write_served(catalog.documents(spark, tables), path, shards=16)
    setup = {"served_write": round(time.perf_counter() - began, 3)}
    opened, each = served.open_served(spark, path), []
    for _ in range(5):
        began = time.perf_counter()
        served.find(opened, catalog.MULTI, limit=20).rows.collect()
        each.append(time.perf_counter() - began)
    took["search_served"] = round(sorted(each)[2], 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(SF_DIR.rstrip("/")), "setup": setup, "layout": f"documents in {2 * int(CPUS)} files"}))
    spark.stop()


if __name__ == "__main__":
    main()
