"""Time the headline jobs and print one JSON line.

Environment: ``BENCH_SF_DIR`` (tables), ``BENCH_CPUS`` (local threads). Every
job runs once on the smallest tables first, so that the times are those of a
warm session; each then counts as the median of its runs.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loresift.functions import text as text_functions
from loresift.operators import clauses
from loresift.operators.batch import batch_search
from loresift.operators.search import search
from loresift.operators.transcripts import extract_documents
from loresift.plans.scan import DocumentScan
from loresift.plans.store import StoredIndex
from loresift.registry import fixtures
from loresift.registry.queries import QUERIES
from loresift.schema import CODE, TRANSCRIPTS
from loresift.session import new_session, scratch_path

DEFAULT_DIR = "/root/testdata/sf0.1"
WARM_DIR = "/root/testdata/sf0.001"


def drain(frame: DataFrame) -> None:
    frame.write.format("noop").mode("overwrite").save()


def jobs(spark: SparkSession, folder: str) -> dict:
    """Name to (job, number of timed runs). The index jobs come before their searches."""
    indexes: dict[str, StoredIndex] = {}

    def build(corpus, documents):
        def run():
            indexes[corpus.name] = StoredIndex.create(documents(spark, folder), corpus, scratch_path(spark, "bench"))

        return run

    def stored(corpus, query, match=clauses.ANY, **options):
        return lambda: search(indexes[corpus.name], query(), match, **options).collect()

    def words(text):
        return lambda: clauses.words(spark, text)

    def many(corpus, **columns):
        asked = fixtures.query_table(spark, folder).withColumns(columns)
        return lambda: drain(batch_search(indexes[corpus.name], asked))

    def replaced(pattern):
        """Replace the files whose path is like ``pattern`` in the index that is there."""
        mine = fixtures.transcripts(spark, folder).filter(F.col("file_path").like(pattern))
        revised = mine.withColumn("text", F.concat("text", F.lit(" revised")))
        return lambda: indexes[TRANSCRIPTS.name].replace_files(revised, mine.select("file_path"))

    def boolean():
        return clauses.boolean(spark, [("any", ["the", "of the"]), ("any", ["aning", "als"])])

    scan = DocumentScan(CODE, fixtures.code(spark, folder))
    documents = fixtures.table(spark, folder, "documents")
    return {
        "transcript_extract": (lambda: drain(extract_documents(fixtures.transcript_lines(spark, folder))), 3),
        "identifier_expand": (
            lambda: drain(documents.select(text_functions.expand_identifiers(documents.text))),
            3,
        ),
        "postings": (lambda: drain(scan.postings()), 3),
        "index_build_transcripts": (build(TRANSCRIPTS, fixtures.transcripts), 3),
        "index_build_code": (build(CODE, fixtures.code), 2),
        "search_any": (stored(TRANSCRIPTS, words("the aning als")), 5),
        "search_rare": (stored(TRANSCRIPTS, words("aning")), 5),
        "search_phrase": (stored(TRANSCRIPTS, lambda: clauses.phrase(spark, "of the")), 5),
        "search_bool": (stored(TRANSCRIPTS, boolean), 5),
        "search_since": (stored(TRANSCRIPTS, words("the aning"), since="20d", now=fixtures.NOW), 5),
        "search_code": (stored(CODE, words("that estion ndat")), 5),
        "search_repo": (stored(CODE, words("that estion"), equals={"repo": "src3", "language": "en"}), 5),
        "scan_search_code": (lambda: search(scan, "that estion ndat").collect(), 3),
        "batch_search_transcripts": (many(TRANSCRIPTS), 3),
        "batch_search_repo": (many(CODE, repo=F.concat(F.lit("src"), F.col("query_id") % 20)), 3),
        "batch_search_all_repos": (many(CODE), 3),
        "ignore_filter": (lambda: drain(QUERIES["ignore_filter"](spark, folder)), 3),
        "stream_debounce": (lambda: drain(QUERIES["stream_debounce"](spark, folder)), 1),
        # these change the index that the searches above have read
        "replace_file": (replaced("%p1/1.jsonl"), 3),
        "replace_many_files": (replaced("%1.jsonl"), 1),
        "search_after_replacing": (stored(TRANSCRIPTS, words("the aning als")), 5),
        "merge_parts": (lambda: indexes[TRANSCRIPTS.name].compact(everything=True), 1),
    }


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", DEFAULT_DIR)
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = new_session(
        "loresift-bench",
        f"local[{cpus}]",
        **{
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "12g",
            "spark.sql.shuffle.partitions": cpus,
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    wanted = sys.argv[1:]
    if Path(WARM_DIR).exists():
        for job, _ in jobs(spark, WARM_DIR).values():
            job()
    seconds = {}
    for name, (job, runs) in jobs(spark, folder).items():
        if wanted and name not in wanted and not name.startswith("index_build"):
            continue
        times = []
        for _ in range(runs):
            start = time.perf_counter()
            job()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times), 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    counts = {
        "documents": fixtures.code(spark, folder).count(),
        "events": fixtures.transcripts(spark, folder).count(),
        "queries": fixtures.query_table(spark, folder).count(),
    }
    rates = {}
    if not wanted:
        rates = {
            "extracted_events_per_sec": round(counts["events"] / seconds["transcript_extract"]),
            "indexed_events_per_sec": round(counts["events"] / seconds["index_build_transcripts"]),
            "indexed_files_per_sec": round(counts["documents"] / seconds["index_build_code"]),
            "batch_queries_per_sec": round(counts["queries"] / seconds["batch_search_transcripts"], 1),
        }
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(folder).name.removeprefix("sf"),
                "rates": rates,
                "counts": counts,
            }
        )
    )


if __name__ == "__main__":
    main()
