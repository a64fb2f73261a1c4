"""The named queries. Each takes a session and a folder of the driver's tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loresift.functions import paths as path_functions
from loresift.functions import text as text_functions
from loresift.functions.since import since_bound
from loresift.operators import clauses, postings, repos
from loresift.operators.batch import batch_search
from loresift.operators.changes import detect_changes
from loresift.operators.code import build_documents, path_gates, walk_tree
from loresift.operators.ignore import IGNORE_RULES, drop_ignored, rules_table
from loresift.operators.search import Beyond, match_count, search
from loresift.operators.transcripts import extract_documents
from loresift.plans.refresh import refresh
from loresift.plans.results import hits_json, hits_listing
from loresift.plans.scan import DocumentScan
from loresift.plans.store import StoredIndex
from loresift.registry import fixtures
from loresift.schema import CODE, TRANSCRIPT_SCHEMA, TRANSCRIPTS
from loresift.session import configure, scratch_path, shuffles_freed
from loresift.sources.jsonl import read_lines
from loresift.sources.tree import _open, read_contents
from loresift.streaming.follow import due_files, follow_folder, follow_versions, quiet_files, transcript_changes

#: What the search queries ask for.
ANY_WORDS = "the aning als"
ALL_WORDS = "the aning"
PHRASE = "of the"
COMPOUND = "the of_the"
CODE_WORDS = "that estion ndat"
BURST_GAP = "6 hours"
BURST_LATE = "10 seconds"


def _talk(spark: SparkSession, folder: str) -> DocumentScan:
    return DocumentScan(TRANSCRIPTS, fixtures.transcripts(configure(spark), folder))


def _code(spark: SparkSession, folder: str) -> DocumentScan:
    return DocumentScan(CODE, fixtures.code(configure(spark), folder))


# -- extraction -------------------------------------------------------------


def transcript_extract(spark: SparkSession, folder: str) -> DataFrame:
    found = extract_documents(fixtures.transcript_lines(configure(spark), folder))
    seconds = F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("at")
    return found.select(*[c for c in found.columns if c != "timestamp"], seconds)


def project_label(spark: SparkSession, folder: str) -> DataFrame:
    turns = fixtures.table(spark, folder, "conversations")
    path = fixtures.session_path(F.col("conv_id")).alias("file_path")
    return turns.select("conv_id", "turn", path).withColumn(
        "project", path_functions.project_label(F.col("file_path"))
    )


def language_label(spark: SparkSession, folder: str) -> DataFrame:
    path = F.col("rel_path")
    return fixtures.paths(spark, folder).select(
        "doc_id", path, path_functions.extension(path).alias("extension"), path_functions.language(path).alias("language")
    )


def path_gate_filter(spark: SparkSession, folder: str) -> DataFrame:
    return path_gates(fixtures.paths(spark, folder))


def ignore_filter(spark: SparkSession, folder: str) -> DataFrame:
    rules = rules_table(spark, ["node_modules/", "*.lock", "# comment", "build/", "!src1/src/build/"])
    rules = rules.unionByName(rules_table(spark, ["*.md", "!f2*.md", "/src/*.rs"], base_dir="src2"))
    rules = rules.unionByName(rules_table(spark, ["*.weird", "!src4/**/f4?.lock"], precedence=IGNORE_RULES))
    return drop_ignored(fixtures.paths(spark, folder), rules)


def identifier_split(spark: SparkSession, folder: str) -> DataFrame:
    documents = fixtures.table(spark, folder, "documents")
    parts = fixtures.table(spark, folder, "part").select(F.concat(F.lit("p"), "p_partkey").alias("id"), F.col("p_brand").alias("source_text"))
    names = fixtures.table(spark, folder, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.col("c_name").alias("source_text"))
    texts = documents.select(F.concat(F.lit("d"), "doc_id").alias("id"), F.col("text").alias("source_text"))
    every = texts.unionByName(parts).unionByName(names)
    return every.select("id", text_functions.split_identifiers(F.col("source_text")).alias("split_text"))


def identifier_expand(spark: SparkSession, folder: str) -> DataFrame:
    documents = fixtures.table(spark, folder, "documents")
    expanded = text_functions.expand_identifiers(F.col("text"))
    return documents.select("doc_id", expanded.alias("expanded"))


# -- files ------------------------------------------------------------------


def _write_files(files: DataFrame, root: str) -> None:
    """Write ``(rel_path, content)`` rows as files, in the tasks that hold them; a file without content goes."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, base = _open(root)
        made = set()
        for batch in batches:
            for row in batch.to_pylist():
                target = f"{base}/{row['rel_path']}"
                if row["content"] is None:
                    filesystem.delete_file(target)
                    continue
                if (parent := target.rsplit("/", 1)[0]) not in made:
                    filesystem.create_dir(parent, recursive=True)
                    made.add(parent)
                with filesystem.open_output_stream(target) as stream:
                    stream.write(row["content"])
            yield pa.record_batch([pa.array([batch.num_rows], pa.int64())], names=["n"])

    content = F.col("content").cast("binary").alias("content")
    with shuffles_freed(files.sparkSession):
        files.select("rel_path", content).mapInArrow(write, "n bigint").agg(F.sum("n")).collect()  # one number


def scan_jsonl(spark: SparkSession, folder: str) -> DataFrame:
    documents = fixtures.table(configure(spark), folder, "documents")
    root = scratch_path(spark, "transcripts")
    name = F.concat("source", F.lit("/"), "doc_id", F.lit(".jsonl"))
    _write_files(documents.select(name.alias("rel_path"), F.col("text").alias("content")), root)
    lines = read_lines(spark, root)
    return lines.withColumn("file_path", path_functions.relative_to(F.col("file_path"), root))


def scan_tree(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as a source tree on disk, walked and read back."""
    configure(spark)
    documents = fixtures.table(spark, folder, "documents")
    root = scratch_path(spark, "tree")
    tail = F.get(F.array(*[F.lit(t) for t in fixtures.PATH_TAILS]), (F.col("doc_id") % len(fixtures.PATH_TAILS)).cast("int"))
    start = F.when(F.col("doc_id") % 3 == 0, "_").when(F.col("doc_id") % 11 == 0, ".").otherwise("f")
    name = F.concat("source", F.lit("/"), start, "doc_id", F.lit("."), tail)
    _write_files(documents.select(name.alias("rel_path"), F.col("text").alias("content")), root)
    found = build_documents(read_contents(walk_tree(spark, root), root), "tree", "development")
    return found.select("repo", "branch", "file_path", "language", "size_bytes", F.md5("content").alias("content_md5"))


# -- index tables -----------------------------------------------------------


def postings_table(spark: SparkSession, folder: str) -> DataFrame:
    rows = _code(spark, folder).postings()
    return rows.select(
        "repo", "file_path", "term", "tf", "dl", F.array_join("positions", ",").alias("positions")
    )


def dictionary(spark: SparkSession, folder: str) -> DataFrame:
    index = _code(spark, folder)
    return postings.dictionary(index.postings().select("repo", "term"), ("repo",))


def corpus_stats(spark: SparkSession, folder: str) -> DataFrame:
    return _code(spark, folder).stats()


def stored_dictionary(spark: SparkSession, folder: str) -> DataFrame:
    return _stored_talk(spark, folder).dictionary()


def _stored_talk(spark: SparkSession, folder: str) -> StoredIndex:
    documents = fixtures.transcripts(configure(spark), folder)
    return StoredIndex.create(documents, TRANSCRIPTS, scratch_path(spark, "index"), 2, 2)


def _stored_code(spark: SparkSession, folder: str) -> StoredIndex:
    documents = fixtures.code(configure(spark), folder)
    return StoredIndex.create(documents, CODE, scratch_path(spark, "index"), term_buckets=1)


# -- search -----------------------------------------------------------------


def search_any(spark: SparkSession, folder: str) -> DataFrame:
    return search(_talk(spark, folder), ANY_WORDS)


def search_all(spark: SparkSession, folder: str) -> DataFrame:
    return search(_talk(spark, folder), ALL_WORDS, clauses.ALL)


def search_phrase(spark: SparkSession, folder: str) -> DataFrame:
    return search(_talk(spark, folder), clauses.phrase(spark, PHRASE))


def search_compound(spark: SparkSession, folder: str) -> DataFrame:
    return search(_talk(spark, folder), COMPOUND)


def search_bool(spark: SparkSession, folder: str) -> DataFrame:
    asked = [(clauses.ANY, ["the", PHRASE]), (clauses.ANY, ["aning", "als"])]
    return search(_talk(spark, folder), clauses.boolean(spark, asked))


def search_text_syntax(spark: SparkSession, folder: str) -> DataFrame:
    return search(_talk(spark, folder), f'(the OR "{PHRASE}") AND (aning OR als)')


def search_range_open(spark: SparkSession, folder: str) -> DataFrame:
    ends = (Beyond(0), Beyond(3))
    return search(_talk(spark, folder), ANY_WORDS, ranges={"event_index": ends}, limit=20)


def search_bool_any(spark: SparkSession, folder: str) -> DataFrame:
    asked = [(clauses.ALL, ["the", "aning"]), (clauses.ALL, ["als", "der"])]
    return search(_talk(spark, folder), clauses.boolean(spark, asked, clauses.ANY), limit=25)


def search_since(spark: SparkSession, folder: str) -> DataFrame:
    return search(_talk(spark, folder), ANY_WORDS, since="28d", now=fixtures.NOW, limit=20)


def search_range(spark: SparkSession, folder: str) -> DataFrame:
    return search(_talk(spark, folder), ANY_WORDS, ranges={"event_index": (1, 2)}, limit=20)


def search_project(spark: SparkSession, folder: str) -> DataFrame:
    return search(_talk(spark, folder), ANY_WORDS, equals={"project": "srv/log/p1"})


def search_keyword(spark: SparkSession, folder: str) -> DataFrame:
    return search(_talk(spark, folder), ANY_WORDS, equals={"event_role": "assistant"}, limit=100)


def search_code(spark: SparkSession, folder: str) -> DataFrame:
    return search(_code(spark, folder), CODE_WORDS, limit=30)


def search_repo_language(spark: SparkSession, folder: str) -> DataFrame:
    return search(_code(spark, folder), CODE_WORDS, equals={"repo": "src3", "language": "en"})


def stored_search(spark: SparkSession, folder: str) -> DataFrame:
    return search(_stored_talk(spark, folder), ANY_WORDS)


def stored_search_bool(spark: SparkSession, folder: str) -> DataFrame:
    asked = [(clauses.ANY, ["the", PHRASE]), (clauses.ANY, ["aning", "als"])]
    return search(_stored_talk(spark, folder), clauses.boolean(spark, asked))


def stored_search_code(spark: SparkSession, folder: str) -> DataFrame:
    return search(_stored_code(spark, folder), CODE_WORDS, equals={"repo": "src3", "language": "en"})


def batch(spark: SparkSession, folder: str) -> DataFrame:
    return batch_search(_talk(spark, folder), fixtures.query_table(spark, folder))


def batch_filtered(spark: SparkSession, folder: str) -> DataFrame:
    """Queries with a project, a time bound, a limit and a compound word each."""
    asked = fixtures.query_table(spark, folder)
    narrowed = asked.select(
        "query_id",
        F.concat("query", F.lit(" "), F.regexp_replace("query", " ", "-")).alias("query"),
        F.when(F.col("query_id") % 2 == 0, F.concat(F.lit("srv/log/p"), F.col("query_id") % 5)).alias("project"),
        F.when(F.col("query_id") % 3 == 0, "2024-01-02T12:00:00Z").alias("since"),
        (F.col("query_id") % 20).cast("int").alias("limit"),
    )
    return batch_search(_talk(spark, folder), narrowed, now=fixtures.NOW)


def batch_code(spark: SparkSession, folder: str) -> DataFrame:
    asked = fixtures.query_table(spark, folder).withColumn("repo", F.concat(F.lit("src"), F.col("query_id") % 20))
    return batch_search(_code(spark, folder), asked)


def batch_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Queries of two groups each, joined as the query says: a phrase or a word, and two words that must or may occur."""
    word = F.split("query", r"\s+")
    pieces = F.array(F.concat_ws(" ", F.slice(word, 1, 2)), F.get(word, F.lit(2)))
    more = F.array(F.get(word, F.lit(3)), F.get(word, F.lit(4)))
    how = F.when(F.col("query_id") % 3 == 0, "all").otherwise("any")
    asked = fixtures.query_table(spark, folder).select(
        "query_id", "query",
        F.when(F.col("query_id") % 2 == 0, "any").otherwise("all").alias("match"),
        F.array(F.struct(F.lit("any").alias("match"), pieces.alias("pieces")),
                F.struct(how.alias("match"), more.alias("pieces"))).alias("groups"),
        F.when(F.col("query_id") % 5 == 0, F.lit(1)).cast("bigint").alias("event_index_min"),
    )
    return batch_search(_stored_talk(spark, folder), asked)


def stored_batch(spark: SparkSession, folder: str) -> DataFrame:
    return batch_search(_stored_talk(spark, folder), fixtures.query_table(spark, folder))


def matches(spark: SparkSession, folder: str) -> DataFrame:
    index = _code(spark, folder)
    return match_count(index, clauses.words(spark, CODE_WORDS), equals={"language": "en"})


def snippet_transcript(spark: SparkSession, folder: str) -> DataFrame:
    talk = fixtures.transcripts(configure(spark), folder)
    cut = text_functions.snippet(F.col("text"), F.lit("The aning"), TRANSCRIPTS.snippet_chars)
    return talk.select("file_path", "event_index", cut.alias("snippet"))


def snippet_code(spark: SparkSession, folder: str) -> DataFrame:
    cut = text_functions.snippet(F.col("content"), F.lit("that"), CODE.snippet_chars)
    return fixtures.code(spark, folder).select("file_path", cut.alias("snippet"))


def since_values(spark: SparkSession, folder: str) -> DataFrame:
    """Relative and absolute bounds made of every event."""
    units = F.array(*[F.lit(u) for u in "smhdw"])
    relative = F.concat((F.col("event_id") % 100).cast("string"), F.get(units, (F.col("event_id") % 5).cast("int")))
    absolute = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+02:00'")
    value = F.when(F.col("event_id") % 2 == 0, relative).otherwise(absolute)
    events = fixtures.table(configure(spark), folder, "events").select("event_id", value.alias("since"))
    bound = since_bound(F.col("since"), F.lit(fixtures.NOW))
    return events.withColumn("bound", F.date_format(bound, "yyyy-MM-dd HH:mm:ss"))


# -- summaries and output ---------------------------------------------------


def index_summary(spark: SparkSession, folder: str) -> DataFrame:
    return _stored_code(spark, folder).summary()


def doc_count(spark: SparkSession, folder: str) -> DataFrame:
    return _stored_code(spark, folder).stats().agg(F.sum("n_docs").alias("n_documents"))


def default_repo(spark: SparkSession, folder: str) -> DataFrame:
    """The default of an index from which all repositories but the last are dropped."""
    documents = fixtures.code(configure(spark), folder)
    last = documents.agg(F.max("repo").alias("repo"))
    index = StoredIndex.create(documents.join(last, "repo", "left_semi"), CODE, scratch_path(spark, "index"))
    return spark.createDataFrame([(repos.default_repo(index.stats()),)], "repo string")


def repo_list(spark: SparkSession, folder: str) -> DataFrame:
    return repos.repo_list(_stored_code(spark, folder).stats())


def json_hits(spark: SparkSession, folder: str) -> DataFrame:
    return hits_json(search_any(spark, folder), TRANSCRIPTS)


def json_hit_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The JSON of the hits read back into rows."""
    hits = search_any(spark, folder)
    rows = F.from_json("hits", f"array<{hits.schema.simpleString()}>")
    return hits_json(hits, TRANSCRIPTS).select(F.inline(rows))


def listing_transcripts(spark: SparkSession, folder: str) -> DataFrame:
    return hits_listing(search_any(spark, folder), TRANSCRIPTS)


def listing_code(spark: SparkSession, folder: str) -> DataFrame:
    return hits_listing(search_code(spark, folder), CODE)


# -- upkeep -----------------------------------------------------------------


def _conversation(column: str) -> Column:
    return F.regexp_extract(column, r"([0-9]+)\.jsonl$", 1).cast("bigint")


def replace_file(spark: SparkSession, folder: str) -> DataFrame:
    """Odd conversations are rewritten, every second of those to nothing."""
    index = _stored_talk(spark, folder)
    talk = fixtures.transcripts(spark, folder)
    odd = talk.filter(_conversation("file_path") % 2 == 1)
    revised = odd.filter(_conversation("file_path") % 4 == 1).withColumn("text", F.concat("text", F.lit(" revised")))
    index.replace_files(revised, odd.select("file_path"))
    return index.dictionary()


def replace_branch(spark: SparkSession, folder: str) -> DataFrame:
    """One repository is rewritten with half of its files."""
    index = _stored_code(spark, folder)
    mine = fixtures.code(spark, folder).filter("repo = 'src3'")
    even = F.regexp_extract("file_path", r"([0-9]+)\.txt$", 1).cast("bigint") % 2 == 0
    other = mine.filter(~even).withColumn("content", F.concat("content", F.lit(" revised")))
    index.replace_branch(other, "src3", "development")
    return index.dictionary()


def _replaced_thrice(spark: SparkSession, folder: str) -> StoredIndex:
    """Odd conversations rewritten twice, then every second of those to nothing: ends as ``replace_file``."""
    index = _stored_talk(spark, folder)
    odd = fixtures.transcripts(spark, folder).filter(_conversation("file_path") % 2 == 1)
    for number in range(2):
        again = odd.withColumn("text", F.concat("text", F.lit(f" draft{number}")))
        index.replace_files(again, odd.select("file_path"))
    revised = odd.filter(_conversation("file_path") % 4 == 1).withColumn("text", F.concat("text", F.lit(" revised")))
    index.replace_files(revised, odd.select("file_path"))
    return index


def replace_thrice(spark: SparkSession, folder: str) -> DataFrame:
    return _replaced_thrice(spark, folder).dictionary()


def compact_index(spark: SparkSession, folder: str) -> DataFrame:
    """Parts of three replacements merged with what they replaced: the documents, and their number by the statistics."""
    index = _replaced_thrice(spark, folder)
    index.compact(everything=True)
    index.clean_up()
    held = index.documents().select("file_path", "event_index", F.md5("text").alias("text_md5"))
    return held.withColumn("n_docs", index.stats().select("n_docs").scalar())


def pinned_reader(spark: SparkSession, folder: str) -> DataFrame:
    """What a pinned reader and one that goes on see after a replacement."""
    index = _stored_talk(spark, folder)
    pinned = index.pinned()
    odd = fixtures.transcripts(spark, folder).filter(_conversation("file_path") % 2 == 1)
    index.replace_files(odd.limit(0), odd.select("file_path"))
    views = [(name, view) for name, view in (("pinned", pinned), ("current", index))]
    counted = [v.documents().agg(F.count("*").alias("n_documents")).withColumn("reader", F.lit(n)) for n, v in views]
    return counted[0].unionByName(counted[1])


def _line(text: Column) -> Column:
    return F.to_json(F.struct(F.lit("user").alias("type"), F.struct(text.alias("content")).alias("message")))


def _transcript_files(spark: SparkSession, folder: str, kept: str, suffix: str = "") -> DataFrame:
    """A transcript per document for which ``kept`` holds; every seventh is empty."""
    content = F.when(F.col("doc_id") % 7 == 0, "").otherwise(F.concat(_line(F.concat("text", F.lit(suffix))), F.lit("\n\n"), _line(F.col("lang"))))
    name = F.concat(F.lit("-docs-"), "source", F.lit("/"), "doc_id", F.lit(".jsonl"))
    return fixtures.table(spark, folder, "documents").filter(kept).select(name.alias("rel_path"), content.alias("content"))


def _changed_files(spark: SparkSession, folder: str, root: str) -> None:
    """After even documents were written: odd ones appear, every fourth is rewritten, every sixth goes."""
    _write_files(_transcript_files(spark, folder, "doc_id % 2 = 1"), root)
    _write_files(_transcript_files(spark, folder, "doc_id % 4 = 0", " revised"), root)
    _write_files(_transcript_files(spark, folder, "doc_id % 6 = 0").withColumn("content", F.lit(None).cast("string")), root)


def _empty_talk(spark: SparkSession) -> StoredIndex:
    return StoredIndex.create(spark.createDataFrame([], TRANSCRIPT_SCHEMA), TRANSCRIPTS, scratch_path(spark, "index"), 2, 64)


def _refreshed(spark: SparkSession, folder: str) -> tuple[StoredIndex, str]:
    root = scratch_path(configure(spark), "talk")
    index = _empty_talk(spark)
    _write_files(_transcript_files(spark, folder, "doc_id % 2 = 0"), root)
    refresh(index, root)
    _changed_files(spark, folder, root)
    refresh(index, root)
    return index, root


def _by_path(index: StoredIndex, root: str) -> DataFrame:
    path = path_functions.relative_to(F.col("file_path"), root).alias("file_path")
    return index.documents().select(path, "event_index", "project", F.md5("text").alias("text_md5"))


def index_refresh(spark: SparkSession, folder: str) -> DataFrame:
    return _by_path(*_refreshed(spark, folder))


def transcript_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and files, those without any event included."""
    return _refreshed(spark, folder)[0].summary()


def stream_bootstrap_follow(spark: SparkSession, folder: str) -> DataFrame:
    """Files are loaded, then followed: what is written while the stream runs is found by its listings."""
    root = scratch_path(configure(spark), "talk")
    index = _empty_talk(spark)
    _write_files(_transcript_files(spark, folder, "doc_id % 2 = 0"), root)
    running = follow_folder(index, root).option("checkpointLocation", scratch_path(spark, "follow-checkpoint")).start()
    try:
        while not index.has_documents() and not running.awaitTermination(1):
            pass
        _changed_files(spark, folder, root)
        begun = len(running.recentProgress) and running.lastProgress["batchId"]
        # a refresh that began after the last change has ended
        while (running.lastProgress or {"batchId": -1})["batchId"] < begun + 2 and not running.awaitTermination(1):
            pass
    finally:
        running.stop()
    return _by_path(index, root)


def prune_files(spark: SparkSession, folder: str) -> DataFrame:
    index = _stored_talk(spark, folder)
    listing = fixtures.transcripts(spark, folder).filter(_conversation("file_path") % 3 != 0)
    index.prune(listing.select("file_path").distinct())
    return index.documents().groupBy("file_path").agg(F.count("*").alias("n_events"))


def _listing(spark: SparkSession, folder: str) -> DataFrame:
    turns = fixtures.table(spark, folder, "conversations")
    return turns.groupBy("conv_id").agg(
        F.max(fixtures.turn_time(F.col("conv_id"), F.col("turn"))).alias("mtime"),
        F.sum(F.char_length("text")).alias("size_bytes"),
    ).withColumn("file_path", fixtures.session_path(F.col("conv_id")))


def change_detect(spark: SparkSession, folder: str) -> DataFrame:
    files = _listing(configure(spark), folder)
    manifest = files.filter(F.col("conv_id") % 5 != 0)
    grown = F.when(F.col("conv_id") % 3 == 0, F.col("size_bytes") + 1).otherwise(F.col("size_bytes"))
    listing = files.filter(F.col("conv_id") % 7 != 0).withColumn("size_bytes", grown)
    columns = ["file_path", "mtime", "size_bytes"]
    return detect_changes(listing.select(*columns), manifest.select(*columns))


# -- streams ----------------------------------------------------------------


def _stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    schema = fixtures.table(spark, folder, name).schema
    # a glob, so that the table may be one file or a folder of files
    return spark.readStream.schema(schema).parquet(f"{folder}/{name}.parque[t]")


def burst_batch(spark: SparkSession, folder: str) -> DataFrame:
    """Bursts of file changes, from the table."""
    return quiet_files(transcript_changes(fixtures.file_changes(configure(spark), folder)), BURST_GAP)


def stream_debounce(spark: SparkSession, folder: str) -> DataFrame:
    """Bursts of file changes that are over, from a stream."""
    configure(spark)
    changes = transcript_changes(_stream(spark, folder, "events").select(*fixtures.change_columns()))
    out, checkpoint = scratch_path(spark, "bursts"), scratch_path(spark, "bursts-checkpoint")
    bursts = quiet_files(changes, BURST_GAP, BURST_LATE)
    running = (
        bursts.writeStream.outputMode("append")
        .format("parquet")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(out)
    )
    running.awaitTermination()
    return spark.read.schema(bursts.schema).parquet(out)


def stream_follow(spark: SparkSession, folder: str) -> DataFrame:
    """All changes of each file, as reported once it is quiet by the clock; the last ones too."""
    configure(spark)
    changes = transcript_changes(_stream(spark, folder, "events").select(*fixtures.change_columns()))
    out = scratch_path(spark, "due")
    due = due_files(changes, 500)
    writer = due.writeStream.outputMode("append").format("parquet").trigger(processingTime="300 milliseconds")
    running = writer.option("checkpointLocation", scratch_path(spark, "due-checkpoint")).start(out)
    try:
        while not running.awaitTermination(1):
            done = running.lastProgress
            if done and done["sources"][0]["endOffset"] and not done["numInputRows"]:
                if done["stateOperators"][0]["numRowsTotal"] == 0:
                    break
    finally:
        running.stop()
    reported = spark.read.schema(due.schema).parquet(out).groupBy("file_path")
    return reported.agg(
        F.min("first_change").alias("first_change"), F.max("last_change").alias("last_change"), F.sum("n_changes").alias("n_changes")
    )


def stream_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """Versions of a transcript per document, streamed into an index.

    Each file is created; every third is then rewritten, every fifth removed.
    """
    configure(spark)
    empty = spark.createDataFrame([], TRANSCRIPT_SCHEMA)
    index = StoredIndex.create(empty, TRANSCRIPTS, scratch_path(spark, "index"), 2, 1)

    def line(text: Column) -> Column:
        message = F.struct(text.alias("content"))
        return F.to_json(F.struct(F.lit("user").alias("type"), message.alias("message")))

    def version(second: int, kind: str, content: Column) -> Column:
        ts = F.timestamp_seconds(F.lit(second))
        return F.struct(F.lit(kind).alias("kind"), ts.alias("ts"), content.alias("content"))

    doc_id, text = F.col("doc_id"), F.col("text")
    first = F.concat(line(text), F.lit("\n\n"), line(F.col("lang")))
    rewritten = F.concat(line(F.concat(text, F.lit(" revised"))), F.lit("\n"))
    versions = F.array_compact(
        F.array(
            version(1, "create", first),
            F.when(doc_id % 3 == 0, version(2, "modify", rewritten)),
            F.when(doc_id % 5 == 0, version(3, "remove", F.lit(None).cast("string"))),
        )
    )
    path = F.concat(F.lit("/t/-docs-"), "source", F.lit("/"), doc_id, F.lit(".jsonl"))
    changes = _stream(spark, folder, "documents").select(path.alias("file_path"), F.inline(versions))
    running = (
        follow_versions(index, changes)
        .option("checkpointLocation", scratch_path(spark, "upsert-checkpoint"))
        .trigger(availableNow=True)
        .start()
    )
    running.awaitTermination()
    return index.documents().select("file_path", "event_index", "project", F.md5("text").alias("text_md5"))


QUERIES = {
    "transcript_extract": transcript_extract,
    "project_label": project_label,
    "language_label": language_label,
    "path_gates": path_gate_filter,
    "ignore_filter": ignore_filter,
    "identifier_split": identifier_split,
    "identifier_expand": identifier_expand,
    "scan_jsonl": scan_jsonl,
    "scan_tree": scan_tree,
    "postings": postings_table,
    "dictionary": dictionary,
    "corpus_stats": corpus_stats,
    "stored_dictionary": stored_dictionary,
    "search_any": search_any,
    "search_all": search_all,
    "search_phrase": search_phrase,
    "search_compound": search_compound,
    "search_bool": search_bool,
    "search_bool_any": search_bool_any,
    "search_text_syntax": search_text_syntax,
    "search_range_open": search_range_open,
    "search_since": search_since,
    "search_range": search_range,
    "search_project": search_project,
    "search_keyword": search_keyword,
    "search_code": search_code,
    "search_repo_language": search_repo_language,
    "stored_search": stored_search,
    "stored_search_bool": stored_search_bool,
    "stored_search_code": stored_search_code,
    "batch_search": batch,
    "batch_search_filtered": batch_filtered,
    "batch_search_code": batch_code,
    "stored_batch_search": stored_batch,
    "batch_search_bool": batch_groups,
    "match_count": matches,
    "snippet_transcript": snippet_transcript,
    "snippet_code": snippet_code,
    "since_values": since_values,
    "index_summary": index_summary,
    "repo_list": repo_list,
    "doc_count": doc_count,
    "default_repo": default_repo,
    "hits_json_rows": json_hit_rows,
    "hits_json": json_hits,
    "listing_transcripts": listing_transcripts,
    "listing_code": listing_code,
    "replace_file": replace_file,
    "replace_branch": replace_branch,
    "replace_thrice": replace_thrice,
    "compact_index": compact_index,
    "pinned_reader": pinned_reader,
    "prune_files": prune_files,
    "index_refresh": index_refresh,
    "transcript_summary": transcript_summary,
    "change_detect": change_detect,
    "burst_batch": burst_batch,
    "stream_debounce": stream_debounce,
    "stream_follow": stream_follow,
    "stream_upsert": stream_upsert,
    "stream_bootstrap_follow": stream_bootstrap_follow,
}
