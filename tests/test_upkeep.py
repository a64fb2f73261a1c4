from __future__ import annotations

import json
import time
from datetime import datetime, timedelta, timezone
from functools import reduce
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loresift.operators import postings
from loresift.operators.changes import detect_changes
from loresift.operators.search import search
from loresift.operators.transcripts import load_transcripts
from loresift.plans.scan import DocumentScan
from loresift.plans.store import StoredIndex, path_bucket
from loresift.schema import TRANSCRIPTS
from loresift.session import scratch_path, settled, shared_folder
from loresift.sources import jsonl
from loresift.sources.jsonl import list_transcripts
from loresift.streaming.follow import apply_versions, follow_files, follow_versions, quiet_files, transcript_changes
from tests.helpers import talk

FILES = [f"/t/-p/{i}.jsonl" for i in range(6)]


def some_files(spark, texts=("ant bee", "ant cat")):
    frames = [talk(spark, [f"{t} f{i}" for t in texts], path=path) for i, path in enumerate(FILES)]
    result = frames[0]
    for frame in frames[1:]:
        result = result.union(frame)
    return result


@pytest.fixture
def index(spark):
    return StoredIndex.create(some_files(spark), TRANSCRIPTS, scratch_path(spark, "upkeep"), 3, 2)


def paths(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "file_path string")


def state(index):
    """Documents, and every derived table as recomputed from them."""
    documents = index.documents()
    scan = DocumentScan(TRANSCRIPTS, documents)
    assert sorted(index.dictionary().collect()) == sorted(postings.dictionary(scan.postings(), ()).collect())
    assert index.stats().collect() == scan.stats().collect()
    columns = ["file_path", "event_index", "term", "tf", "positions", "dl"]
    assert sorted(index.postings().select(*columns).collect()) == sorted(scan.postings().select(*columns).collect())
    return {(r["file_path"], r["event_index"]): r["text"] for r in documents.collect()}


def test_replacing_files_is_idempotent_and_leaves_the_rest(spark, index):
    before = state(index)
    new = talk(spark, ["dog"], path=FILES[0]).union(talk(spark, ["elk"], path="/t/-p/new.jsonl"))
    changed = paths(spark, FILES[0], FILES[1], "/t/-p/new.jsonl")
    index.replace_files(new, changed)
    after = state(index)
    assert after == {
        **{k: v for k, v in before.items() if k[0] not in FILES[:2]},
        (FILES[0], 0): "dog",
        ("/t/-p/new.jsonl", 0): "elk",
    }
    index.replace_files(new, changed)
    assert state(index) == after
    assert len(search(index, "dog").collect()) == 1


def test_postings_of_a_part_are_made_by_tasks_of_bounded_size(spark, monkeypatch):
    texts = [f"{number} " + "ant bee cat " * 40 for number in range(40)]
    made, tasks = postings.postings, []

    def noting(documents, *rest):
        counted = documents.mapInArrow(lambda batches: [pa.record_batch([[sum(b.num_rows for b in batches)]], names=["n"])], "n long")
        tasks.append(sorted(row["n"] for row in counted.collect() if row["n"]))
        return made(documents, *rest)

    monkeypatch.setattr(postings, "postings", noting)
    monkeypatch.setattr("loresift.plans.store.POSTED_BYTES", 2000, raising=False)
    # stored in a single file, and so are the live rows that the replacement hides
    index = StoredIndex.create(talk(spark, texts, path=FILES[0]).coalesce(1), TRANSCRIPTS, scratch_path(spark, "upkeep"), 1, 2)
    index.replace_files(talk(spark, ["dog"], path=FILES[0]), paths(spark, FILES[0]))
    assert [sum(rows) for rows in tasks] == [40, 1, 40]
    assert max(tasks[0]) <= 20 and max(tasks[2]) <= 20
    monkeypatch.setattr(postings, "postings", made)
    assert state(index) == {(FILES[0], 0): "dog"}


def _shuffled(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = (files.apply(i).getName() for i in range(files.size()))
    return {name for name in names if name.startswith("shuffle_") and name.endswith(".data")}


def test_postings_are_shuffled_a_portion_of_the_files_at_a_time(spark, monkeypatch):
    documents = reduce(DataFrame.union, [talk(spark, [f"ant w{k} x{k}" * 3 for k in range(9)], path=p) for p in FILES])
    whole = StoredIndex.create(documents, TRANSCRIPTS, scratch_path(spark, "whole"), 8, 2)
    made, portions = postings.postings, []

    def noting(documents, *rest):
        portions.append(documents.count())
        return made(documents, *rest)

    monkeypatch.setattr(postings, "postings", noting)
    monkeypatch.setattr("loresift.plans.store.PORTION_BYTES", 1)
    parted = StoredIndex.create(documents, TRANSCRIPTS, scratch_path(spark, "parted"), 8, 2)
    folders = documents.select(path_bucket(F.col("file_path"), 8)).distinct().count()
    assert len(portions) >= folders > 1 and sum(portions) == 9 * len(FILES)
    for index in (whole, parted):
        index.replace_files(talk(spark, ["dog w1"], path=FILES[0]), paths(spark, *FILES[:2]))
    columns = ["file_path", "event_index", "term", "tf", "positions", "dl"]
    for rows in (lambda i: i.postings().select(*columns), lambda i: i.dictionary(), lambda i: i.stats()):
        assert sorted(rows(parted).collect()) == sorted(rows(whole).collect())
    assert state(parted) == state(whole)
    for term in ("ant", "w1", "dog"):
        assert sorted(search(parted, term).collect()) == sorted(search(whole, term).collect())


def test_a_write_keeps_nothing_that_it_shuffled(spark):
    before = _shuffled(spark)
    written = settled(spark.range(1000).repartition(3, "id"), "written")
    until = time.time() + 20
    while (left := _shuffled(spark) - before) and time.time() < until:  # they go in the background
        time.sleep(0.1)
    assert not left and written.count() == 1000


def test_a_replacement_leaves_no_rows_in_the_shared_folder(spark, index):
    folder = Path(shared_folder(spark).removeprefix("file:"))
    before = set(folder.iterdir())
    index.replace_files(talk(spark, ["dog"], path=FILES[0]), paths(spark, *FILES[:2]))
    left = {p.name.rpartition("-")[0]: spark.read.parquet(str(p)).columns for p in set(folder.iterdir()) - before}
    assert left.keys() >= {"changed", "hidden", "hidden-terms"}
    assert all(columns == ["nothing"] for columns in left.values())


def test_versions_are_kept_in_files_not_in_a_cache(spark, index, monkeypatch):
    line = json.dumps({"type": "user", "message": {"content": "dog"}})
    rows = [(FILES[0], "modify", datetime(2024, 1, 2), line), (FILES[0], "create", datetime(2024, 1, 1), "{}")]
    versions = spark.createDataFrame(rows, "file_path string, kind string, ts timestamp, content string")
    replace_files, plans = StoredIndex.replace_files, []

    def noting(self, documents, changed, *rest):
        plans.extend(rows._jdf.queryExecution().withCachedData().toString() for rows in (documents, changed))
        return replace_files(self, documents, changed, *rest)

    monkeypatch.setattr(StoredIndex, "replace_files", noting)
    apply_versions(index, versions)
    assert len(plans) == 2 and not any("InMemoryRelation" in plan for plan in plans)
    assert state(index)[(FILES[0], 0)] == "dog"


def test_replacing_everything_by_nothing(spark, index):
    index.replace_files(talk(spark, []), paths(spark, *FILES))
    assert state(index) == {}
    assert not index.has_documents()
    assert search(index, "ant").collect() == []
    index.replace_files(talk(spark, ["ant"], path=FILES[0]), paths(spark, FILES[0]))
    assert len(search(index, "ant").collect()) == 1


def test_a_replacement_that_was_cut_off_is_not_seen(spark, index, monkeypatch):
    before = state(index)
    commit = StoredIndex._commit

    def cut_off(self, part, removed):
        raise RuntimeError("lost")

    monkeypatch.setattr(StoredIndex, "_commit", cut_off)
    with pytest.raises(RuntimeError):
        index.replace_files(talk(spark, ["dog"], path=FILES[0]), paths(spark, FILES[0]))
    with pytest.raises(RuntimeError):
        StoredIndex.create(some_files(spark), TRANSCRIPTS, half := scratch_path(spark, "half"), 3, 2)
    monkeypatch.setattr(StoredIndex, "_commit", commit)
    assert state(index) == before
    with pytest.raises(ValueError, match="no index"):
        StoredIndex.open(spark, half)
    index.replace_files(talk(spark, ["dog"], path=FILES[0]), paths(spark, FILES[0]))
    after = state(index)
    assert after[(FILES[0], 0)] == "dog" and (FILES[0], 1) not in after


def test_an_index_is_not_written_over(spark, index):
    with pytest.raises(ValueError, match="already"):
        StoredIndex.create(some_files(spark), TRANSCRIPTS, index.root, 3, 2)


def test_pruning_and_merging_everything(spark, index):
    index.prune(paths(spark, *FILES[:2]))
    kept = state(index)
    assert {k[0] for k in kept} == set(FILES[:2])
    assert index.compact(everything=True) == 2
    assert state(index) == kept and len(index.parts()) == 1
    assert index.compact(everything=True) == 0


def folder_bytes(index):
    files = [f for f in Path(index.root).rglob("*.parquet") if f.is_file()]
    return sum(f.stat().st_size for f in files)


def test_a_replaced_file_writes_in_proportion_to_itself(spark):
    words = [f"w{k}" for k in range(400)]
    files = [talk(spark, [" ".join(words)] * 5, path=p) for p in FILES]
    index = StoredIndex.create(reduce(DataFrame.union, files), TRANSCRIPTS, scratch_path(spark, "grows"), 3, 8)
    whole, lists = folder_bytes(index), sorted(str(f) for f in Path(index.root).rglob("*.parquet"))
    index.replace_files(talk(spark, ["dog bee"], path=FILES[0]), paths(spark, FILES[0]))
    assert set(lists) < {str(f) for f in Path(index.root).rglob("*.parquet")}  # nothing was written over
    one_file = folder_bytes(index) - whole
    assert one_file < whole
    state(index)
    # what one word more takes does not grow with the index
    more = [talk(spark, [" ".join(words)] * 5, path=f"/t/-q/{k}.jsonl") for k in range(30)]
    large = StoredIndex.create(reduce(DataFrame.union, files + more), TRANSCRIPTS, scratch_path(spark, "large"), 3, 8)
    before = folder_bytes(large)
    large.replace_files(talk(spark, ["dog bee"], path=FILES[0]), paths(spark, FILES[0]))
    assert folder_bytes(large) - before < 1.2 * one_file


def test_storage_stays_bounded_over_many_replacements(spark, index):
    expected = state(index)
    first, merged = folder_bytes(index), []
    for k in range(20):
        index.replace_files(talk(spark, [f"dog{k}"], path=FILES[k % 2]), paths(spark, FILES[k % 2]))
        if k % 4 == 3:
            merged.append(index.compact())
    assert max(merged) > 3 and len(index.parts()) <= 4
    index.clean_up()
    after = state(index)
    assert after == {**{k: v for k, v in expected.items() if k[0] not in FILES[:2]}, (FILES[0], 0): "dog18", (FILES[1], 0): "dog19"}
    index.compact(everything=True)
    index.clean_up()
    held = [f for p in index.parts() for t in ("documents", "postings", "dictionary") for f in (Path(index.root) / t / p.folder).rglob("*.parquet")]
    assert state(index) == after and sum(f.stat().st_size for f in held) < first


def test_merging_leaves_larger_parts_and_keeps_what_hides_them(spark, index):
    base = index.parts()[0]
    index.replace_files(talk(spark, ["dog"], path=FILES[0]), paths(spark, FILES[0]))
    index.replace_files(talk(spark, []), paths(spark, FILES[1]))
    expected = state(index)
    assert index.compact() == 2 and index.parts()[0] == base and len(index.parts()) == 2
    assert state(index) == expected
    index.replace_files(talk(spark, ["elk"], path=FILES[1]), paths(spark, FILES[1]))
    assert state(index) == {**expected, (FILES[1], 0): "elk"}


def test_a_pinned_reader_sees_one_state(spark, index):
    pinned = index.pinned()
    before = state(pinned)
    index.replace_files(talk(spark, ["zebra"], path=FILES[0]), paths(spark, FILES[0]))
    index.compact(everything=True)
    assert state(pinned) == before and search(pinned, "zebra").collect() == []
    assert len(search(index, "zebra").collect()) == 1


def test_a_lookup_opens_only_the_files_of_its_terms(spark):
    documents = reduce(DataFrame.union, [talk(spark, [f"ant w{k} x{k} y{k}" for k in range(30)], path=p) for p in FILES])
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "2k")
    try:
        index = StoredIndex.create(documents, TRANSCRIPTS, scratch_path(spark, "fenced"), 2, 64)
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    parts = index.parts()
    every = set(index._read("postings").inputFiles())
    assert len(every) > 3
    for term in ("ant", "w3", "x7", "nothing"):
        found = index._lookup("postings", [term], parts)
        opened = set(found.inputFiles())
        holding = {r["f"] for r in index._read("postings").filter(F.col("term") == term).select(F.input_file_name().alias("f")).collect()}
        assert holding <= opened < every and found.count() == index._read("postings").filter(F.col("term") == term).count()


def test_opening_an_index_again_sees_later_commits(spark, index):
    other = StoredIndex.open(spark, index.root)
    assert (other.corpus, other.doc_buckets, other.term_buckets) == (TRANSCRIPTS, 3, 2)
    index.replace_files(talk(spark, ["zebra"], path=FILES[0]), paths(spark, FILES[0]))
    assert len(search(other, "zebra").collect()) == 1


def test_change_detection(spark):
    schema = "file_path string, mtime timestamp, size_bytes bigint"
    early, late = datetime(2024, 1, 1), datetime(2024, 1, 2)
    manifest = spark.createDataFrame([("same", early, 1), ("touched", early, 1), ("grown", early, 1), ("gone", early, 1)], schema)
    listing = spark.createDataFrame([("same", early, 1), ("touched", late, 1), ("grown", early, 2), ("new", late, 1)], schema)
    found = {r["file_path"]: r["change"] for r in detect_changes(listing, manifest).collect()}
    assert found == {"touched": "modified", "grown": "modified", "gone": "removed", "new": "created"}


def line(text):
    return json.dumps({"type": "user", "sessionId": "s", "message": {"content": text}})


def test_initial_load_then_changes_found_by_listing(spark, tmp_path):
    root = tmp_path / "-srv-log-demo"
    root.mkdir()
    (root / "a.jsonl").write_text(line("ant") + "\n" + line("bee") + "\n")
    (root / "b.jsonl").write_text(line("cat"))
    manifest = list_transcripts(spark, str(tmp_path))
    manifest.write.parquet(scratch := scratch_path(spark, "manifest"))
    index = StoredIndex.create(load_transcripts(spark, str(tmp_path)), TRANSCRIPTS, scratch_path(spark, "followed"), 2, 1)
    assert sorted(state(index).values()) == ["ant", "bee", "cat"]
    summary = index.summary().first()
    assert (summary["n_documents"], summary["n_files"]) == (3, 2)
    (root / "a.jsonl").write_text(line("dog"))
    (root / "b.jsonl").unlink()
    (root / "c.jsonl").write_text(line("elk"))
    changes = detect_changes(list_transcripts(spark, str(tmp_path)), spark.read.parquet(scratch))
    rows = load_transcripts(spark, str(tmp_path)).join(changes, "file_path", "left_semi")
    index.replace_files(rows, changes)
    assert state(index) == {(str(root / "a.jsonl"), 0): "dog", (str(root / "c.jsonl"), 0): "elk"}


CHANGES = "file_path string, kind string, ts timestamp"
START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def at(millis):
    return START + timedelta(milliseconds=millis)


def run(writer, spark):
    query = writer.option("checkpointLocation", scratch_path(spark, "checkpoint")).trigger(availableNow=True).start()
    query.awaitTermination()


def run_until_quiet(writer, spark, rows):
    """Until so many changes are read and no timer is left."""
    query = writer.option("checkpointLocation", scratch_path(spark, "checkpoint")).trigger(processingTime="200 milliseconds").start()
    try:
        for _ in range(200):
            done = query.recentProgress
            if sum(p["numInputRows"] for p in done) >= rows and done[-1]["stateOperators"][0]["numRowsTotal"] == 0:
                return
            time.sleep(0.3)
        raise AssertionError("timers are left")
    finally:
        query.stop()


def test_an_older_version_in_a_later_batch_is_passed_over(spark, tmp_path):
    index = StoredIndex.create(talk(spark, []), TRANSCRIPTS, scratch_path(spark, "order"), 2, 1)
    batches = [
        [("/t/-p/a.jsonl", "modify", at(50), line("new")), ("/t/-p/b.jsonl", "remove", at(50), None)],
        [("/t/-p/a.jsonl", "modify", at(10), line("old")), ("/t/-p/b.jsonl", "create", at(10), line("old"))],
    ]
    run(follow_versions(index, stream_of(spark, tmp_path, batches, CHANGES + ", content string")), spark)
    assert state(index) == {("/t/-p/a.jsonl", 0): "new"}


def test_bursts_merge_below_the_quiet_time_only(spark):
    rows = [("a.jsonl", "modify", at(t)) for t in (0, 700, 1449, 2199)]
    rows += [("b.jsonl", "create", at(0)), ("b.jsonl", "access", at(100)), ("c.txt", "modify", at(0))]
    changes = spark.createDataFrame(rows, CHANGES)
    found = quiet_files(transcript_changes(changes)).orderBy("file_path", "first_change").collect()
    assert [(r["file_path"], r["n_changes"]) for r in found] == [("a.jsonl", 3), ("a.jsonl", 1), ("b.jsonl", 1)]


def stream_of(spark, tmp_path, batches, schema):
    """A stream that reads one batch of rows per micro-batch."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"b={i}"))
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True)
    return reader.parquet(str(tmp_path / "in"))


def test_versions_are_upserted_batch_by_batch(spark, tmp_path):
    index = StoredIndex.create(talk(spark, []), TRANSCRIPTS, scratch_path(spark, "versions"), 2, 1)
    batches = [
        [("/t/-p/a.jsonl", "create", at(0), line("ant")), ("/t/-p/a.jsonl", "modify", at(5), line("ant") + "\n" + line("bee"))],
        [("/t/-p/b.jsonl", "create", at(9), line("cat")), ("/t/-p/x.txt", "create", at(9), line("no"))],
        [("/t/-p/a.jsonl", "modify", at(20), line("dog")), ("/t/-p/b.jsonl", "remove", at(21), None)],
    ]
    changes = stream_of(spark, tmp_path, batches, CHANGES + ", content string")
    run(follow_versions(index, changes), spark)
    assert state(index) == {("/t/-p/a.jsonl", 0): "dog"}


def test_quiet_files_are_read_from_storage(spark, tmp_path):
    root = tmp_path / "-srv-log-demo"
    root.mkdir()
    kept, gone = root / "a.jsonl", root / "gone.jsonl"
    kept.write_text(line("ant"))
    index = StoredIndex.create(talk(spark, ["old"], path=str(gone)), TRANSCRIPTS, scratch_path(spark, "quiet"), 2, 1)
    late = root / "late.jsonl"
    late.write_text(line("bee"))
    batches = [
        [(str(kept), "create", at(0)), (str(kept), "modify", at(300)), (str(gone), "remove", at(60_000))],
        [(str(late), "modify", at(-9_000_000))],  # later than any watermark would allow, and the last there is
    ]
    changes = stream_of(spark, tmp_path, batches, CHANGES)
    run_until_quiet(follow_files(index, changes, str(root), quiet_millis=300), spark, rows=4)
    assert state(index) == {(str(kept), 0): "ant", (str(late), 0): "bee"}
    assert index.documents().first()["project"] == "srv/log/demo"
    assert index.documents().filter(F.col("timestamp").isNotNull()).isEmpty()


def test_few_slots_of_one_task_are_written_as_several_files(spark):
    """A partition that is sorted and written doesn't grow with what the task before it read."""
    small = {
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2k",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k",
    }
    texts = [" ".join(f"w{(7 * i + j) % 400}" for j in range(60)) for i in range(40)]
    for key, value in small.items():
        spark.conf.set(key, value)
    try:
        index = StoredIndex.create(talk(spark, texts, path=FILES[0]), TRANSCRIPTS, scratch_path(spark, "fine"), 1, 1)
    finally:
        for key in small:
            spark.conf.unset(key)
    (part,) = index.parts()
    posted = index._read("postings", (part,))
    assert len(posted.inputFiles()) > 1
    per_file = posted.groupBy(F.input_file_name().alias("file")).agg(F.collect_list("hash").alias("all"))
    assert all(r["all"] == sorted(r["all"]) for r in per_file.collect())
    assert len(state(index)) == len(texts)
    hits = [search(i, "w3 w9").collect() for i in (index, DocumentScan(TRANSCRIPTS, talk(spark, texts, path=FILES[0])))]
    assert hits[0] == hits[1] and hits[0]


def test_rows_of_terms_are_sorted_in_partitions_of_bounded_size(spark, monkeypatch):
    """Whatever size the planner aims at elsewhere, which stays as it is set."""
    monkeypatch.setattr("loresift.plans.store.SORTED_BYTES", 2048, raising=False)
    name, least = "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.minPartitionSize"
    texts = [" ".join(f"w{(7 * i + j) % 400}" for j in range(60)) for i in range(40)]
    spark.conf.set(least, "1k")
    try:
        for aimed in (None, "64MB", "1g"):
            if aimed:
                spark.conf.set(name, aimed)
            index = StoredIndex.create(talk(spark, texts, path=FILES[0]), TRANSCRIPTS, scratch_path(spark, "sorted"), 1, 1)
            assert len(index._read("postings", index.parts()).inputFiles()) > 1
            assert spark.conf.get(name, None) == aimed
    finally:
        spark.conf.unset(least)
        spark.conf.unset(name)
    assert len(state(index)) == len(texts)


def test_postings_of_many_portions_equal_those_of_one(spark, monkeypatch):
    rows = [(["ant", "bee", "ant"], 3, 1), (None, None, 2), ([], 0, 3), (["cat"] * 5 + ["ant"], 6, 4)]
    schema = pa.schema([("tokens", pa.list_(pa.string())), ("dl", pa.int32()), ("key", pa.int64())])
    batch = pa.Table.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema=schema).to_batches()[0]

    def found():
        out = [r for b in postings._cut_runs(["key"])(iter([batch])) for r in b.to_pylist()]
        return sorted((r["key"], r["term"], r["tf"], tuple(r["positions"]), r["dl"]) for r in out)

    whole = [(1, "ant", 2, (0, 2), 3), (1, "bee", 1, (1,), 3), (4, "ant", 1, (5,), 6), (4, "cat", 5, (0, 1, 2, 3, 4), 6)]
    assert found() == whole
    monkeypatch.setattr(postings, "TOKENS", 1)
    monkeypatch.setattr(postings, "ROWS", 1)
    assert found() == whole


ODD_TEXTS = ["", None, "--", " ant  bee ", "É_é É", "İstanbul ΟΔΟΣ οδός ß", "a1 ½ 二三 x²", "😀ant😀", "\tant\x00bee\n", "᾿Α ﬁ Ǆ"]


def test_words_reach_the_workers_as_one_string_and_stay_the_same(spark):
    """The tokens of odd texts in order, by the rows that are made of them; no list of them is handed over."""
    rows = [(number, text) for number, text in enumerate(ODD_TEXTS)]
    documents = talk(spark, ["x"]).drop("event_index", "text").crossJoin(spark.createDataFrame(rows, "event_index long, text string"))
    made = postings.postings(documents, TRANSCRIPTS)
    assert "regexp_extract_all" not in made._jdf.queryExecution().optimizedPlan().toString()
    wanted = {r["event_index"]: r["tokens"] or [] for r in postings.tokenized(documents, TRANSCRIPTS).collect()}
    found = {number: {} for number in wanted}
    for row in made.collect():
        assert (row["tf"], row["dl"]) == (len(row["positions"]), len(wanted[row["event_index"]]))
        found[row["event_index"]] |= dict.fromkeys(row["positions"], row["term"])
    assert {number: [term for _, term in sorted(places.items())] for number, places in found.items()} == wanted


def test_what_a_replacement_hides_is_found_once(spark, index, tmp_path, monkeypatch):
    """The changed files are asked for once, and only terms are made of the rows they hide."""
    asked = str(tmp_path)

    def noting(batches):
        for number, batch in enumerate(batches):
            (Path(asked) / f"{number}-{time.time_ns()}").touch()
            yield batch

    made, carried = postings.postings, []

    def watching(documents, corpus, *rest):
        carried.append(corpus.filterable)
        return made(documents, corpus, *rest)

    monkeypatch.setattr(postings, "postings", watching)
    changed = paths(spark, *FILES[:2]).coalesce(1).mapInArrow(noting, "file_path string")
    before = {k: v for k, v in state_of_texts(index).items() if k[0] not in FILES[:2]}
    index.replace_files(talk(spark, ["dog"], path=FILES[0]), changed)
    assert len(list(tmp_path.iterdir())) == 1
    assert carried == [TRANSCRIPTS.filterable, ()]
    monkeypatch.setattr(postings, "postings", made)
    assert state(index) == {**before, (FILES[0], 0): "dog"}


def state_of_texts(index):
    return {(r["file_path"], r["event_index"]): r["text"] for r in index.documents().collect()}


def test_lines_of_many_files_are_handed_on_together(tmp_path, monkeypatch):
    class Blocks:
        """What the reading tasks run, caught."""

        def select(self, *names):
            return self

        def mapInArrow(self, function, schema):
            return function

    names = ["path", "file_path", "block", "lines_before"]
    for number in range(5):
        (tmp_path / f"{number}.jsonl").write_text("" if number == 3 else f"a{number}\n\nb{number}\n")
    files = [str(tmp_path / f"{number}.jsonl") for number in range(6)]  # the last is not there
    blocks = [pa.table([some, some, [0] * 3, [0] * 3], names=names).to_batches()[0] for some in (files[:3], files[3:])]
    read = jsonl._read_blocks(Blocks(), str(tmp_path), jsonl.BLOCK_BYTES, False)
    wanted = [(files[n], at, f"{letter}{n}") for n in (0, 1, 2, 4) for at, letter in ((0, "a"), (2, "b"))]
    for lines, size, batches in ((1 << 16, 1 << 22, 1), (3, 1 << 22, 3), (1 << 16, 4, 4)):
        monkeypatch.setattr(jsonl, "_READ_LINES", lines, raising=False)
        monkeypatch.setattr(jsonl, "_READ_BYTES", size)
        found = list(read(iter(blocks)))
        assert len(found) == batches
        assert [tuple(row.values()) for batch in found for row in batch.to_pylist()] == wanted
