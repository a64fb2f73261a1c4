from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from loresift.operators.transcripts import extract_documents
from loresift.sources.jsonl import list_transcripts, read_lines, read_lines_of, split_lines

PATH = "/var/logs/-srv-team-harbour/k7.jsonl"


def extract(spark, *lines):
    rows = [(PATH, i, line if isinstance(line, str) else json.dumps(line)) for i, line in enumerate(lines)]
    found = extract_documents(spark.createDataFrame(rows, "file_path string, event_index bigint, line string"))
    at = F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return {r["event_index"]: r for r in found.withColumn("timestamp", at).collect()}


def message(content, **fields):
    return {"type": "user", "message": {"content": content}, **fields}


def test_user_message(spark):
    line = message("paint the fence", sessionId="k7", timestamp="2025-11-03T08:09:10Z", cwd="/w", gitBranch="trunk")
    row = extract(spark, line)[0]
    assert row["session_id"] == "k7"
    assert row["event_role"] == "user"
    assert row["text"] == "paint the fence"
    assert (row["cwd"], row["git_branch"]) == ("/w", "trunk")
    assert row["timestamp"] == "2025-11-03 08:09:10.000000"
    assert row["project"] == "srv/team/harbour"
    assert row["file_path"] == PATH


def test_content_blocks(spark):
    blocks = [
        "plain",
        {"type": "text", "text": "shown"},
        {"type": "thinking", "thinking": "tide first, then wind"},
        {"name": "Read", "input": {"path": "/a b", "line": 3}},
        {"name": "NoInput"},
        {"name": "Null", "input": None},
        {"name": 5, "input": "dropped", "text": 7},
        {"text": "both", "thinking": "kinds"},
        12,
    ]
    row = extract(spark, message(blocks))[0]
    assert row["text"].split("\n") == [
        "plain",
        "shown",
        "tide first, then wind",
        "[tool: Read]",
        '{"line":3,"path":"/a b"}',
        "[tool: NoInput]",
        "[tool: Null]",
        "null",
        "both",
        "kinds",
    ]


def test_attachments(spark):
    def attachment(**fields):
        return {"type": "attachment", "attachment": fields}

    found = extract(
        spark,
        attachment(content="14 boats", stdout="moored\n", stderr=""),
        attachment(content="", stdout="x"),
        attachment(stdout="", stderr="err"),
        attachment(stdout=""),
    )
    assert {i: r["text"] for i, r in found.items()} == {0: "14 boats\nmoored\n", 1: "\nx", 2: "err"}


def test_lines_without_text_give_no_document(spark):
    found = extract(
        spark,
        {"type": "weather-note", "sessionId": "s", "gauge": 7},
        "{unclosed: [",
        message("   \n "),
        message({"text": "an object"}),
        {"message": {"content": "no type"}},
        "[]",
        {"type": "user"},
        message(""),
    )
    assert found == {}


def test_fields_of_the_wrong_type_count_as_absent(spark):
    row = extract(spark, message("x", sessionId=5, cwd={"a": 1}, gitBranch=None, timestamp=1700000000))[0]
    assert (row["session_id"], row["cwd"], row["git_branch"], row["timestamp"]) == ("", None, None, None)
    assert extract(spark, {"type": 5, "message": {"content": "x"}}) == {}


def test_timestamps(spark):
    values = ["2023-02-17T21:05:40.987654321+02:00", "2023-02-17", "yesterday", "2023-02-17T21:05:40"]
    found = extract(spark, *[message("x", timestamp=v) for v in values])
    assert [found[i]["timestamp"] for i in range(4)] == ["2023-02-17 19:05:40.987654", None, None, None]


def test_last_of_repeated_keys_wins(spark):
    assert extract(spark, '{"type":"user","type":"assistant","message":{"content":"x"}}')[0]["event_role"] == "assistant"


LINES = b'first\r\n\n  \n\xff\xfebad\nlast "\xc3\xa9"'


@pytest.mark.parametrize("limit", [1 << 20, 7, 1])
def test_lines_keep_their_physical_number(spark, tmp_path, limit):
    """Blocks of any size agree: blank and undecodable lines are left out but counted."""
    folder = tmp_path / "a b" / "-p"
    folder.mkdir(parents=True)
    (folder / "one+1.jsonl").write_bytes(LINES)
    (folder / "two.jsonl").write_bytes(b"")
    (folder / "three.JSONL").write_bytes(b"not listed")
    found = read_lines(spark, str(tmp_path), limit).orderBy("event_index").collect()
    assert [(r["event_index"], r["line"]) for r in found] == [(0, "first"), (4, 'last "é"')]
    assert {r["file_path"] for r in found} == {str(folder / "one+1.jsonl")}


@pytest.mark.parametrize("limit", [1 << 20, 5])
def test_names_and_marks_leave_out_no_line(spark, tmp_path, limit):
    names = ["a.jsonl", "_b.jsonl", ".c.jsonl", "_d/e.jsonl", ".f/g.jsonl", "h/i.jsonl"]
    for name in names:
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"\xef\xbb\xbffirst\nsecond")
    found = read_lines(spark, str(tmp_path), limit).collect()
    assert {(r["file_path"].removeprefix(f"{tmp_path}/"), r["event_index"], r["line"]) for r in found} == {
        (name, *line) for name in names for line in ((0, "\ufefffirst"), (1, "second"))
    }


def test_a_large_file_is_read_in_blocks(spark, tmp_path):
    lines = [f"line {i} " + "x" * (i % 50) for i in range(40000)]
    (tmp_path / "big.jsonl").write_text("\n".join(lines) + "\n")
    found = {r["event_index"]: r["line"] for r in read_lines(spark, str(tmp_path), 65536).collect()}
    assert found == dict(enumerate(lines))


@pytest.mark.parametrize("limit", [100, 4, 1])
def test_lines_of_named_files(spark, tmp_path, limit):
    (tmp_path / "a.jsonl").write_text("1\n\n3")
    (tmp_path / "b.jsonl").write_text("12345\n6")
    (tmp_path / "c.jsonl").write_text("not asked for")
    names = [(str(tmp_path / n),) for n in ("a.jsonl", "b.jsonl", "gone.jsonl")]
    found = read_lines_of(spark.createDataFrame(names, "file_path string"), str(tmp_path), limit).collect()
    lines = {(r["file_path"].rsplit("/", 1)[1], r["event_index"], r["line"]) for r in found}
    assert lines == {("a.jsonl", 0, "1"), ("a.jsonl", 2, "3"), ("b.jsonl", 0, "12345"), ("b.jsonl", 1, "6")}


def test_listing_has_sizes_and_times(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("12345")
    row = list_transcripts(spark, str(tmp_path)).first()
    assert (row["file_path"], row["size_bytes"]) == (str(tmp_path / "a.jsonl"), 5)
    assert row["mtime"] is not None


def test_split_lines_of_a_column(spark):
    frame = spark.createDataFrame([("f", "a\n\nb")], "file_path string, value string")
    assert [(r["event_index"], r["line"]) for r in split_lines(frame).collect()] == [(0, "a"), (2, "b")]


class Faulty:
    """A store whose files fail on opening, or after the first read."""

    def __init__(self, error, on_open=False):
        self.error, self.on_open, self.reads = error, on_open, 0

    def open_input_file(self, path):
        if self.on_open:
            raise self.error
        return self

    def __enter__(self):
        return self

    def __exit__(self, *_):
        return None

    def seek(self, at):
        return at

    def read(self, size):
        self.reads += 1
        if self.reads > 1:
            raise self.error
        return b"x\n" * 10


def test_only_files_that_are_gone_are_passed_over(spark, tmp_path):
    from loresift.sources import jsonl

    for error in (FileNotFoundError(2, "x"), PermissionError(13, "x")):
        assert jsonl._lines_begun(Faulty(error, on_open=True), "x", 0, 100) is None
    for on_open in (True, False):
        with pytest.raises(OSError, match="storage"):
            jsonl._lines_begun(Faulty(OSError(5, "storage"), on_open), "x", 0, 100)
    (tmp_path / "a.jsonl").write_text("".join(f"line {i}\n" for i in range(50)))
    files = [(str(tmp_path / n), str(tmp_path / n), 400) for n in ("a.jsonl", "gone.jsonl")]
    listed = spark.createDataFrame(files, "path string, file_path string, size_bytes bigint")
    for size in (64, 1000):
        got = sorted((r.event_index, r.line) for r in jsonl._numbered(listed, str(tmp_path), size).collect())
        assert got == [(i, f"line {i}") for i in range(50)]
