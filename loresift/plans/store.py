"""A stored index: documents, postings, dictionary and statistics as Parquet tables that only grow.

Every write adds one part to each table and names it in the table of commits
last, so a reader sees all of it or nothing. A part has a generation number and
a list of replaced keys: a key that a generation replaces hides the rows with
that key in earlier ones, and readers take such rows out by an anti-join. So a
replacement writes in proportion to what it replaces and by.

Dictionary and statistics of a part are signed: what its documents add, less
what the rows it hides held. Adding them up gives those of the live documents.

Postings and dictionary are laid out by a hash of the term. A table of
fences tells which files hold which slots of it, so a lookup opens the files of its terms
and lists no folders. Readers may pin what they see; merging parts of like size
leaves the files of others alone. There is one writer at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce
from typing import NamedTuple

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loresift.functions.paths import all_of
from loresift.operators import postings as build
from loresift.schema import CODE, TRANSCRIPTS, Corpus
from loresift.session import configure, let_go, partitions_of, settled, write_parquet

#: Folders of the documents, by a hash of the path; a hit's text is read from its own.
DOC_BUCKETS = 4
#: Slots of terms; files hold many, a file's fence names them.
TERM_BUCKETS = 1024
#: Rows of terms are dealt by at least so many ranges of hashes when they are written.
FINE_SLOTS = 1024
#: Bytes of text that one task makes postings of, which are many times as large.
POSTED_BYTES = 8 << 20
#: Bytes of text whose postings are shuffled at a time, some times as large, however much text a part holds.
PORTION_BYTES = 256 << 20
#: Bytes that the planner makes a task's share of rows of terms; in memory, where they are sorted, they are many times as large.
SORTED_BYTES = 16 << 20
#: Parts are merged with newer ones that hold at least a half as many rows in all.
LIKE_SIZE = 2

_COMMITS = (
    "seq bigint, gen bigint, run string, n_docs bigint, n_replaced bigint, n_listed bigint, removed array<string>, "
    "corpus string, doc_buckets int, term_buckets int"
)
_TABLES = ("documents", "postings", "dictionary", "stats", "replaced", "manifest", "fences")


def path_bucket(path: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(path), F.lit(buckets)).cast("int")


class Part(NamedTuple):
    """What one write added."""

    gen: int
    run: str
    n_docs: int = 0
    n_replaced: int = 0
    n_listed: int = 0

    @property
    def folder(self) -> str:
        return f"gen={self.gen}/run={self.run}"

    @property
    def size(self) -> int:
        return self.n_docs + self.n_replaced


@dataclass
class IndexView:
    """The index as certain parts make it up."""

    spark: SparkSession
    root: str
    corpus: Corpus
    doc_buckets: int
    term_buckets: int
    pinned_parts: tuple[Part, ...] = ()

    def parts(self) -> tuple[Part, ...]:
        """The parts that count, oldest first."""
        return self.pinned_parts

    def pinned(self) -> IndexView:
        """The index as it is now, whatever is committed later."""
        return IndexView(self.spark, self.root, self.corpus, self.doc_buckets, self.term_buckets, self.parts())

    # -- tables --------------------------------------------------------------

    def _schema(self, table: str) -> str:
        """Declared, so that no file is opened to find it out and an empty table still reads."""
        corpus = self.corpus
        types = {"event_index": "bigint", "timestamp": "timestamp", "size_bytes": "bigint"}

        def columns(names) -> list[str]:
            return [f"{name} {types.get(name, 'string')}" for name in names]

        own = {
            "documents": [*columns(corpus.carried), f"{corpus.text} string"],
            "postings": [*columns(corpus.filterable), "term string", "tf int", "positions array<int>", "dl int", "hash bigint"],
            "dictionary": [*columns(corpus.scope), "term string", "df bigint", "hash bigint"],
            "stats": [*columns(corpus.scope), "n_docs bigint", "sum_dl bigint"],
            "replaced": [*columns(corpus.unit), "until bigint", "ts timestamp"],
            "manifest": ["file_path string", "mtime timestamp", "size_bytes bigint"],
            "fences": ["of string", "slot int", "file string"],
        }[table]
        tail = ["bucket int"] if table == "documents" else []
        return ", ".join([*own, "gen bigint", "run string", *tail])

    def _read(self, table: str, parts: tuple[Part, ...] | None = None, files: list[str] | None = None) -> DataFrame:
        """A table's rows in some parts, or in some files of it."""
        if files is None:
            parts = self.parts() if parts is None else parts
            counted = {"documents": "n_docs", "postings": "n_docs", "replaced": "n_replaced", "manifest": "n_listed"}
            files = [p.folder for p in parts if table not in counted or getattr(p, counted[table])]
        if not files:
            return self.spark.createDataFrame([], self._schema(table))
        base = f"{self.root}/{table}"
        return self.spark.read.schema(self._schema(table)).option("basePath", base).parquet(*[f"{base}/{f}" for f in files])

    def _hidden(self, parts: tuple[Part, ...]) -> DataFrame | None:
        """The replaced keys with the generation ``until`` which they are hidden, None if there are none."""
        later = parts[1:]  # nothing is older than the first part
        if not any(p.n_replaced for p in later):
            return None
        return self._read("replaced", later).groupBy(*self.corpus.unit).agg(F.max("until").alias("until"))

    def _live(self, rows: DataFrame, parts: tuple[Part, ...]) -> DataFrame:
        """Rows that no later generation has replaced. The planner broadcasts the keys only if they are few bytes."""
        hidden = self._hidden(parts)
        if hidden is None:
            return rows
        old = hidden.withColumnsRenamed({c: f"old_{c}" for c in self.corpus.unit})
        same = [F.col(c) == F.col(f"old_{c}") for c in self.corpus.unit]
        return rows.join(old, all_of([*same, F.col("gen") < F.col("until")]), "left_anti")

    def _documents(self) -> DataFrame:
        parts = self.parts()
        return self._live(self._read("documents", parts), parts)

    def documents(self) -> DataFrame:
        return self._documents().select(*self.corpus.carried, self.corpus.text)

    def postings(self) -> DataFrame:
        parts = self.parts()
        rows = self._live(self._read("postings", parts), parts)
        return rows.select(*self.corpus.filterable, "term", "tf", "positions", "dl")

    def count_scopes(self) -> int | None:
        """Number of statistics scopes; the table read for it has a row per scope and part."""
        return self.stats().count()

    def stats(self) -> DataFrame:
        found = self._read("stats").groupBy(*self.corpus.scope).agg(
            F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n_docs"),
            F.coalesce(F.sum("sum_dl"), F.lit(0)).alias("sum_dl"),
        )
        return found.filter("n_docs > 0") if self.corpus.scope else found

    def _added_up(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(*self.corpus.scope, "term").agg(F.sum("df").alias("df")).filter("df > 0")

    def dictionary(self) -> DataFrame:
        return self._added_up(self._read("dictionary"))

    def dictionary_of(self, terms: DataFrame) -> DataFrame:
        return self._added_up(self._read("dictionary").join(terms, "term", "left_semi"))

    # -- lookups ---------------------------------------------------------------

    def _slot(self, term: Column) -> Column:
        return build.term_bucket(term, self.term_buckets)

    def _files_of(self, terms: list[str], parts: tuple[Part, ...]) -> dict[str, list[str]]:
        """The files of postings and dictionary that may hold a term: names only, as many as a lookup has to open.

        A pinned view looks once for the terms of a query.
        """
        seen = self.__dict__.setdefault("_seen", {}) if self.pinned_parts else {}
        if (key := tuple(sorted(terms))) in seen:
            return seen[key]
        fences = self._read("fences", parts).filter(F.col("slot").isin(*[self._slot(F.lit(t)) for t in terms]))
        found: dict[str, list[str]] = {"postings": [], "dictionary": []}
        for row in fences.select("of", "file").distinct().collect():
            found[row["of"]].append(row["file"])
        seen[key] = found
        return found

    def _lookup(self, table: str, terms: list[str], parts: tuple[Part, ...]) -> DataFrame:
        """Rows of literal terms, from the files whose fences hold them, by a pushed-down ``IN``.

        Rows lie in the order of their terms' hashes; older parts have none and lie by slot and term.
        """
        if not terms:
            return self._read(table, files=[]).filter(F.lit(False))
        near = F.col("hash").isin(*[build.term_hash(F.lit(t)) for t in terms]) | F.col("hash").isNull()
        return self._read(table, files=self._files_of(terms, parts)[table]).filter(F.col("term").isin(*terms) & near)

    def term_stats(self, terms: list[str], within: Column | None) -> DataFrame:
        """One row per scope: ``n_docs``, ``avg_dl`` and ``df_<i>`` of the i-th term."""
        scope, parts = list(self.corpus.scope), self.parts()
        counts = [
            F.coalesce(F.sum(F.when(F.col("term") == t, F.col("df"))), F.lit(0)).alias(f"df_{i}")
            for i, t in enumerate(terms)
        ]
        stats, found = self._read("stats", parts), self._lookup("dictionary", terms, parts)
        if within is not None:
            stats, found = stats.filter(within), found.filter(within)
        sizes = stats.groupBy(*scope).agg(
            F.sum("n_docs").alias("n_docs"), (F.try_divide(F.sum("sum_dl"), F.sum("n_docs"))).alias("avg_dl")
        )
        names = [f"df_{i}" for i in range(len(terms))]
        frequencies = found.groupBy(*scope).agg(*counts)
        if scope:
            return sizes.join(frequencies, scope, "left").fillna(0, names)
        packed = sizes.withColumn("found", frequencies.select(F.struct(*names)).scalar())
        return packed.select("n_docs", "avg_dl", *[F.col(f"found.{n}") for n in names])

    def candidates(self, terms: list[str], phrase_terms: set[str], where: Column) -> DataFrame:
        """Documents with ``dl`` and, per term, ``tf_<i>`` and where needed ``pos_<i>``.

        Reads the postings of these terms only, and filters on the field copies
        they carry. Positions are read only for phrases.
        """
        columns = []
        for i, term in enumerate(terms):
            own = F.col("term") == term
            if term in phrase_terms:
                positions = F.first(F.when(own, F.col("positions")), ignorenulls=True)
                columns.append(F.coalesce(positions, F.array().cast("array<int>")).alias(f"pos_{i}"))
            columns.append(F.coalesce(F.sum(F.when(own, F.col("tf"))), F.lit(0)).alias(f"tf_{i}"))
        parts = self.parts()
        found = self._live(self._lookup("postings", terms, parts).filter(where), parts)
        return found.groupBy(*self.corpus.keys).agg(F.max("dl").alias("dl"), *columns)

    def _located(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", path_bucket(F.col("file_path"), self.doc_buckets))

    def with_documents(self, hits: DataFrame, hits_bounded: bool) -> DataFrame:
        """Add text and fields to hits; with few hits only their folders are read."""
        located = self._located(hits)
        small = F.broadcast(located) if hits_bounded else located
        found = small.join(self._documents(), [*self.corpus.keys, "bucket"])
        return found.drop("bucket", "gen", "run")

    # -- summaries ---------------------------------------------------------

    def manifest(self) -> DataFrame:
        """``(file_path, mtime, size_bytes)`` of the files as they were listed when they were read."""
        last = self._read("manifest").groupBy("file_path").agg(F.max_by(F.struct("mtime", "size_bytes"), "gen").alias("last"))
        return last.select("file_path", "last.mtime", "last.size_bytes").filter("size_bytes IS NOT NULL")

    def summary(self) -> DataFrame:
        """Number of documents and files held, and for code their bytes. Files without documents count if they were listed."""
        files = F.count_distinct(*[c for c in self.corpus.keys if c != "event_index"])
        if any(p.n_listed for p in self.parts()):
            return self.stats().select(F.col("n_docs").alias("n_documents"), self.manifest().select(F.count("*")).scalar().alias("n_files"))
        columns = [F.count("*").alias("n_documents"), files.alias("n_files")]
        if self.corpus is CODE:
            columns.append(F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("n_bytes"))
        return self.documents().agg(*columns)

    def has_documents(self) -> bool:
        return not self.stats().filter("n_docs > 0").isEmpty()

    def applied_versions(self) -> DataFrame:
        """``(file_path, ts)`` of the newest version that streams have applied to each file."""
        noted = self._read("replaced").filter(F.col("ts").isNotNull())
        return noted.groupBy("file_path").agg(F.max("ts").alias("ts"))


class StoredIndex(IndexView):
    """Open with :meth:`open`, make with :meth:`create`. Each read sees what is committed by then."""

    def __init__(self, spark: SparkSession, root: str, corpus: Corpus, doc_buckets: int, term_buckets: int):
        super().__init__(configure(spark), root.rstrip("/"), corpus, doc_buckets, term_buckets)

    # -- making and opening ------------------------------------------------

    @classmethod
    def create(
        cls,
        documents: DataFrame,
        corpus: Corpus,
        root: str,
        doc_buckets: int = DOC_BUCKETS,
        term_buckets: int = TERM_BUCKETS,
    ) -> StoredIndex:
        """Write a new index of ``documents`` below ``root``."""
        index = cls(documents.sparkSession, root, corpus, doc_buckets, term_buckets)
        if index._commits() is not None:
            raise ValueError(f"there is an index in {root} already")
        index._add(documents, None, None)
        return index

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> StoredIndex:
        commits = cls(spark, root, TRANSCRIPTS, DOC_BUCKETS, TERM_BUCKETS)._commits()
        if not commits:
            raise ValueError(f"there is no index in {root}")
        corpus = {c.name: c for c in (TRANSCRIPTS, CODE)}[commits[0]["corpus"]]
        return cls(spark, root, corpus, commits[0]["doc_buckets"], commits[0]["term_buckets"])

    # -- commits -------------------------------------------------------------

    def _commits(self) -> list | None:
        """A row per commit, in order; None if there is no index."""
        try:
            return sorted(self.spark.read.schema(_COMMITS).json(f"{self.root}/commits").collect(), key=lambda c: c["seq"])
        except AnalysisException as problem:
            if problem.getCondition() == "PATH_NOT_FOUND":
                return None
            raise

    def parts(self) -> tuple[Part, ...]:
        found: dict[str, Part] = {}
        for commit in self._commits() or ():
            for run in commit["removed"]:
                del found[run]
            found[commit["run"]] = Part(**{name: commit[name] for name in Part._fields})
        return tuple(sorted(found.values()))

    def _commit(self, part: Part, removed: list[str]) -> None:
        """One row in one file, which appears by a rename: the write counts from here on."""
        row = {
            "seq": [max([c["seq"] for c in self._commits() or ()], default=0) + 1], **{k: [v] for k, v in part._asdict().items()},
            "removed": pa.array([removed], pa.list_(pa.string())), "corpus": [self.corpus.name],
            "doc_buckets": [self.doc_buckets], "term_buckets": [self.term_buckets],
        }
        self.spark.createDataFrame(pa.table(row)).coalesce(1).write.mode("append").json(f"{self.root}/commits")

    # -- writing -------------------------------------------------------------

    def _write(
        self, table: str, part: Part, rows: DataFrame, by: str | None = None, order: tuple[str, ...] = (), mode: str = "errorifexists"
    ) -> DataFrame:
        """Write a table's part, or with ``append`` more of it, and read it back.

        The rebalance lets the adaptive planner merge small partitions and
        split large ones, such as a very common term's slot; each is sorted for
        the readers' min/max tests.
        """
        if by:
            rows = rows.hint("rebalance", by).sortWithinPartitions(by, *order)
        folders = ["bucket"] if table == "documents" else []
        write_parquet(rows, f"{self.root}/{table}/{part.folder}", *folders, mode=mode)
        return self._read(table, files=[part.folder])

    def _write_by_term(self, table: str, part: Part, rows: DataFrame, mode: str = "errorifexists") -> DataFrame:
        """Write rows of terms in the order of their hashes, which one number sorts.

        They are dealt by slots, or by finer ones where slots are few, so that a
        partition doesn't grow with what a single task before it read. The
        planner's partitions are made smaller for it where they are larger.
        """
        finer = self.term_buckets * -(-FINE_SLOTS // self.term_buckets)
        hashed = rows.withColumn("hash", build.term_hash(F.col("term")))
        dealt = hashed.withColumn("_dealt", build.hash_bucket(F.col("hash"), finer)).hint("rebalance", "_dealt")
        with partitions_of(rows.sparkSession, SORTED_BYTES):
            return self._write(table, part, dealt.drop("_dealt").sortWithinPartitions("hash"), mode=mode)

    def _write_fences(self, part: Part, **tables: DataFrame) -> None:
        slot = build.hash_bucket(F.col("hash"), self.term_buckets).alias("slot")
        # the name alone, as it is compared once a row
        found = [
            rows.select(slot, F.col("_metadata.file_name").alias("name")).distinct().select(F.lit(of).alias("of"), "slot", "name")
            for of, rows in tables.items()
        ]
        file = F.concat(F.lit(f"{part.folder}/"), "name")
        self._write("fences", part, found[0].union(found[1]).select("of", "slot", file.alias("file")), "slot")

    def _posted(self, documents: DataFrame, corpus: Corpus | None = None) -> Iterator[DataFrame]:
        """Postings of a table of documents, a portion of its files at a time; no two hold rows of the same document.

        Postings are some times as large as their text. Who shuffles those of a
        portion before the next needs disk for one, however many there are. The
        documents of a portion are dealt by their keys to tasks of so many bytes
        of text, as a task that read one whole file would hold all its postings.
        """
        name = F.col("_metadata.file_path")
        size = F.coalesce(F.sum(F.octet_length(self.corpus.text)), F.lit(0))
        sizes = sorted(map(tuple, documents.groupBy(name.alias("name")).agg(size.alias("size")).collect()))  # a row a file
        portions: list[list[tuple[str, int]]] = [[]]
        for file in sizes:
            if portions[-1] and sum(n for _, n in portions[-1]) + file[1] > PORTION_BYTES:
                portions.append([])
            portions[-1].append(file)
        for files in portions:
            mine = documents if len(portions) == 1 else documents.filter(name.isin(*[f for f, _ in files]))
            tasks = max(1, -(-sum(n for _, n in files) // POSTED_BYTES))
            yield build.postings(mine.repartition(tasks, *self.corpus.keys), corpus or self.corpus)

    def _hidden_terms(self, hidden: DataFrame) -> DataFrame:
        """Of live rows that go: per scope and term ``df`` and the occurrences ``tf``, which add up. Texts are tokenised once for both."""
        counted = replace(self.corpus, keys=self.corpus.scope, fields=())  # nothing else is copied onto their postings
        found = [
            settled(rows.groupBy(*self.corpus.scope, "term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf")), "hidden-terms")
            for rows in self._posted(hidden, counted)
        ]
        return reduce(DataFrame.union, found)

    def _add(
        self, documents: DataFrame, replaced: DataFrame | None, hidden: DataFrame | None, listed: DataFrame | None = None
    ) -> None:
        """Add a part with ``documents`` that replaces the keys in ``replaced``; ``hidden`` are the live rows it hides.

        ``listed`` are the manifest's rows of the files, without a size if a file is gone.
        """
        corpus, parts = self.corpus, self.parts()
        part = Part(max([p.gen for p in parts], default=0) + 1, uuid.uuid4().hex)
        mine = documents.select(*corpus.carried, corpus.text)
        stored = self._write("documents", part, self._located(mine), "bucket", corpus.keys)
        n_docs = stored.count()  # from the files' footers
        keys = replaced.select(*corpus.unit, F.lit(part.gen).alias("until"), "ts") if replaced is not None else None
        n_replaced = 0
        if keys is not None:
            n_replaced = self._write("replaced", part, keys, corpus.unit[0]).count()
        n_listed = 0
        if listed is not None:
            n_listed = self._write("manifest", part, listed.select("file_path", "mtime", "size_bytes"), "file_path").count()

        for rows in self._posted(stored):
            posted = self._write_by_term("postings", part, rows, mode="append")
        # counted and sorted one after the other, so that what is shuffled for the one is gone by the other
        scratch = [settled(build.dictionary(posted.select(*corpus.scope, "term"), corpus.scope), "terms")]
        sums = [
            stored.groupBy(*corpus.scope).agg(F.count("*").alias("n_docs"), F.lit(0).alias("sum_dl")),
            posted.groupBy(*corpus.scope).agg(F.lit(0).alias("n_docs"), F.sum("tf").alias("sum_dl")),
        ]
        if hidden is not None:
            # found once: they are measured, tokenised and counted
            hidden = settled(hidden.select(*corpus.keys, corpus.text), "hidden")
            less = self._hidden_terms(hidden)
            terms = scratch[0].unionByName(less.select(*corpus.scope, "term", (-F.col("df")).alias("df")))
            scratch += [hidden, less, settled(terms.groupBy(*corpus.scope, "term").agg(F.sum("df").alias("df")), "terms")]
            sums.append(hidden.groupBy(*corpus.scope).agg((-F.count("*")).alias("n_docs"), F.lit(0).alias("sum_dl")))
            sums.append(less.groupBy(*corpus.scope).agg(F.lit(0).alias("n_docs"), (-F.sum("tf")).alias("sum_dl")))
        stats = reduce(DataFrame.unionByName, sums).groupBy(*corpus.scope)
        stats = stats.agg(F.sum("n_docs").alias("n_docs"), F.coalesce(F.sum("sum_dl"), F.lit(0)).alias("sum_dl"))
        named = self._write_by_term("dictionary", part, scratch[-1].filter("df <> 0"))
        self._write("stats", part, stats.coalesce(1))
        self._write_fences(part, postings=posted, dictionary=named)
        self._commit(part._replace(n_docs=n_docs, n_replaced=n_replaced, n_listed=n_listed), [])
        let_go(*scratch)

    # -- replacing ---------------------------------------------------------

    def replace_files(self, documents: DataFrame, changed: DataFrame, listed: DataFrame | None = None) -> None:
        """Replace what is held of the files in ``changed`` by ``documents``.

        A changed file without new documents disappears. Doing it twice is the
        same as doing it once. A column ``ts`` of ``changed`` is kept as the
        version that is applied now, ``listed`` as the files' manifest.
        """
        if self.corpus is not TRANSCRIPTS:
            raise ValueError("files are replaced in transcripts; replace a branch of code")
        ts = F.col("ts") if "ts" in changed.columns else F.lit(None).cast("timestamp")
        keys = settled(changed.select("file_path", ts.alias("ts")).groupBy("file_path").agg(F.max("ts").alias("ts")), "changed")
        if keys.isEmpty():
            let_go(keys)
            return
        # on the bucket too, so that few changed files read only their folders
        hidden = self._documents().join(self._located(keys).drop("ts"), ["file_path", "bucket"], "left_semi")
        self._add(documents, keys, hidden, listed)
        let_go(keys)

    def replace_branch(self, documents: DataFrame, repo: str, branch: str) -> None:
        """Replace everything held of a repository branch by ``documents``."""
        if self.corpus is not CODE:
            raise ValueError("branches are replaced in code; replace files of transcripts")
        mine = (F.col("repo") == repo) & (F.col("branch") == branch)
        keys = {"repo": [repo], "branch": [branch], "ts": pa.array([None], pa.timestamp("us", tz="UTC"))}
        self._add(documents.filter(mine), self.spark.createDataFrame(pa.table(keys)), self._documents().filter(mine))

    def prune(self, listing: DataFrame) -> None:
        """Drop the transcripts that are no longer in ``listing``."""
        held = self.documents().select("file_path").distinct()
        gone = held.join(listing.select("file_path"), "file_path", "left_anti")
        forgotten = gone.select("file_path", F.lit(None).cast("timestamp").alias("mtime"), F.lit(None).cast("bigint").alias("size_bytes"))
        known = any(p.n_listed for p in self.parts())
        self.replace_files(self.documents().filter(F.lit(False)), gone, forgotten if known else None)

    # -- merging -------------------------------------------------------------

    def compact(self, everything: bool = False) -> int:
        """Merge the newest parts as far back as sizes are alike; returns how many were merged.

        Older, larger parts stay as they lie. Rows that were replaced and
        entries that add up to nothing go.
        """
        parts = self.parts()
        first = 0 if everything else len(parts) - 1
        while first and parts[first - 1].size <= LIKE_SIZE * sum(p.size for p in parts[first:]):
            first -= 1
        run = parts[first:]
        if len(run) < 2:
            return 0
        corpus = self.corpus
        part = Part(run[-1].gen, uuid.uuid4().hex)
        live = {t: self._live(self._read(t, run), parts).drop("gen", "run") for t in ("documents", "postings")}
        stored = self._write("documents", part, live["documents"], "bucket", corpus.keys)
        posted = self._write_by_term("postings", part, live["postings"])
        sums = self._read("dictionary", run).groupBy(*corpus.scope, "term").agg(F.sum("df").alias("df"))
        named = self._write_by_term("dictionary", part, sums.filter("df <> 0"))
        stats = self._read("stats", run).groupBy(*corpus.scope)
        stats = stats.agg(F.sum("n_docs").alias("n_docs"), F.sum("sum_dl").alias("sum_dl"))
        self._write("stats", part, stats.coalesce(1))
        kept = self._read("replaced", run).groupBy(*corpus.unit)
        kept = kept.agg(F.max("until").alias("until"), F.max("ts").alias("ts"))
        if not first:  # nothing older is left to hide; versions are still asked for
            kept = kept.filter("ts IS NOT NULL")
        n_replaced = self._write("replaced", part, kept, corpus.unit[0]).count()
        files = self._read("manifest", run).groupBy("file_path")
        files = files.agg(F.max_by(F.struct("mtime", "size_bytes"), "gen").alias("last")).select("file_path", "last.*")
        n_listed = self._write("manifest", part, files, "file_path").count()
        self._write_fences(part, postings=posted, dictionary=named)
        counts = {"n_docs": stored.count(), "n_replaced": n_replaced, "n_listed": n_listed}
        self._commit(part._replace(**counts), [p.run for p in run])
        return len(run)

    def clean_up(self) -> None:
        """Empty the folders of merged parts, which readers that pinned them can no longer read then."""
        commits = self._commits() or []
        folder = {c["run"]: Part(c["gen"], c["run"]).folder for c in commits}
        nothing = self.spark.createDataFrame([], "nothing int")
        for run in [r for c in commits for r in c["removed"]]:
            for table in _TABLES:
                nothing.write.mode("overwrite").parquet(f"{self.root}/{table}/{folder[run]}")
