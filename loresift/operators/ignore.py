"""Ignore rules as a table, and the files they leave.

A rule row holds ``base_dir`` (folder it counts from, ``''`` for the root),
``prefix`` (path from an outer rule file's folder to the root, else ``''``),
``precedence``, ``depth`` and ``seq`` (later, deeper and more specific rules
win, in that order), ``regex``, ``negated`` and ``dir_only``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loresift.functions.paths import file_name
from loresift.operators.skew import salted_join
from loresift.sources.tree import EXCLUDE_FILE, _open, read_contents

_RULE_ARROW = pa.schema(
    [
        ("base_dir", pa.string()),
        ("prefix", pa.string()),
        ("precedence", pa.int32()),
        ("depth", pa.int32()),
        ("seq", pa.int32()),
        ("regex", pa.string()),
        ("negated", pa.bool_()),
        ("dir_only", pa.bool_()),
    ]
)

# Rule files by rising precedence.
GLOBAL_RULES, EXCLUDE_RULES, GITIGNORE_RULES, IGNORE_RULES = 0, 1, 2, 3
RULE_FILES = {".gitignore": GITIGNORE_RULES, ".ignore": IGNORE_RULES}


_PARSED = T.StructType(
    [
        T.StructField("regex", T.StringType()),
        T.StructField("negated", T.BooleanType()),
        T.StructField("dir_only", T.BooleanType()),
    ]
)


def glob_to_regex(glob: str) -> str:
    """Regular expression for a rule's glob, over paths relative to its folder."""
    anchored = "/" in glob
    parts = re.split(r"(\*\*/|/\*\*$|\*|\?|\\.|\[[!^]?\]?[^\]]*\])", glob.removeprefix("/"))
    out = []
    for part in parts:
        if part == "**/":
            out.append("(?:.*/)?")
        elif part == "/**":
            out.append("/.+")
        elif part == "*":
            out.append("[^/]*")
        elif part == "?":
            out.append("[^/]")
        elif part.startswith("[") and part.endswith("]") and len(part) > 2:
            negated = part[1] in "!^"
            members = part[2 if negated else 1 : -1].replace("\\", r"\\").replace("[", r"\[").replace("&&", r"&\&")
            members = members if not members.startswith("]") else "\\" + members
            out.append(f"(?!/)[{'^' if negated else ''}{members}]")
        elif part.startswith("\\") and len(part) == 2:
            out.append(re.escape(part[1]))
        else:
            out.append(re.escape(part))
    return ("^" if anchored else "^(?:.*/)?") + "".join(out) + "$"


def parse_rule(line: str) -> tuple[str, bool, bool] | None:
    """``(regex, negated, dir_only)`` of one line of a rule file, None for no rule."""
    text = re.sub(r"(?<!\\)\s+$", "", line)
    if not text or text.startswith("#"):
        return None
    negated = text.startswith("!")
    text = text[1:] if negated else text
    dir_only = text.endswith("/")
    text = text.rstrip("/") if dir_only else text
    if not text:
        return None
    return glob_to_regex(text), negated, dir_only


def rules_table(spark: SparkSession, lines: list[str], base_dir: str = "", precedence: int = GITIGNORE_RULES,
                prefix: str = "", depth: int | None = None) -> DataFrame:
    """Rule rows of lines given as a list, such as those of a machine-wide rule file."""
    level = depth if depth is not None else (base_dir.count("/") + 1 if base_dir else 0)
    parsed = [(seq, parse_rule(line)) for seq, line in enumerate(lines)]
    rows = [(base_dir, prefix, precedence, level, seq, *rule) for seq, rule in parsed if rule]
    return _rule_rows(spark, rows)


def _rule_rows(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """From Arrow, which keeps a small table local and its size known to the planner."""
    columns = list(zip(*rows)) or [[] for _ in _RULE_ARROW]
    table = pa.table([pa.array(c, f.type) for c, f in zip(columns, _RULE_ARROW)], schema=_RULE_ARROW)
    return spark.createDataFrame(table)


@F.pandas_udf(_PARSED)
def _parse_rules(lines: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in lines:
        parsed = [parse_rule(line) or (None, None, None) for line in batch]
        yield pd.DataFrame(parsed, columns=["regex", "negated", "dir_only"])


def outer_rules(spark: SparkSession, root: str) -> tuple[DataFrame, bool]:
    """Rules of the folders above the root, and whether the root is in a repository."""
    filesystem, base = _open(root)
    in_repository = filesystem.get_file_info(base + "/.git").type != fs.FileType.NotFound
    rules = _rule_rows(spark, [])
    pending_git, found = [], in_repository
    folder, depth = base, 0
    while "/" in folder.strip("/"):
        folder, depth = folder.rsplit("/", 1)[0], depth - 1
        prefix = base.removeprefix(folder).lstrip("/") + "/"
        for name, precedence in RULE_FILES.items():
            path = f"{folder}/{name}"
            if filesystem.get_file_info(path).type != fs.FileType.File:
                continue
            with filesystem.open_input_stream(path) as stream:
                lines = stream.read().decode("utf-8", "replace").split("\n")
            table = rules_table(spark, lines, "", precedence, prefix, depth)
            if precedence == IGNORE_RULES:
                rules = rules.unionByName(table)
            elif not found:  # a repository's rules stop at its own root
                pending_git.append(table)
        if not found and filesystem.get_file_info(folder + "/.git").type != fs.FileType.NotFound:
            found = True
    if found and not in_repository:
        for table in pending_git:
            rules = rules.unionByName(table)
    return rules, found


def read_rules(listing: DataFrame, root: str, in_repository: bool) -> DataFrame:
    """Rules of the rule files in a listing.

    ``.gitignore`` and the repository's exclude file count only inside a repository.
    """
    name = file_name(F.col("rel_path"))
    names = list(RULE_FILES) if in_repository else [".ignore"]
    wanted = name.isin(names)
    if in_repository:
        wanted = wanted | (F.col("rel_path") == EXCLUDE_FILE)
    is_exclude = F.col("rel_path") == EXCLUDE_FILE
    folder = F.regexp_extract("rel_path", "^(.*)/[^/]*$", 1)
    files = read_contents(listing.filter(wanted), root).select(
        F.when(is_exclude, "").otherwise(folder).alias("base_dir"),
        F.when(is_exclude, EXCLUDE_RULES)
        .when(file_name(F.col("rel_path")) == ".ignore", IGNORE_RULES)
        .otherwise(GITIGNORE_RULES)
        .alias("precedence"),
        F.posexplode(F.split(F.col("content").cast("string"), "\r?\n")).alias("seq", "line"),
    )
    parsed = files.withColumn("rule", _parse_rules("line")).filter(F.col("rule.regex").isNotNull())
    return parsed.select(
        "base_dir",
        F.lit("").alias("prefix"),
        "precedence",
        F.when(F.col("base_dir") == "", 0).otherwise(F.size(F.split("base_dir", "/"))).alias("depth"),
        "seq",
        "rule.regex",
        "rule.negated",
        "rule.dir_only",
    )

def _folders_above(path: Column) -> Column:
    """The folders a path lies in, the root ``''`` first."""
    names = F.split(path, "/")
    return F.transform(
        F.sequence(F.lit(0), F.size(names) - 1), lambda n: F.array_join(F.slice(names, F.lit(1), n), "/")
    )


def ignored_nodes(nodes: DataFrame, rules: DataFrame) -> DataFrame:
    """Those of ``(node, is_dir)`` whose last matching rule is not a negation.

    Rules meet nodes by folder; the root folder holds every node, hence the salt.
    """
    in_folders = nodes.withColumn("base_dir", F.explode(_folders_above(F.col("node"))))
    met = salted_join(in_folders, rules, ["base_dir"], ["node"])
    below = F.when(F.col("base_dir") == "", F.concat("prefix", "node")).otherwise(
        F.substr("node", F.char_length("base_dir") + 2)
    )
    matching = met.filter((F.col("is_dir") | ~F.col("dir_only")) & F.rlike(below, F.col("regex")))
    last = matching.groupBy("node", "is_dir").agg(
        F.max_by("negated", F.struct("precedence", "depth", "seq")).alias("negated")
    )
    return last.filter(~F.col("negated")).select("node", "is_dir")


def drop_ignored(files: DataFrame, rules: DataFrame) -> DataFrame:
    """Files of which neither the path nor a folder above it is ignored."""
    placed = files.select("rel_path", F.explode(_folders_above(F.col("rel_path"))).alias("node"))
    inside = placed.filter(F.col("node") != "")
    folders = inside.select("node").distinct().withColumn("is_dir", F.lit(True))
    nodes = folders.unionByName(files.select(F.col("rel_path").alias("node"), F.lit(False).alias("is_dir")))
    ignored = ignored_nodes(nodes, rules)
    by_folder = salted_join(inside, ignored.filter("is_dir").select("node"), ["node"], ["rel_path"], "left_semi")
    by_name = ignored.filter(~F.col("is_dir")).select(F.col("node").alias("rel_path"))
    dropped = by_folder.select("rel_path").unionByName(by_name)
    return files.join(dropped, "rel_path", "left_anti").select(*files.columns)
