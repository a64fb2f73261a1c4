"""Source files to documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loresift.functions.paths import MAX_FILE_BYTES, indexable_size, is_binary, is_hidden, language
from loresift.functions.text import expand_identifiers
from loresift.operators.ignore import ignored_nodes, outer_rules, read_rules
from loresift.schema import CODE_SCHEMA
from loresift.session import settled
from loresift.sources.tree import list_tree, read_contents


def path_gates(files: DataFrame, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """Leave out empty, oversized, binary and hidden files by path and size alone."""
    path = F.col("rel_path")
    return files.filter(indexable_size(F.col("size_bytes"), max_bytes) & ~is_binary(path) & ~is_hidden(path))


def build_documents(files: DataFrame, repo: str, branch: str = "unknown", commit_sha: str = "unknown") -> DataFrame:
    """Documents of files with their ``content`` bytes; undecodable files drop out.

    The size kept is that of the file, not of the expanded text.
    """
    if not repo or not branch:
        raise ValueError("repository and branch need a name")  # they name storage folders
    text = files.withColumn("content", F.col("content").cast("string")).filter(F.is_valid_utf8("content"))
    return text.select(
        F.lit(repo).alias("repo"),
        F.lit(branch).alias("branch"),
        F.lit(commit_sha).alias("commit_sha"),
        F.col("rel_path").alias("file_path"),
        language(F.col("rel_path")).alias("language"),
        expand_identifiers(F.col("content")).alias("content"),
        F.col("size_bytes").cast("bigint").alias("size_bytes"),
    ).select(*CODE_SCHEMA.fieldNames())


def walk_tree(spark: SparkSession, root: str, extra_rules: DataFrame | None = None) -> DataFrame:
    """Files of a tree that would be indexed, before their contents are read.

    Rules are read as the listing comes to them, and hidden or ignored folders
    are never opened.
    """
    rules, in_repository = outer_rules(spark, root)
    if extra_rules is not None:
        rules = rules.unionByName(extra_rules)

    def kept(found: DataFrame) -> DataFrame:
        nonlocal rules
        inner = read_rules(found.filter("NOT is_dir"), root, in_repository)
        rules = rules.unionByName(settled(inner, "rules"))
        ignored = ignored_nodes(found.select(F.col("rel_path").alias("node"), "is_dir"), rules)
        ignored = ignored.select(F.col("node").alias("rel_path"), "is_dir")
        seen = found.filter(~(F.col("is_dir") & is_hidden(F.col("rel_path"))))
        return seen.join(ignored, ["rel_path", "is_dir"], "left_anti").select(*found.columns)

    return path_gates(list_tree(spark, root, kept))


def load_tree(
    spark: SparkSession,
    root: str,
    repo: str | None = None,
    branch: str = "unknown",
    commit_sha: str = "unknown",
    extra_rules: DataFrame | None = None,
) -> DataFrame:
    """Documents of a source tree; the label defaults to the folder's name."""
    label = repo or root.rstrip("/").rsplit("/", 1)[-1] or "repo"
    files = walk_tree(spark, root, extra_rules)
    return build_documents(read_contents(files, root), label, branch, commit_sha)
