"""Session settings the jobs rely on, and the shared folder they may write to."""

from __future__ import annotations

import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Runtime settings every job needs for right results.
REQUIRED = {
    # Timestamps are UTC instants throughout.
    "spark.sql.session.timeZone": "UTC",
    # A JSON object with a repeated key keeps the last value.
    "spark.sql.variant.allowDuplicateKeys": "true",
}

#: Settings that matter for speed only; a value the cluster has set wins.
PREFERRED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Arrow batches of texts are bounded by bytes too, as single ones may be long.
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
    # Merge the sessions of one map task before the shuffle, so that a file
    # that changes very often does not send every event to one reducer.
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}


_shipped: set[str] = set()


def _ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once per application."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        package = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="loresift-package-")) / package.name
        context.addPyFile(shutil.make_archive(str(target), "zip", package.parent, package.name))
        _shipped.add(context.applicationId)


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session made elsewhere."""
    _ship_package(spark)
    for key, value in REQUIRED.items():
        spark.conf.set(key, value)
    explicit = spark.sparkContext.getConf()
    for key, value in PREFERRED.items():
        if not explicit.contains(key):
            spark.conf.set(key, value)
    return spark


def new_session(app_name: str = "loresift", master: str | None = None, **conf: str) -> SparkSession:
    """Start (or reuse) a session with the settings above."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**PREFERRED, **REQUIRED, **conf}.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only where the session names none and runs in one process (tests) a
    temporary folder is made and set; on a cluster that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="loresift-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def _bytes_of(setting: str) -> int:
    """Bytes of a setting such as ``64m``, ``64MB`` or ``67108864b``."""
    number, unit = re.fullmatch(r"(\d+)\s*([bkmgtp]?)b?", setting.strip().lower()).groups()
    return int(number) << 10 * "bkmgtp".index(unit or "b")


@contextmanager
def partitions_of(spark: SparkSession, most: int) -> Iterator[None]:
    """Let the adaptive planner aim at partitions of at most so many shuffled bytes in the jobs run within.

    Nor does it merge smaller ones to more than it is told to aim at.
    """
    aim, least = "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.minPartitionSize"
    most = min(most, _bytes_of(spark.conf.get(aim)))
    changed = {name: spark.conf.get(name, None) for name in (aim, least) if _bytes_of(spark.conf.get(name)) > most}
    for name in changed:
        spark.conf.set(name, str(most))
    try:
        yield
    finally:
        for name, before in changed.items():
            if before is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, before)


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Let what a job run within has shuffled go when the job ends, not whenever the driver collects its garbage.

    For writes and the like: a frame that is run a second time itself would have to shuffle again.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    if (before := spark.conf.get(name, "false")) == "true":
        yield
        return
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def write_parquet(rows: DataFrame, path: str, *by: str, mode: str = "errorifexists") -> None:
    """Write rows with little disk: compressed well, and nothing shuffled is kept."""
    with shuffles_freed(rows.sparkSession):
        rows.write.mode(mode).option("compression", "zstd").partitionBy(*by).parquet(path)


def settled(rows: DataFrame, label: str) -> DataFrame:
    """Write rows to the shared folder and read them back: computed once, and from files that outlive any executor."""
    path = scratch_path(rows.sparkSession, label)
    write_parquet(rows, path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def let_go(*tables: DataFrame) -> None:
    """Empty the files of tables that were ``settled`` and are not read any more."""
    for rows in tables:
        for path in {file.rpartition("/")[0] for file in rows.inputFiles()}:
            rows.sparkSession.createDataFrame([], "nothing int").write.mode("overwrite").parquet(path)
