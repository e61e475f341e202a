"""Session settings and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()

#: Settings under which jobs take rows of many MB one at a time, in the JVM and in Python.
_LARGE_ROWS = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1",
    "spark.sql.parquet.enableVectorizedReader": "false",
    "spark.sql.inMemoryColumnarStorage.batchSize": "1",
}
#: Parquet options for such rows: without them a writer gathers 100 rows before it looks at their size.
LARGE_ROW_FILES = {
    "parquet.block.size": str(32 << 20),
    "parquet.block.size.row.check.min": "1",
    "parquet.block.size.row.check.max": "1",
    "parquet.page.size.row.check.min": "1",
    "parquet.page.size.row.check.max": "1",
    "parquet.enable.dictionary": "false",
}


def build_session(app_name: str = "phenoweave", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the jobs are written for.

    Adaptive execution re-plans joins from measured sizes and splits skewed
    partitions. Checkpoint files of superseded iterations are removed once
    nothing refers to them.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts, as the cluster names it.

    Only a local session without the setting gets a folder of its own; on a
    cluster a missing setting is an error, because a machine-local folder would
    be lost with its executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        named = tempfile.mkdtemp(prefix="phenoweave-checkpoints-")
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per application.

    Functions that run in tasks are pickled by reference, so every executor must
    be able to import the package, wherever the driver was started.
    """
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="phenoweave-archive-")) / "phenoweave.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, source.relative_to(root.parent))
    sc.addPyFile(str(archive))
    _shipped.add(sc.applicationId)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it back.

    Like a checkpoint it survives lost executors and cuts the lineage, but it is
    compressed and read by column.
    """
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame, keep_layout: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and go on from there; survives lost executors.

    With ``keep_layout`` the result also remembers how it is partitioned and
    sorted, so that joins and groupings on the same key need no shuffle. An
    adaptive plan does not report its layout, hence such a frame is planned
    without adaptive execution; use it where the plan has no join left to adapt.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    if not keep_layout:
        return df.checkpoint()
    setting = "spark.sql.adaptive.enabled"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "false")
    try:
        return df.checkpoint()
    finally:
        spark.conf.set(setting, before)


@contextmanager
def large_rows(spark: SparkSession) -> Iterator[None]:
    """Jobs that run inside hold one row at a time where rows are whole blocks of persons; grouped frames do not belong here."""
    before = {name: spark.conf.get(name) for name in _LARGE_ROWS}
    for name, value in _LARGE_ROWS.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
