"""Session defaults and the shared scratch area for lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build(app: str = "fathom", cpus: int = 8, shuffle_partitions: int | None = None) -> SparkSession:
    """A local session with the settings the tests and the benchmark use."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where it is unset, a local one is set once, but only for a local
    master: on a cluster each executor would write to a disk of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="fathom-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.sparkContext.setCheckpointDir(named)
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


_open_scopes: list[list[tuple[SparkSession, str]]] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed with the scratch tables."""
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    for scope in _open_scopes:
        scope.append((spark, path))
    return path


def cut(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later stages start from files, not from shuffles
    that a lost executor takes with it, and range partitioning samples the files instead of the whole plan."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def discard(*tables: DataFrame) -> None:
    """Remove tables that ``cut`` wrote, once all that was made from them is written too."""
    for df in tables:
        start = f"{shared_dir(df.sparkSession)}/tables/"
        for path in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
            if start.split(":", 1)[-1].strip("/") in path:
                _delete(df.sparkSession, path)


@contextmanager
def scratch() -> Iterator[None]:
    """Removes all tables that were cut inside, at the end: write or collect the results before it."""
    made: list[tuple[SparkSession, str]] = []
    _open_scopes.append(made)
    try:
        yield
    finally:
        _open_scopes.remove(made)
        for spark, path in made:
            _delete(spark, path)
