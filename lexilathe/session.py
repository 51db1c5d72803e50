"""Session helpers shared by all operators: table reading, shared scratch space, broadcast size checks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: A side is only hinted for broadcast when it is known to hold at most this many rows.
BROADCAST_ROWS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table `name` under `sf_dir`."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Directory for checkpoint(): the cluster's spark.checkpoint.dir; a local folder only where none is set (tests)."""
    sc = spark.sparkContext
    have = sc._jsc.sc().getCheckpointDir()
    if have.isDefined():
        return have.get()
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="lexilathe-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def settle(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared checkpoint folder, so that later reads neither recompute it nor depend
    on one executor."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """df as a table written to the shared folder. Unlike a checkpoint it takes no constraints of its plan along, which
    in loops of joins grow until planning takes longer than the work."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, with its scheme, so that it names the same place from every machine."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return path.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(path).toString()


def drop_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder that shared_folder() named."""
    sc = spark.sparkContext
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


def open_folder(path: str):
    """(file system, path in it) for reading a folder of the shared file system outside of Spark."""
    from pyarrow import fs

    scheme, rest = path.split(":", 1) if ":" in path else ("file", path)
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(("s3" if scheme in ("s3a", "s3n") else scheme) + ":" + rest)


def local_session(cores: int = 8, partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("lexilathe")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors' Python, once an application, so that they need not have it installed."""
    import zipfile
    from pathlib import Path

    sc = spark.sparkContext
    root = Path(__file__).resolve().parent
    if sc.applicationId in _SHIPPED or not root.is_dir():
        return
    target = Path(tempfile.mkdtemp(prefix="lexilathe-package-")) / "lexilathe.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(target))
    _SHIPPED.add(sc.applicationId)


def shipped(query):
    """query(spark, sf_dir) with the package sent first."""
    from functools import wraps

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return query(spark, sf_dir)

    return run
