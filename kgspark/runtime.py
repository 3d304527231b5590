"""Session helpers: shared scratch folder, materialised intermediates, table readers."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SCRATCH: list[tuple[SparkSession, str]] = []


def scratch_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (``spark.checkpoint.dir``).

    Only a local session without that setting gets a folder of its own, since
    there the driver and the executors are one process on one disk.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = "file://" + tempfile.mkdtemp(prefix="kgspark-")
    spark.conf.set("spark.checkpoint.dir", path)
    spark.sparkContext.setCheckpointDir(path)
    return path


#: Spark setting under which the shuffle files of a query go when the query has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_folder(spark: SparkSession, tag: str) -> str:
    """A new folder's name in the scratch folder; ``release`` deletes it."""
    path = f"{scratch_dir(spark)}/kgspark/{tag}-{uuid.uuid4().hex}"
    _SCRATCH.append((spark, path))
    return path


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared scratch folder and read it back.

    Cuts the lineage as ``checkpoint()`` does, but keeps column pruning,
    compression and file statistics. Lost executors cost nothing: the rows are
    in shared storage. The shuffle files of the write are not needed any more
    and go with it. ``discard`` removes one folder, ``release`` all.
    """
    spark = df.sparkSession
    path = scratch_folder(spark, tag)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.select("*").write.parquet(path)  # a query of its own, planned under the setting
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` by hash of the keys over all shuffle partitions, for work that is large next to its bytes.

    Adaptive execution merges partitions by their bytes, which says nothing of
    the pairs that a join makes of them or of what a metric costs; it leaves a
    stated number as it is.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` for a join that never sends it whole through the driver.

    Spark takes what an explode or a Python step makes for as large as its input,
    so it would broadcast millions of rows made of a few thousand names.
    """
    return df.hint("merge")


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def discard(*tables: DataFrame) -> None:
    """Delete the folders of tables from ``materialize`` that no later plan reads."""
    for df in tables:
        path = getattr(df, "scratch_path", None)
        if path:
            _delete(df.sparkSession, path)
            _SCRATCH[:] = [x for x in _SCRATCH if x[1] != path]


def release() -> None:
    """Delete every folder that ``materialize`` made in this process."""
    while _SCRATCH:
        spark, path = _SCRATCH.pop()
        try:
            _delete(spark, path)
        except Exception:  # the session is gone; the folder's owner clears it
            return


atexit.register(release)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
