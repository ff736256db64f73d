"""Session settings and shared scratch space."""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings the operators are planned for. All can be set on a live session.
RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

_local_scratch: str | None = None
_stored_paths: list[str] = []
_path_of: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def build_session(app_name: str = "seqloom", **conf: str) -> SparkSession:
    """Create a session with the recommended settings; keyword names use ``__`` for dots."""
    builder = SparkSession.builder.appName(app_name)
    for key, value in RECOMMENDED_CONF.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def apply_recommended(spark: SparkSession) -> SparkSession:
    for key, value in RECOMMENDED_CONF.items():
        spark.conf.set(key, value)
    return spark


def _configured_dir(spark: SparkSession) -> str | None:
    return spark.conf.get("spark.checkpoint.dir", None)


def shared_dir(spark: SparkSession) -> str:
    """The folder every node can reach, as named by the cluster in ``spark.checkpoint.dir``.

    Only on one machine (master ``local``) is a temporary folder made where none is named; a
    cluster without the setting raises ``ValueError``, since its nodes share no temporary folder.
    """
    global _local_scratch
    configured = _configured_dir(spark)
    if configured:
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError(f"Set spark.checkpoint.dir to a folder all nodes of {master} share")
    if _local_scratch is None:
        _local_scratch = tempfile.mkdtemp(prefix="seqloom-")
    return _local_scratch


def new_shared_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/seqloom/{name}-{uuid.uuid4().hex}"


def stored(
    df: DataFrame, name: str, partition_by: tuple[str, ...] = (), compression: str | None = None
) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it back.

    Cuts the lineage like a checkpoint, but later readers scan only the columns they use and only
    the partitions they ask for. The files stay until ``release`` or ``clear_stored``.
    """
    spark = df.sparkSession
    path = new_shared_path(spark, name)
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    (writer.option("compression", compression) if compression else writer).parquet(path)
    register(path)
    out = spark.read.schema(df.schema).parquet(path)
    _path_of[out] = path
    return out


def register(path: str) -> str:
    """Have ``clear_stored`` delete ``path`` too."""
    _stored_paths.append(path)
    return path


def delete_path(spark: SparkSession, path: str) -> bool:
    """Delete a folder in any store that Spark reaches; False if there was none."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if path in _stored_paths:
        _stored_paths.remove(path)
    return bool(target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True))


def release(*frames: DataFrame) -> None:
    """Delete the files of frames that ``stored`` has returned, once nothing built on them is read again."""
    for frame in frames:
        if path := _path_of.pop(frame, None):
            delete_path(frame.sparkSession, path)


def stored_count() -> int:
    """Number of registered folders, a mark for ``clear_stored``."""
    return len(_stored_paths)


def clear_stored(spark: SparkSession, keep: int = 0) -> int:
    """Delete what has been registered in this session but for the first ``keep`` folders; returns how many.

    Call it once no DataFrame built on them is needed any more.
    """
    return sum(delete_path(spark, path) for path in _stored_paths[keep:][::-1])


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in reliable storage and cut its lineage."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)
