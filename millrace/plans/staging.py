"""Where multi-job operators keep their intermediate tables.

Executors may be lost at any time, so lineage is cut only with tables written
to the folder all executors share.  The cluster names that folder in
``spark.checkpoint.dir``; only where it is unset and all executors run on this
machine (tests, notebooks) a folder of this process is set instead.  ``unstage``
deletes what a session has staged, once its results have been written.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_STAGED: dict[str, list[str]] = {}
#: Removes the shuffle files of a query when it ends; else they stay until the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session: ``spark.checkpoint.dir`` if set."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="millrace-")
        spark.sparkContext.setCheckpointDir(_OWN[app])
    return _OWN[app]


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return a scan of it; the shuffle files of the write are removed."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/millrace-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    _STAGED.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def unstage(spark: SparkSession) -> int:
    """Delete the tables that this session has staged; returns how many. Frames built on them can be read no more."""
    staged = _STAGED.pop(spark.sparkContext.applicationId, [])
    for path in staged:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    return len(staged)
