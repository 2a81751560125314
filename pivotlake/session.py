"""Session settings and the shared folder for durable intermediate tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from pivotlake.errors import PivotError

CHECKPOINT_CONF = "spark.checkpoint.dir"
_TEMPORARY: list[tempfile.TemporaryDirectory] = []
_OWN_FOLDERS: set[str] = set()


def build_session(app: str = "pivotlake", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the engine is tuned for; ``conf`` overrides them.

    ``forceOptimizeSkewedJoin`` lets AQE split a hot join key even where that costs
    one more exchange, because one key may hold a third of all rows.
    """
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.ui.showConsoleProgress": "false",
        # Checkpoints go when the frame that made them does.
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        # Call-site capture for error messages costs more than planning itself.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        **conf,
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str | None:
    """The folder every executor can reach, or None when a cluster names none.

    The session's ``spark.checkpoint.dir`` decides. Only a local session, whose
    executors are threads of this machine, may fall back to a temporary folder.
    """
    folder = spark.conf.get(CHECKPOINT_CONF, None) or None
    if folder is None:
        folder = _current_checkpoint_dir(spark)
    if folder is None and re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        # Removed when this process ends.
        _TEMPORARY.append(tempfile.TemporaryDirectory(prefix="pivotlake-", ignore_cleanup_errors=True))
        folder = _TEMPORARY[-1].name
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def _current_checkpoint_dir(spark: SparkSession) -> str | None:
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    return current.get() if current.isDefined() else None


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder for one written table.

    Tables of an application lie in one folder, which is removed when it ends.
    """
    root = shared_folder(spark)
    if root is None:
        raise PivotError(f"set {CHECKPOINT_CONF} to a folder all executors share")
    own = f"{root.rstrip('/')}/pivotlake/{spark.sparkContext.applicationId}"
    if own not in _OWN_FOLDERS:
        _OWN_FOLDERS.add(own)
        path = spark._jvm.org.apache.hadoop.fs.Path(own)
        system = path.getFileSystem(spark._jsc.hadoopConfiguration())
        system.mkdirs(path)
        system.deleteOnExit(path)
    return f"{own}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and cut its lineage with a reliable checkpoint.

    The files live in the shared folder, so losing an executor afterwards costs
    nothing but a re-read.
    """
    spark = df.sparkSession
    folder = shared_folder(spark)
    if folder is None:
        raise PivotError(f"set {CHECKPOINT_CONF} to a folder all executors share")
    if _current_checkpoint_dir(spark) is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def can_materialise(spark: SparkSession) -> bool:
    return shared_folder(spark) is not None
