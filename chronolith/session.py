"""Session settings and shared scratch space.

Everything that has to outlive a stage (cut lineage, streaming state, batch
outputs) goes to the folder named by ``spark.checkpoint.dir``, which all
executors share.  Where that setting is absent, a cluster is an error
(E_SHARED_DIR); a local session, all in one process, gets a folder of its own
that goes with the process.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from chronolith.errors import EngineError

#: Scratch paths made by this process and not removed yet.
_MADE: list[str] = []


def prepare(spark: SparkSession) -> SparkSession:
    """Settings the operators rely on: times without zone are UTC, AQE splits skewed joins."""
    for k, v in (
        ("spark.sql.session.timeZone", "UTC"),
        ("spark.sql.adaptive.enabled", "true"),
        ("spark.sql.adaptive.skewJoin.enabled", "true"),
        ("spark.sql.adaptive.coalescePartitions.enabled", "true"),
        # texts can be long: a batch sent to Python stays small in rows and bytes
        ("spark.sql.execution.arrow.maxRecordsPerBatch", "1000"),
        ("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20)),
    ):
        if spark.conf.get(k, None) != v:
            spark.conf.set(k, v)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder shared by all executors; set on the context too, so that checkpoint() works."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        known = sc._jsc.sc().getCheckpointDir()
        if known.isDefined():
            base = known.get()
        elif sc.master.split("[")[0] == "local":
            base = tempfile.mkdtemp(prefix="chronolith-")
            atexit.register(shutil.rmtree, base, ignore_errors=True)
        else:
            raise EngineError("E_SHARED_DIR", "set spark.checkpoint.dir to a folder that all executors share")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    _MADE.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _MADE[-1]


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Removes, on leaving, all scratch made inside; results that read it must have been used by then."""
    before = len(_MADE)
    try:
        yield
    finally:
        for path in _MADE[before:]:
            remove(spark, path)
        del _MADE[before:]


def checkpointed(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint in the shared folder: lineage ends there and survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write to shared scratch as Parquet and read back; cuts lineage and keeps columns prunable."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, whatever the scheme."""
    return _path(spark, path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path with all below it."""
    file_system(spark, path).delete(_path(spark, path), True)


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it does not exist."""
    fs, p = file_system(spark, path), _path(spark, path)
    return [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []


def read_text(spark: SparkSession, path: str) -> str:
    stream = file_system(spark, path).open(_path(spark, path))
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def claim(spark: SparkSession, path: str, text: str) -> bool:
    """Make the file ``path`` with ``text``, whole and once: False if it is there already.

    The text is written beside it first; then the name is taken in one step that
    never replaces: a rename that refuses to overwrite (HDFS and the like), a hard
    link on local files, whose rename would overwrite.  A store without such a
    rename (plain object stores) can't hold the heads of a log.
    """
    jvm, fs, to = spark.sparkContext._jvm, file_system(spark, path), _path(spark, path)
    part = _path(spark, f"{path.rpartition('/')[0]}/.part-{uuid.uuid4().hex}")
    out = fs.create(part, False)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        if fs.getUri().getScheme() == "file":
            local = lambda p: jvm.java.io.File(p.toUri().getPath()).toPath()
            jvm.java.nio.file.Files.createLink(local(to), local(part))
        else:
            options = jvm.org.apache.hadoop.fs.Options.Rename
            never = spark.sparkContext._gateway.new_array(options, 1)
            never[0] = options.NONE
            conf = spark.sparkContext._jsc.hadoopConfiguration()
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(part, to, never)
    except Exception as e:
        if "AlreadyExists" not in str(e):
            raise
        return False
    finally:
        fs.delete(part, False)
    return True
