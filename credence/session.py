"""Session settings and the one place where lineage is cut."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def build_session(app="credence", master=None, **conf) -> SparkSession:
    """A session with the settings the jobs are written for.

    On a cluster, pass ``spark.sql.shuffle.partitions`` sized to the data
    (about 200 MB of shuffle per partition); AQE merges what turns out small.
    """
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # lets AQE hash-join a shuffled narrow side instead of sorting wide rows
        "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "128MB",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's ``spark.checkpoint.dir``; invent one only in local mode."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="credence-ckpt-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")


def materialize(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives lost executors and cuts the lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def arrow_rows(spark: SparkSession, most: int) -> Iterator[None]:
    """Arrow batches of at most ``most`` rows for what runs inside; a smaller setting of the caller stands."""
    before = spark.conf.get(ARROW_ROWS)
    if 0 < int(before) <= most:
        yield
        return
    spark.conf.set(ARROW_ROWS, most)
    try:
        yield
    finally:
        spark.conf.set(ARROW_ROWS, before)


_STAGED: list[str] = []
_TABLES: dict[str, str] = {}


def stage(df: DataFrame, name: str, schema: StructType | None = None) -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder and read it back, as ``schema`` if given.

    Unlike a checkpoint, later reads prune columns and push filters down. The table stays
    until its owner calls ``release``, as lazy frames may still read it.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _STAGED.append(path)
    return spark.read.schema(schema or df.schema).parquet(path)


def stage_bucketed(df: DataFrame, name: str, key: str, buckets: int | None = None) -> DataFrame:
    """``stage`` with the rows dealt by ``key`` into buckets, one file each.

    The rows move once, as they are written. Joins and groupings on ``key`` read each bucket where it lies: the
    plan has no exchange above the scan. The table is temporary: ``release`` drops it with its files.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"credence_{name.replace('-', '_')}_{uuid.uuid4().hex}"
    path = f"{spark.sparkContext.getCheckpointDir()}/{table}"
    # the same hash deals the shuffle and names the bucket, so each task writes one file
    df.repartition(buckets, key).write.bucketBy(buckets, key).option("path", path).saveAsTable(table, format="parquet")
    _STAGED.append(path)
    _TABLES[path] = table
    return spark.table(table)


def staged() -> list[str]:
    """Paths of the tables staged by this driver and not yet released, oldest first."""
    return list(_STAGED)


def release(spark: SparkSession, paths: list[str]) -> None:
    """Delete staged tables; frames that read them must be done with."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in list(paths):
        if path in _TABLES:
            spark.sql(f"DROP TABLE IF EXISTS {_TABLES.pop(path)}")
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)
        if path in _STAGED:
            _STAGED.remove(path)
