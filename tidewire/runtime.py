"""Session-level helpers shared by every operator: shared scratch space, size-checked joins, worker imports."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only after a count shows at most so many (narrow) rows.
BROADCAST_ROWS = 50_000

#: Bytes of an Arrow batch for Python workers at most (whole rows), so that long texts don't fill an executor.
ARROW_BYTES = 16 << 20

_written: list[tuple[object, str]] = []


def build_session(app: str = "tidewire", cpus: int | str = "*") -> SparkSession:
    """A local session with the settings the engine expects; on a cluster the caller's own session is used."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("TIDEWIRE_DRIVER_MEMORY", "6g"))
        .getOrCreate()
    )


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a temporary one only in a local session that names none (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tidewire-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def materialise(df: DataFrame) -> DataFrame:
    """Write df as Parquet into the shared scratch folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/tidewire-{uuid.uuid4().hex}"
    df.write.parquet(path)
    keep(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def keep(spark: SparkSession, path: str) -> None:
    """Remember a scratch path, to be deleted at the end."""
    _written.append((spark, path))


@atexit.register
def _drop_written() -> None:
    for spark, path in _written:
        try:
            jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)
        except Exception:  # the JVM may be gone by now
            return


def small_enough(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether a (materialised, narrow) side has at most `rows` rows; reads no more than one beyond that."""
    return df.limit(rows + 1).count() <= rows


def checked(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint where the counted size allows it; otherwise the plain side, for a shuffled, skew-split join."""
    return F.broadcast(df) if small_enough(df, rows) else df


def workers_see_package(spark: SparkSession) -> None:
    """Let Python workers import this package when the driver found it by sys.path alone, and keep Arrow batches small."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) > ARROW_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    parts = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in parts:
        env["PYTHONPATH"] = os.pathsep.join([root, *parts])
