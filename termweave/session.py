"""Session helpers: builder defaults, table loading, checkpoint folder, checked broadcast."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: With this setting a query's shuffle files go as soon as it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Most rows and bytes that a side may have before it is hinted for broadcasting.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64 << 20


def _own_folder() -> str:
    """A new folder for a local session's checkpoints, removed when the process ends."""
    folder = tempfile.mkdtemp(prefix="termweave-checkpoints-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def build_session(cpus: int = 8, app: str = "termweave", checkpoints: str | None = None) -> SparkSession:
    """A local session with the settings the tests and the benchmark use; checkpoints go to the given folder or to one of its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.checkpoint.dir", checkpoints or _own_folder())
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoint(): the session's own setting. A session on one machine that sets none gets a folder of its own; on a cluster that is an error."""
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = _own_folder()
    sc.setCheckpointDir(folder)
    return folder


def _bytes(column: Column, kind: T.DataType) -> Column:
    """About how many bytes a value takes."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(column), F.lit(0)) + 16
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, T.StringType):
            return F.coalesce(F.octet_length(F.array_join(column, "")) + F.size(column) * 16, F.lit(0)) + 16
        return F.coalesce(F.size(column), F.lit(0)) * 16 + 16
    if isinstance(kind, T.StructType):
        return sum((_bytes(column[f.name], f.dataType) for f in kind), F.lit(8))
    return F.lit(8)


def _size(schema: T.StructType) -> list[Column]:
    """Rows and bytes of a frame, as aggregates."""
    taken = F.coalesce(F.sum(sum((_bytes(F.col(f"`{f.name}`"), f.dataType) for f in schema), F.lit(0).cast("long"))), F.lit(0))
    return [F.count(F.lit(1)).alias("rows"), taken.alias("bytes")]


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise a frame in the shared checkpoint folder, so that a lost executor never forces a long recomputation. Its size is noted on the way, and the shuffle
    files that it took, which nothing reads again, are removed at once."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    seen, before = Observation(), spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")  # read when a frame is made
    try:
        observed = df.observe(seen, *_size(df.schema))
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    out = observed.checkpoint(eager=True)
    noted = seen.get
    if "rows" in noted:
        out.__dict__["_measured"] = (noted["rows"], noted["bytes"])
    return out


def release(spark: SparkSession) -> None:
    """Have checkpoints and shuffle files removed that no frame uses any more: they go when the driver collects its garbage, which it may not do for long."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def is_small(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES, of: DataFrame | None = None) -> bool:
    """Whether a frame has at most so many rows and bytes. Known of a frame that cut_lineage made, and of what is selected or filtered from one (``of``); any other
    frame is counted, up to max_rows + 1 rows."""
    noted = (df if of is None else of).__dict__.get("_measured")
    rows, taken = noted or df.limit(max_rows + 1).agg(*_size(df.schema)).first()
    return rows <= max_rows and taken <= max_bytes


def small_side(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES, of: DataFrame | None = None) -> DataFrame:
    """Hint a broadcast if the frame is small by count and bytes; beyond that the plain frame, so Spark shuffles and AQE splits skew.

    A frame of unknown size is counted and then made again: give it a scan or a materialised frame (see ``materialised``).
    """
    return F.broadcast(df) if is_small(df, max_rows, max_bytes, of) else df


def materialised(df: DataFrame) -> DataFrame:
    """small_side of a frame that is dear to make: it is written first, so that it is made once."""
    return small_side(cut_lineage(df))
