"""How many ranges to cut work into, from counted rows; which side of a join is short."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RANGE_ROWS_CONF = "spark.prepkit.rangeRows"
_RANGE_ROWS = 1_000_000
#: What a lookup side may hold to be sent to all tasks.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 16 << 20

#: Rows of a partition that models are fitted on, and up to how many partitions the least is kept to.
FIT_ROWS_LEAST, FIT_ROWS_MOST, FIT_TASKS = 20_000, 500_000, 16


def ranges_for(spark: SparkSession, rows: int) -> int:
    """Ranges of about a million rows each (``spark.prepkit.rangeRows``)."""
    return max(1, -(-rows // int(spark.conf.get(RANGE_ROWS_CONF, str(_RANGE_ROWS)))))


def bucket_count(df: DataFrame) -> int:
    """Ranges for the rows of the frame, which are counted."""
    return ranges_for(df.sparkSession, df.count())


def lookup_side(side: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """A lookup side of a join: broadcast when its counted rows and bytes are few.

    A longer side is joined by shuffle, with skewed keys split at run time.
    """
    text = F.length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in side.columns])))
    size = side.limit(max_rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(text), F.lit(0))).first()
    return F.broadcast(side) if size[0] <= max_rows and 2 * size[1] <= max_bytes else side


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """The frame over partitions by its number of rows, for fits that read it many times: each pass keeps several tasks
    busy, none reads much, and their number (a task's report goes to the driver) does not follow the files' layout."""
    parts = max(1, min(-(-rows // FIT_ROWS_LEAST), FIT_TASKS), -(-rows // FIT_ROWS_MOST))
    return df.repartition(parts, *keys)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; a local one is made in local mode alone."""
    if spark.sparkContext.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        shared = tempfile.mkdtemp(prefix="spark-ckpt-")
    spark.sparkContext.setCheckpointDir(shared)
