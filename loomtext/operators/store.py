"""Tables between steps, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Only on one machine may the session leave it unnamed; a temporary one is taken then."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and sc.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-ckpt-"))
    return sc.getCheckpointDir()


def written(df: DataFrame, compression: str | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, read by several consumers, kept when an executor is lost."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tables/{uuid.uuid4().hex}"
    (df.write.option("compression", compression) if compression else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a few numbers that are sent to every task rather than met in a shuffle, at most.
SENT_ROWS = 400_000


def sent_if_small(marks: DataFrame) -> DataFrame:
    """A written table of ids and short values, marked for broadcast if it has at most ``SENT_ROWS`` rows; a larger one is joined in the shuffle."""
    return F.broadcast(marks) if marks.limit(SENT_ROWS + 1).count() <= SENT_ROWS else marks


#: Bytes of the Arrow batches that Python workers get, at most.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Holds the session's Arrow batches to a size that leaves workers room for the work on them."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key)
    if not now.isdigit() or not 0 < int(now) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` with their place (from 0) in ``order``: a range sort, counts by part and their sums before each part; no task holds all rows."""
    parted = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    # written, as another evaluation might draw other boundaries
    parts = written(parted.withColumns({"_part": F.shiftright("_at", 33), "_at": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))}))
    counts = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = counts.select("_part", before.alias("_base"))  # a row for each part
    return parts.join(F.broadcast(bases), "_part").withColumn(name, F.col("_at") + F.col("_base")).drop("_part", "_at", "_base")
