"""The append-only log as a stream: rows that arrive are merged into the stored log, and notes judged again where they came.

Rows carry their position in their channel, so late and repeated rows need no watermark: a row is known
by (coord, channel, pos), and the first version of it that was stored stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import knowledge

LOG = "coord string, channel string, pos long, ts string, author string, text string, stamp string, reaffirms long"


def read(spark: SparkSession, folder: str) -> DataFrame:
    """JSON lines that are put into a folder, as they come; unknown fields are dropped, missing ones are null."""
    return spark.readStream.schema(LOG).json(folder)


def merge(batch: DataFrame, folder: str, batch_id: int) -> None:
    """Appends the rows of a batch that the stored log hasn't; a batch that runs again writes the same part again.

    Parts are named by batch, so that a batch which was interrupted is replaced, not added to.
    """
    spark = batch.sparkSession
    new = batch.filter("coord is not null and channel is not null and pos is not null")
    rest = [c for c in new.columns if c not in ("coord", "channel", "pos")]
    new = new.groupBy("coord", "channel", "pos").agg(F.min(F.struct(*rest)).alias("x")).select("coord", "channel", "pos", "x.*")
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    parts = [f.getPath().toString() for f in store.listStatus(path)] if store.exists(path) else []
    earlier = [p for p in parts if p.rsplit("batch=", 1)[-1].isdigit() and int(p.rsplit("batch=", 1)[-1]) < batch_id]
    if earlier:
        had = spark.read.schema(LOG).parquet(*earlier)
        new = new.join(had.select("coord", "channel", "pos"), ["coord", "channel", "pos"], "left_anti")
    new.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")


def stored_log(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(LOG + ", batch long").parquet(folder).drop("batch")


def ingest(spark: SparkSession, source: str, folder: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Merges what lies in source into the log at folder; with once, until all of it is read."""
    writer = read(spark, source).writeStream.foreachBatch(lambda df, k: merge(df, folder, k)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def judged(spark: SparkSession, folder: str, accepted: DataFrame) -> DataFrame:
    """The stored log's prose with staleness and supersession."""
    return knowledge.for_display(knowledge.with_staleness(stored_log(spark, folder), accepted))
