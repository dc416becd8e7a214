"""What the training-data operators share on the driver: tables, shared storage, size-checked broadcasts."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir; a temporary one only where that is unset in local mode."""
    jsc = spark.sparkContext._jsc.sc()
    current = jsc.getCheckpointDir()
    if current.isDefined():
        return current.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="cairn-"))
    return jsc.getCheckpointDir().get()


def stable(df: DataFrame) -> DataFrame:
    """Computed once into the shared folder; survives the loss of executors and cuts the lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def packed(df: DataFrame, **more) -> DataFrame:
    """df's columns as the struct `__row`, beside more columns: no name of df can clash with one of ours."""
    return df.select(F.struct(*[df[f"`{c}`"].alias(c) for c in df.columns]).alias("__row"), *[x.alias(k) for k, x in more.items()])


def unpacked(rows: DataFrame, names: list[str]) -> DataFrame:
    """The columns that packed() put away."""
    return rows.select(*[F.col(f"__row.`{c}`").alias(c) for c in names])


def join_checked(df: DataFrame, side: DataFrame, on: str, how: str = "inner", broadcast_rows: int = 1_000_000) -> DataFrame:
    """df joined with a side that is broadcast up to broadcast_rows (of some 50 bytes, hashed), else shuffled; adaptive execution splits hot keys of df then."""
    small = side.limit(broadcast_rows + 1).count() <= broadcast_rows
    return df.join(F.broadcast(side) if small else side, on, how)


def semi_join_ids(df: DataFrame, ids: DataFrame, on: str, broadcast_rows: int = 2_000_000) -> DataFrame:
    """Rows of df whose id is in ids; ids are broadcast up to broadcast_rows (about 64 MB hashed), else shuffled."""
    return join_checked(df, ids, on, "left_semi", broadcast_rows)
