"""Session settings for cluster runs and the shared checkpoint folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Joins by several keys stay in the partitions of rows that are hashed by one of them.
SHARED_KEY = {"spark.sql.requireAllClusterKeysForCoPartition": "false"}

# Runtime re-planning does the size checks: a side becomes a broadcast only when
# its measured shuffle output is below the threshold, and hot join partitions are split.
ADAPTIVE = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "3",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.session.timeZone": "UTC",
    **SHARED_KEY,
}


def configure(builder: SparkSession.Builder, partitions: int = 4000, **extra: str) -> SparkSession.Builder:
    """Apply the adaptive settings, then any overrides.

    ``partitions`` is the number of shuffle partitions before adaptive merging, so it bounds the size of the largest task;
    small results are merged back at run time.
    """
    ceiling = {"spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(partitions)}
    for key, value in {**ADAPTIVE, **ceiling, **extra}.items():
        builder = builder.config(key, value)
    return builder


def checkpoint_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it; an error where it names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rsplit("/", 1)[0]
    raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back: cuts lineage, survives the loss of executors."""
    path = f"{checkpoint_root(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: With this a finished write drops the shuffle files behind it, which otherwise stay until the driver collects its garbage.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def bucketed(df: DataFrame, name: str, buckets: int, *keys: str) -> str:
    """Write ``df`` once in the shared folder, each row in the bucket of its first key and sorted by all keys; the table's name.

    Joins and folds by the first key (and any others) read the buckets in place, without a shuffle. ``df`` is to be hashed by that key
    over as many tasks, so that a task writes one file.
    """
    spark, ident = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    before = spark.conf.get(DROP_SHUFFLES, None)
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        df.write.format("parquet").bucketBy(buckets, keys[0]).sortBy(*keys).option("path", f"{checkpoint_root(spark)}/{ident}").saveAsTable(ident)
    finally:
        spark.conf.unset(DROP_SHUFFLES) if before is None else spark.conf.set(DROP_SHUFFLES, before)
    return ident


def staged(df: DataFrame) -> DataFrame:
    """A stage for analyses with several results: their shared part is written once."""
    return stage_table(df, "stage")


def as_is(df: DataFrame) -> DataFrame:
    """The default stage: keep one lazy plan."""
    return df


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder (survives the loss of executors)."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(checkpoint_root(spark))
    return df.checkpoint(eager=True)
