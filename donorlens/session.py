"""Session construction and cluster-safe scratch locations."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession

# Settings that matter at scale. AQE coalesces small shuffle partitions, turns
# sort-merge joins into broadcast joins when a side is measured small at run
# time, and splits skewed join partitions.
_SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    # checkpoint files of a finished plan are removed once unreferenced
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "donorlens", extra: dict | None = None) -> SparkSession:
    """Return a SparkSession with the settings the plans assume.

    On a cluster ``master`` stays None (spark-submit decides) and
    ``spark.sql.shuffle.partitions`` should be sized so that one shuffle
    partition is ~128-256 MB of the widest exchange (for 100 TB of payments:
    several tens of thousands; AQE coalesces down from there).
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    for k, v in _SCALE_CONF.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """The shared checkpoint folder named by the cluster.

    Read from ``spark.checkpoint.dir``. Only when the session has none is a
    folder chosen here: ``fallback`` if given, else -- and only for a
    ``local`` master, where the machine *is* the cluster -- a folder under
    the system temp dir. A cluster without the setting is an error.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        if fallback is None:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir is not set; name a shared folder")
            import tempfile
            fallback = tempfile.mkdtemp(prefix="donorlens-ckpt-")
        d = fallback
        spark.conf.set("spark.checkpoint.dir", d)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d


def cut_lineage(df, spark: SparkSession | None = None):
    """Reliable checkpoint (written to the shared checkpoint folder).

    Survives executor loss, unlike local checkpoints or caching.
    """
    spark = spark or df.sparkSession
    checkpoint_dir(spark, fallback=os.environ.get("DONORLENS_CHECKPOINT_DIR"))
    return df.checkpoint(eager=True)


def materialize(df):
    """Cut a plan that several actions reuse (model inputs, kNN points): a reliable checkpoint."""
    return cut_lineage(df)


def staged(df, name: str = "table"):
    """Write ``df`` as Parquet below the shared checkpoint folder and read it back.

    For tables that several consumers read: columnar, so each reads its own
    columns only. The folder is deleted when the driver's JVM ends.
    """
    spark = df.sparkSession
    root = checkpoint_dir(spark, fallback=os.environ.get("DONORLENS_CHECKPOINT_DIR"))
    path = f"{root.rstrip('/')}/donorlens-{uuid.uuid4().hex}/{name}"
    schema = df.schema
    df.write.parquet(path)
    delete_at_exit(spark, path)
    return spark.read.schema(schema).parquet(path)


def bucketed(df, key: str, buckets: int | None = None):
    """Write ``df`` as a table bucketed and sorted by ``key`` below the shared checkpoint folder, and read it back.

    Tables bucketed alike are joined and grouped by the key without an exchange,
    however often they are read. One file per bucket, by default as many as the
    session has shuffle partitions. Rows of one key share a bucket: for tables of
    one row per key, or few.
    """
    spark = df.sparkSession
    root = checkpoint_dir(spark, fallback=os.environ.get("DONORLENS_CHECKPOINT_DIR"))
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"donorlens_{uuid.uuid4().hex}"
    path = f"{root.rstrip('/')}/{name}/bucketed"
    (df.repartition(buckets, key).write.format("parquet").bucketBy(buckets, key).sortBy(key).option("path", path)
     .saveAsTable(name))
    delete_at_exit(spark, path)
    return spark.table(name)


def delete_at_exit(spark: SparkSession, path: str) -> None:
    """Remove the folder that holds ``path`` when the driver's JVM ends."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path).getParent()
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)
