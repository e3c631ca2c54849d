"""Session helpers: configuration and table loading.

Nothing here holds data on the driver. Table reads are plain
``spark.read.parquet`` so Catalyst prunes columns and pushes filters into the
scan.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on. ANSI mode stays on (Spark 4 default); money is
# decimal and parses go through try_cast, so nothing depends on it being off.
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # HotSpot never compiles a method over 8000 bytes: a stage whose generated code has
    # one would be interpreted for every row. Its operators then run one by one, compiled.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def get_spark(master: str = "local[*]", shuffle_partitions: int = 8,
              app: str = "varpack") -> SparkSession:
    """Session for tests and the bench. On a cluster the caller's session is
    used as it is; only the settings above are applied."""
    builder = (SparkSession.builder.master(master).appName(app)
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.ui.enabled", "false")
               .config("spark.driver.memory", "8g"))
    for k, v in SESSION_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    return spark


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings the engine relies on to an existing session."""
    for k, v in SESSION_CONF.items():
        if k == "spark.sql.adaptive.skewJoin.enabled":
            continue
        try:
            spark.conf.set(k, v)
        except Exception:  # static or locked setting: leave it as the cluster has it
            pass
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_path(spark: SparkSession) -> str:
    """A new name below spark.checkpoint.dir, which every executor must see. Only
    a session on one machine may leave the setting out."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="varpack-shared-")
        spark.conf.set("spark.checkpoint.dir", root)
    return os.path.join(root, f"varpack-{uuid.uuid4().hex}")


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` as a Parquet table below spark.checkpoint.dir, the folder
    that the whole cluster shares, and read it back: a frame that several
    branches use is computed once, and a lost executor costs a re-read."""
    path = shared_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
