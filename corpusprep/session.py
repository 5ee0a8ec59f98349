"""Session helpers: building a session for tests/bench and locating the
shared checkpoint folder.

Library code never creates its own session; jobs receive one. The only
cluster-level setting read here is ``spark.checkpoint.dir``: lineage is
cut with reliable ``checkpoint()`` into that shared folder. A folder of
our own is set only when none is configured *and* the master is local
(tests, bench).
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "corpusprep") -> SparkSession:
    """Session for tests and the bench (local mode, UI off, UTC)."""
    scratch = tempfile.mkdtemp(prefix="corpusprep-", dir="/tmp")
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.local.dir", os.path.join(scratch, "local"))
        .config("spark.sql.warehouse.dir", os.path.join(scratch, "warehouse"))
        .config(SPREAD, str(2 * (int(cpus) if str(cpus).isdigit() else os.cpu_count() or 1)))
        .config("spark.checkpoint.dir", os.path.join(scratch, "checkpoints"))
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def scale_conf(input_bytes: int, *, executors: int, cores_per_executor: int,
               target_partition_bytes: int = 256 << 20) -> dict[str, str]:
    """Session settings for a cluster run over ``input_bytes`` of Parquet.

    Shuffle partitions are sized so one partition of the largest shuffle
    (the exploded token rows, ~4x the compressed text) stays near the target
    and there are at least 3 waves of tasks; AQE then coalesces small ones
    and splits skewed join partitions. Broadcasts are left to the explicit,
    size-bounded hints in the library plus Spark's own runtime size check.
    """
    slots = executors * cores_per_executor
    # beyond ~250k reducers the map-output metadata dominates: partitions grow instead
    shuffle_parts = min(250_000, max(3 * slots, (4 * input_bytes) // target_partition_bytes))
    return {
        "spark.sql.shuffle.partitions": str(shuffle_parts),
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes // 2),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes // 2),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.autoBroadcastJoinThreshold": str(64 << 20),
        "spark.sql.session.timeZone": "UTC",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder, configuring it from the
    session's ``spark.checkpoint.dir`` when the context has none yet.

    On a cluster the folder must be shared storage named by the cluster;
    only a local master may fall back to a scratch folder under /tmp.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        try:
            configured = spark.conf.get("spark.checkpoint.dir")
        except Exception:  # not set at all
            configured = None
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError(
                "spark.checkpoint.dir is not set: a shared folder is required "
                "to cut lineage on a cluster")
        configured = tempfile.mkdtemp(prefix="corpusprep-ckpt-", dir="/tmp")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable (shared-storage) checkpoint; survives executor loss."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Session setting: partitions that ``table`` deals a fixture to (unset: none).
SPREAD = "spark.corpusprep.spread"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One fixture table (`<sf_dir>/<name>.parquet`), read as it lies.

    The small fixtures are single row groups, which a scan cannot split; a
    local session (tests, bench) sets SPREAD to deal their rows to its cores."""
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    spread = int(spark.conf.get(SPREAD, "0"))
    return df.repartition(spread) if spread else df
