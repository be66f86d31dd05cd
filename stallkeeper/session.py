"""Session settings."""

import os

from pyspark.sql import SparkSession

SHUFFLE_BYTES_PER_PARTITION = 256 << 20
# Parquet is coded and compressed: a partition has as many rows as one of text of many times its bytes.
PACKED_BYTES_PER_PARTITION = 8 << 20
# Stored tables are read by tasks of so many bytes, so that what a task sorts or groups stays in memory.
SCAN_BYTES = 16 << 20
MAX_SCAN_TASKS = 200_000

_INITIAL_PARTITIONS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
_SCAN_TASKS = "spark.sql.files.maxPartitionNum"
_SCAN_BYTES = "spark.sql.files.maxPartitionBytes"


def local_session(cores: int | str = 8, memory: str = "16g") -> SparkSession:
    """For tests and the bench. On a cluster, use the session the cluster gives."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("stallkeeper")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", memory))
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


class Sizing:
    """Initial shuffle partitions for an input, one for each `bytes_per_partition` of it.

    Adaptive execution merges small partitions at run time but splits only skewed joins, so it
    has to start with many: the default of 200 would mean half a terabyte each on 100 TB. The
    number follows from the input alone, whatever the session did before; `least` is the
    session's own shuffle partitions, and `most`, if given, bounds the bookkeeping of map x reduce
    blocks. Tasks read at most `scan_bytes`, or what the session has if that is less. `restore` puts
    back what the session had.
    """

    def __init__(
        self,
        spark: SparkSession,
        input_bytes: int,
        bytes_per_partition: int = SHUFFLE_BYTES_PER_PARTITION,
        most: int | None = None,
        scan_bytes: int = SCAN_BYTES,
    ):
        self.spark = spark
        wanted = -(-input_bytes // bytes_per_partition)
        if most is not None:
            wanted = min(wanted, most)
        self.partitions = max(wanted, int(spark.conf.get("spark.sql.shuffle.partitions")))
        as_bytes = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
        self._settings = {
            _INITIAL_PARTITIONS: str(self.partitions),
            _SCAN_TASKS: str(MAX_SCAN_TASKS),
            _SCAN_BYTES: str(min(scan_bytes, as_bytes(spark.conf.get(_SCAN_BYTES)))),
        }
        self._before: dict[str, str | None] | None = None

    def apply(self) -> "Sizing":
        if self._before is None:
            self._before = {key: self.spark.conf.get(key, None) for key in self._settings}
        for key, value in self._settings.items():
            self.spark.conf.set(key, value)
        return self

    def restore(self) -> None:
        for key, value in (self._before or {}).items():
            if value is None:
                self.spark.conf.unset(key)
            else:
                self.spark.conf.set(key, value)
        self._before = None
