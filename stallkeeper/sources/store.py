"""Named tables written once to the cluster's shared folder and read back from there."""

import hashlib
import json
import threading
from collections.abc import Callable, Iterable, Iterator, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict
from functools import cache, reduce
from tempfile import TemporaryDirectory
from urllib.parse import urlparse
from uuid import uuid4

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from stallkeeper.operators.buckets import Buckets

# Written into a table's folder after its files. Readers skip names that begin with "_".
_MARKER = "_stallkeeper_complete"
_COUNTS = "counts"
# A row group is read by one task, so files are written in row groups that are a task's share.
ROW_GROUP_BYTES = 16 << 20
_COUNTS_SCHEMA = "table_name string, rows bigint, files bigint, bytes bigint, rejected bigint"


class TableStore:
    """Tables under one folder.

    A table is built on first request. Later requests, and recovery after a lost
    executor, read the written files instead of recomputing the lineage. How many rows and files
    were written is noted beside the tables, and compared with what is there without reading them.
    Different tables can be written at the same time, a table by one thread.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self._tables: dict[str, DataFrame] = {}
        self._locks: dict[str, threading.RLock] = {}

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def _lock(self, name: str) -> threading.RLock:
        return self._locks.setdefault(name, threading.RLock())

    def table(
        self, name: str, build: Callable[[], DataFrame], buckets: Buckets | None = None
    ) -> DataFrame:
        with self._lock(name):
            if name not in self._tables and not self._complete(name):
                return self.replace(name, build(), buckets=buckets)
            return self._read(name)

    def existing(self, name: str) -> DataFrame:
        with self._lock(name):
            if name not in self._tables and not self._complete(name):
                raise FileNotFoundError(self.path(name))
            return self._read(name)

    def export(self, name: str, write: Callable[[str], None]) -> str:
        """Path of files in another format, written once by the given writer."""
        with self._lock(name):
            if not self._complete(name):
                write(self.path(name))
                write_text(self.spark, f"{self.path(name)}/{_MARKER}", name)
            return self.path(name)

    def replace(
        self,
        name: str,
        df: DataFrame,
        rejected: Column | None = None,
        buckets: Buckets | None = None,
    ) -> DataFrame:
        """Empty and reload: the way to re-run a load on new input. Rows are counted as they are
        written, and those for which `rejected` is true besides. Rows for buckets have to come in
        as many partitions, by the same columns."""
        if rejected is None:
            rejected = F.lit(False)
        with self._lock(name):
            seen = Observation(f"{name}-{uuid4().hex}")
            counted = df.observe(
                seen, F.count(F.lit(1)).alias("rows"), F.count_if(rejected).alias("rejected")
            )
            if buckets:
                written = _passing_name()
                writer = counted.write.mode("overwrite").option("path", self.path(name))
                writer = writer.option("parquet.block.size", ROW_GROUP_BYTES)
                writer = writer.bucketBy(buckets.count, *buckets.columns)
                if buckets.sort:
                    writer = writer.sortBy(*buckets.sort)
                writer.saveAsTable(written)
                self.spark.sql(f"DROP TABLE {written}")  # the files stay
            else:
                writer = counted.write.mode("overwrite")
                writer.option("parquet.block.size", ROW_GROUP_BYTES).parquet(self.path(name))
            files, size = _data_files(self.spark, self.path(name))
            about = {"table_name": name, **seen.get, "files": files, "bytes": size}
            about |= {"buckets": asdict(buckets) if buckets else None}
            write_text(self.spark, self._counts_path(name), json.dumps(about))
            write_text(self.spark, f"{self.path(name)}/{_MARKER}", name)
            self._tables[name] = self._stored(name, df.schema, buckets)
            return self._tables[name]

    def _stored(self, name: str, schema: StructType, buckets: Buckets | None) -> DataFrame:
        if not buckets:
            return self.spark.read.schema(schema).parquet(self.path(name))
        # Only a catalog can tell Spark of buckets. The table is known to it just long enough to be
        # read by name; what is read then keeps the layout.
        known = _passing_name()
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        listed = ", ".join(buckets.columns)
        path = self.path(name).replace("\\", "\\\\").replace("'", "\\'")
        order = f"SORTED BY ({', '.join(buckets.sort)}) " if buckets.sort else ""
        self.spark.sql(
            f"CREATE TABLE {known} ({columns}) USING parquet CLUSTERED BY ({listed}) {order}"
            f"INTO {buckets.count} BUCKETS LOCATION '{path}'"
        )
        try:
            return self.spark.table(known)
        finally:
            self.spark.sql(f"DROP TABLE {known}")

    def counts(self) -> dict[str, dict]:
        """What was noted for each table that was written: rows, rejected, files and bytes."""
        names = names_in(self.spark, f"{self.folder}/{_COUNTS}")
        return {n.removesuffix(".json"): self.count(n.removesuffix(".json")) for n in names}

    def count(self, name: str) -> dict:
        about = json.loads(read_text(self.spark, self._counts_path(name)))
        return {key: value for key, value in about.items() if key != "table_name"}

    def counts_table(self) -> DataFrame:
        return self.spark.read.schema(_COUNTS_SCHEMA).json(f"{self.folder}/{_COUNTS}")

    def check(self, names: Iterable[str]) -> DataFrame:
        """For each written table the rows and files that were written, and those that are there.

        Rows are taken from the files' footers: no column is read."""
        found = []
        for name in names:
            files, _ = _data_files(self.spark, self.path(name))
            there = self.spark.read.parquet(self.path(name)) if files else self.spark.range(0)
            found.append(
                there.agg(F.count(F.lit(1)).alias("rows_found")).select(
                    F.lit(name).alias("table_name"), "rows_found", F.lit(files).alias("files_found")
                )
            )
        noted = self.counts_table().withColumnsRenamed(
            {"rows": "rows_written", "files": "files_written"}
        )
        both = noted.join(reduce(DataFrame.unionByName, found), "table_name")
        intact = (F.col("rows_written") == F.col("rows_found")) & (
            F.col("files_written") == F.col("files_found")
        )
        return both.select(
            "table_name", "rows_written", "rows_found", "files_written", "files_found",
            intact.alias("intact"),
        )

    def _counts_path(self, name: str) -> str:
        return f"{self.folder}/{_COUNTS}/{name}.json"

    def _read(self, name: str) -> DataFrame:
        if name not in self._tables:
            plain = self.spark.read.parquet(self.path(name))
            noted = exists(self.spark, self._counts_path(name)) and self.count(name)["buckets"]
            self._tables[name] = (
                self._stored(name, plain.schema, Buckets(**noted)) if noted else plain
            )
        return self._tables[name]

    def _complete(self, name: str) -> bool:
        # An interrupted write leaves no marker and is done again.
        return exists(self.spark, f"{self.path(name)}/{_MARKER}")


class StoredTables(Mapping[str, DataFrame]):
    """Tables by name, each written to the store when it is first asked for."""

    def __init__(self, store: TableStore, tables: Mapping[str, DataFrame]):
        self._store = store
        self._source = tables

    def __getitem__(self, name: str) -> DataFrame:
        return self._store.table(name, lambda: self._source[name])

    def __iter__(self) -> Iterator[str]:
        return iter(self._source)

    def __len__(self) -> int:
        return len(self._source)


def at_once(tables: Mapping[str, DataFrame], names: list[str]) -> list[DataFrame]:
    """The named tables, those to be written at the same time: what one task is busy with leaves the
    other cores to the other tables."""
    with ThreadPoolExecutor(len(names)) as pool:
        return list(pool.map(tables.__getitem__, names))


@cache
def _local_folder() -> TemporaryDirectory:
    """One for the process, removed at its end."""
    return TemporaryDirectory(prefix="stallkeeper-")


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: the one named by spark.checkpoint.dir."""
    configured = (
        spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    )
    if configured:
        return configured
    master = spark.sparkContext.master
    if master == "local" or master.startswith("local["):
        return _local_folder().name
    # Managed tables need the warehouse folder to be shared, too, but its default is not.
    folder = spark.conf.get("spark.sql.warehouse.dir")
    if urlparse(folder).scheme == "file":
        raise ValueError(
            f"{folder} is on each machine's own disk: set spark.checkpoint.dir to a shared folder"
        )
    return folder


def source_state(spark: SparkSession, paths: Iterable[str]) -> tuple[str, int]:
    """A text that changes when any file under the paths (globs, too) changes, and their bytes."""
    found = []
    for path in paths:
        location, fs = _file_system(spark, path)
        matches = fs.globStatus(location)
        if not matches:
            raise FileNotFoundError(path)
        for match in matches:
            if match.isFile():
                found.append(match)
                continue
            files = fs.listFiles(match.getPath(), True)
            while files.hasNext():
                found.append(files.next())
    states = sorted(
        (f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in found
    )
    digest = hashlib.sha256("\n".join(map(str, states)).encode()).hexdigest()
    return digest[:20], sum(length for _, length, _ in states)


def delete_at_exit(spark: SparkSession, folder: str) -> None:
    """For tables that only serve this application."""
    location, fs = _file_system(spark, folder)
    fs.mkdirs(location)
    fs.deleteOnExit(location)


def _passing_name() -> str:
    return f"stallkeeper_{uuid4().hex}"


def write_text(spark: SparkSession, path: str, text: str) -> None:
    location, fs = _file_system(spark, path)
    out = fs.create(location, True)
    try:
        out.write(bytearray(text, "utf-8"))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    location, fs = _file_system(spark, path)
    stream = fs.open(location)
    try:
        # One small file: its text goes through the driver.
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def exists(spark: SparkSession, path: str) -> bool:
    location, fs = _file_system(spark, path)
    return fs.exists(location)


def delete(spark: SparkSession, path: str) -> None:
    location, fs = _file_system(spark, path)
    fs.delete(location, True)


def names_in(spark: SparkSession, folder: str) -> list[str]:
    location, fs = _file_system(spark, folder)
    if not fs.exists(location):
        return []
    return sorted(status.getPath().getName() for status in fs.listStatus(location))


def rename_new(spark: SparkSession, path: str, to: str) -> bool:
    """Renames a file unless there is one of the new name already: in one step where the file system
    has such a rename, as distributed ones do."""
    fs = spark._jvm.org.apache.hadoop.fs
    old, new = fs.Path(path), fs.Path(to)
    context = fs.FileContext.getFileContext(old.toUri(), spark._jsc.hadoopConfiguration())
    keep = getattr(fs, "Options$Rename").NONE
    options = spark.sparkContext._gateway.new_array(getattr(fs, "Options$Rename"), 1)
    options[0] = keep
    try:
        context.rename(context.makeQualified(old), context.makeQualified(new), options)
    except Py4JJavaError as error:
        if error.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
            return False
        raise
    return True


def _data_files(spark: SparkSession, folder: str) -> tuple[int, int]:
    """Number and bytes of the files that readers see."""
    location, fs = _file_system(spark, folder)
    sizes = [
        status.getLen()
        for status in fs.listStatus(location)
        if status.isFile() and status.getPath().getName()[0] not in "._"
    ]
    return len(sizes), sum(sizes)


def _file_system(spark: SparkSession, path: str):
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    return location, location.getFileSystem(spark._jsc.hadoopConfiguration())
