"""The pipeline: staging, star, reporting view and rollups, each table written once."""

import threading
from collections.abc import Iterable, Iterator, Mapping
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stallkeeper.operators import cleaning, quality
from stallkeeper.operators.buckets import Buckets, dealt, dealt_orders, hot_orders, once
from stallkeeper.operators.dedup import kept
from stallkeeper.operators.ranking import in_global_order, with_rank
from stallkeeper.plans import advanced, mart
from stallkeeper.session import PACKED_BYTES_PER_PARTITION, Sizing
from stallkeeper.sources import files, testdata
from stallkeeper.sources.loads import KEEP_SECONDS, Loads
from stallkeeper.sources.schemas import STAGING, STAR
from stallkeeper.sources.store import (
    StoredTables, TableStore, at_once, delete_at_exit, shared_folder, source_state,
)

_LOADED = "loaded_"

# The two biggest facts are written together with the parents' columns: the joins that
# fetch those also do the referential check, so orders and lines cross the network
# once, not once for the fact and again for each report.
_PROJECTIONS = {
    "fact_orders": ("placed_orders", cleaning.ORDER_COLUMNS),
    "fact_order_items": ("sales_lines", cleaning.ITEM_COLUMNS),
    "fact_payments": ("fact_payments", cleaning.PAYMENT_COLUMNS),
    "placed_orders": ("placed_orders", mart.PLACED_COLUMNS),
    "sales_lines": ("sales_lines", mart.SALES_COLUMNS),
}
# Dealt alike by order. Sorted in each file, so that a filter on the status skips row groups.
_BUCKETED = {"placed_orders": ("order_status",), "sales_lines": ("order_status",), "fact_payments": ()}


class TooManyRejects(ValueError):
    """A file has more malformed rows than the load allows."""


class Warehouse(Mapping[str, DataFrame]):
    """Star tables, `sales_lines` and rollups by name, over seven staging tables.

    Asking for a table builds what it depends on, in dependency order. Star tables are stored with
    the rows that cleaning dropped, each with its rule; by name they are without them, `traced` has
    them all. The session is sized for the input as long as the warehouse is open: `close`, or the
    end of a `with` block, puts back the settings from before.
    """

    def __init__(
        self,
        staging: Mapping[str, DataFrame],
        store: TableStore,
        rejects: Mapping[str, DataFrame] | None = None,
        sizing: Sizing | None = None,
        version: int | None = None,
    ):
        self.sizing = sizing
        self.version = version
        self.staging = staging
        self.store = store
        self.rejects = rejects or {}

    @classmethod
    def from_files(
        cls,
        spark: SparkSession,
        paths: Mapping[str, str],
        folder: str,
        comma: bool = False,
        max_rejects: int | None = None,
        keep_seconds: float = KEEP_SECONDS,
    ) -> "Warehouse":
        """Loads raw files into `folder`, as the version that is read from then on.

        It is published only once all of its tables are complete. If that fails, or if a file has
        more than `max_rejects` malformed rows, the version before stays the one that is read.
        Replaced versions can be opened for `keep_seconds` longer, which must be more than a load
        takes.
        """
        input_bytes = source_state(spark, paths.values())[1]
        sizing = Sizing(spark, input_bytes).apply()
        try:
            loads = Loads(spark, folder, keep_seconds)
            store = loads.begin()
            for name, df in files.read_all(spark, paths, comma).items():
                store.replace(f"{_LOADED}{name}", df, files.is_rejected())
                rejects = store.count(f"{_LOADED}{name}")["rejected"]
                if max_rejects is not None and rejects > max_rejects:
                    raise TooManyRejects(
                        f"{rejects} malformed rows in {paths[name]}, {max_rejects} are allowed"
                    )
            warehouse = cls._over(store, sizing)
            warehouse.rebuild()
            warehouse.version = loads.publish(store, input_bytes=input_bytes)
        except BaseException:
            sizing.restore()
            raise
        return warehouse

    @classmethod
    def open(cls, spark: SparkSession, folder: str, version: int | None = None) -> "Warehouse":
        """A warehouse loaded earlier, the last one or another that is still kept, with the session
        sized as for loading it."""
        store, about = Loads(spark, folder).published(version)
        sizing = Sizing(spark, about["input_bytes"]).apply()
        return cls._over(store, sizing, about["version"])

    @classmethod
    def _over(
        cls, store: TableStore, sizing: Sizing, version: int | None = None
    ) -> "Warehouse":
        loaded = {name: store.existing(f"{_LOADED}{name}") for name in STAGING}
        return cls(
            {name: files.accepted(df) for name, df in loaded.items()},
            store,
            {name: files.rejected(df) for name, df in loaded.items()},
            sizing,
            version,
        )

    def close(self) -> None:
        if self.sizing:
            self.sizing.restore()

    def __enter__(self) -> "Warehouse":
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def __getitem__(self, name: str) -> DataFrame:
        columns = _PROJECTIONS.get(name, (name, None))[1]
        rows = self.dealt(name)
        return rows.select(*columns) if columns else rows

    def traced(self, name: str) -> DataFrame:
        """The table as it is stored, with the rows that a rule dropped."""
        source = _PROJECTIONS.get(name, (name,))[0]
        rows = self.store.table(source, self._builders[source], self._buckets(source))
        return once(rows) if source == "placed_orders" else rows

    def dealt(self, name: str) -> DataFrame:
        """The rows of a table as it lies in buckets, with the salt of their order if it has one."""
        return kept(self.traced(name))

    def star_as_dealt(self) -> dict[str, DataFrame]:
        return {name: self.dealt(name) for name in STAR}

    def order_places(self) -> DataFrame:
        """Each order in every bucket that rows of it may be in."""
        stored = self.store.table(
            "placed_orders", self._builders["placed_orders"], self._buckets("placed_orders")
        )
        return kept(stored)

    def _buckets(self, name: str) -> Buckets | None:
        if name not in _BUCKETED:
            return None
        return Buckets(self._bucket_count, sort=_BUCKETED[name])

    @property
    def _bucket_count(self) -> int:
        if self.sizing:
            return self.sizing.partitions
        return int(self.store.spark.conf.get("spark.sql.shuffle.partitions"))

    def staging_counts(self) -> DataFrame:
        """Rows of each staging table as counted when it was written; nothing is scanned."""
        for name in STAGING:
            self.staging[name]  # written by now
        name = F.regexp_replace("table_name", f"^{_LOADED}", "")
        return self.store.counts_table().where(name.isin(*STAGING)).select(
            name.alias("staging_table"), (F.col("rows") - F.col("rejected")).alias("rows_loaded")
        )

    def loss_ledger(self) -> DataFrame:
        return quality.loss_ledger(
            self.staging_counts(), {name: self.traced(name) for name in STAR}
        )

    def check_files(self, names: Iterable[str] | None = None) -> DataFrame:
        """Rows and files of written tables, staging under its own names, as they were written and
        as found now in the files' footers. All stored tables if none are named."""
        names = list(names or (*STAGING, *self.stored))
        known = set(self.store.counts())
        for name in names:
            if not {name, f"{_LOADED}{name}"} & known:
                self.staging[name] if name in STAGING else self.traced(name)  # written by now
        stored = [f"{_LOADED}{n}" if f"{_LOADED}{n}" in known else n for n in names]
        own_name = F.regexp_replace("table_name", f"^{_LOADED}", "")
        return self.store.check(stored).withColumn("table_name", own_name)

    def __iter__(self) -> Iterator[str]:
        return iter([*STAR, *(n for n in self._builders if n not in STAR)])

    def __len__(self) -> int:
        return len(list(iter(self)))

    @property
    def stored(self) -> list[str]:
        """Tables that are written, parents before children."""
        return list(self._builders)

    def rebuild(self) -> None:
        """Writes every table again, parents before children."""
        for name, build in self._builders.items():
            self.store.replace(name, build(), buckets=self._buckets(name))

    def register_views(self) -> None:
        """Makes the tables available to spark.sql under their own names."""
        for name in STAGING:
            self.staging[name].createOrReplaceTempView(name)
        for name in (*STAR, "sales_lines"):
            self[name].createOrReplaceTempView(name)

    @cached_property
    def _builders(self):
        """Insertion order is dependency order."""
        stg = self.staging
        return {
            "dim_customers": lambda: cleaning.traced_customers(stg["stg_customers"]),
            "dim_sellers": lambda: cleaning.traced_sellers(stg["stg_sellers"]),
            "dim_products": lambda: cleaning.traced_products(
                stg["stg_products"], stg["stg_category"]
            ),
            "hot_orders": lambda: hot_orders(
                [stg["stg_order_items"], stg["stg_order_payments"]], self._bucket_count
            ),
            "placed_orders": self._dealt_orders,
            "fact_payments": lambda: cleaning.traced_payments(
                self._dealt_by_order(
                    cleaning.single_payments(stg["stg_order_payments"]), "payment_seq"
                ),
                self.order_places(),
            ),
            "sales_lines": lambda: mart.traced_sales(
                cleaning.traced_lines(stg["stg_order_items"]),
                self.order_places(),
                self["dim_products"],
                self["dim_sellers"],
                lambda lines: self._dealt_by_order(lines, "item_seq"),
            ),
            "order_totals": lambda: mart.order_totals(self["sales_lines"]),
            "customer_totals": lambda: mart.customer_totals(self["order_totals"]),
            "rfm_borders": lambda: advanced.rfm_borders(self["customer_totals"]),
            "seller_positions": lambda: in_global_order(
                mart.seller_totals(self["sales_lines"]), [F.desc("revenue"), F.asc("seller_id")]
            ),
        }

    def _dealt_orders(self) -> DataFrame:
        stg = self.staging
        # What orders and hot orders are made from, written side by side.
        at_once(stg, ["stg_order_items", "stg_orders", "stg_customers", "stg_order_payments"])
        return dealt_orders(
            mart.traced_orders(
                cleaning.traced_headers(stg["stg_orders"]), self["dim_customers"]
            ),
            self["hot_orders"],
            self._bucket_count,
        )

    def _dealt_by_order(self, rows: DataFrame, by: str) -> DataFrame:
        return dealt(rows, by, self["hot_orders"], self._bucket_count)

    def sellers_ranked(self, running: bool = False) -> DataFrame:
        return with_rank(self["seller_positions"], "revenue" if running else None)


_by_source: dict[tuple[str, str], Warehouse] = {}
_lock = threading.Lock()


def testdata_warehouse(spark: SparkSession, sf_dir: str) -> Warehouse:
    """Warehouse over the bound test tables, shared by all queries of this application.

    The tables are found again by the state of the source files, not by their path
    alone, and are gone when the application ends.
    """
    application = spark.sparkContext.applicationId
    source, size = source_state(spark, testdata.base_paths(sf_dir))
    key = (application, source)
    with _lock:
        if key not in _by_source:
            own = f"{shared_folder(spark)}/stallkeeper-{application}"
            delete_at_exit(spark, own)
            store = TableStore(spark, f"{own}/{source}")
            staging = StoredTables(store, testdata.bind(spark, sf_dir))
            sizing = Sizing(spark, size, PACKED_BYTES_PER_PARTITION)
            _by_source[key] = Warehouse(staging, store, sizing=sizing)
        warehouse = _by_source[key]
        warehouse.sizing.apply()
        return warehouse
