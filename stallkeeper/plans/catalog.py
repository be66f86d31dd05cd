"""Every query by name: over a warehouse, and over the bound test tables."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stallkeeper.operators import quality
from stallkeeper.plans import advanced, business
from stallkeeper.plans.warehouse import Warehouse, testdata_warehouse
from stallkeeper.sources import files
from stallkeeper.sources.schemas import STAGING

Query = Callable[[SparkSession, str], DataFrame]


def _with_bigints(df: DataFrame) -> DataFrame:
    """Integers as bigint, the type both engines agree on."""
    return df.select(
        *[
            F.col(name).cast("bigint").alias(name) if kind in ("int", "bigint") else F.col(name)
            for name, kind in df.dtypes
        ]
    )


def _reloaded_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Staging orders written as tab separated lines, some short or long, and loaded again."""
    w = testdata_warehouse(spark, sf_dir)
    fields = [F.col(c) for c in STAGING["stg_orders"].names]
    number = F.col("order_id").cast("bigint")
    line = (
        F.when(number % 37 == 0, files.tab_joined(fields[:-1]))
        .when(number % 43 == 0, files.tab_joined([*fields, F.lit("extra")]))
        .otherwise(files.tab_joined(fields))
    )
    lines = w.staging["stg_orders"].select(line.alias("value"))
    path = w.store.export("exported_orders", lambda to: lines.write.mode("overwrite").text(to))
    return w.store.table(
        "loaded_exported_orders",
        lambda: files.read_tab_separated(spark, path, STAGING["stg_orders"], header=False),
    )


def _rfm_scores(w: Warehouse) -> DataFrame:
    return advanced.a4_rfm_scores(w["customer_totals"], w["rfm_borders"], w["fact_orders"])


REPORTS: dict[str, Callable[[Warehouse], DataFrame]] = {
    "staging_counts": lambda w: w.staging_counts(),
    "dq_profile": lambda w: quality.dq_profile(w.staging),
    "reconcile_counts": lambda w: quality.reconcile_counts(w.staging, w),
    "loss_ledger": lambda w: w.loss_ledger(),
    "check_files": lambda w: w.check_files(STAGING).drop("files_written", "files_found"),
    "check_primary_keys": lambda w: quality.check_primary_keys(w.staging, w.star_as_dealt()),
    "check_foreign_keys": lambda w: quality.check_foreign_keys(
        w.staging, w.star_as_dealt(), w.order_places()
    ),
    "check_not_null": lambda w: quality.check_not_null(w.staging, w),
    "check_lengths": lambda w: quality.check_lengths(w.staging, w),
    "dim_customers": lambda w: w["dim_customers"],
    "dim_products": lambda w: w["dim_products"],
    "dim_sellers": lambda w: w["dim_sellers"],
    "fact_orders": lambda w: w["fact_orders"],
    "fact_order_items": lambda w: w["fact_order_items"],
    "fact_payments": lambda w: w["fact_payments"],
    "sales_lines": lambda w: w["sales_lines"],
    "q1_kpis": lambda w: business.q1_kpis(w["customer_totals"]),
    "q2_monthly_revenue": lambda w: business.q2_monthly_revenue(w["order_totals"]),
    "q3_category_share": lambda w: business.q3_category_share(w.dealt("sales_lines")),
    "q4a_top_sellers": lambda w: business.q4a_top_sellers(w.dealt("sales_lines")),
    "q4b_top_categories": lambda w: business.q4b_top_categories(w.dealt("sales_lines")),
    "q5a_status_mix": lambda w: business.q5a_status_mix(w["fact_orders"]),
    "q5b_cancellation_rate": lambda w: business.q5b_cancellation_rate(w["fact_orders"]),
    "q6_revenue_by_state": lambda w: business.q6_revenue_by_state(w["order_totals"]),
    "q7_payment_mix": lambda w: business.q7_payment_mix(w["fact_payments"]),
    "q8_loyalty": lambda w: business.q8_loyalty(w["customer_totals"]),
    "q9_delivery": lambda w: business.q9_delivery(w["fact_orders"]),
    "a1_mom_growth": lambda w: advanced.a1_mom_growth(w["order_totals"]),
    "a2_cumulative_revenue": lambda w: advanced.a2_cumulative_revenue(w["order_totals"]),
    "a3_top_seller_per_category": lambda w: advanced.a3_top_seller_per_category(
        w["sales_lines"]
    ),
    "a4_rfm_scores": _rfm_scores,
    "a4_rfm_segments": lambda w: advanced.a4_rfm_segments(_rfm_scores(w)),
    "a5_pareto": lambda w: advanced.a5_pareto(w.sellers_ranked()),
    "a5_seller_curve": lambda w: advanced.a5_seller_curve(w.sellers_ranked(running=True)),
    "a6_cohorts": lambda w: advanced.a6_cohorts(w["customer_totals"]),
    "a7_delivery_sla": lambda w: advanced.a7_delivery_sla(w["placed_orders"]),
}


def _bound(plan: Callable[[Warehouse], DataFrame]) -> Query:
    return lambda spark, sf_dir: _with_bigints(plan(testdata_warehouse(spark, sf_dir)))


def _load_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.accepted(_reloaded_orders(spark, sf_dir))


def _load_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.rejected(_reloaded_orders(spark, sf_dir))


def _load_comma_separated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Staging customers written as quoted text with a header, and loaded again."""
    w = testdata_warehouse(spark, sf_dir)
    customers = w.staging["stg_customers"]
    path = w.store.export(
        "exported_customers", lambda to: files.write_comma_separated(customers, to)
    )
    return files.accepted(
        w.store.table(
            "loaded_exported_customers",
            lambda: files.read_comma_separated(spark, path, STAGING["stg_customers"]),
        )
    )


def _preview_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.preview(testdata_warehouse(spark, sf_dir).staging["stg_customers"], 5)


def all_queries() -> dict[str, Query]:
    return {
        **{name: _bound(plan) for name, plan in REPORTS.items()},
        "load_accepted": _load_accepted,
        "load_rejects": _load_rejects,
        "load_comma_separated": _load_comma_separated,
        "preview_customers": _preview_customers,
    }
