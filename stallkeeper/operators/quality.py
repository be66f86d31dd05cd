"""Counts, quality profile and declared constraints, on staging and on the star."""

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stallkeeper.functions.casts import blank, folded, to_int, to_money, to_timestamp
from stallkeeper.operators.buckets import SALT, with_salt
from stallkeeper.operators.cleaning import RULES_OF
from stallkeeper.operators.dedup import COPIES, DUPLICATE, LOST_BY
from stallkeeper.sources.schemas import CONVERSIONS, FOREIGN_KEYS, LENGTHS, RULES, STAGING

Tables = Mapping[str, DataFrame]


def _union_all(parts: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def preview(df: DataFrame, n: int = 5) -> DataFrame:
    """The first n rows in the order of all columns, for a first look: any n would do, and these
    are the same ones every time, without a full sort."""
    return df.orderBy(*df.columns).limit(n)


def staging_counts(staging: Tables) -> DataFrame:
    return _union_all(
        staging[name].agg(
            F.lit(name).alias("staging_table"), F.count(F.lit(1)).alias("rows_loaded")
        )
        for name in STAGING
    )


def _unconverted(name: str) -> dict[str, Column]:
    """For each converted column, whether a text that is not blank becomes NULL."""
    to_type = {"int": to_int, "money": to_money, "timestamp": to_timestamp}
    return {
        f"text not converted: {name}.{column}": ~blank(F.col(column))
        & to_type[kind](F.col(column)).isNull()
        for column, kind in CONVERSIONS[name].items()
    }


def dq_profile(staging: Tables) -> DataFrame:
    """Findings on the raw text, one pass per table.

    Where keys have to be told apart, everything is counted for each key first and then summed, so
    that no key's rows are repeated for it.
    """
    undated = (folded(F.col("order_status")) == "delivered") & (
        F.col("order_delivered_customer_date").isNull()
        | (F.rtrim("order_delivered_customer_date") == "")
    )
    price = to_money(F.col("price"))
    # The texts of the first five checks.
    people = "customer_id rows vs real people (unique_id)"
    copies = "duplicate order_item keys (order_id,item_id)"
    conditions = {
        "stg_customers": {},
        "stg_products": {"products with missing category": blank(F.col("product_category_name"))},
        "stg_orders": {"orders marked delivered but no delivery date": undated},
        "stg_order_items": {
            "order_items with non-numeric/negative price": price.isNull() | (price < 0)
        },
        "stg_order_payments": {},
    }
    keys = {
        "stg_customers": [F.col("customer_unique_id")],
        "stg_order_items": [
            F.coalesce(c, F.lit("")) for c in ("order_id", "order_item_id")
        ],
    }
    rows, different = F.sum("n"), F.count("k0")
    on_keys = {
        "stg_customers": {
            people: F.concat(
                F.coalesce(rows, F.lit(0)).cast("string"), F.lit(" rows / "),
                different.cast("string"), F.lit(" people"),
            )
        },
        "stg_order_items": {copies: (F.coalesce(rows, F.lit(0)) - different).cast("string")},
    }

    def profile(name: str) -> DataFrame:
        own = conditions[name]
        checks = own | _unconverted(name)
        counts = [F.count_if(c.isNotNull() & c).alias(f"c{i}") for i, c in enumerate(checks.values())]
        by = [k.alias(f"k{i}") for i, k in enumerate(keys.get(name, [F.lit(0)]))]
        if name not in keys:
            counted = staging[name].agg(F.count(F.lit(1)).alias("n"), *counts)
        else:
            counted = staging[name].groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *counts)
        found = {
            # As a sum of cases, which is NULL over no rows.
            check: (F.when(rows > 0, F.sum(f"c{i}")) if check in own else F.coalesce(
                F.sum(f"c{i}"), F.lit(0)
            )).cast("string")
            for i, check in enumerate(checks)
        } | on_keys.get(name, {})
        listed = [
            F.struct(F.lit(check).alias("check_name"), value.alias("finding"))
            for check, value in found.items()
        ]
        return counted.agg(F.array(*listed).alias("f")).select(F.inline("f"))

    return _union_all(profile(name) for name in conditions)


def reconcile_counts(staging: Tables, star: Tables) -> DataFrame:
    """Raw and clean row counts side by side."""

    def counted(df: DataFrame, entity: str, raw: int) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("n")).select(
            F.lit(entity).alias("entity"),
            (F.col("n") * raw).alias("raw_rows"),
            (F.col("n") * (1 - raw)).alias("clean_rows"),
        )

    counts = _union_all(
        part
        for table, rules in RULES.items()
        for part in (
            counted(staging[rules.staging], rules.entity, 1),
            counted(star[table], rules.entity, 0),
        )
    )
    return counts.groupBy("entity").agg(
        F.sum("raw_rows").alias("raw_rows"), F.sum("clean_rows").alias("clean_rows")
    )


def loss_ledger(raw_counts: DataFrame, tables: Tables) -> DataFrame:
    """For every rule of a table, how many raw rows it was the first to drop: raw rows less all of
    them are the clean ones.

    `tables` are the traced forms of the star tables, which count what they drop as they are built;
    `raw_counts` has the rows of each staging table as counted when it was written.
    """
    found = _union_all(
        df.groupBy(LOST_BY)
        .agg(F.count(F.lit(1)).alias("n"), F.sum(COPIES).alias("copies"))
        .select(F.lit(table).alias("t"), LOST_BY, "n", "copies")
        for table, df in tables.items()
    )
    # A row that was de-duplicated stands for its copies, whether it stays or loses a parent later.
    later = [(t, r) for t, rules in RULES_OF.items() for r in rules[rules.index(DUPLICATE) + 1 :]]
    single = F.col(LOST_BY).isNull() | F.struct("t", LOST_BY).isin(
        *[F.struct(F.lit(t).alias("t"), F.lit(r).alias(LOST_BY)) for t, r in later]
    )
    lost = found.select(
        "t",
        F.inline(
            F.array(
                F.struct(
                    F.col(LOST_BY).alias("reason"),
                    F.when(single, F.col("n")).otherwise(F.col("copies")).alias("lost"),
                ),
                F.struct(
                    F.lit(DUPLICATE).alias("reason"),
                    F.when(single, F.col("copies") - F.col("n")).otherwise(0).alias("lost"),
                ),
            )
        ),
    )
    lost = lost.groupBy("t", "reason").agg(F.sum("lost").alias("lost_rows"))
    names = found.sparkSession.createDataFrame(
        [(t, RULES[t].entity, RULES[t].staging, r) for t in tables for r in RULES_OF[t]],
        "t string, entity string, staging_table string, reason string",
    )
    clean = lost.where("reason IS NULL").select("t", F.col("lost_rows").alias("clean"))
    return (
        names.join(lost, ["t", "reason"], "left")
        .join(clean, "t", "left")
        .join(raw_counts, "staging_table")
        .select(
            "entity",
            "reason",
            F.coalesce("lost_rows", F.lit(0)).alias("lost_rows"),
            F.col("rows_loaded").alias("raw_rows"),
            F.coalesce("clean", F.lit(0)).alias("clean_rows"),
        )
    )


def check_primary_keys(staging: Tables, star: Tables) -> DataFrame:
    """Number of keys held by more than one row. Tables dealt by order are counted where they lie."""

    def repeated(df: DataFrame, keys: tuple[str, ...], stage: str, table: str) -> DataFrame:
        return (
            df.groupBy(*with_salt(df, keys))
            .agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") > 1)
            .agg(F.count(F.lit(1)).alias("duplicate_keys"))
            .select(F.lit(stage).alias("stage"), F.lit(table).alias("table_name"), "duplicate_keys")
        )

    return _union_all(
        part
        for table, rules in RULES.items()
        for part in (
            repeated(staging[rules.staging], rules.raw_key, "raw", rules.staging),
            repeated(star[table], rules.key, "clean", table),
        )
    )


def check_foreign_keys(
    staging: Tables, star: Tables, order_places: DataFrame | None = None
) -> DataFrame:
    """Rows whose parent is missing. A NULL reference is not an orphan.

    Each child is read once for all of its references. They are counted per key before the one
    join, so a missing parent that very many rows point at is a single row in the shuffle. Children
    dealt by order meet `order_places` in their own buckets, without a shuffle.
    """
    edges = []
    for fk in FOREIGN_KEYS:
        raw = RULES[fk.child].staging, RULES[fk.parent].staging
        edges += [("raw", *raw, fk.column), ("clean", fk.child, fk.parent, fk.column)]
    numbered = list(enumerate(edges))
    tables = {"raw": staging, "clean": star}

    def in_place(edge: tuple) -> bool:
        stage, child, _, column = edge
        return (
            order_places is not None and stage == "clean" and column == "order_id"
            and SALT in tables[stage][child].columns
        )

    def pair(edge: int, column: str) -> Column:
        return F.struct(F.lit(edge).alias("edge"), F.col(column).alias("key"))

    def references(stage: str, child: str) -> DataFrame:
        own = [pair(n, e[3]) for n, e in elsewhere if e[:2] == (stage, child)]
        return tables[stage][child].select(F.inline(F.array(*own))).where("key IS NOT NULL")

    elsewhere = [(n, e) for n, e in numbered if not in_place(e)]
    counted = _union_all(references(*child) for child in dict.fromkeys(e[:2] for _, e in elsewhere))
    counted = counted.groupBy("edge", "key").agg(F.count(F.lit(1)).alias("n"))
    parents = _union_all(
        tables[stage][parent].select(F.lit(n).alias("edge"), F.col(column).alias("key"))
        for n, (stage, _, parent, column) in elsewhere
    )
    orphans = [counted.join(parents, ["edge", "key"], "left_anti").select("edge", "n")]
    for n, (stage, child, _, column) in numbered:
        if in_place((stage, child, None, column)):
            rows = tables[stage][child].where(F.col(column).isNotNull())
            rows = rows.groupBy(column, SALT).agg(F.count(F.lit(1)).alias("n"))
            missing = rows.join(order_places, [column, SALT], "left_anti")
            orphans.append(missing.select(F.lit(n).alias("edge"), "n"))
    found = _union_all(orphans).groupBy("edge").agg(F.sum("n").alias("n"))
    names = found.sparkSession.createDataFrame(
        [(n, *e) for n, e in numbered],
        "edge int, stage string, child string, parent string, column_name string",
    )
    return names.join(found, "edge", "left").select(
        "stage", "child", "parent", "column_name", F.coalesce("n", F.lit(0)).alias("orphans")
    )


def check_not_null(staging: Tables, star: Tables) -> DataFrame:
    """NULLs per column declared NOT NULL, one pass per table."""

    def nulls(df: DataFrame, columns: tuple[str, ...], stage: str, table: str) -> DataFrame:
        counts = F.array(
            *[
                F.struct(
                    F.lit(stage).alias("stage"),
                    F.lit(table).alias("table_name"),
                    F.lit(c).alias("column_name"),
                    F.count_if(F.col(c).isNull()).alias("nulls"),
                )
                for c in columns
            ]
        )
        return df.agg(counts.alias("c")).select(F.inline("c"))

    return _union_all(
        part
        for table, rules in RULES.items()
        for part in (
            nulls(staging[rules.staging], rules.raw_not_null, "raw", rules.staging),
            nulls(star[table], rules.not_null, "clean", table),
        )
    )


def check_lengths(staging: Tables, star: Tables) -> DataFrame:
    """Longest text of each column, in characters, and how many are longer than declared; one pass
    per table. Nothing is cut: this says what a store that keeps to the lengths would refuse."""

    def measured(df: DataFrame, stage: str, table: str) -> DataFrame:
        found = F.array(
            *[
                F.struct(
                    F.lit(stage).alias("stage"),
                    F.lit(table).alias("table_name"),
                    F.lit(column).alias("column_name"),
                    F.lit(declared).alias("declared"),
                    F.max(F.length(column)).alias("longest"),
                    F.count_if(F.length(column) > declared).alias("too_long"),
                )
                for column, declared in LENGTHS[table].items()
            ]
        )
        return df.agg(found.alias("f")).select(F.inline("f"))

    return _union_all(
        measured(staging[table] if table in STAGING else star[table], stage, table)
        for table in LENGTHS
        for stage in ["raw" if table in STAGING else "clean"]
    )
