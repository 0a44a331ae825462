"""Panels drawn from the warehouse tables.

Money is summed as whole cents, so sums do not depend on row order; every sum is
partially aggregated before its shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Scale for panels whose statistics are compared after rounding: a prime near a
# million, so that no scaled sum of cents lies on a rounding boundary.
SCALE = 1_000_003.0


# Columns read here, so that no scan has to look into files for its schema.
SCHEMAS = {
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def cents(column: str) -> Column:
    """Amount as a whole number of cents: sums are exact and stay in one register."""
    return F.floor(F.col(column) * 100 + 0.5)


def money(column: str) -> Column:
    return F.sum(cents(column)).cast("double") / 100


def period(freq: str, column: str) -> Column:
    day = F.col(column).cast("date")
    return day if freq == "day" else F.trunc(day, freq)


def orders_by_priority(spark: SparkSession, sf_dir: str, *, start: str | None = None, end: str | None = None) -> DataFrame:
    """Monthly order value per priority; one panel."""
    orders = table(spark, sf_dir, "orders")
    if start is not None:
        orders = orders.where(F.col("o_orderdate") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        orders = orders.where(F.col("o_orderdate") < F.lit(end).cast("timestamp_ntz") + F.expr("interval 1 day"))
    return orders.groupBy(
        F.lit("all").alias("panel_id"),
        F.col("o_orderpriority").alias("series_id"),
        period("month", "o_orderdate").alias("ts"),
    ).agg(money("o_totalprice").alias("value"))


def scaled_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders_by_priority(spark, sf_dir).withColumn("value", F.col("value") / F.lit(SCALE))


def orders_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly order value per nation (panel) and market segment (series).

    Customers are joined first and summed away in the same stage. A customer with
    very many orders is a hot join key, which adaptive execution splits: nothing
    between the join and the partial sums asks for its partitioning.
    """
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_totalprice")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    per_segment = (
        orders.join(customer, orders.o_custkey == customer.c_custkey)
        .groupBy("c_nationkey", "c_mktsegment", period("month", "o_orderdate").alias("ts"))
        .agg(money("o_totalprice").alias("value"))
    )
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return per_segment.join(nation, per_segment.c_nationkey == nation.n_nationkey).select(
        F.col("n_name").alias("panel_id"),
        F.col("c_mktsegment").alias("series_id"),
        "ts",
        "value",
    )


def scaled_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders_by_nation(spark, sf_dir).withColumn("value", F.col("value") / F.lit(SCALE))


def events_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily event value per user."""
    return (
        table(spark, sf_dir, "events")
        .groupBy(
            F.lit("all").alias("panel_id"),
            F.col("user_id").cast("string").alias("series_id"),
            period("day", "ts").alias("day"),
        )
        .agg(money("value").alias("value"))
        .withColumnRenamed("day", "ts")
    )


MIXED_SERIES = ("spend_m", "price_m", "count_m", "output_q", "yield_d")


def _parts(rows: DataFrame, series: dict[str, tuple[Column, Column, Column]]) -> DataFrame:
    """Unfold each aggregated row into one (series_id, ts, a, b) row per series."""
    cells = [
        F.struct(F.lit(name).alias("series_id"), ts.alias("ts"), a.cast("bigint").alias("a"), b.cast("bigint").alias("b"))
        for name, (ts, a, b) in series.items()
    ]
    return rows.select(F.explode(F.array(*cells)).alias("_c")).select("_c.*")


def mixed_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five macro-like series at monthly, quarterly and daily frequency.

    Each table is scanned once and summed per day (orders: per month); the small
    sums are then unfolded to their series and summed per period.
    """
    late = (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F") & (F.col("l_quantity") > 40)
    days = (
        table(spark, sf_dir, "lineitem")
        .groupBy(period("day", "l_shipdate").alias("day"))
        .agg(
            F.sum(cents("l_extendedprice")).alias("price"),
            F.sum(cents("l_quantity")).alias("quantity"),
            F.sum(F.when(late, cents("l_discount"))).alias("discount"),
            F.count_if(late).alias("late"),
        )
    )
    months = (
        table(spark, sf_dir, "orders")
        .groupBy(period("month", "o_orderdate").alias("month"))
        .agg(F.count(F.lit(1)).alias("orders"), F.sum(cents("o_totalprice")).alias("total"))
    )
    one = F.lit(1)
    ship_month = F.trunc("day", "month")
    shipped = _parts(
        days,
        {
            "spend_m": (ship_month, F.col("price"), one),
            "price_m": (ship_month, F.col("price"), F.col("quantity")),
            "yield_d": (F.col("day"), F.col("discount"), F.when(F.col("late") > 0, F.col("late"))),
        },
    )
    ordered = _parts(
        months,
        {
            "count_m": (F.col("month"), F.col("orders"), one),
            "output_q": (F.trunc("month", "quarter"), F.col("total"), one),
        },
    )
    # a is in cents, but for the count; b is in cents for the price only.
    a, b = F.sum("a").cast("double"), F.sum("b").cast("double")
    value = (
        F.when(F.col("series_id") == "price_m", F.round((a / 100) / (b / 100), 6))
        .when(F.col("series_id") == "yield_d", F.round(F.lit(100.0) * (a / 100) / b, 6))
        .when(F.col("series_id") == "count_m", a)
        .otherwise(a / 100)
    )
    return (
        shipped.unionByName(ordered)
        .where(F.col("b").isNotNull())
        .groupBy("series_id", "ts")
        .agg(value.alias("value"))
        .select(F.lit("all").alias("panel_id"), "series_id", "ts", "value")
    )


def vectors_as_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each embedding vector as a short series, one point per dimension."""
    return (
        table(spark, sf_dir, "embeddings")
        .select("vec_id", F.posexplode("embedding").alias("i", "v"))
        .select(
            F.lit("all").alias("panel_id"),
            F.col("vec_id").cast("string").alias("series_id"),
            F.date_add(F.lit("2000-01-01").cast("date"), F.col("i")).alias("ts"),
            F.round(F.col("v").cast("double"), 6).alias("value"),
        )
    )


def brand_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feature -> score table: mean retail price per brand."""
    return (
        table(spark, sf_dir, "part")
        .groupBy(F.lit("all").alias("panel_id"), F.col("p_brand").alias("feature"))
        .agg(F.round(money("p_retailprice") / F.count("*").cast("double"), 6).alias("agg_mse"))
    )
