"""The full load of a sales warehouse as steps that can be run again: dates, products, customers, daily sales, summary."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime, timezone

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from datamove.functions import scalar
from datamove.operators import patterns
from datamove.plans.load import log_step

LOG_COLUMNS = "step_name string, rows_loaded bigint, started_at timestamp, finished_at timestamp, message string"


def finished_steps(spark: SparkSession, log_table: str, run: str) -> list[str]:
    """Names of the run's steps that the log calls finished; one row a step at most."""
    rows = spark.table(log_table).where(F.col("step_name").startswith(f"{run}/") & F.col("message").isNull())
    return [r.step_name.removeprefix(f"{run}/") for r in rows.select("step_name").distinct().collect()]


def run_steps(spark: SparkSession, log_table: str, run: str, steps: list[tuple[str, Callable[[], int]]]) -> DataFrame:
    """Run the steps in order, each followed by a row in the log; a step that the log has as finished for this `run` is passed over, so that a load that was
    broken off goes on behind its last finished step. A failing step leaves a row with its message and ends the run.

    A step must leave the same table however often it runs: it may be repeated when the load ended between its write and its log row."""
    done = set(finished_steps(spark, log_table, run))
    for name, step in steps:
        if name in done:
            continue
        started = datetime.now(timezone.utc)
        try:
            rows = step()
        except Exception as e:
            log_step(spark, log_table, f"{run}/{name}", started, message=str(e) or type(e).__name__)
            raise
        log_step(spark, log_table, f"{run}/{name}", started, rows)
    names = spark.createDataFrame([(i, n) for i, (n, _) in enumerate(steps, 1)], "step int, name string")
    log = spark.table(log_table).where(F.col("step_name").startswith(f"{run}/") & F.col("message").isNull())
    return names.join(log.withColumn("name", F.expr(f"substring(step_name, {len(run) + 2})")), "name").select("step", "name", "rows_loaded", "started_at", "finished_at")


def overwrite(df: DataFrame, table: str, location: str) -> int:
    """The table's rows, replaced; returns how many were written."""
    seen = Observation()
    (df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").format("parquet").option("path", location).saveAsTable(table))
    return int(seen.get["rows"])


def full_load(spark: SparkSession, sources: dict[str, Callable[[], DataFrame]], tables: dict[str, tuple[str, str]], log_table: str, run: str,
              first: date, last: date, cancelled: str) -> DataFrame:
    """Load dim_date, dim_product, dim_customer, fact_daily_sales and sales_summary from the sources customer (customer_id, customer_key, country, ...), product,
    orders (order_id, customer_id, order_date, status) and lines (order_id, quantity, amount); later steps read the tables that earlier ones wrote.
    `tables` names each step's table and place. Returns the log's row of every step."""
    def facts() -> DataFrame:
        daily = patterns.daily_sales(sources["orders"](), sources["lines"](), cancelled)
        customers = spark.table(tables["dim_customer"][0])
        return patterns.lookup(daily, customers, ["customer_id"], ["customer_key"]).select("order_date", "customer_key", "order_count", "total_quantity", "total_amount")

    made: dict[str, Callable[[], DataFrame]] = {
        "dim_date": lambda: patterns.dim_date(spark, first, last), "dim_product": sources["product"], "dim_customer": sources["customer"], "fact_daily_sales": facts,
        "sales_summary": lambda: patterns.sales_summary(spark.table(tables["fact_daily_sales"][0]), spark.table(tables["dim_customer"][0]))}
    return run_steps(spark, log_table, run, [(name, lambda name=name, rows=rows: overwrite(rows(), *tables[name])) for name, rows in made.items()])


def customer_dimension(customers: DataFrame) -> DataFrame:
    """Active customers with their surrogate key, full name and e-mail parts."""
    return customers.where("is_active").select(
        "customer_id", (F.col("customer_id") + 1000).alias("customer_key"), scalar.full_name(F.col("first_name"), F.col("last_name")).alias("full_name"),
        F.lower("email").alias("email"), F.lower(scalar.text_after(F.col("email"), "@")).alias("email_domain"), "city", "country")
