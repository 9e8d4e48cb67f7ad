"""Column helpers for expressions that legacy dialects spell differently. Everything stays a built-in Spark expression."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed value: the fiscal year starts on the first of this month.
FISCAL_START_MONTH = 4


def iif(condition: Column, then: Column, otherwise: Column) -> Column:
    """IIF / IFF."""
    return F.when(condition, then).otherwise(otherwise)


def choose(index: Column, values: list[str]) -> Column:
    """CHOOSE: 1-based pick from a list; NULL outside it."""
    return F.when(index.between(1, len(values)), F.elt(index.cast("int"), *[F.lit(v) for v in values]))


def find_text(text: Column, needle: str) -> Column:
    """FINDSTRING / CHARINDEX / INSTR: 1-based position, 0 when absent."""
    return F.instr(text, needle)


def text_after(text: Column, needle: str) -> Column:
    """What follows the first occurrence of `needle` (all of the text when it is absent)."""
    return F.substring(text, F.instr(text, needle) + F.lit(1), F.length(text))


def full_name(first: Column, last: Column) -> Column:
    return F.concat(F.trim(first), F.lit(" "), F.trim(last))


def money(col: Column, precision: int = 18, scale: int = 2) -> Column:
    """Amounts are summed as decimals, so the result does not depend on the order of the rows."""
    return col.cast(f"decimal({precision},{scale})")


def line_amount(quantity: Column, price: Column, discount: Column) -> Column:
    """quantity * price * (1 - discount) with every factor a decimal."""
    one = F.lit(1).cast("decimal(5,4)")
    return (money(quantity, 10, 0) * money(price, 12, 2) * (one - money(discount, 5, 4))).cast("decimal(27,6)")


def date_key(day: Column) -> Column:
    """yyyymmdd as a number."""
    return (F.year(day) * 10000 + F.month(day) * 100 + F.dayofmonth(day)).cast("int")


def month_start(day: Column) -> Column:
    return F.trunc(day, "month")


def fiscal_year(day: Column) -> Column:
    return (F.year(day) + F.when(F.month(day) >= FISCAL_START_MONTH, 1).otherwise(0)).cast("int")


def iso_date(ts: Column) -> Column:
    """CONVERT(..., 120) / TO_CHAR(..., 'YYYY-MM-DD')."""
    return F.date_format(ts, "yyyy-MM-dd")


def days_between(earlier: Column, later: Column) -> Column:
    """DATEDIFF(DAY, earlier, later): calendar days."""
    return F.datediff(later, earlier)


# The same rule as a SQL function, for SQL users.
FISCAL_YEAR_SQL = f"""
CREATE OR REPLACE TEMPORARY FUNCTION fiscal_year(d DATE) RETURNS INT
RETURN year(d) + CASE WHEN month(d) >= {FISCAL_START_MONTH} THEN 1 ELSE 0 END
"""


def register_sql_functions(spark) -> None:
    """Make `fiscal_year(date)` available to SQL text in this session."""
    spark.sql(FISCAL_YEAR_SQL)
