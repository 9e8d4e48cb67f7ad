"""Read a table over a database connection, split into parallel range reads on a key, or let the database count and sum it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import date, datetime, timedelta
from decimal import Decimal

from pyspark.sql import DataFrame, Row, SparkSession, types as T

from datamove import fixed_values as fixed
from datamove.spec import MoveError


# How a database writes the type in which numbers are summed, where its decimals hold fewer digits or have another name.
SUM_TYPE, SUM_TYPES = "DECIMAL(38, 6)", {"oracle": "NUMBER(38, 6)", "derby": "DECIMAL(31, 6)"}
FAN, EVEN, MOST_ROUNDS, ASKED_AT_ONCE = 8, 0.1, 40, 200


@dataclass(frozen=True)
class Connection:
    """Where a database is. `url` wins over the parts; the password is only ever passed to the reader."""

    kind: str
    host: str = ""
    database: str = ""
    port: int | None = None
    user: str = ""
    password: str = field(default="", repr=False)
    warehouse: str = ""
    driver: str = ""
    url: str = ""

    def jdbc_url(self) -> str:
        if self.url:
            return self.url
        if self.kind not in fixed.DEFAULT_PORTS:
            raise MoveError(f"Choose a database kind: {', '.join(fixed.DEFAULT_PORTS)}.")
        if not self.host:
            raise MoveError("The database host is required.")
        if self.kind == "snowflake" and not self.warehouse:
            raise MoveError("A warehouse is required for snowflake.")
        port = self.port or fixed.DEFAULT_PORTS[self.kind]
        place = {"host": self.host, "port": port, "db": self.database, "wh": self.warehouse}
        patterns = {
            "sqlserver": "jdbc:sqlserver://{host}:{port};databaseName={db}",
            "sqldw": "jdbc:sqlserver://{host}:{port};databaseName={db}",
            "oracle": "jdbc:oracle:thin:@//{host}:{port}/{db}",
            "snowflake": "jdbc:snowflake://{host}:{port}/?db={db}&warehouse={wh}",
            "teradata": "jdbc:teradata://{host}/DBS_PORT={port}",
            "redshift": "jdbc:redshift://{host}:{port}/{db}",
            "postgresql": "jdbc:postgresql://{host}:{port}/{db}",
            "mysql": "jdbc:mysql://{host}:{port}/{db}",
        }
        return patterns[self.kind].format(**place)


def _reader(spark: SparkSession, conn: Connection):
    reader = spark.read.format("jdbc").option("url", conn.jdbc_url()).option("fetchsize", "10000")
    for key, value in (("user", conn.user), ("password", conn.password), ("driver", conn.driver)):
        reader = reader.option(key, value) if value else reader
    return reader


def _read_ranges(spark: SparkSession, conn: Connection, rows: str, ranges: list[str]) -> DataFrame:
    """One task for each condition."""
    properties = {k: v for k, v in (("user", conn.user), ("password", conn.password), ("driver", conn.driver)) if v} | {"fetchsize": "10000"}
    return spark.read.jdbc(conn.jdbc_url(), rows, predicates=ranges, properties=properties)


def _from(table: str, where: str) -> str:
    return f"FROM {table}{' WHERE ' + where if where else ''}"


def ask(spark: SparkSession, conn: Connection, query: str) -> Row:
    """One row that the database computes."""
    return _reader(spark, conn).option("query", query).load().first()


def source_schema(spark: SparkSession, conn: Connection, table: str) -> T.StructType:
    return _reader(spark, conn).option("dbtable", table).load().schema


def literal(value) -> str:
    """A key's value in SQL; dates and times in the form that every driver translates."""
    if isinstance(value, datetime):
        return "{ts '" + value.strftime("%Y-%m-%d %H:%M:%S.%f") + "'}"
    return "{d '" + value.isoformat() + "'}" if isinstance(value, date) else str(value)


def _between(low, high, share: int, of: int):
    """A value about share / of of the way; never `low` while there is another."""
    if isinstance(low, datetime):
        return low + timedelta(microseconds=((high - low) // timedelta(microseconds=1) * share) // of)
    if isinstance(low, date):
        return low + timedelta(days=((high - low).days * share) // of)
    if isinstance(low, int):
        return low + (high - low) * share // of
    return low + (high - low) * share / of  # decimal or double


def split_points(low, high, total: int, parts: int, below: Callable[[list], list[int]]) -> list:
    """Values that cut a column's rows into about equal ranges. below(points): for each point, how many rows are smaller.

    Every cut starts between the column's ends and is narrowed from both sides by asking for the counts at points in between, all cuts in one question, until the
    rows in doubt are few or the two sides are neighbours (a value that very many rows share cannot be divided)."""
    brackets = {i: ((low, 0), (high, total)) for i in range(1, parts)}  # (value, rows below it): the cut lies behind the first, not behind the second
    cuts = {}
    for _ in range(MOST_ROUNDS):
        points = {i: sorted({_between(a, b, k, FAN) for k in range(1, FAN)} - {a, b}) for i, ((a, _), (b, _)) in brackets.items()}
        asked = sorted(set().union(*points.values())) if points else []
        counts = dict(zip(asked, below(asked), strict=True)) if asked else {}
        for i, inside in points.items():
            (a, n_a), (b, n_b) = brackets[i]
            want = total * i // parts
            for p in inside:
                if counts[p] <= want and (p, counts[p]) > (a, n_a):
                    a, n_a = p, counts[p]
                elif counts[p] > want:
                    b, n_b = p, counts[p]
                    break
            brackets[i] = ((a, n_a), (b, n_b))
            if not inside or n_b - n_a <= EVEN * total / parts:
                cuts[i] = a if want - n_a <= n_b - want else b
        brackets = {i: x for i, x in brackets.items() if i not in cuts}
        if not brackets:
            break
    cuts.update({i: a for i, ((a, _), _) in brackets.items()})
    return sorted({c for c in cuts.values() if low < c <= high})


def key_ranges(spark: SparkSession, conn: Connection, table: str, key: str, parts: int, where: str = "") -> list[str]:
    """Conditions that cut the table's rows into up to `parts` about equal ranges of the key, found by counts that the database computes; NULL keys lie in
    the first one. The key is a number, date or timestamp."""
    low, high, total = ask(spark, conn, f"SELECT MIN({key}) AS lo, MAX({key}) AS hi, COUNT({key}) AS n {_from(table, where)}")
    if parts < 2 or low is None or low == high:
        return []
    if isinstance(low, Decimal) and low == low.to_integral_value() and high == high.to_integral_value():
        low, high = int(low), int(high)

    def below(points: list) -> list[int]:
        out: list[int] = []
        for first in range(0, len(points), ASKED_AT_ONCE):
            counts = ", ".join(f"SUM(CASE WHEN {key} < {literal(p)} THEN 1 ELSE 0 END) AS n{i}" for i, p in enumerate(points[first : first + ASKED_AT_ONCE]))
            out += [int(n) for n in ask(spark, conn, f"SELECT {counts} {_from(table, where)}")]
        return out

    points = [literal(p) for p in split_points(low, high, int(total), parts, below)]
    if not points:
        return []
    return [f"{key} < {points[0]} OR {key} IS NULL", *[f"{key} >= {a} AND {key} < {b}" for a, b in zip(points, points[1:])], f"{key} >= {points[-1]}"]


def read_jdbc(spark: SparkSession, conn: Connection, table: str, where: str = "", key: str = "", parts: int = 1) -> DataFrame:
    """The table, filtered in the database. With `key` the read is split into up to `parts` ranges of about equal numbers of rows, one task each."""
    ranges, rows = key_ranges(spark, conn, table, key, parts, where) if key else [], f"(SELECT * {_from(table, where)}) src"
    return _read_ranges(spark, conn, rows, ranges) if ranges else _reader(spark, conn).option("dbtable", rows).load()


def source_count(spark: SparkSession, conn: Connection, table: str, where: str = "") -> int:
    return int(ask(spark, conn, f"SELECT COUNT(*) AS n {_from(table, where)}")[0])


def source_sums(spark: SparkSession, conn: Connection, table: str, columns: list[str], where: str = "") -> DataFrame:
    """One row, computed in the database: row_count, and sum_<i> of every column by value."""
    kind = next((k for k in SUM_TYPES if k == conn.kind or conn.jdbc_url().startswith(f"jdbc:{k}:")), None)
    sums = "".join(f", SUM(CAST({c} AS {SUM_TYPES.get(kind, SUM_TYPE)})) AS sum_{i}" for i, c in enumerate(columns))
    asked = _reader(spark, conn).option("query", f"SELECT COUNT(*) AS row_count{sums} {_from(table, where)}").load()
    return asked.toDF("row_count", *[f"sum_{i}" for i in range(len(columns))])
