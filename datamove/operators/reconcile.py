"""Prove that two tables hold the same rows: counts, sums, checksums, and keyed row and column differences.

Every comparison is an aggregation with map-side combine: what crosses the network is one row per input partition
(profiles) or one row per key (keyed differences), never the tables' values, so a hot key costs no more than any other.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

# Fixed value: numbers are summed and hashed by value in this type.
BY_VALUE = "decimal(38,6)"


def lower_columns(df: DataFrame) -> dict[str, T.DataType]:
    """Column name (lower case) -> type, in table order."""
    return {f.name.lower(): f.dataType for f in df.schema.fields}


def shared_columns(source: DataFrame, target: DataFrame) -> list[str]:
    """Columns on both sides, in target order."""
    have = lower_columns(source)
    return [c for c in lower_columns(target) if c in have]


def numeric_columns(source: DataFrame, target: DataFrame) -> list[str]:
    """Shared columns that are numbers on both sides (an interval is not a number)."""
    left, right = lower_columns(source), lower_columns(target)
    return [c for c in shared_columns(source, target)
            if isinstance(left[c], T.NumericType) and isinstance(right[c], T.NumericType)]


def integral_columns(source: DataFrame, target: DataFrame) -> set[str]:
    left, right = lower_columns(source), lower_columns(target)
    return {c for c in shared_columns(source, target)
            if isinstance(left[c], T.IntegralType) and isinstance(right[c], T.IntegralType)}


def column_differences(source: DataFrame, target: DataFrame) -> dict[str, list[str]]:
    left, right = lower_columns(source), lower_columns(target)
    return {"only_in_source": [c for c in left if c not in right], "only_in_target": [c for c in right if c not in left]}


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _by_value(name: str, integral: bool = False) -> Column:
    """A number as it is summed."""
    col = F.col(_quoted(name))
    return col.cast("bigint") if integral else col.try_cast(BY_VALUE)


HASHED_AS_IS = (T.DecimalType, T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType, T.BinaryType)
FRACTIONS = (T.FloatType, T.DoubleType)
NUMBER, TEXT = "number", "text"


def _as_decimal(t: T.DataType) -> T.DecimalType | None:
    if isinstance(t, T.DecimalType):
        return t
    return T.DecimalType(20, 0) if isinstance(t, T.IntegralType) else None


def common_form(left: T.DataType, right: T.DataType) -> T.DataType | str | None:
    """The form in which values of two types are compared, none of which loses a digit: None for as they are, a type to cast both to, NUMBER for the canonical
    digits of a number, or TEXT."""
    if isinstance(left, T.IntegralType) and isinstance(right, T.IntegralType):
        return T.LongType()
    if isinstance(left, FRACTIONS) and isinstance(right, FRACTIONS):
        return T.DoubleType()
    if left == right and isinstance(left, HASHED_AS_IS):
        return None
    one, two = _as_decimal(left), _as_decimal(right)
    if one and two:
        scale, whole = max(one.scale, two.scale), max(one.precision - one.scale, two.precision - two.scale)
        return T.DecimalType(whole + scale, scale) if whole + scale <= 38 else NUMBER
    return NUMBER if isinstance(left, T.NumericType) and isinstance(right, T.NumericType) else TEXT


def comparison_forms(source: DataFrame, target: DataFrame) -> dict[str, T.DataType | str | None]:
    left, right = lower_columns(source), lower_columns(target)
    return {c: common_form(left[c], right[c]) for c in shared_columns(source, target)}


def canonical_number(value: Column) -> Column:
    """Any number as sign, digits without zeros at either end, and exponent: equal for a double's shortest digits, and for decimals of any scale. Infinities and
    NaN stay words."""
    text = F.upper(value.cast("string"))
    parts = F.split(F.ltrim(text, F.lit("-")), "E")
    mantissa, exponent = F.split(parts[0], "\\."), F.coalesce(F.try_element_at(parts, F.lit(2)).try_cast("int"), F.lit(0))
    fraction = F.coalesce(F.try_element_at(mantissa, F.lit(2)), F.lit(""))
    digits = F.concat(mantissa[0], fraction)
    short = F.rtrim(digits, F.lit("0"))
    number = F.concat(F.when(text.startswith("-"), "-").otherwise(""), F.ltrim(short, F.lit("0")), F.lit("E"),
                      (exponent - F.length(fraction) + F.length(digits) - F.length(short)).cast("string"))
    return F.when(~text.rlike("^-?[0-9]"), text).when(short == "", "0").otherwise(number)


def in_form(name: str, form: T.DataType | str | None) -> Column:
    """A column's value in its common form. Both zeros of a double are one value."""
    col = F.col(_quoted(name))
    if form is None:
        return col
    if form == NUMBER:
        return canonical_number(col)
    if form == TEXT:
        return col.cast("string")
    cast = col.cast(form)
    return F.when(cast == 0, F.lit(0.0)).otherwise(cast) if isinstance(form, T.DoubleType) else cast


def _hash_of(values: list[Column]) -> Column:
    """Hash of a row's values. NULL positions are hashed too, so a value that moved to another column is seen."""
    return F.xxhash64(*[x for v in values for x in (v, v.isNull())])


def _halves(value: Column, name: str) -> list[Column]:
    # A 64-bit value is summed as two 32-bit halves: exact in plain longs for up to 2^31 rows of one input partition.
    return [F.sum(F.shiftright(value, 32)).alias(f"{name}_hi"), F.sum(value.bitwiseAND(F.lit(0xFFFFFFFF))).alias(f"{name}_lo")]


def _whole(name: str) -> Column:
    wide = "decimal(38,0)"
    hi, lo = (F.sum(F.col(f"{name}_{h}").cast("decimal(20,0)")).cast(wide) for h in ("hi", "lo"))
    return (hi * F.lit(4294967296).cast("decimal(10,0)") + lo).cast(wide)


def profile(df: DataFrame, numeric: list[str], shared: list[str], integral: set[str] = frozenset(),
            lossy: list[str] = (), forms: dict[str, T.DataType | str | None] | None = None) -> DataFrame:
    """One row: row_count, sum_<i> of every numeric column, cast_nulls, and the order-independent row checksum over the values in their forms
    (without `forms`: in the form that they share with a column of the same type).

    One scan, every value converted once. Each input partition is reduced to a single row of longs and decimals before
    anything is exchanged.
    """
    types = lower_columns(df)
    forms = forms if forms is not None else {c: common_form(types[c], types[c]) for c in shared}
    position = {c: i for i, c in enumerate(numeric)}
    row_hash = [_hash_of([in_form(c, forms[c]) for c in shared]).alias("row_hash")] if shared else []
    values = df.select(*[_by_value(c, c in integral).alias(f"v{i}") for c, i in position.items()],
                       *[F.col(_quoted(c)).isNotNull().alias(f"there{position[c]}") for c in lossy], *row_hash)
    value = {c: F.col(f"v{i}") for c, i in position.items()}
    partial: list[Column] = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(numeric):
        partial += _halves(value[c], f"s{i}") if c in integral else [F.sum(value[c]).alias(f"s{i}")]
    if lossy:
        lost = [(F.col(f"there{position[c]}") & value[c].isNull()).cast("bigint") for c in lossy]
        partial.append(F.sum(reduce(lambda a, b: a + b, lost)).alias("lost"))
    if shared:
        partial += _halves(F.col("row_hash"), "h")
    per_partition = values.groupBy(F.spark_partition_id().alias("part")).agg(*partial)
    final = [F.coalesce(F.sum("n"), F.lit(0)).alias("row_count")]
    for i, c in enumerate(numeric):
        final.append((_whole(f"s{i}").cast(BY_VALUE) if c in integral else F.sum(f"s{i}")).alias(f"sum_{i}"))
    if lossy:
        final.append(F.coalesce(F.sum("lost"), F.lit(0)).alias("cast_nulls"))
    if shared:
        final.append(_whole("h").alias("checksum"))
    return per_partition.agg(*final)


def _lossy(df_types: list[dict[str, T.DataType]], numeric: list[str]) -> list[str]:
    def may_lose(t: T.DataType) -> bool:
        return isinstance(t, (T.FloatType, T.DoubleType)) or isinstance(t, T.DecimalType) and t.precision - t.scale > 32
    return [c for c in numeric if any(may_lose(types[c]) for types in df_types)]


def compare_table(source: DataFrame, target: DataFrame, checksum: bool = True) -> DataFrame:
    """Check rows (check_no, check, source, target, match) for two tables.

    `row_count`, `sum(c)` of every shared numeric column, `cast_nulls` where a number may not fit the common type, and
    `row_checksum(n columns)`. Sums are decimals of six places, the checksum is over all digits; two NULLs are equal.
    """
    shared = shared_columns(source, target)
    numeric, integral, forms = numeric_columns(source, target), integral_columns(source, target), comparison_forms(source, target)
    lossy = _lossy([lower_columns(source), lower_columns(target)], numeric)
    labels = ["row_count", *[f"sum({c})" for c in numeric]]
    fields = ["row_count", *[f"sum_{i}" for i in range(len(numeric))]]
    if lossy:
        labels.append("cast_nulls")
        fields.append("cast_nulls")
    if checksum and shared:
        labels.append(f"row_checksum({len(shared)} columns)")
        fields.append("checksum")

    return check_rows(profile(source, numeric, shared if checksum else [], integral, lossy, forms),
                      profile(target, numeric, shared if checksum else [], integral, lossy, forms), dict(zip(labels, fields, strict=True)))


def check_rows(source: DataFrame, target: DataFrame, checks: dict[str, str]) -> DataFrame:
    """Two one-row frames of totals -> a row (check_no, check, source, target, match) for every check name -> column."""
    def long_form(row: DataFrame, side: str) -> DataFrame:
        entries = F.array(*[F.struct(F.lit(i).alias("check_no"), F.lit(label).alias("check"), F.col(field).cast(BY_VALUE).alias("value"))
                            for i, (label, field) in enumerate(checks.items())])
        return row.select(F.inline(entries)).withColumn("side", F.lit(side))

    both = long_form(source, "source").unionByName(long_form(target, "target"))
    on_side = lambda side: F.max(F.when(F.col("side") == side, F.col("value")))
    return (both.groupBy("check_no", "check").agg(on_side("source").alias("source"), on_side("target").alias("target"))
            .withColumn("match", equal_values(F.col("source"), F.col("target"))))


def equal_values(left: Column, right: Column) -> Column:
    """Two check values are equal: as numbers when both read as numbers, both NULL, else as text."""
    a, b = left.try_cast("decimal(38,10)"), right.try_cast("decimal(38,10)")
    return (F.when(left.isNull() | right.isNull(), left.isNull() & right.isNull())
            .when(a.isNotNull() & b.isNotNull(), a == b)
            .otherwise(left.cast("string") == right.cast("string")))


def _hashed(source: DataFrame, target: DataFrame, keys: list[str], columns: list[str], per_column: bool) -> DataFrame:
    integral, forms = integral_columns(source, target), comparison_forms(source, target)
    pick = keys + columns
    form = lambda c: in_form(c, forms[c])

    def side(df: DataFrame, sign: int) -> DataFrame:
        hashes = ([_hash_of([form(c)]).alias(f"_h{i}") for i, c in enumerate(columns)] if per_column
                  else [_hash_of([form(c) for c in columns]).alias("_h0")])
        key_cols = [(F.col(_quoted(k)).cast("bigint") if k in integral else F.col(_quoted(k))).alias(k) for k in keys]
        return df.select(*[F.col(_quoted(c)) for c in pick]).select(*key_cols, F.lit(sign).alias("_side"), *hashes)

    return side(source, 1).unionByName(side(target, -1))


def _by_key(source: DataFrame, target: DataFrame, keys: list[str], columns: list[str] | None,
            per_column: bool) -> tuple[DataFrame, list[str]]:
    keys = [k.lower() for k in keys]
    columns = [c.lower() for c in columns] if columns else [c for c in shared_columns(source, target) if c not in keys]
    count_of = lambda sign: F.sum(F.when(F.col("_side") == sign, 1).otherwise(0)).alias(
        "in_source" if sign == 1 else "in_target")
    n_hashes = len(columns) if per_column else 1
    united = _hashed(source, target, keys, columns, per_column)
    signed = [F.sum(F.col("_side") * piece).alias(f"d{i}_{j}") for i in range(n_hashes) for j, piece in enumerate(_pieces(F.col(f"_h{i}")))]
    by_key = united.groupBy(*keys).agg(count_of(1), count_of(-1), *signed)
    differs = [reduce(lambda a, b: a | b, [F.col(f"d{i}_{j}") != 0 for j in range(3)]).alias(f"differs_{i}") for i in range(n_hashes)]
    return by_key.select(*keys, "in_source", "in_target", *differs), columns


def _pieces(value: Column) -> list[Column]:
    """A 64-bit hash in three parts of at most 22 bits: their sums stay exact in longs for 2^41 rows of one key."""
    low = F.lit((1 << 22) - 1)
    return [value.bitwiseAND(low), F.shiftright(value, 22).bitwiseAND(low), F.shiftright(value, 44)]


def reconcile_rows(source: DataFrame, target: DataFrame, keys: list[str], columns: list[str] | None = None) -> DataFrame:
    """Keys whose rows differ: (keys, in_source, in_target, difference).

    Source rows count +1 and target rows -1 in one aggregation by key, so equal rows cancel out. No join, one shuffle of
    key + 8-byte hash, and rows that share a key are compared as a group rather than as pairs.
    """
    by_key, _ = _by_key(source, target, keys, columns, per_column=False)
    difference = (F.when(F.col("in_target") == 0, "missing_in_target").when(F.col("in_source") == 0, "missing_in_source")
                  .when((F.col("in_source") != F.col("in_target")) | F.col("differs_0"), "changed"))
    return by_key.withColumn("difference", difference).where("difference is not null").drop("differs_0")


def reconcile_columns(source: DataFrame, target: DataFrame, keys: list[str], columns: list[str] | None = None) -> DataFrame:
    """For each compared column, the number of keys present on both sides whose value differs: (column, mismatches)."""
    by_key, columns = _by_key(source, target, keys, columns, per_column=True)
    counts = by_key.where("in_source > 0 and in_target > 0").agg(
        *[F.count_if(f"differs_{i}").alias(f"m{i}") for i in range(len(columns))])
    entries = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("mismatches")) for i, c in enumerate(columns)])
    return counts.select(F.inline(entries))


# ---------------------------------------------------------------- descent

LEVEL_RANGES, MOST_RANGES, LEAF_ROWS = 64, 1024, 100_000
_NO_KEY = -1


def _place(df: DataFrame, key: str | None, keys: list[Column]) -> Column:
    """Where a row lies in the tree: the key itself if it is one whole number or date, else a hash of all keys."""
    if key is None:
        return F.xxhash64(*keys)
    kind = lower_columns(df)[key]
    return F.unix_date(F.col(_quoted(key))).cast("bigint") if isinstance(kind, T.DateType) else F.col(_quoted(key)).cast("bigint")


def _within(df: DataFrame, key: str | None, keys: list[Column], ranges: list[tuple[int, int]] | None, no_key: bool) -> DataFrame:
    """The rows in the ranges (first, last) of places. Of a key column the filter reaches the scan, which then skips files and row groups."""
    if ranges is None:
        return df
    if key is None:
        column, literal = _place(df, key, keys), F.lit
    elif isinstance(lower_columns(df)[key], T.DateType):
        column, literal = F.col(_quoted(key)), lambda n: F.date_from_unix_date(F.lit(n))
    else:
        column, literal = F.col(_quoted(key)), F.lit
    tests = [(column >= literal(a)) & (column <= literal(b)) for a, b in ranges] + ([F.col(_quoted(key)).isNull()] if no_key else [])
    while len(tests) > 1:  # a balanced tree of ORs: a chain of a thousand is too deep for the planner
        tests = [tests[i] | tests[i + 1] if i + 1 < len(tests) else tests[i] for i in range(0, len(tests), 2)]
    return df.where(tests[0]) if tests else df.where("false")


def _merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def reconcile_descent(source: DataFrame, target: DataFrame, keys: list[str], columns: list[str] | None = None, leaf_rows: int = LEAF_ROWS,
                      trace: list[dict] | None = None) -> DataFrame:
    """What reconcile_rows returns, for tables that differ in few rows: checksums of ranges of the key are compared, and only ranges that differ are read
    again, in finer ranges, until at most `leaf_rows` rows are left to compare one by one.

    The first pass exchanges one row per range and input partition; later ones read what the key's filter leaves. If more than MOST_RANGES ranges or half of all rows
    differ, the descent ends at once and the rows of the differing ranges are compared. `trace` receives one entry per pass: ranges and rows read."""
    keys = [k.lower() for k in keys]
    compared = [c.lower() for c in columns] if columns else [c for c in shared_columns(source, target) if c not in keys]
    left, right, forms = lower_columns(source), lower_columns(target), comparison_forms(source, target)
    by = [in_form(k, forms[k]) for k in keys]
    whole = len(keys) == 1 and left[keys[0]] == right[keys[0]] and isinstance(left[keys[0]], (T.IntegralType, T.DateType))
    key = keys[0] if whole else None
    if key:
        low, high = (source.select(_place(source, key, by).alias("p")).unionByName(target.select(_place(target, key, by).alias("p")))
                     .agg(F.min("p"), F.max("p")).first())
        low, high = (0, 0) if low is None else (low, high)
    else:
        low, high = -(2**63), 2**63 - 1
    # in decimals where the span of places exceeds a long; its ranges end at a width whose numbers are longs
    wide, finest = ("CAST({} AS DECIMAL(20, 0))", 8) if high - low >= 1 << 62 else ("CAST({} AS BIGINT)", 1)
    width, ranges, no_key, all_rows = high - low + 1, None, False, None
    while True:
        width = max(finest, -(-width // LEVEL_RANGES))

        def side(df: DataFrame, sign: int) -> DataFrame:
            node = F.expr(f"(p - {wide.format(low)}) DIV {wide.format(width)}")
            hashed = _within(df, key, by, ranges, no_key).select(
                _place(df, key, by).alias("p"), _hash_of([in_form(c, forms[c]) for c in [*keys, *compared]]).alias("h"))
            return hashed.select(F.coalesce(node, F.lit(_NO_KEY)).cast("bigint").alias("node"), F.lit(sign).alias("sign"), "h")

        pieces = [F.sum(F.col("sign") * x).alias(f"d{j}") for j, x in enumerate(_pieces(F.col("h")))]
        nodes = side(source, 1).unionByName(side(target, -1)).groupBy("node").agg(F.sum("sign").alias("d"), F.count(F.lit(1)).alias("n"), *pieces)
        differs = nodes.withColumn("differs", F.expr("d <> 0 OR d0 <> 0 OR d1 <> 0 OR d2 <> 0"))
        totals = differs.groupBy().agg(F.sum("n").alias("n"), F.sum(F.when(F.col("differs"), F.col("n"))).alias("open"),
                                       F.slice(F.array_sort(F.collect_list(F.when(F.col("differs"), F.col("node")))), 1, MOST_RANGES + 2).alias("nodes")).first()
        rows, left_rows = totals["n"] or 0, totals["open"] or 0
        if trace is not None:
            trace.append({"ranges": len(totals["nodes"]), "rows": rows})
        all_rows = rows if all_rows is None else all_rows
        found = list(totals["nodes"])
        no_key_now = _NO_KEY in found
        if len(found) <= MOST_RANGES:
            step = [(low + n * width, min(low + (n + 1) * width - 1, high)) for n in found if n != _NO_KEY]
            inside = step if ranges is None else [(max(a, c), min(b, d)) for a, b in step for c, d in ranges if max(a, c) <= min(b, d)]
            ranges, no_key = _merged(inside), no_key_now
        if width == finest or left_rows <= leaf_rows or len(found) > MOST_RANGES or 2 * left_rows > all_rows:
            break
    return reconcile_rows(_within(source, key, by, ranges, no_key), _within(target, key, by, ranges, no_key), keys, compared)


def failing_checks_text(checks: DataFrame) -> DataFrame:
    """Per target, the failing checks as `check: source -> target; ...` in check order (for sign-off lists)."""
    text = F.concat(F.col("check"), F.lit(": "), F.coalesce(F.col("source").cast("string"), F.lit("NULL")), F.lit(" -> "),
                    F.coalesce(F.col("target").cast("string"), F.lit("NULL")))
    failing = F.collect_list(F.when(~F.col("match"), F.struct("check_no", text.alias("t"))))  # one entry per check
    return (checks.groupBy("table_name")
            .agg(F.when(F.min(F.col("match").cast("int")) == 1, "match").otherwise("mismatch").alias("status"),
                 F.array_join(F.transform(F.array_sort(failing), lambda x: x["t"]), "; ").alias("differences")))
