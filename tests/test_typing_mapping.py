import pytest

from datamove.operators import mapping, typing


def mapped(spark, db, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, data_type string, precision string, scale string")
    return [(r.target_type, r.known) for r in typing.map_types(df, db).orderBy("i").collect()]


@pytest.mark.parametrize("db,rows", [
    ("sqlserver", [(("int", "10", "0"), "INT"), (("tinyint", None, None), "SMALLINT"), (("decimal", "18", "2"), "DECIMAL(18,2)"), (("datetime2", None, None), "TIMESTAMP"),
                   (("timestamp", None, None), "BINARY"), (("bit", None, None), "BOOLEAN"), (("float", "24", None), "FLOAT"), (("float", "53", None), "DOUBLE"),
                   (("money", "19", "4"), "DECIMAL(19,4)"), (("decimal(40,50)", None, None), "DECIMAL(38,38)"), (("time(7)", None, None), "STRING")]),
    ("oracle", [(("NUMBER", None, None), "DECIMAL(38,10)"), (("DATE", None, None), "TIMESTAMP"), (("VARCHAR2", None, None), "STRING"), (("FLOAT", "126", None), "DOUBLE"),
                (("TIMESTAMP(6) WITH LOCAL TIME ZONE", None, None), "TIMESTAMP"), (("INTERVAL DAY TO SECOND", None, None), "STRING")]),
    ("snowflake", [(("NUMBER", "38", "0"), "DECIMAL(38,0)"), (("TIMESTAMP", None, None), "TIMESTAMP_NTZ"), (("VARIANT", None, None), "VARIANT")]),
    ("teradata", [(("CV", None, None), "STRING"), (("D", "12", "2"), "DECIMAL(12,2)"), (("I1", None, None), "TINYINT"), (("TS", None, None), "TIMESTAMP"), (("byteint", None, None), "TINYINT")]),
    ("netezza", [(("NUMERIC(10,2)", None, None), "DECIMAL(10,2)")]),
    ("redshift", [(("character varying", None, None), "STRING"), (("timestamp without time zone", None, None), "TIMESTAMP"), (("super", None, None), "STRING")]),
    ("bigquery", [(("INT64", None, None), "BIGINT"), (("NUMERIC", None, None), "DECIMAL(38,9)"), (("STRUCT", None, None), "VARIANT")]),
    ("postgresql", [(("timestamp with time zone", None, None), "TIMESTAMP"), (("double  precision", None, None), "DOUBLE"), (("jsonb", None, None), "STRING")]),
])
def test_known_types(spark, db, rows):
    assert mapped(spark, db, [r for r, _ in rows]) == [(want, True) for _, want in rows]


def test_unknown_type_is_text_and_flagged(spark):
    assert mapped(spark, "sqlserver", [("weirdtype", None, None), ("D", None, None)]) == [("STRING", False)] * 2


def test_definitions_skip_known_tables_and_note_unknown_types(spark):
    columns = spark.createDataFrame([("dbo", "Orders", "OrderId", 1, "int", False, "INT", True), ("dbo", "Orders", "Odd`x", 2, "weird", True, "STRING", False),
                                     ("dbo", "Customers", "Id", 1, "int", False, "INT", True)],
                                    "schema_name string, table_name string, column_name string, ordinal int, data_type string, nullable boolean, target_type string, known boolean")
    rows = typing.table_definitions(columns, "main.dev", spark.createDataFrame([("customers",)], "table_name string")).collect()
    assert [(r.statement, r.review) for r in rows] == [("CREATE TABLE IF NOT EXISTS main.dev.`Orders` (`OrderId` INT NOT NULL, `Odd``x` STRING)", "Odd`x (weird)")]


def test_pairs_existing_tables(spark):
    sources = spark.createDataFrame([("dbo.Orders", "main.dev.Orders"), ("sales.Items", "main.dev.Items"), ("dbo.New", "main.dev.New")], "source string, default_target string")
    targets = spark.createDataFrame([("main.dev.orders",), ("main.other.Items",)], "target string")
    got = {r.source: (r.target, r.exists) for r in mapping.pair_tables(sources, targets).collect()}
    assert got == {"dbo.Orders": ("main.dev.orders", True), "sales.Items": ("main.other.Items", True), "dbo.New": ("main.dev.New", False)}


def test_pairs_columns_with_a_saved_mapping(spark):
    side = lambda names: spark.createDataFrame([("t", n) for n in names], "table_name string, column_name string")
    source, target = side(["id", "cust_name", "extra"]), side(["id", "customer_name"])
    plain = {(r.target_column, r.source_column): r.pairing for r in mapping.pair_columns(source, target).collect()}
    assert plain == {("id", "id"): "paired", ("customer_name", None): "target_without_source", (None, "cust_name"): "source_not_copied", (None, "extra"): "source_not_copied"}
    saved = spark.createDataFrame([("T", "Customer_Name", "CUST_NAME")], "table_name string, target_column string, source_column string")
    pairs = mapping.pair_columns(source, target, saved)
    assert {(r.target_column, r.source_column) for r in pairs.where("pairing = 'paired'").collect()} == {("id", "id"), ("customer_name", "cust_name")}
    tables = spark.createDataFrame([("t", True, True, True), ("gone", True, False, True), ("cmp", False, True, True), ("lost", True, True, False), ("bare", True, True, True)],
                                   "table_name string, load boolean, target_exists boolean, source_exists boolean")
    status = {r.table_name: r.status for r in mapping.mapping_status(tables, pairs).collect()}
    assert status == {"t": "check columns", "gone": "no target table", "cmp": "compare only", "lost": "no source table", "bare": "no matching columns"}


def test_schema_map_and_doubled_targets(spark):
    schemas = spark.createDataFrame([("DBO",), ("hr",)], "schema_name string")
    explicit = spark.createDataFrame([("dbo", "main.sales")], "source_schema string, target_schema string")
    assert {tuple(r) for r in mapping.schema_map(schemas, explicit, "main.dev").collect()} == {("DBO", "main.sales"), ("hr", "main.dev")}
    pairs = spark.createDataFrame([("a", "m.T"), ("b", "m.t"), ("c", "m.u")], "source string, target string")
    assert [tuple(r) for r in mapping.doubled_targets(pairs).collect()] == [("m.t", 2)]
    assert [r[0] for r in mapping.boolean_columns(spark.createDataFrame([("IsActive", "BIT"), ("x", "int")], "column_name string, data_type string")).collect()] == ["isactive"]


def test_column_differences(spark):
    side = lambda names: spark.createDataFrame([("t", n) for n in names], "table_name string, column_name string")
    assert {(r.column_name, r.only_in) for r in mapping.column_differences(side(["A", "b"]), side(["a", "C"])).collect()} == {("b", "source"), ("c", "target")}
