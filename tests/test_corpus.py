"""Jobs over code files."""

import random

import pytest
from pyspark.sql import functions as F

from datamove.operators import corpus


def files(spark, *texts):
    return spark.createDataFrame([(f"f{i}.sql", t) for i, t in enumerate(texts)], "path string, text string")


def scan(spark, text, dialect):
    return {r.rule: r for r in corpus.rule_scan(files(spark, text), dialect).collect()}


# A line of a bakery's code for each rule; lines of one dialect make files in any order.
BAKERY = {
    "mssql": {"system-variable": "SET loaves = @@ERROR() + 1;", "temp-table": "UPDATE ##ovens SET heat = 230;", "top-clause": "SELECT TOP (3) recipe FROM book ORDER BY stars;",
              "converter-note": "SELECT grams -- FIXME: weigh again"},
    "snowflake": {"snowflake-stage": "COPY INTO flour FROM @deliveries/rye;", "snowflake-flatten": "SELECT g.value FROM orders o, LATERAL FLATTEN(input => o.rolls) g;",
                  "snowflake-tz-timestamp": "ALTER TABLE batches ADD baked TIMESTAMP_TZ;"},
    "oracle": {"rownum": "DELETE FROM crumbs WHERE ROWNUM < 4;", "connect-by": "SELECT dough FROM starters START WITH mother IS NULL CONNECT BY PRIOR dough = mother;",
               "outer-join-plus": "SELECT r.name FROM recipes r, prices p WHERE p.recipe(+) = r.name;", "sequence": "SELECT ticket_no.NEXTVAL FROM counter;",
               "plsql-package": "DBMS_LOCK.SLEEP(5);", "plsql-cursor-attr": "sold := sold + SQL%ROWCOUNT;", "oracle-date-mask": "SELECT TO_CHAR(baked, 'DD.MM.YYYY') FROM batches;"},
    "teradata": {"teradata-table-kind": "CREATE MULTISET TABLE baskets (n INT);", "primary-index": "CREATE TABLE racks (n INT) PRIMARY INDEX (n);", "sel-abbrev": "SEL price FROM cakes;",
                 "collect-stats": "COLLECT STATISTICS ON cakes COLUMN (price);"},
    "netezza": {"netezza-groom": "GROOM TABLE racks VERSIONS;", "netezza-stats": "GENERATE STATISTICS ON racks;", "netezza-age": "SELECT AGE(baked) FROM batches;"},
}


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("dialect", sorted(BAKERY))
def test_every_rule_finds_its_line(spark, dialect, seed):
    rng = random.Random(seed)
    rules = rng.sample(sorted(BAKERY[dialect]), len(BAKERY[dialect]))
    lines, at = [], {}
    for rule in rules:
        lines += ["-- plain words, TOP 9 and ROWNUM", "SELECT bread FROM shelf;"][: rng.randint(0, 2)]
        lines.append(BAKERY[dialect][rule])
        at[rule] = len(lines)
    found = scan(spark, "\n".join(lines) + "\n", dialect)
    assert {r: found[r].line for r in at} == at
    others = {r for d, rs in BAKERY.items() if d != dialect for r in rs}
    assert not set(found) - set(at) & others - {"sequence", "converter-note"}


@pytest.mark.parametrize("text,dialect,want", [
    (".SET WIDTH 80\nSELECT 1;\n", "teradata", {"bteq-command"}), ("MERGE INTO p\nUSING prices AS p JOIN fresh f ON f.id = p.id\nON f.cost < 9 WHEN MATCHED THEN UPDATE SET p.cost = f.cost;", "mssql", {"merge-into-alias"}),
    ("MERGE INTO shop.prices AS p USING fresh f ON p.id = f.id WHEN MATCHED THEN UPDATE SET p.cost = f.cost;", "mssql", set()),
    ("SELECT RAISE_ERROR('till is empty')", "teradata", set()), ("SELECT DATE_FORMAT(baked, 'dd.MM.yyyy')", "oracle", set()),
    ("DELETE FROM crumbs WHERE ROWNUM < @@ERROR", "snowflake", set()), ("SELECT ((loaves + 1);\nSELECT rolls;", "mssql", {"unbalanced-parentheses"}),
    ("DROP TABLE `##ovens`;", "mssql", {"temp-table-name"}), ("SELECT CURRENT_DATE - 2 FROM shelf", "mssql", {"date-minus-number"}),
    ("CREATE TABLE ovens (\nserviced DATE,\nheat INT)", "oracle", {"oracle-date-column"}), ("SELECT rolls FROM shop.shelf LIMIT 3;", "mssql", set()),
])
def test_rules_of_their_own(spark, text, dialect, want):
    assert set(scan(spark, text, dialect)) == want


def test_repeats_fold_and_notes_are_graded(spark):
    found = scan(spark, "SELECT @a;\nSELECT @b, @a;\nSELECT @a;", "mssql")
    rows = {r.text: (r.line, r.other_lines) for r in corpus.rule_scan(files(spark, "SELECT @a;\nSELECT @b, @a;\nSELECT @a;"), "mssql").collect()}
    assert rows == {"@a": (1, [2, 3]), "@b": (2, [])} and set(found) == {"local-variable"}
    grade = lambda note: scan(spark, f"SELECT 1 -- FIXME: {note}\n", "mssql")["converter-note"].severity
    assert grade("T-SQL GETDATE returns datetime with approximately 3.33 ms resolution") == "info"
    assert grade("there is no equivalent to CREATE TASK") == "error" and grade("does not support PRINT") == "warning"
    assert scan(spark, "SELECT 1 /*FIXME*/ FROM t\n", "oracle")["converter-note"].text == "marked for review"
    assert "converter-note" not in scan(spark, "SELECT TOP 5 * /*FIXME*/ FROM t\n", "mssql")


@pytest.mark.parametrize("text,dialect,want", [
    ("DELETE FROM [dbo].Crumbs WHERE id IN (SELECT id FROM dbo.Swept UNION SELECT id FROM far.dbo.Swept)", "mssql",
     "DELETE FROM main.s.Crumbs WHERE id IN (SELECT id FROM main.s.Swept UNION SELECT id FROM far.dbo.Swept)"),
    ("UPDATE `dbo`.`Ovens` SET heat = 200", "mssql", "UPDATE main.s.`Ovens` SET heat = 200"),
    ("SELECT 'dbo.Ovens [heat] WITH (NOLOCK)' -- [dbo].Ovens", "mssql", None), ("SELECT layers[2] FROM cakes", "snowflake", None),
    ("SELECT COUNT_BIG(*), [Oven No], GETDATE() FROM ovens WITH (NOLOCK)\nGO\nSELECT heat FROM ovens", "mssql",
     "SELECT COUNT(*), `Oven No`, CURRENT_TIMESTAMP() FROM ovens\n\nSELECT heat FROM ovens"),
    ("SELECT rolls AS\n -- sold today\n Sold FROM shelf", "mssql", "SELECT rolls AS Sold FROM shelf -- sold today"),
    ("SELECT CAST(note AS VARCHAR(16777216)) FROM cakes", "snowflake", "SELECT CAST(note AS STRING) FROM cakes"),
    ("DELETE FROM ovens WHERE IsActive = 0 AND heat = 0 AND o.IsActive <> 1 AND note = 'IsActive = 1'", "mssql",
     "DELETE FROM ovens WHERE IsActive = false AND heat = 0 AND o.IsActive <> true AND note = 'IsActive = 1'"),
    ("CREATE TABLE racks (n INT NOT NULL, shelf INT NULL, note TEXT DEFAULT NULL); UPDATE racks SET note = NULL", "mssql",
     "CREATE TABLE racks (n INT NOT NULL, shelf INT, note TEXT DEFAULT NULL); UPDATE racks SET note = NULL"),
    ("SELECT rolls AS\n 'the rolls'\n FROM shelf", "mssql", None), ("SELECT \"a \\\" b\", 'l''oven' /* 1\n2 */ -- 3\n, `x``y`, 'no end", "mssql", None),
    ("ALTER TABLE racks /* ADD  wheels */;", "mssql", "-- not converted - rewrite manually: ALTER TABLE racks ADD wheels"),
])
def test_rewrites(spark, text, dialect, want):
    row = corpus.rewrite(files(spark, text), dialect, {"dbo": "main.s"}, ["isactive"]).first()
    assert row.new_text == (want or text)
    assert bool(row.counts) == (want is not None)


def test_status_best_version_and_dropped(spark):
    two = files(spark, "SELECT TOP 1 x;", "SELECT @a;", "SELECT 1;")
    findings = corpus.rule_scan(two, "mssql")
    assert {r.path: r.status for r in corpus.file_status(two, findings).collect()} == {"f0.sql": "needs-fix", "f1.sql": "review", "f2.sql": "ready"}
    first = corpus.finding_scores(findings)
    second = corpus.finding_scores(corpus.rule_scan(files(spark, "SELECT (x;", "SELECT @a;", "SELECT 1;"), "mssql"))
    assert {r.path: r.keep for r in corpus.best_version(first, second).collect()} == {"f0.sql": "first", "f1.sql": "first"}
    notes = spark.createDataFrame([("f1.sql", 1)], "path string, notes int")
    before = files(spark, "SET NOCOUNT ON;\nSELECT 1; SELECT ';' -- ;\n; SELECT 3", "a; b;")
    assert [tuple(r) for r in corpus.dropped_statements(before, files(spark, "SELECT 1;", "a;"), notes).collect()] == [("f0.sql", 2)]


def test_definitions(spark):
    text = ("CREATE TABLE [dbo].[Orders] ([Id] INT IDENTITY(1,1) PRIMARY KEY, Amount DECIMAL(10, 2) NOT NULL CONSTRAINT DF DEFAULT ((0)), Note NVARCHAR(MAX) NULL -- a, b\n"
            ", CONSTRAINT PK UNIQUE (x)); create table z (x int, y text not null, primary key (y))")
    rows = [(r.table_name, r.position, r.column_name, r.data_type, r.nullable, r.identity, r.primary_key) for r in corpus.defined_tables(files(spark, text)).orderBy("table_name", "position").collect()]
    assert rows == [("dbo.Orders", 1, "Id", "INT", True, True, True), ("dbo.Orders", 2, "Amount", "DECIMAL(10, 2)", False, False, False), ("dbo.Orders", 3, "Note", "NVARCHAR(MAX)", True, False, False),
                    ("z", 1, "x", "int", True, False, False), ("z", 2, "y", "text", False, False, True)]


def test_lineage_and_missing(spark):
    text = "INSERT INTO dw.Fact SELECT * FROM [srv].[dbo].[Orders] o JOIN #t x ON 1=1; -- FROM nowhere\nEXEC dbo.usp_Send; UPDATE Fact SET a = 'FROM gone'"
    edges = corpus.edges(files(spark, text))
    assert {(r.object, r.how) for r in edges.collect()} == {("dw.fact", "writes"), ("fact", "writes"), ("dbo.orders", "reads"), ("dbo.usp_send", "calls")}
    known = spark.createDataFrame([("dw.Fact",), ("dbo.Orders",)], "name string")
    assert [r.object for r in corpus.missing_objects(edges, known).collect()] == ["dbo.usp_send"]


def test_dialects(spark):
    rows = {r.path: (r.dialect, r.confidence, r.score) for r in corpus.dialect_scores(files(
        spark, "SELECT [dbo].x, GETDATE() FROM t\nGO\n", "CREATE TABLE t (a NVARCHAR(9)) WITH (DISTRIBUTION = HASH(a), CLUSTERED COLUMNSTORE INDEX)", "SELECT 1"), ["path"]).collect()}
    assert rows == {"f0.sql": ("mssql", "medium", 3), "f1.sql": ("synapse", "medium", 3), "f2.sql": ("mssql", "low", 0)}
    assert corpus.dialect_scores(files(spark, "SELECT NVL(a, 1), SYSDATE FROM d WHERE ROWNUM < 3"), []).first().dialect == "oracle"


def test_compare_code_and_fingerprints(spark):
    left = files(spark, "CREATE PROC dbo.A AS -- note\n SELECT [x] FROM t;\nGO\nCREATE VIEW dbo.B AS SELECT 1", "CREATE FUNCTION C() RETURNS INT")
    right = files(spark, "create or alter procedure [dbo].[a] as select x from t", "CREATE VIEW dbo.B AS SELECT 2", "CREATE VIEW d AS SELECT 3")
    assert {r.name: r.result for r in corpus.compare_code(left, right).collect()} == {"dbo.a": "same", "dbo.b": "different", "dbo.c": "only_left", "dbo.d": "only_right"}
    prints = corpus.fingerprints(left)
    assert corpus.set_fingerprint(prints).first() == corpus.set_fingerprint(prints.repartition(5)).first()
    assert {r.path: r.drift for r in corpus.drift(prints, corpus.fingerprints(right)).collect()} == {"f0.sql": "changed", "f1.sql": "changed", "f2.sql": "added"}


def test_fingerprint_of_a_set_changes_with_its_files(spark):
    row = lambda df: tuple(df.first())
    prints = corpus.fingerprints(files(spark, "a", "b", "c", "a"))
    whole, none = corpus.multiset_fingerprint(prints), prints.limit(0)
    assert row(whole) == row(corpus.multiset_fingerprint(prints.repartition(3))) and whole.first().files == 4
    one = prints.where("path = 'f1.sql'")
    without = corpus.multiset_fingerprint(prints.where("path <> 'f1.sql'"))
    assert row(corpus.changed_fingerprint(whole, none, one)) == row(without) != row(whole)
    assert row(corpus.changed_fingerprint(corpus.changed_fingerprint(whole, one, none), none, one)) == row(whole)
    assert row(corpus.multiset_fingerprint(none)) == (0, [0] * 16)
    text = whole.select(corpus.fingerprint_text(F.col("lanes"))).first()[0]
    assert len(text) == 128 and int(text[:8], 16) == whole.first().lanes[0]


def test_fit_follows_callers(spark):
    placed = corpus.fit(files(spark, "CREATE PROCEDURE dbo.usp_LoadFacts AS INSERT INTO f SELECT dbo.fn_Rate(x) FROM s", "CREATE FUNCTION dbo.fn_Rate(@x INT) RETURNS INT AS BEGIN RETURN 1 END",
                              "CREATE PROCEDURE dbo.SaveUser @Id INT AS UPDATE u SET a = 1 WHERE Id = @Id", "CREATE TABLE AspNetUsers (a INT)", "GRANT SELECT ON t TO r"))
    assert {r.path: r.category for r in placed.collect()} == {"f0.sql": "migrate", "f1.sql": "migrate", "f2.sql": "keep", "f3.sql": "skip", "f4.sql": "skip"}
    assert corpus.fit_verdict(placed).first().verdict == "application"


def test_helpers_follow_through_chains_and_circles(spark):
    rng = random.Random(4)
    names = [f"fn_x{i}" for i in range(30)]
    calls = {n: set(rng.sample(names, rng.choice([0, 1, 1, 2]))) - {n} for n in names}
    calls["fn_x0"] = {"fn_x1"}
    roots = {"usp_LoadDaily": {"fn_x3", "fn_x7"}, "SaveCart": {"fn_x3", "fn_x11", "fn_x19"}, "DeleteCart": {"fn_x2"}}
    texts = [f"CREATE FUNCTION dbo.{n}(@x INT) RETURNS INT AS BEGIN RETURN {' + '.join(f'dbo.{c}(@x)' for c in sorted(cs)) or '1'} END" for n, cs in calls.items()]
    texts += [f"CREATE PROCEDURE dbo.{n} @a INT AS SELECT {', '.join(f'dbo.{c}(@a)' for c in sorted(cs))}" for n, cs in roots.items()]
    placed = {r.short: r for r in corpus.fit(files(spark, *texts)).collect()}
    assert {n: placed[n].category for n in roots} == {"usp_LoadDaily": "migrate", "SaveCart": "keep", "DeleteCart": "keep"}

    def reach(start, barred=()):
        seen, todo = set(), list(start)
        while todo:
            n = todo.pop()
            if n not in seen and n not in barred:
                seen.add(n)
                todo += calls[n]
        return seen
    moves = reach(roots["usp_LoadDaily"])
    stays = reach(roots["SaveCart"] | roots["DeleteCart"], moves)
    assert {n: placed[n].category for n in names} == {n: "migrate" if n in moves else "keep" if n in stays else "review" for n in names}
    for n in names:
        tail = placed[n].reasons[-1]
        assert tail.startswith("used by code that moves: ") if n in moves else tail.startswith("used only by code that stays: ") if n in stays else tail.startswith("nothing")
        if n in moves | stays:
            first = tail.split(": ")[1].split(" and ")[0]
            assert n in {**{k.lower(): v for k, v in roots.items()}, **calls}[first]


def test_purposes_and_reasons(spark):
    placed = {r.name: r for r in corpus.fit(files(
        spark, "CREATE TABLE app_audit_log (a INT)", "CREATE TABLE AspNetRoles (a INT)", "GRANT SELECT ON t TO u", "INSERT INTO t VALUES (1)", "SELECT 1",
        "CREATE PROCEDURE r.SalesReport AS SELECT a, SUM(b), COUNT(c) FROM t GROUP BY a", "CREATE INDEX ix ON t (a)", "CREATE SYNONYM sy FOR t")).collect()}
    assert {n: r.purpose for n, r in placed.items()} == {
        "app_audit_log": "log table", "AspNetRoles": "framework table", "f2": "security / setup", "f3": "seed data", "f4": "script",
        "r.SalesReport": "reporting / analytics", "ix": "index", "sy": "synonym"}
    assert placed["r.SalesReport"].reasons == ["named like reporting: report", "groups rows", "2 aggregates"]
    assert all(len(r.reasons) == 1 for n, r in placed.items() if n != "r.SalesReport")


def test_features_and_other_databases(spark):
    texts = ["DECLARE c CURSOR FOR SELECT 1", "EXEC (@sql)", "SELECT * FROM srv.db.dbo.t", "SELECT * FROM [other].dbo.x", "SELECT * FROM dbo.a.b, dw.t.c -- x.y.z", "SELECT 'p.q.r' FROM #t"]
    got = {r.feature: r.files for r in corpus.features(files(spark, *texts), ["DW"]).collect()}
    assert {k: v for k, v in got.items() if v} == {"cursor": 1, "dynamic-sql": 1, "cross-database": 2, "temp-table": 1}


def test_fit_of_versioned_tables_and_deployment_scripts(spark):
    df = spark.createDataFrame([("a/Script.PostDeployment1.sql", "INSERT INTO t VALUES (1)"), ("t.sql", "CREATE TABLE dbo.T (v ROWVERSION)"), ("fact_x.sql", "CREATE TABLE dw.FactSales (a INT)")],
                               "path string, text string")
    placed = corpus.fit(df, "mssql")
    assert {r.path: (r.category, r.versioned) for r in placed.collect()} == {"a/Script.PostDeployment1.sql": ("skip", False), "t.sql": ("data", True), "fact_x.sql": ("data", False)}
    assert corpus.fit_verdict(placed).first().verdict == "mixed"
    assert corpus.fit_verdict(corpus.fit(df, "oracle")).first().verdict == "warehouse"


def test_tables_with_deep_parentheses(spark):
    deep = "(" * 12 + "a + 1, 2" + ")" * 12
    text = f"CREATE TABLE t (a INT NOT NULL, b AS {deep}, c INT DEFAULT {deep}, CHECK {deep}, PRIMARY KEY (a));\nCREATE TABLE [s].[u] (x DECIMAL(10, 2));\nCREATE TABLE v (y INT"
    rows = {(r.table_name, r.position): (r.column_name, r.primary_key) for r in corpus.defined_tables(files(spark, text)).collect()}
    assert rows == {("t", 1): ("a", True), ("t", 2): ("b", False), ("t", 3): ("c", False), ("s.u", 1): ("x", False)}


def test_names_of_any_script(spark):
    text = "SET @größe = 1;\nSELECT * FROM #körbe;\nSELECT übertop FROM straße;\nDECLARE čas CURSOR FOR SELECT 1;\n"
    found = scan(spark, text, "mssql")
    assert found["local-variable"].text == "@größe" and found["temp-table"].text == "#körbe" and found["cursor"].line == 4
    assert "top-clause" not in scan(spark, "SELECT ÄTOP 5 FROM t", "mssql") and "rownum" not in scan(spark, "SELECT ROWNUMÉRO FROM t", "oracle")
    one = corpus.main_objects(files(spark, "CREATE VIEW dbo.Straße AS SELECT 1 AS größe")).first()
    assert (one["kind"], one["name"], one["short"]) == ("view", "dbo.Straße", "straße")
    columns = corpus.defined_tables(files(spark, "CREATE TABLE dbo.Größen (Länge INT NOT NULL, Maß ÜbergrößeTyp)")).orderBy("position").collect()
    assert [(r.table_name, r.column_name, r.data_type) for r in columns] == [("dbo.Größen", "Länge", "INT"), ("dbo.Größen", "Maß", "ÜbergrößeTyp")]
    seen = {r.feature: r.files for r in corpus.features(files(spark, "SELECT * FROM Läger.dbo.Kühlung", "SELECT 1 FROM ##größe", "DECLARE größe CURSOR FOR SELECT 1")).collect()}
    assert seen["cross-database"] == 1 and seen["temp-table"] == 1 and seen["cursor"] == 1
    used = corpus.edges(files(spark, "INSERT INTO dbo.Straße SELECT * FROM Läger.Kühlung")).collect()
    assert {(r.object, r.how) for r in used} == {("dbo.straße", "writes"), ("läger.kühlung", "reads")}
    assert [r.name for r in corpus.code_objects(files(spark, "CREATE PROC dbo.Wörter AS SELECT 1")).collect()] == ["dbo.wörter"]


def test_rewrites_keep_names_of_any_script(spark):
    rows = corpus.rewrite(files(spark, "SELECT ÜGETDATE() FROM Maß.t WHERE t.Größe = 1 AND x = GETDATE();"), "mssql", {"Maß": "main.dev"}, ["Größe"]).first()
    assert rows.new_text == "SELECT ÜGETDATE() FROM main.dev.t WHERE t.Größe = true AND x = CURRENT_TIMESTAMP();"
    assert rows.counts == {"schema-map:Maß": 1, "boolean-compare:true": 1, "getdate": 1}
    kept = corpus.rewrite(files(spark, "SELECT * FROM Übermaß.t"), "mssql", {"maß": "main.dev"}).first()
    assert kept.new_text == kept.text


@pytest.mark.parametrize(("action", "told"), [("", ""), (" ON DELETE CASCADE", "; ON DELETE CASCADE dropped"), (" ON UPDATE\nSET NULL ;", "; ON UPDATE SET NULL dropped")])
def test_dropped_action_of_a_foreign_key_is_told(spark, action, told):
    text = f"ALTER TABLE shop.rolls /* ADD CONSTRAINT fk_oven FOREIGN KEY (oven) REFERENCES shop.ovens (id){action} */;"
    got = corpus.rewrite(files(spark, text), "mssql").first()
    assert got.new_text == (f"-- foreign key for information (not enforced{told}):\n"
                            "-- ALTER TABLE shop.rolls ADD CONSTRAINT fk_oven FOREIGN KEY (oven) REFERENCES shop.ovens (id);")
