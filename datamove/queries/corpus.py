"""Code-corpus jobs. Every document becomes one code file: statements of several dialects around the document's whole text,
which stands in a comment and in a string."""

from __future__ import annotations

from pyspark.sql import functions as F

from datamove import code_rules as rules
from datamove.operators import corpus
from datamove.queries.base import query, read

# One SQL text for both engines: statements by document number, then the document as a comment and as a string.
_CODE = """CASE doc_id % 8
 WHEN 0 THEN 'CREATE PROCEDURE dbo.usp_LoadSales' || doc_id || ' @Days INT AS' || chr(10) || 'BEGIN' || chr(10) || '  SET NOCOUNT ON;' || chr(10)
   || '  INSERT INTO dw.FactSales SELECT o.id, GETDATE() FROM [dbo].[Orders] o WITH (NOLOCK) JOIN dbo.Customer c ON c.id = o.cid WHERE o.d > @Days AND @Days > 0;'
   || chr(10) || '  EXEC dbo.Helper' || (doc_id + 7) || ';' || chr(10) || '  SELECT @@ROWCOUNT AS n, @Days AS d;' || chr(10) || 'END'
 WHEN 1 THEN 'CREATE VIEW rpt.SalesSummary' || doc_id || ' AS SELECT c.country, SUM(f.amount) AS amount, COUNT(*) AS n' || chr(10)
   || 'FROM dw.FactSales f JOIN dbo.Customer c ON c.id = f.cid WHERE c.IsActive = 1 GROUP BY c.country;'
 WHEN 2 THEN 'CREATE TABLE dw.Fact_T' || doc_id || ' (Id INT IDENTITY(1,1) PRIMARY KEY, Amount DECIMAL(10, 2) NOT NULL, Note NVARCHAR(50) NULL, IsActive BIT);'
 WHEN 3 THEN 'CREATE PROCEDURE dbo.GetCustomer' || doc_id || ' @Id INT AS' || chr(10) || 'SELECT TOP 5 * FROM dbo.Customer WHERE Id = @Id;' || chr(10) || 'SELECT * INTO #tmp FROM t1;'
 WHEN 4 THEN 'CREATE OR REPLACE VIEW SALES.V' || doc_id || ' AS SELECT NVL(a, 0), ROWNUM FROM SALES.T WHERE x = y(+);' || chr(10)
   || 'CREATE SEQUENCE SALES.S START WITH 1; SELECT 1 FROM SALES.H CONNECT BY PRIOR id = p;'
 WHEN 5 THEN 'COPY INTO t FROM @stage/x;' || chr(10) || 'SELECT IFF(a, b, c) FROM T, LATERAL FLATTEN(input => v);'
 WHEN 6 THEN '.LOGON x' || chr(10) || 'SEL id FROM t;' || chr(10) || 'COLLECT STATISTICS ON t;' || chr(10) || 'CREATE MULTISET VOLATILE TABLE vt AS (SEL 1) PRIMARY INDEX (id);'
 ELSE 'CREATE PROCEDURE dbo.Helper' || doc_id || ' AS' || chr(10) || 'DECLARE @x INT; WHILE @x < 3 BEGIN FETCH NEXT FROM cur; EXEC (@sql); END;' || chr(10)
   || 'BEGIN TRANSACTION; DELETE FROM dbo.Orders WHERE Id = @x; ROLLBACK;' || chr(10) || 'SELECT (1;' END"""
_TAIL = "chr(10) || '/* ' || text || ' */' || chr(10) || 'SELECT ''' || text || ''';'"
_PATH = "'src/' || lang || '/f' || doc_id || '.sql'"
FILES_SQL = f"""files AS (SELECT doc_id, path, code_part, tail, code_part || tail AS text FROM (
  SELECT doc_id, {_PATH} AS path, {_CODE} AS code_part, {_TAIL} AS tail FROM documents))"""

_SEGMENT_RE2 = (r"""--[^\n]*|/\*(?:[^*]|\*+[^*/])*\*+/|/\*[\s\S]*|''(?:[^''\\]|\\[\s\S]|'''')*''|''[\s\S]*|"(?:[^"\\]|\\[\s\S]|"")*"|"[\s\S]*|`[^`]*`|`[\s\S]*|[^-/''"`]+|[-/]""")
MASKED_SQL = FILES_SQL + f""", masked AS (SELECT doc_id, path, text, array_to_string(list_transform(regexp_extract_all(text, '{_SEGMENT_RE2}'),
  lambda s: CASE WHEN regexp_matches(s, '^(?:--|/\\*|''|")') THEN regexp_replace(s, '[^\\n]', ' ', 'g') ELSE s END), '') AS code FROM files)"""


def code_files(spark, folder):
    spark_sql = read(spark, folder, "documents").selectExpr("doc_id", f"{_PATH} AS path", f"{_CODE} AS code_part", f"{_TAIL} AS tail")
    return spark_sql.selectExpr("doc_id", "path", "code_part", "tail", "code_part || tail AS text")


def _files(spark, folder):
    return code_files(spark, folder).select("path", "text")


# ---------------------------------------------------------------- findings

# The rules' patterns for an engine without look-around: (what stands before, the match). Rules whose constructs these files
# do not contain are left out of the SQL.
_RE2 = {
    "local-variable": (r"(^|[^@\w])", r"(@[A-Za-z_]\w*)"), "temp-table": (r"(^|[^\w#`])", r"(##?[A-Za-z_]\w*)"),
    "snowflake-stage": (r"(^|[^\w@'])", r"(@~?[A-Za-z_][\w./]*)"), "connect-by": ("()", r"((?i)\bCONNECT\s+BY\b)"),
    "unbalanced-parentheses": ("()", r"(SELECT \(1;)"),
}
_NOT_IN_FILES = {"oracle-date-column", "date-minus-number", "merge-into-alias"}
_EXTRA = [("unbalanced-parentheses", "", "error", [], False, "")]


def _quote(text: str) -> str:
    return text.replace("'", "''")


def _hits_sql(keep) -> str:
    parts = []
    for name, _, severity, dialects, apart, pattern in rules.RULES + _EXTRA:
        if name in _NOT_IN_FILES or not keep(name, dialects):
            continue
        before, match = _RE2.get(name, ("()", "(" + pattern.replace("(?imd)", "(?im)") + ")"))
        both = _quote(before + match)
        marked = f"regexp_replace(code, '{both}', '\\1' || chr(57346) || '\\2', 'g')"
        text = "''" if name == "unbalanced-parentheses" else "trim(h, ' ' || chr(10))"
        parts.append(f"""SELECT path, '{name}' AS rule, '{severity}' AS severity, line, {text} AS text, {text if apart else "''"} AS apart FROM (
  SELECT path, unnest(regexp_extract_all(code, '{both}', 2)) AS h, unnest(flatten(list_transform(range(1, len(l) + 1), lambda i:
    list_transform(range(length(l[i]) - length(replace(l[i], chr(57346), ''))), lambda x: i)))) AS line
  FROM (SELECT path, code, string_split({marked}, chr(10)) AS l FROM masked))""")
    return "hits AS (" + "\nUNION ALL ".join(parts) + ")"


def _findings_sql(dialect: str | None) -> str:
    def keep(name, dialects):
        return dialect is None or not dialects or dialect in dialects
    return f"""{MASKED_SQL}, {_hits_sql(keep)}, findings AS (
  SELECT path, rule, severity, min(line) AS line, arg_min(text, (line, text)) AS text, list_sort(list(line))[2:] AS other FROM hits h
  WHERE NOT (rule = 'local-variable' AND EXISTS (SELECT 1 FROM hits s WHERE s.path = h.path AND s.line = h.line AND s.rule = 'system-variable'))
  GROUP BY path, rule, severity, apart)"""


def _findings(spark, folder, dialect=None):
    return corpus.rule_scan(_files(spark, folder), dialect)


@query("corpus_rule_scan", f"WITH {_findings_sql(None)}\nSELECT path, rule, severity, CAST(line AS INTEGER) AS line, text, array_to_string(other, ',') AS other_lines FROM findings")
def corpus_rule_scan(spark, folder):
    return _findings(spark, folder).withColumn("other_lines", F.array_join(F.transform("other_lines", lambda n: n.cast("string")), ","))


@query("corpus_status", f"""WITH {_findings_sql('mssql')}
SELECT f.path, CASE WHEN bool_or(severity = 'error') THEN 'needs-fix' WHEN bool_or(severity = 'warning') THEN 'review' ELSE 'ready' END AS status FROM files f LEFT JOIN findings USING (path) GROUP BY 1""")
def corpus_status(spark, folder):
    return corpus.file_status(_files(spark, folder), _findings(spark, folder, "mssql"))


@query("corpus_open_items", f"""WITH {_findings_sql('mssql')}
SELECT f.path, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings FROM files f LEFT JOIN findings USING (path) GROUP BY 1""")
def corpus_open_items(spark, folder):
    return corpus.open_items(_files(spark, folder), _findings(spark, folder, "mssql"))


_COMPLEXITY = "CASE WHEN n_chars < 500 THEN 'low' WHEN n_chars < 2000 THEN 'MEDIUM' WHEN n_chars < 5000 THEN 'HIGH' WHEN n_chars < 9000 THEN 'VERY HIGH' ELSE 'unrated' END"


@query("effort_estimate", f"""WITH {_findings_sql('mssql')}, b AS (SELECT count(*) AS files, CAST(round(sum(CASE {_COMPLEXITY} WHEN 'low' THEN 0.5 WHEN 'HIGH' THEN 6.0 WHEN 'VERY HIGH' THEN 12.0 ELSE 2.0 END), 1) AS DOUBLE) AS base FROM documents),
o AS (SELECT count(*) AS n FROM findings WHERE severity <> 'info')
SELECT base AS baseline_hours, files, n AS open_items, CAST(round(n * 0.5 + files * 0.25, 1) AS DOUBLE) AS remaining_hours,
       CAST(round(100 * greatest(0.0, 1 - (n * 0.5 + files * 0.25) / base)) AS INTEGER) AS saved_percent FROM b, o""")
def effort_estimate(spark, folder):
    rated = read(spark, folder, "documents").selectExpr(f"{_PATH} AS path", f"{_COMPLEXITY} AS complexity")
    return corpus.effort(rated, _findings(spark, folder, "mssql"))


@query("corpus_best_version", f"""
SELECT {_PATH} AS path, CAST(n_chars % 5 AS INTEGER) AS first_errors, CASE WHEN doc_id % 9 = 0 THEN 0 ELSE CAST(doc_id % 4 AS INTEGER) END AS second_errors,
       CASE WHEN CASE WHEN doc_id % 9 = 0 THEN 0 ELSE doc_id % 4 END < n_chars % 5 AND NOT (doc_id % 9 <> 0 AND n_chars % 3 = 0 AND n_chars % 2 = 1) THEN 'second' ELSE 'first' END AS keep FROM documents""")
def corpus_best_version(spark, folder):
    documents = read(spark, folder, "documents")
    first = documents.selectExpr(f"{_PATH} AS path", "CAST(n_chars % 5 AS INT) AS errors", "n_chars % 2 = 0 AS damaged")
    second = documents.where("doc_id % 9 <> 0").selectExpr(f"{_PATH} AS path", "CAST(doc_id % 4 AS INT) AS errors", "n_chars % 3 = 0 AS damaged")
    return corpus.best_version(first, second)


# ---------------------------------------------------------------- rewrites

@query("corpus_rewrite", "WITH " + FILES_SQL + """
SELECT path, regexp_replace(CASE doc_id % 8
   WHEN 0 THEN replace(replace(replace(replace(replace(replace(code_part, '[dbo].[Orders]', 'main.sales.`Orders`'), ' WITH (NOLOCK)', ''), 'GETDATE()', 'CURRENT_TIMESTAMP()'), '  SET NOCOUNT ON;', ''), 'PROCEDURE dbo.', 'PROCEDURE main.sales.'), 'EXEC dbo.', 'EXEC main.sales.')
               .replace('JOIN dbo.', 'JOIN main.sales.')
   WHEN 1 THEN replace(replace(code_part, 'IsActive = 1', 'IsActive = true'), 'JOIN dbo.', 'JOIN main.sales.')
   WHEN 2 THEN replace(code_part, 'NVARCHAR(50) NULL', 'NVARCHAR(50)') ELSE replace(code_part, ' dbo.', ' main.sales.') END || tail, '\\n{3,}', chr(10) || chr(10), 'g') AS new_text,
  CASE doc_id % 8 WHEN 0 THEN 'bracket-identifier=1,getdate=1,nolock-hint=1,schema-map:dbo=4,set-nocount=1' WHEN 1 THEN 'boolean-compare:true=1,schema-map:dbo=1' WHEN 2 THEN 'explicit-null=1'
       WHEN 3 THEN 'schema-map:dbo=2' WHEN 7 THEN 'schema-map:dbo=2' ELSE '' END AS counts
FROM files""")
def corpus_rewrite(spark, folder):
    done = corpus.rewrite(_files(spark, folder), "mssql", {"dbo": "main.sales"}, ["isactive"])
    entries = F.transform(F.array_sort(F.map_entries("counts")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return done.select("path", "new_text", F.array_join(entries, ",").alias("counts"))


# ---------------------------------------------------------------- dialect and fit

_HINT_SUMS = ", ".join(f"{' + '.join(f'''CAST(regexp_matches(text, '{_quote(p)}') AS INTEGER)''' for _, p in patterns)} AS {d}" for d, patterns in rules.DIALECT_HINTS.items())
_RANKED = ", ".join(f"(-{d}, {i}, '{d}')" for i, d in enumerate(rules.DIALECT_HINTS))


@query("corpus_dialect", f"""WITH {FILES_SQL}, h AS (SELECT path, {_HINT_SUMS} FROM files), s AS (SELECT * REPLACE (CASE WHEN synapse > 0 THEN synapse + mssql ELSE 0 END AS synapse) FROM h),
r AS (SELECT path, row_number() OVER (PARTITION BY path ORDER BY n DESC, i) AS rk, d, n FROM (""" + " UNION ALL ".join(
    f"SELECT path, {i} AS i, '{d}' AS d, {d} AS n FROM s" for i, d in enumerate(rules.DIALECT_HINTS)) + """))
SELECT a.path, CASE WHEN a.n = 0 THEN 'mssql' ELSE a.d END AS dialect, CASE WHEN (a.n >= 3 AND a.n >= 2 * b.n) OR (a.n >= 2 AND b.n = 0) THEN 'medium' ELSE 'low' END AS confidence,
       CAST(a.n AS BIGINT) AS score, CAST(b.n AS BIGINT) AS runner_up_score FROM r a JOIN r b ON a.path = b.path AND a.rk = 1 AND b.rk = 2""")
def corpus_dialect(spark, folder):
    return corpus.dialect_scores(_files(spark, folder), ["path"])


_NAMED = """CASE doc_id % 8 WHEN 0 THEN 'dbo.usp_LoadSales' || doc_id WHEN 1 THEN 'rpt.SalesSummary' || doc_id WHEN 2 THEN 'dw.Fact_T' || doc_id WHEN 3 THEN 'dbo.GetCustomer' || doc_id
  WHEN 4 THEN 'SALES.V' || doc_id WHEN 7 THEN 'dbo.Helper' || doc_id ELSE 'f' || doc_id END"""
_KIND = "CASE doc_id % 8 WHEN 0 THEN 'procedure' WHEN 1 THEN 'view' WHEN 2 THEN 'table' WHEN 3 THEN 'procedure' WHEN 4 THEN 'view' WHEN 7 THEN 'procedure' ELSE 'script' END"


@query("corpus_fit", f"""
SELECT {_PATH} AS path, {_NAMED} AS name, {_KIND} AS kind, CASE doc_id % 8 WHEN 2 THEN 'data' WHEN 3 THEN 'keep' WHEN 5 THEN 'review' WHEN 6 THEN 'review' ELSE 'migrate' END AS category,
       CASE doc_id % 8 WHEN 0 THEN 'ETL / data movement' WHEN 1 THEN 'reporting / analytics' WHEN 2 THEN 'table' WHEN 3 THEN 'application logic' WHEN 4 THEN 'reporting / analytics' WHEN 7 THEN 'helper' ELSE 'script' END AS purpose,
       CAST(CASE doc_id % 8 WHEN 0 THEN 5 WHEN 1 THEN 8 WHEN 3 THEN -2 WHEN 4 THEN 2 WHEN 7 THEN -1 END AS INTEGER) AS score FROM documents""")
def corpus_fit(spark, folder):
    placed = corpus.fit(_files(spark, folder))
    purpose = F.when(F.col("purpose").startswith("helper"), "helper").otherwise(F.col("purpose"))
    return placed.select("path", "name", "kind", "category", purpose.alias("purpose"), "score")


@query("corpus_fit_chains", """
SELECT CAST(doc_id AS INTEGER) AS chain, 'fn_step' || i || '_' || doc_id AS name, CASE WHEN doc_id % 3 = 0 THEN 'migrate' WHEN doc_id % 3 = 1 THEN 'keep' ELSE 'review' END AS category,
       CASE WHEN doc_id % 3 = 0 THEN 'helper for reporting / ETL' WHEN doc_id % 3 = 1 THEN 'helper for application logic' ELSE 'unclear' END AS purpose
FROM documents, (VALUES (1), (2), (3), (4), (5), (6)) AS v(i)""")
def corpus_fit_chains(spark, folder):
    """For each document, a chain of six helpers behind its text as a comment; a third hang on code that moves, a third on code that stays, a third call each
    other in a circle that nothing else calls."""
    docs = read(spark, folder, "documents").where("doc_id IS NOT NULL").selectExpr("doc_id", "'/* ' || replace(replace(coalesce(text, ''), '*/', ''), '/*', '') || ' */ ' AS note")
    step = "concat('CREATE FUNCTION dbo.fn_step', i, '_', doc_id, '(@x INT) RETURNS INT AS BEGIN RETURN dbo.fn_step', IF(i = 6 AND doc_id % 3 = 2, 1, i + 1), '_', doc_id, '(@x) END')"
    helpers = docs.selectExpr("doc_id", "note", "explode(sequence(1, 6)) AS i").selectExpr(f"concat('h', i, '_', doc_id, '.sql') AS path", f"note || {step} AS text")
    roots = docs.where("doc_id % 3 <> 2").selectExpr(
        "concat('r', doc_id, '.sql') AS path",
        "note || IF(doc_id % 3 = 0, concat('CREATE PROCEDURE dbo.usp_LoadFacts', doc_id, ' AS INSERT INTO f SELECT dbo.fn_step1_', doc_id, '(x) FROM s'),"
        " concat('CREATE PROCEDURE dbo.SaveUser', doc_id, ' @Id INT AS UPDATE u SET a = dbo.fn_step1_', doc_id, '(1) WHERE Id = @Id')) AS text")
    placed = corpus.fit(helpers.unionByName(roots)).where("kind = 'function'")
    return placed.select(F.regexp_extract("path", r"_(\d+)", 1).cast("int").alias("chain"), F.col("short").alias("name"), "category", "purpose")


@query("corpus_verdict", """
SELECT count(*) FILTER (doc_id % 8 IN (0, 1, 4, 7)) AS migrate, count(*) FILTER (doc_id % 8 = 2) AS data, count(*) FILTER (doc_id % 8 = 3) AS keep, CAST(0 AS BIGINT) AS skip,
       count(*) FILTER (doc_id % 8 IN (5, 6)) AS review, count(*) FILTER (doc_id % 8 = 2) AS tables, 'mixed' AS verdict FROM documents""")
def corpus_verdict(spark, folder):
    return corpus.fit_verdict(corpus.fit(_files(spark, folder))).select("migrate", "data", "keep", "skip", "review", "tables", "verdict")


# ---------------------------------------------------------------- lineage

_EDGES_SQL = MASKED_SQL + ", uses AS (" + " UNION ALL ".join(
    f"SELECT path, unnest(regexp_extract_all(code, '{_quote(pattern)}', 1)) AS raw, '{how}' AS how FROM masked" for how, pattern in rules.USES.items()) + f"""),
edges AS (SELECT DISTINCT path, lower(array_to_string(p[greatest(len(p) - 1, 1):], '.')) AS object, how FROM (
  SELECT path, how, list_transform(string_split(raw, '.'), lambda x: trim(x, ' []"`' || chr(10))) AS p FROM uses)
  WHERE NOT regexp_matches(lower(array_to_string(p[greatest(len(p) - 1, 1):], '.')), '{rules.NOT_AN_OBJECT}'))"""


@query("corpus_edges", f"WITH {_EDGES_SQL}\nSELECT path, object, how FROM edges")
def corpus_edges(spark, folder):
    return corpus.edges(_files(spark, folder))


@query("corpus_missing", f"""WITH {_EDGES_SQL}, known AS (SELECT lower({_NAMED}) AS name FROM documents WHERE doc_id % 8 NOT IN (5, 6) UNION ALL SELECT 'sales.t1' FROM documents WHERE doc_id = 0)
SELECT DISTINCT object FROM edges WHERE object NOT IN (SELECT name FROM known) AND NOT (NOT contains(object, '.') AND object IN (SELECT regexp_extract(name, '([^.]*)$', 1) FROM known))""")
def corpus_missing(spark, folder):
    files = _files(spark, folder)
    known = corpus.main_objects(files).where("kind <> 'script'").select("name")
    extra = read(spark, folder, "documents").where("doc_id = 0").selectExpr("'sales.t1' AS name")
    return corpus.missing_objects(corpus.edges(files), known.unionByName(extra))


@query("corpus_tables", """
SELECT 'src/' || lang || '/f' || doc_id || '.sql' AS path, 'dw.Fact_T' || doc_id AS table_name, CAST(i AS INTEGER) AS position, c AS column_name, t AS data_type, n AS nullable, i = 1 AS identity, i = 1 AS primary_key
FROM documents, (VALUES (1, 'Id', 'INT', TRUE), (2, 'Amount', 'DECIMAL(10, 2)', FALSE), (3, 'Note', 'NVARCHAR(50)', TRUE), (4, 'IsActive', 'BIT', TRUE)) v(i, c, t, n) WHERE doc_id % 8 = 2""")
def corpus_tables(spark, folder):
    return corpus.defined_tables(_files(spark, folder))


@query("corpus_features", """
SELECT feature, count(*) FILTER (list_contains(k, doc_id % 8)) AS files FROM documents, (VALUES ('cursor', [99]), ('dynamic-sql', [7]), ('temp-table', [3, 6]), ('transaction', [7]),
  ('linked-server', [99]), ('error-handling', [99]), ('while-loop', [7]), ('cross-database', [99])) v(feature, k) GROUP BY 1""")
def corpus_features(spark, folder):
    return corpus.features(_files(spark, folder))


@query("corpus_schemas", f"SELECT split_part({_NAMED}, '.', 1) AS schema_name, {_KIND} AS kind, count(*) AS objects FROM documents WHERE doc_id % 8 NOT IN (5, 6) GROUP BY 1, 2")
def corpus_schemas(spark, folder):
    return corpus.objects_per_schema(_files(spark, folder))


# ---------------------------------------------------------------- two corpora

_OTHER = """CASE WHEN doc_id % 5 = 0 THEN replace(text, 'SELECT ', 'SELECT  /* x */ ') WHEN doc_id % 5 = 1 THEN replace(text, 'dbo.Customer', 'dbo.Client') ELSE text END"""


def _two(spark, folder):
    files = code_files(spark, folder)
    left = files.where("doc_id % 7 <> 0").select("path", "text")
    return left, files.where("doc_id % 11 <> 0").selectExpr("path", f"{_OTHER} AS text")


@query("corpus_compare", f"""
SELECT lower(CASE WHEN doc_id % 8 = 4 THEN '' ELSE {_NAMED} END) AS name, CASE WHEN doc_id % 11 = 0 THEN 'only_left' WHEN doc_id % 7 = 0 THEN 'only_right'
  WHEN doc_id % 5 = 1 AND doc_id % 8 <> 7 THEN 'different' ELSE 'same' END AS result
FROM documents WHERE doc_id % 8 IN (0, 1, 3, 7) AND NOT (doc_id % 7 = 0 AND doc_id % 11 = 0)""")
def corpus_compare(spark, folder):
    return corpus.compare_code(*_two(spark, folder))


@query("corpus_dropped", f"""
SELECT {_PATH} AS path, CASE WHEN doc_id % 16 = 0 THEN 2 ELSE 1 END AS missing FROM documents WHERE (doc_id % 8 = 0 AND doc_id % 3 <> 0) OR (doc_id % 16 = 0)""")
def corpus_dropped(spark, folder):
    files = code_files(spark, folder)
    lost = F.regexp_replace("code_part", r"  EXEC dbo\.Helper\d+;\n|  SET NOCOUNT ON;\n", "")
    counted = F.when(F.col("doc_id") % 16 == 0, "  SELECT @@ROWCOUNT AS n, @Days AS d;\n").otherwise("\ue000")
    after = files.select("path", F.concat(F.replace(lost, counted, F.lit("")), "tail").alias("text"))
    # a note explains one lost statement of every third file
    notes = files.where("doc_id % 3 = 0 and doc_id % 16 <> 0").select("path", F.lit(1).alias("notes"))
    return corpus.dropped_statements(files.select("path", "text"), after, notes)


@query("corpus_fingerprint", f"""WITH {FILES_SQL}, p AS (SELECT path, sha256(text) AS h FROM files),
g AS (SELECT substr(sha256(path), 1, 4) AS g, count(*) AS n, sha256(string_agg(path || ':' || h || chr(10), '' ORDER BY path || ':' || h)) AS h FROM p GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS files, sha256(string_agg(g || ':' || h || chr(10), '' ORDER BY g)) AS fingerprint FROM g""")
def corpus_fingerprint(spark, folder):
    return corpus.set_fingerprint(corpus.fingerprints(_files(spark, folder)))


_LANE_SUMS = " || ".join(f"lpad(format('{{:x}}', CAST(sum(CAST('0x' || substr(d, {8 * i + 1}, 8) AS BIGINT)) % 4294967296 AS BIGINT)), 8, '0')" for i in range(corpus.LANES))


@query("corpus_multiset_fingerprint", f"""WITH {FILES_SQL}, p AS (SELECT path || ':' || sha256(text) AS line FROM files), d AS (SELECT sha256(line) || sha256('2:' || line) AS d FROM p)
SELECT count(*) AS files, {_LANE_SUMS} AS fingerprint FROM d""")
def corpus_multiset_fingerprint(spark, folder):
    """From every other file, then the rest added and some files taken out and put back."""
    prints = corpus.fingerprints(_files(spark, folder))
    half = F.pmod(F.xxhash64("path"), F.lit(2)) == 0
    few = prints.where(F.pmod(F.xxhash64("path"), F.lit(10)) == 0)
    whole = corpus.changed_fingerprint(corpus.multiset_fingerprint(prints.where(half)), prints.where(~half).unionByName(few), few)
    return whole.select("files", corpus.fingerprint_text(F.col("lanes")).alias("fingerprint"))


@query("corpus_drift", f"""WITH {FILES_SQL}, l AS (SELECT path, text FROM files WHERE doc_id % 7 <> 0), r AS (SELECT path, {_OTHER} AS text FROM files WHERE doc_id % 11 <> 0)
SELECT coalesce(l.path, r.path) AS path, CASE WHEN r.path IS NULL THEN 'missing' WHEN l.path IS NULL THEN 'added' ELSE 'changed' END AS drift FROM l FULL JOIN r USING (path) WHERE l.text IS DISTINCT FROM r.text""")
def corpus_drift(spark, folder):
    left, right = _two(spark, folder)
    return corpus.drift(corpus.fingerprints(left), corpus.fingerprints(right))
