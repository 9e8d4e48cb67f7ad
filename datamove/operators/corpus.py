"""Scan jobs over a table of code files (path, text). One row is one file; everything is a column expression over its text,
so files spread over the cluster and only findings, names or scores are exchanged."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from datamove import code_rules as rules, fixed_values as fixed
from datamove.operators.reach import reached
from datamove.session import broadcast_if_small, cut_lineage, spread_over_cores

# Private-use characters that stand for what is hidden while patterns run.
_CLOSE, _MARK, _CALL = "\ue001", "\ue003", "\ue004"
_LINE, _BLOCK, _BLOCK_LINES, _OTHER, _OTHER_LINES = "\ue005", "\ue006", "\ue007", "\ue008", "\ue009"
_NOTE, _CONSTRAINT = "\ue00a", "\ue00b"
_FIRST_STAND_IN, _LAST_STAND_IN = "\ue000", "\ue00f"
# A file is a run of line comments, block comments, strings, quoted names and code.
_SEGMENT = (r"""--[^\n]*+|/\*(?:[^*]++|\*(?!/))*+(?:\*/|\z)|'(?:[^'\\]++|\\[\s\S]|'')*+(?:'|\\?\z)|"(?:[^"\\]++|\\[\s\S]|"")*+(?:"|\\?\z)"""
            r"""|`(?:[^`]++|``)*+(?:`|\z)|[\x{E000}-\x{E00F}]|[^\-/'"`\x{E000}-\x{E00F}]++|[\-/]""")


def any_script(pattern: str) -> str:
    """The pattern with letters, digits, blanks and case of all scripts, so that names like `größe` are whole words."""
    return "(?U)" + pattern


def _comment(s: Column) -> Column:
    return s.startswith("--") | s.startswith("/*")


def _text_part(s: Column) -> Column:
    """A comment, a string, or a stray stand-in character."""
    first = F.substring(s, 1, 1)
    return first.isin("'", '"') | _comment(s) | first.between(_FIRST_STAND_IN, _LAST_STAND_IN)


def _hidden_part(s: Column) -> Column:
    """The same, or a quoted name."""
    return _text_part(s) | s.startswith("`")


def segments(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_SEGMENT), F.lit(0))


def masked(parts: Column, keep_names: bool = True, blank: str = " ") -> Column:
    """The text with strings and comments (and quoted names) blanked out. A hidden stretch of a line becomes one blank and line
    breaks stay, so line numbers hold and patterns do not run over long blanks."""
    hidden = _text_part if keep_names else _hidden_part
    return F.array_join(F.transform(parts, lambda s: F.when(hidden(s), F.regexp_replace(s, r"[^\n]+", blank)).otherwise(s)), "")


def with_masks(files: DataFrame) -> DataFrame:
    """Add `code` (quoted names kept) and `bare` (quoted names blanked too). Each is computed once per file."""
    cut = spread_over_cores(files, "path").withColumn("_parts", segments(F.col("text")))
    coded = cut.withColumn("code", masked(F.col("_parts")))
    return coded.withColumn("bare", F.when(F.col("code").contains("`"), masked(F.col("_parts"), keep_names=False)).otherwise(F.col("code")))


def _lines_of_marks(marked: Column) -> Column:
    """1-based line number of every mark, in order."""
    per_line = F.transform(F.split(marked, "\n"), lambda line, i: F.array_repeat(i + 1, F.length(line) - F.length(F.replace(line, F.lit(_MARK), F.lit("")))))
    return F.flatten(per_line)


def _occurs(low: Column, needles: str) -> Column:
    """A cheap test before a pattern: one of the texts occurs in the lower-cased text."""
    return reduce(lambda a, b: a | b, [low.contains(n) for n in needles.split("|")])


def _applies(dialects: list[str], dialect: str | None) -> bool:
    return not dialects or dialect is None or dialect in dialects


def _matches(rule: str, needles: str, severity: str, apart: bool, text: Column, pattern: str, call: bool = False) -> Column:
    """What one rule finds in a file: its matches, and the text with a mark before each; NULL when there are none."""
    group, pattern = 1 if rule == "merge-into-alias" else 0, any_script(pattern)
    return F.when(_occurs(F.col("_low"), needles) & text.rlike(pattern), F.struct(
        F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), F.lit(apart).alias("apart"), F.lit(call).alias("call"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("found"), F.regexp_replace(text, pattern, _MARK + "$0").alias("marked")))


def _hits(matches: Column) -> Column:
    """All findings of a file: array<struct<rule, severity, line, text, apart>>."""
    def of_rule(m: Column) -> Column:
        def entry(hit: Column, line: Column) -> Column:
            whole = F.replace(hit, F.lit(_CALL), F.lit(""))
            clean = F.regexp_replace(F.when(m["call"], F.substring_index(whole, "(", 1)).otherwise(whole), r"\A\s+|\s+\z", "")
            return F.struct(m["rule"].alias("rule"), m["severity"].alias("severity"), line.alias("line"), clean.alias("text"),
                            F.when(m["apart"], clean).otherwise("").alias("apart"))
        return F.zip_with(m["found"], _lines_of_marks(m["marked"]), entry)
    return F.flatten(F.transform(F.filter(matches, lambda m: m.isNotNull()), of_rule))


def _note_hits(parts: Column) -> Column:
    """Findings from notes left in comments."""
    def noted(s: Column) -> Column:  # the note's text, NULL for anything else
        low = F.lower(s)
        marked = _comment(s) & reduce(lambda a, b: a | b, [low.contains(n) for n in rules.NOTE_NEEDLES])
        return F.when(marked & s.rlike(any_script(rules.NOTE_MARKERS)), F.regexp_extract(s, any_script(rules.NOTE_MARKERS), 2))

    found = F.transform(parts, noted)
    notes = F.filter(found, lambda n: n.isNotNull())
    breaks = lambda s: F.regexp_replace(s, r"[^\n]+", "")
    lines = _lines_of_marks(F.array_join(F.zip_with(parts, found, lambda s, n: F.concat(F.when(n.isNotNull(), _MARK).otherwise(""), breaks(s))), ""))

    def entry(note: Column, line: Column) -> Column:
        clean = F.regexp_replace(note, r"[*/\s]+\z", "")
        clean = F.when(F.trim(clean) == "", rules.EMPTY_NOTE).otherwise(F.trim(clean))
        benign = reduce(lambda a, b: a | b, [clean.rlike(p) for p in rules.BENIGN_NOTES])
        severity = F.when(benign, "info").when(clean.rlike(rules.BLOCKING_NOTES), "error").otherwise("warning")
        return F.struct(F.lit("converter-note").alias("rule"), severity.alias("severity"), line.alias("line"),
                        clean.alias("text"), clean.alias("apart"))
    return F.when(F.exists(found, lambda n: n.isNotNull()), F.zip_with(notes, lines, entry))


def _statement_hits(bare: Column) -> Column:
    """Statements whose parentheses do not balance."""
    marked = F.regexp_replace(bare, r"(\A|;)(\s*)(?=[^;\s])", "$1$2" + _MARK)
    statements = F.split(marked, _MARK)
    bodies = F.slice(statements, 2, F.greatest(F.size(statements) - 1, F.lit(0)))
    uneven = lambda s: F.regexp_count(s, F.lit(r"\(")) != F.regexp_count(s, F.lit(r"\)"))
    pairs = F.filter(F.zip_with(bodies, _lines_of_marks(marked), lambda s, n: F.struct(s.alias("s"), n.alias("n"))), lambda x: uneven(x["s"]))
    return F.transform(pairs, lambda x: F.struct(F.lit("unbalanced-parentheses").alias("rule"), F.lit("error").alias("severity"),
                                                 x["n"].alias("line"), F.lit("").alias("text"), F.lit("").alias("apart")))


def rule_scan(files: DataFrame, dialect: str | None = None, only: list[str] | None = None) -> DataFrame:
    """Findings per file: (path, rule, severity, line, text, other_lines). A repeated finding is listed once with the other
    lines. Strings and comments never count, except for notes left in comments."""
    wanted = lambda name: only is None or name in only
    base = with_masks(files).withColumn("_low", F.lower("code"))
    calls = {r[0]: r for r in rules.CALL_RULES if _applies(r[3], dialect) and wanted(r[0])}
    if calls:  # mark calls in code, so that a match may look into the string behind it
        call = "|".join(r[-2] for r in calls.values())
        marked = F.transform("_parts", lambda s: F.when(_text_part(s), s).otherwise(F.regexp_replace(s, any_script(call), _CALL + "$0")))
        base = base.withColumn("_calls", F.array_join(marked, ""))
    found = [_matches(name, needles, severity, apart, F.col("code"), pattern)
             for name, needles, severity, dialects, apart, pattern in rules.RULES if _applies(dialects, dialect) and wanted(name)]
    found += [_matches(name, needles, severity, apart, F.col("_calls"), _CALL + call + after, call=True)
              for name, needles, severity, _, apart, call, after in calls.values()]
    found = [_hits(F.array(*found))] if found else []
    if wanted("unbalanced-parentheses"):
        found.append(_statement_hits(F.col("bare")))
    if wanted("unconverted-file"):
        found.append(F.when(F.col("text").rlike(rules.UNCONVERTED_FILE), F.array(F.struct(
            F.lit("unconverted-file").alias("rule"), F.lit("error").alias("severity"), F.lit(1).alias("line"),
            F.lit("").alias("text"), F.lit("").alias("apart")))))
    none = F.array().cast("array<struct<rule:string,severity:string,line:int,text:string,apart:string>>")
    base = base.withColumn("_hits", F.flatten(F.array(*[F.coalesce(h, none) for h in found], none)))
    lines_of = lambda keep: F.transform(F.filter("_hits", keep), lambda x: x["line"])
    # a local variable on the line of a system variable is the same problem
    base = base.withColumn("_system", lines_of(lambda x: x["rule"] == "system-variable"))
    hits = F.filter("_hits", lambda x: ~((x["rule"] == "local-variable") & F.array_contains(F.col("_system"), x["line"])))
    if wanted("converter-note"):  # a bare note next to a finding on the same line adds nothing
        base = base.withColumn("_all", lines_of(lambda x: F.lit(True)))
        notes = F.filter(F.coalesce(_note_hits(F.col("_parts")), none), lambda x: ~((x["text"] == rules.EMPTY_NOTE) & F.array_contains(F.col("_all"), x["line"])))
        hits = F.concat(hits, notes)
    rows = base.select("path", F.inline(hits))
    folded = rows.groupBy("path", "rule", "severity", "apart").agg(
        F.min("line").alias("line"), F.min_by("text", F.struct("line", "text")).alias("text"), F.array_sort(F.collect_list("line")).alias("_lines"))
    return folded.select("path", "rule", "severity", "line", "text",
                         F.slice("_lines", 2, F.greatest(F.size("_lines") - 1, F.lit(0))).alias("other_lines"))


# ---------------------------------------------------------------- rewrites

# A hidden segment becomes <kind><number><end> while patterns run; the kinds tell comments, other text and line breaks apart.
_OPENERS = _LINE + _BLOCK + _BLOCK_LINES + _OTHER + _OTHER_LINES + _NOTE + _CONSTRAINT


def _token(s: Column, i: Column) -> Column:
    kind = (F.when(s.startswith("--"), _LINE).when(s.startswith("/*"), F.when(s.contains("\n"), _BLOCK_LINES).otherwise(_BLOCK))
            .otherwise(F.when(s.contains("\n"), _OTHER_LINES).otherwise(_OTHER)))
    return F.concat(kind, (i + 1).cast("string"), F.lit(_CLOSE))


def _skeleton(df: DataFrame, keep_names: bool) -> DataFrame:
    """Replace strings and comments (and quoted names) of `_new` by tokens in `_skeleton`; the segments stay in `_hidden`."""
    hidden = _text_part if keep_names else _hidden_part
    df = df.withColumn("_hidden", segments(F.col("_new")))
    return df.withColumn("_skeleton", F.array_join(F.transform("_hidden", lambda s, i: F.when(hidden(s), _token(s, i)).otherwise(s)), ""))


def _spaced(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def _restore(df: DataFrame, schema_map: dict[str, str] | None = None) -> DataFrame:
    """Put the hidden segments back in place of their tokens. A token of the kind note or constraint is a block comment whose
    content is written out as a line comment."""
    pieces = F.split("_skeleton", f"(?=[{_OPENERS}])")

    def inside(segment: Column) -> Column:
        return F.regexp_replace(segment, r"\A/\*|\*/\z", "")

    def constraint(segment: Column, table: Column) -> Column:
        body = _spaced(F.substring_index(inside(segment), "-- FIXME:", 1))
        action = F.regexp_replace(F.regexp_extract(body, rules.FOREIGN_KEY, 5), r"^[\s;]+|[\s;]+$", "")
        key = F.regexp_replace(F.regexp_replace(body, rules.FOREIGN_KEY, "ADD CONSTRAINT $1 FOREIGN KEY $2 REFERENCES $3 $4;"), r"\[([^\]]+)\]", "`$1`")
        for source, target in (schema_map or {}).items():
            key = F.regexp_replace(key, rf"(?i)(?<=REFERENCES )(?:`\Q{source}\E`|\Q{source}\E)\.", target.replace("$", "\\$") + ".")
        dropped = F.when(action == "", "").otherwise(F.concat(F.lit("; "), action, F.lit(" dropped")))  # ON DELETE, ON UPDATE
        told = F.concat(F.lit("-- foreign key for information (not enforced"), dropped, F.lit("):\n-- ALTER TABLE "), table, F.lit(" "), key)
        left = F.concat(F.lit("-- not converted - rewrite manually: ALTER TABLE "), table, F.lit(" "), _spaced(inside(segment)))
        return F.when(body.rlike(rules.FOREIGN_KEY), told).otherwise(left)

    def piece(p: Column) -> Column:
        kind = F.substring(p, 1, 1)
        segment = F.element_at(F.col("_hidden"), F.substring_index(F.substring(p, 2, F.length(p)), _CLOSE, 1).try_cast("int"))
        rest = F.substring(p, F.instr(p, _CLOSE) + 1, F.length(p))
        after = F.substring(rest, F.instr(rest, _MARK) + 1, F.length(rest))
        return (F.when(~kind.isin(*_OPENERS), p).when(kind == _NOTE, F.concat(_spaced(inside(segment)), rest))
                .when(kind == _CONSTRAINT, F.concat(constraint(segment, F.substring_index(rest, _MARK, 1)), after)).otherwise(F.concat(segment, rest)))
    return df.withColumn("_new", F.array_join(F.transform(pieces, piece), ""))


def _apply(df: DataFrame, rule: str, pattern: str, replacement: str) -> DataFrame:
    pattern = any_script(pattern)
    counted = df.withColumn("_counts", F.map_concat("_counts", F.create_map(F.lit(rule), F.regexp_count("_skeleton", F.lit(pattern)))))
    return counted.withColumn("_skeleton", F.regexp_replace("_skeleton", pattern, replacement))


def rewrite(files: DataFrame, dialect: str | None = None, schema_map: dict[str, str] | None = None,
            boolean_names: list[str] | None = None) -> DataFrame:
    """Safe mechanical rewrites outside strings and comments: (path, text, new_text, counts: rule -> times applied)."""
    df = spread_over_cores(files, "path").withColumn("_new", F.col("text")).withColumn("_counts", F.create_map().cast("map<string,int>"))
    df = _skeleton(df, keep_names=True)
    for source, target in (schema_map or {}).items():
        name = "\\Q" + source + "\\E"
        pattern = rf"(?i)(?<![\w.`])(?:\[{name}\]|`{name}`|{name})\.(?=[\w\[`])"
        df = _apply(df, f"schema-map:{source}", pattern, target.replace("$", "\\$") + ".")
    if boolean_names:
        names = "|".join("\\Q" + n + "\\E" for n in boolean_names)
        for digit, word in (("1", "true"), ("0", "false")):
            pattern = rf"(?<![\w.`])((?:`?\w+`?\.)?`?(?i:{names})`?)(\s*(?:=|<>|!=)\s*){digit}\b(?!\s*\.)"
            df = _apply(df, f"boolean-compare:{word}", pattern, f"$1$2{word}")
    df = _skeleton(_restore(df), keep_names=False)
    for rule, dialects, pattern, replacement in rules.REWRITES:
        if _applies(dialects, dialect):
            df = _apply(df, rule, pattern, replacement)
    # a comment between AS and its alias moves behind the alias's line
    df = _apply(df, "dangling-comment", rf"(?i)\bAS[ \t]*\r?\n[ \t]*({_LINE}\d+{_CLOSE})\r?\n[ \t]*(\w+)([^\n\-]*)", "AS $2$3 $1")
    block = rf"[{_BLOCK}{_BLOCK_LINES}](\d+){_CLOSE}\s*;"
    # an unconverted CREATE is only a comment in a shell that cannot run
    df = _apply(df, "empty-create", rf"(?i)\bCREATE(?:\s+OR\s+REPLACE)?\s*{block}", f"-- not converted - rewrite manually: CREATE {_NOTE}$1{_CLOSE}")
    # column definitions: an explicit NULL is the default
    pieces = F.split("_skeleton", ";")
    in_tables, explicit = lambda s: s.rlike(any_script(rules.CREATE_TABLE_START)), any_script(rules.EXPLICIT_NULL)
    nulls = F.aggregate(pieces, F.lit(0), lambda n, s: n + F.when(in_tables(s), F.regexp_count(s, F.lit(explicit))).otherwise(0))
    df = df.withColumn("_counts", F.map_concat("_counts", F.create_map(F.lit("explicit-null"), nulls)))
    df = df.withColumn("_skeleton", F.array_join(F.transform(pieces, lambda s: F.when(in_tables(s), F.regexp_replace(s, explicit, "")).otherwise(s)), ";"))
    # a commented-out constraint leaves an ALTER TABLE that cannot run
    df = _apply(df, "empty-alter", rf"(?i)\bALTER\s+TABLE\s+([^\s/;{_OPENERS}]+)\s*{block}", f"{_CONSTRAINT}$2{_CLOSE}$1{_MARK}")
    df = _restore(df, schema_map)
    return df.select("path", "text", F.regexp_replace("_new", r"\n{3,}", "\n\n").alias("new_text"),
                     F.map_filter("_counts", lambda k, v: v > 0).alias("counts"))


# ---------------------------------------------------------------- statuses and scores

def file_status(files: DataFrame, findings: DataFrame) -> DataFrame:
    """ready / review / needs-fix per file from its findings that are still open."""
    worst = findings.groupBy("path").agg(F.max((F.col("severity") == "error").cast("int")).alias("_e"),
                                         F.max((F.col("severity") == "warning").cast("int")).alias("_w"))
    return files.select("path").join(worst, "path", "left").select(
        "path", F.when(F.col("_e") == 1, "needs-fix").when(F.col("_w") == 1, "review").otherwise("ready").alias("status"))


def finding_scores(findings: DataFrame) -> DataFrame:
    """Per file: errors, warnings (every occurrence) and whether the result is structurally damaged."""
    times = F.lit(1) + F.size("other_lines")
    total = lambda s: F.sum(F.when(F.col("severity") == s, times).otherwise(0))
    return findings.groupBy("path").agg(total("error").alias("errors"), total("warning").alias("warnings"),
                                        (F.max(F.col("rule").isin(rules.DAMAGE_RULES).cast("int")) == 1).alias("damaged"))


def best_version(first: DataFrame, second: DataFrame) -> DataFrame:
    """Which of two scored versions of a file to keep: the second only for strictly fewer errors and never for new damage."""
    a = first.select("path", F.col("errors").alias("first_errors"), F.col("damaged").alias("_da"))
    b = second.select("path", F.col("errors").alias("second_errors"), F.col("damaged").alias("_db"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    no = lambda c: F.coalesce(F.col(c), F.lit(False))
    better = (zero("second_errors") < zero("first_errors")) & ~(no("_db") & ~no("_da"))
    return a.join(b, "path", "full").select("path", zero("first_errors").alias("first_errors"), zero("second_errors").alias("second_errors"),
                                            F.when(better, "second").otherwise("first").alias("keep"))


def dialect_scores(files: DataFrame, by: list[str]) -> DataFrame:
    """Best dialect per group (by=[] for the whole corpus): dialect, confidence, score, runner_up_score.

    A hint counts once per file. Synapse code is T-SQL too: once it has hits of its own, the T-SQL hits count for it."""
    hit = lambda needle, p: F.when(_occurs(F.col("_low"), needle) & F.col("text").rlike(any_script(p)), 1).otherwise(0)
    hits = {d: reduce(lambda a, b: a + b, [hit(n, p) for n, p in patterns]) for d, patterns in rules.DIALECT_HINTS.items()}
    sums = spread_over_cores(files, "path").withColumn("_low", F.lower("text")).groupBy(*by).agg(*[F.coalesce(F.sum(h), F.lit(0)).alias(d) for d, h in hits.items()])
    sums = sums.withColumn("synapse", F.when(F.col("synapse") > 0, F.col("synapse") + F.col("mssql")).otherwise(0))
    order = list(rules.DIALECT_HINTS)
    ranked = F.array_sort(F.array(*[F.struct((-F.col(d)).alias("s"), F.lit(i).alias("i"), F.lit(d).alias("d")) for i, d in enumerate(order)]))
    sums = sums.withColumn("_r", ranked)
    top, second = -F.col("_r")[0]["s"], -F.col("_r")[1]["s"]
    sure = ((top >= 3) & (top >= 2 * second)) | ((top >= 2) & (second == 0))
    return sums.select(*by, F.when(top == 0, "mssql").otherwise(F.col("_r")[0]["d"]).alias("dialect"),
                       F.when(sure, "medium").otherwise("low").alias("confidence"), top.alias("score"), second.alias("runner_up_score"))


def _strip_quotes(name: Column) -> Column:
    return F.regexp_replace(name, r"[\[\]`\"]", "")


def main_objects(files: DataFrame) -> DataFrame:
    """Kind and name of the main object of each file; `script` or `security` when it creates none. Adds `bare`."""
    df = with_masks(files)
    first_word = F.lower(F.regexp_extract(F.regexp_extract("bare", any_script(rules.CREATED_OBJECT), 1), r"^\w+", 0))
    kinds = F.create_map(*[F.lit(x) for pair in rules.OBJECT_KINDS.items() for x in pair])
    stem = F.regexp_replace(F.regexp_extract("path", r"([^/]*)$", 1), r"\.[^.]*$", "")
    name = _strip_quotes(F.regexp_extract("bare", any_script(rules.CREATED_OBJECT), 2))
    df = df.withColumn("_word", first_word)
    kind = (F.when(F.col("_word") != "", F.coalesce(F.try_element_at(kinds, F.col("_word")), F.col("_word")))
            .when(F.col("bare").rlike(any_script(rules.SECURITY_WORD)), "security").otherwise("script"))
    named = F.when((F.col("_word") == "") | (name == ""), stem).otherwise(name)
    return df.select("path", "text", "code", "bare", kind.alias("kind"), named.alias("name")).withColumn(
        "short", F.lower(F.regexp_extract("name", r"([^.]*)$", 1)))


def _score(patterns: list[tuple[str, int]]) -> Column:
    return reduce(lambda a, b: a + b, [F.when(F.col("bare").rlike(any_script(p)), w).otherwise(0) for p, w in patterns])


def _body_reasons(patterns: list[tuple[str, int]], reasons: list[str]) -> list[Column]:
    return [F.when(F.col("bare").rlike(any_script(p)), why) for (p, _), why in zip(patterns, reasons, strict=True)]


def _calls(files: DataFrame, placed: DataFrame) -> DataFrame:
    """(path, caller, callee): words of the routines' code that are names of unclear routines."""
    unclear = placed.where("_routine and category = 'review'").select(F.col("short").alias("callee")).distinct()
    callers = placed.where("_routine").select("path", F.col("short").alias("caller"))
    words = F.array_distinct(F.regexp_extract_all(F.lower(masked(segments(F.col("text")), keep_names=False)), F.lit(any_script(r"[\w$#@]+")), F.lit(0)))
    return (spread_over_cores(files, "path").select("path", F.explode(words).alias("callee")).join(broadcast_if_small(unclear), "callee")
            .join(callers, "path").where("caller <> callee"))


def follow_callers(placed: DataFrame, calls: DataFrame) -> DataFrame:
    """(short, category, callers, first_caller) of unclear routines that placed ones use, directly or through other unclear ones: what anything that moves
    reaches moves too, what only kept code reaches is kept. Routines that call each other in a circle are placed by who calls into it."""
    own = placed.where("_routine").select("path", "category")
    calls = cut_lineage(calls.join(own, "path").select("caller", "callee", "category"))
    between = calls.where("category = 'review'").select(F.col("caller").alias("a"), F.col("callee").alias("b"))
    seeds = lambda category: calls.where(F.col("category") == category).select(F.col("callee").alias("node"))
    moves = reached(seeds("migrate"), between)
    stays = reached(seeds("keep").join(moves, "node", "left_anti"), between.join(moves.withColumnRenamed("node", "b"), "b", "left_anti"))
    label = moves.withColumn("label", F.lit("migrate")).unionByName(stays.withColumn("label", F.lit("keep")))
    # callers of the same label tell why; only their number and first name are kept
    of_caller = label.select(F.col("node").alias("caller"), F.col("label").alias("passed_on"))
    same = (calls.join(of_caller, "caller", "left").withColumn("by", F.when(F.col("category") == "review", F.col("passed_on")).otherwise(F.col("category")))
            .join(label, F.col("callee") == F.col("node")).where(F.col("by") == F.col("label")))
    return same.groupBy(F.col("callee").alias("_word"), F.col("label").alias("_label")).agg(
        F.count_distinct("caller").alias("_callers"), F.min("caller").alias("_first"))


def fit(files: DataFrame, dialect: str | None = None) -> DataFrame:
    """Where each object belongs: (path, name, kind, category, purpose, score, reasons). Routines are scored from the words of their name and
    patterns in their body; an unclear routine follows the objects that use it, through any number of other unclear ones."""
    df = main_objects(files)
    words = F.transform(F.regexp_extract_all(F.regexp_extract("name", r"([^.]*)$", 1), F.lit(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])"), F.lit(0)), F.lower)
    listed = lambda known: F.array_intersect("_words", F.array(*[F.lit(w) for w in known]))
    says = lambda known: F.when(F.size(listed(known)) > 0, rules.NAME_WEIGHT).otherwise(0)
    df = df.withColumn("_words", words)
    df = df.withColumn("_joins", F.regexp_count("bare", F.lit(any_script(rules.JOIN_WORD)))).withColumn("_aggs", F.regexp_count("bare", F.lit(any_script(rules.AGGREGATE_CALL))))
    one = lambda c: F.when(c, 1).otherwise(0)
    df = df.withColumn("_report", says(rules.REPORT_WORDS) + _score(rules.REPORT_BODY) + one(F.col("_joins") >= 3) + one(F.col("_aggs") >= 2)
                       + F.when(F.col("kind") == "view", 2).otherwise(0))
    df = df.withColumn("_etl", says(rules.ETL_WORDS) + _score(rules.ETL_BODY)).withColumn("_app", says(rules.APP_WORDS) + _score(rules.APP_BODY))
    screen = ((F.col("kind") == "procedure") & F.col("bare").rlike(any_script(rules.PROCEDURE_PARAMETERS)) & ~F.col("bare").rlike(any_script(rules.WRITE_WORD))
              & (F.col("_joins") <= 2) & (F.col("_aggs") == 0) & (F.col("_report") == 0) & (F.col("_etl") == 0))
    df = df.withColumn("score", F.col("_report") + F.col("_etl") - F.col("_app") - F.when(screen, 2).otherwise(0))
    routine = F.col("kind").isin("procedure", "function", "view")
    last_name, table = F.regexp_extract("name", r"([^.]*)$", 1), F.col("kind") == "table"
    migrates, stays = F.col("score") >= 2, F.col("score") <= -2
    writes, deployed, is_setup = F.col("bare").rlike(any_script(rules.WRITE_WORD)), F.col("path").rlike(rules.DEPLOYMENT_SCRIPTS), F.col("kind").isin("security", "schema")
    framework, log = table & last_name.rlike(any_script(rules.FRAMEWORK_TABLES)), table & last_name.rlike(any_script(rules.LOG_TABLES))
    script = ~F.col("kind").isin("procedure", "function", "view", "table", "trigger", "type", "security", "schema", "index", "sequence", "synonym")
    # (when, category, purpose, reason): the first that holds; routines have reasons of their own
    kinds = [(deployed, "skip", F.lit("deployment script"), "runs with a deployment; its rows come with the tables"),
             (routine & migrates, "migrate", F.when(F.col("_etl") > F.col("_report"), "ETL / data movement").otherwise("reporting / analytics"), None),
             (routine & stays, "keep", F.lit("application logic"), None), (routine, "review", F.lit("unclear"), None),
             (framework, "skip", F.lit("framework table"), "bookkeeping of an application framework"), (log, "data", F.lit("log table"), "a log: copied if it is analysed"),
             (table, "data", F.lit("table"), "holds rows to copy"), (F.col("kind").isin("trigger", "type"), "keep", F.col("kind"), "belongs to the application's own writes"),
             (is_setup, "skip", F.lit("security / setup"), "rights are set up anew"), (F.col("kind") == "index", "skip", F.col("kind"), "has no use there"),
             (F.col("kind").isin("sequence", "synonym"), "review", F.col("kind"), "has no direct counterpart"),
             (script & writes, "data", F.lit("seed data"), "its rows come with the tables"), (F.lit(True), "review", F.lit("script"), "creates no object")]
    pick = lambda i: F.coalesce(*[F.when(k[0], k[i] if isinstance(k[i], Column) else F.lit(k[i])) for k in kinds])
    named = [F.when(F.size(listed(known)) > 0, F.concat(F.lit(f"{what}: "), F.array_join(F.array_sort(F.array_distinct(listed(known))), ", ")))
             for known, what in ((rules.REPORT_WORDS, "named like reporting"), (rules.ETL_WORDS, "named like data movement"), (rules.APP_WORDS, "named like application code"))]
    told = F.filter(F.array(*named, *_body_reasons(rules.APP_BODY, rules.APP_REASONS), *_body_reasons(rules.REPORT_BODY, rules.REPORT_REASONS),
                            *_body_reasons(rules.ETL_BODY, rules.ETL_REASONS),
                            F.when(F.col("_joins") >= 3, F.concat(F.lit("joins "), F.col("_joins").cast("string"), F.lit(" tables"))),
                            F.when(F.col("_aggs") >= 2, F.concat(F.col("_aggs").cast("string"), F.lit(" aggregates"))),
                            F.when(F.col("kind") == "view", "a view moves with its tables"), F.when(screen, "looks rows up by parameters")), lambda x: x.isNotNull())
    reasons = F.when(routine & ~deployed, F.when(F.size(told) == 0, F.array(F.lit("nothing in its name or code tells"))).otherwise(told)).otherwise(F.array(pick(3)))
    versions = rules.VERSIONED_TABLES if dialect in rules.TSQL else rules.SYSTEM_VERSIONING
    narrow = df.select("path", "name", "kind", "short", "score", pick(2).alias("purpose"), pick(1).alias("category"), reasons.alias("reasons"), routine.alias("_routine"),
                       (F.col("bare").rlike(any_script(rules.AUDIT_COLUMNS)) & table).alias("audited"), (F.col("bare").rlike(versions) & table).alias("versioned"))
    placed = cut_lineage(narrow)  # a few short values per file; the texts are not scored twice
    followed = follow_callers(placed, _calls(files, placed))
    joined = placed.join(followed, (placed["short"] == followed["_word"]) & placed["_routine"] & (placed["category"] == "review"), "left")
    helper = F.when(F.col("_label") == "migrate", "helper for reporting / ETL").when(F.col("_label") == "keep", "helper for application logic")
    why = F.concat(F.when(F.col("_label") == "migrate", "used by code that moves: ").otherwise("used only by code that stays: "), F.col("_first"),
                   F.when(F.col("_callers") > 1, F.concat(F.lit(" and "), (F.col("_callers") - 1).cast("string"), F.lit(" more"))).otherwise(""))
    return joined.select("path", "name", "kind", F.coalesce("_label", "category").alias("category"), F.coalesce(helper, "purpose").alias("purpose"),
                         F.when(F.col("_routine"), F.col("score")).alias("score"), F.when(F.col("_label").isNotNull(), F.array_append("reasons", why)).otherwise(F.col("reasons")).alias("reasons"),
                         "audited", "versioned", F.regexp_extract("name", r"([^.]*)$", 1).alias("short"))


def fit_verdict(placed: DataFrame) -> DataFrame:
    """One row: counts per category and the verdict for the whole corpus."""
    n = lambda c: F.count_if(F.col("category") == c)
    table = F.col("kind") == "table"
    counts = placed.agg(
        *[n(c).alias(c) for c in ("migrate", "data", "keep", "skip", "review")], F.count_if(table).alias("tables"), F.count_if("audited").alias("audited"), F.count_if("versioned").alias("versioned"),
        F.count_if(table & (F.col("category") == "skip")).alias("framework"), F.count_if(table & (F.col("category") == "data") & F.col("short").rlike(any_script(rules.WAREHOUSE_TABLES))).alias("warehouse"))
    app = (F.col("framework") > 0) | (F.col("versioned") > 0) | ((F.col("tables") > 0) & (F.col("audited") / F.greatest("tables", F.lit(1)) >= 0.3)) | (F.col("keep") >= 3)
    house = (F.col("warehouse") > 0) | ((F.col("migrate") >= 3) & (F.col("keep") == 0))
    verdict = (F.when(app & ~house, "application").when(house & ~app, "warehouse").when(app & house, "mixed")
               .when(F.col("keep") > F.col("migrate"), "application").when(F.col("keep") == 0, "warehouse").otherwise("mixed"))
    return counts.withColumn("verdict", verdict)


# ---------------------------------------------------------------- lineage

def _object_name(raw: Column) -> Column:
    """schema.name or name: the last two parts without quotes or spaces."""
    parts = F.transform(F.split(raw, r"\."), lambda p: F.regexp_replace(p, r"^[\s\[\]\"`]+|[\s\[\]\"`]+$", ""))
    parts = F.filter(parts, lambda p: p != "")
    return F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), F.lit(2)), ".")


def edges(files: DataFrame) -> DataFrame:
    """What each file reads, writes and calls: distinct (path, object, how), object names in lower case."""
    def uses_of(how: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all("code", F.lit(any_script(pattern)), F.lit(1)),
                           lambda x: F.struct(F.lower(_object_name(x)).alias("object"), F.lit(how).alias("how")))
    uses = [uses_of(how, pattern) for how, pattern in rules.USES.items()]
    # each file's list is made distinct in place, so nothing is exchanged
    found = F.array_distinct(F.concat(*uses))
    return with_masks(files).select("path", F.inline(found)).where(~F.col("object").rlike(any_script(rules.NOT_AN_OBJECT)) & (F.col("object") != ""))


def missing_objects(used: DataFrame, known: DataFrame) -> DataFrame:
    """Used objects that are not known. A name without a schema matches any known name that ends in it."""
    names = known.select(F.lower("name").alias("_known")).distinct()
    objects = used.select("object").distinct()
    full = objects.join(names, F.col("object") == F.col("_known"), "left_anti")
    short = names.select(F.regexp_extract("_known", r"([^.]*)$", 1).alias("_short")).distinct()
    bare = F.when(~F.col("object").contains("."), F.col("object"))
    return full.join(short, bare == F.col("_short"), "left_anti")


# ---------------------------------------------------------------- table definitions

def _opened(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("("), F.lit("")))


def _up_to_closing(text: Column) -> Column:
    """The text before the parenthesis that closes one opened before it; NULL when nothing closes it."""
    pieces = F.split(text, r"\)")
    start = F.struct(F.lit(0).alias("closed"), F.lit(0).alias("opened"), F.lit(-1).alias("end"))

    def step(acc: Column, piece: Column) -> Column:
        opened = acc["opened"] + _opened(piece)
        end = F.when((acc["end"] < 0) & (opened == acc["closed"]), acc["closed"]).otherwise(acc["end"])
        return F.struct((acc["closed"] + 1).alias("closed"), opened.alias("opened"), end.alias("end"))
    end = F.aggregate(pieces, start, step, lambda acc: acc["end"])
    return F.transform(F.array(F.struct(pieces.alias("p"), end.alias("e"))), lambda x: F.when(
        (x["e"] >= 0) & (x["e"] < F.size(x["p"]) - 1), F.array_join(F.slice(x["p"], F.lit(1), x["e"] + 1), ")")))[0]


def _at_outer_commas(text: Column) -> Column:
    """The parts between commas that lie outside all parentheses."""
    start = F.struct(F.lit(0).alias("depth"), F.array().cast("array<string>").alias("parts"))

    def step(acc: Column, piece: Column) -> Column:
        depth = acc["depth"] + _opened(piece) - (F.length(piece) - F.length(F.replace(piece, F.lit(")"), F.lit(""))))
        done = F.size(acc["parts"])
        whole = F.concat(F.slice(acc["parts"], F.lit(1), done - 1), F.array(F.concat(F.element_at(acc["parts"], -1), F.lit(","), piece)))
        return F.struct(depth.alias("depth"), F.when(acc["depth"] > 0, whole).otherwise(F.concat(acc["parts"], F.array(piece))).alias("parts"))
    return F.aggregate(F.split(text, ","), start, step, lambda acc: acc["parts"])


def defined_tables(files: DataFrame) -> DataFrame:
    """Columns of the CREATE TABLE statements: (path, table_name, position, column_name, data_type, nullable, identity,
    primary_key). Bodies and columns are cut at balanced parentheses of any depth."""
    clean = lambda c: F.regexp_replace(c, r"[\[\]`\"]", "")
    pieces = with_masks(files).select("path", F.explode(F.split("code", any_script(r"(?=" + rules.CREATE_TABLE + ")"))).alias("piece"))
    named = pieces.select("path", F.regexp_extract("piece", any_script(r"\A" + rules.CREATE_TABLE), 1).alias("name"), F.regexp_replace("piece", any_script(r"\A" + rules.CREATE_TABLE), "").alias("rest"))
    tables = named.where("name <> ''").select(
        "path", clean(F.regexp_replace("name", r"\s*\.\s*", ".")).alias("table_name"), _up_to_closing(F.col("rest")).alias("body")).where("body IS NOT NULL")
    parts = F.filter(F.transform(_at_outer_commas(F.col("body")), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")
    key = r"(?i)PRIMARY\s+KEY\s*(?:CLUSTERED|NONCLUSTERED)?\s*\(([^)]*)\)"
    head = lambda p: F.upper(clean(F.regexp_extract(p, r"^\S+", 0)))
    is_column = lambda p: ~head(p).isin(rules.NOT_A_COLUMN) & p.rlike(r"\s")
    keyed = F.array_join(F.transform(F.filter("parts", lambda p: head(p).isin(rules.NOT_A_COLUMN)), lambda p: F.regexp_extract(p, key, 1)), ",")
    key_names = F.transform(F.split(keyed, ","), lambda c: F.lower(clean(F.regexp_extract(c, r"(\S+)", 1))))
    tables = tables.withColumn("parts", parts).withColumn("_keys", key_names)
    rows = tables.select("path", "table_name", "_keys", F.posexplode(F.filter("parts", is_column)).alias("position", "p"))
    name = clean(F.regexp_extract("p", r"^\S+", 0))
    kind = F.regexp_extract("p", r"(?U)^(?:\[[^\]]+\]|`[^`]+`|\"[^\"]+\"|\S+)\s+(\[?[\w.]+\]?(?:\s*\([^)]*\))?|[^\s,]+)", 1)
    return rows.select(
        "path", "table_name", (F.col("position") + 1).alias("position"), name.alias("column_name"), F.regexp_replace(kind, r"^[\[\]]+|[\[\]]+$", "").alias("data_type"),
        (~F.col("p").rlike(r"(?i)\bNOT\s+NULL\b")).alias("nullable"),
        F.col("p").rlike(r"(?is)\bIDENTITY\b|\bGENERATED\b.*\bAS\s+IDENTITY\b|\bAUTOINCREMENT\b").alias("identity"),
        (F.col("p").rlike(r"(?i)\bPRIMARY\s+KEY\b") | F.array_contains("_keys", F.lower(name))).alias("primary_key"))


# ---------------------------------------------------------------- features, comparison, drift, effort

def features(files: DataFrame, schemas: list[str] = ()) -> DataFrame:
    """How many files use each notable feature: (feature, files). A name of four parts, or of three that does not start with a
    local schema or one of `schemas`, is a reference to another database."""
    local = [*rules.LOCAL_SCHEMAS, *[s.lower() for s in schemas]]

    def elsewhere(name: Column) -> Column:
        parts = F.split(F.lower(_strip_quotes(name)), r"\.")
        return (F.size(parts) == 4) | ~parts[0].isin(local)
    tests = {k: F.col("bare").rlike(any_script(p)) for k, p in rules.FEATURES.items()}
    tests["cross-database"] = F.exists(F.regexp_extract_all("code", F.lit(any_script(rules.LONG_NAME)), F.lit(0)), elsewhere)
    df = with_masks(files).agg(*[F.count_if(t).alias(k) for k, t in tests.items()])
    return df.select(F.inline(F.array(*[F.struct(F.lit(k).alias("feature"), F.col(k).alias("files")) for k in tests])))


def objects_per_schema(files: DataFrame) -> DataFrame:
    """Objects per schema and kind."""
    objects = main_objects(files).where(F.col("kind").isin("table", "procedure", "function", "view", "trigger"))
    parts = F.split("name", r"\.")
    schema = F.when(F.size(parts) >= 2, F.element_at(parts, -2)).otherwise("(default)")
    return objects.groupBy(schema.alias("schema_name"), "kind").agg(F.count(F.lit(1)).alias("objects"))


def normalised(text: Column) -> Column:
    """Text without comments, brackets, case and spacing differences."""
    steps = [(r"(?s)--[^\n]*|/\*.*?\*/", " "), (r"[\[\]\"]", ""), (r"\bcreate\s+or\s+alter\b", "create"), (r"\bproc\b", "procedure"),
             (r"\bgo\b", " "), (r"[\s;]+", " ")]
    out = text
    for i, (pattern, replacement) in enumerate(steps):
        out = F.regexp_replace(F.lower(out) if i == 1 else out, pattern, replacement)
    return F.trim(out)


def code_objects(files: DataFrame) -> DataFrame:
    """Procedures, views, functions and triggers of the files: (name, body), body normalised; the last definition counts."""
    files = spread_over_cores(files, "path")
    pieces = F.split("text", any_script(r"(?=" + rules.CODE_OBJECT.replace("((?:", "(?:(?:", 1) + ")"))
    rows = files.select("path", F.posexplode(pieces).alias("position", "piece"))
    raw = F.lower(F.regexp_replace(F.regexp_extract("piece", any_script(r"\A" + rules.CODE_OBJECT), 1), r"[\[\]\"\s]", ""))
    rows = rows.withColumn("_raw", raw).where("_raw <> ''")
    name = F.when(F.col("_raw").contains("."), F.col("_raw")).otherwise(F.concat(F.lit("dbo."), F.col("_raw")))
    return rows.groupBy(name.alias("name")).agg(F.max_by(normalised(F.col("piece")), F.struct("path", "position")).alias("body"))


def compare_code(left: DataFrame, right: DataFrame) -> DataFrame:
    """Objects of two corpora: (name, result) with same | different | only_left | only_right. Same: one text contains the other."""
    a, b = code_objects(left).withColumnRenamed("body", "_a"), code_objects(right).withColumnRenamed("body", "_b")
    same = F.col("_a").contains(F.col("_b")) | F.col("_b").contains(F.col("_a"))
    result = F.when(F.col("_b").isNull(), "only_left").when(F.col("_a").isNull(), "only_right").when(same, "same").otherwise("different")
    return a.join(b, "name", "full").select("name", result.alias("result"))


def _statements(df: DataFrame, name: str, drop_settings: bool = False) -> DataFrame:
    """Statements of each file: one per semicolon in code, and a last one without. Session settings on a line of their own
    can be left out; what is hidden is a letter until then, so that a setting with a comment behind it still counts."""
    coded = spread_over_cores(df, "path").select("path", masked(segments(F.col("text")), keep_names=False, blank=_OTHER).alias("_code"))
    if drop_settings:
        coded = coded.withColumn("_code", F.regexp_replace("_code", any_script(rules.SESSION_SETTINGS), ""))
    last = F.when(F.substring_index("_code", ";", -1).rlike(rf"[^\s{_OTHER}]"), 1).otherwise(0)
    return coded.select("path", (F.length("_code") - F.length(F.replace("_code", F.lit(";"), F.lit(""))) + last).alias(name))


def dropped_statements(before: DataFrame, after: DataFrame, notes: DataFrame) -> DataFrame:
    """Files with fewer statements after than before, less the notes (path, notes) explaining it: (path, missing)."""
    a, b = _statements(before, "_before", drop_settings=True), _statements(after, "_after")
    gap = F.col("_before") - F.col("_after") - F.coalesce("notes", F.lit(0))
    return a.join(b, "path").join(notes.select("path", "notes"), "path", "left").select("path", gap.cast("int").alias("missing")).where("missing > 0")


def fingerprints(files: DataFrame) -> DataFrame:
    return files.select("path", F.sha2("text", 256).alias("sha256"))


def set_fingerprint(prints: DataFrame, prefix: int = 4) -> DataFrame:
    """One fingerprint for the whole set in two steps, so no task sees all files: files are grouped by the first characters of
    their path's hash, each group's sorted `path:sha256` lines are hashed, then the groups' lines are hashed."""
    line = F.concat("path", F.lit(":"), "sha256", F.lit("\n"))
    groups = prints.groupBy(F.substring(F.sha2("path", 256), 1, prefix).alias("g")).agg(
        F.count(F.lit(1)).alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list(line)), ""), 256).alias("h"))
    top = F.array_join(F.array_sort(F.collect_list(F.concat("g", F.lit(":"), "h", F.lit("\n")))), "")  # at most 16^prefix lines
    return groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("files"), F.sha2(top, 256).alias("fingerprint"))


LANES = 16


def multiset_fingerprint(prints: DataFrame) -> DataFrame:
    """One row (files, lanes): a fingerprint that files can be added to and taken from. Each file's path and hash give LANES numbers of 32 bits, which are added up
    by lane modulo 2^32; the order does not matter, parts can be summed apart, and a task keeps LANES numbers, not files."""
    line = F.concat("path", F.lit(":"), "sha256")
    digest = F.concat(F.sha2(line, 256), F.sha2(F.concat(F.lit("2:"), line), 256))
    lanes = [F.conv(F.substring("_digest", 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(LANES)]
    parts = prints.select(digest.alias("_digest")).select(*[x.alias(f"l{i}") for i, x in enumerate(lanes)])
    # sums of 2^31 files stay below 2^63; partitions are reduced apart before they are added modulo 2^32
    apart = parts.groupBy(F.spark_partition_id().alias("_part")).agg(F.count(F.lit(1)).alias("n"), *[F.pmod(F.sum(f"l{i}"), F.lit(1 << 32)).alias(f"l{i}") for i in range(LANES)])
    summed = [F.coalesce(F.pmod(F.sum(f"l{i}"), F.lit(1 << 32)), F.lit(0)) for i in range(LANES)]
    return apart.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("files"), F.array(*summed).alias("lanes"))


def changed_fingerprint(fingerprint: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """The fingerprint after files came and went, from these files alone."""
    sides = [fingerprint.withColumn("sign", F.lit(1)), multiset_fingerprint(added).withColumn("sign", F.lit(1)), multiset_fingerprint(removed).withColumn("sign", F.lit(-1))]
    signed = reduce(DataFrame.unionByName, sides)
    lanes = [F.pmod(F.sum(F.col("sign") * F.col("lanes")[i]), F.lit(1 << 32)) for i in range(LANES)]
    return signed.agg(F.sum(F.col("sign") * F.col("files")).alias("files"), F.array(*lanes).alias("lanes"))


def fingerprint_text(lanes: Column) -> Column:
    return F.array_join(F.transform(lanes, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def drift(recorded: DataFrame, current: DataFrame) -> DataFrame:
    """Files changed, missing or added since the fingerprints were recorded: (path, drift)."""
    a, b = recorded.select("path", F.col("sha256").alias("_a")), current.select("path", F.col("sha256").alias("_b"))
    kind = F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "added").when(F.col("_a") != F.col("_b"), "changed")
    return a.join(b, "path", "full").select("path", kind.alias("drift")).where("drift is not null")


def effort(complexity: DataFrame, findings: DataFrame) -> DataFrame:
    """Hours by hand (path, complexity), hours left after the move, and the share saved."""
    rates = F.create_map(*[F.lit(x) for pair in fixed.HOURS_PER_FILE.items() for x in pair])
    rate = F.coalesce(F.try_element_at(rates, F.upper("complexity")), F.lit(fixed.HOURS_PER_FILE["MEDIUM"]))
    base = complexity.agg(F.round(F.coalesce(F.sum(rate), F.lit(0.0)), 1).alias("baseline_hours"), F.count(F.lit(1)).alias("files"), F.lit(0).cast("bigint").alias("open_items"))
    open_items = findings.where("severity <> 'info'").agg(F.lit(0.0).alias("baseline_hours"), F.lit(0).cast("bigint").alias("files"), F.count(F.lit(1)).alias("open_items"))
    both = base.unionByName(open_items).agg(F.sum("baseline_hours").alias("baseline_hours"), F.sum("files").alias("files"), F.sum("open_items").alias("open_items"))
    left = F.round(F.col("open_items") * fixed.HOURS_PER_OPEN_ITEM + F.col("files") * fixed.REVIEW_HOURS_PER_FILE, 1)
    both = both.withColumn("remaining_hours", left)
    saved = F.when(F.col("baseline_hours") > 0, F.round(100 * F.greatest(F.lit(0.0), 1 - F.col("remaining_hours") / F.col("baseline_hours"))).cast("int")).otherwise(0)
    return both.withColumn("saved_percent", saved)


def open_items(files: DataFrame, findings: DataFrame) -> DataFrame:
    """Open errors and warnings per file; information is left out."""
    n = lambda s: F.count_if(F.col("severity") == s)
    counts = findings.groupBy("path").agg(n("error").alias("errors"), n("warning").alias("warnings"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return files.select("path").join(counts, "path", "left").select("path", zero("errors"), zero("warnings"))
