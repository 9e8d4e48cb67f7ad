"""URL filters: explicit host and path rules, and association rules over URL tokens.

Where no explicit rule fits, association rules decide: token combinations of labelled URLs that end in a verdict and pass the confidence and support
bounds, matched through an inverted index on each rule's rarest token. Spark's FP-growth mines them. Three things keep that bounded, and lose no rule:
tokens that stand in the very same labelled URLs, as the segments of one long path do, are mined as one and each of them matches; a token or combination
all of whose URLs have one verdict is a rule and is not extended, since no longer rule would gain confidence; and FP-growth, whose work grows with the
power of a URL's tokens, gets the URLs with at most BASKET_ITEMS tokens left. Longer ones are extended token by token up to the length of a rule. A
combination that is frequent in all URLs is frequent, at the same share, in the short or in the long ones, so both parts' findings together hold every rule; they are
then counted over all URLs. Rules hold up to MOST_ITEMS tokens. DataFrame functions only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, Window, functions as F

from datamove.session import cut_lineage

# fixed values: (verdict, host and path prefix)
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_SUPPORT, MIN_CONFIDENCE, MOST_ITEMS, BASKET_ITEMS = 0.002, 0.6, 3, 12
VERDICT = "verdict="


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest.substr(F.length(raw) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.coalesce(F.translate(raw, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def explicit(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null where none does."""
    rule = verdict = None
    for says, text in sorted(rules, key=lambda r: -len(r[1])):
        own, _, prefix = text.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith("/" + prefix)
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, says) if verdict is None else verdict.when(fits, says)
    return rule, verdict


def tokens(host: Column, path: Column) -> Column:
    """Sorted distinct items: the host, each of its labels, its last two labels, and each path segment that is not a number."""
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    last2 = F.when(F.size(labels) >= 2, F.array(F.concat(F.lit("site:"), F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".")))).otherwise(F.array().cast("array<string>"))
    segments = F.filter(F.split(path, "/"), lambda x: (x != "") & ~x.rlike(r"^[0-9]+(\.[A-Za-z]+)?$"))
    return F.array_sort(F.array_distinct(F.concat(F.transform(labels, lambda x: F.concat(F.lit("label:"), x)), last2, F.transform(segments, lambda x: F.concat(F.lit("path:"), x)))))


def token_classes(labelled: DataFrame, min_support: float = MIN_SUPPORT) -> DataFrame:
    """(items, verdict) -> (item, one, pure) of the tokens that may be in a rule. one: the shortest of those that stand in the same rows; pure: all rows have one verdict."""
    n = labelled.count()
    rows = labelled.select(F.explode("items").alias("item"), "verdict", F.xxhash64("items", "verdict").alias("row"))
    found = (rows.groupBy("item", "verdict").agg(F.count("*").alias("n"), F.sum(F.col("row").cast("decimal(20, 0)")).alias("rows"), F.bit_xor("row").alias("mixed"))
             .groupBy("item").agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.sum("rows").alias("rows"), F.bit_xor("mixed").alias("mixed"))
             .where(F.col("most") >= min_support * n))
    same = found.groupBy("n", "rows", "mixed").agg(F.min(F.struct(F.length("item").alias("length"), "item")).alias("one"))
    return cut_lineage(found.join(same, ["n", "rows", "mixed"]).select("item", F.col("one.item").alias("one"), (F.col("most") == F.col("n")).alias("pure")))


def by_rarest(parts: DataFrame, sets: DataFrame) -> DataFrame:
    """(antecedent, ...) with `item`: the antecedent's token that the fewest sets hold."""
    counts = sets.select(F.explode("items").alias("item")).groupBy("item").agg(F.count("*").alias("held"))
    rarest = (parts.select("antecedent", F.explode("antecedent").alias("item")).join(counts, "item", "left")
              .groupBy("antecedent").agg(F.min_by("item", F.struct(F.coalesce("held", F.lit(0)), "item")).alias("item")))
    return parts.join(rarest, "antecedent")


def counted(baskets: DataFrame, parts: DataFrame) -> DataFrame:
    """(antecedent) -> (antecedent, verdict, n, of): in how many rows of the verdict, and of all, its tokens stand together."""
    met = (baskets.withColumn("item", F.explode("items")).join(by_rarest(parts, baskets), "item").where(F.size(F.array_except("antecedent", "items")) == 0)
           .groupBy("antecedent", "verdict").agg(F.sum("n").alias("n")))
    return met.withColumn("of", F.sum("n").over(Window.partitionBy("antecedent")))


def combinations(baskets: DataFrame, least: float) -> list[DataFrame]:
    """(antecedent, verdict, n, of) of all combinations of two to MOST_ITEMS tokens that some verdict has in at least `least` rows; those whose rows all have
    one verdict are not extended."""
    short = F.size("items") <= BASKET_ITEMS
    rows = {r["short"]: r["n"] for r in baskets.groupBy(short.alias("short")).agg(F.sum("n").alias("n")).collect()}
    if sum(rows.values()) < least or not rows:
        return []
    share, found = least / sum(rows.values()) * (1 - 1e-9), []  # rounding must not raise a bound
    is_verdict = lambda x: x.startswith(VERDICT)
    if rows.get(True):
        repeated = baskets.where(short).select(F.concat("items", F.array(F.concat(F.lit(VERDICT), "verdict"))).alias("items"), F.explode(F.sequence(F.lit(1).cast("long"), "n"))).select("items")
        mined = FPGrowth(itemsCol="items", minSupport=share).fit(repeated).freqItemsets
        parts = (mined.where(F.exists("items", is_verdict) & F.size("items").between(3, MOST_ITEMS + 1))
                 .select(F.array_sort(F.filter("items", lambda x: ~is_verdict(x))).alias("antecedent")).distinct())
        found.append(cut_lineage(counted(baskets, parts).where(F.col("n") >= least)))
    if rows.get(False):
        held = baskets.where(~short).select("id", "verdict", "n", F.explode("items").alias("last")).withColumn("part", F.array("last"))
        for _ in range(MOST_ITEMS - 1):
            first = held.select("id", "verdict", "n", "part", "last", F.slice("part", 1, F.size("part") - 1).alias("stem"))
            more = first.select("id", "stem", F.col("last").alias("next"))
            grown = first.join(more, ["id", "stem"]).where(F.col("next") > F.col("last")).select(
                "id", "verdict", "n", F.col("next").alias("last"), F.array_append("part", F.col("next")).alias("part"))
            parts = (grown.groupBy("part", "verdict").agg(F.sum("n").alias("n")).where(F.col("n") >= share * rows[False]).select(F.col("part").alias("antecedent")).distinct())
            known = cut_lineage(counted(baskets, parts).where(F.col("n") >= least))
            found.append(known)
            held = cut_lineage(grown.join(known.where("n < of").select(F.col("antecedent").alias("part")).distinct(), "part", "left_semi"))
    return found


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(items, verdict) -> (antecedent, verdict, confidence, support): rules of up to MOST_ITEMS tokens, each the `one` of its class; a rule that adds tokens to a
    shorter one of the same verdict without gaining confidence is dropped."""
    total, classes = labelled.count(), token_classes(labelled, min_support)
    ones = classes.where("item = one").select("item", "pure")
    sets = cut_lineage(labelled.groupBy("items", "verdict").agg(F.count("*").alias("n")).withColumn("id", F.monotonically_increasing_id()))
    held = sets.select("id", "verdict", "n", F.explode("items").alias("item")).join(ones, "item")
    single = held.groupBy(F.array("item").alias("antecedent"), "verdict").agg(F.sum("n").alias("n")).withColumn("of", F.sum("n").over(Window.partitionBy("antecedent")))
    baskets = cut_lineage(held.where("NOT pure").groupBy("id", "verdict", "n").agg(F.array_sort(F.collect_list("item")).alias("items")).where(F.size("items") > 1))
    found = reduce(DataFrame.unionByName, combinations(baskets, min_support * total), single.where(F.col("n") >= min_support * total)).distinct()
    rules = cut_lineage(found.select("antecedent", "verdict", (F.col("n") / F.col("of")).alias("confidence"), (F.col("n") / F.lit(float(max(total, 1)))).alias("support"))
                        .where(F.col("confidence") >= min_confidence))
    # shorter rules that are a subset, through their first item: at most MOST_ITEMS index rows a rule
    short = rules.select(F.col("antecedent")[0].alias("item"), F.col("antecedent").alias("part"), F.col("verdict").alias("v"), F.col("confidence").alias("c"))
    weaker = (rules.withColumn("item", F.explode("antecedent")).join(short, "item")
              .where((F.col("v") == F.col("verdict")) & (F.size("part") < F.size("antecedent")) & (F.col("c") >= F.col("confidence"))
                     & (F.size(F.array_except("part", "antecedent")) == 0)).select("antecedent", "verdict").distinct())
    return rules.join(weaker, ["antecedent", "verdict"], "left_anti")


def judge(sets: DataFrame, rules: DataFrame, classes: DataFrame) -> DataFrame:
    """(items) -> (items, verdict, confidence, matched): of the rules that have a token of each of their classes there, the one of highest confidence, then support,
    then most tokens. classes: (item, one), as they were mined; matched: the tokens that are there."""
    own = (sets.select("items", F.explode("items").alias("item")).join(classes.select("item", "one"), "item").groupBy("items", "one").agg(F.min("item").alias("item"))
           .groupBy("items").agg(F.map_from_entries(F.collect_list(F.struct("one", "item"))).alias("own"))
           .select(F.col("items").alias("all_items"), "own", F.map_keys("own").alias("items")))
    found = (own.withColumn("item", F.explode("items")).join(by_rarest(rules, own), "item").where(F.size(F.array_except("antecedent", "items")) == 0)
             .groupBy("all_items").agg(F.max(F.struct("confidence", "support", F.size("antecedent").alias("n"), "verdict",
                                                      F.transform("antecedent", lambda x: F.col("own")[x]).alias("matched"))).alias("best")))
    return found.select(F.col("all_items").alias("items"), F.col("best.verdict").alias("verdict"), F.col("best.confidence").alias("confidence"), F.col("best.matched").alias("matched"))


def filter_urls(pages: DataFrame, labels: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """-> (page_id, host, path, rule, verdict, matched, confidence).

    Labelled URLs: those an explicit rule decides, and those whose id has a row in `labels` (toxic or of low quality: block, else allow). A null url
    or one without `://` has an empty host and path and gets `default`, as does one that no rule fits. Repeated rows and null ids are kept;
    other columns are ignored; without labels nothing is mined. Token sets are judged once each, so one host may hold any share of the rows.
    """
    host, path = host_and_path(F.col(url_col))
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = explicit(F.col("host"), F.col("path"))
    base = cut_lineage(base.withColumns({"rule": rule, "ruled": verdict, "items": tokens(F.col("host"), F.col("path"))})
                       .withColumn("key", F.array_join("items", "\u0001")))
    marks = (labels.where("doc_id IS NOT NULL AND (toxic IS NOT NULL OR quality IS NOT NULL)").groupBy(F.col("doc_id").cast("long").alias("page_id"))
             .agg(F.max(F.when((F.col("toxic") == 1) | (F.col("quality") == 0), "block").otherwise("allow")).alias("marked")))
    labelled = (base.where("size(items) > 0").join(marks, "page_id", "left").withColumn("verdict", F.coalesce("ruled", "marked"))
                .where("verdict IS NOT NULL").select("items", "verdict"))
    labelled = cut_lineage(labelled)
    rules = mine(labelled)
    open_sets = base.where("rule IS NULL AND size(items) > 0").groupBy("key").agg(F.first("items").alias("items"))
    judged = judge(open_sets.select("items"), rules, token_classes(labelled)).select(F.array_join("items", "\u0001").alias("key"), F.col("verdict").alias("mined"), "confidence", "matched")
    return base.join(judged, "key", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("ruled", "mined", F.lit(default)).alias("verdict"),
        F.when(F.col("rule").isNull(), F.array_join("matched", " ")).alias("matched"), F.when(F.col("rule").isNull(), F.col("confidence")).alias("confidence"))
