"""Sharding by proportional stratified interleaving.

Rows of each source are ranked in a seeded random order; rank over the source's size is a row's place between 0 and 1; all rows sorted by
place are cut into shards of equal row counts, so every stretch, and so every shard, holds the sources in the mixture of the whole.

Both ranks are distributed: the seeded order and the places are cut into even intervals, counted, and a row's rank is its interval's offset
plus its row number inside. Texts never move; a source of any size is spread over all intervals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from datamove.session import cut_lineage

INTERVALS = 4096


def interleave(docs: DataFrame, shards: int = 16, seed: int = 20240607, id_col: str = "doc_id", text_col: str = "text",
               source_col: str = "source") -> DataFrame:
    """-> (doc_id, size, text_crc32, source_name, place, law, shard, slot, grown_shard): law `rows`, shards differ by one row at most.

    size: UTF-8 bytes of the text plus 1; a null text is empty. A null source is a source of its own. Equal rows are interchangeable; null ids
    and repeated rows are kept; other columns are ignored; an empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("")).alias("src"))
    order = ["h", "doc_id", "text_crc32", "size"]
    base = cut_lineage(base.withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "text_crc32"))
                       .withColumn("part", F.shiftrightunsigned("h", 64 - (INTERVALS.bit_length() - 1)).cast("int")))

    counts = base.groupBy("src", "part").agg(F.count("*").alias("n"))  # at most INTERVALS rows a source
    upto = Window.partitionBy("src").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("src", "part", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy("src")).alias("of"))
    ranked = (base.join(counts, ["src", "part"])
              .withColumn("rank", F.col("before") + F.row_number().over(Window.partitionBy("src", "part").orderBy(*order)) - 1)
              .withColumn("place", (F.col("rank") + 0.5) / F.col("of")))
    ranked = cut_lineage(ranked.select("doc_id", "size", "text_crc32", "src", "h", "place", F.floor(F.col("place") * INTERVALS).cast("int").alias("cell")))

    cells = ranked.groupBy("cell").agg(F.count("*").alias("n"))  # at most INTERVALS rows in all
    cells = cells.select("cell", F.coalesce(F.sum("n").over(Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
                         F.sum("n").over(Window.partitionBy()).alias("total"))
    at = F.col("before") + F.row_number().over(Window.partitionBy("cell").orderBy("place", "src", *order)) - 1
    placed = ranked.join(cells, "cell").withColumn("at", at).withColumn("shard", F.expr(f"at * {shards} div total"))
    return placed.select("doc_id", "size", "text_crc32", F.when(F.col("src") != "", F.substring("src", 2, 1 << 30)).alias("source_name"), "place", F.lit("rows").alias("law"),
                         F.col("shard").cast("int").alias("shard"),
                         (F.col("at") - F.expr(f"(shard * total + {shards - 1}) div {shards}")).cast("long").alias("slot"),
                         F.lit(None).cast("int").alias("grown_shard"))
