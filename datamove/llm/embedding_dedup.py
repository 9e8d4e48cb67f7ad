"""Embedding near-duplicates by NN-descent.

Equal vectors are one node with a count. Each node keeps a list of near neighbours of its own label; a round joins every node's neighbours
and reverse neighbours with each other and keeps the nearest. Nodes are dealt into blocks of a label, so a block's vectors are sent once for all its
joins. Of all pairs a block meets that reach the threshold, ties are kept beside the lists: the pairs themselves may be many, so each node is tied to the
least node of its part of the block. Components are made from ties, so a link never gives way to nearer nodes, and the links of a group
are counted exactly, block pair by block pair.

Lists whose last place still reaches the threshold are saturated: such nodes lie in dense groups, and are compared with all nodes of their label.
Recall is audited label by label: nodes chosen by hash are compared with all nodes of the label, four times as many each time, until LINKED of them had
links or all nodes were compared, which is then exact. Where it falls short, lists are doubled and more rounds follow; a label that still
falls short is compared whole. Labels of one block are exact from the start. What was measured is logged.
"""

from __future__ import annotations

import logging
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from datamove.llm.graph import components
from datamove.session import cut_lineage

NEIGHBOURS, STARTS, ROUNDS, STILL = 10, 3, 5, 0.02  # list length; random partitions at the start; rounds at most; ended by fewer changes than this share of all places
BLOCK = 1024
TILE = 2048  # nodes of each side of a comparison of a label
AUDITED, LINKED, WANTED_RECALL, MORE_ROUNDS = 4096, 256, 0.98, 3  # nodes of a label at first; of them with links, at least
EDGE = "u long, v long, sim double, tie boolean"  # a place of u's list, or a tie
_log = logging.getLogger(__name__)


def _vectors(column) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.zeros((0, 1))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _ties(nodes: np.ndarray, i: np.ndarray, j: np.ndarray) -> pd.DataFrame:
    """Each end of the pairs with the first node it is connected with."""
    root = np.arange(len(nodes))
    while True:
        least = root.copy()
        np.minimum.at(least, i, root[j])
        np.minimum.at(least, j, root[i])
        least = least[least]
        if (least == root).all():
            break
        root = least
    tied = np.flatnonzero(root != np.arange(len(nodes)))
    return pd.DataFrame({"u": nodes[tied], "v": nodes[root[tied]], "sim": 0.0, "tie": True})


def _pairs_of(x: np.ndarray, nodes: np.ndarray, k: int, threshold: float) -> pd.DataFrame:
    """For each node its k nearest of these, and the ties of all pairs."""
    sims = x @ x.T
    np.fill_diagonal(sims, -2)
    ties = _ties(nodes, *np.nonzero(np.triu(sims >= threshold)))
    k = min(k, len(nodes) - 1)
    near = np.argpartition(-sims, k - 1, axis=1)[:, :k] if k > 0 else np.zeros((len(nodes), 0), int)
    value = np.take_along_axis(sims, near, axis=1)
    return pd.concat([pd.DataFrame({"u": np.repeat(nodes, near.shape[1]), "v": nodes[near].ravel(), "sim": value.ravel(), "tie": False}), ties])


def _first_lists(k: int, threshold: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return _pairs_of(_unit(_vectors(pdf["vec"])), pdf["node"].to_numpy(), k, threshold)
    return run


def _local_joins(k: int, threshold: float):
    def run(lists: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        """lists: (c, member) of the block's centres; vectors: each distinct member with its last place."""
        if not len(lists) or not len(vectors):
            return pd.DataFrame({"u": pd.Series(dtype="int64"), "v": pd.Series(dtype="int64"), "sim": pd.Series(dtype="float64"), "tie": pd.Series(dtype="bool")})
        vectors = vectors.sort_values("node")
        nodes, low, x = vectors["node"].to_numpy(), vectors["low"].to_numpy(), _unit(_vectors(vectors["vec"]))
        lists = lists.sort_values("c")
        at = np.searchsorted(nodes, lists["member"].to_numpy())
        cuts = np.flatnonzero(np.diff(lists["c"].to_numpy())) + 1
        u, v, sim = [], [], []
        for members in np.split(at, cuts):
            s = x[members] @ x[members].T
            i, j = np.nonzero(np.triu((s > np.minimum(low[members][:, None], low[members][None, :])) | (s >= threshold), 1))
            u.append(members[i])
            v.append(members[j])
            sim.append(s[i, j])
        u, v, sim = map(np.concatenate, (u, v, sim))
        near = sim >= threshold
        ties = _ties(nodes, u[near], v[near])
        out = pd.DataFrame({"u": np.concatenate([u, v]), "v": np.concatenate([v, u]), "sim": np.concatenate([sim, sim])})
        out = out[out["sim"].to_numpy() > low[out["u"].to_numpy()]].drop_duplicates(["u", "v"])
        out = out.sort_values(["u", "sim"], ascending=[True, False]).groupby("u").head(k)
        return pd.concat([pd.DataFrame({"u": nodes[out["u"].to_numpy()], "v": nodes[out["v"].to_numpy()], "sim": out["sim"].to_numpy(), "tie": False}), ties])
    return run


def _count_links(threshold: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """One pair of blocks of a group: for each node the number of vectors of the other block linked to it, and its least linked node."""
        pdf = pdf.sort_values(["side", "node"])
        side, nodes, n, x = pdf["side"].to_numpy(), pdf["node"].to_numpy(), pdf["n"].to_numpy(), _unit(_vectors(pdf["vec"]))
        a, b = side == 0, side == 1
        if b.any():
            linked = x[a] @ x[b].T >= threshold
            links = np.concatenate([linked @ n[b], linked.T @ n[a]])
            return pd.DataFrame({"node": np.concatenate([nodes[a], nodes[b]]), "links": links.astype("int64")})
        linked = x @ x.T >= threshold
        np.fill_diagonal(linked, False)
        return pd.DataFrame({"node": nodes, "links": (linked @ n).astype("int64")})
    return run


def _compare(threshold: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """One tile of a label: for each query its links here and those of its own component, and ties of the links between components."""
        side, label = pdf["side"].to_numpy(), pdf["label"].iloc[0]
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        nodes, n, of, x = pdf["node"].to_numpy(), pdf["n"].to_numpy(), pdf["component"].to_numpy(), _unit(_vectors(pdf["vec"]))
        i, j = np.nonzero((x[a] @ x[b].T >= threshold) & (nodes[a][:, None] != nodes[b][None, :]))
        i, j = a[i], b[j]
        same = of[i] == of[j]
        links = np.bincount(i, weights=n[j], minlength=len(nodes)).astype("int64")
        met = np.bincount(i[same], weights=n[j[same]], minlength=len(nodes)).astype("int64")
        at = np.flatnonzero(links)
        ties = _ties(nodes, i[~same], j[~same])
        return pd.DataFrame({"label": label, "u": np.concatenate([nodes[at], ties["u"].to_numpy()]), "v": np.concatenate([nodes[at], ties["v"].to_numpy()]),
                             "links": np.concatenate([links[at], np.zeros(len(ties), "int64")]), "met": np.concatenate([met[at], np.zeros(len(ties), "int64")])})
    return run


def _with_all(queries: DataFrame, nodes: DataFrame, groups: DataFrame, threshold: float) -> DataFrame:
    """Query nodes against all nodes of their labels, exactly -> (label, u, v, links, met): u = v counts links of a query, all and within its component
    (one row of each tile that has any); else a tie."""
    asked = queries.select("node", F.lit(True).alias("asked"))
    placed = cut_lineage(nodes.select("label", "node", "n").join(groups, "node", "left").join(asked, "node", "left")
                         .select("label", "node", "n", F.coalesce("component", "node").alias("component"), F.col("asked").isNotNull().alias("asked")))
    sides = (placed.groupBy("label").agg(F.ceil(F.count_if("asked") / TILE).cast("int").alias("xs"), F.ceil(F.count("*") / TILE).cast("int").alias("ys"))
             .where("xs > 0"))
    named = placed.join(sides, "label").join(nodes.select("node", "vec"), "node")
    part = lambda c: F.pmod(F.xxhash64("node", F.lit(5)), F.col(c)).cast("int")
    all_of = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    a = named.where("asked").select("label", part("xs").alias("x"), all_of("ys").alias("y"), F.lit(0).alias("side"), "node", "n", "component", "vec")
    b = named.select("label", all_of("xs").alias("x"), part("ys").alias("y"), F.lit(1).alias("side"), "node", "n", "component", "vec")
    return cut_lineage(a.unionByName(b).groupBy("label", "x", "y").applyInPandas(_compare(threshold), "label long, u long, v long, links long, met long"))


def _improve(lists: DataFrame, nodes: DataFrame, k: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """One round: neighbours of neighbours, both ways."""
    last = lists.groupBy("u").agg(F.min("sim").alias("last"), F.count("*").alias("filled"))
    low = nodes.join(last.withColumnRenamed("u", "node"), "node", "left").withColumn(
        "low", F.when(F.col("filled") >= k, F.col("last")).otherwise(F.lit(-2.0))).select("node", "low", "vec")
    back = (lists.select(F.col("v").alias("c"), F.col("u").alias("member"))
            .withColumn("r", F.row_number().over(Window.partitionBy("c").orderBy(F.xxhash64("member", "c")))).where(F.col("r") <= k).select("c", "member"))
    around = lists.select(F.col("u").alias("c"), F.col("v").alias("member")).unionByName(back)
    around = around.unionByName(around.select("c", F.col("c").alias("member"))).distinct()
    around = around.join(nodes.select(F.col("node").alias("c"), "block"), "c").select("block", "c", "member")
    sent = around.select("block", F.col("member").alias("node")).distinct().join(low, "node").select(F.col("block").alias("of_block"), "node", "low", "vec")
    found = around.groupBy("block").cogroup(sent.groupBy("of_block")).applyInPandas(_local_joins(k, threshold), EDGE)
    return _nearest(lists.withColumn("tie", F.lit(False)).unionByName(found), k)


def _nearest(edges: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """The k nearest of each node, and all ties."""
    edges = edges.groupBy("u", "v", "tie").agg(F.max("sim").alias("sim"))
    order = Window.partitionBy("u", "tie").orderBy(F.desc("sim"), "v")
    both = cut_lineage(edges.withColumn("r", F.row_number().over(order)).where(F.col("tie") | (F.col("r") <= k)).select("u", "v", "sim", "tie"))
    return both.where("NOT tie").select("u", "v", "sim"), both.where("tie").select("u", "v")


def _components(ties: list[DataFrame]) -> DataFrame:
    return cut_lineage(components(reduce(DataFrame.unionByName, ties).select(F.col("u").alias("a"), F.col("v").alias("b"))))


def _as_ties(groups: DataFrame) -> DataFrame:
    """What is connected so far: later ties are added to it, and the earlier ones are not read again."""
    return groups.select(F.col("node").alias("u"), F.col("component").alias("v"))


def _links(groups: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """(node, links): exact inside each group."""
    members = groups.join(nodes.select("node", "n", "vec"), "node")
    parts = members.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    tiles = (members.join(parts, "component").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
             .select("component", F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y"),
                     (F.col("part") > F.col("other")).cast("int").alias("side"), "node", "n", "vec"))
    links = (tiles.groupBy("component", "x", "y").applyInPandas(_count_links(threshold), "node long, links long")
             .groupBy("node").agg(F.sum("links").alias("links")))
    return cut_lineage(links)


def _audit(labels: DataFrame, nodes: DataFrame, groups: DataFrame, threshold: float) -> tuple[DataFrame, list[DataFrame]]:
    """labels: (label, size). -> those whose recall falls short, and the ties met.

    Recall of a label: the least of two shares over its query nodes, of all their links, and of the nodes with links, those whose links lie all within
    their component. A label with fewer than LINKED such nodes counts as not measured, and more nodes are taken; one whose nodes were all taken is exact."""
    place = F.pmod(F.xxhash64("node", F.lit(3)), F.lit(1 << 30)) / F.lit(float(1 << 30)) * F.col("size")
    open_labels, taken, wanted, met, short = labels, 0, AUDITED, [], []
    while True:
        found = _with_all(nodes.join(open_labels, "label").where((place >= taken) & (place < wanted)), nodes, groups, threshold)
        met.append(found)
        each = reduce(DataFrame.unionByName, met).where("u = v").groupBy("label", "u").agg(F.sum("links").alias("links"), F.sum("met").alias("met"))
        seen = each.groupBy("label").agg(F.count("*").alias("seen"), F.least(F.sum("met") / F.sum("links"), F.avg((F.col("met") >= F.col("links")).cast("double"))).alias("recall"))
        judged = cut_lineage(open_labels.join(seen, "label", "left").select("label", "size", F.coalesce("seen", F.lit(0)).alias("seen"), "recall"))
        exact, measured = F.col("size") <= wanted, F.col("seen") >= LINKED
        short.append(judged.where(~exact & measured & (F.col("recall") < WANTED_RECALL)).select("label", "size"))
        told = judged.agg(F.count_if(exact).alias("exact"), F.count_if(~exact & measured).alias("measured"), F.count_if(~exact & ~measured).alias("open"), F.min(F.when(measured | exact, F.col("recall"))).alias("recall")).first()
        _log.info("audit of %s nodes a label: %s labels compared whole, %s measured, %s open; least recall %s", wanted, told["exact"], told["measured"], told["open"], told["recall"])
        if not told["open"]:
            break
        open_labels, taken, wanted = judged.where(~exact & ~measured).select("label", "size"), wanted, 4 * wanted
    return reduce(DataFrame.unionByName, short), [m.where("u <> v").select("u", "v") for m in met]


def near_duplicates(table: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """-> (vec_id, n_links, component_id, kept): links by cosine >= threshold in double precision between rows of one label.

    Null labels and vectors that are null, empty, zero or hold null or non-finite parts link with nothing; so do vectors of different lengths. Equal
    vectors of a label link with each other. Null ids take part in links, but name no component unless it has no other id (then null). Repeated
    rows are rows of their own; other columns are ignored; an empty table gives no rows.
    """
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(F.col(vector_col).cast("array<double>"), lambda v: v + F.lit(0.0)).alias("vec"), F.col(label_col).alias("label"))
    fine = (F.col("label").isNotNull() & F.col("vec").isNotNull() & (F.size("vec") > 0)
            & F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("vec", lambda v: v != 0))
    # scaled by the largest part: squares of huge or tiny parts stay finite
    scaled = F.transform("vec", lambda v: v / F.array_max(F.transform("vec", F.abs)))
    rows = rows.withColumn("fine", F.coalesce(fine, F.lit(False)))
    good = rows.where("fine").withColumn("key", F.xxhash64("label", "vec")).withColumn("kind", F.xxhash64("label", F.size("vec")))
    nodes = good.groupBy("key").agg(F.count("*").alias("n"), F.min("vec_id").alias("least_id"), F.first("kind").alias("label"), F.first(scaled).alias("vec"))
    sizes = cut_lineage(nodes.groupBy("label").agg(F.count("*").alias("size"), F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")))
    nodes = cut_lineage(nodes.join(sizes, "label").select(
        F.col("key").alias("node"), "n", "least_id", "label", "vec", F.xxhash64("label", F.pmod(F.xxhash64("key", F.lit(1)), F.col("blocks"))).alias("block")))

    k, rounds = NEIGHBOURS, ROUNDS
    # the first lists: the nearest within several random partitions, so that no part of a dense group stays shut off from the rest
    mixed = nodes.join(sizes, "label").select("node", "vec", F.explode(F.sequence(F.lit(1), F.lit(STARTS))).alias("start"), "label", "blocks")
    mixed = mixed.withColumn("mix", F.xxhash64("label", "start", F.pmod(F.xxhash64("node", "start"), F.col("blocks"))))
    lists, tied = _nearest(mixed.select("mix", "node", "vec").groupBy("mix").applyInPandas(_first_lists(k, threshold), EDGE), k)
    ties, settled = [tied], []
    short = sizes.where("blocks > 1").select("label", "size")  # a label of one block has been compared whole
    for _ in range(1 + MORE_ROUNDS):
        if short.isEmpty():
            break
        moving = nodes.join(short, "label", "left_semi")
        lists = lists.join(moving.select(F.col("node").alias("u")), "u", "left_semi")
        for _ in range(rounds):
            better, tied = _improve(lists, moving, k, threshold)
            places, kept = better.join(lists.select("u", "v", F.lit(True).alias("old")), ["u", "v"], "left").agg(F.count("*"), F.count("old")).first()
            lists = better
            ties.append(tied)
            if places - kept <= STILL * places:
                break
        groups = _components(ties)
        ties = [_as_ties(groups)]
        saturated = lists.groupBy("u").agg(F.count("*").alias("filled"), F.min("sim").alias("last")).where((F.col("filled") >= k) & (F.col("last") >= threshold)).select(F.col("u").alias("node"))
        for before in settled:
            saturated = saturated.join(before, "node", "left_anti")
        saturated = cut_lineage(saturated)
        settled.append(saturated)
        if not saturated.isEmpty():
            ties.append(_with_all(saturated, nodes, groups, threshold).where("u <> v").select("u", "v"))
            groups = _components(ties)
            ties = [_as_ties(groups)]
        short, met = _audit(short, nodes, groups, threshold)
        ties += met
        k, rounds = 2 * k, 2  # longer lists
    if not short.isEmpty():
        ties.append(_with_all(nodes.join(short, "label", "left_semi"), nodes, groups, threshold).where("u <> v").select("u", "v"))
    groups = _components(ties)
    links = _links(groups, nodes, threshold)

    named = (nodes.select("node", "n", "least_id").join(groups, "node", "left").join(links, "node", "left")
             .select("node", "n", "least_id", F.coalesce("component", "node").alias("component"), F.coalesce("links", F.lit(0)).alias("links")))
    least = named.groupBy("component").agg(F.min("least_id").alias("component_id"))
    final = named.join(least, "component").select(F.col("node").alias("key"), (F.col("links") + F.col("n") - 1).alias("n_links"), "component_id")
    linked = good.select("vec_id", "key").join(final, "key").select("vec_id", "n_links", "component_id")
    alone = rows.where("NOT fine").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
