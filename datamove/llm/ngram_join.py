"""N-gram Jaccard join: size-banded tiles, hashed bitmap signatures, exact sorted-array intersection.

Sizes are cut into bands. Sets of one band whose similarity reaches the threshold differ in at most k shingles, so when the space of
shingle hashes is cut into more than k parts, both agree wholly in one part. Equal (band, part, content) values therefore hold every
link: no pair is lost and no frequent shingle makes a hot key. Shingles that very many texts share would fill whole parts of unrelated texts, so
parts are made of the other shingles: leaving the same shingles out of two sets never makes them differ in more than k. Which ones are
left out therefore changes the work and not the links. A set with few other shingles takes its parts from all of them; both kinds overlap by
k shingles, so that two linked sets always share one kind. Sets that meet form candidate groups; a group is cut into blocks
of bounded size, and each pair of blocks is one tile. Inside a tile, sets are ordered by size and only sizes within the threshold's band meet.
Tiles are worked on twice. First with hashed bitmaps alone, a few bits a shingle: each bit holds the parity of the shingles hashed to it, so the
bits that differ bound the overlap from above. What the bound leaves connected forms the final groups, and in their tiles, with the whole
texts, sets are intersected exactly. Pairs already connected inside a tile are skipped, and a tile returns at most one link per set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from datamove.llm.graph import components
from datamove.llm.words import as_long, mix, shingle_sets
from datamove.session import cut_lineage

BAND_RATIO = 1.2
SPARE_PARTS, SPARE_SHARE = 2, 0.3  # parts beyond k + 1, at least and as a share of k; so many empty parts are left out of the tiles
FEWEST_OTHERS = 1.6  # a set's parts leave common shingles out while it has this many others for each of the k
COUNTED_SHINGLES = 1 << 21  # common shingles are counted over runs of texts with about so many shingles,
COMMON_IN_RUN, COMMON_TEXTS, MOST_COMMON = 3, 32, 1 << 18  # in this many texts of a run and of all runs; of more than MOST_COMMON the most frequent
FLUSH_ROWS = 1 << 19
BLOCK_SETS, BLOCK_BYTES = 1024, 8 << 20
MOST_BROADCAST = 1 << 21  # ids, 16 MB of longs
BITMAP_BLOCK_SETS, FEWEST_BITS, MOST_BITS = 4096, 256, 1 << 16
_U = np.uint64
_NONE = np.zeros(0, _U)


def linked(common: int, total: int, percent: int) -> bool:
    """total: sum of both sizes."""
    return 100 * common >= percent * (total - common)


def set_key(hashes: np.ndarray) -> np.uint64:
    """Equal sets have equal keys; the empty set has key 0."""
    return mix(np.array([mix(hashes).sum(dtype=_U) ^ _U(len(hashes))], _U))[0] if len(hashes) else _U(0)


def bands(percent: int, largest: int) -> list[tuple[int, int, int, int]]:
    """(first size, size after the last, k, smallest size that may link into the band), up to `largest`."""
    out, low = [], 1
    while low <= largest:
        high = max(low + 1, int(low * BAND_RATIO))
        total = 2 * (high - 1)
        differ = (100 - percent) * total // (100 + percent)
        out.append((low, high, differ, -(-percent * low // 100)))
        low = high
    return out


_bands: dict[int, list] = {}


def _part_keys(hashes: np.ndarray, sums: np.ndarray, differ: int, tag: int) -> np.ndarray:
    """One key for each part; sums: running sums of the mixed hashes. Of two sets that differ in at most `differ`, more parts agree than are spare."""
    spare = max(SPARE_PARTS, int(SPARE_SHARE * differ))
    parts = differ + 1 + spare
    part = ((hashes >> _U(32)) * _U(parts)) >> _U(32)
    at = np.searchsorted(part, np.arange(parts + 1, dtype=_U))
    content, filled = sums[at[1:]] - sums[at[:-1]], at[1:] > at[:-1]
    keys = mix(content + mix(np.arange(parts, dtype=_U) + _U(tag << 32)))
    return keys[filled] if parts - filled.sum() <= spare else keys


def tile_keys(hashes: np.ndarray, percent: int, common: np.ndarray = _NONE) -> np.ndarray:
    """The tile signatures of one sorted set: one for each part of each band in which it may have a partner. common: sorted shingles to leave out."""
    size, out = len(hashes), []
    table = _bands.get(percent)
    if table is None or table[-1][1] <= 2 * size + 2:
        table = _bands[percent] = bands(percent, max(1 << 16, 4 * size + 4))
    at = np.searchsorted(common, hashes)
    others = hashes if not len(common) else hashes[common[np.minimum(at, len(common) - 1)] != hashes]
    sums = [np.concatenate([np.zeros(1, _U), np.cumsum(mix(x ^ _U(0x5851F42D4C957F2D)))]) for x in (others, hashes)]
    for number, (low, high, differ, least) in enumerate(table):
        if least > size:
            break
        if size >= high or not differ:  # only equal sets link, and these share a key
            continue
        if len(others) >= FEWEST_OTHERS * differ:
            out.append(_part_keys(others, sums[0], differ, 2 * number))
        if len(others) < FEWEST_OTHERS * differ + differ:
            out.append(_part_keys(hashes, sums[1], differ, 2 * number + 1))
    return np.concatenate(out) if out else _NONE


def _stars(sig: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of rows sorted by (sig, key): the first of each sig, and (first, other) pairs for the rest."""
    new = np.ones(len(sig), bool)
    new[1:] = sig[1:] != sig[:-1]
    leader = key[new][np.cumsum(new) - 1]
    other = key != leader
    return sig[new], key[new], leader[other], key[other]


def bitmap(hashes: np.ndarray) -> bytes:
    """Parity bits: at least two for each shingle, up to MOST_BITS. The bits of a shorter bitmap are those of a longer one, folded."""
    bits = FEWEST_BITS
    while bits < min(2 * len(hashes), MOST_BITS):
        bits *= 2
    at = ((hashes >> _U(7)) & _U(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def shared_by(sets: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that at least `least` of the sets hold, sorted, and how many do. Empties `sets`: the run is held once, and sorted where it lies."""
    run = np.concatenate(sets)
    sets.clear()
    run.sort()
    found = run[least - 1 :][run[least - 1 :] == run[: len(run) - least + 1]]
    found = found[np.diff(found, prepend=~found[:1]) != 0]
    return found, np.searchsorted(run, found, side="right") - np.searchsorted(run, found)


def _sizes(width: int):
    """A row for each text, and rows (key, texts) for shingles that many different texts of a run share."""
    def shared(sets: list[np.ndarray]) -> pa.RecordBatch:
        found, texts = shared_by(sets, COMMON_IN_RUN)
        nothing = [pa.nulls(len(found), pa.int64())] * 4
        return pa.RecordBatch.from_arrays([*nothing, as_long(found), pa.nulls(len(found), pa.binary()), pa.array(texts, pa.int64())], names)

    names = ["doc_id", "text_hash", "n_bytes", "n_shingles", "key", "bitmap", "texts"]

    def run(batches):
        held, seen, n_held = [], set(), 0
        for b in batches:
            sizes, keys, maps = [], [], []
            for s in shingle_sets(b.column("text"), width):
                key = set_key(s)
                sizes.append(len(s))
                keys.append(key)
                maps.append(bitmap(s))
                if len(s) and int(key) not in seen:
                    seen.add(int(key))
                    held.append(s)
                    n_held += len(s)
                    if n_held >= COUNTED_SHINGLES:
                        yield shared(held)
                        held, seen, n_held = [], set(), 0
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names[:3]], pa.array(sizes, pa.int64()), as_long(np.array(keys, _U)),
                                              pa.array(maps, pa.binary()), pa.nulls(len(sizes), pa.int64())], names)
        if held:
            yield shared(held)
    return run


def _common(shared: DataFrame) -> np.ndarray:
    """The shingles found in most texts, sorted; at most MOST_COMMON."""
    totals = shared.groupBy("key").agg(F.sum("texts").alias("texts"))
    least = COMMON_TEXTS
    while totals.where(F.col("texts") >= least).count() > MOST_COMMON:
        least *= 2
    return np.sort(totals.where(F.col("texts") >= least).select("key").toArrow()["key"].to_numpy().view(_U))


def _signatures(width: int, percent: int, common: np.ndarray):
    """(sig, key) rows. Sets of one task that share a signature are joined here: one of them goes on, and each other one gets a signature
    of its own with that one, so a group of any size sends a few rows per task and tile."""
    def flush(sigs, keys):
        sig = np.concatenate(sigs)
        key = np.repeat(np.array(keys, _U), [len(s) for s in sigs])
        order = np.lexsort((key, sig))
        sig, key, a, b = _stars(sig[order], key[order])
        pairs = np.unique(np.stack([a, b], 1), axis=0) if len(a) else np.zeros((0, 2), _U)
        tie = mix(pairs[:, 0] + mix(pairs[:, 1]))
        return pa.RecordBatch.from_arrays(
            [as_long(np.concatenate([sig, tie, tie])), as_long(np.concatenate([key, pairs[:, 0], pairs[:, 1]]))], ["sig", "key"])

    def run(batches):
        sigs, keys, seen, rows = [], [], set(), 0
        for b in batches:
            for s in shingle_sets(b.column("text"), width):
                key = int(set_key(s))
                if key in seen or not len(s):
                    continue
                seen.add(key)
                sigs.append(tile_keys(s, percent, common))
                keys.append(key)
                rows += len(sigs[-1])
                if rows >= FLUSH_ROWS:
                    yield flush(sigs, keys)
                    sigs, keys, seen, rows = [], [], set(), 0
        if sigs:
            yield flush(sigs, keys)
    return run


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(sig, key) sorted by both -> (a, b): each key with the first of its signature. Holds one batch and one carried row."""
    sig0, key0 = None, None
    for b in batches:
        sig, key = (b.column(c).to_numpy().astype(np.int64) for c in ("sig", "key"))
        if sig0 is not None:
            sig, key = np.concatenate([[sig0], sig]), np.concatenate([[key0], key])
        if not len(sig):
            continue
        first_sig, first_key, a, c = _stars(sig, key)
        sig0, key0 = first_sig[-1], first_key[-1]
        pairs = np.unique(np.stack([a, c], 1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])


class Bitmaps:
    """Bitmaps ordered by set size, so by length too; a range is compared at the length of the first, shortest one."""

    def __init__(self, maps: list[bytes]):
        words = np.array([len(m) // 8 for m in maps])
        self.starts = np.flatnonzero(np.diff(words, prepend=0))
        self.blocks = [np.frombuffer(b"".join(maps[a:b]), "<u8").reshape(b - a, -1) for a, b in zip(self.starts, [*self.starts[1:], len(maps)], strict=True)]
        self.folded: dict[tuple[int, int], np.ndarray] = {}

    def at_length(self, block: int, words: int) -> np.ndarray:
        own = self.blocks[block]
        if own.shape[1] == words:
            return own
        if (block, words) not in self.folded:
            self.folded[block, words] = np.bitwise_xor.reduce(own.reshape(len(own), -1, words), axis=1)
        return self.folded[block, words]

    def differ(self, i: int, end: int) -> np.ndarray:
        """Number of differing bits between bitmap i and each of i + 1 to end - 1."""
        home = int(np.searchsorted(self.starts, i, side="right")) - 1
        one = self.blocks[home][i - self.starts[home]]
        out = []
        for block in range(home, len(self.starts)):
            first = self.starts[block]
            if first >= end:
                break
            rows = self.at_length(block, len(one))[max(0, i + 1 - first) : end - first]
            out.append(np.bitwise_count(rows ^ one).sum(axis=1, dtype=np.int64))
        return np.concatenate(out)


def tile_links(sizes: np.ndarray, maps: list[bytes], side: np.ndarray, percent: int, exact=None) -> list[tuple[int, int]]:
    """Links (positions) that connect the sets of one tile as all its links would. side: 0 or 1 for the two blocks, of which only
    pairs across are compared; all 0 in a tile of one block. exact(i, j): size of the overlap; without it the bound decides."""
    order = np.argsort(sizes, kind="stable")
    sizes, side = sizes[order], side[order]
    one_block = not side.any()
    bits = Bitmaps([maps[i] for i in order])
    label = np.arange(len(order))
    out = []
    for i in range(len(order)):
        # larger partners of i: 100 * n_i >= percent * n_j
        end = int(np.searchsorted(sizes, 100 * sizes[i] // percent, side="right"))
        if end <= i + 1 or sizes[i] == 0:
            continue
        total = sizes[i] + sizes[i + 1 : end]
        bound = (total - bits.differ(i, end)) // 2  # of the overlap, from above
        fits = (100 * bound >= percent * (total - bound)) & (label[i + 1 : end] != label[i])
        if not one_block:
            fits &= side[i + 1 : end] != side[i]
        for j in np.flatnonzero(fits) + i + 1:
            if label[j] != label[i] and (exact is None or linked(exact(order[i], order[j]), int(sizes[i] + sizes[j]), percent)):
                label[label == label[j]] = label[i]
                out.append((order[i], order[j]))
    return out


def _sides(block: np.ndarray) -> np.ndarray:
    return (block != block.min()).astype(int) if len(block) else np.zeros(0, int)


def _edge_table(keys: np.ndarray, links: list[tuple[int, int]]) -> pa.Table:
    return pa.table({"a": pa.array([keys[i] for i, _ in links], pa.int64()), "b": pa.array([keys[j] for _, j in links], pa.int64())})


def _bound(percent: int):
    def run(table: pa.Table) -> pa.Table:
        keys = table.column("key").to_numpy()
        links = tile_links(table.column("n").to_numpy(), table.column("bitmap").to_pylist(), _sides(table.column("block").to_numpy()), percent)
        return _edge_table(keys, links)
    return run


def _compare(width: int, percent: int):
    def run(table: pa.Table) -> pa.Table:
        sets = list(shingle_sets(table.column("text").combine_chunks(), width))
        own = np.array([set_key(s) for s in sets], _U).view(np.int64)
        expected, block = table.column("key").to_numpy(), table.column("block").to_numpy()
        keep = np.flatnonzero(own == expected)  # a repeated doc_id may bring another text along
        keep = keep[np.unique(own[keep], return_index=True)[1]]
        sets, own = [sets[i] for i in keep], own[keep]
        links = tile_links(np.array([len(x) for x in sets], np.int64), [bitmap(x) for x in sets], _sides(block[keep]), percent,
                           lambda i, j: len(np.intersect1d(sets[i], sets[j], assume_unique=True)))
        return _edge_table(own, links)
    return run


def _tiles(sets: DataFrame, groups: DataFrame, most_sets: int, size: Column) -> DataFrame:
    """Sets with their groups, once for each tile (grp, x, y) they are in; a block has about most_sets sets and BLOCK_BYTES bytes of `size`."""
    placed = sets.join(groups.select(F.col("node").alias("key"), F.col("component").alias("grp")), "key")
    blocks = placed.groupBy("grp").agg(F.greatest(F.ceil(F.count("*") / most_sets), F.ceil(F.sum(size) / BLOCK_BYTES)).cast("int").alias("n_blocks"))
    return (placed.join(blocks, "grp").withColumn("block", F.pmod(F.xxhash64("key"), F.col("n_blocks")).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
            .withColumns({"x": F.least("block", "other"), "y": F.greatest("block", "other")}))


def linked_rows(docs: DataFrame, width: int, percent: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """-> (doc_id, text_hash, n_shingles, component, component_id): a row for each of docs. component: the same for all rows whose texts are
    connected by links, null for empty sets; component_id: the smallest id among these rows, null ids aside, or the own id where component is null.

    Texts are known by the key of their set alone, so ids may be null or repeat. A set's text is fetched by the id and hash of one of its rows."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"))
    sized = docs.select("doc_id", "text_hash", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    read = cut_lineage(sized.mapInArrow(
        _sizes(width), "doc_id long, text_hash long, n_bytes long, n_shingles long, key long, bitmap binary, texts long"))
    sizes = read.where("texts IS NULL").drop("texts")
    common = _common(read.where("texts IS NOT NULL").select("key", "texts"))
    sig = docs.select("text").mapInArrow(_signatures(width, percent, common), "sig long, key long")
    met = sig.repartition("sig").sortWithinPartitions("sig", "key").mapInArrow(_meet, "a long, b long")

    # one row for each different set
    sets = sizes.where("n_shingles > 0").groupBy("key").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash", "n_bytes")).alias("row"), F.first("n_shingles").alias("n"),
        F.first("bitmap").alias("bitmap")).select("key", "row.doc_id", "row.text_hash", "row.n_bytes", "n", "bitmap")
    tiles = _tiles(sets, components(met), BITMAP_BLOCK_SETS, F.octet_length("bitmap"))
    # dealt by tile: the blocks were counted by group, and that partitioning would leave all tiles of a large group in one task
    dealt = tiles.select("grp", "x", "y", "key", "n", "bitmap", "block").repartition("grp", "x", "y")
    near = dealt.groupBy("grp", "x", "y").applyInArrow(_bound(percent), "a long, b long")
    tiles = cut_lineage(_tiles(sets.drop("bitmap"), components(near), BLOCK_SETS, F.greatest("n_bytes", F.col("n") * 8))
                        .select("key", "doc_id", "text_hash", "grp", "x", "y", "block"))
    needed = tiles.select("key", "doc_id", "text_hash").distinct().withColumnsRenamed({"doc_id": "of_id", "text_hash": "of_hash"})
    if needed.count() <= MOST_BROADCAST:  # other texts are dropped before the shuffle; beyond it, the join below drops them
        needed = F.broadcast(needed)
    # rows that repeat the fetched one, which ids that are null or not unique allow, are merged before they are shuffled
    texts = docs.join(needed, docs["doc_id"].eqNullSafe(needed["of_id"]) & (docs["text_hash"] == needed["of_hash"])).groupBy("key").agg(F.first("text").alias("text"))
    placed = tiles.join(texts, "key").select("grp", "x", "y", "key", "block", "text")
    links = placed.groupBy("grp", "x", "y").applyInArrow(_compare(width, percent), "a long, b long")
    found = components(links)

    ids = sizes.where("n_shingles > 0").groupBy("key").agg(F.min("doc_id").alias("least_id"))
    named = ids.join(found.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    lowest = named.groupBy("component").agg(F.min("least_id").alias("component_id"))
    by_key = named.join(lowest, "component").select(F.col("key").alias("set_key"), "component", "component_id")
    rows = sizes.select("doc_id", "text_hash", "n_shingles", "key")
    columns = ["doc_id", "text_hash", "n_shingles", "component", "component_id"]
    full = rows.where("n_shingles > 0").join(by_key, F.col("key") == F.col("set_key"), "left").select(columns)
    return full.unionByName(rows.where("n_shingles = 0").withColumns({"component": F.lit(None).cast("long"), "component_id": F.col("doc_id")}).select(columns))


def ngram_groups(docs: DataFrame, width: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """-> (doc_id, n_shingles, component_id): size of each text's shingle set and the smallest id reachable by links.

    Two texts link when 100 * |A and B| >= percent * |A or B| for their sets of `width`-word shingles. Nulls and texts without words have an
    empty set and link with nothing. A null id takes part by its text, links others as any row does, and is never a component_id unless the whole component
    has none (then null). Repeated rows give repeated rows; an id may repeat with other texts. Other columns are ignored; an empty table gives no rows.
    """
    return linked_rows(docs, width, percent, id_col, text_col).select("doc_id", "n_shingles", "component_id")


def drop_linked(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without all but one document of each linked group: the one with the smallest id (null ids last, then by text hash) stays.

    A document is an id and its text, so rows that repeat the kept document stay too; texts without words all stay. Only ids and hashes of the rest are
    brought to the texts: as a broadcast while their number is bounded, beyond that by a join that shuffles the texts once."""
    document = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    rows = linked_rows(docs, width, percent, id_col, text_col).where("component IS NOT NULL").select("component", document.alias("document"))
    first = rows.groupBy("component").agg(F.min("document").alias("kept"))
    dropped = cut_lineage(rows.join(first, "component").where("document <> kept")
                          .select(F.col("document.doc_id").alias("_drop_id"), F.col("document.text_hash").alias("_drop_hash")).distinct())
    if dropped.count() <= MOST_BROADCAST:
        dropped = F.broadcast(dropped)
    return docs.join(dropped, docs[id_col].cast("long").eqNullSafe(dropped["_drop_id"]) & (F.xxhash64(docs[text_col]) == dropped["_drop_hash"]), "left_anti")
