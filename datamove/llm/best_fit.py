"""Best-fit packing whose number of sequences is certified by lower bounds.

Documents are tokenised once; pieces of the full length are sequences of their own, all others are packed by length alone, so only a few numbers
a piece are shuffled. They are dealt into groups of bounded size and each group is packed best-fit decreasing. Dual-feasible functions give a
lower bound of the group's number of sequences: a group that meets it is certified. Groups with a gap give up all sequences that are not full, certified
ones only the emptiest (their rounding loss); these documents are exchanged, that is dealt anew into groups, and packed again, while that saves
sequences and the bound of the whole table is not met. A round that saves nothing is discarded.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from datamove.llm.packing import encoder
from datamove.llm.written import written

LONGEST = 1024
GROUP_PIECES = 8192  # pieces of a group, on average
MOST_ROUNDS, REFINED = 12, 64
FLUSH_PIECES = 1 << 16
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, tag long"
PLACED = f"{PIECES}, sequence_id long, offset long, released boolean, sequences long, bound long"


@cache
def dual_feasible(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of weights by length 0 to `size`, and the weight of a full sequence: lengths that fit into one sequence never weigh more than that."""
    x = np.arange(size + 1, dtype=np.int64)
    rows = [np.where(x > size - t, size, np.where(x >= t, x, 0)) for t in range(size // 2 + 1)]  # short lengths lose their weight to long ones
    rows += [np.where((k + 1) * x % size == 0, k * x, (k + 1) * x // size * size) for k in range(1, REFINED)]  # rounded to k-ths
    for t in range(2, size // 2 + 1):  # multiples of t, counted twice; long lengths take what the rest cannot use
        rows.append(np.where(2 * x > size, 2 * (size // t - (size - x) // t), np.where(2 * x == size, size // t, 2 * (x // t))))
    table = np.stack(rows)
    return table, table[:, size].copy()


def fewest(lengths_of: np.ndarray, size: int = LONGEST) -> int:
    """No packing of so many pieces of each length 0 to `size` has fewer sequences."""
    table, full = dual_feasible(size)
    return int((-(-(table @ lengths_of) // full)).max()) if lengths_of.any() else 0


def best_fit_decreasing(lengths: np.ndarray, size: int = LONGEST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths in falling order -> sequence and offset of each, and the room left in each sequence."""
    at, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    by_room, rooms, left = defaultdict(list), 0, []  # `rooms` has a bit for each room that some sequence has
    for i, length in enumerate(lengths.tolist()):
        fitting = rooms >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            number = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, number = size, len(left)
            left.append(size)
        at[i], offsets[i], left[number] = number, size - room, room - length
        if room > length:
            by_room[room - length].append(number)
            rooms |= 1 << (room - length)
    return at, offsets, np.array(left, np.int64)


def given_up(left: np.ndarray, bound: int) -> np.ndarray:
    """Which sequences a group gives up for the exchange."""
    if len(left) > bound:
        return left > 0
    return (left > 0) & (np.arange(len(left)) == left.argmax())


def _pieces(path: str, end_id: int):
    def run(batches):
        encode, tag = encoder(path).encode, TaskContext.get().partitionId() << 33
        tail = np.array([end_id], "<u4").tobytes()
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "tag"]
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        rows: list[tuple] = []

        def flush():
            columns = zip(*rows, strict=True) if rows else [[] for _ in names]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = memoryview(encode(text.as_py() or "") + tail)
                n = len(ids) // 4
                start = 0
                end = n % LONGEST or LONGEST
                piece = 0
                while start < n:
                    rows.append((doc_id, piece, start, end - start, zlib.crc32(ids[4 * start : 4 * end]), tag))
                    piece, tag, start, end = piece + 1, tag + 1, end, end + LONGEST
                if len(rows) >= FLUSH_PIECES:
                    yield flush()
                    rows.clear()
        yield flush()
    return run


def _pack(number: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        lengths, tags = table["length"].to_numpy(), table["tag"].to_numpy()
        order = np.lexsort((tags, -lengths))
        at, offsets, left = best_fit_decreasing(lengths[order])
        bound = fewest(np.bincount(lengths, minlength=LONGEST + 1))
        once = np.zeros(len(lengths), np.int64)
        once[0] = 1
        first = (number << 58) | (key[0].as_py() << 24)
        columns = {"sequence_id": first + at, "offset": offsets, "released": given_up(left, bound)[at], "sequences": once * len(left), "bound": once * bound}
        table = table.drop_columns(["grp"]).take(pa.array(order))
        for name, values in columns.items():
            table = table.append_column(name, pa.array(values))
        return table
    return run


def _dealt(pieces: DataFrame, n: int, number: int) -> DataFrame:
    """Packs n pieces in groups; `tag` differs for every piece, so equal documents spread too."""
    groups = -(-n // GROUP_PIECES)
    dealt = pieces.withColumn("grp", F.pmod(F.xxhash64("tag", F.lit(number)), F.lit(groups)).cast("long"))
    return written(dealt.groupBy("grp").applyInArrow(_pack(number), PLACED), f"best-fit-{number}")


def _tally(placed: DataFrame) -> tuple[int, int, int]:
    """Sequences, released sequences, released pieces."""
    made, given, n = placed.agg(F.sum("sequences"), F.sum((F.col("released") & (F.col("offset") == 0)).cast("long")), F.sum(F.col("released").cast("long"))).first()
    return made or 0, given or 0, n or 0


def pack_best_fit(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2) -> DataFrame:
    """-> one row per piece: its document, number, place there, CRC-32 of its ids, sequence and offset there; `fewest_sequences` is a lower bound of the
    number of sequences of any packing of the table.

    A document of more than 1024 tokens, with `end_id`, is cut into pieces of 1024, of which the first may be shorter; no other is cut. A null or empty
    text is the end id alone; a null id is kept; repeated rows are packed each; an empty table gives no rows. Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    pieces = written(rows.mapInArrow(_pieces(tokenizer_path, end_id), PIECES), "best-fit-pieces")
    whole = pieces.where(F.col("length") == LONGEST).withColumns({"sequence_id": F.col("tag"), "offset": F.lit(0).cast("long")})
    lengths_of = np.zeros(LONGEST + 1, np.int64)
    for length, n in pieces.groupBy("length").count().collect():  # at most 1024 rows
        lengths_of[length] = n
    n_whole, lengths_of[LONGEST] = int(lengths_of[LONGEST]), 0
    n, bound = int(lengths_of.sum()), fewest(lengths_of)

    kept: list[DataFrame] = [whole]
    if n:
        last = _dealt(pieces.where(F.col("length") < LONGEST), n, 1)
        settled, (made, given, n) = 0, _tally(last)  # sequences kept in earlier rounds; of the last one: all, given up, pieces in these
        for number in range(2, MOST_ROUNDS + 2):
            if settled + made <= bound or not n:
                break
            after = _dealt(last.where("released").select(*pieces.columns), n, number)
            made_after, given_after, n_after = _tally(after)
            if made_after >= given:
                break
            kept.append(last.where("NOT released"))
            settled += made - given
            last, made, given, n = after, made_after, given_after, n_after
        kept.append(last)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    placed = reduce(DataFrame.unionByName, [k.select(columns) for k in kept])
    return placed.withColumn("fewest_sequences", F.lit(bound + n_whole).cast("long"))
