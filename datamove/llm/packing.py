"""Hierarchical multi-length packing of tokenised documents.

Documents are routed by length to context tiers (1024, 512, ... tokens). Whole windows of a long document are a sequence each; its rest
and every shorter document wait in the tier that is the smallest window to hold it. The tiers are packed from the longest down: a piece opens a window of its
tier, and the gap behind it is filled from the shorter tiers, longest piece that fits first, the last one cut so that the window is
exactly full. What cannot be filled at the end of a batch of documents waits for the next one; only a task's last windows can be short.
Windows of one tier form step groups of equal token numbers, but for the last group of every tier in every task, which may be short. No shuffle: a task packs its own partition, and its memory is one batch.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

LONGEST, TIERS = 1024, (1024, 512, 256, 128, 64)
STEP_TOKENS = 1 << 16
CACHE_WORDS, LONGEST_CACHED = 250_000, 32
LATIN_END = "\u0250"
SLICE_CHARS = 1 << 22
SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
          "tier int, step_group long")
_BREAK = re.compile(r" (?=\S)")
_ODD = re.compile(r" (?:\s|$)")


class WordIds(dict):
    """' word' -> its ids as little-endian bytes, for a byte-level BPE whose pre-tokens never span a space followed by text.

    Words not met before and within Latin script go to a second encoder made of the same vocabulary, which is several times faster on single words; all
    else goes to the tokenizers library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # a byte-level vocabulary writes printable bytes as themselves, the others, in order, from code point 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        as_byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
        ranks = {bytes(as_byte[c] for c in t): i for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if t not in self.special}
        self.fast = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        short = " " + word
        found = array("I", self.fast(short)).tobytes() if len(word) <= LONGEST_CACHED and max(short) < LATIN_END else self.ids(short)
        if len(word) <= LONGEST_CACHED:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = found
        return found

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self.special):  # the text around a special token is cut there first
            return self.ids(text)
        first, *rest = _BREAK.split(text) if _ODD.search(text) else text.split(" ")
        return (self.ids(first) if first else b"") + b"".join(map(self.__getitem__, rest))


_encoders: dict[str, WordIds] = {}


def encoder(path: str) -> WordIds:
    """One per worker process."""
    if path not in _encoders:
        _encoders[path] = WordIds(path)
    return _encoders[path]


class Packer:
    """Packs pieces (document, start, length) into windows; `windows` holds those that are closed."""

    def __init__(self):
        self.waiting = {c: deque() for c in TIERS}
        self.windows: list[tuple[int, list[tuple[int, int, int]]]] = []

    def tier(self, length: int) -> int:
        return next(c for c in reversed(TIERS) if length <= c)

    def put(self, doc: int, start: int, length: int) -> None:
        if length:
            self.waiting[self.tier(length)].append((doc, start, length))

    def add(self, doc: int, length: int) -> None:
        whole = length // LONGEST * LONGEST
        for start in range(0, whole, LONGEST):
            self.windows.append((LONGEST, [(doc, start, LONGEST)]))
        self.put(doc, whole, length - whole)

    def _filler(self, gap: int, below: int) -> tuple[int, int, int] | None:
        """A piece of a shorter tier: of the longest tier that fits into the gap, else the shortest there is (to be cut)."""
        shorter = [c for c in TIERS if c < below and self.waiting[c]]
        for c in shorter:
            if c <= gap:
                return self.waiting[c].popleft()
        return self.waiting[shorter[-1]].popleft() if shorter else None

    def pack(self) -> None:
        """Closes every window that can be made full."""
        for size in TIERS:
            queue = self.waiting[size]
            while queue:
                piece = queue.popleft()
                window, room = [piece], size - piece[2]
                while room:
                    more = self._filler(room, size)
                    if more is None and queue and size > TIERS[-1]:  # no shorter tier is left: cut one of the same
                        more = queue.popleft()
                    if more is None:
                        break
                    doc, start, length = more
                    window.append((doc, start, min(length, room)))
                    if length > room:
                        self.put(doc, start + room, length - room)
                    room -= min(length, room)
                if room:  # cannot be filled now: its pieces wait
                    for p in reversed(window):
                        self.waiting[self.tier(p[2])].appendleft(p)
                    break
                self.windows.append((size, window))

    def rest(self) -> None:
        """At the end: what still waits, one after the other, in windows of the longest tier."""
        window, room = [], LONGEST
        for size in TIERS:
            for doc, start, length in self.waiting[size]:
                while length:
                    part = min(length, room)
                    window.append((doc, start, part))
                    start, length, room = start + part, length - part, room - part
                    if not room:
                        self.windows.append((LONGEST, window))
                        window, room = [], LONGEST
            self.waiting[size].clear()
        if window:
            self.windows.append((LONGEST, window))


def _pack(encode: Callable[[], Callable[[str], bytes]], end_id: int) -> Callable[[Iterator], Iterator]:
    def run(batches):
        to_ids, part = encode(), TaskContext.get().partitionId()
        packer, made, groups = Packer(), 0, {c: 0 for c in TIERS}
        ids: dict[int, np.ndarray] = {}
        names: dict[int, int | None] = {}
        number = 0
        tail = np.array([end_id], "<u4").tobytes()

        def closed():
            nonlocal made
            cols = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group")}
            for size, window in packer.windows:
                at, sequence = 0, (part << 40) | made
                step = (part << 40) | (TIERS.index(size) << 36) | (groups[size] // (STEP_TOKENS // size))
                groups[size] += 1
                made += 1
                for doc, start, length in window:
                    own = ids[doc]
                    for k, v in zip(cols, (names[doc], start, length, zlib.crc32(own[4 * start : 4 * (start + length)]), len(own) // 4, sequence,
                                           at, size, step), strict=True):
                        cols[k].append(v)
                    at += length
            packer.windows.clear()
            types = {"tier": pa.int32()}
            return pa.RecordBatch.from_arrays([pa.array(v, types.get(k, pa.int64())) for k, v in cols.items()], list(cols))

        def forget():
            kept = {p[0] for q in packer.waiting.values() for p in q}
            for doc in [d for d in ids if d not in kept]:
                del ids[doc], names[doc]

        held = 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                text = text.as_py() or ""
                own = memoryview(to_ids(text) + tail)
                ids[number], names[number] = own, doc_id
                packer.add(number, len(own) // 4)
                number += 1
                held += len(text)
                if held >= SLICE_CHARS:
                    packer.pack()
                    yield closed()
                    forget()
                    held = 0
        packer.pack()
        packer.rest()
        yield closed()
    return run


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> DataFrame:
    """-> one row per piece of a document: its place in the document (start, length), the CRC-32 of its ids, the document's number of ids with
    `end_id`, its sequence and the offset there, the sequence's tier and step group.

    A null or empty text is the end id alone; a null id is kept; repeated rows are packed each. An empty table gives no rows. Other
    columns are ignored. Sequence and step-group numbers start with the number of the task that packed them, step-group numbers go on with the tier.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_pack(lambda: encoder(tokenizer_path).encode, end_id), SCHEMA)
