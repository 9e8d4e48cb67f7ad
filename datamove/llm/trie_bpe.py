"""BPE encoding by prefix-sharing trie traversal, and decoding.

For every prefix of a word there is one last token of its encoding, and the encoding is that token after the encoding of the rest. So the
distinct words of a batch are walked as a trie, depth first: each node keeps the last token of its prefix, found from the states of its
ancestors, and words that share a prefix share its states. Sorted words are the depth-first order of their trie; the stack of states is the path.
A token fits behind another one when the two together encode as just these two, which their own merges tell: both are taken apart again, the later merge first, and
no merge across the boundary may come before one that was undone. Tokens that end at a place are found from their last symbol backwards. A word's last symbol
carries the word-end mark and is a child node of its own. Words encoded before are kept, so only new ones are walked.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from itertools import accumulate, islice
from unicodedata import is_normalized

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

CACHE_CHUNKS, CACHE_WORDS, CACHE_PAIRS, LONGEST_CACHED = 400_000, 400_000, 200_000, 32
_TOKEN = ""  # key of a backward node that is a whole token; symbols are never empty
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def make_room(cache: dict, most: int) -> None:
    """Forget the older half of a full cache."""
    if len(cache) >= most:
        for key in list(islice(cache, most // 2)):
            del cache[key]


class TrieBpe:
    """A tokenizers file whose pre-tokens never hold white space; its normaliser and pre-tokenizer come from the library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        self.normalize, self.split = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.ranks = {tuple(m): i for i, m in enumerate(model["merges"])}
        self.end = model.get("end_of_word_suffix") or ""
        self.special = {t.content: i for i, t in library.get_added_tokens_decoder().items()}
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.tokens = {str(i): t for t, i in [*self.vocab.items(), *self.special.items()]}
        self.backward = {mark: self._backward(mark) for mark in {"", self.end}}
        self.parts: dict[str, tuple[str, str] | None] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.words: dict[str, str] = {}
        self.chunks: dict[str, str] = {}

    def _backward(self, mark: str) -> dict:
        """The vocabulary's tokens with the mark, or without one, as a trie from the last symbol to the first."""
        root: dict = {}
        for token in self.vocab:
            marked = bool(self.end) and token.endswith(self.end)
            if marked != bool(mark):
                continue
            node = root
            for symbol in reversed(token[: -len(mark)] if mark else token):
                node = node.setdefault(symbol, {})
            node[_TOKEN] = True
        return root

    # -- encoding ---------------------------------------------------------------------------------------------------------------
    def symbols(self, token: str) -> list[str]:
        if self.end and token.endswith(self.end):
            body = token[: -len(self.end)]
            return [*body[:-1], body[-1] + self.end]
        return list(token)

    def merged(self, symbols: list[str]) -> list[str]:
        """The definition: join the pair of lowest rank, the leftmost first, until none is left."""
        parts = list(symbols)
        while len(parts) > 1:
            rank, at = min((self.ranks.get((a, b), 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def last_merge(self, token: str) -> tuple[str, str] | None:
        """The two parts that are joined last when the token is encoded; None for a single symbol. A token that its own merges do not reach has ("", "")."""
        if token not in self.parts:
            parts = self.symbols(token)
            last = None
            while len(parts) > 1:
                rank, at = min((self.ranks.get((a, b), 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
                if rank == 1 << 60:
                    last = ("", "")
                    break
                last = parts[at], parts[at + 1]
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            self.parts[token] = last
        return self.parts[token]

    def stays_apart(self, left: str, right: str) -> bool:
        """No merge joins the end of one token with the start of the next before both are whole."""
        none = 1 << 60
        before = none  # merges across the boundary from this rank on come too late
        while True:
            if self.ranks.get((left, right), none) < before:
                return False
            one, two = self.last_merge(left), self.last_merge(right)
            rank_one, rank_two = (self.ranks[one] if one else -1), (self.ranks[two] if two else -1)
            if rank_one < 0 and rank_two < 0:
                return True
            if rank_one > rank_two:  # undo the later merge; of equal ranks the one on the right, as merges run from the left
                before, left = rank_one, one[1]
            else:
                before, right = rank_two + 1, two[0]

    def fits(self, before: str, token: str) -> bool:
        known = self.last_merge(token) != ("", "") and (not before or self.stays_apart(before, token))
        if len(self.pairs) >= CACHE_PAIRS:
            self.pairs.clear()
        self.pairs[before, token] = known
        return known

    def last_token(self, word: str, end: int, states: list[str], mark: str) -> str:
        """Last token of word[:end], given the states of all shorter prefixes."""
        node, start, starts = self.backward[mark], end, []
        while start:
            node = node.get(word[start - 1])
            if node is None:
                break
            start -= 1
            if _TOKEN in node:
                starts.append(start)
        pairs = self.pairs
        for start in reversed(starts):
            token, before = word[start:end] + mark, states[start - 1] if start else ""
            known = pairs.get((before, token))
            if known or known is None and self.fits(before, token):
                return token
        raise ValueError(f"no token ends {word[:end]!r}")

    def encode_words(self, words: Iterable[str]) -> dict[str, list[int]]:
        out, states, path = {}, [], ""
        for word in sorted(set(words)):
            body = word[:-1]
            shared, most = 0, min(len(body), len(path))
            while shared < most and body[shared] == path[shared]:
                shared += 1
            del states[shared:]
            for end in range(shared + 1, len(body) + 1):
                states.append(self.last_token(body, end, states, ""))
            path = body
            token, at, ids = self.last_token(word, len(word), states, self.end), len(word), []
            while True:
                ids.append(self.vocab[token])
                at -= len(token) - len(self.end) * (at == len(word) and bool(self.end))
                if at <= 0:
                    break
                token = states[at - 1]
            out[word] = ids[::-1]
        return out

    def split_chunks(self, chunks: set[str]) -> dict[str, list]:
        """The pre-tokens of each piece, and the ids of special tokens."""
        special = self.special_pattern.search if self.special_pattern else lambda c: None
        same_length = lambda c: c.isascii() or is_normalized("NFC", c) and len(c.lower()) == len(c)
        plain = [c for c in chunks if c.isprintable() and same_length(c) and not special(c)]
        pieces: dict[str, list] = {c: [] for c in plain}
        normal = self.normalize(" ".join(plain))
        ends = list(accumulate(len(c) + 1 for c in plain))
        if normal.count(" ") == len(plain) - 1 and all(normal[e - 1] == " " for e in ends[:-1]):  # all of them in one call: no pre-token holds a blank
            of_end = iter(zip(ends, plain))
            end, words = 0, []
            for word, (first, _) in self.split(normal):
                while first >= end:
                    end, chunk = next(of_end)
                    words = pieces[chunk]
                words.append(word)
        else:
            pieces = {}
        for chunk in chunks - pieces.keys():
            parts: list = []
            for p in self.special_pattern.split(chunk) if self.special_pattern else [chunk]:
                if p in self.special:
                    parts.append(self.special[p])
                elif p:
                    parts += [w for w, _ in self.split(self.normalize(p))]
            pieces[chunk] = parts
        return pieces

    def encode_chunks(self, chunks: set[str]) -> dict[str, str]:
        """Pieces of text without blanks -> their ids, joined by spaces."""
        pieces = self.split_chunks(chunks)
        make_room(self.words, CACHE_WORDS)
        found = {w: " ".join(map(str, ids)) for w, ids in self.encode_words(
            {p for parts in pieces.values() for p in parts if isinstance(p, str) and p not in self.words}).items()}
        long = {w: found.pop(w) for w in [w for w in found if len(w) > LONGEST_CACHED]}
        self.words.update(found)
        known = self.words
        return {c: " ".join([known[p] if p in known else long[p] if isinstance(p, str) else str(p) for p in parts]) for c, parts in pieces.items()}

    def encode_batch(self, texts: list[str]) -> Iterator[str]:
        cut = [t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in texts]
        make_room(self.chunks, CACHE_CHUNKS)
        new = self.encode_chunks(set().union(*cut).difference(self.chunks, ("",)))
        self.chunks.update(new)
        ids = self.chunks.__getitem__
        for parts in cut:
            yield " ".join(filter(None, map(ids, filter(None, parts))))
        for chunk in [c for c in new if len(c) > LONGEST_CACHED]:
            del self.chunks[chunk]

    # -- decoding ---------------------------------------------------------------------------------------------------------------
    def decode(self, ids: str) -> str:
        """Of ids joined by spaces. The vocabulary file names no decoder, so the tokens are joined by single spaces."""
        return " ".join(map(self.tokens.__getitem__, ids.split(" "))) if ids else ""


_known: dict[str, TrieBpe] = {}


def tokenizer(path: str) -> TrieBpe:
    """One per worker process."""
    if path not in _known:
        _known[path] = TrieBpe(path)
    return _known[path]


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


def _encode(path: str, texts_in: int = 1 << 20):
    def run(batches):
        bpe = tokenizer(path)
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            first = 0
            while first < len(texts):
                part, size = [], 0
                while first + len(part) < len(texts) and size < texts_in:
                    part.append(texts[first + len(part)].as_py() or "")
                    size += len(part[-1])
                rows = [(x.count(" ") + 1 if x else 0, _sha(x), _sha(bpe.decode(x))) for x in bpe.encode_batch(part)]
                n, a, b = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([ids.slice(first, len(part)), pa.array(n, pa.int64()), pa.array(a), pa.array(b)],
                                                 ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
                first += len(part)
    return run


def encode_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """-> (doc_id, n_tokens, ids_sha256, decoded_sha256) of each whole text. A null text is empty: no tokens, hashes of the empty text.
    Null ids and repeated rows are kept; other columns are ignored; an empty table gives no rows."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_encode(tokenizer_path), SCHEMA)
