"""Byte-level BPE encoding and decoding by a pair occurrence index.

The distinct pre-tokens of a batch are laid out as one linked list of symbols. An index maps each pair of
neighbouring symbols to all its positions; the pairs' ranks are applied in ascending order, each to all its
positions at once, and only the lists of the pairs to the left and right of a merge are updated. As a merge can
only create pairs of a higher rank, one ascending pass gives what merging each word by itself gives.

Defined results: a null text counts as empty; an empty text has no ids and decodes to the empty text; repeated
rows give repeated results; an empty table gives an empty one. Columns other than the key and the text are
dropped, so clashing names can't occur. Ties: pairs have different ranks, and the positions of one pair merge from left
to right, so "aaa" becomes "aa", "a". Texts are taken AT_ONCE bytes at a time, a very long one alone and whole: memory
grows with the longest text.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, slices

#: How the ByteLevel pre-tokenizer cuts a text (fixed value of the format; white space as Unicode's property).
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
#: Pre-tokens kept by a Python worker, and the longest that is kept (a bound of memory, not of what is encoded).
CACHE_WORDS, CACHE_LENGTH = 200_000, 64
#: Bytes of text that are cut into pre-tokens at a time; a pre-token takes some 15 times its bytes.
AT_ONCE = 2 << 20


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in the vocabulary file."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Codec:
    """Encoder and decoder of a vocabulary file of the tokenizers library (byte-level BPE, no normalizer)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        of_letter = {c: b for b, c in enumerate(letters)}
        vocab = spec["model"]["vocab"]
        self.byte_id = [vocab[c] for c in letters]
        self.rank = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rank[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.piece = [b""] * (1 + max([*vocab.values(), *self.added.values()]))
        for token, i in vocab.items():
            self.piece[i] = bytes(of_letter[c] for c in token)
        for token, i in self.added.items():
            self.piece[i] = token.encode()
        self.cut = regex.compile(PATTERN).findall
        longest_first = sorted(self.added, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")") if self.added else None
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def merge(self, words: list[str]) -> list[bytes]:
        """The ids of each word, as little-endian unsigned 32-bit integers."""
        byte_id, rank = self.byte_id, self.rank
        symbol: list[int] = []
        for w in words:
            symbol.extend([byte_id[b] for b in w.encode()])
            symbol.append(-1)  # no pair reaches over the end of a word
        n = len(symbol)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        places: dict[tuple[int, int], list[int]] = {}
        for i, pair in enumerate(zip(symbol, symbol[1:])):
            if pair in places:
                places[pair].append(i)
            elif pair in rank:
                places[pair] = [i]
        active = [(rank[p], p) for p in places]
        heapq.heapify(active)
        while active:
            (_, made), pair = heapq.heappop(active)
            left, right = pair
            for i in sorted(places.pop(pair)):
                if symbol[i] != left:
                    continue
                j = after[i]
                if symbol[j] != right:
                    continue
                symbol[i], symbol[j] = made, -2
                k = after[i] = after[j]
                before[k] = i
                h = before[i]
                for at, new in ((h, (symbol[h], made)), (i, (made, symbol[k]))):
                    if new in places:
                        places[new].append(at)
                    elif new in rank:
                        places[new] = [at]
                        heapq.heappush(active, (rank[new], new))
        flat = np.array(symbol, dtype=np.int64)
        flat = flat[flat != -2]
        ends = np.flatnonzero(flat == -1)
        ids = flat.astype("<u4").tobytes()
        starts = np.concatenate(([0], ends[:-1] + 1)) if len(ends) else ends
        return [ids[4 * s : 4 * e] for s, e in zip(starts.tolist(), ends.tolist())]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text; strings of added tokens are taken as these tokens."""
        cut = [
            [self.cut(x) if i % 2 == 0 else x for i, x in enumerate(self.special.split(t))] if self.special else [self.cut(t)]
            for t in texts
        ]
        known, older = self.known, self.older
        fresh = {w for parts in cut for p in parts[::2] for w in set(p)}.difference(known)
        for w in fresh.intersection(older):
            known[w] = older[w]
        fresh = list(fresh.difference(known))
        for k in range(0, len(fresh), 50_000):
            known.update(zip(fresh[k : k + 50_000], self.merge(fresh[k : k + 50_000])))
        lookup = known.__getitem__
        out = []
        for parts in cut:
            out.append(b"".join(
                b"".join(map(lookup, p)) if i % 2 == 0 else self.added[p].to_bytes(4, "little") for i, p in enumerate(parts)
            ))
        if len(known) > CACHE_WORDS:
            self.known, self.older = {}, {w: x for w, x in known.items() if len(w) <= CACHE_LENGTH}
        return out

    def decode(self, ids: bytes) -> str:
        piece = self.piece.__getitem__
        return b"".join(map(piece, np.frombuffer(ids, dtype="<u4").tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One codec for each vocabulary and Python worker."""
    return Codec(path)


def encode(docs: DataFrame, vocab: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(vocab)
        for b in slices(batches, "text", AT_ONCE):
            ids = [np.frombuffer(x, dtype="<u4").astype(np.int32) for x in bpe.encode([t or "" for t in b.column("text").to_pylist()])]
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(ids, pa.list_(pa.int32()))], ["key", "ids"])

    kind = docs.schema[key].dataType.simpleString()
    src = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return mapped(src, run, f"key {kind}, ids array<int>").select(F.col("key").alias(key), "ids")


def decode(encoded: DataFrame, vocab: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, text) of every list of ids; null ids give the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(vocab)
        for b in batches:
            texts = [bpe.decode(np.array(x or [], dtype="<u4").tobytes()) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(texts, pa.string())], ["key", "text"])

    kind = encoded.schema[key].dataType.simpleString()
    src = encoded.select(F.col(key).alias("key"), F.col(ids).alias("ids"))
    return mapped(src, run, f"key {kind}, text string").select(F.col("key").alias(key), F.col("text"))


def digest(docs: DataFrame, vocab: str, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode every whole text, decode the ids again, and return (key, n_tokens, ids_sha256, decoded_sha256).

    Both directions run in one pass over a batch, so the ids, several times the text, only leave the worker if asked
    for: with_ids adds ids array<int>.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(vocab)
        for b in slices(batches, "text", AT_ONCE):
            ids = bpe.encode([t or "" for t in b.column("text").to_pylist()])
            columns = [
                b.column("key"),
                pa.array([len(x) // 4 for x in ids], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                pa.array([hashlib.sha256(bpe.decode(x).encode()).hexdigest() for x in ids], pa.string()),
            ]
            if with_ids:
                columns.append(pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in ids], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, ["key", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(columns)])

    kind = docs.schema[key].dataType.simpleString()
    src = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    schema = f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return mapped(src, run, schema).withColumnRenamed("key", key)
