"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact weighted-shingle check.

Words are runs of letters, digits and underscores in lower case; a shingle is five words (an item of fewer words is one
shingle). A shingle weighs as often as it occurs; the similarity of two bags of shingles is the weighted Jaccard, the
sum of the lesser counts by the sum of the greater ones. It depends on the two texts only, whatever the corpus.

For every item size, a document's windows of that many words are fingerprinted; a shorter document is one window, passed
over if it has less than 0.8 of the item's shingles, as its similarity is less then too. A fingerprint has BITS bits, each
the sign of the sum of the shingles' weights with one bit of the shingle's digest as sign. Fingerprints within RADIUS differ
in at most RADIUS // BLOCKS bits of at least one of BLOCKS blocks, so a pair that is close in no block can't be within the
radius: the blocks propose every pair within it, and 0.84 % of unrelated ones. Only windows and items with a shingle in
common meet, found by an index from shingles to items, as the similarity of all others is 0; so what a window costs depends
on the items that share its words, not on the size of the benchmark. (At a radius of a quarter of the bits, tables of all
near block values would be larger than the items themselves, so blocks are compared, not looked up.) Pairs within the
radius are verified exactly. At similarity 0.8 two fingerprints are 38.6 bits apart on average (27 degrees) with a
deviation of 5.7; RADIUS is 4.3 deviations beyond.

Documents are read once for each block of items; a block has at most ITEM_WORDS words of whole items (one larger item is a
block by itself). The driver holds one block at a time, and each block but the last is run and its result written before
the next is read, so what the driver and a task hold of the benchmark is bounded whatever its size. No shuffle takes part.

Defined results: null or empty texts and items match nothing; repeated documents give repeated rows, repeated items
(same key and text) one row each; of an item's windows of equal similarity the first counts; a very long text is
fingerprinted MOST_STARTS windows at a time; an empty table on either side gives an empty result; other columns don't take
part. Jobs run while the plan is built: one to read the items, one for each block of items but the last.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, slices, stash
from .words import MIX, SHINGLE, WORD, Words, mixed, shingles

#: Least similarity, bits of a fingerprint, greatest Hamming distance, blocks of 32 bits.
SIMILARITY, BITS, RADIUS, BLOCKS = 0.8, 256, 63, 8
#: Blocks that are compared at a time.
COMPARED = 1 << 20
#: Words of a block of items at most.
ITEM_WORDS = 500_000


def among(x: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Which of x are in own, which is in order and not empty."""
    at = np.minimum(np.searchsorted(own, x), len(own) - 1)
    return own[at] == x


def signs(x: np.ndarray) -> np.ndarray:
    """-1 or 1 for each of the BITS bits of each number's digest."""
    words = mixed(x[:, None] + np.arange(1, BITS // 64 + 1, dtype=np.uint64) * MIX)
    bits = np.unpackbits(words.astype("<u8").view(np.uint8), axis=1, bitorder="little")
    return bits.astype(np.int32) * 2 - 1


def packed(sums: np.ndarray) -> np.ndarray:
    """The fingerprints of rows of BITS sums, as rows of blocks; a sum of zero gives 1."""
    return np.packbits(sums >= 0, axis=1, bitorder="little").view("<u4")


class Size:
    """The items of one number of words: fingerprints, shingles, and which items have each shingle."""

    def __init__(self, words: int, rows: list[tuple[int, Counter]]):
        self.words, self.shingle = words, min(words, SHINGLE)
        self.items = rows
        bags = [np.array(list(bag), np.uint64) for _, bag in rows]
        sums = [(signs(x) * np.array(list(bag.values()), np.int64)[:, None]).sum(axis=0) for x, (_, bag) in zip(bags, rows)]
        self.prints = packed(np.array(sums))
        flat, holder = np.concatenate(bags), np.repeat(np.arange(len(rows)), [len(x) for x in bags])
        order = np.argsort(flat, kind="stable")
        self.own, first = np.unique(flat[order], return_index=True)
        self.holders, self.first = holder[order], np.append(first, len(flat))

    def having(self, x: np.ndarray) -> np.ndarray:
        """The items with any of the shingles x, all of which some item has."""
        at = np.unique(np.searchsorted(self.own, x)).tolist()
        return np.unique(np.concatenate([self.holders[self.first[k] : self.first[k + 1]] for k in at]))

    def near(self, prints: np.ndarray, items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) of all fingerprints within the radius, of these items."""
        lot = max(1, COMPARED // (len(items) * BLOCKS))
        found = []
        for lo in range(0, len(prints), lot):
            apart = np.bitwise_count(prints[lo : lo + lot, None, :] ^ self.prints[items][None])
            w, i = np.nonzero(apart.min(axis=2) <= RADIUS // BLOCKS)
            close = apart[w, i].sum(axis=1, dtype=np.int64) <= RADIUS
            found.append((w[close] + lo, items[i[close]]))
        return tuple(np.concatenate(x) for x in zip(*found))


class Benchmark:
    """A block of items: their sizes, and a bitmap of all their shingles."""

    MAP = 1 << 22

    def __init__(self, rows: list[tuple]):
        words = Words()
        by: dict[int, list] = {}
        for item, text in rows:
            w = words.numbers(text or "")
            if len(w):
                by.setdefault(len(w), []).append((item, Counter(shingles(w, min(len(w), SHINGLE)).tolist())))
        self.sizes = [Size(n, by[n]) for n in sorted(by)]
        self.bitmap = {}
        for s in self.sizes:
            self.bitmap.setdefault(s.shingle, np.zeros(self.MAP, bool))[(s.own % np.uint64(self.MAP)).astype(np.int64)] = True
        self.all = {k: np.unique(np.concatenate([s.own for s in self.sizes if s.shingle == k])) for k in self.bitmap}

    @staticmethod
    def similar(bag: Counter, window: np.ndarray) -> float:
        low = sum((bag & Counter(window.tolist())).values())
        return low / (sum(bag.values()) + len(window) - low)

    def matches(self, words: np.ndarray) -> list[tuple]:
        """(item, first word, words, similarity) of each item's best window, the first of equals."""
        best: dict = {}
        for k, bitmap in self.bitmap.items():
            x = shingles(words, k)
            hits = np.flatnonzero(bitmap[(x % np.uint64(self.MAP)).astype(np.int64)])
            hits = hits[among(x[hits], self.all[k])]
            if not len(hits):
                continue
            for size in self.sizes:
                whole = size.words - k + 1  # shingles of the item
                span = min(whole, len(x))  # and of a window, the whole text if that is shorter
                if size.shingle != k or span < SIMILARITY * whole - 1e-9:
                    continue
                mine = hits[among(x[hits], size.own)]
                for lo, hi in runs(mine, span, len(x) - span):
                    y = x[lo : hi + span]
                    sums = np.cumsum(signs(y), axis=0)
                    at = sums[span - 1 :].copy()
                    at[1:] -= sums[: len(y) - span]
                    held = size.having(x[mine[(mine >= lo) & (mine < hi + span)]])
                    for w, i in zip(*(v.tolist() for v in size.near(packed(at), held))):
                        item, bag = size.items[i]
                        s = self.similar(bag, y[w : w + span])
                        if s >= SIMILARITY - 1e-12 and s > best.get((item, i, size.words), (0, 0))[0] + 1e-12:
                            best[item, i, size.words] = (s, lo + w)
        out: dict = {}
        for (item, _, n), (s, start) in best.items():
            if item not in out or s > out[item][3]:
                out[item] = (item, start, min(n, len(words)), s)
        return list(out.values())


#: Window starts that are fingerprinted at a time, whatever the text's length.
MOST_STARTS = 4096


def runs(hits: np.ndarray, span: int, last: int) -> Iterator[tuple[int, int]]:
    """First and last start of the windows of `span` shingles that hold one of `hits`, run after run."""
    lo = hi = None
    for h in hits.tolist():
        a, b = max(0, h - span + 1), min(h, last)
        if a > b:
            continue
        if lo is not None and a <= hi + 1:
            hi = max(hi, b)
        else:
            if lo is not None:
                yield from cut(lo, hi)
            lo, hi = a, b
    if lo is not None:
        yield from cut(lo, hi)


def cut(lo: int, hi: int) -> Iterator[tuple[int, int]]:
    for a in range(lo, hi + 1, MOST_STARTS):
        yield a, min(hi, a + MOST_STARTS - 1)


def blocks(items: DataFrame, item: str, text: str) -> Iterator[list[tuple]]:
    """The items' (key, text) in blocks of at most ITEM_WORDS words, by key; one block at a time reaches the driver."""
    rows, total = [], 0
    for r in items.select(F.col(item), F.col(text).cast("string")).distinct().orderBy(item, text).toLocalIterator():
        n = len(WORD.findall(r[1] or ""))
        if rows and total + n > ITEM_WORDS:
            yield rows
            rows, total = [], 0
        rows.append((r[0], r[1]))
        total += n
    if rows:
        yield rows


def leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(key, item, first_word, n_words, similarity): for each document and item that leaks into it, the best window."""
    src = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind, item_kind = src.schema["key"].dataType.simpleString(), items.schema[item].dataType
    schema = f"key {kind}, item {item_kind.simpleString()}, first_word long, n_words long, similarity double"

    def finder(rows: list[tuple]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bench, words = Benchmark(rows), Words()
            for b in slices(batches, "text", 1 << 20):
                found = [(k, *m) for k, t in zip(b.column("key").to_pylist(), b.column("text").to_pylist()) if t for m in bench.matches(words.numbers(t))]
                if found:
                    key_type = b.schema.field("key").type
                    columns = list(zip(*found))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(columns[0], key_type), pa.array(columns[1]), *(pa.array(c, t) for c, t in zip(columns[2:], (pa.int64(), pa.int64(), pa.float64())))],
                        ["key", "item", "first_word", "n_words", "similarity"],
                    )

        return run

    out = last = None
    for rows in blocks(items, item, item_text):
        if last is not None:
            out = stash(last) if out is None else out.unionAll(stash(last))
        last = mapped(src, finder(rows), schema)
    if last is None:
        last = docs.sparkSession.createDataFrame([], schema)
    out = last if out is None else out.unionAll(last)
    return out.withColumnsRenamed({"key": key, "item": item})


def clean(docs: DataFrame, items: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The docs without any leak, with all their columns, by the same windows and checks; no join and no shuffle."""
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(text).cast("string").alias("text"))
    schema = f"row {row.schema['row'].dataType.simpleString()}, text string"

    def keeper(rows: list[tuple]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bench, words = Benchmark(rows), Words()
            for b in slices(batches, "text", 1 << 20):
                good = [not (t and bench.matches(words.numbers(t))) for t in b.column("text").to_pylist()]
                yield b.filter(pa.array(good, pa.bool_()))

        return run

    for n, rows in enumerate(blocks(items, item, item_text)):
        row = mapped(stash(row) if n else row, keeper(rows), schema)
    return row.select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))
