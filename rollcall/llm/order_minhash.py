"""Near-duplicates by Order MinHash, verified by banded alignment.

k-mers are shingles of five words, labelled with how often they occurred before in the text. Each of TABLES hash
functions takes a text's PICKED lowest labelled k-mers and keeps them in text order; a sketch is the digest of that
list, so it tells order and repetition apart, as edit similarity does. Texts that share at least AGREE sketches are
candidates. At the least similarity, 0.8, a sketch agrees with a chance of about 0.8**3, so about 16 of TABLES do, and
fewer than AGREE with a chance of about 1e-7 (2e-5 where two texts have five shingles in all).

Two texts are near-duplicates if a banded alignment of their shingles (longest common subsequence, lcs) gives
lcs / (n + m - lcs) >= 0.8. The band is as wide as that bound lets an alignment stray, so it cuts nothing off.

Links, not pairs: texts with the same words are one to begin with. In each bucket (a table's sketch) every text is
compared with the bucket's hub, the least id; texts that are linked then form components, so a group of n copies or near
copies costs about n comparisons in a table. Then each bucket's texts are compared with a hub drawn by a hash, if it is of
another component, HUB_ROUNDS times. What is left in a bucket, the texts outside its largest component, is
compared with the texts of other components there, each pair in the first bucket that it shares. A bucket with more than
OUTSIDE of them is opened: its texts meet by pairs of sketches instead, TABLES // AGREE apart at most. That loses no
candidate, as of AGREE agreeing tables on a circle two are no further apart. Comparing means counting agreeing
sketches and holding parity bitmaps against each other: bit i tells whether an odd number of a text's labelled k-mers
fall on i, so two bitmaps differ in at most as many bits as there are k-mers in one text only. At similarity 0.8 or more
those are at most a ninth of the two texts' k-mers, so no similar pair is passed over. A bitmap has two to four bits a
k-mer, which tells most pairs at 0.75 from those at 0.8; at most MOST_BITS bits, beyond which (over 16,384 shingles) it
tells less. These tests are conditions of the joins, so only pairs that pass become rows, and texts are read for those.

Defined results: a null text counts as empty; texts without words are classed by equality; a text of fewer than five words
is one shingle; repeated rows are one class; null keys are documents of their own; a class is named by its least key (null
if it has no other); ties: the least id is the hub of a bucket and names its component; an empty table gives an empty one;
other columns don't take part. A very long text is sketched AT_ONCE hashes at a time; aligning two of n shingles takes
about n * n / 300 word operations, the one step that doesn't grow in proportion. Jobs run while the plan is built.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mapped, numbered, slices, stash
from .words import MIX, SHINGLE, Words, mixed, shingles

#: Sketches of a text, k-mers of a sketch, sketches that candidates share, least similarity.
TABLES, PICKED, AGREE, SIMILARITY = 32, 3, 3, 0.8
#: Bits of a parity bitmap at least and at most.
LEAST_BITS, MOST_BITS = 64, 1 << 16
#: Rounds with hubs drawn by a hash; rows that one file of an intermediate table holds.
HUB_ROUNDS, FILE_ROWS = 2, 25_000
#: Texts outside a bucket's largest component that are compared with all its others; fuller buckets are opened.
OUTSIDE = 2000
#: Shingles whose hashes are held at a time; shingles that a worker keeps of texts it compares.
AT_ONCE, KEPT_SHINGLES = 1 << 17, 1 << 20
SEEDS = np.random.default_rng(7).integers(0, 1 << 63, TABLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def labelled(x: np.ndarray) -> np.ndarray:
    """k-mers with their occurrence: equal ones get different numbers, by how many came before."""
    order = np.argsort(x, kind="stable")
    y = x[order]
    place = np.arange(len(y))
    start = np.maximum.accumulate(np.where(np.concatenate([[True], y[1:] != y[:-1]]), place, 0))
    out = x.copy()
    out[order] += (place - start).astype(np.uint64) * MIX
    return mixed(out)


def parities(kmers: np.ndarray) -> np.ndarray:
    """The parity bitmap of labelled k-mers, as 64-bit integers."""
    bits = min(max(1 << (2 * len(kmers) - 1).bit_length(), LEAST_BITS), MOST_BITS)
    odd = np.bincount((kmers & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view(np.int64)


def sketches(kmers: np.ndarray) -> np.ndarray:
    """The sketch of each table of a text's labelled k-mers (at least one)."""
    n = len(kmers)
    if n > PICKED:
        picked = np.empty((TABLES, PICKED), np.int64)
        lots = max(1, AT_ONCE // n)
        for t in range(0, TABLES, lots):
            hashes = kmers[None, :] * SEEDS[t : t + lots, None]
            picked[t : t + lots] = np.argpartition(hashes, PICKED - 1, axis=1)[:, :PICKED]
        picked.sort(axis=1)
    else:
        picked = np.tile(np.arange(n), (TABLES, 1))
    out = SEEDS.copy()
    for k in range(picked.shape[1]):
        out = mixed(out * MIX + kmers[picked[:, k]])
    return out


def shingled(words: np.ndarray) -> np.ndarray:
    return shingles(words, min(len(words), SHINGLE)) if len(words) else words


def aligned(a: list[int], b: list[int], band: int) -> int:
    """The longest common subsequence of a and b over pairs with |i - j| <= band, by bit-parallel rows.

    Bit j of the row is 0 where column j raises the length; the row holds the band's columns only. Columns that leave
    the band are settled, so their zeros are counted as they go.
    """
    places: dict[int, list[int]] = {}
    for j, s in enumerate(b):
        places.setdefault(s, []).append(j)
    lo, hi = 0, min(len(b), band + 1)  # columns lo to hi - 1
    row, done = (1 << hi) - 1, 0
    for i, s in enumerate(a):
        if i:
            if i - band > lo:
                if lo < hi:
                    done += 1 - (row & 1)
                    row >>= 1
                lo += 1
            if hi < len(b):
                row |= 1 << (hi - lo)
                hi += 1
        if lo >= hi:
            break
        own = places.get(s)
        if own:
            at = 0
            for j in own[bisect_left(own, lo) :]:
                if j >= hi:
                    break
                at |= 1 << (j - lo)
            x = row & at
            if x:
                row = ((row + x) | (row ^ x)) & ((1 << (hi - lo)) - 1)
    return done + max(0, hi - lo) - row.bit_count()


def similarity(x: np.ndarray, y: np.ndarray) -> float:
    """lcs / (n + m - lcs) of two lists of shingles, 0 where it is sure to be below SIMILARITY."""
    n, m = len(x), len(y)
    if not n or not m or min(n, m) < SIMILARITY * max(n, m) - 1e-9:
        return 0.0
    k = min(n, m)
    head = int(np.argmin(np.append(x[:k] == y[:k], False)))
    k -= head
    tail = int(np.argmin(np.append(x[n - k :][::-1] == y[m - k :][::-1], False)))
    x, y = x[head : n - tail], y[head : m - tail]
    # lcs >= SIMILARITY / (1 + SIMILARITY) * (n + m) leaves so many shingles of either text without a partner
    band = int((n + m) * (1 - 2 * SIMILARITY / (1 + SIMILARITY)) + 1e-9)
    if len(x) and len(y):
        common = np.intersect1d(x, y)
        loose = np.count_nonzero(~np.isin(x, common)) + np.count_nonzero(~np.isin(y, common))
        if loose > band:
            return 0.0
    lcs = head + tail + (aligned(x.tolist(), y.tolist(), band) if len(x) and len(y) else 0)
    return lcs / (n + m - lcs)


def sketched(rows: DataFrame) -> DataFrame:
    """(id, copy, n, sketch, bits) of rows (id, text): copy is a digest of the words, or of the text if it has none; n
    shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for b in slices(batches, "text", 1 << 20):
            copies, sizes, found, bits = [], [], [], []
            for t in b.column("text").to_pylist():
                w = words.numbers(t)
                copies.append(("w" if len(w) else "t") + xxhash.xxh3_128_hexdigest(w.tobytes() if len(w) else t.encode()))
                x = labelled(shingled(w)) if len(w) else w
                sizes.append(len(x))
                found.append(sketches(x).view(np.int64) if len(x) else x.view(np.int64))
                bits.append(parities(x))
            columns = [b.column("id"), pa.array(copies, pa.string()), pa.array(sizes, pa.int64()), pa.array(found, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "copy", "n", "sketch", "bits"])

    return mapped(rows.select("id", "text"), run, "id long, copy string, n long, sketch array<long>, bits array<long>")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose texts (id, text) are near-duplicates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, kept, held = Words(), OrderedDict(), 0

        def of(i: int, text: str) -> np.ndarray:
            nonlocal held
            if i not in kept:
                kept[i] = shingled(words.numbers(text))
                held += len(kept[i])
                while held > KEPT_SHINGLES and len(kept) > 2:
                    held -= len(kept.popitem(last=False)[1])
            kept.move_to_end(i)
            return kept[i]

        for b in slices(batches, "text", 1 << 20):
            columns = [b.column(c).to_pylist() for c in ("a", "text_a", "b", "text")]
            good = [similarity(of(i, s), of(j, t)) >= SIMILARITY - 1e-9 for i, s, j, t in zip(*columns)]
            yield b.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("id").alias("b"), "text"), "b")
    return mapped(both.select("a", "text_a", "b", "text"), run, "a long, b long")


def files(rows: int) -> int:
    return rows // FILE_ROWS + 1


def components(links: DataFrame) -> DataFrame:
    """(id, part) of all ids in links (a, b): part is the least id that links lead to.

    Each round takes the least part among the neighbours, then the part of that part, until nothing changes.
    """
    k = files(2 * links.count())
    edges = stash(links.union(links.select("b", "a")).distinct(), k)
    parts = stash(edges.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("b")).select("id", F.least("id", "b").alias("part")), k)
    while True:
        near = edges.join(parts, edges.b == parts.id).groupBy("a").agg(F.min("part").alias("near"))
        least = stash(parts.join(near, parts.id == near.a).select("id", F.least("part", "near").alias("part"), F.col("part").alias("old")), k)
        over = least.select(F.col("id").alias("part"), F.col("part").alias("beyond"))
        parts = stash(least.join(over, "part").select("id", F.col("beyond").alias("part"), "old"), k)
        if parts.where("part <> old").limit(1).count() == 0:
            return parts.select("id", "part")
        parts = parts.select("id", "part")


AGREEING = "size(filter(zip_with(sketch_a, sketch_b, (x, y) -> x = y), z -> z)) >= {least}"
FIRST = "array_position(zip_with(sketch_a, sketch_b, (x, y) -> x = y), true) = place"
FOLDED = "if(size({x}) > size({y}), zip_with(slice({x}, 1, size({y})), slice({x}, size({y}) + 1, size({y})), (p, q) -> p ^ q), {x})"
DIFFERING = "aggregate(zip_with({a}, {b}, (x, y) -> bit_count(x ^ y)), 0, (s, v) -> s + v)"


def agreeing() -> Column:
    """Whether texts a and b are candidates, by their sizes, sketches and parity bitmaps.

    lcs / (n + m - lcs) >= 0.8 leaves at most (n + m) / 9 k-mers without a partner. Sizes that fit make bitmaps of one
    size or of twice the size; a bitmap is halved by adding up its halves.
    """
    fits = F.expr(f"least(n_a, n_b) >= {SIMILARITY} * greatest(n_a, n_b) - 1e-9D")
    differing = DIFFERING.format(a=FOLDED.format(x="bits_a", y="bits_b"), b=FOLDED.format(x="bits_b", y="bits_a"))
    alone = F.expr(f"{differing} <= (n_a + n_b) * {(1 - SIMILARITY) / (1 + SIMILARITY)} + 1e-6D")
    return fits & alone & F.expr(AGREEING.format(least=AGREE))


def side(rows: DataFrame, name: str, *also: str) -> DataFrame:
    return rows.select(F.col("id").alias(name), *(F.col(c).alias(f"{c}_{name}") for c in ("sketch", "n", "bits")), *also)


def grouped(members: DataFrame, links: DataFrame) -> DataFrame:
    """members (id, ...) with part, the component that links give so far."""
    return members.join(components(links), "id", "left").withColumn("part", F.coalesce("part", "id"))


def left_over(rows: DataFrame, k: int) -> DataFrame:
    """Rows (bucket, id, part, ...) of buckets with several components, with `main`, a largest component of the bucket,
    and `outside`, the number of texts outside it."""
    several = rows.groupBy("bucket").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo <> hi").select("bucket")
    rows = stash(rows.join(stash(several, k), "bucket"), k)
    sizes = rows.groupBy("bucket", "part").agg(F.count(F.lit(1)).alias("k")).groupBy("bucket")
    sizes = sizes.agg(F.max(F.struct("k", "part"))["part"].alias("main"), (F.sum("k") - F.max("k")).alias("outside"))
    return rows.join(stash(sizes, k), "bucket")


def hubbed(rows: DataFrame, within: DataFrame, turn: int, k: int) -> DataFrame:
    """Candidates (a, b): each bucket's hub of this turn with the bucket's texts of other components."""
    drawn = rows.groupBy("bucket").agg(F.min(F.struct(F.xxhash64("id", "bucket", F.lit(turn)).alias("p"), "id", "part")).alias("h"))
    hubs = stash(drawn.select(F.col("bucket").alias("bucket_a"), F.col("h.id").alias("a"), F.col("h.part").alias("part_a")), k)
    pairs = hubs.join(rows.select("bucket", F.col("id").alias("b"), "part"), (F.col("bucket_a") == F.col("bucket")) & (F.col("part_a") != F.col("part")))
    pairs = pairs.select("a", "b").distinct()
    return pairs.join(side(within, "a"), "a").join(side(within, "b"), "b").where(agreeing()).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def crossed(rows: DataFrame, first: bool) -> DataFrame:
    """Candidates (a, b): texts outside the main component with texts of other components in their bucket (and if
    `first`, in no bucket of an earlier place)."""
    a = side(rows.where("part <> main"), "a", "bucket", "place", F.col("part").alias("part_a"))
    b = side(rows, "b", F.col("bucket").alias("bucket_b"), F.col("part").alias("part_b"), (F.col("part") != F.col("main")).alias("out_b"))
    on = (F.col("bucket") == F.col("bucket_b")) & (F.col("part_a") != F.col("part_b")) & ((F.col("a") < F.col("b")) | ~F.col("out_b"))
    pairs = a.join(b, on & (F.expr(FIRST) if first else F.lit(True)) & agreeing())
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def opened(rows: DataFrame) -> DataFrame:
    """Rows (bucket, place, id, part, n, sketch, bits) of texts by pairs of sketches at most TABLES // AGREE tables apart."""
    pairs = [(t, (t + k) % TABLES) for t in range(TABLES) for k in range(1, TABLES // AGREE + 1)]
    keys = F.array(*(F.xxhash64(F.lit(i), F.col("sketch")[t], F.col("sketch")[u]) for i, (t, u) in enumerate(pairs)))
    texts = rows.select("id", "part", "n", "sketch", "bits").dropDuplicates(["id"])
    return texts.select("id", "part", "n", "sketch", "bits", F.lit(0).alias("place"), F.explode(keys).alias("bucket"))


def classes(rows: DataFrame) -> DataFrame:
    """(id, part) of rows (id long, text): the least id of each row's class."""
    own = stash(sketched(rows))
    k = files(own.count())
    one = stash(own.groupBy("copy").agg(F.min(F.struct("id", "n", "sketch", "bits")).alias("first")).select("copy", "first.*"), k)
    entries = one.select("id", F.posexplode("sketch").alias("place", "bucket"))
    hubs = entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("texts"), F.min("id").alias("hub"))
    members = stash(entries.join(stash(hubs.where("texts > 1").drop("texts"), k), "bucket"), k)
    within = stash(one.join(members.select("id").distinct(), "id", "left_semi").select("id", "n", "sketch", "bits"), k)
    texts = stash(rows.select("id", "text").join(within.select("id"), "id", "left_semi"), k)

    stars = members.where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    stars = stars.join(side(within, "a"), "a").join(side(within, "b"), "b").where(agreeing())
    links = stash(verified(stars.select("a", "b"), texts))

    places = members.select("bucket", (F.col("place") + 1).alias("place"), "id")
    left = places.join(stash(grouped(within.select("id"), links), k), "id")
    for turn in range(HUB_ROUNDS):
        left = left_over(left, k)
        links = stash(links.union(verified(stash(hubbed(left, within, turn, k).distinct(), k), texts)))
        left = left.select("bucket", "place", "id").join(stash(grouped(within.select("id"), links), k), "id")
    left = stash(left_over(left, k), k)
    pairs = crossed(left.where(F.col("outside") <= OUTSIDE).join(within, "id"), first=True)
    full = left.where(F.col("outside") > OUTSIDE)
    if full.limit(1).count():
        pairs = pairs.union(crossed(left_over(opened(full.join(within, "id")), k), first=False))
    links = stash(links.union(verified(stash(pairs.distinct(), k), texts)))

    final = stash(grouped(one.select("copy", "id"), links), k).select("copy", "part")
    return own.select("id", "copy").join(final, "copy").select("id", "part")


def report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, class_id) of every row: class_id is the least key among its copies and near-duplicates."""
    rows = numbered(docs, key, text)
    found = stash(classes(rows))
    named = found.join(rows.select("id", "key"), "id")
    least = named.groupBy("part").agg(F.min("key").alias("class_id"))
    return named.join(least, "part").select(F.col("key").alias(key), "class_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The docs, with all their columns, less all but the first row (by id) of each class."""
    row = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    unique = numbered(row, "key", "text", also=("row",))
    extra = stash(classes(unique)).where("id <> part").select("id")
    return unique.join(extra, "id", "left_anti").select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))
