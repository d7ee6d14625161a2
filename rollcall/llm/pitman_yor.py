"""Language-model scores by a hierarchical Pitman-Yor model.

Restaurants. A word's tokens sit in one restaurant of words. What it serves at a new table is drawn, half and half, from
the training words with one more for whatever is unseen, all alike, as in the base score, or by spelling a word letter by
letter (bytes, then an end) in restaurants of letters whose contexts are the last three, two, one and no letters of the word so far. Contexts
share parents: (y, x, b) and (z, x, b) both order from (x, b), that from (b), that from the one without context, and that
from the uniform distribution. A text's tokens are its words and one end, spelled as the empty word.

Seating. What is kept of a dish in a restaurant is its customers and its tables. In a round of Gibbs sampling, from the
words up, customers leave and sit down again: each dish's LOTS lots in turn, one customer a lot where a dish has LOTS
customers or less. A customer that leaves takes its table along if it sits alone, with the chance that this seating has
among all of c customers at t tables (exact up to EXACT customers, beyond by its limit, the discount's share of tables);
then it opens a table or joins one by the Chinese restaurant process. Every table is a customer of the parent, so tables
that come and go upset the letters' restaurants before their own sweep. The seating is carried from round to round. After
BURN rounds, the predictive probabilities of SAMPLES rounds are averaged, not the seatings.

Approximations: a lot's customers leave and sit down at once, with the chances at its middle; how many tables the other
dishes of a restaurant hold is what they held when the sweep began, so dishes are independent of each other and of how
they are spread over tasks; and words are seated against their spelling by one letter of context, as the longer contexts
are spread over tasks, while scores use three.

Random numbers are digests of the round, the restaurant and the dish, so scores don't depend on partitions or batches.

Distribution. Words and their counts are one table. What occurs once in training has one customer at one table for good, so
it is counted once and takes no part in the rounds. Words are in parts by their digest, about WORDS_A_PART a part, as arrays. Restaurants with two or three letters are spread by
their last two letters, at most 258**2 dishes each; those with one letter or none have 258**2 numbers in all and are
seated by the driver. To score, texts go in
blocks of about BLOCK bytes, as lists of distinct words and the tokens' numbers among them; a block asks each part
for its words there in one row, packed, and for letter sequences by an equi-join, so no model is broadcast and no row depends on
how often a word occurs. Words are compared whole.

Contexts. With order 2, as the query asks, a token sits in the restaurant of the token before it, a text's first in that of
the end; tables there are the customers of the restaurant of words. With order 1 all tokens sit in that one. Pairs of words
are spread by the first, in PARTS_A_BLOCK parts a block. A block's pairs go to their parts once, packed: there they are counted,
and the block's question becomes a place for each pair, 0 if it is not in training, 1 if once, else of a dish. A part holds the
dishes of two customers or more as arrays, and of the others, which never move, how many tables they hold in each restaurant.
In a round it tells each part of the words, in one row, how many tables serve which words, and gets what serves them back in
one row: nothing is moved by word. Words and pairs are told apart by 64-bit digests there. A restaurant's distinct dishes are in
one task. Pairs are seated against the words as their last round left them.

Defined results: a null text counts as empty, one end; a null key trains; repeated rows count as often as they occur; an
empty table gives an empty result; without training rows the scores come from the uniform distribution and the base from
no counts; other columns don't take part. Equal words are one dish, so ties can't occur. A very long text is a block by
itself; its distinct words are spelled AT_ONCE bytes at a time, a longer word alone. Jobs run while the plan is built.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.sources.shared import spread

from .common import discard, mapped, numbered, slices, stash
from .words import MIX, mixed

#: Bytes of text in a block, bytes of words that are spelled at a time; rounds before the first sample, and samples.
BLOCK, AT_ONCE, BURN, SAMPLES = 14 << 20, 1 << 18, 2, 3
#: Lots of a dish in a sweep; customers up to which the chance of sitting alone is exact; mean from which a draw is normal.
LOTS, EXACT, NORMAL = 32, 64, 30.0
#: The part of the parent of words that is uniform; the other part spells.
UNIFORM = 0.5
#: Discounts and strengths: of words, then of letters by the length of the context.
WORD_DISCOUNT, WORD_STRENGTH = 0.7, 10.0
DISCOUNT, STRENGTH = (0.1, 0.3, 0.5, 0.7), (1.0, 1.0, 1.0, 1.0)
#: Those of the restaurants of a word before; parts of the pairs for each block.
PAIR_DISCOUNT, PAIR_STRENGTH, PARTS_A_BLOCK = 0.7, 10.0, 2
#: Words, and bytes of words, in a part.
WORDS_A_PART, BYTES_A_PART = 200_000, 4 << 20
#: After the 256 bytes come the end of a word and its start, the context of what has no letter before it.
END, START, LETTERS = 256, 257, 258


def tokens(text: str) -> list[bytes]:
    """A-Z in lower case, words between spaces and 0x09-0x0D, then the end as the empty word."""
    return [*text.encode().lower().split(), b""]


def held_out(key: str):
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 10 == 0, F.lit(False))


def blocked(rows: DataFrame, train: str) -> DataFrame:
    """(block, blob): rows (id, text, train) in blocks of about BLOCK bytes; a longer text is a block by itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, size = TaskContext.get().partitionId(), 0, 0
        number: dict[bytes, int] = {b"": 0}
        ids, flags, texts = [], [], []

        def out() -> pa.RecordBatch:
            block = (np.array(ids, np.int64), np.array(flags, bool), np.array([len(x) for x in texts], np.int64), b" ".join(number), np.concatenate(texts))
            blob = zstandard.ZstdCompressor(level=1).compress(pickle.dumps(block, protocol=5))
            return pa.RecordBatch.from_arrays([pa.array([part << 32 | n], pa.int64()), pa.array([blob], pa.binary())], ["block", "blob"])

        for b in slices(batches, "text", 1 << 20):
            for i, text, flag in zip(*(b.column(c).to_pylist() for c in ("id", "text", "train"))):
                words = tokens(text)
                for w in set(words).difference(number):
                    number[w] = len(number)
                ids.append(i)
                flags.append(flag)
                texts.append(np.array([number[w] for w in words], np.uint32))
            size += b.column("text").nbytes
            if size >= BLOCK:
                yield out()
                number, ids, flags, texts = {b"": 0}, [], [], []
                size, n = 0, n + 1
        if ids:
            yield out()

    return mapped(rows.select("id", "text", F.col(train).alias("train")), run, "block long, blob binary")


class Block:
    """ids and train flags of texts, tokens of each, its distinct words, and the tokens' numbers among them."""

    def __init__(self, blob: pa.Scalar):
        self.ids, self.train, self.sizes, words, self.tokens = pickle.loads(zstandard.ZstdDecompressor().decompress(blob.as_py()))
        self.words = words.split(b" ")

    def counts(self) -> np.ndarray:
        """How often each word occurs in training texts."""
        return np.bincount(self.tokens[np.repeat(self.train, self.sizes)], minlength=len(self.words))

    def lots(self) -> Iterator[slice]:
        return lots(self.words)

    def codes(self) -> list[tuple[int, np.ndarray]]:
        """By kind, the codes of the letters and contexts that spell the words, in order."""
        code = np.zeros(0, np.int64)
        for lot in self.lots():
            code = np.union1d(code, spelled(self.words[lot])[1])
        short = np.unique(code % LETTERS**3)
        return [(3, code), (2, short), (13, np.unique(code // LETTERS)), (12, np.unique(short // LETTERS))]


def lots(words: list[bytes]) -> Iterator[slice]:
    """The words in lots of about AT_ONCE bytes."""
    place = np.cumsum([len(w) + 4 for w in words]) // AT_ONCE
    edges = [0, *(np.flatnonzero(np.diff(place)) + 1).tolist(), len(words)]
    for lo, hi in zip(edges, edges[1:]):
        yield slice(lo, hi)


def spelled(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(word, code) of every letter of every word, its end included: code has the three letters before it and itself."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 4)
    flat = np.full(int(ends[-1]) if len(words) else 0, START, np.int64)
    own = np.repeat(np.arange(len(words)), sizes + 4)
    place = np.arange(len(flat)) - np.repeat(ends - sizes - 4, sizes + 4)
    letter = (place >= 3) & (place < 3 + np.repeat(sizes, sizes + 4))
    flat[letter] = np.frombuffer(b"".join(words), np.uint8)
    flat[ends - 1] = END
    at = np.flatnonzero(place >= 3)
    code = ((flat[at - 3] * LETTERS + flat[at - 2]) * LETTERS + flat[at - 1]) * LETTERS + flat[at]
    return own[at], code


def digests(words: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)


def draws(key: np.ndarray, *salt: int) -> np.ndarray:
    """Numbers between 0 and 1 by the dishes' keys and what they are drawn for."""
    for s in salt:
        key = mixed(key + np.array([s + 1], np.uint64) * MIX)
    return ((key >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def binomial(m: np.ndarray, chance: np.ndarray, key: np.ndarray, *salt: int) -> np.ndarray:
    """How many of m succeed, by inversion; rounded from a normal number where the mean and its rest are above NORMAL."""
    u = draws(key, *salt, 0)
    out = (u < chance).astype(np.int64)
    mean = m * chance
    wide = (m > 1) & (mean > NORMAL) & (m - mean > NORMAL)
    if wide.any():
        z = np.sqrt(-2 * np.log(u[wide])) * np.cos(2 * np.pi * draws(key[wide], *salt, 1))
        out[wide] = np.rint(mean[wide] + z * np.sqrt(mean[wide] * (1 - chance[wide])))
    few = np.flatnonzero((m > 1) & ~wide)
    if len(few):
        q, n = chance[few], m[few]
        turned = q > 0.5
        q = np.where(turned, 1 - q, q)
        left, part, k = u[few].copy(), np.exp(n * np.log1p(-q)), np.zeros(len(few), np.int64)
        open_ = np.arange(len(few))
        while len(open_):
            left[open_] -= part[open_]
            open_ = open_[(left[open_] > 0) & (k[open_] < n[open_])]
            part[open_] *= (n[open_] - k[open_]) / (k[open_] + 1) * q[open_] / (1 - q[open_])
            k[open_] += 1
        out[few] = np.where(turned, n - k, k)
    return np.clip(out, 0, m)


@lru_cache(maxsize=8)
def alone(discount: float) -> np.ndarray:
    """By customers c and tables t, up to EXACT: how many of c customers at t tables sit alone on average."""
    s = np.zeros((EXACT + 1, EXACT + 1))  # generalized Stirling numbers
    s[0, 0] = 1
    k = np.arange(EXACT + 1)
    for n in range(1, EXACT + 1):
        s[n, 1:] = s[n - 1, :-1]
        s[n] += np.where(k < n, (n - 1 - discount * k) * s[n - 1], 0)
    out = np.zeros_like(s)
    np.divide(k[1:, None] * s[:-1, :-1], s[1:, 1:], out=out[1:, 1:], where=s[1:, 1:] > 0)
    return out


def left(c: np.ndarray, t: np.ndarray, m: np.ndarray, discount: float, key: np.ndarray, *salt: int) -> np.ndarray:
    """The tables that stay when m of c customers leave; one at least while a customer stays."""
    few = np.minimum(c, EXACT)
    single = np.where(c <= EXACT, alone(discount)[few, np.minimum(t, few)], np.maximum(discount * t, 2 * t - c))
    gone = binomial(m, single / np.maximum(c, 1), key, *salt)
    return np.clip(t - gone, np.minimum(1, c - m), np.minimum(t, c - m))


def seated(c: np.ndarray, c0: np.ndarray, t0: np.ndarray, p: np.ndarray, others: np.ndarray, discount: float, strength: float, key: np.ndarray, *salt: int) -> np.ndarray:
    """Tables of dishes that the parent serves with probability p, beside `others` tables, when customers come or leave
    until c0 at t0 tables are c: newcomers one by one up to LOTS / 2 seated ones, then in lots of their LOTS / 2th part."""
    t = t0.astype(np.int64)
    fewer = np.flatnonzero(c < c0)
    t[fewer] = left(c0[fewer], t[fewer], (c0 - c)[fewer], discount, key[fewer], *salt, 1)
    now = np.minimum(c0, c).astype(np.int64)
    first = (now == 0) & (c > 0)
    t[first], now[first] = 1, 1
    who, n = np.flatnonzero(now < c), 0
    while len(who):
        m = np.minimum(np.maximum(1, now[who] * 2 // LOTS), c[who] - now[who])
        a = (strength + discount * (others[who] + t[who])) * p[who]
        t[who] += binomial(m, a / (a + now[who] + (m - 1) / 2 - discount * t[who]), key[who], *salt, 2, n)
        now[who] += m
        who, n = who[now[who] < c[who]], n + 1
    return t


def sweep(c: np.ndarray, t: np.ndarray, p: np.ndarray, others: np.ndarray, discount: float, strength: float, key: np.ndarray, *salt: int) -> np.ndarray:
    """The tables after each of the LOTS lots of a dish's customers has left and sat down again."""
    t = t.astype(np.int64)
    active = np.flatnonzero(c > 1)  # one customer has one table
    for k in range(LOTS):
        active = active[c[active] > k]
        if not len(active):
            break
        n, own = c[active], key[active]
        m = n // LOTS + (k < n % LOTS)
        stay = left(n, t[active], m, discount, own, *salt, 3, k)
        a = (strength + discount * (others[active] + stay)) * p[active]
        t[active] = stay + binomial(m, a / (a + n - m + (m - 1) / 2 - discount * stay), own, *salt, 4, k)
    return t


def sums(index: np.ndarray, values: np.ndarray) -> np.ndarray:
    """For each row, the sum of values over the rows with its index."""
    return np.bincount(index, values)[index]


def sat(index: np.ndarray, c: np.ndarray, c0: np.ndarray, t0: np.ndarray, p: np.ndarray, k: int, key: np.ndarray, *salt: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A round in the restaurants `index` of contexts of k letters, which held c0 customers at t0 tables: tables, predictive
    probability, and what part of it the parent gives."""
    t = seated(c, c0, t0, p, sums(index, t0) - t0, DISCOUNT[k], STRENGTH[k], key, *salt, k)
    t = sweep(c, t, p, sums(index, t) - t, DISCOUNT[k], STRENGTH[k], key, *salt, k)
    total, tables = sums(index, c), sums(index, t)
    beyond = (STRENGTH[k] + DISCOUNT[k] * tables) / (STRENGTH[k] + total)
    return t, (c - DISCOUNT[k] * t) / (STRENGTH[k] + total) + beyond * p, beyond


class Short:
    """Restaurants with one letter of context and none, as matrices: served[b, s] is the probability of s after b."""

    def __init__(self):
        self.served = np.full((LETTERS, END + 1), 1 / (END + 1))
        self.c, self.t = np.zeros((2, LETTERS, END + 1), np.int64)
        self.root_c, self.root_t = np.zeros((2, END + 1), np.int64)
        self.root = np.full(END + 1, 1 / (END + 1))

    def update(self, rows: list[tuple[int, int, int]], seed: int) -> None:
        """A round over rows (b, s, customers), all tables' orders."""
        uniform = 1 / (END + 1)
        b, s, c = (np.array(x, np.int64) for x in zip(*sorted(rows)))
        key = (b * LETTERS + s).astype(np.uint64)
        t, _, _ = sat(b, c, self.c[b, s], self.t[b, s], self.root[s], 1, key, seed)
        self.c[b, s], self.t[b, s] = c, t
        own = np.bincount(s, t, END + 1).astype(np.int64)
        dishes = np.flatnonzero(own)
        tables, p, beyond = sat(np.zeros(len(dishes), np.int64), own[dishes], self.root_c[dishes], self.root_t[dishes], np.full(len(dishes), uniform), 0, dishes.astype(np.uint64), seed)
        self.root_c[dishes], self.root_t[dishes] = own[dishes], tables
        self.root = np.full(END + 1, beyond[0] * uniform)
        self.root[dishes] = p
        total, held = sums(b, c), sums(b, t)
        beyond = (STRENGTH[1] + DISCOUNT[1] * held) / (STRENGTH[1] + total)
        self.served = np.tile(self.root, (LETTERS, 1))
        self.served[b] *= beyond[:, None]
        self.served[b, s] = (c - DISCOUNT[1] * t) / (STRENGTH[1] + total) + beyond * self.root[s]


def vocabulary(blocks: DataFrame) -> DataFrame:
    """(word, c): how often each word occurs in training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for blob in b.column("blob"):
                block = Block(blob)
                count = block.counts()
                seen = np.flatnonzero(count)
                yield pa.RecordBatch.from_arrays([pa.array([block.words[i] for i in seen], pa.binary()), pa.array(count[seen])], ["word", "c"])

    return mapped(blocks.select("blob"), run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def parent(spelling: np.ndarray, types: int) -> np.ndarray:
    """What words' tables are ordered from, by the probability of each word's spelling."""
    return UNIFORM / (types + 1) + (1 - UNIFORM) * spelling


#: Kinds of rows: seats as arrays; what parts of words and of pairs tell each other, `at` the other's part; a block's
#: places, `at` the block; how often, n, a letter is spelled after three others, `at` their code; words that occur once.
SEATED, TOLD, ASKED, LETTER, ONCE = 0, 1, 2, 3, 4
#: Kinds of a block's answers, above those of letters.
WORDS, PAIRS = 100, 101
ROWS = "kind tinyint, part int, at long, blob binary, n long"


def packed(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(arrays, protocol=5))


def unpacked(blob: pa.Scalar) -> tuple[np.ndarray, ...]:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(blob.as_py()))


def narrow(x: np.ndarray) -> np.ndarray:
    """Numbers from 0 on in as few bytes as the largest needs."""
    return x.astype(np.min_scalar_type(int(x.max(initial=0))))


def listed(part: int, rows: list[tuple[int, int, bytes, int]], code: np.ndarray = np.zeros(0, np.int64), many: np.ndarray = np.zeros(0, np.int64)) -> pa.Table:
    """ROWS of a part: rows (kind, at, blob, n), then letters' codes and numbers."""
    kind, at, blob, n = zip(*rows)
    columns = [
        pa.array(np.concatenate([kind, np.full(len(code), LETTER)]), pa.int8()),
        pa.array(np.full(len(rows) + len(code), part), pa.int32()),
        pa.array(np.concatenate([np.array(at, np.int64), code]), pa.int64()),
        pa.concat_arrays([pa.array(blob, pa.binary()), pa.nulls(len(code), pa.binary())]),
        pa.array(np.concatenate([np.array(n, np.int64), many]), pa.int64()),
    ]
    return pa.table(columns, names=["kind", "part", "at", "blob", "n"])


def part_of(h: np.ndarray, parts: int) -> np.ndarray:
    return (mixed(h) % np.uint64(parts)).astype(np.int64)


def dealt(part: np.ndarray) -> dict[int, np.ndarray]:
    """By part, the places of its rows, in order."""
    order = np.argsort(part, kind="stable")
    found, first = np.unique(part[order], return_index=True)
    return dict(zip(found.tolist(), np.split(order, first[1:])))


def joined(words: list[bytes]) -> np.ndarray:
    return np.frombuffer(b" ".join(words), np.uint8)


def parted(words: np.ndarray) -> list[bytes]:
    return words.tobytes().split(b" ")


def told_to(rows: DataFrame):
    """What the other side told the parts, grouped by them."""
    return spread(rows.where(F.col("kind") == TOLD).select(F.col("at").cast("int").alias("to"), F.col("part").alias("sender"), "blob"), "to").groupBy("to")


def words_counted(words: DataFrame, told: DataFrame | None, parts: int) -> DataFrame:
    """ROWS with the words (word, c) in parts. Seats of those that occur twice or more: words by digest, their counts, customers
    that never move, and customers and tables by round. The others, and how often they spell each letter after three others.
    told: of pairs; without it all of a word's tokens are its customers."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = digests(b.column("word").to_pylist())
            columns = [pa.array(part_of(h, parts), pa.int32()), b.column("word"), pa.array(h.view(np.int64)), b.column("c")]
            yield pa.RecordBatch.from_arrays(columns, ["part", "word", "h", "c"])

    def run(rows: pa.Table, told: pa.Table | None) -> pa.Table:
        if not rows.num_rows:
            return listed(0, [(TOLD, 0, b"", 0)])[:0]
        h, c = rows.column("h").to_numpy().view(np.uint64), rows.column("c").to_numpy()
        order = np.argsort(h)
        lone, order = order[c[order] == 1], order[c[order] > 1]
        take = lambda x: rows.column("word").take(pa.array(x)).to_pylist()
        out, code, many = [], np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(lone):
            words = take(lone)
            out.append((ONCE, 0, packed(joined(words)), 0))
            for lot in lots(words):
                code, back = np.unique(np.concatenate([code, spelled(words[lot])[1]]), return_inverse=True)
                many = np.bincount(back, np.concatenate([many, np.ones(len(back) - len(many), np.int64)]), len(code)).astype(np.int64)
        if len(order):
            h, words, c = h[order], take(order), c[order]
            still, n = c, c
            if told is not None:
                still, n = np.zeros((2, len(h)), np.int64)
                for blob in told.column("blob"):
                    which, now, alone = unpacked(blob)
                    at = np.minimum(np.searchsorted(h, which), len(h) - 1)
                    known = h[at] == which
                    still[at[known]] += alone[known]
                    n[at[known]] += now[known]
                n += still
            out.append((SEATED, 0, packed(joined(words), c, still, n[None], np.ones((1, len(h)), np.int64)), 0))
        return listed(rows.column("part")[0].as_py(), out, code, many)

    rows = spread(mapped(words, deal, "part int, word binary, h long, c long"), "part").groupBy("part")
    return rows.applyInArrow(lambda rows: run(rows, None), ROWS) if told is None else rows.cogroup(told_to(told)).applyInArrow(run, ROWS)


def words_seated(state: DataFrame, told: DataFrame | None, served: np.ndarray, types: int, tables: int, seed: int, last: bool) -> DataFrame:
    """ROWS of the words after one more round: seats, with the customers in n and the tables in `at`; answers to what pairs told,
    except in the last round; and how often a part's tables spell each letter after three others. `tables` are all that words hold."""

    def run(part: int, blob: pa.Scalar, told: list[tuple[int, pa.Scalar]]) -> pa.Table:
        words, c, still, ns, ts = unpacked(blob)
        words, n = parted(words), still.copy()
        key, p, codes = digests(words), np.empty(len(words)), []
        for lot in lots(words):
            own, code = spelled(words[lot])
            p[lot] = parent(np.exp(np.bincount(own, np.log(served[code // LETTERS % LETTERS, code % LETTERS]), lot.stop - lot.start)), types)
            codes.append((own + lot.start, code))
        asked = []
        for sender, blob in told:
            which, now, _ = unpacked(blob)
            which, now = which[now > 0], now[now > 0]
            at = np.searchsorted(key, which)
            n[at] += now
            asked.append((sender, at))
        others = tables - ts[-1]
        t = seated(n, ns[-1], ts[-1], p, others, WORD_DISCOUNT, WORD_STRENGTH, key, seed, 8)
        t = sweep(n, t, p, others, WORD_DISCOUNT, WORD_STRENGTH, key, seed, 9)
        state = packed(joined(words), c, still, np.concatenate([ns, n[None]]), np.concatenate([ts, t[None]]))
        rows = [(SEATED, int(t.sum()), state, int(n.sum()))]
        if not last:
            rows += [(TOLD, sender, packed(n[at] - WORD_DISCOUNT * t[at], p[at]), 0) for sender, at in asked]
        own, code = (np.concatenate(x) for x in zip(*codes))
        code, back = np.unique(code, return_inverse=True)
        return listed(part, rows, code, np.bincount(back, t[own], len(code)).astype(np.int64))

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, blob in zip(b.column("part").to_pylist(), b.column("blob")):
                yield from run(part, blob, []).to_batches()

    def together(rows: pa.Table, told: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return listed(0, [(TOLD, 0, b"", 0)])[:0]
        return run(rows.column("part")[0].as_py(), rows.column("blob")[0], list(zip(told.column("sender").to_pylist(), told.column("blob"))))

    seats = state.where(F.col("kind") == SEATED).select("part", "blob")
    if told is None:
        return mapped(seats, alone, ROWS)
    return spread(seats, "part").groupBy("part").cogroup(told_to(told)).applyInArrow(together, ROWS)


def letter_counts(state: DataFrame, once: DataFrame) -> DataFrame:
    """(code, c): how often the words' tables spell each letter after three others; once: those of words that occur once."""
    rows = state.unionAll(once).where(F.col("kind") == LETTER).select(F.col("at").alias("code"), F.col("n").alias("c"))
    return rows.groupBy("code").agg(F.sum("c").alias("c"))


def key_of(kind: int, code: np.ndarray) -> list[bytes]:
    """Keys of letters and contexts: the kind, then the code; in Model.answers a word's is a 0 before the word."""
    raw = code.astype(">u8").tobytes()
    return [bytes([kind]) + raw[i : i + 8] for i in range(0, len(raw), 8)]


def letter_tables(counts: DataFrame, before: DataFrame | None, served: np.ndarray, seed: int) -> DataFrame:
    """(kind, code, p, c, t) of the restaurants with three and two letters after a round against `served`; before: the same
    after the last round.

    Kinds: 3 and 2 are a letter after so many others, with its predictive probability, customers and tables; 13 and 12 are
    contexts of that length, with the part that their parents give. All that share the last two letters meet in a task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lots = [b for b in batches if b.num_rows]
        if not lots:
            return
        kind, code, c, t = (np.concatenate([b.column(x).to_numpy() for b in lots]) for x in ("kind", "code", "c", "t"))

        def held(k: int, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Customers and tables of the wanted codes after the last round."""
            mine = np.flatnonzero(kind == k)
            mine = mine[np.argsort(code[mine])]
            at = np.minimum(np.searchsorted(code[mine], wanted), max(0, len(mine) - 1))
            known = code[mine][at] == wanted if len(mine) else np.zeros(len(wanted), bool)
            return tuple(np.where(known, x[mine][at], 0) if len(mine) else np.zeros(len(wanted), np.int64) for x in (c, t))

        new = np.flatnonzero(kind == 0)
        new = new[np.argsort(code[new])]
        wanted, n = code[new], c[new]
        shorter, up = np.unique(wanted % LETTERS**3, return_inverse=True)
        _, own3 = np.unique(wanted // LETTERS, return_inverse=True)
        _, own2 = np.unique(shorter // LETTERS, return_inverse=True)
        above = served[shorter // LETTERS % LETTERS, shorter % LETTERS]
        c2, t2 = held(2, shorter)
        beyond2 = (STRENGTH[2] + DISCOUNT[2] * sums(own2, t2)) / (STRENGTH[2] + sums(own2, c2))
        p2 = (c2 - DISCOUNT[2] * t2) / (STRENGTH[2] + sums(own2, c2)) + beyond2 * above  # as the last round left it
        t3, p3, beyond3 = sat(own3, n, *held(3, wanted), p2[up], 3, wanted.astype(np.uint64), seed)
        n2 = np.bincount(up, t3).astype(np.int64)
        t2, p2, beyond2 = sat(own2, n2, c2, t2, above, 2, shorter.astype(np.uint64), seed)
        p3 = (n - DISCOUNT[3] * t3) / (STRENGTH[3] + sums(own3, n)) + beyond3 * p2[up]
        first3, first2 = np.unique(own3, return_index=True)[1], np.unique(own2, return_index=True)[1]
        parts = [(3, wanted, p3, n, t3), (2, shorter, p2, n2, t2), (13, wanted[first3] // LETTERS, beyond3[first3], 0 * first3, 0 * first3), (12, shorter[first2] // LETTERS, beyond2[first2], 0 * first2, 0 * first2)]
        for k, x, p, a, b in parts:
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), k, np.int8)), pa.array(x), pa.array(p, pa.float64()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["kind", "code", "p", "c", "t"])

    rows = counts.select(F.lit(0).cast("tinyint").alias("kind"), "code", "c", F.lit(0).cast("long").alias("t"))
    if before is not None:
        rows = rows.unionAll(before.where("kind < 10").select("kind", "code", "c", "t"))
    spread = rows.repartition((F.col("code") / LETTERS).cast("long") % LETTERS**2)
    return mapped(spread, run, "kind tinyint, code long, p double, c long, t long")


class Pairs:
    """A block's distinct pairs of a token (v) and the token before it (u), numbers among its words; place: each token's pair;
    h: the words' digests; lots: by part, the pairs in it."""

    def __init__(self, block: Block, parts: int):
        starts = np.concatenate([[0], np.cumsum(block.sizes)[:-1]])
        pair = np.roll(block.tokens, 1).astype(np.int64)
        pair[starts] = 0  # the end
        pair *= len(block.words)
        pair += block.tokens
        pair, self.place = np.unique(pair, return_inverse=True)
        self.u, self.v = pair // len(block.words), pair % len(block.words)
        self.count = np.bincount(self.place[np.repeat(block.train, block.sizes)], minlength=len(pair))
        self.h = digests(block.words)
        self.lots = dealt(part_of(self.h, parts)[self.u])


def pair_keys(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    return mixed(mixed(u) + v)


def pair_questions(blocks: DataFrame, parts: int) -> DataFrame:
    """(part, block, blob) of each block's pairs in a part: contexts' digests, pairs' places among them, words' digests and
    counts in training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, blob in zip(b.column("block").to_pylist(), b.column("blob")):
                pairs = Pairs(Block(blob), parts)
                for part, lot in pairs.lots.items():
                    contexts, own = np.unique(pairs.h[pairs.u[lot]], return_inverse=True)
                    one = packed(contexts, own.astype(np.uint32), pairs.h[pairs.v[lot]], pairs.count[lot])
                    yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([i], pa.int64()), pa.array([one], pa.binary())], ["part", "block", "blob"])

    return mapped(blocks, run, "part int, block long, blob binary")


class Counted:
    """The distinct pairs of a part's questions: contexts, own (a training pair's context among them), its word v and count c, in
    the order of pair_keys(); place: of every pair asked for, 0 if not in training, 1 if once, else 2 and more by order."""

    def __init__(self, blobs: pa.ChunkedArray):
        self.lots = [unpacked(x) for x in blobs]
        u, v, c = (np.concatenate(x) for x in zip(*((contexts[own], words, n) for contexts, own, words, n in self.lots)))
        _, first, back = np.unique(pair_keys(u, v), return_index=True, return_inverse=True)
        c = np.bincount(back, c, len(first)).astype(np.int64)
        self.place = np.where(c > 1, np.cumsum(c > 1) + 1, c).astype(np.uint32)[back]
        first, self.c = first[c > 0], c[c > 0]
        self.v = v[first]
        self.contexts, self.own = np.unique(u[first], return_inverse=True)

    def places(self) -> Iterator[bytes]:
        """For each question: pairs' places, and contexts' places here, customers, and tables that never move."""
        lone = self.c == 1
        customers, still = np.bincount(self.own, self.c, len(self.contexts) + 1), np.bincount(self.own[lone], minlength=len(self.contexts) + 1)
        edges = np.cumsum([len(own) for _, own, _, _ in self.lots])
        for (contexts, *_), place in zip(self.lots, np.split(self.place, edges[:-1])):
            up = np.searchsorted(self.contexts, contexts)
            known = np.append(self.contexts, [np.uint64(0)])[up] == contexts
            up = np.where(known & (up < len(self.contexts)), up, len(self.contexts)).astype(np.uint32)
            yield packed(place, up, customers[up].astype(np.int64), still[up])


def pairs_counted(asked: DataFrame, word_parts: int) -> DataFrame:
    """ROWS of all training pairs, each dish at one table: seats (contexts, own, words, counts, tables by round) of those with two
    customers or more and, by context, the tables of the others; for parts of words the tables of the two sorts that serve
    each word; places for each block."""

    def run(rows: pa.Table) -> pa.Table:
        pairs = Counted(rows.column("blob"))
        more = pairs.c > 1
        own, v = pairs.own[more], pairs.v[more]
        used = np.bincount(own, minlength=len(pairs.contexts)) > 0
        still = np.bincount(pairs.own[~more], minlength=len(used))
        seats = packed(np.where(used, pairs.contexts, np.uint64(0)), own.astype(np.uint32), v, pairs.c[more], np.ones((1, len(v)), np.int64), still)
        words, back = np.unique(pairs.v, return_inverse=True)
        now, alone = (np.bincount(back[x], minlength=len(words)) for x in (more, ~more))
        out = [(SEATED, 0, seats, 0), *((TOLD, at, packed(words[x], now[x], alone[x]), 0) for at, x in dealt(part_of(words, word_parts)).items())]
        out += [(ASKED, block, blob, 0) for block, blob in zip(rows.column("block").to_pylist(), pairs.places())]
        return listed(rows.column("part")[0].as_py(), out)

    return spread(asked, "part").groupBy("part").applyInArrow(run, ROWS)


def pairs_seated(seats: DataFrame, told: DataFrame, new: float, total: float, word_parts: int, seed: int, last: bool) -> DataFrame:
    """ROWS of the pairs after one more round: seats, after the last without digests, and the tables that serve each word. Words
    told (a, b): a word is served with (a + new * b) / total."""

    def run(rows: pa.Table, told: pa.Table) -> pa.Table:
        contexts, own, v, c, ts, still = unpacked(rows.column("blob")[0])
        words, back = np.unique(v, return_inverse=True)
        parts, served = dealt(part_of(words, word_parts)), np.full(len(words), np.nan)
        for sender, blob in zip(told.column("sender").to_pylist(), told.column("blob")):
            if sender in parts:
                a, b = unpacked(blob)
                served[parts[sender]] = (a + new * b) / total
        t = ts[-1]
        others = (still + np.bincount(own, t, len(contexts)).astype(np.int64))[own] - t
        t = sweep(c, t, served[back], others, PAIR_DISCOUNT, PAIR_STRENGTH, pair_keys(contexts[own], v), seed, 10)
        now = np.bincount(back, t, len(words)).astype(np.int64)
        ts = np.concatenate([ts, t[None]])
        out = [(SEATED, 0, packed(np.zeros_like(contexts), own, v[:0], narrow(c), narrow(ts), still) if last else packed(contexts, own, v, c, ts, still), 0)]
        out += [(TOLD, at, packed(words[x], now[x], words[:0]), 0) for at, x in parts.items()]
        return listed(rows.column("part")[0].as_py(), out)

    rows = spread(seats.where(F.col("kind") == SEATED).select("part", "blob"), "part")
    return rows.groupBy("part").cogroup(told_to(told)).applyInArrow(run, ROWS)


def pairs_listed(asked: DataFrame, seats: DataFrame) -> DataFrame:
    """(part, blob) of all training pairs: contexts, own, words, counts, tables by round."""

    def run(questions: pa.Table, state: pa.Table) -> pa.Table:
        pairs = Counted(questions.column("blob"))
        _, _, _, _, now, _ = unpacked(state.column("blob")[0])
        ts = np.ones((len(now), len(pairs.c)), np.int64)
        ts[:, pairs.c > 1] = now
        return pa.table([questions.column("part")[:1], pa.array([packed(pairs.contexts, pairs.own, pairs.v, pairs.c, ts)], pa.binary())], names=["part", "blob"])

    return asked.groupBy("part").cogroup(seats.groupBy("part")).applyInArrow(run, "part int, blob binary")


def pair_answers(asked: DataFrame, seats: DataFrame) -> DataFrame:
    """(block, part, blob) for places asked: each pair's customers and tables by sample, each context's too. seats: (part, blob),
    with pairs that never move or without."""

    def run(questions: pa.Table, state: pa.Table) -> pa.Table:
        blocks, blobs, part = [], [], questions.column("part")[0].as_py()
        contexts, own, _, c, ts, *_ = unpacked(state.column("blob")[0])
        own, ts, c = own[c > 1], ts[BURN : BURN + SAMPLES, c > 1], c[c > 1]
        all_t = np.array([np.bincount(own, t, len(contexts) + 1) for t in ts]).astype(np.int64)
        ends = np.tile([0, 1], (len(ts), 1))
        c, ts = narrow(np.concatenate([[0, 1], c])), narrow(np.concatenate([ends, ts], axis=1))
        for block, blob in zip(questions.column("block").to_pylist(), questions.column("blob")):
            place, up, customers, still = unpacked(blob)
            blocks.append(block)
            blobs.append(packed(c[place], ts[:, place], customers, all_t[:, up] + still))
        return pa.table([pa.array(blocks, pa.int64()), pa.array(np.full(len(blocks), part), pa.int32()), pa.array(blobs, pa.binary())], names=["block", "part", "blob"])

    return spread(asked, "part").groupBy("part").cogroup(spread(seats.select("part", "blob"), "part").groupBy("part")).applyInArrow(run, "block long, part int, blob binary")


def kept(df: DataFrame) -> DataFrame:
    """stash(df), whose shuffle files go when it is written, not when the driver happens to collect its garbage: nothing reads them
    again."""
    conf, name = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(name, None)
    conf.set(name, "true")
    try:
        return stash(df)
    finally:
        conf.unset(name) if before is None else conf.set(name, before)


class Model:
    """words and letters, the samples' matrices and numbers of word tables and customers, N and V.

    answers (key, c, v array, with order 2 ns): c is a word's count, v its tables in each sample, ns its customers; or v is a
    letter's or context's probabilities (then c is 0). stashes: what all of it is read from. words: ROWS of their parts. letters (key, v). asked and seats, with order 2: (part, block, blob) of the blocks' places, (part, blob) of the
    pairs of two customers or more; pairs: (part, blob) of all pairs, which are counted anew for it.
    """

    def __init__(self, blocks: DataFrame, order: int = 1):
        known = kept(vocabulary(blocks))
        types, total, lone, size = known.agg(F.count(F.lit(1)), F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") == 1, 1)), F.coalesce(F.sum(F.length("word")), F.lit(0))).first()
        self.blocks, self.types, self.total, self.asked, self.seats, self.parts = blocks, int(types), int(total), None, None, 0
        self.word_parts, self.stashes, told = 1 + max(types // WORDS_A_PART, size // BYTES_A_PART), [], None
        if order > 1 and self.total:
            self.parts = max(1, PARTS_A_BLOCK * blocks.count())
            told = kept(pairs_counted(pair_questions(blocks, self.parts), self.word_parts))
            self.asked = kept(told.where(F.col("kind") == ASKED).select("part", F.col("at").alias("block"), "blob"))
        if self.total:
            state = kept(words_counted(known, told, self.word_parts))
            once = kept(state.where(F.col("kind").isin(ONCE, LETTER)))
            discard(known)
        short, seats, tables, code = Short(), None, self.types, F.col("code")
        self.served, self.tables, self.customers, letters = [], [], [], []
        for r in range(BURN + SAMPLES if self.total else 0):
            last = r == BURN + SAMPLES - 1
            old, state = state, kept(words_seated(state, told, short.served, self.types, tables, r, last))
            discard(old)
            before, seats = seats, kept(letter_tables(letter_counts(state, once), seats, short.served, r))
            if before is not None and r <= BURN:
                discard(before)
            held, customers = state.where(F.col("kind") == SEATED).agg(F.coalesce(F.sum("at"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
            tables, customers = int(held) + lone, int(customers) + lone
            if r >= BURN:
                letters.append(seats.select("kind", "code", F.lit(r - BURN).alias("i"), "p"))
                self.served.append(short.served)
                self.tables.append(tables)
                self.customers.append(customers)
                self.stashes.append(seats)
            orders = seats.where("kind = 2").groupBy((code / LETTERS).cast("long") % LETTERS, code % LETTERS).agg(F.sum("t"))
            short.update([tuple(map(int, x)) for x in orders.collect()], r)  # at most 258 * 257
            if told is not None and not last:
                old, told = told, kept(pairs_seated(told, state, WORD_STRENGTH + WORD_DISCOUNT * tables, WORD_STRENGTH + customers, self.word_parts, r, r == BURN + SAMPLES - 2))
                discard(old)
        if not letters:
            self.served, self.tables, self.customers = [short.served], [0], [0]
            self.letters = blocks.sparkSession.createDataFrame([], "key binary, v array<float>")
            self.words = blocks.sparkSession.createDataFrame([], ROWS)
            return
        self.stashes += [state, once, *(x for x in (told, self.asked) if x is not None)]
        self.seats = None if told is None else told.where(F.col("kind") == SEATED).select("part", "blob")
        self.words = state.where(F.col("kind") == SEATED).unionAll(once.where(F.col("kind") == ONCE))
        rows = letters[0]
        for more in letters[1:]:
            rows = rows.unionAll(more)
        # every sample has the same codes: they are those of the vocabulary
        values = F.array(*(F.max(F.when(F.col("i") == i, F.col("p"))).cast("float") for i in range(SAMPLES)))
        key = F.concat(F.unhex(F.lpad(F.hex(F.col("kind").cast("long")), 2, "0")), F.unhex(F.lpad(F.hex("code"), 16, "0")))
        self.letters = rows.groupBy("kind", "code").agg(values.alias("v")).select(key.alias("key"), "v")

    @property
    def answers(self) -> DataFrame:
        """Rows of all words and letters; a report asks for `words` and `letters` apart."""
        rows = words_listed(self.words).unionAll(self.letters.select("key", F.lit(0).cast("long").alias("c"), "v", F.lit(None).cast("array<float>").alias("ns")))
        return rows if self.seats is not None else rows.drop("ns")

    @property
    def pairs(self) -> DataFrame | None:
        return None if self.seats is None else pairs_listed(pair_questions(self.blocks, self.parts), self.seats)


def words_of(kind: int, blob: pa.Scalar) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Words of a row of Model.words, their counts, and tables and customers by sample."""
    words, *numbers = unpacked(blob)
    words = parted(words)
    if kind == ONCE:
        ones = np.ones((SAMPLES, len(words)), np.int64)
        return words, ones[0], ones, ones
    c, _, ns, ts = numbers
    return words, c, ts[1 + BURN :], ns[1 + BURN :]


def words_listed(words: DataFrame) -> DataFrame:
    """(key, c, v, ns) of Model.words."""

    def longs(rows: np.ndarray) -> pa.Array:
        rows = np.ascontiguousarray(rows.T, np.float32)
        return pa.FixedSizeListArray.from_arrays(pa.array(rows.ravel()), rows.shape[1]).cast(pa.list_(pa.float32()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for kind, blob in zip(b.column("kind").to_pylist(), b.column("blob")):
                words, c, ts, ns = words_of(kind, blob)
                for lot in lots(words):
                    yield pa.RecordBatch.from_arrays([pa.array([b"\0" + w for w in words[lot]], pa.binary()), pa.array(c[lot]), longs(ts[:, lot]), longs(ns[:, lot])], ["key", "c", "v", "ns"])

    return mapped(words.select("kind", "blob"), run, "key binary, c long, v array<float>, ns array<float>")


def word_answers(blocks: DataFrame, words: DataFrame, parts: int) -> DataFrame:
    """(block, part, blob): counts, tables and customers by sample, of a block's words in a part of Model.words, in order."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, blob in zip(b.column("block").to_pylist(), b.column("blob")):
                block = Block(blob)
                for part, lot in dealt(part_of(digests(block.words), parts)).items():
                    yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([i], pa.int64()), pa.array([packed(joined([block.words[k] for k in lot]))], pa.binary())], ["part", "block", "blob"])

    def run(asked: pa.Table, seats: pa.Table) -> pa.Table:
        place: dict[bytes, int] = {}
        none = np.zeros((SAMPLES, 1), np.int64)
        numbers = [(none[0], none, none)]
        for kind, blob in zip(seats.column("kind").to_pylist(), seats.column("blob")):
            mine, *more = words_of(kind, blob)
            place.update(zip(mine, range(len(place) + 1, len(place) + len(mine) + 1)))
            numbers.append(more)
        c, ts, ns = (narrow(np.concatenate(x, axis=-1)) for x in zip(*numbers))
        blobs = []
        for blob in asked.column("blob"):
            at = np.array([place.get(w, 0) for w in parted(*unpacked(blob))], np.int64)
            blobs.append(packed(c[at], ts[:, at], ns[:, at]))
        return pa.table([asked.column("block"), asked.column("part"), pa.array(blobs, pa.binary())], names=["block", "part", "blob"])

    asked = spread(mapped(blocks, ask, "part int, block long, blob binary"), "part")
    return asked.groupBy("part").cogroup(spread(words.select("part", "kind", "blob"), "part").groupBy("part")).applyInArrow(run, "block long, part int, blob binary")


def questions(blocks: DataFrame) -> DataFrame:
    """(block, kind, n, key) of each block's letters and contexts: n is the place in the block's own list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, blob in zip(b.column("block").to_pylist(), b.column("blob")):
                block = Block(blob)

                def rows(kind: int, keys: list[bytes]) -> pa.RecordBatch:
                    n = len(keys)
                    columns = [pa.array(np.full(n, i)), pa.array(np.full(n, kind, np.int8)), pa.array(np.arange(n, dtype=np.int32)), pa.array(keys, pa.binary())]
                    return pa.RecordBatch.from_arrays(columns, ["block", "kind", "n", "key"])

                for kind, code in block.codes():
                    yield rows(kind, key_of(kind, code))

    return mapped(blocks, run, "block long, kind tinyint, n int, key binary")


def probabilities(words: list[bytes], codes: dict[int, np.ndarray], found: dict[int, np.ndarray], served: list[np.ndarray]) -> np.ndarray:
    """By sample and word, the probability of its spelling; found: by kind the values of the codes, NaN if unseen."""
    own, code = spelled(words)
    at3, at2 = np.searchsorted(codes[3], code), np.searchsorted(codes[2], code % LETTERS**3)
    up3, up2 = np.searchsorted(codes[13], code // LETTERS), np.searchsorted(codes[12], code // LETTERS % LETTERS**2)
    out = np.empty((len(served), len(words)))
    for i, matrix in enumerate(served):
        p = matrix[code // LETTERS % LETTERS, code % LETTERS]
        for at, up, k in ((at2, up2, 2), (at3, up3, 3)):
            beyond = found[10 + k][up, i]
            seen = found[k][at, i]
            p = np.where(np.isnan(seen), np.where(np.isnan(beyond), 1.0, beyond) * p, seen)
        out[i] = np.bincount(own, np.log(p), len(words))
    return np.exp(out)


def after(pairs: Pairs, p: np.ndarray, answers: dict[int, tuple[np.ndarray, ...]]) -> np.ndarray:
    """By sample and pair, the probability of its word after the one before; p: those of words by themselves."""
    out = p[:, pairs.v]
    for part, lot in pairs.lots.items():
        c, t, all_c, all_t = answers[part]
        own = np.unique(pairs.h[pairs.u[lot]], return_inverse=True)[1]
        out[:, lot] = (c - PAIR_DISCOUNT * t + (PAIR_STRENGTH + PAIR_DISCOUNT * all_t[:, own]) * out[:, lot]) / (PAIR_STRENGTH + all_c[own])
    return out


def report(docs: DataFrame, key: str = "doc_id", text: str = "text", order: int = 1) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row; scores are log10. order: 1 takes words
    by themselves, 2 after the word before."""
    rows = numbered(docs, key, text)
    blocks = kept(blocked(rows.withColumn("train", ~held_out("key")), "train"))
    model = Model(blocks, order)
    paired, parts, word_parts, all_customers = model.seats is not None, model.parts, model.word_parts, model.customers
    answers = questions(blocks).join(model.letters, "key").select("block", "kind", "n", "v", F.lit(None).cast("binary").alias("blob"))
    packs = [(WORDS, word_answers(blocks, model.words, word_parts))] if model.total else []
    if paired:
        packs.append((PAIRS, pair_answers(model.asked, model.seats)))
    for kind, more in packs:
        answers = answers.unionAll(more.select("block", F.lit(kind).cast("tinyint"), F.col("part"), F.lit(None).cast("array<float>"), "blob"))
    answers = kept(answers)
    discard(*model.stashes)
    served, tables, total, types = model.served, model.tables, model.total, model.types

    def run(blob_table: pa.Table, answer_table: pa.Table) -> pa.Table:
        columns: list[list] = [[] for _ in range(5)]
        kinds, places = answer_table.column("kind").to_numpy(), answer_table.column("n").to_numpy()
        packs = {kind: {n: unpacked(blob) for n, blob in zip(places[kinds == kind].tolist(), answer_table.column("blob").filter(pa.array(kinds == kind)))} for kind in (WORDS, PAIRS)}
        letters = kinds < WORDS
        values = answer_table.column("v").filter(pa.array(letters)).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(served))
        kinds, places = kinds[letters], places[letters]
        for blob in blob_table.column("blob"):
            block = Block(blob)
            codes, found = dict(block.codes()), {}
            for kind in codes:
                found[kind] = np.full((len(codes[kind]), len(served)), np.nan)
                mine = np.flatnonzero(kinds == kind)
                if len(mine):
                    found[kind][places[mine]] = values[mine]
            words = len(block.words)
            c, (t, n) = np.zeros(words, np.int64), np.zeros((2, len(served), words), np.int64)
            if packs[WORDS]:
                for part, lot in dealt(part_of(digests(block.words), word_parts)).items():
                    if part in packs[WORDS]:
                        c[lot], t[:, lot], n[:, lot] = packs[WORDS][part]
            p = np.zeros((len(served), words))
            for lot in block.lots():
                spelling = probabilities(block.words[lot], codes, found, served)
                for i, (all_tables, customers) in enumerate(zip(tables, all_customers)):
                    new = (WORD_STRENGTH + WORD_DISCOUNT * all_tables) * parent(spelling[i], types)
                    p[i, lot] = (n[i, lot] - WORD_DISCOUNT * t[i, lot] + new) / (WORD_STRENGTH + customers)
            place = block.tokens
            if paired:
                pairs = Pairs(block, parts)
                p, place = after(pairs, p, packs[PAIRS]), pairs.place
            log_p, base = np.log10(p.mean(axis=0)), np.log10((c + 0.1) / (total + 0.1 * (types + 1)))
            starts = np.concatenate([[0], np.cumsum(block.sizes)[:-1]])  # a text has one token at least, its end
            by_text = [np.add.reduceat(x[k], starts) for x, k in (((c > 0).astype(np.int64), block.tokens), (base, block.tokens), (log_p, place))]
            for column, x in zip(columns, (block.ids, block.sizes, *by_text)):
                column.append(x)
        kinds_out = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        whole = [np.concatenate(x) if x else np.zeros(0) for x in columns]
        return pa.table([pa.array(x.tolist(), k) for x, k in zip(whole, kinds_out)], names=["id", "n_tokens", "n_known", "base_score", "score"])

    scored = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, "id long, n_tokens long, n_known long, base_score double, score double")
    out = scored.join(rows.select("id", "key"), "id").select(F.col("key").alias(key), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
    return out.select(key, held_out(key).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
