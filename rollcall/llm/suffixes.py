"""Removal of repeated windows by a depth-limited radix sort of suffixes.

The suffixes of all texts (as UTF-8 bytes) are put in groups by their first WINDOW bytes, never further: after the last
pass, suffixes in one group start with the same window, and every group of two or more is a repeated window. Each byte
of such a window is removed. Passes go from the most significant digit down, and what is alone in its group leaves:

1. Digit one is a window's lowest-hashed GRAM of bytes (the first of equals): a function of the window alone, so equal
   windows agree on it. Neighbouring windows mostly share it, so a run of them is one row (some 70 bytes of text each)
   instead of one row a suffix. Groups of one leave here.
2. Digit two is the run's whole reach, from its first window's first byte to its last window's last. If all rows of a
   gram agree on it, or two do, all their windows are repeated.
3. The runs left, at the ends of repeated passages, are cut into bins of BIN neighbouring windows, by the windows' offsets
   from the gram, so that equal windows are in equal bins. A bin's digit is its core, the bytes that all windows with these
   offsets share: bins that are alone have no repeated window and leave; if all of a group agree on their reach, all their
   windows are repeated.
4. Only the bins left, where a repeated passage ends, are opened into single windows: the last digit is the window itself.

Digits are 64-bit digests, and the passes compare two of them (the gram's and the reach's, core's or window's) for each window.

Shuffles hold rows of a few numbers; hot groups are counted by partial aggregates or joined by plain equi-joins, whose
skewed partitions Spark splits. Texts are shuffled by key to cut runs into bins and to cut the removed bytes out.

Defined results: a null text counts as empty; texts shorter than WINDOW keep everything; rows that repeat, or share a key,
are documents of their own; an empty table gives an empty one; other columns don't take part. Ties: of equal lowest grams
of a window the first counts. A very long text is digested PIECE bytes at a time; its runs and spots are lists of one row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, numbered, slices, stash
from .words import mixed

#: Bytes of a window and of a gram, windows of a bin.
WINDOW, GRAM, BIN = 200, 40, 8
#: Bytes that are digested at a time; longer texts go in pieces that share all but one byte of a window.
PIECE = 1 << 17
U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
LETTERS = np.random.default_rng(20).integers(0, 1 << 64, 256, dtype=np.uint64)


class Powers:
    """BASE and its inverse modulo 2**64, to the powers 0, 1, 2, ..."""

    up = down = np.ones(1, U)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            n = 1 << (n - 1).bit_length()
            with np.errstate(over="ignore"):
                cls.up = np.cumprod(np.concatenate([np.ones(1, U), np.full(n - 1, BASE, U)]))
                cls.down = np.cumprod(np.concatenate([np.ones(1, U), np.full(n - 1, pow(BASE, -1, 1 << 64), U)]))
        return cls.up, cls.down


class Digests:
    """Digests of all substrings of some bytes, from one running sum."""

    def __init__(self, data: bytes):
        raw = np.frombuffer(data, np.uint8)
        self.n = len(raw)
        up, self.down = Powers.of(self.n + 1)
        self.sums = np.zeros(self.n + 1, U)
        np.cumsum(LETTERS[raw] * up[: self.n], out=self.sums[1:])

    def all(self, size: int) -> np.ndarray:
        n = self.n - size + 1
        return mixed((self.sums[size:] - self.sums[:n]) * self.down[:n])

    def at(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.down[start])


def lowest(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours."""
    n = len(x)
    full = -(-n // width) * width
    padded = np.full(full, np.iinfo(U).max, U)
    padded[:n] = x
    ahead = np.minimum.accumulate(padded.reshape(-1, width), axis=1).ravel()
    back = np.minimum.accumulate(padded.reshape(-1, width)[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def runs(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(text, first start, windows, offset of the gram in the first, gram digest, reach digest) of the runs of windows with
    one gram."""
    data = b"".join(texts)
    if len(data) < WINDOW:
        return (np.zeros(0, np.int64),) * 6
    d = Digests(data)
    gram = d.all(GRAM)
    low = U((1 << 24) - 1)
    first = (lowest((gram & ~low) | np.arange(len(gram), dtype=U), WINDOW - GRAM + 1) & low).astype(np.int64)
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(sizes)
    starts = np.arange(len(first))
    text = np.repeat(np.arange(len(texts)), sizes)[: len(first)]
    good = starts + WINDOW <= ends[text]
    starts, text, first = starts[good], text[good], first[good]
    if not len(starts):
        return (np.zeros(0, np.int64),) * 6
    new = np.flatnonzero(np.concatenate([[True], (first[1:] != first[:-1]) | (text[1:] != text[:-1])]))
    count = np.diff(np.concatenate([new, [len(starts)]]))
    q, p, own = starts[new], first[new], text[new]
    shape = mixed(((p - q).astype(U) << U(32)) | count.astype(U))
    reach = mixed(d.at(q, q + count + WINDOW - 1) ^ shape)
    return own, q - (ends - sizes)[own], count, p - q, gram[p], reach


def pieces(texts: list[bytes]) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """(texts, offsets, bytes) in lots of about PIECE bytes; every window is in one piece."""
    lot: tuple[list[int], list[int], list[bytes]] = ([], [], [])
    size = 0
    for i, t in enumerate(texts):
        for at in range(0, max(1, len(t) - WINDOW + 1), PIECE):
            part = t[at : at + PIECE + WINDOW - 1]
            if size and size + len(part) > PIECE + WINDOW:
                yield lot
                lot, size = ([], [], []), 0
            for column, value in zip(lot, (i, at, part)):
                column.append(value)
            size += len(part)
    if size:
        yield lot


def texts_of(batch: pa.RecordBatch) -> list[bytes]:
    return [t or b"" for t in batch.column("text").to_pylist()]


def occurrences(docs: DataFrame) -> DataFrame:
    """(gram, reach, id, at, n, off) of every run of docs (id long, text binary): n windows from byte `at` on, in the first of
    which the gram is `off` bytes in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            ids = np.array(b.column("id").to_pylist(), np.int64)
            for which, offsets, parts in pieces(texts_of(b)):
                own, q, n, off, gram, reach = runs(parts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (gram.view(np.int64), reach.view(np.int64), ids[np.array(which)[own]], np.array(offsets)[own] + q, n.astype(np.int16), off.astype(np.int16))],
                    ["gram", "reach", "id", "at", "n", "off"],
                )

    return mapped(docs, run, "gram long, reach long, id long, at long, n smallint, off smallint")


def binned(wanted: DataFrame) -> DataFrame:
    """(gram, core, reach, id, at, n, windows) of the bins of the runs that each text (id, text, runs) lists; windows are
    the digests of a bin's n windows."""

    def cut(t: bytes, lo: int, gram: np.ndarray, at: np.ndarray, n: np.ndarray, off: np.ndarray) -> list[pa.Array]:
        d = Digests(t[lo : lo + PIECE + 2 * WINDOW])
        run = np.repeat(np.arange(len(at)), n)
        step = np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
        q, offset = at[run] - lo + step, off[run] - step
        place = offset // BIN
        new = np.flatnonzero(np.concatenate([[True], (run[1:] != run[:-1]) | (place[1:] != place[:-1])]))
        size = np.diff(np.append(new, len(run)))
        q0, place0, offset0 = q[new], place[new], offset[new]
        p = q0 + offset0
        least, most = place0 * BIN, np.minimum(place0 * BIN + BIN - 1, WINDOW - GRAM)
        core = mixed(d.at(p - least, p - most + WINDOW) ^ mixed(place0.astype(U)))
        reach = mixed(d.at(q0, q0 + size + WINDOW - 1) ^ mixed((offset0.astype(U) << U(32)) | size.astype(U)))
        lists = pa.ListArray.from_arrays(pa.array(np.append(new, len(run)).astype(np.int32)), pa.array(d.at(q, q + WINDOW).view(np.int64)))
        return [pa.array(gram[run[new]]), pa.array(core.view(np.int64)), pa.array(reach.view(np.int64)), pa.array(q0 + lo), pa.array(size.astype(np.int16)), lists]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 1 << 20):
            for i, t, own in zip(b.column("id").to_pylist(), texts_of(b), b.column("runs").to_pylist()):
                numbers = np.array([[r[c] for c in ("gram", "at", "n", "off")] for r in own], np.int64)
                numbers = numbers[np.argsort(numbers[:, 1], kind="stable")]
                for lo in range(0, len(t), PIECE):
                    mine = numbers[(numbers[:, 1] >= lo) & (numbers[:, 1] < lo + PIECE)]
                    if len(mine):
                        gram, core, reach, at, n, windows = cut(t, lo, *mine.T)
                        yield pa.RecordBatch.from_arrays([gram, core, reach, pa.array(np.full(len(gram), i)), at, n, windows], ["gram", "core", "reach", "id", "at", "n", "windows"])

    return mapped(wanted, run, "gram long, core long, reach long, id long, at long, n smallint, windows array<long>")


def twice(rows: DataFrame, *digits: str) -> DataFrame:
    """(digits, whole) of the groups of two rows or more by these digits; whole: all agree on the reach."""
    groups = rows.groupBy(*digits).agg(F.count(F.lit(1)).alias("rows"), F.min("reach").alias("lo"), F.max("reach").alias("hi"))
    return stash(groups.where("rows > 1").select(*digits, F.expr("lo = hi").alias("whole")))


def repeated(docs: DataFrame) -> DataFrame:
    """(id, at, n): from byte `at` of text id on, n windows start that start elsewhere too; docs (id long, text binary)."""
    found = occurrences(docs)
    shared = stash(found.join(twice(found, "gram"), "gram"))
    part = shared.where("not whole")
    kinds = part.groupBy("gram", "reach").agg(F.count(F.lit(1)).alias("rows"), F.min(F.struct("id", "at", "n", "off")).alias("one"))
    kinds = stash(kinds.select("gram", "reach", "rows", "one.*"))
    copies = kinds.where("rows > 1").select("gram", "reach")
    lists = kinds.groupBy("id").agg(F.collect_list(F.struct("gram", "at", "n", "off")).alias("runs"))
    bins = stash(binned(docs.join(lists, "id")))
    cores = bins.join(twice(bins, "gram", "core"), ["gram", "core"])
    cores = stash(cores.select("gram", "id", "at", "n", "whole", F.when(~F.col("whole"), F.col("windows")).alias("windows")))
    windows = cores.where("not whole").select("gram", "id", "at", F.posexplode("windows").alias("step", "window"))
    again = stash(windows.groupBy("gram", "window").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").drop("rows"))
    one = F.lit(1).cast("smallint").alias("n")
    return (
        shared.where("whole").select("id", "at", "n")
        .unionAll(part.join(copies, ["gram", "reach"]).select("id", "at", "n"))
        .unionAll(cores.where("whole").select("id", "at", "n"))
        .unionAll(windows.join(again, ["gram", "window"]).select("id", (F.col("at") + F.col("step")).alias("at"), one))
    )


def covered(spots: list[dict] | None, size: int) -> list[tuple[int, int]]:
    """The maximal runs of bytes under the windows."""
    out: list[tuple[int, int]] = []
    for at, n in sorted((s["at"], s["n"]) for s in spots or []):
        end = min(size, at + n + WINDOW - 1)
        if out and at <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((at, end))
    return out


def remove(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256, spans array<struct<start, end>>) of every row.

    spans are the maximal runs of removed bytes, from which a caller can cut the text.
    """
    rows = numbered(docs, key, text).withColumn("text", F.col("text").cast("binary"))
    spots = repeated(rows.select("id", "text")).groupBy("id").agg(F.collect_list(F.struct("at", "n")).alias("spots"))
    both = rows.join(stash(spots), "id", "left").select("key", "text", "spots")
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            texts = texts_of(b)
            spans = [covered(s, len(t)) for t, s in zip(texts, b.column("spots").to_pylist())]
            kept = []
            for t, own in zip(texts, spans):
                edges = [0, *(e for s in own for e in s), len(t)]
                kept.append(hashlib.sha256(b"".join(t[x:y] for x, y in zip(edges[::2], edges[1::2]))).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("key"),
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.array([sum(e - s for s, e in own) for own in spans], pa.int64()),
                    pa.array([len(own) for own in spans], pa.int64()),
                    pa.array(kept, pa.string()),
                    pa.array([[{"start": s, "end": e} for s, e in own] for own in spans], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                ],
                ["key", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"],
            )

    schema = f"key {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>"
    return mapped(both, run, schema).withColumnRenamed("key", key)
