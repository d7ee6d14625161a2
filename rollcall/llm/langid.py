"""Language ID by rank-order profiles.

A language's profile is its PROFILE most frequent letter n-grams (1 to LONGEST letters, words padded with a space on
both sides) in order of frequency over all labelled training texts. A document is ranked the same way, and its distance
to a language is the sum over its n-grams of how far out of place each is there, PROFILE for those that are missing.

N-grams are numbers (up to three code points of 21 bits), counted by sorting, so no dictionary grows with the text.
Training adds up the counts of a partition, then of all by language and n-gram, and keeps each language's first PROFILE;
only these, PROFILE rows a language, reach the driver and the workers. All whole texts take part in training and in
prediction.

Defined results: a text that is null or has no letter, or any text when no language was learned, is `und` with score 0;
ties between languages go to the name that sorts first, ties between n-grams to the shorter, then the lower code
points; a null key is never held
out; repeated rows give repeated results; an empty table gives an empty one; other columns don't take part. Training
counts half a megabyte at a time, a very long text alone and whole, so memory grows with the longest text.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mapped, slices

#: N-grams of a profile (they have one to three letters), bits of a letter in an n-gram's number.
PROFILE, BITS = 400, 21


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.array([unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)])


def grams(text: str | None) -> np.ndarray:
    """The numbers of all n-grams of a text's words, each padded with a space on both sides, but for the space by itself."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    points = np.concatenate([[32], points, [32]]).astype(np.int64)
    good = letters()[points]
    keep = good.copy()
    keep[1:] |= good[:-1]  # one space after a word
    keep[0] = True
    points = np.where(good, points, 32)[keep]
    one = points[points != 32]
    two = points[:-1] << BITS | points[1:]
    three = points[:-2] << 2 * BITS | two[1:]
    return np.concatenate([one, two, three[points[1:-1] != 32]]) if len(one) else one


def counted(x: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct numbers in order, and how often each occurs (or the sums of n)."""
    if n is None:
        x = np.sort(x)
        edge = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]) if len(x) else [])
        return x[edge], np.diff(np.append(edge, len(x)))
    order = np.argsort(x, kind="stable")
    x, n = x[order], n[order]
    edge = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]) if len(x) else [])
    return x[edge], np.add.reduceat(n, edge) if len(edge) else n


def held_out(key: str):
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % 4 == 2


def profiles(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, gram, place) of the labelled docs: each language's first PROFILE n-grams, place from 0."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for b in slices(batches, "text", 1 << 19):
            parts: dict[str, list[str]] = {}
            for name, t in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
                parts.setdefault(name, []).append(t)
            for name, own in parts.items():
                new = counted(grams("\n".join(own)))
                if name in total:
                    new = counted(*(np.concatenate(x) for x in zip(total[name], new)))
                total[name] = new
        for name, (x, n) in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(x), pa.string()), pa.array(x, pa.int64()), pa.array(n, pa.int64())], ["lang", "gram", "n"])

    known = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text")).where("lang is not null and text is not null")
    counts = mapped(known, count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    first = counts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= PROFILE)  # the limit reaches the window
    return first.select("lang", "gram", (F.col("place") - 1).alias("place"))


class Ranker:
    """Distances of texts to profiles."""

    def __init__(self, rows: list[tuple[str, int, int]]):
        self.langs = sorted({r[0] for r in rows})
        self.known = np.array(sorted({r[1] for r in rows}), np.int64)
        self.places = np.full((len(self.known) + 1, len(self.langs)), -1, np.int64)  # the last row: n-grams of no profile
        number = {name: i for i, name in enumerate(self.langs)}
        for name, gram, place in rows:
            self.places[np.searchsorted(self.known, gram), number[name]] = place

    def judge(self, text: str | None) -> tuple[str, float]:
        x, n = counted(grams(text))
        if not len(x) or not self.langs:
            return "und", 0.0
        if len(x) > PROFILE:
            least = np.partition(n, len(n) - PROFILE)[len(n) - PROFILE]
            x, n = x[n >= least], n[n >= least]
        x = x[np.argsort(-n, kind="stable")][:PROFILE]
        at = np.minimum(np.searchsorted(self.known, x), len(self.known) - 1)
        places = self.places[np.where(self.known[at] == x, at, len(self.known))]
        away = np.where(places < 0, PROFILE, np.abs(places - np.arange(len(x))[:, None])).sum(axis=0)
        best = int(np.argmin(away))
        return self.langs[best], float(1 - away[best] / (PROFILE * len(x)))


def predict(docs: DataFrame, profile: DataFrame, text: str = "text") -> DataFrame:
    """docs with columns lang_pred and score (0 to 1: 1 less the distance's share of the greatest possible one)."""
    rows = [tuple(r) for r in profile.select("lang", "gram", "place").collect()]  # PROFILE a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranker = Ranker(rows)
        for b in slices(batches, "text"):
            found = [ranker.judge(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("row"), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], ["row", "lang_pred", "score"]
            )

    columns = [c for c in docs.columns if c not in ("lang_pred", "score")]
    src = docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"), F.col(text).cast("string").alias("text"))
    out = mapped(src, run, f"row {src.schema['row'].dataType.simpleString()}, lang_pred string, score double")
    return out.select(*(F.col(f"row.`{c}`").alias(c) for c in columns), "lang_pred", "score")


def report(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(key, held_out, lang_pred, score): learn from the labelled docs that are not held out, predict all."""
    profile = profiles(docs.where(~held_out(key)), text, lang)
    guessed = predict(docs.select(F.col(key).alias(key), F.col(text).alias("text")), profile)
    return guessed.select(key, held_out(key).alias("held_out"), "lang_pred", "score")
