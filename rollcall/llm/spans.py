"""Spans of regular expressions with code point offsets, from built-in functions only.

Spark gives a pattern's matches (regexp_extract_all) and the pieces between them (split), but no offsets. Both follow
the same leftmost, non-overlapping search, so match i starts after pieces 0..i and matches 0..i-1. The running sum is
taken over blocks of BLOCK, so that a text with many matches doesn't cost the square of their number.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 64
#: Code points of a piece of a text, spans that are masked together.
PIECE, LOT = 4096, 256


def add(df: DataFrame, text: str, found: dict[str, str]) -> DataFrame:
    """One more column for each (name, Java pattern): array<struct<start int, end int, hit string>>, ends exclusive.

    The patterns must not match the empty string. A null text has null spans.
    """
    names = list(found)
    df = df.select(
        "*",
        *(c for n, p in found.items() for c in (
            F.regexp_extract_all(text, F.lit(p), F.lit(0)).alias(f"_hit_{n}"),
            F.split(text, p, -1).alias(f"_gap_{n}"),
        )),
    )
    df = df.select("*", *(F.expr(_if_any(n, f"transform(sequence(0, size(_hit_{n}) - 1), i -> length(_hit_{n}[i]) + length(_gap_{n}[i]))", "int")).alias(f"_len_{n}") for n in names))
    blocks = "transform(sequence(0, cast((size(_len_{n}) - 1) div {b} as int)), k -> aggregate(slice(_len_{n}, k * {b} + 1, {b}), 0, (s, x) -> s + x))"
    df = df.select("*", *(F.expr(_if_any(n, blocks.format(n=n, b=BLOCK), "int")).alias(f"_sum_{n}") for n in names))
    before = "transform(sequence(0, size(_sum_{n}) - 1), k -> aggregate(slice(_sum_{n}, 1, k), 0, (s, x) -> s + x))"
    df = df.select("*", *(F.expr(_if_any(n, before.format(n=n), "int")).alias(f"_pre_{n}") for n in names))
    at = (
        "transform(sequence(0, size(_hit_{n}) - 1), i -> _pre_{n}[cast(i div {b} as int)]"
        " + aggregate(slice(_len_{n}, cast(i div {b} as int) * {b} + 1, i % {b}), 0, (s, x) -> s + x) + length(_gap_{n}[i]))"
    )
    df = df.select("*", *(F.expr(f"if(size(_pre_{n}) > 0, {at.format(n=n, b=BLOCK)}, _pre_{n})").alias(f"_at_{n}") for n in names))
    whole = "transform(sequence(0, size(_at_{n}) - 1), i -> struct(_at_{n}[i] as start, _at_{n}[i] + length(_hit_{n}[i]) as end, _hit_{n}[i] as hit))"
    df = df.select("*", *(F.expr(_if_any(n, whole.format(n=n), "struct<start:int,end:int,hit:string>")).alias(n) for n in names))
    return df.drop(*(f"_{k}_{n}" for n in names for k in ("hit", "gap", "len", "sum", "pre", "at")))


def _if_any(name: str, then: str, item: str) -> str:
    return f"if(size(_hit_{name}) > 0, {then}, cast(array() as array<{item}>))"


def rendered(*kinds: tuple[str, Column]) -> Column:
    """array<string> kind:start:end, kind after kind; each kind's spans in their own order."""

    def of(kind: str, c: Column) -> Column:
        return F.transform(c, lambda x: F.concat(F.lit(f"{kind}:"), x["start"].cast("string"), F.lit(":"), x["end"].cast("string")))

    return F.concat(*(of(k, c) for k, c in kinds))


def kept(spans: str, good: Callable[[Column], Column]) -> Column:
    return F.filter(F.col(spans), lambda x: good(x["hit"]))


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(digits)),
        F.lit(0),
        lambda s, i: s
        + F.when(i % 2 == 1, F.substring(digits, -i, F.lit(1)).cast("int")).otherwise(
            F.element_at(F.array(*(F.lit(v) for v in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), F.substring(digits, -i, F.lit(1)).cast("int") + 1)
        ),
    )
    return (F.length(digits) > 0) & (total % 10 == 0)


def pieces(text: str) -> Column:
    """array<string>: the text in pieces of PIECE code points, so that looking up a place doesn't walk through a long text."""
    return F.when(F.length(text) > PIECE, F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % PIECE), F.lit(0))).otherwise(F.array(F.col(text)))


def ahead(pieces: str, start: Column, n: int) -> Column:
    """The n code points (n <= PIECE) before place `start` of the text, fewer at its beginning."""

    def cut(c: Column, at: Column) -> Column:
        return F.substring(c, F.greatest(at - n, F.lit(0)) + 1, F.least(at, F.lit(n)))

    k = F.floor(start / PIECE).cast("int")
    two = F.concat(F.get(pieces, k - 1), F.get(pieces, k))
    return F.when(k == 0, cut(F.get(pieces, F.lit(0)), start)).otherwise(cut(two, start - (k - 1) * PIECE))


def masked(df: DataFrame, text: str, spans: str) -> DataFrame:
    """df with text in which each maximal run of overlapping spans (array<struct<start, end, mark>>) became its first mark.

    Spans are taken LOT at a time, from the last place masked before them on, so a text with many spans doesn't cost its length
    for each of them.
    """
    lots = "transform(sequence(0, cast((size(_sorted) - 1) div {b} as int)), k -> {of})"
    own = f"slice(_sorted, k * {LOT} + 1, {LOT})"
    steps = {
        "_sorted": f"array_sort({spans})",
        "_ends": lots.format(b=LOT, of=f"array_max(transform({own}, x -> x.end))"),
        "_from": lots.format(b=LOT, of="coalesce(array_max(slice(_ends, 1, k)), 0)"),
        "_lots": lots.format(b=LOT, of=f"""named_struct('at', _from[k], 'own', {own},
            'part', substring({text}, _from[k] + 1, greatest(_ends[k] - _from[k], 0)))"""),
        "_outs": """transform(_lots, g -> aggregate(g.own, named_struct('out', '', 'at', g.at),
            (s, x) -> if(x.start < s.at, named_struct('out', s.out, 'at', greatest(s.at, x.end)),
                named_struct('out', concat(s.out, substring(g.part, s.at - g.at + 1, x.start - s.at), x.mark), 'at', x.end)),
            s -> s.out))""",
    }
    out = df
    for name, step in steps.items():
        out = out.withColumn(name, F.expr(step))
    whole = F.concat(F.array_join("_outs", ""), F.expr(f"substring({text}, array_max(_ends) + 1)"))
    return out.withColumn(text, F.when(F.size("_sorted") > 0, whole).otherwise(F.col(text))).drop(*steps)
