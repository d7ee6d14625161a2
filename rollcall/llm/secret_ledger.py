"""Secrets by an incremental blob ledger.

Every version of every text is addressed by its content (SHA-256 of the UTF-8 bytes), so a text that occurs under many
paths, or again in a later version, is one blob. The ledger holds, for each blob, which rule versions have scanned it
and what they found; a rule's version is the digest of its definition, so changing a rule makes its pairs unseen. A run
scans only the (blob, rule version) pairs that the ledger lacks, and joins the findings back to all paths.

Defined results: a null text is the empty blob; repeated rows give repeated results; an empty table gives an empty
result and an empty ledger; columns other than the keys and the text don't take part, so their names can't clash. Ties:
spans of different rules may overlap and all stay, equal starts in the order of the rules. A very long text is one blob,
scanned whole by one task, once however many paths share it.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spans
from .common import stash


@dataclass(frozen=True)
class Rule:
    """A Java pattern; a hit counts if `group` (0: all of it) has at least `least` code points."""

    name: str
    pattern: str
    least: int = 1
    group: int = 0

    @property
    def version(self) -> str:
        return hashlib.sha256(repr((self.name, self.pattern, self.least, self.group)).encode()).hexdigest()[:12]

    def good(self, hit: Column) -> Column:
        part = hit if self.group == 0 else F.regexp_extract(hit, self.pattern, self.group)
        return F.length(part) >= self.least


# The base rules, then the rules that the ledger adds.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = (
    Rule("assign", ASSIGN, 8, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 16),
    Rule("hex", r"[0-9a-f]{32,}", 32),
)
ADDED = (
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("host_token", r"gh[opsu]_[A-Za-z0-9]{36,}"),
)
RULES = (*BASE, *ADDED)

LEDGER = "blob string, findings array<struct<rule:string,version:string,spans:array<struct<start:int,end:int>>>>"


def address(text: str) -> Column:
    return F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")), 256)


def scan(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The new ledger rows: for each blob of docs with unseen rule versions, the findings of these.

    Copies of a blob are reduced to one before and after the shuffle, however many paths share it.
    """
    blobs = docs.select(address(text).alias("blob"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    blobs = blobs.groupBy("blob").agg(F.first("text").alias("text"))
    seen: Column = F.lit(None).cast("array<string>")
    if ledger is not None:
        done = ledger.select("blob", F.explode("findings").alias("f")).groupBy("blob")
        done = done.agg(F.collect_set(F.concat_ws(":", "f.rule", "f.version")).alias("seen"))  # as many as rule versions
        blobs, seen = blobs.join(done, "blob", "left"), F.col("seen")
    fresh = [F.coalesce(~F.array_contains(seen, f"{r.name}:{r.version}"), F.lit(True)) for r in rules]
    blobs = blobs.select("blob", *(F.when(new, F.col("text")).otherwise("").alias(f"text_{i}") for i, new in enumerate(fresh)),
                         F.array(*(F.when(new, F.lit(i)) for i, new in enumerate(fresh))).alias("new"))
    found = blobs.where(F.exists("new", lambda x: x.isNotNull()))
    for i, r in enumerate(rules):
        found = spans.add(found, f"text_{i}", {f"hits_{i}": r.pattern}).drop(f"text_{i}")
    def finding(i: int, r: Rule) -> Column:
        hits = F.transform(spans.kept(f"hits_{i}", r.good), lambda x: F.struct(x["start"], x["end"]))
        return F.when(F.col("new")[i].isNotNull(), F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("version"), hits.alias("spans")))

    return found.select("blob", F.array_compact(F.array(*(finding(i, r) for i, r in enumerate(rules)))).alias("findings"))


def update(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The whole ledger after a run, old rows and new, written to the shared folder."""
    new = stash(scan(docs, ledger, rules, text))
    return new if ledger is None else ledger.unionByName(new)


def attach(docs: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES, keys: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """(keys, hits array<struct<start, k, end>>): the ledger's findings of the current rules at every path, by start, then rule."""
    current = {f"{r.name}:{r.version}": i for i, r in enumerate(rules)}
    number = F.create_map(*(F.lit(v) for kv in current.items() for v in kv))
    rows = ledger.select("blob", F.explode("findings").alias("f")).where(F.size("f.spans") > 0)
    rows = rows.select("blob", F.element_at(number, F.concat_ws(":", "f.rule", "f.version")).alias("k"), "f.spans").where("k is not null")
    per = rows.groupBy("blob").agg(F.flatten(F.collect_list(F.expr("transform(spans, x -> struct(x.start as start, k as k, x.end as end))"))).alias("hits"))
    per = per.select("blob", F.array_sort("hits").alias("hits"))
    paths = docs.select(*keys, address(text).alias("blob"))
    none = F.expr("cast(array() as array<struct<start:int,k:int,end:int>>)")
    return paths.join(per, "blob", "left").select(*keys, F.coalesce("hits", none).alias("hits"))


def report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_assign, n_access, n_hex, base_sha256, spans): spans are kind:start:end in code points, by start, then kind."""
    hits = attach(docs, update(docs, text=text), keys=(key,), text=text)
    names = F.array(*(F.lit(r.name) for r in RULES))
    shown = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["start"], x["end"])), ",")
    count = lambda i: F.size(F.filter("hits", lambda x: x["k"] == i)).cast("long")
    return hits.select(
        key,
        *(count(i).alias(f"n_{r.name}") for i, r in enumerate(BASE)),
        F.sha2(shown(F.filter("hits", lambda x: x["k"] < len(BASE))), 256).alias("base_sha256"),
        shown(F.col("hits")).alias("spans"),
    )
