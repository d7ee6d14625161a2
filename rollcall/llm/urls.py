"""URL filters: rules of hosts and path prefixes first, boosted trees on lexical features for the rest.

The trees are fit on URLs with a known verdict: by default those that a rule decides, or any (url, bad) rows. Features:
length, depth, digit ratio, entropy, number of parameters, labels and hyphens of the host, and the statistics of the
host's last label (how often it occurs, and how often as bad) over all labelled URLs. At most SAMPLE distinct labelled URLs,
the first by a hash, reach the driver as feature bins, weighted by how often they occur; the trees become one SQL expression.

Defined results: a null URL, or one without `://`, has an empty host and path, fits no rule and is judged by its features
like any other; repeated rows give repeated results; without labelled rows of both verdicts everything that no rule
decides is allowed; an empty table gives an empty one; columns other than the key and the URL don't take part. Ties: of
rules that fit, the longest wins, and two of one length that fit one URL are the same; of equally good splits of a tree
the first feature's lowest counts. A very long URL is judged whole, like any other.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The rules as (verdict, host and path prefix).
RULES = (
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
)
#: Distinct labelled URLs that fit the trees, at most; trees, their depth, the shrinkage, and bins of a feature.
SAMPLE, TREES, DEPTH, RATE, BINS = 20_000, 24, 3, 0.3, 16
FEATURES = ("length", "depth", "digit_ratio", "entropy", "parameters", "labels", "hyphens", "suffix_count", "suffix_bad")


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path: after the first `://` up to / ? # or the end, A-Z lower-cased; then up to ? # or the end."""
    whole = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.regexp_extract(url, whole, 1)
    lowered = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lowered, F.lit("")), F.coalesce(F.regexp_extract(url, whole, 2), F.lit(""))


def ruled(rules: tuple[tuple[str, str], ...]) -> tuple[Column, Column]:
    """The longest rule that fits columns host and path, and its verdict, both null if none does."""
    rule = verdict = F.lit(None).cast("string")
    for what, where in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # the longest ends up outermost
        host, _, path = where.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(f"/{path}")
        rule, verdict = F.when(fits, F.lit(where)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def lexical(df: DataFrame) -> DataFrame:
    """df (url, host, path) with the features that need no statistics."""
    df = df.withColumn("_url", F.coalesce("url", F.lit("")))
    n = F.greatest(F.length("_url"), F.lit(1))
    count = lambda c, what: F.length(c) - F.length(F.replace(c, F.lit(what), F.lit("")))
    share = lambda x: (F.length("_url") - F.length(F.replace(F.col("_url"), x, F.lit("")))) / F.length(x) / n
    letters = F.array_distinct(F.filter(F.split("_url", ""), lambda x: F.length(x) > 0))
    return df.withColumns({
        "length": F.length("_url").cast("double"),
        "depth": count(F.col("path"), "/").cast("double"),
        "digit_ratio": F.length(F.regexp_replace("_url", "[^0-9]", "")) / n,
        "entropy": F.aggregate(F.transform(letters, share), F.lit(0.0), lambda s, p: s - p * F.log2(p)),
        "parameters": F.length(F.regexp_replace(F.regexp_extract("_url", r"(?s)\?([^#]*)", 1), "[^=]", "")).cast("double"),
        "labels": count(F.col("host"), ".").cast("double"),
        "hyphens": count(F.col("host"), "-").cast("double"),
        "suffix": F.substring_index("host", ".", -1),
    }).drop("_url")


class Trees:
    """Gradient boosting with logistic loss over binned features, on rows (bins..., bad, count)."""

    def __init__(self, rows: list[tuple[list[int], int, int]]):
        bad = sum(n for _, y, n in rows if y)
        total = sum(n for *_, n in rows)
        self.trees: list = []
        self.base = math.log(bad / (total - bad)) if 0 < bad < total else -20.0
        if not 0 < bad < total:
            return
        score = [self.base] * len(rows)
        for _ in range(TREES):
            p = [1 / (1 + math.exp(-s)) for s in score]
            slope = [(y - q) * n for (_, y, n), q in zip(rows, p)]
            curve = [q * (1 - q) * n for (*_, n), q in zip(rows, p)]
            tree = self.grow(rows, slope, curve, list(range(len(rows))), DEPTH)
            self.trees.append(tree)
            for i, (bins, _, _) in enumerate(rows):
                node = tree
                while isinstance(node, tuple):
                    node = node[2] if bins[node[0]] <= node[1] else node[3]
                score[i] += node

    def grow(self, rows, slope, curve, own, depth):
        g, h = sum(slope[i] for i in own), sum(curve[i] for i in own)
        best = (1e-6, None, None)
        for f in range(len(FEATURES)) if depth else ():
            sums = [[0.0, 0.0] for _ in range(BINS)]
            for i in own:
                cell = sums[rows[i][0][f]]
                cell[0] += slope[i]
                cell[1] += curve[i]
            a = b = 0.0
            for cut in range(BINS - 1):
                a, b = a + sums[cut][0], b + sums[cut][1]
                if b and h - b:
                    gain = a * a / (b + 1) + (g - a) ** 2 / (h - b + 1) - g * g / (h + 1)
                    if gain > best[0] + 1e-12:
                        best = (gain, f, cut)
        if best[1] is None:
            return RATE * g / (h + 1)
        left = [i for i in own if rows[i][0][best[1]] <= best[2]]
        right = [i for i in own if rows[i][0][best[1]] > best[2]]
        return (best[1], best[2], self.grow(rows, slope, curve, left, depth - 1), self.grow(rows, slope, curve, right, depth - 1))

    def column(self, edges: list[list[float]]) -> Column:
        """The log odds as an expression over the feature columns; bin b holds values up to edges[b]."""

        def of(node) -> Column:
            if not isinstance(node, tuple):
                return F.lit(float(node))
            f, cut, left, right = node
            if cut >= len(edges[f]):
                return of(left)
            return F.when(F.col(FEATURES[f]) <= float(edges[f][cut]), of(left)).otherwise(of(right))

        total = F.lit(float(self.base))
        for t in self.trees:
            total = total + of(t)
        return total


def judge(pages: DataFrame, labelled: DataFrame | None = None, rules: tuple[tuple[str, str], ...] = RULES, key: str = "page_id", url: str = "url") -> DataFrame:
    """(key, host, path, rule, verdict, p_block) of every page; labelled: (url, bad boolean) rows instead of the ruled pages."""

    def featured(df: DataFrame) -> DataFrame:
        host, path = parts(F.col("url"))
        return lexical(df.withColumns({"host": host, "path": path}))

    mine = featured(pages.select(F.col(key).alias("key"), F.col(url).cast("string").alias("url")))
    rule, verdict = ruled(rules)
    mine = mine.withColumns({"rule": rule, "ruled": verdict})
    if labelled is None:
        known = mine.where("rule is not null").withColumn("bad", F.col("ruled") == "block")
    else:
        known = featured(labelled.select("url", "bad")).where("bad is not null")
    stats = known.groupBy("suffix").agg(
        F.log1p(F.count(F.lit(1))).alias("suffix_count"), ((F.sum(F.col("bad").cast("int")) + 1) / (F.count(F.lit(1)) + 2)).alias("suffix_bad")
    )
    filled = {"suffix_count": 0.0, "suffix_bad": 0.5}
    distinct = known.groupBy("url", F.col("bad").cast("int").alias("bad")).agg(F.count(F.lit(1)).alias("n"))
    sample = featured(distinct.orderBy(F.xxhash64("url"), "url", "bad").limit(SAMPLE)).join(stats, "suffix", "left").fillna(filled)
    grouped = sample.groupBy(*FEATURES, "bad").agg(F.sum("n").alias("count"))  # SAMPLE rows at most
    seen = sorted((tuple(r[f] for f in FEATURES), r["bad"], r["count"]) for r in grouped.collect())
    edges = [cuts([v[f] for v, _, n in seen]) for f in range(len(FEATURES))]
    model = Trees([([sum(x > e for e in edges[f]) for f, x in enumerate(v)], y, n) for v, y, n in seen])
    scored = mine.join(stats, "suffix", "left").fillna(filled).withColumn("p_block", 1 / (1 + F.exp(-model.column(edges))))
    return scored.select(
        F.col("key").alias(key), "host", "path", "rule",
        F.coalesce("ruled", F.when(F.col("p_block") >= 0.5, "block").otherwise("allow")).alias("verdict"), "p_block",
    )


def cuts(values: list[float]) -> list[float]:
    """At most BINS - 1 upper edges that split the distinct values about evenly."""
    distinct = sorted(set(values))
    if len(distinct) <= BINS:
        return distinct[:-1]
    return [distinct[len(distinct) * i // BINS - 1] for i in range(1, BINS)]
