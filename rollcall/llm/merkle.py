"""Document fingerprints: a Merkle tree over sections, paragraphs and pieces.

Sections are parted by an empty line, paragraphs by a line end, and a paragraph's leaves are pieces of up to WORDS words
with the white space around them, so nothing of a text is left out. A leaf is the SHA-256 of its piece, an inner node
that of its children's digests joined by commas, and the root that of the sections. Roots test equality; where roots
differ, differing branches locate the edits.

A fingerprint is root:sections, sections joined by `/`, their paragraphs by `.`, each the first DIGITS hex digits of its
leaves one after the other. The likeness of two fingerprints is 1 for equal roots and else the Dice coefficient of
their sets of leaves, from 0 to 1.

Defined results: a null text counts as empty; the empty text has the empty tree, alike (1) only to itself; repeated
rows give repeated results; an empty table gives an empty one; columns other than the key and the text don't take part,
so their names can't clash. Ties: texts of one key follow each other by the digest of key and text; null keys come last.
A very long text is one row of one task, whose tree takes some 70 bytes for each piece of four words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from .common import stash

#: Words of a leaf, hex digits that a fingerprint keeps of a leaf.
WORDS, DIGITS = 4, 6
#: A piece of a paragraph (no line ends in it).
PIECE = r"[\x20\t\r\f\x0B]*(?:[^\x20\t\r\f\x0B]+[\x20\t\r\f\x0B]*){1,%d}|[\x20\t\r\f\x0B]+" % WORDS
#: Ranges of keys in which the order of documents is taken, at least and at most, and rows of a range in between.
RANGES, ROWS = (64, 1024), 100_000


def tree(df: DataFrame, text: str, name: str) -> DataFrame:
    """df with column `name`, the fingerprint of `text` (not null)."""
    leaves = F.transform(
        F.split(text, "\n\n", -1),
        lambda s: F.transform(F.split(s, "\n", -1), lambda p: F.transform(F.regexp_extract_all(p, F.lit(PIECE), F.lit(0)), lambda x: F.sha2(x, 256))),
    )
    df = df.withColumn("_leaves", leaves)
    node = lambda a: F.sha2(F.array_join(a, ","), 256)
    root = node(F.transform("_leaves", lambda s: node(F.transform(s, node))))
    short = lambda p: F.array_join(F.transform(p, lambda x: F.substring(x, 1, DIGITS)), "")
    body = F.array_join(F.transform("_leaves", lambda s: F.array_join(F.transform(s, short), ".")), "/")
    return df.withColumn(name, F.concat(root, F.lit(":"), body)).drop("_leaves")


def leaf_set(fingerprint: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.regexp_replace(F.substring(fingerprint, 66, 2**31 - 1), "[./]", ""), F.lit("[0-9a-f]{%d}" % DIGITS), F.lit(0)))


def likeness(df: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """df with column `name`, how alike the fingerprints a and b are, from 0 to 1."""
    sets = df.withColumns({"_a": leaf_set(F.col(a)), "_b": leaf_set(F.col(b))})
    common, total = F.size(F.array_intersect("_a", "_b")), F.size("_a") + F.size("_b")
    dice = F.when(total > 0, 2.0 * common / total).otherwise(0.0)
    return sets.withColumn(name, F.when(F.substring(a, 1, 64) == F.substring(b, 1, 64), 1.0).otherwise(dice)).drop("_a", "_b")


def edits(a: str, b: str) -> Column:
    """array<string> section.paragraph (from 0) of the paragraphs of fingerprint a that are not at that place in b."""
    places = lambda c: (
        f"flatten(transform(split(substring({c}, 66), '/', -1), (s, i) -> "
        "transform(split(s, '[.]', -1), (p, j) -> struct(concat(i, '.', j) as at, p as p))))"
    )
    return F.expr(f"transform(array_except({places(a)}, {places(b)}), x -> x.at)")


#: Keys drawn for each range where keys have no quantiles.
SAMPLED = 20


def successors(ids: DataFrame, key: str) -> DataFrame:
    """(rid, next) of rows (rid, key): who follows whom by descending key, rid on ties; the last is followed by the first.

    The keys' quantiles cut them into ranges of about equal size, each ordered by itself, and the ranges' first rows,
    RANGES[1] at most, link the ranges. No task holds more than one range, and no text takes part.
    """
    n = ids.count()
    k = max(RANGES[0], min(RANGES[1], n // ROWS))
    if isinstance(ids.schema[key].dataType, NumericType):
        cuts = ids.select(F.percentile_approx(key, [i / k for i in range(1, k)], 10_000)).first()[0] or []
    else:  # SAMPLED keys a range, drawn by their rows' digests; they decide on the ranges' sizes only
        drawn = ids.where(F.col(key).isNotNull()).orderBy(F.xxhash64("rid"), "rid").limit(SAMPLED * k).select(key).collect()
        drawn = sorted(x[0] for x in drawn)
        cuts = [drawn[len(drawn) * i // k] for i in range(1, k)] if drawn else []
    cuts = sorted(set(cuts))

    def place(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col(key) <= cuts[mid], place(lo, mid)).otherwise(place(mid + 1, hi))

    ranged = ids.select("rid", key, F.when(F.col(key).isNull(), -1).otherwise(place(0, len(cuts))).alias("part"))
    inside = Window.partitionBy("part").orderBy(F.desc_nulls_last(key), "rid")
    ranged = ranged.select("rid", "part", F.lead("rid").over(inside).alias("next"), F.row_number().over(inside).alias("n"))
    firsts = ranged.where("n = 1").select("part", "rid")
    over = Window.orderBy(F.desc("part"))  # a row for each range
    first_of_all = F.first("rid").over(over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    firsts = firsts.select("part", F.coalesce(F.lead("rid").over(over), first_of_all).alias("beyond"))
    return ranged.join(firsts, "part", "left").select("rid", F.coalesce("next", "beyond").alias("next"))


def report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of each document.

    The edited text is the text with its last half replaced by as much of the beginning of the next document, by
    descending key. Both joins use one shuffle of (rid, text); what travels besides is the part that an edit needs.
    A rid is the digest of key and text: repeated rows are one document, and several texts of a key follow by rid.
    """
    src = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rid = F.unhex(F.sha2(F.concat(F.coalesce(F.col("key").cast("string"), F.lit("~")), F.lit(":"), F.sha2("text", 256)), 256))
    src = src.withColumn("rid", rid)
    ids = stash(src.select("rid", "key", F.length("text").alias("n")))
    once = ids.groupBy("rid").agg(F.first("key").alias("key"), F.first("n").alias("n"), F.count(F.lit(1)).alias("rows"))
    follows = stash(successors(once.select("rid", "key"), "key").join(once, "rid"))
    repeated = follows.agg(F.max("rows")).first()[0]
    texts = src.select("rid", "text")
    donors = texts if not repeated or repeated == 1 else texts.dropDuplicates(["rid"])
    wanted = follows.select(F.col("next").alias("rid"), F.col("rid").alias("to"), "key", "n")
    given = tree(donors.join(wanted, "rid"), "text", "next_fingerprint")
    given = given.select(F.col("to").alias("rid"), "key", F.expr("substring(text, 1, cast(n div 2 as int))").alias("donation"), "next_fingerprint")
    both = texts.join(given, "rid")
    half = "cast(length(text) div 2 as int)"
    both = both.select("key", "text", "next_fingerprint", F.expr(f"concat(substring(text, 1, length(text) - {half}), donation)").alias("edited"))
    both = tree(tree(both, "text", "fingerprint"), "edited", "edited_fingerprint")
    both = both.select("key", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "next_fingerprint")
    both = likeness(likeness(both, "fingerprint", "edited_fingerprint", "near_edited"), "fingerprint", "next_fingerprint", "near_next")
    return both.drop("next_fingerprint").withColumnRenamed("key", key)
