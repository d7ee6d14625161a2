"""Export rows: the roster decides who is in, references only add to it; statuses and summary."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

EXTRA = ("nia", "repetix", "materia")


def enrich(roster: DataFrame, links: DataFrame, references: DataFrame, by: Sequence[str], values: Sequence[str] = EXTRA) -> DataFrame:
    """Every roster row, with the values of its linked reference and how it was linked; blank where there is none."""
    added = links.join(references.select(*by, F.col("id").alias("ref_id"), *values), [*by, "ref_id"], "left").select(*by, "id", "method", *values)
    out = roster.join(added, [*by, "id"], "left")
    return out.select(*roster.columns, F.coalesce("method", F.lit("")).alias("method"), *(F.coalesce(v, F.lit("")).alias(v) for v in values))


def unresolved(roster: DataFrame, links: DataFrame, by: Sequence[str]) -> DataFrame:
    return roster.join(links.select(*by, "id"), [*by, "id"], "left_anti")


def statuses(items: DataFrame) -> DataFrame:
    """items (failed, n_references, n_unmatched, n_ambiguous, n_missing_photos, n_issues, ...) with kind of outcome.

    REVIEW blocks the item; an ambiguous row blocks its class. WARNING and MISSING_PHOTOS are exported nevertheless.
    """
    status = (
        F.when(F.col("failed") | (F.col("n_ambiguous") > 0), "REVIEW")
        .when((F.col("n_references") == 0) | (F.col("n_unmatched") > 0) | (F.col("n_issues") > 0), "WARNING")
        .when(F.col("n_missing_photos") > 0, "MISSING_PHOTOS")
        .otherwise("READY")
    )
    return items.withColumn("status", status)


def summary(items: DataFrame) -> DataFrame:
    """One row: ready, warning and blocking counts, and the exit code (2 if anything blocks)."""
    counts = items.agg(
        F.count_if(F.col("status") == "READY").alias("ready"),
        F.count_if(F.col("status").isin("WARNING", "MISSING_PHOTOS")).alias("warning"),
        F.count_if(F.col("status") == "REVIEW").alias("blocking"),
    )
    return counts.withColumn("exit_code", F.when(F.col("blocking") > 0, 2).otherwise(0))


def report(items: DataFrame) -> DataFrame:
    """(roster, line): one line an item for a terminal or a text file, with counts and no names."""
    counts = [F.concat(F.lit(f"{title}="), F.coalesce(F.col(c).cast("string"), F.lit("0"))) for title, c in (
        ("rows", "n_rows"), ("matched", "n_matched"), ("ambiguous", "n_ambiguous"), ("unmatched", "n_unmatched"), ("missing_photos", "n_missing_photos"), ("issues", "n_issues"))]
    return items.select("roster", F.concat(F.lit("["), "status", F.lit("] "), F.concat_ws(" ", *counts)).alias("line"))


def blockers(rows: DataFrame, n_references: int, wanted: Sequence[str] = ()) -> DataFrame:
    """(roster, codes) of the rosters whose export has to stop, from rows (roster, id, outcome, nia): an ambiguous row, no
    usable reference though there are references, optional columns wanted without any reference, a number that two rows'
    photos would share. Codes are in this order; rosters that may be exported have none and are left out."""
    from .classes import issues

    number = F.nullif(tx.safe_file_name(F.coalesce(F.trim("nia"), F.lit("")), ""), F.lit(""))
    own = rows.withColumn("_n", number).groupBy("roster").agg(
        F.count_if(F.col("outcome") == "ambiguous").alias("_a"), F.count_if(F.col("outcome") == "matched").alias("_m"),
        F.count("_n").alias("_k"), F.countDistinct(F.lower("_n")).alias("_d"),
    )
    codes = issues(
        ("ambiguous_photo", F.col("_a") > 0), ("no_usable_reference", F.lit(n_references > 0) & (F.col("_m") == 0)),
        ("columns_without_references", F.lit(bool(wanted) and n_references == 0)), ("duplicate_number", F.col("_k") > F.col("_d")),
    )
    return own.select("roster", codes.alias("codes")).where(F.size("codes") > 0)


def sheet(rows: DataFrame, nia: bool = True, repetix: bool = False, materia: bool = False, cased: bool = False, also: Sequence[str] = ()) -> DataFrame:
    """The output columns, then those in `also`; names in written case if asked for, which is presentation only: matching uses the original."""
    name = tx.name_case if cased else (lambda c: c)
    columns = [name(F.col("surnames")).alias("Apellidos"), name(F.col("given_names")).alias("Nombre")]
    columns += [F.col(c).alias(title) for wanted, c, title in ((nia, "nia", "NIA"), (repetix, "repetix", "REPETIX"), (materia, "materia", "MATÈRIA")) if wanted]
    return rows.select(*columns, *also)
