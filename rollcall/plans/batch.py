"""From a table of words to one file a class: what a folder of reports becomes, its manifest and its exit code.

A document that can't be used (no known header, no students, no class) has a line of its own and stops no other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..operators import classes, enrich
from ..sources import sinks
from ..sources.shared import stash
from . import convert


def plan(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items, rows): a line for each class (status OK or REVIEW, file_name) and each document without one (ERROR), and the
    students of all classes with their file_name.

    Classes with issues are written too, for review; from the second on, classes of one group are repeated_group. A class
    without group is named after its document.
    """
    found, members = convert.references(words)
    found = found.withColumn("group", F.coalesce("group_code", F.regexp_replace(F.element_at(F.split("source", "/"), -1), r"\.[^.]*$", "")))
    found = classes.repeated_groups(sinks.class_names(found, "group"), "group", ["source", "class_key"])
    found = stash(found)
    rows = members.select("source", "class_key", "seq", "surnames", "given_names", "nia", "repetix", "materia").join(found.select("source", "class_key", "file_name"), ["source", "class_key"])
    rows = stash(rows)
    sizes = rows.groupBy("source", "class_key").agg(F.count(F.lit(1)).alias("n_rows"))
    documents = convert.reference_issues(words, found).withColumnRenamed("issues", "_own")
    lines = documents.join(found.drop("n_students"), "source", "left").join(sizes, ["source", "class_key"], "left")
    notes = F.concat("_own", F.coalesce("issues", F.array().cast("array<string>")), F.when(F.col("repeated"), F.array(F.lit("repeated_group"))).otherwise(F.array().cast("array<string>")))
    lines = lines.withColumn("issues", notes)
    status = F.when(F.col("file_name").isNull(), "ERROR").when(F.size("issues") > 0, "REVIEW").otherwise("OK")
    items = lines.select("source", status.alias("status"), "file_name", "group_code", "course", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), "issues")
    return items, rows


def summary(items: DataFrame) -> DataFrame:
    """One row: documents, files, failures, and the exit code (2 if a document failed, 1 if there is none)."""
    counts = items.agg(F.countDistinct("source").alias("documents"), F.count("file_name").alias("files"), F.count_if(F.col("status") == "ERROR").alias("failures"))
    return counts.withColumn("exit_code", F.when(F.col("documents") == 0, 1).when(F.col("failures") > 0, 2).otherwise(0))


def export(words: DataFrame, folder: str, nia: bool = True, repetix: bool = False, materia: bool = False, cased: bool = False) -> Row:
    """Write `folder`/classes (CSV, one folder a class) and `folder`/manifest (text); an existing one is an error. The summary's row."""
    items, rows = plan(words)
    items = stash(items)
    titled = enrich.sheet(rows, nia, repetix, materia, cased, also=("file_name",))
    sinks.write_csv(titled, f"{folder}/classes")
    sinks.manifest(items).write.mode("errorifexists").text(f"{folder}/manifest")
    return summary(items).first()
