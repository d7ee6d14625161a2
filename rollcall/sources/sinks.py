"""Outputs: one CSV or XLSX a class, photos by name, manifests. Names are computed in the plan, not from what a folder holds."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators.classes import numbered_names

#: Column widths of a sheet.
WIDTHS = {"Apellidos": 34, "Nombre": 26, "NIA": 16, "REPETIX": 12, "MATÈRIA": 45}


def class_names(classes: DataFrame, group: str = "group_code") -> DataFrame:
    """classes with file_name `<group>_export`, numbered from the second on if safe names meet."""
    named = classes.withColumn("_base", F.concat(tx.safe_file_name(F.col(group)), F.lit("_export")))
    return numbered_names(named, [], "_base", ["source", "class_key"], "file_name", every=False).drop("_base")


def free_names(wanted: DataFrame, taken: DataFrame, name: str = "name") -> DataFrame:
    """wanted with `free`: its name, or name__2, name__3, ... the first that no folder in taken (name) has."""
    used = taken.select(F.regexp_extract(name, r"^(.*?)(?:__([0-9]+))?$", 1).alias("_base"), F.coalesce(F.regexp_extract(name, r"__([0-9]+)$", 1).try_cast("int"), F.lit(1)).alias("_k"))
    own = wanted.select(F.col(name).alias("_base")).join(used, "_base").groupBy("_base").agg(F.array_sort(F.collect_set("_k")).alias("_ks"))
    first = F.array_min(F.filter(F.sequence(F.lit(1), F.size("_ks") + 1), lambda k: ~F.array_contains("_ks", k)))
    out = wanted.join(own.select("_base", first.alias("_k")), wanted[name] == F.col("_base"), "left")
    return out.withColumn("free", F.when(F.coalesce("_k", F.lit(1)) == 1, F.col(name)).otherwise(F.concat(F.col(name), F.lit("__"), F.col("_k").cast("string")))).drop("_base", "_k")


def write_csv(rows: DataFrame, folder: str, name: str = "file_name") -> None:
    """A folder `file_name=...` for each class, written by its own tasks."""
    rows.repartition(name).write.mode("errorifexists").partitionBy(name).option("header", True).csv(folder)


def write_xlsx(rows: DataFrame, folder: str, name: str = "file_name") -> DataFrame:
    """(file_name, path, n_rows): one workbook a class, in a folder that the executors share. Needs the optional openpyxl."""
    try:
        import openpyxl  # noqa: F401
    except ImportError as e:
        raise NotImplementedError("XLSX needs the optional package openpyxl; write_csv doesn't") from e
    columns = [c for c in rows.columns if c != name]

    def book(pdf: pd.DataFrame) -> pd.DataFrame:
        from openpyxl import Workbook
        from openpyxl.styles import Font
        from openpyxl.utils import get_column_letter

        file = pdf[name].iloc[0]
        wb = Workbook()
        ws = wb.active
        ws.title = file[:31]
        ws.append(columns)
        for i, c in enumerate(columns, 1):
            ws.cell(1, i).font = Font(bold=True)
            ws.column_dimensions[get_column_letter(i)].width = WIDTHS.get(c, 20)
        ws.freeze_panes = "A2"
        for row in pdf[columns].itertuples(index=False):
            ws.append(list(row))
        path = f"{folder}/{file}.xlsx"
        wb.save(path)
        return pd.DataFrame([(file, path, len(pdf))], columns=[name, "path", "n_rows"])

    return rows.groupBy(name).applyInPandas(book, f"{name} string, path string, n_rows long")


def photo_names(rows: DataFrame, cased: bool = False) -> DataFrame:
    """rows (source, id, surnames, given_names, nia) with by_number and by_name, the file stems of their photos.

    Namesakes within a source all get a number; by_number is null without a number.
    """
    stem = tx.file_stem(F.col("surnames"), F.col("given_names"))
    named = rows.withColumn("_stem", tx.recased_stem(stem) if cased else stem)
    named = numbered_names(named, ["source"], "_stem", ["id"], "by_name").drop("_stem")
    number = F.trim(F.coalesce("nia", F.lit("")))
    return named.withColumn("by_number", F.when(number != "", tx.safe_file_name(number)))


def write_photos(photos: DataFrame, folder: str) -> DataFrame:
    """(path, n_bytes) of photos (name, image binary) written below a folder that the executors share."""

    def save(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            done = []
            for name, image in zip(pdf["name"], pdf["image"]):
                path = f"{folder}/{name}.png"
                with open(path, "wb") as f:
                    f.write(image)
                done.append((path, len(image)))
            yield pd.DataFrame(done, columns=["path", "n_bytes"])

    return photos.select("name", "image").mapInPandas(save, "path string, n_bytes long")


def manifest(items: DataFrame) -> DataFrame:
    """One text line an item: status, source, file and counts."""
    return items.select(F.concat_ws("\t", "status", "source", "file_name", F.col("n_rows").cast("string")).alias("value"))
