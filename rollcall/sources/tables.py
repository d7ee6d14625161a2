"""Inputs: tables of positioned words, blocks and images, lists of document files, and an optional PDF decoder."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORDS = "source string, page int, block int, line int, word_no int, text string, x0 double, y0 double, x1 double, y1 double, page_w double, page_h double, rotation int"
BLOCKS = "source string, page int, block int, text string, x0 double, y0 double, x1 double, y1 double, line_count int, line_height double"
IMAGES = "source string, page int, xref int, x0 double, y0 double, x1 double, y1 double, width_px int, height_px int, page_w double, page_h double"


def read(spark: SparkSession, path: str, schema: str, format: str = "parquet") -> DataFrame:
    """A table in a fixed schema, from any format that Spark reads."""
    return spark.read.schema(schema).format(format).load(path)


def document_files(spark: SparkSession, paths: Sequence[str], recursive: bool = True, suffix: str = "pdf") -> DataFrame:
    """(path, length) of the documents under files and folders, each once, by path without case, the suffix in any case;
    a path that is missing is an error."""
    pattern = "*." + "".join(f"[{x.lower()}{x.upper()}]" for x in suffix)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).option("pathGlobFilter", pattern).load(list(paths))
    return files.select("path", "length").dropDuplicates(["path"]).orderBy(F.lower("path"))


def references_for(files: DataFrame, source: str) -> DataFrame:
    """The reference files of a source: all files but itself."""
    return files.where(F.col("path") != source)


def pdf_words(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Words of PDF files, one task a file. Needs a PDF library, which is optional and never bundled."""
    try:
        import pymupdf  # noqa: F401
    except ImportError as e:
        raise NotImplementedError("reading PDF files needs the optional package pymupdf; tables of words don't") from e

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pymupdf

        names = [c.split()[0] for c in WORDS.split(", ")]
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                rows = []
                with pymupdf.open(stream=content, filetype="pdf") as doc:
                    for n, page in enumerate(doc, 1):
                        for x0, y0, x1, y1, text, block, line, word in page.get_text("words", sort=False):
                            rows.append((path, n, block, line, word, text, x0, y0, x1, y1, page.cropbox.width, page.cropbox.height, page.rotation))
                yield pd.DataFrame(rows, columns=names)

    files = spark.read.format("binaryFile").load(list(paths)).select("path", "content")
    return files.mapInPandas(decode, WORDS)


def classify(signatures: DataFrame, n_students: DataFrame, n_slots: DataFrame, files: DataFrame) -> DataFrame:
    """(source, kind): reference with a known header and students, else photo with named slots, else unsupported."""
    own = files.select(F.col("path").alias("source")).join(signatures.select("source", F.lit(True).alias("_sig")), "source", "left")
    own = own.join(n_students.select("source", "n_students"), "source", "left").join(n_slots.select("source", "n_slots"), "source", "left")
    kind = F.when(F.col("_sig") & (F.col("n_students") > 0), "reference").when(F.col("n_slots") > 0, "photo").otherwise("unsupported")
    return own.select("source", kind.alias("kind"))
