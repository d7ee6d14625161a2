"""Reports that carry shapes and counts, never names, numbers or paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

# Header words that a layout report, or one of a photo document, may show.
SAFE_LABELS = ("ORDE", "NIA", "REPETIX", "COGNOMS", "I", "NOM", "MATERIA", "MODUL")
PHOTO_LABELS = (
    "ALUMNES", "ASSIGNATURA", "CENTRE", "COGNOMS", "CURS", "DISPONIBLE", "FOTOGRAFIA", "GRUP", "GRUPO", "I", "LLISTAT", "MATERIA",
    "MODUL", "NIA", "NO", "NOM", "PROFESSOR", "TUTOR",
)
#: Issue codes that a shared report may name.
SAFE_ISSUES = ("tutor_differs", "no_course", "courses_differ", "no_group", "not_in_sequence", "restart_without_section", "repeated_number", "no_signature", "no_students", "no_classes", "roster_invalid", "match_incomplete")


def shape(c: Column) -> Column:
    """What a word is made of, as <L3:D2:COMMA:HYPHEN:APOST:P1>: letters, digits, whether there are commas, hyphens or
    apostrophes, others. Only what occurs is named; an empty word is <EMPTY>."""
    n = lambda kept: F.length(F.regexp_replace(c, kept, ""))
    counted = lambda letter, k: F.when(k > 0, F.concat(F.lit(letter), k.cast("string")))
    flag = lambda name, inside: F.when(c.rlike(inside), F.lit(name))
    parts = F.concat_ws(
        ":", counted("L", n(r"\P{L}+")), counted("D", n(r"\P{Nd}+")), flag("COMMA", ","), flag("HYPHEN", "-"), flag("APOST", "['’]"),
        counted("P", n(r"[\p{L}\p{Nd},'’\-]+")),
    )
    return F.when(c == "", F.lit("<EMPTY>")).otherwise(F.concat(F.lit("<"), parts, F.lit(">")))


def mask(c: Column, ordinal: Column | None = None, labels: tuple[str, ...] = SAFE_LABELS, repeats: bool = True) -> Column:
    """A word as it may be shown: header words in capitals without marks, numbers by their length (ordinals by value), others
    by shape. repeats: a bare R, the mark of a repeater, is shown."""
    text, token = F.trim(c), tx.header_token(c)
    number = F.concat(F.lit("<NUM:"), F.length(text).cast("string"), F.lit(">"))
    if ordinal is not None:
        number = F.when(F.coalesce(ordinal, F.lit(False)), F.concat(F.lit("ORDE="), text.cast("long").cast("string"))).otherwise(number)
    shown = F.when(token.isin(*labels), token)
    if repeats:
        shown = shown.when(F.upper(text) == "R", F.lit("R"))
    return shown.when(tx.is_numeric(c), number).otherwise(shape(text))


def shape_counts(words: DataFrame, word: str = "w") -> DataFrame:
    """(shown, n): how often each masked word occurs. Words are counted first, so each distinct one is masked once."""
    counts = words.groupBy(word).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(mask(F.col(word)).alias("shown")).agg(F.sum("n").alias("n"))


def safe_issues(issues: Column) -> Column:
    """Known codes stay; all others become `other`."""
    return F.transform(issues, lambda x: F.when(x.isin(*SAFE_ISSUES), x).otherwise("other"))


def layout_report(words: DataFrame, anchors: DataFrame, reach: float = 12.0) -> DataFrame:
    """(source, page, ordinal, shown, vx0, vy0) of the words within `reach` points of an ordinal's row.

    words (source, page, text, vx0, vy0, cy), anchors (source, page, ordinal, visual_y).
    """
    near = words.join(anchors.select("source", "page", "ordinal", "visual_y"), ["source", "page"]).where(F.abs(F.col("cy") - F.col("visual_y")) <= reach)
    ordinal = F.col("text") == F.col("ordinal").cast("string")
    return near.select("source", "page", "ordinal", mask(F.col("text"), ordinal).alias("shown"), F.round("vx0", 1).alias("vx0"), F.round("vy0", 1).alias("vy0"))


def photo_layout_report(words: DataFrame, images: DataFrame) -> DataFrame:
    """(source, page, kind, shown, x0, y0, x1, y1): masked words and image boxes, never image bytes or their digests."""
    box = [F.round(c, 1).alias(n) for c, n in (("vx0", "x0"), ("vy0", "y0"), ("vx1", "x1"), ("vy1", "y1"))]
    text = words.select("source", "page", F.lit("word").alias("kind"), mask(F.col("text"), labels=PHOTO_LABELS, repeats=False).alias("shown"), *box)
    boxes = images.select("source", "page", F.lit("image").alias("kind"), F.lit("").alias("shown"), *(F.round(c, 1).alias(c) for c in ("x0", "y0", "x1", "y1")))
    return text.unionAll(boxes)
