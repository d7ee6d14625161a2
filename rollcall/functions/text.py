"""Scalar text functions as Column expressions: cleaning, folding, matching keys, name casing, file names.

All run in the JVM. Folding uses a table of Latin letters derived from Unicode; `fold(..., exact=True)` calls the
Unicode database through an Arrow UDF instead, for scripts outside that table. Null in, null out, unless a docstring
says otherwise.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

LETTER = r"\p{L}"
NAME_PART = rf"[{LETTER}\-'’]+"
#: Key tiers, from strict to lax.
TIERS = ("exact", "structural", "folded", "compact")
# Words that stay in lower case inside a name of several words.
PARTICLES = ("de", "del", "la", "las", "los", "da", "das", "do", "dos", "e", "i", "y")


def _latin_table() -> tuple[str, str, dict[str, str]]:
    """Latin letters with marks: single replacements for translate(), and longer ones."""
    short, long = {}, {"ß": "ss", "ẞ": "ss"}
    for code in (*range(0xAA, 0x250), *range(0x1E00, 0x1F00), *range(0xFB00, 0xFB07), *range(0xFF01, 0xFF5F)):
        c = chr(code)
        plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if plain != c and plain.isalnum():
            (short if len(plain) == 1 else long)[c] = plain
    return "".join(short), "".join(short.values()), long


SHORT_FROM, SHORT_TO, LONG = _latin_table()
MARKS = r"\p{M}"


def _compatible_table() -> tuple[str, str, dict[str, str]]:
    """Compatibility forms (full width, ligatures, ordinals, ...) and what they stand for, marks composed."""
    short, long = {}, {}
    for code in (*range(0xA0, 0x250), *range(0x2000, 0x2100), *range(0x2100, 0x2190), *range(0xFB00, 0xFB07), *range(0xFF01, 0xFF5F)):
        c = chr(code)
        plain = unicodedata.normalize("NFKC", c)
        if plain != c and plain:
            (short if len(plain) == 1 else long)[c] = plain
    return "".join(short), "".join(short.values()), long


def _composed_table() -> dict[str, str]:
    """A Latin letter and a mark after it, and the one letter that they make."""
    pairs = {}
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) > 1 and unicodedata.normalize("NFC", parts) == chr(code):
            pairs[unicodedata.normalize("NFC", parts[:-1]) + parts[-1]] = chr(code)
    return pairs


COMPATIBLE_FROM, COMPATIBLE_TO, COMPATIBLE_LONG = _compatible_table()
COMPOSED = _composed_table()


def clean_spaces(c: Column) -> Column:
    """Runs of Unicode white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def is_numeric(c: Column) -> Column:
    return F.trim(c).rlike(r"^[0-9]+$")


def is_name_component(c: Column) -> Column:
    return c.rlike(rf"^{NAME_PART}$")


@F.pandas_udf(T.StringType())
def _exact_fold(s: pd.Series) -> pd.Series:
    def one(x):
        return None if x is None else "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c))

    return s.map(one)


def ascii_only(c: Column) -> Column:
    """Whether each letter is one byte, so nothing has to be folded."""
    return F.octet_length(c) == F.length(c)


def strip_marks(c: Column, exact: bool = False) -> Column:
    """Letters without diacritics, compatibility forms resolved."""
    if exact:
        return _exact_fold(c)
    return F.when(ascii_only(c), c).otherwise(_strip_marks(c))


def _strip_marks(c: Column) -> Column:
    out = F.translate(F.regexp_replace(c, MARKS, ""), SHORT_FROM, SHORT_TO)
    long = {k: v for k, v in LONG.items() if k not in "ßẞ"}
    spelled = F.aggregate(F.map_entries(constant_map(long)), out, lambda done, x: F.replace(done, x["key"], x["value"]))
    return F.when(out.rlike(f"[{''.join(long)}]"), spelled).otherwise(out)


def compose(c: Column) -> Column:
    """Compatibility forms resolved and letters joined with the marks after them, for Latin letters; marks in any other
    than the canonical order, and other scripts, stay as they are."""
    return F.when(ascii_only(c), c).otherwise(_compose(c))


def constant_map(pairs: dict[str, str]) -> Column:
    """The map as one expression, which the plan folds into a literal: keys are made often, and a call for each letter took
    longer than the work on small tables."""
    return F.str_to_map(F.lit("\x1e".join(f"{k}\x1f{v}" for k, v in pairs.items())), F.lit("\x1e"), F.lit("\x1f"))


def _compose(c: Column) -> Column:
    out = F.translate(c, COMPATIBLE_FROM, COMPATIBLE_TO)
    rare = constant_map(COMPATIBLE_LONG)
    spelled = F.array_join(F.transform(F.split(out, ""), lambda x: F.coalesce(F.try_element_at(rare, x), x)), "")
    out = F.when(out.rlike(f"[{''.join(COMPATIBLE_LONG)}]"), spelled).otherwise(out)
    known = constant_map(COMPOSED)

    def joined(done: Column, piece: Column) -> Column:
        both = F.concat(F.right(done, F.lit(1)), F.left(piece, F.lit(1)))
        return F.concat(F.left(done, F.length(done) - 1), F.coalesce(F.try_element_at(known, both), both), F.substring(piece, 2, 2**30))

    whole = F.aggregate(F.split(out, rf"(?={MARKS})"), F.lit(""), joined)
    return F.when(out.rlike(MARKS), whole).otherwise(out)


def fold_case(c: Column) -> Column:
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def person_name(c: Column) -> Column:
    """struct(full_name, surnames, given_names) of `Surnames, Given`, null if the text is no such name."""
    text = clean_spaces(c)
    words = rf"{NAME_PART}(?: {NAME_PART})*"
    pattern = rf"^({words}), ({words})$"
    surnames, given = F.regexp_extract(text, pattern, 1), F.regexp_extract(text, pattern, 2)
    return F.when(surnames != "", F.struct(F.concat_ws(", ", surnames, given).alias("full_name"), surnames.alias("surnames"), given.alias("given_names")))


def continues_name(c: Column) -> Column:
    """Only name components, no comma."""
    return clean_spaces(c).rlike(rf"^{NAME_PART}(?: {NAME_PART})*$")


def label_key(c: Column) -> Column:
    """Upper case, letters only, accents kept."""
    return F.regexp_replace(F.upper(c), rf"[^{LETTER}]", "")


def header_token(c: Column) -> Column:
    """Upper case, unaccented, letters and digits only."""
    return F.regexp_replace(F.upper(strip_marks(c)), r"[^\p{L}\p{N}]", "")


def _spelled(words: Sequence[str], between: str) -> str:
    return "|".join(f"^{between}" + between.join(w) + f"{between}$" for w in words)


def has_label(c: Column, labels: Sequence[str]) -> Column:
    """Whether label_key() is one of the labels, which are letters: fails at the first other letter."""
    return F.upper(c).rlike(_spelled(labels, rf"[^{LETTER}]*"))


def has_token(c: Column, tokens: Sequence[str]) -> Column:
    """Whether header_token() is one of the tokens, which are letters and digits."""
    return F.upper(strip_marks(c)).rlike(_spelled(tokens, r"[^\p{L}\p{N}]*"))


def group_code(c: Column) -> Column:
    """What stands before the first spaced dash; null if nothing does."""
    text = clean_spaces(c)
    return F.nullif(F.trim(F.split(text, r"\s+-\s+", 2)[0]), F.lit(""))


def course_key(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.upper(strip_marks(c)), r"[^A-Z0-9]+", " "))


def courses_compatible(a: Column, b: Column) -> Column:
    """Course keys: equal, either empty, or one the other's beginning up to a word's end."""
    return (a == "") | (b == "") | (a == b) | a.startswith(F.concat(b, F.lit(" "))) | b.startswith(F.concat(a, F.lit(" ")))


def header_value(tokens: Column) -> Column:
    """The words of a header value without colons and stars, joined; null if none is left."""
    bare = F.transform(tokens, lambda t: F.trim(F.regexp_replace(F.trim(t), "^:+", "")))
    return F.nullif(clean_spaces(F.array_join(F.filter(bare, lambda t: ~t.isin("", "***")), " ")), F.lit(""))


def name_key(c: Column, tier: str, exact: bool = False) -> Column:
    """A name part's key in a tier: case and space; also punctuation; also marks; also word breaks.

    Composed and decomposed letters and compatibility forms have one key in every tier.
    """
    if tier == "exact":
        return clean_spaces(fold_case(clean_spaces(compose(c))))
    if tier not in TIERS:
        raise ValueError(f"unknown tier {tier!r}")
    text = fold_case(compose(c)) if tier == "structural" else fold_case(strip_marks(c, exact))
    gap = "" if tier == "compact" else " "
    return F.trim(F.regexp_replace(text, r"[^\p{L}\p{N}]+", gap))


def group_key(c: Column) -> Column:
    """Like a compact key; null becomes empty."""
    return F.coalesce(name_key(c, "compact"), F.lit(""))


def folded_tokens(c: Column) -> Column:
    """Words of the folded text; underscores belong to words."""
    text = F.regexp_replace(fold_case(strip_marks(c)), r"[^\p{L}\p{N}_]+", " ")
    return F.filter(F.split(F.trim(text), " "), lambda t: t != "")


def is_subsequence(short: Column, long: Column) -> Column:
    """Whether the words of `short` occur in `long` in this order."""
    found = F.aggregate(long, F.lit(0), lambda i, t: F.when((i < F.size(short)) & (F.get(short, i) == t), i + 1).otherwise(i))
    return (F.size(short) > 0) & (found == F.size(short))


def differently_long_subsequence(a: Column, b: Column) -> Column:
    return (F.size(a) != F.size(b)) & (is_subsequence(a, b) | is_subsequence(b, a))


def similarity(a: Column, b: Column) -> Column:
    """1 less the edit distance's share of the longer text; 1 for two empty ones."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1.0 - F.levenshtein(a, b) / longest)


def fuzzy_scores(surname_a: Column, given_a: Column, surname_b: Column, given_b: Column, surname: Column | None = None) -> tuple[Column, Column, Column]:
    """(score, surname score, given score) of folded keys; the weights are doubles, summed from left to right. surname: the
    surname score where it is known."""
    s, g = similarity(surname_a, surname_b) if surname is None else surname, similarity(given_a, given_b)
    full = similarity(F.concat_ws(" ", surname_a, given_a), F.concat_ws(" ", surname_b, given_b))
    return F.lit(0.55) * s + F.lit(0.35) * g + F.lit(0.10) * full, s, g


def name_case(c: Column) -> Column:
    """A name in capitals as it is written: words and their hyphened parts capitalised, particles of a longer name in lower
    case, Roman numerals and words that have lower case already as they are, Mc followed by a capital."""
    words = F.filter(F.split(clean_spaces(c), " "), lambda w: w != "")
    has_lower = lambda w: w.rlike(r"\p{Ll}")

    def piece(p: Column) -> Column:
        low = F.lower(p)
        mc = F.concat(F.lit("Mc"), F.upper(F.substring(low, 3, 1)), F.substring(low, 4, 2**30))
        plain = F.concat(F.upper(F.substring(low, 1, 1)), F.substring(low, 2, 2**30))
        return F.when(p.rlike("^[IVXLCDM]+$"), p).when(low.rlike(rf"^mc{LETTER}"), mc).otherwise(plain)

    def word(w: Column) -> Column:
        parts = F.split(w, r"(?<=[-'’])|(?=[-'’])")
        return F.array_join(F.transform(parts, piece), "")

    cased = F.transform(words, lambda w: F.when(has_lower(w), w).when((F.size(words) > 1) & F.lower(w).isin(*PARTICLES), F.lower(w)).otherwise(word(w)))
    return F.array_join(cased, " ")


def identity(nia: Column, surnames: Column, given: Column) -> Column:
    """struct(kind, value): the number if there is one, else the folded name; the two never meet."""
    number = F.trim(F.coalesce(nia, F.lit("")))
    name = F.concat_ws("|", name_key(surnames, "folded"), name_key(given, "folded"))
    return F.when(number != "", F.struct(F.lit("nia").alias("kind"), number.alias("value"))).otherwise(F.struct(F.lit("name").alias("kind"), name.alias("value")))


def safe_file_name(c: Column, default: str = "grupo") -> Column:
    """Without characters that file systems refuse; null or nothing left gives the default."""
    text = F.regexp_replace(clean_spaces(c), r'[<>:"/\\|?*]', "_")
    return F.coalesce(F.nullif(F.regexp_replace(text, r"^[ ._]+|[ ._]+$", ""), F.lit("")), F.lit(default))


def safe_sheet_name(c: Column, default: str = "Alumnado") -> Column:
    text = F.regexp_replace(F.regexp_replace(clean_spaces(c), r"[\[\]:*?/\\]", "_"), "^'+|'+$", "")
    return F.substring(F.coalesce(F.nullif(text, F.lit("")), F.lit(default)), 1, 31)


def file_stem(surnames: Column, given: Column) -> Column:
    """`Surnames, Given` as a safe name."""
    return safe_file_name(F.concat_ws(", ", surnames, given))


def recased_stem(stem: Column) -> Column:
    """A stem with its name in written case; a trailing __n stays."""
    suffix = F.regexp_extract(stem, r"(__[0-9]+)$", 1)
    body = F.regexp_replace(stem, r"__[0-9]+$", "")
    parts = F.split(body, ", ", 2)
    cased = F.when(F.size(parts) == 2, F.concat_ws(", ", name_case(parts[0]), name_case(F.get(parts, F.lit(1))))).otherwise(name_case(body))
    return F.concat(cased, suffix)


def score_text(c: Column) -> Column:
    return F.coalesce(F.format_number(c, 3), F.lit("n/a"))
