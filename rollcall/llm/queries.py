"""The registered queries of this subpackage, with their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontam, langid, merkle, order_minhash, pii, pitman_yor, secret_ledger, suffixes, urls
from .common import table


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(table(spark, sf_dir, "documents"), vocabulary())


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_ledger.report(table(spark, sf_dir, "documents"))


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op5_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove(table(spark, sf_dir, "documents")).drop("spans")


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.report(table(spark, sf_dir, "documents"))


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.report(table(spark, sf_dir, "documents"))


def op9_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.report(table(spark, sf_dir, "documents"), order=2)


def op10_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.report(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # it imports this module

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_pii": op2_pii,
    "op3_secrets": op3_secrets,
    "op4_urls": op4_urls,
    "op5_decontam": op5_decontam,
    "op6_suffixes": op6_suffixes,
    "op7_near_duplicates": op7_near_duplicates,
    "op8_langid": op8_langid,
    "op9_pitman_yor": op9_pitman_yor,
    "op10_merkle": op10_merkle,
    "pipeline": pipeline,
}


def _op3_sql() -> str:
    """Offsets as in the operator: matches and the pieces between them follow the same search."""
    kinds = []
    for k, r in enumerate(secret_ledger.RULES):
        pattern = r.pattern.replace("'", "''")
        good = f"length(regexp_extract(hit, '{pattern}', {r.group})) >= {r.least}"
        kinds.append(f"""SELECT doc_id, {k} AS k, '{r.name}' AS rule, i, hit, start_at, start_at + length(hit) AS end_at FROM (
            SELECT doc_id, i, hits[i] AS hit,
                list_sum([length(g) FOR g IN gaps[1:i]]) + coalesce(list_sum([length(h) FOR h IN hits[1:i - 1]]), 0) AS start_at
            FROM (SELECT doc_id, hits, gaps, unnest(range(1, len(hits) + 1)) AS i FROM (
                SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{pattern}') AS hits,
                    string_split_regex(coalesce(text, ''), '{pattern}') AS gaps FROM documents)))
            WHERE {good}""")
    base = len(secret_ledger.BASE)
    shown = "rule || ':' || start_at::BIGINT || ':' || end_at::BIGINT"
    counts = ", ".join(f"(count(*) FILTER (k = {k}))::BIGINT AS n_{r.name}" for k, r in enumerate(secret_ledger.BASE))
    return f"""WITH s AS ({' UNION ALL '.join(kinds)})
        SELECT doc_id, {counts},
            sha256(coalesce(string_agg({shown}, ',' ORDER BY start_at, k) FILTER (k < {base}), '')) AS base_sha256,
            coalesce(string_agg({shown}, ',' ORDER BY start_at, k), '') AS spans
        FROM documents LEFT JOIN s USING (doc_id) GROUP BY doc_id"""


def _op10_sql() -> str:
    piece = merkle.PIECE.replace("'", "''")

    def leaves(text: str) -> str:
        return (
            f"[[[sha256(x) FOR x IN regexp_extract_all(p, '{piece}')] FOR p IN string_split(s, chr(10))]"
            f" FOR s IN string_split({text}, chr(10) || chr(10))]"
        )

    def fingerprint(tree: str) -> str:
        root = f"sha256(array_to_string([sha256(array_to_string([sha256(array_to_string(p, ',')) FOR p IN s], ',')) FOR s IN {tree}], ','))"
        body = f"array_to_string([array_to_string([array_to_string([x[1:{merkle.DIGITS}] FOR x IN p], '') FOR p IN s], '.') FOR s IN {tree}], '/')"
        return f"{root} || ':' || {body}"

    def near(a: str, b: str) -> str:
        sets = [f"list_distinct(regexp_extract_all(regexp_replace(substring({c}, 66), '[./]', '', 'g'), '[0-9a-f]{{{merkle.DIGITS}}}'))" for c in (a, b)]
        sizes = f"(len({sets[0]}) + len({sets[1]}))"
        return (
            f"CASE WHEN {a}[1:64] = {b}[1:64] THEN 1.0::DOUBLE WHEN {sizes} = 0 THEN 0.0::DOUBLE"
            f" ELSE 2.0::DOUBLE * len(list_intersect({sets[0]}, {sets[1]})) / {sizes} END"
        )

    return f"""WITH a AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
        b AS (SELECT doc_id, x, coalesce(lead(x) OVER (ORDER BY doc_id DESC),
            first_value(x) OVER (ORDER BY doc_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS y FROM a),
        c AS (SELECT *, substring(x, 1, length(x) - length(x) // 2) || substring(y, 1, length(x) // 2) AS e FROM b),
        d AS (SELECT *, {leaves('x')} AS tx, {leaves('y')} AS ty, {leaves('e')} AS te FROM c),
        f AS (SELECT doc_id, length(x)::BIGINT AS n_chars, sha256(e) AS edited_sha256, {fingerprint('tx')} AS fingerprint,
            {fingerprint('te')} AS edited_fingerprint, {fingerprint('ty')} AS next_fingerprint FROM d)
        SELECT doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
            {near('fingerprint', 'edited_fingerprint')} AS near_edited, {near('fingerprint', 'next_fingerprint')} AS near_next
        FROM f"""


ORACLES: dict[str, str] = {"op3_secrets": _op3_sql(), "op10_merkle": _op10_sql()}
