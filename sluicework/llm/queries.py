"""The registered queries of these operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, functions as F

from sluicework.llm import (
    chat, clustering, decontamination, hard_negatives, language, licences, near_duplicates, nearest, packing, page_text, quality, substrings,
    token_files,
)
from sluicework.llm.frames import documents, staging_path

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql:
            ORACLE[name] = sql
        return function

    return register


@query("op1_token_files")
def op1_token_files(spark, sf_dir: str) -> DataFrame:
    path = staging_path(spark, "tokens")
    token_files.write_tokens(documents(spark, sf_dir), path, public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.read_tokens(spark, path)


@query("op9_best_fit_packing")
def op9_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


@query("op7_licence_scan")
def op7_licence_scan(spark, sf_dir: str) -> DataFrame:
    found = licences.scan(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "permissive")


@query("op8_decontamination")
def op8_decontamination(spark, sf_dir: str) -> DataFrame:
    found = decontamination.overlaps(documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), decontamination.is_contaminated().alias("contaminated"),
    )


@query("op4_language_bitmask")
def op4_language_bitmask(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = language.identify(docs.select("doc_id", "text"), language.train(docs))
    return found.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


@query(
    "op5_exact_top_k",
    """WITH v AS (SELECT vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings
                  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
       s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
             FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0),
       r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
       SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5""",
)
def op5_exact_top_k(spark, sf_dir: str) -> DataFrame:
    vectors = nearest.quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return nearest.top_k(vectors.where("vec_id % 50 = 0"), vectors)


@query(
    "op10_chat_collapse",
    """WITH t AS (SELECT conv_id, row_number() OVER w AS place, struct_pack(r := role, t := text) AS s,
                         '<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) AS piece
                  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST)),
       c AS (SELECT conv_id, count(*) AS n_turns, list(s ORDER BY place) AS turns, string_agg(piece, '' ORDER BY place) AS text FROM t GROUP BY conv_id),
       u AS (SELECT min(conv_id) AS conv_id, n_turns, count(*) AS n_copies, turns, any_value(text) AS text FROM c GROUP BY turns, n_turns),
       p AS (SELECT DISTINCT turns[1:k] AS turns FROM (SELECT turns, unnest(range(1, n_turns)) AS k FROM u))
       SELECT conv_id, n_turns, n_copies, text FROM u ANTI JOIN p USING (turns)""",
)
def op10_chat_collapse(spark, sf_dir: str) -> DataFrame:
    return chat.render(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


@query("op2_hyperminhash")
def op2_hyperminhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(documents(spark, sf_dir), size=3, part=85, whole=100)


@query("op6_suffix_automata")
def op6_suffix_automata(spark, sf_dir: str) -> DataFrame:
    left = substrings.remove_repeats(documents(spark, sf_dir).select("doc_id", "text"), window=20)
    return left.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op3_ordinal_quality")
def op3_ordinal_quality(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = quality.train(docs, quality.ratings_of(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    graded = quality.grade(docs.select("doc_id", "text"), model)
    return graded.select("doc_id", "expected_grade", "tails", quality.is_accepted().alias("accepted"))


@query(
    "op13_hard_negatives",
    """WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                         [floor(256 * x::DOUBLE) FOR x IN embedding] AS v
                  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
                   AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
       s AS (SELECT a.vec_id AS anchor_id, a.label AS anchor_label, c.vec_id, c.label, list_dot_product(a.v, c.v)::BIGINT AS score
             FROM r a JOIN r c ON c.vec_id <> a.vec_id AND len(c.v) = len(a.v) WHERE a.vec_id % 50 = 0),
       p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE label = anchor_label
             QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
       n AS (SELECT p.anchor_id, p.positive_id, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
             FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.label <> s.anchor_label
              AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score)
       SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM (
         SELECT *, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY negative_score DESC, negative_id)::INTEGER AS rank FROM n)
       WHERE rank <= 3""",
)
def op13_hard_negatives(spark, sf_dir: str) -> DataFrame:
    rows = hard_negatives.labelled(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return hard_negatives.mine(rows, F.col("vec_id") % 50 == 0, positives=5, negatives=3, low=50, high=95)


def _lloyd_sql(k: int = 16, rounds: int = 3, dim: int = 64) -> str:
    """DuckDB twin of op12: the rounds written out one after the other."""
    distance = f"list_sum([(v.v[i] - c.c[i]) * (v.v[i] - c.c[i]) FOR i IN range(1, {dim + 1})])"
    parts = [
        f"""v AS (SELECT vec_id, [floor(64 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
              WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) = {dim}
                AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0)""",
        f"""c0 AS (SELECT cluster, v AS c FROM (SELECT (row_number() OVER (ORDER BY sha256('1:' || vec_id::VARCHAR), v) - 1)::INTEGER AS cluster, v FROM v)
               WHERE cluster < {k})""",
    ]
    for r in range(rounds + 1):
        parts.append(
            f"""a{r} AS (SELECT vec_id, v, cluster, distance FROM (
                   SELECT v.vec_id, v.v, c.cluster, {distance} AS distance,
                          row_number() OVER (PARTITION BY v.vec_id ORDER BY {distance}, c.cluster) AS n FROM v, c{r} c) WHERE n = 1)"""
        )
        if r < rounds:
            parts.append(
                f"""c{r + 1} AS (SELECT cluster, list(((s - (((s % n) + n) % n)) // n)::BIGINT ORDER BY i) AS c FROM (
                        SELECT a.cluster, i, sum(a.v[i]) AS s, count(*) AS n FROM a{r} a, range(1, {dim + 1}) t(i) GROUP BY a.cluster, i)
                      GROUP BY cluster
                      UNION ALL SELECT cluster, c FROM c{r} WHERE cluster NOT IN (SELECT cluster FROM a{r}))"""
            )
    return (
        "WITH " + ",\n".join(parts)
        + f"""
        SELECT a.vec_id, a.cluster, a.distance::BIGINT AS distance,
               (sum(a.distance) OVER (PARTITION BY a.cluster))::BIGINT AS cluster_inertia, (sum(a.distance) OVER ())::BIGINT AS inertia,
               sha256(array_to_string(c.c, ',')) AS centroid_sha256
        FROM a{rounds} a JOIN c{rounds} c USING (cluster)"""
    )


@query("op12_va_file_clustering", _lloyd_sql())
def op12_va_file_clustering(spark, sf_dir: str) -> DataFrame:
    vectors = clustering.kept(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), dim=64, scale=64)
    return clustering.cluster(vectors, k=16, rounds=3, bits=3, dim=64, seed="1:")


@query("op11_block_lstm")
def op11_block_lstm(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return page_text.extract(pages, page_text.train(pages))
