"""One query for each training-data operator, with production parameters, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from castline.llm import secret_tags
from castline.llm.bpe_automaton import encode_texts
from castline.llm.centroids import cluster_vectors
from castline.llm.chat import format_turns
from castline.llm.common import table
from castline.llm.embedding_dedup import near_duplicates as near_duplicate_vectors
from castline.llm.language_id import fit, identify, remainder
from castline.llm.line_templates import drop_repeated_lines
from castline.llm.media import media_digests, media_rows
from castline.llm.ngram_join import near_duplicates as near_duplicate_documents
from castline.llm.packing import pack_documents
from castline.llm.token_counts import count_tokens
from castline.llm.url_filters import judge_urls
from castline.llm.whitening import whiten

BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of every document: texts with a Jaccard similarity of 0.75 over five-word shingles are linked."""
    return near_duplicate_documents(table(spark, sf_dir, "documents"))


def op2_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digests of the ids and of the decoded text of every document."""
    rows = encode_texts(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn with its recovered role, in canonical form."""
    return format_turns(table(spark, sf_dir, "conversations"))


def op4_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every document and their places in sequences of 2048 tokens."""
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE), size=2048)


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's URL."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return judge_urls(table(spark, sf_dir, "pages"), rules)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document, by a model of the labelled ones that are not held out."""
    documents = table(spark, sf_dir, "documents")
    named = identify(documents, fit(documents))
    return named.select("doc_id", F.coalesce(remainder(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op7_media_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is read back from the media files and tensors of every document."""
    return media_digests(media_rows(table(spark, sf_dir, "documents")))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines whose template an earlier one has."""
    return drop_repeated_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", "text")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of tokens of every document."""
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), limit=512)


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links and the class of every vector, among those of its label."""
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"), cosine=0.98)


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's place on the first eight components, in standard deviations; a deviation that no long can hold is null."""
    return whiten(table(spark, sf_dir, "embeddings"), components=8).withColumn("deviation", F.expr("try_cast(deviation AS long)"))


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cluster of every vector after three rounds with 16 centroids."""
    return cluster_vectors(table(spark, sf_dir, "embeddings"), k=16, rounds=3, width=64, scale=64, seed=1)


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets of every document: the patterns' counts and digest, and all spans."""
    documents = table(spark, sf_dir, "documents")
    found = secret_tags.find_secrets(documents, secret_tags.fit(documents))
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "crf")
    return found.select("doc_id", of("assign"), of("access"), of("hex"), F.sha2(told(base), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_join": op1_ngram_join,
    "op2_bpe_roundtrip": op2_bpe_roundtrip,
    "op3_chat_format": op3_chat_format,
    "op4_pack_sequences": op4_pack_sequences,
    "op5_url_filter": op5_url_filter,
    "op6_language_id": op6_language_id,
    "op7_media_features": op7_media_features,
    "op8_line_dedup": op8_line_dedup,
    "op9_token_counts": op9_token_counts,
    "op10_embedding_dedup": op10_embedding_dedup,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_centroid_clusters": op12_centroid_clusters,
    "op13_secret_scan": op13_secret_scan,
}


def lloyd_sql(k: int = 16, rounds: int = 3, width: int = 64, scale: int = 64, seed: int = 1) -> str:
    """Lloyd's rounds written out: centroids c0 and, after each assignment a0, a1, ..., the next ones."""
    steps = [
        f"""kept AS MATERIALIZED (
            SELECT vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v, row_number() OVER () AS r
            FROM embeddings
            WHERE len(embedding) = {width} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {width})""",
        f"""c0 AS MATERIALIZED (
            SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id) NULLS LAST, v) - 1 AS cluster, v AS c
            FROM kept ORDER BY sha256('{seed}:' || vec_id) NULLS LAST, v LIMIT {k})""",
    ]
    for i in range(rounds + 1):
        steps.append(
            f"""a{i} AS MATERIALIZED (
            SELECT r, vec_id, v, min(struct_pack(d := d, cluster := cluster)) AS near FROM (
                SELECT r, vec_id, v, cluster, list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM kept, c{i})
            GROUP BY r, vec_id, v)"""
        )
        if i < rounds:
            steps.append(
                f"""c{i + 1} AS MATERIALIZED (
            SELECT c.cluster, coalesce(m.c, c.c) AS c FROM c{i} c LEFT JOIN (
                SELECT cluster, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY place) AS c FROM (
                    SELECT cluster, place, sum(x)::HUGEINT AS s, count(*)::HUGEINT AS n
                    FROM (SELECT near.cluster AS cluster, unnest(v) AS x, generate_subscripts(v, 1) AS place FROM a{i})
                    GROUP BY cluster, place) GROUP BY cluster) m ON m.cluster = c.cluster)"""
            )
    return (
        "WITH "
        + ",\n        ".join(steps)
        + f"""
        SELECT a.vec_id, a.near.cluster::INTEGER AS cluster, a.near.d AS distance,
               sum(a.near.d) OVER (PARTITION BY a.near.cluster)::BIGINT AS cluster_inertia, sum(a.near.d) OVER ()::BIGINT AS inertia,
               sha256(array_to_string(c.c, ',')) AS centroid_sha256
        FROM a{rounds} a JOIN c{rounds} c ON c.cluster = a.near.cluster"""
    )


ORACLE_SQL: dict[str, str] = {
    "op5_url_filter": r"""
        WITH cut AS (
            SELECT page_id,
                   translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
            FROM pages),
        ruled AS (
            SELECT *, CASE
                WHEN (host = 'example.net' OR suffix(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
                WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
                WHEN (host = 'org' OR suffix(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
                WHEN (host = 'net' OR suffix(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
            FROM cut)
        SELECT page_id, host, path, rule,
               CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict
        FROM ruled""",
    "op12_centroid_clusters": lloyd_sql(),
}
