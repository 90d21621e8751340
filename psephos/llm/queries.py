"""A thin query per operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, chat, credentials, decontaminate, langid, licenses, lines, mixing, near, oracles, pii, resampling, substrings, topk

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        "contaminated",
    )


ORACLES["op1_decontaminate"] = oracles.DECONTAMINATE


@query
def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.repeated_substrings(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


ORACLES["op8_substring_dedup"] = oracles.SUBSTRINGS


@query
def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicates(table(spark, sf_dir, "documents"))


ORACLES["op10_ngram_jaccard_join"] = oracles.NEAR


@query
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = langid.identify(table(spark, sf_dir, "documents"))
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "ambiguous")


@query
def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_data(table(spark, sf_dir, "documents"))
    counts = {f"n_{kind}": F.expr(f"cast(size(filter(base, s -> s.kind = '{kind}')) as bigint)") for kind in pii.BASE_KINDS}
    return found.select(
        "doc_id",
        *(c.alias(name) for name, c in counts.items()),
        F.sha2(pii.spans_text("base"), 256).alias("base_sha256"),
        pii.spans_text(F.concat("base", "found")).alias("spans"),
        F.size("found").cast("bigint").alias("n_found"),
        (F.size("base") + F.size("found") > 0).alias("flagged"),
    )


@query
def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


ORACLES["op4_exact_topk"] = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
), r AS (
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


@query
def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    return chat.digests(rows.unionByName(more)).drop("n_tokens", "loss_tokens")


ORACLES["op9_chat_format"] = oracles.CHAT


@query
def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in a mix of the sources by their target weights."""
    return mixing.mixed(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), mixing.TARGETS)


ORACLES["op7_mix_sources"] = mixing.ORACLE_SQL


@query
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLES["op5_line_dedup"] = lines.ORACLE_SQL


@query
def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Effective licences of the documents, each being a file of the tree given by its source and language.

    The document of a directory that states a licence most plainly, anywhere in its text, is the directory's licence file.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", "source", "lang", F.concat("doc_id", F.lit(".txt"))).alias("path"), "text")
    return licenses.effective_licenses(docs, "doc_id", elect=True)


ORACLES["op3_license_scan"] = licenses.oracle_sql()


@query
def op13_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.link_support(table(spark, sf_dir, "documents"))


@query
def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resampling.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


ORACLES["op12_importance_resampling"] = oracles.RESAMPLE


@query
def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = credentials.secret_scan(table(spark, sf_dir, "documents"))
    counts = {f"n_{kind}": F.expr(f"cast(size(filter(base, s -> s.kind = '{kind}')) as bigint)") for kind in credentials.BASE_KINDS}
    return found.select(
        "doc_id",
        *(c.alias(name) for name, c in counts.items()),
        F.sha2(credentials.spans_text("base"), 256).alias("base_sha256"),
        credentials.spans_text("base", "found").alias("spans"),
        F.size("found").cast("bigint").alias("n_found"),
    )


ORACLES["op11_secret_scan"] = credentials.ORACLE_SQL
