"""The queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, hmm, licenses, mixing, pii, quality, secret_scan, simhash, tokens
from .common import table


def vocabulary(name: str) -> str:
    """Where the box keeps a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicate_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex(F.element_at("fp", 1)), 16, "0")).alias("fingerprint"), "component_id")


def op2_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken")).drop("found")


AWKWARD = "\\### Assistant: </turn> ok"


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(AWKWARD).alias("text"))
    found = chat.read_back(chat.format_conversations(turns.unionByName(more)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return found.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target weights: the k-th of the sources in order of names weighs 1 / k."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    names = sorted(r["source"] for r in docs.select("source").distinct().collect() if r["source"] is not None)
    return mixing.mixed(docs, {s: 1 / k for k, s in enumerate(names, 1)} or None)


def pii_key(spark: SparkSession) -> str:
    """The job's setting spark.cueweave.pii.key; without it a fixed one, for queries and tests."""
    return spark.conf.get("spark.cueweave.pii.key", "a key for tests")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymise(docs, pii_key(spark), count_col="n_replaced")


def op9_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.scores(table(spark, sf_dir, "documents"))


def op10_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_decontam": op2_decontam,
    "op3_quality": op3_quality,
    "op4_secrets": op4_secrets,
    "op5_chat": op5_chat,
    "op6_licenses": op6_licenses,
    "op7_mixing": op7_mixing,
    "op8_pii": op8_pii,
    "op9_hmm": op9_hmm,
    "op10_tokens": op10_tokens,
}

SQL: dict[str, str] = {
    # The renderer escapes turns that hold a control string, and those whose role holds the mark between role and text.
    "op5_chat": r"""
        WITH given AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
            UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
        marked AS (
            SELECT *, contains(role || ' ' || text, '###') OR contains(role || ' ' || text, '</turn>') OR contains(role, ': ') AS escaped,
                replace(replace(replace(replace(role, '\', '\\'), '###', '\h'), '</turn>', '\t'), ': ', '\c') AS role2,
                replace(replace(replace(replace(text, '\', '\\'), '###', '\h'), '</turn>', '\t'), ': ', '\c') AS text2
            FROM given),
        folded AS (
            SELECT conv_id, count(*) AS n_turns,
                string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
                coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
                sum(CASE WHEN escaped THEN 15 + length(role2) + length(text2) ELSE 14 + length(role) + length(text) END) AS chars
            FROM marked GROUP BY conv_id)
        SELECT conv_id, n_turns, sha256(said) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
            sha256(loss) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars
        FROM folded""",
}
