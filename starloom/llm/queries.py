"""One query for each operator: (spark, folder of tables) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.llm.common import table
from starloom.llm.decontaminate import find_leaks
from starloom.llm.exact_dedup import exact_groups
from starloom.llm.line_dedup import dedup_lines
from starloom.llm.manifest import folded_root, hex_text, leaf_digest, merkle_manifest, proof_siblings
from starloom.llm.ngram_join import Jaccard, ngram_components
from starloom.llm.packing import pack_documents
from starloom.llm.quality import judge_quality
from starloom.llm.secret_scan import scan_secrets
from starloom.llm.sharding import shard_documents
from starloom.llm.spelling import count_words, group_spellings, letter_runs, thinned
from starloom.llm.suffix_dedup import remove_repeats
from starloom.llm.toxicity import score_toxicity, train_toxicity
from starloom.llm.url_filter import Rule, filter_urls

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}

URL_RULES = (
    Rule("allow", "com"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)


def query(name: str) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        return function

    return register


def packing_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op1_line_dedup")
def op1_line_dedup(spark, sf_dir):
    docs = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "n_lines", "n_removed", "text")


@query("op2_ngram_join")
def op2_ngram_join(spark, sf_dir):
    return ngram_components(table(spark, sf_dir, "documents"), Jaccard(words=3, up=90, down=100))


@query("op3_secret_scan")
def op3_secret_scan(spark, sf_dir):
    found = scan_secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "start", "length", F.sha2("value", 256).alias("value_sha256"), "score", "is_secret")


@query("op4_quality_rules")
def op4_quality_rules(spark, sf_dir):
    judged = judge_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    signals = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return judged.select("doc_id", *signals, "base_failed", "kept", "ratio")


@query("op5_packing")
def op5_packing(spark, sf_dir):
    pieces = pack_documents(table(spark, sf_dir, "documents"), packing_tokenizer())
    place = ("doc_tokens", "sequence_id", "offset")
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), *place)


@query("op6_url_filter")
def op6_url_filter(spark, sf_dir):
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).drop("url")


@query("op7_toxicity")
def op7_toxicity(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    model = train_toxicity(docs, labels.where(~held_out))
    return score_toxicity(docs.select("doc_id", "text"), model).select(
        "doc_id",
        F.coalesce(held_out, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


@query("op8_suffix_dedup")
def op8_suffix_dedup(spark, sf_dir):
    return remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("rest", 256).alias("kept_sha256")
    )


@query("op9_decontaminate")
def op9_decontaminate(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    leaks = find_leaks(docs, table(spark, sf_dir, "benchmark")).select("doc_id", F.explode("leaks").alias("leak"))
    return leaks.select("doc_id", "leak.*")


@query("op10_sharding")
def op10_sharding(spark, sf_dir):
    return shard_documents(table(spark, sf_dir, "documents"))


@query("op11_merkle_manifest")
def op11_merkle_manifest(spark, sf_dir):
    """Documents whose id's crc32 is divisible by 7 are verified with n_chars one higher."""
    tampered = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) == 0
    n_chars = F.col("n_chars") + F.when(tampered, 1).otherwise(0)
    leaf = lambda n: leaf_digest(F.col("doc_id"), F.col("source"), F.col("lang"), n, F.col("text"))
    docs = table(spark, sf_dir, "documents")
    manifest = merkle_manifest(docs, leaf(F.col("n_chars")), also={"given": leaf(n_chars)})
    folded = manifest.withColumn("folded", folded_root(F.col("given")))
    return folded.select(
        "doc_id",
        hex_text("digest").alias("leaf"),
        hex_text("subroot").alias("subroot"),
        hex_text("root").alias("root"),
        F.sha2(proof_siblings(), 256).alias("proof_sha256"),
        hex_text("folded").alias("folded_root"),
        (F.col("folded") == F.col("root")).alias("verified"),
    )


@query("op12_exact_dedup")
def op12_exact_dedup(spark, sf_dir):
    return exact_groups(table(spark, sf_dir, "documents"))


@query("op13_spelling_variants")
def op13_spelling_variants(spark, sf_dir):
    runs = letter_runs(table(spark, sf_dir, "documents"), least=7)
    return group_spellings(count_words(runs.select(thinned(runs).alias("word"))))
