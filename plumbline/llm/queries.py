"""The registered queries of the corpus operators: each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from .common import prepare, shared_folder


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import fetch, payload_digest, payload_size, write_bundles

    pages = table(spark, sf_dir, "pages")
    folder = shared_folder(spark, "warc")
    records = fetch(write_bundles(pages, folder), folder)
    kind = pages.schema["page_id"].dataType
    return records.select(F.expr("try_cast(record_id AS BIGINT)").cast(kind).alias("page_id"), payload_size().alias("payload_bytes"), payload_digest().alias("payload_digest"), "record_type", F.expr("try_cast(refers_to AS BIGINT)").cast(kind).alias("refers_to"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack, token_pieces

    pieces = token_pieces(table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"), end_id=1)
    return pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repetition import quality_report

    return quality_report(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import contamination

    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import format_conversations, read_back

    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return read_back(format_conversations(rows))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fold, score, train

    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels"), held_out=2))
    return scored.select("doc_id", (fold(F.col("doc_id")) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import joined, labelled_samples, train, with_spans

    found = with_spans(table(spark, sf_dir, "documents").select("doc_id", "text"), train(labelled_samples(spark)))
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(F.col("base_spans")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_files import read_token_files, write_token_files

    folder = shared_folder(spark, "tokens")
    manifest = write_token_files(table(spark, sf_dir, "documents"), folder, _tokenizer("byte_bpe_50k.json"), end_id=0)
    return read_token_files(manifest, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_duplicates import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm import build, fold, score

    docs = table(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id")) == 0
    return score(docs, build(docs, learn=~held_out)).select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urls import judge, write_array

    rules = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
    array = write_array(spark.createDataFrame(rules, "host string, path string, verdict string"), shared_folder(spark, "urls"))
    return judge(table(spark, sf_dir, "pages"), array)


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .whitening import report

    return report(table(spark, sf_dir, "embeddings"), most=8)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repair import damaged, report

    return report(damaged(table(spark, sf_dir, "conversations")))


_QUERIES = [op1_warc_bundles, op2_best_fit_packing, op3_quality_rules, op4_token_files, op5_benchmark_decontamination, op6_chat_formatting, op7_toxicity, op8_secret_scan, op9_jaccard_join, op10_lm_scoring, op11_url_filter, op12_embedding_whitening, op13_conversation_repair]


def _shipped(query):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepare(spark)
        return query(spark, sf_dir)

    run.__name__, run.__doc__ = query.__name__, query.__doc__
    return run


def queries() -> dict:
    return {q.__name__: _shipped(q) for q in _QUERIES}


def oracle_sql() -> dict[str, str]:
    from .oracle import SQL

    return dict(SQL)
