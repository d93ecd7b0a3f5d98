"""The registered queries of the training-data operators, each over its whole table, and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.chat_format import format_turns, read_back
from docloom.llm.common import fold_of, table, with_text_columns
from docloom.llm.fingerprints import fingerprint_edits
from docloom.llm.language_id import fit_languages, identify_languages
from docloom.llm.ngram_join import jaccard_components
from docloom.llm.oracles import ORACLES
from docloom.llm.passages import repeated_passages
from docloom.llm.piece_codec import DEFAULT_MODEL, codec
from docloom.llm.quality_classifier import fit_quality, score_quality
from docloom.llm.quality_rules import apply_rules
from docloom.llm.secret_scan import scan_secrets
from docloom.llm.source_mix import mix_sources

#: Documents at or above this score count as good.
GOOD = 0.7


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(fold_of(F.col("doc_id"), 4) == 2, F.lit(False))  # a row without an id is in no fold
    model = fit_quality(docs, labels, ~held_out)
    scored = score_quality(docs.select("doc_id", "text"), model, ["doc_id"])
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = apply_rules(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(table(spark, sf_dir, "documents"))


def op4_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: number of pieces, digest of the ids as little-endian 32-bit integers, and whether decoding gives the text back."""
    import hashlib

    import pyarrow as pa

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    fields = [T.StructField("n_pieces", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("round_trip", T.BooleanType())]

    def make(batch: pa.RecordBatch) -> list:
        tool = codec(DEFAULT_MODEL)
        texts = batch.column("text").to_pylist()
        ids = tool.encode_bytes(texts)
        same = [tool.decode(memoryview(i).cast("i")) == (t or "") for i, t in zip(ids, texts, strict=True)]
        return [
            pa.array([len(i) // 4 for i in ids], pa.int64()),
            pa.array([hashlib.sha256(i).hexdigest() for i in ids]),
            pa.array(same, pa.bool_()),
        ]

    return with_text_columns(docs, fields, make, ["doc_id"], end=lambda: codec(DEFAULT_MODEL).forget())


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size")).alias("taken"))


def op6_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(fold_of(F.col("doc_id"), 3) == 1, F.lit(False))
    model = fit_languages(docs, ~held_out)
    found = identify_languages(docs.select("doc_id", "text"), model, ["doc_id"])
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return read_back(format_turns(rows.union(more)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_quality_classifier,
            op2_quality_rules,
            op3_fingerprints,
            op4_piece_codec,
            op5_source_mix,
            op6_repeated_passages,
            op7_secret_scan,
            op8_language_id,
            op9_ngram_join,
            op10_chat_format,
        )
    }


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
