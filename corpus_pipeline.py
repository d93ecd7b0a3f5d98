"""The corpus pipeline: documents to encoded training text in five stages.

Each stage takes (spark, docs, sf_dir) and works on every row that its predecessor kept. ``run`` writes each stage's
rows as Parquet into the shared folder and reads them again.

Common to all stages: only the columns of documents are read, so further columns never clash; an empty table gives an
empty table; texts are taken whole, however long; nulls in lang, source or n_chars are passed on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import Scratch, table
from docloom.llm.ngram_join import keep_one_per_class
from docloom.llm.piece_codec import encode_documents
from docloom.llm.quality_classifier import fit_quality, score_quality
from docloom.llm.secret_scan import redact_secrets
from docloom.llm.source_mix import take_mix

#: Documents whose score is below this are rejected.
LEAST_QUALITY = 0.5
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier, fitted on all labelled rows of ``docs``, does not reject.

    A null or empty text is scored as an empty one; a row without an id is scored like any other but has no label;
    repeated rows are all kept or all rejected, and each counts in the fit; a score of exactly the threshold is kept.
    """
    docs = docs.select(*COLUMNS)
    model = fit_quality(docs, table(spark, sf_dir, "labels"), F.lit(True))
    scored = score_quality(docs, model, list(COLUMNS), "_score")
    return scored.where(F.col("_score") >= LEAST_QUALITY).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near copies, that of the smallest id.

    Null and empty texts are no copies of each other: each id keeps one. Rows that repeat an id and a text are copies;
    two texts under one id are two documents. Rows without an id all stay.
    """
    return keep_one_per_class(docs.select(*COLUMNS))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, secrets in their texts replaced by the names of their kinds; ``n_chars`` follows the text.

    A null text stays null and keeps its ``n_chars``; an empty one stays empty; repeated rows are changed alike.
    """
    return redact_secrets(docs.select(*COLUMNS))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it: 0, 1 or 2 times.

    Null and empty texts have no words, so they come as often as their place in the draw says; a null source is a
    source of its own; rows of equal key are ordered by id, and rows that repeat an id are taken together.
    """
    return take_mix(docs.select(*COLUMNS))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source and the ids of the text's pieces, one row for each row of the mix.

    Null and empty texts have no pieces.
    """
    return encode_documents(docs.select("doc_id", "lang", "source", "text"), keep=["doc_id", "lang", "source"])


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("secrets", secrets),
    ("mixture", mixture),
    ("pieces", pieces),
]

#: The classifier and the encoder are not expressible in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    tmp, docs, before = Scratch(spark), table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs = tmp.store(stage(spark, docs, sf_dir))
        if before is not None:
            tmp.drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
