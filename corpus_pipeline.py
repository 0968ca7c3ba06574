"""A corpus from raw documents to packed sequences, in five stages of training-data operators.

Every stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns a
DataFrame, which is written as Parquet and read again as the next stage's docs. All stages but the last
return the columns of documents; n_chars always describes the text as it then is.

In every stage rows may be null in any column, ids may repeat, texts may be empty or long, and columns may
be named like those an operator uses; an empty table gives an empty result with the same columns. Each
stage judges rows by their text, never by their doc_id alone. The order of the stages is given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.decontamination import decontaminate
from quire.llm.jaccard_join import drop_near_duplicates
from quire.llm.line_dedup import line_dedup as remove_repeated_lines
from quire.llm.packing import pack
from quire.llm.quality import score_quality, train
from quire.llm.runtime import written
from quire.session import table

#: A document goes if the classifier's score is lower.
LEAST_SCORE = 0.3


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go, empty and null texts among them if the model scores an
    empty passage below LEAST_SCORE. Without labels of both kinds every document scores 0.5 and stays."""
    model = train(docs, table(spark, sf_dir, "labels"))
    columns = docs.columns
    return score_quality(docs, model).where(F.col("score") >= LEAST_SCORE).select(*columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated runs of lines and long lines go; so do documents of which nothing but white space is left.

    Null texts, and those that were blank before, stay; rows equal in doc_id and text count once and get
    the same result."""
    columns = docs.columns
    out = remove_repeated_lines(docs, short_repeats=True).withColumn("n_chars", F.length("text").cast("long"))
    return out.where((F.col("n_removed_chunks") == 0) | (F.length(F.trim(F.regexp_replace("text", r"\s+", " "))) > 0)).select(*columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays, that with the least doc_id (null before all);
    rows equal in doc_id and text are one document. Texts without words, null among them, all stay."""
    return drop_near_duplicates(docs).select(*docs.columns)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap a benchmark item go, whatever their doc_id. Null and empty texts overlap
    nothing and stay; without items every document stays."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, tokenised and packed into sequences; one row per piece.

    A null or empty text is its end token alone; a null or repeated doc_id is carried by its pieces, and
    rows are never joined by it."""
    return pack(docs)


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("packing", packing)]

#: SQL can express neither the classifier nor the tokeniser; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each on the written result of the one before."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
