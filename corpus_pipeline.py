"""A corpus pipeline: language, near-duplicates, decontamination, mixing, token files.

Each stage gets what its predecessor kept, written as Parquet and read again, and
returns the columns of ``documents``; the last returns its report on the token
files. SQL can't express the stages, so tests hold them against brute force.

In every stage null ids and repeated rows are rows like others, columns besides
``doc_id``, ``text``, ``lang`` and ``source`` come through untouched under whatever
name, and an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from sensorloom.llm import decontaminate, language, mixing, near_dedup, tokens
from sensorloom.llm.common import new_folder, numbered
from sensorloom.llm.queries import tokenizer_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that have a language: those without a letter (null and empty texts too), or that no language's model codes in fewer bits than their bytes have, go. Without a labelled text to learn from, only the first rule judges."""
    try:
        model = language.learn(docs)
    except language.NoLabelledText:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    return docs.where(~language.rejected(language.predict(model)(F.col("text"))))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: that with the smallest id, null ids last; of rows with that id, the first in its file. Null and empty texts are in no group and stay."""
    rows, place = numbered(docs)
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), place["file"].alias("file"), place["row"].alias("row"))
    rows = rows.select(key.alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    gone = near_dedup.near_duplicates(rows.select("key", "doc.text"), "key").where(~F.col("kept")).select("key")
    return rows.join(gone, "key", "left_anti").select("doc.*")


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark; null and empty texts hold none."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.with_matches(docs, benchmark, column="_matches").where(F.size("_matches") == 0).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mix: the order of files and rows is the schedule's, which the next stage writes tokens in. A null source is a source of its own."""
    mixed = mixing.mix(docs, position=POSITION, slot="_slot")
    return mixed.repartitionByRange(POSITION).sortWithinPartitions(POSITION).select(*[f"`{c}`" for c in docs.columns])


def write_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in the order of the rows' files; ``doc_id, start, n_tokens, ids_crc32`` of each document, read back from them. A null text is the end id alone."""
    try:
        number = F.regexp_extract("_metadata.file_name", r"^part-(\d+)", 1).try_cast("bigint")
        placed = docs.select("doc_id", "text", number.alias("_part"), F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
        order = [F.col("_part"), F.col("_file"), F.col("_row")]
    except AnalysisException:  # not from files: in the order of ids
        placed, order = docs, None
    found = tokens.tokenize(placed, tokenizer_path(), order_by=order)
    return found.select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontaminate", decontaminate_benchmark),
    ("mix", mix_sources),
    ("tokens", write_token_files),
]
ORACLE_SQL = None
POSITION = "_position_in_mix"


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's result for ``documents``; each stage's rows are written to the shared folder and read from there."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        folder = new_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return STAGES[-1][1](spark, docs, sf_dir)
