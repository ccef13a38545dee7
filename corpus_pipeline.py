"""A corpus pipeline of five stages over the documents table. Each stage works on all that its predecessor kept.

run() writes each stage's result as Parquet to the shared folder, reads it back, and deletes what no later stage reads.

Defined results: null and empty texts fail the base rule of the first stage, so they go there; given to a later stage, they pass it
unchanged and have no tokens. Rows with a null doc_id pass the dedup stages; rows that share a doc_id are one document given twice. An empty
table passes all stages. Other columns may have any name and stay up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lessonlake.llm import bpe, decontaminate, line_dedup, minhash, quality_rules
from lessonlake.llm.common import Tables, materialise, table  # noqa: F401  (materialise: for tests of single stages)

#: Words of a shingle, as for all near-duplicate stages without a contract of their own. After line dedup few near copies of 0.8 in
#: five-word shingles are left: most of their lines went with it.
SHINGLE = 5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. The line model is trained on the labelled ones among docs."""
    return quality_rules.keep_documents(docs, quality_rules.train(docs, table(spark, sf_dir, "labels")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat an earlier one; n_chars follows the text."""
    out = line_dedup.dedup_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return minhash.dedup_documents(docs, SHINGLE)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the contamination rule doesn't hit."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the remaining texts."""
    return bpe.bpe_digests(docs, bpe.load_vocabulary())


STAGES = [("quality rules", quality), ("line dedup", lines), ("minhash near-dedup", near_duplicates), ("benchmark decontamination", decontamination), ("bpe encoding", tokens)]
#: The line model and the tokeniser have no SQL form. tests/llm holds each stage's operator, and stages two to four as they are chained
#: here, against brute-force versions, and the tokeniser against the tokenizers library.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, tables = table(spark, sf_dir, "documents"), Tables(spark)
    for _, stage in STAGES[:-1]:
        read, docs = docs, tables.write(stage(spark, docs, sf_dir))
        tables.drop(read)
    return STAGES[-1][1](spark, docs, sf_dir)
