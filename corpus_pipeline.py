"""A training corpus from raw documents: quality, near duplicates, repeated passages, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next stage's docs. All
but the last return the columns of documents. Texts that a stage leaves alone stay as they are, byte for byte.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectide.llm import decontaminate, jaccard, packing, quality_model, substring

#: The stages' decisions are of models and of exact repeats over the whole input; SQL can't express the first.
ORACLE_SQL = None
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on labelled documents of docs, doesn't reject.

    Null texts are scored as empty ones; rows that share an id are judged one by one; without labels all stay; an empty table
    stays empty; columns beside those of documents are dropped.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality_model.fit(docs, labels)
    scored = quality_model.score_quality(docs, model, carry=["text", "lang", "source", "n_chars"], threshold=0.3, only_predicted=True)
    return scored.select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the least id; documents without words link with nothing.

    Rows equal in id and text are one document; rows that share an id but not the text are different ones. Rows without
    an id come last: one of them stays only where no row of its group has an id.
    """
    return jaccard.one_of_each(docs, carry=["lang", "source", "n_chars"]).select(COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 35 words or more that stand anywhere else too; documents of which nothing is left go.

    Texts without such passages, null and empty ones too, stay byte for byte; rows that share an id are documents of their own; an
    empty table stays empty; columns beside those of documents are dropped.
    """
    out = substring.dedup_substrings(docs.withColumn("whole", F.col("text")), window=35, carry=["whole", "lang", "source", "n_chars"])
    text = F.when(F.col("n_removed") == 0, F.col("whole")).otherwise(F.col("kept_text"))
    length = F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.length("kept_text").cast("long"))
    out = out.where("n_removed = 0 or n_removed < n_words")
    return out.select("doc_id", text.alias("text"), "lang", "source", length.alias("n_chars"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of 10 words of a benchmark item.

    Null and empty texts stay; rows that share an id are judged one by one; an empty benchmark takes nothing; an empty table stays
    empty; columns beside those of documents are dropped.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    out = decontaminate.find_contamination(docs, benchmark, window=10, carry=["text", "lang", "source", "n_chars"], only_clean=True)
    return out.select(COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' ids and their places in sequences of 1024.

    Null texts are empty (the end id alone); rows that share an id are documents of their own; an empty table gives no
    pieces; columns beside id and text are not read.
    """
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", quality),
    ("near duplicates", near_duplicates),
    ("substring dedup", repeated_passages),
    ("benchmark decontamination", decontaminated),
    ("best-fit packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what lies between stages is written to the shared checkpoint folder."""
    from vectide.llm.exchange import checkpointed

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = checkpointed(docs)
    return docs
