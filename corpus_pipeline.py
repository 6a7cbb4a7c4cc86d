"""From raw documents to token ids: five stages, each one operator of ``geoloom.llm``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and
read again as the next one's docs. All but the last return the columns of
``documents``; decisions take effect: rejected, repeated and contaminated documents
are gone, dropped lines are cut out of the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.llm import decontaminate, jaccard, langid, linededup, sentencepieces
from geoloom.session import stored

#: SQL cannot express compression sizes or the tokenizer; tests hold the rows against plain versions.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language compression cannot tell (null, no letters, a narrow margin) go."""
    return langid.drop_rejected(docs, langid.fit(docs))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go but for their first; so do documents that keep no word."""
    out = linededup.drop_repeated_lines(docs)
    n_dropped = linededup.count_names(docs.columns)[1]
    out = out.filter((F.col(n_dropped) == 0) | F.col("text").rlike(r"\S"))
    columns = [F.length("text").cast(docs.schema["n_chars"].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns]
    return out.select(*columns)


def join_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by five-word shingles (similarity 0.8), the smallest id stays."""
    return jaccard.keep_one_of_each_group(docs).select(*docs.columns)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap an item of the benchmark go."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and what decoding them gives back."""
    import public_tokenizers

    return sentencepieces.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("near_copies", join_near_copies),
    ("decontamination", decontaminate_benchmark),
    ("sentencepieces", encode_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, name)
    return docs
