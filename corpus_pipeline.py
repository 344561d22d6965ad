"""From raw documents to token ids: the corpus operators one after another, each on all that the one before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again for the next stage. All but
the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanlake.llm import byte_bpe, mixing, near_duplicates, substring_repeats, toxicity
from scanlake.llm.common import written

#: Targets that flatten sources, languages and topics a little, and the share of tokens that the mix keeps.
MIX = {"source": 0.9, "lang": 0.9, "topic": 0.9}
MIX_SHARE = 0.8


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted to be toxic go; all others stay as they are, empty and null texts too."""
    scores = toxicity.toxicity_scores(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), *docs.columns)
    return scores.filter("predicted = 0").select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id stays; rows with a null doc_id stay."""
    gone = near_duplicates.near_duplicates(docs).filter("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages are cut; a text that loses none stays as it is, another keeps its words joined by single spaces."""
    done = substring_repeats.without_repeats(docs, *docs.columns)
    cut = F.col("n_removed") > 0
    changed = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return done.select(*[F.when(cut, changed[c]).otherwise(F.col(f"row.{c}")).alias(c) if c in changed else F.col(f"row.{c}") for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose sources, languages and topics are flattened a little; rows without tokens (null or empty text) stay, no rows give none."""
    return mixing.mixed(docs, MIX, MIX_SHARE, public_tokenizers.path("piece_bpe_32k.model")).filter("kept").select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids, and whether decoding gave the text back; null and empty texts have no ids, no rows give none."""
    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    encoded = byte_bpe.round_trips(docs, ranks, pattern, "doc_id", "lang", "source")
    return encoded.select("row.doc_id", "row.lang", "row.source", F.size("ids").cast("long").alias("n_tokens"), "ids", "round_trip")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("substring_repeats", cut_repeats),
    ("mixing", mix),
    ("byte_bpe", encode),
]
#: Fitting classifiers and joining tokens by rank have no SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
