"""The corpus pipeline: quality classifier, near duplicates, substring dedup, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surfacelens.llm import mixing, ngram_join, packing, quality, substring
from surfacelens.llm.common import fold, stored, table
from surfacelens.llm.queries import tokenizer_path

#: Part of an original that a document keeps at least after substring dedup, or it goes.
LEAST_WORDS = 1


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier (fitted on the labels outside its held-out fold) does not reject.

    Rows with a null doc_id, null and empty texts are scored as they are; equal rows all stay or
    all go; without labels every document scores 0.5 and stays. An empty table stays empty.
    """
    model = quality.train(docs, table(spark, sf_dir, "labels"), "quality", fold("doc_id", 3) != 1)
    columns = [f"`{c}`" for c in docs.columns]
    return quality.score(docs, model, "__quality").where("__quality >= 0.5").select(*columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each component of near duplicates (five-word shingles, similarity 0.8).

    Of a kept doc_id all rows stay, also where they repeat or differ in text, as they are one node
    of the links; a doc_id that is linked to a smaller one goes with all its rows. Rows with a null
    doc_id, null texts and texts without words are linked with nothing and stay.
    """
    found = ngram_join.near_duplicates(docs, shingle_words=5, percent=80)
    gone = found.where("doc_id != component_id").select(F.col("doc_id").alias("__gone")).distinct()
    kept = docs.join(gone, docs["doc_id"] == F.col("__gone"), "left_anti")
    return kept.select(*[f"`{c}`" for c in docs.columns])


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 40 words or more that a document with a smaller doc_id has; what has no words left goes.

    A text that loses nothing stays as it is, also a null or empty one; of one that does, n_chars
    is counted again. Rows of one doc_id don't take each other's words; a null doc_id is the largest.
    """
    cleaned = substring.remove_repeats(docs.withColumn("__text", F.col("text")), window=40, counts=("__words", "__removed"))
    changed = F.col("__removed") > 0
    kept = cleaned.where(~changed | (F.col("__words") - F.col("__removed") >= LEAST_WORDS)).withColumn("text", F.when(changed, F.col("text")).otherwise(F.col("__text")))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return kept.select(*[f"`{c}`" for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in temperature-mixed shares, in the mixture's order: every document once at least, no source more than twice.

    Rows are sorted by range, so the written table's files hold them in that order and packing
    meets the sources interleaved. A null source is one of its own; repeated rows count each.
    """
    # Columns of the documents that are called like those of the mixture step aside meanwhile.
    aside = {c: f"__own_{c}" for c in docs.columns if c.startswith("mix_")}
    mixed = mixing.mix(docs.withColumnsRenamed(aside), "source", max_passes=2.0)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = mixed.repartitionByRange(parts, "mix_order").sortWithinPartitions("mix_order")
    return ordered.select(*[F.col(f"`{aside.get(c, c)}`").alias(c) for c in docs.columns])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1024 ids, with their ids' checksum. A null or empty text is its end id alone; repeated rows are packed each."""
    pieces = packing.pack(docs.select("doc_id", "text"), tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("substring dedup", drop_repeated_passages),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack_sequences),
]

#: No SQL can fit the classifier or cut token ids: tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"stage-{k}")
    return docs
