"""The registered queries of the numbered operators: thin, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import katz, merkle, mixing, ngram_join, oracles, packing, permutation_index, prefix_trie, quality, substring, toxicity, url_filter, wavelet, webp
from .common import fold, stored, table


def tokenizer_path() -> str:
    """The public byte-level tokenizer that the contracts name."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' toxicity scores; labels of fold 2 of 4 are held out."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    lexicon = toxicity.learn(docs, table(spark, sf_dir, "labels"), "toxic", fold("doc_id", 4) != 2)
    scored = toxicity.score(docs, lexicon).drop("text")
    return scored.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 1024 ids."""
    pieces = packing.pack(table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the words of 13-word windows that an earlier document has."""
    kept = substring.remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text"), window=13)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' quality scores; labels of fold 1 of 3 are held out."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels"), "quality", fold("doc_id", 3) != 1)
    scored = quality.score(docs, model).drop("text")
    return scored.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest other vectors of every vector whose id is divisible by 50."""
    return permutation_index.search(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), F.col("vec_id") % 50 == 0, k=5)


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' Katz scores; fold 1 of 5 is held out of the model."""
    scored = katz.score(table(spark, sf_dir, "documents", "doc_id", "text"), fold("doc_id", 5) != 1)
    return scored.select("doc_id", (fold("doc_id", 5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents stored as lossless WebP images and read back."""
    return webp.read_media(webp.store_media(table(spark, sf_dir, "documents", "doc_id", "text")))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in a mixture whose sources are repeated at most twice."""
    mixed = mixing.mix(table(spark, sf_dir, "documents", "doc_id", "source", "text"), max_passes=2.0)
    return mixed.select("doc_id", "source", "mix_pass", "mix_block", "mix_tokens", "mix_order")


def op8_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' ids, written to wavelet-matrix shards and read back."""
    rows = wavelet.token_ranges(table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_path())
    return rows.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents under Jaccard similarity of 0.85 on four-word shingles."""
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"), shingle_words=4, percent=85)


#: Hosts and paths with what the contract says of them.
URL_RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))


def op11_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages' hosts and paths under five rules; what none of them fits is allowed."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judge(table(spark, sf_dir, "pages", "page_id", "url"), rules).drop("url")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes of the trie of rebuilt conversations: each takes the first turns of its hundred's first one."""
    own = stored(prefix_trie.turn_rows(table(spark, sf_dir, "conversations")), "places")
    ids = own.where("place = 0").select("conv_id", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6).alias("h"), (F.col("conv_id") - F.col("conv_id") % 100).alias("base"))
    # A hundred's first conversation gives five turns at most to a hundred others at most.
    first = own.where("place < 5 and conv_id % 100 = 0").select(F.col("conv_id").alias("base"), "place", "turn", "chars")
    taken = ids.join(first, "base").where("place < h").select("conv_id", "place", "turn", "chars")
    kept = own.where(F.col("place") >= F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6)
    trie = prefix_trie.build(kept.unionByName(taken), ids.select("conv_id"))
    out = trie.nodes.join(prefix_trie.end_digests(trie), "key", "left")
    return out.select(*(F.col(c).cast("long").alias(c) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")), F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' proofs in a manifest of trees by source, and whether they hold after some texts were lower-cased."""
    docs = table(spark, sf_dir, "documents", "doc_id", "source", "lang", "n_chars", "text")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.col("text"))
    fields = ("doc_id", "source", "lang", "n_chars")
    rows = docs.select("doc_id", "source", merkle.leaf_hash(*fields, "text").alias("leaf"), merkle.leaf_hash(*fields, tampered).alias("shown"))
    proofs = merkle.prove(rows, "source", ["doc_id"], "leaf")
    folded = merkle.fold(F.col("shown"), F.col("proof"))
    return proofs.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")).alias("proof_sha256"), folded.alias("folded_root"), (folded == F.col("root")).alias("verified"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_packing": op2_packing,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_quality": op4_quality,
    "op5_nearest": op5_nearest,
    "op6_lm_score": op6_lm_score,
    "op7_media": op7_media,
    "op9_mixing": op9_mixing,
    "op10_ngram_join": op10_ngram_join,
    "op8_token_output": op8_token_output,
    "op11_url_rules": op11_url_rules,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_merkle": op13_merkle,
}
ORACLE_SQL: dict[str, str] = oracles.SQL
