"""The training-corpus pipeline over the documents table (doc_id, text, lang, ...), by the operators of mesograph.llm.

Each stage takes (spark, docs, sf_dir), works on every row its predecessor kept, and all but the last return the columns of its input,
whatever these are.  Empty tables stay empty, null texts and ids are told below, rows are never sampled or cut.

  toxicity         drops documents with a toxicity score of 0.5 or more; learns from sf_dir/labels.parquet outside the held-out fifth
  language         drops documents without a letter and those in which no language has half of the words; learns from lang
  near_duplicates  keeps the document of smallest doc_id of each group of near copies (five words, similarity 0.8); texts that share a
                   doc_id are judged each by itself, of rows that share doc_id and text one stays; rows without a doc_id are not compared and stay
  decontamination  drops documents with a passage of ten words (or a whole shorter item) of sf_dir/benchmark.parquet
  byte_bpe         token ids and their decoding: doc_id, n_tokens, ids_sha256, decoded_sha256
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mesograph.llm import bpe, decontamination, language, neardup, toxicity
from mesograph.llm.common import id_remainder, own_name, small_batches, stored

MAIN_SHARE = 0.5


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    labels = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("ann_id"), "toxic").where(id_remainder("ann_id", 5) != 0)
    model = toxicity.fit_on(docs.select(F.col("doc_id").alias("ann_id"), F.col("text").alias("label")), labels)
    return docs.where(toxicity.score_column(model, "text") < 0.5)


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    known = docs.select(F.col("doc_id").alias("ann_id"), F.col("text").alias("label"), F.col("lang").alias("language")).where(id_remainder("ann_id", 5) != 0)
    model = language.fit_on(known)
    (found,) = own_name(docs, "_language")
    marked = docs.withColumn(found, language.language_column(model, "text"))
    return marked.where((F.col(f"{found}.lang_pred") != language.UNKNOWN) & (F.col(f"{found}.score") >= MAIN_SHARE)).drop(found)


def _one_id_per_text(docs: DataFrame, key: str) -> DataFrame:
    """`docs` with a whole number `key` that tells texts of one doc_id apart: the doc_id itself for one text of each, numbers beyond all doc_ids for the others."""
    text_key, twin, number, first = own_name(docs, "_text_key", "_twin", "_number", "_first")
    ids = F.col("doc_id").cast("long")
    known = docs.withColumn(text_key, F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    often = docs.groupBy(ids.alias(twin)).count().where("count > 1").select(twin)
    texts = known.select(ids.alias("doc_id"), text_key).join(often, F.col("doc_id") == F.col(twin), "left_semi").distinct()
    numbered = stored(texts.withColumn(number, F.monotonically_increasing_id()), "texts-of-ids")
    lowest, highest = docs.agg(F.min(ids), F.max(ids)).first()
    beyond = F.lit(highest) + 1 + F.col(number) if (highest or 0) < 2 ** 62 else F.lit(lowest) - 1 - F.col(number)
    firsts = numbered.groupBy(F.col("doc_id").alias(twin)).agg(F.min(number).alias(first))
    named = numbered.join(firsts, F.col("doc_id") == F.col(twin)).select(F.col("doc_id").alias(twin), F.col(text_key).alias(first), F.when(F.col(number) == F.col(first), F.col("doc_id")).otherwise(beyond).alias(key))
    found = known.join(named, (ids == F.col(twin)) & (F.col(text_key) == F.col(first)), "left").drop(twin, first, text_key)
    return found.withColumn(key, F.coalesce(key, ids))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    key, kept, turn, draw = own_name(docs, "_key", "_kept", "_turn", "_draw")
    known = docs.where(F.col("doc_id").isNotNull())
    repeated = not known.groupBy("doc_id").count().where("count > 1").isEmpty()
    known = _one_id_per_text(known, key) if repeated else known.withColumn(key, F.col("doc_id").cast("long"))
    verdicts = neardup.near_duplicates(known.select(F.col(key).alias("ann_id"), F.col("text").alias("label")), width=5, per_cent=80)
    stay = verdicts.where("kept").select(F.col("ann_id").alias(kept)).distinct()
    told = known.join(stay, F.col(key) == F.col(kept)).drop(kept)
    if repeated:  # of rows alike in doc_id and text one stays
        first = Window.partitionBy(key).orderBy(draw)
        told = (told.withColumn(draw, F.xxhash64(*[c for c, kind in docs.dtypes if "map<" not in kind]))
                .withColumn(turn, F.row_number().over(first)).where(F.col(turn) == 1).drop(turn, draw))
    return told.drop(key).unionByName(docs.where(F.col("doc_id").isNull()))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    notes = docs.select(F.col("doc_id").alias("ann_id"), F.col("text").alias("label"))
    found = decontamination.leaked_passages(notes, _table(spark, sf_dir, "benchmark").select("item_id", "text"))
    text_key, key, ann = own_name(docs, "_text_key", "_hit_key", "_hit_id")
    hit = found.select(F.col("ann_id").alias(ann), F.col("_key").alias(key)).distinct()
    marked = docs.withColumn(text_key, F.md5(F.col("text").cast("binary")))
    return marked.join(hit, F.col("doc_id").eqNullSafe(F.col(ann)) & (F.col(text_key) == F.col(key)), "left_anti").drop(text_key)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = bpe.encode_labels(docs, ranks, public_tokenizers.PATTERN, "doc_id", "text")
    return bpe.decode_labels(encoded, ranks).select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("language", drop_unknown_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("byte_bpe", encode_texts),
]
# SQL has no compressor, no Viterbi, no components over links and no merges; tests/llm compares each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over sf_dir/documents.parquet; what a stage returns is written to the shared folder and read again."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
