"""A training corpus from raw documents: each stage writes Parquet that the next one reads."""

from __future__ import annotations

import numpy as np
import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.llm.byte_bpe import encode_documents
from tallymark.llm.common import fresh_name, row_digest, stored, table
from tallymark.llm.language_id import DIMENSIONS, UNKNOWN, language_of, train_prototypes
from tallymark.llm.mixing import mix_sources
from tallymark.llm.near_dedup import near_duplicates
from tallymark.llm.pii import pseudonymised
from tallymark.llm.queries import PII_KEY


#: A text gets another language than the declared one if its cosine with that is larger by this much. Of
#: held-out texts of the given tables one in a thousand is ahead by 0.04, by more only wrongly declared ones.
AHEAD = 0.2


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: a null text and one without letters go. The others keep the declared
    language unless another one is ahead of it by ``AHEAD``; where none is declared (null or ``und``), the
    nearest one is filled in. Profiles are learnt from the declared languages; a language without a
    profile, as where none is declared at all, stays as it is. Repeated rows are judged alike, an empty
    table gives an empty one."""
    known = F.nullif(F.col("lang"), F.lit(UNKNOWN))
    learnt = train_prototypes(docs.where(known.isNotNull()))
    found, text = fresh_name(docs, "found"), F.col("text")
    judged = docs.withColumn(found, language_of(text, learnt or {"any": np.ones(DIMENSIONS)}, known))
    judged = judged.where(F.col(found)["lang_pred"] != UNKNOWN)
    other = F.coalesce(F.col(found)["ahead"] >= AHEAD, F.lit(False)) | known.isNull()
    lang = F.when(other & F.lit(bool(learnt)), F.col(found)["lang_pred"]).otherwise(F.col("lang"))
    return judged.withColumn("lang", lang).drop(found)


def chosen_rows(docs: DataFrame, key: Column, name: str, chosen: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose ``key`` is in ``chosen`` (``name``, rows, ..), one for each key, with the
    other columns of ``chosen``. Only rows that are repeated are shuffled to find one of each."""
    keyed = docs.withColumn(name, key)
    once = keyed.join(chosen.where("rows = 1").drop("rows"), name)
    several = keyed.join(chosen.where("rows > 1").drop("rows"), name).dropDuplicates([name])
    return once.unionByName(several).drop(name)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document per near-duplicate group: that with the smallest id, nulls last. A row is known by its
    id and a digest of all its columns, so null and repeated ids do not matter, and of equal rows one
    stays. A text without words is in no group."""
    digest = row_digest(docs)
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), digest.alias("row"))
    name = fresh_name(docs, "key")
    found = near_duplicates(docs.select(key.alias(name), "text"), id_col=name)
    kept = stored(found.where("kept").groupBy(name).agg(F.count("*").alias("rows")), "kept")
    return chosen_rows(docs, key, name, kept)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data become pseudonyms of the same length; n_chars still holds. Null and empty texts stay
    as they are, repeated rows get equal pseudonyms, an empty table gives an empty one."""
    return docs.withColumn("text", pseudonymised(F.col("text"), PII_KEY)["text"])


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, each as often as it is taken. A row is known by a digest of all its
    columns, so null and repeated ids do not matter; of equal rows one stands for all their copies. Texts
    without words are not taken, an empty table gives an empty one."""
    name, times = fresh_name(docs, "row"), fresh_name(docs, "times")
    taken = (
        mix_sources(docs.withColumn(name, row_digest(docs)), id_col=name)
        .groupBy(name)
        .agg(F.sum("copies").cast("int").alias(times), F.count("*").alias("rows"))
        .where(F.col(times) > 0)
    )
    mix = chosen_rows(docs, row_digest(docs), name, stored(taken, "taken"))
    again = F.explode(F.sequence(F.lit(1), F.col(times)))
    return mix.withColumn(times, again).select(*(F.col(f"`{c}`") for c in docs.columns))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix, with the digests of the ids and of the decoded text. A null
    text counts as empty and has no ids, repeated rows give a row each, an empty table gives no rows."""
    return encode_documents(
        docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    )


STAGES = [
    ("language_id", known_language),
    ("minhash_dedup", one_of_each_group),
    ("pii", without_personal_data),
    ("mixing", mixed_sources),
    ("byte_bpe", encoded),
]

#: Prototypes, signatures, pseudonyms, the cube method and BPE are beyond SQL; tests compare the
#: stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
