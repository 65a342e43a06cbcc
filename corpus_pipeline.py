"""A training-data pipeline: language ID, near-dedup, repeated passages, source mixing, tokens."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm import bpe, langid, minhash, mixing, suffix_dedup
from nearfield.llm.grouping import matching
from nearfield.runtime import discard, materialize, scratch, table

LEAST_SCORE = 0.5
SHINGLE_WORDS, SIMILARITY_PERCENT = 5, 80
WEIGHTS, MIX_PERCENT = [5, 2, 1], 100
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def _columns(docs: DataFrame, within: str = "", **changed: Column) -> list[Column]:
    """The columns of docs by name, some of them changed; of the struct `within`, if it is named."""
    prefix = f"{within}." if within else ""
    return [changed.get(f.name, F.col(f"{prefix}`{f.name}`")).cast(f.dataType).alias(f.name) for f in docs.schema.fields]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those whose language is less likely than LEAST_SCORE.

    Null and empty texts go; a text of any length is read whole; copies are judged alike; where no row names a
    language, all rows go; an empty table stays empty; columns of any name are kept.
    """
    carried = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("carried")  # apart from the columns that predict() adds
    found = langid.predict(docs.select(carried, "text"), langid.train(docs))
    return found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(_columns(docs, "carried", text=F.col("text")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near-duplicates.

    Rows without id and null and empty texts stay; rows that share an id stay or go together;
    columns of any name are kept.
    """
    found = minhash.near_duplicates(docs, SHINGLE_WORDS, SIMILARITY_PERCENT)
    gone = found.where("not kept").select("doc_id").distinct()
    return matching(docs, gone, "doc_id", "left_anti").select(_columns(docs))


def _whole_characters(text: Column) -> Column:
    """Without the parts of characters left at a cut. U+FFFD that stood in the text is escaped meanwhile, for it
    is what make_valid_utf8 puts in their place; replace() works on bytes, so it takes no part for one."""
    escape, own, lost = F.lit("\x01"), F.lit("\x01b"), F.lit("\ufffd")
    text = F.replace(F.replace(text, escape, F.lit("\x01a")), lost, own)
    text = F.replace(F.make_valid_utf8(text), lost, F.lit(""))
    return F.replace(F.replace(text, own, lost), F.lit("\x01a"), escape)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts bytes that repeat from a document with a smaller id; parts of characters left at a cut go
    too. Documents of which no word is left go.

    Rows without id stay as they are; a null text becomes an empty one and stays; rows that share an id are one document and stay
    all; columns of any name are kept.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    found = suffix_dedup.remove_repeats(docs, carry=others)
    kept = F.col("kept").cast("string")
    text = F.when(F.col("n_removed") == 0, kept).otherwise(_whole_characters(kept))
    found = found.withColumn("kept_text", text).where("n_removed = 0 or trim(kept_text) <> ''")
    new = {"doc_id": F.col("doc_id"), "text": F.col("kept_text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.char_length("kept_text")
    return found.select(_columns(docs, "carried", **new)).unionByName(docs.where("doc_id is null"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes documents by source weight; one that the mix takes twice is there twice.

    Documents without words are not taken; a null source is one of its own; rows that share an id count one by
    one; ties are ordered by a hash of the id; columns of any name are kept.
    """
    found = mixing.mix(docs, WEIGHTS, MIX_PERCENT, carry=docs.columns)
    copies = found.where("taken > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), (F.col("taken") / F.col("size")).cast("int"))))
    return copies.select(_columns(docs, "carried"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian unsigned 32-bit integers), and whether they decode to the text.

    Null and empty texts have no tokens and are exact; every row, repeated or not, gives one; an empty table
    gives none; columns other than doc_id, text, lang and source are not read.
    """
    path = public_tokenizers.path(VOCABULARY)
    docs = docs.select("doc_id", "text", "lang", "source")
    encoded = bpe.encode(docs, path, public_tokenizers.PATTERN, decoded="decoded")
    exact = F.col("decoded") == F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return encoded.select("doc_id", "lang", "source", "n_tokens", "ids", exact.alias("exact"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_dedup", near_dedup),
    ("repeated_passages", repeated_passages),
    ("source_mix", source_mix),
    ("tokens", tokens),
]

#: The stages hash, iterate and tokenize in ways that SQL has no words for; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other. What a stage wrote, and what its operator left for it, is deleted once the
    next table is written; a stage called by itself deletes nothing that its result reads."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before = docs
        with scratch(spark) as keep:
            docs = keep(materialize(stage(spark, before, sf_dir), name))
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
