"""A training corpus from ``documents``: toxicity, language ID, near-dedup, source mixing, tokens.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a
DataFrame, which is written as Parquet and reread as the next one's ``docs``.  All but the
last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vertebra.llm import bpe, langid, mixing, neardup, toxicity
from vertebra.llm.common import in_fold, read, stash

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Least probability of the predicted language.
LEAST_LANGUAGE = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under the threshold; learns from the fold the operator's query learns from.

    Null and empty texts and very long ones are scored as any other, equal rows alike; without
    labels nothing is toxic; an empty table gives no rows; other columns are left behind."""
    docs = docs.select(*COLUMNS)
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"), ~in_fold(F.col("doc_id"), 4, 2))
    return toxicity.score(docs, model).where(F.col("score") < toxicity.THRESHOLD).select(*COLUMNS)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised: not ``und``, and probable enough.

    Texts that are null or have no letter go, as does everything if no language was learned;
    equal rows fare alike; an empty table gives no rows; other columns are left behind."""
    docs = docs.select(*COLUMNS)
    model = langid.fit(docs, ~in_fold(F.col("doc_id"), 5, 0))
    found = langid.predict(docs, model)
    return found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE)).select(*COLUMNS)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the smallest doc_id, and one of rows equal
    in doc_id and text.  Rows without doc_id or without a word are near duplicates of nothing."""
    return neardup.one_of_each(docs.select(*COLUMNS)).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated at their source's rate, in a new global order.

    A null source is a source; rows of equal doc_id are repeated alike; texts play no part but
    by their size; an empty table gives no rows; other columns are left behind."""
    return mixing.poisson_mix(docs.select(*COLUMNS)).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, with a digest of what they decode to.

    A null text counts as empty and has no ids; equal rows each give a row; a long text is
    encoded in chunks; an empty table gives no rows.

    The ids are written before they are decoded: a task with two Python steps in a row takes two
    workers, and Spark keeps them all, with what each has loaded, for every later step."""
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    both = bpe.decode(stash(bpe.encode(docs, path, pattern, sure=bpe.SURE), "pipeline-ids"), path)
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids",
                       F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("language", known_language),
    ("near-dedup", one_of_each),
    ("mixing", mixed),
    ("bpe", tokens),
]

#: Learned models and MinHash are beyond SQL.  Tests of the operators hold near-dedup and bpe
#: against brute force, mixing against its SQL, toxicity and language against their labels;
#: the test of the stages in a row holds their row counts, and that no near duplicate is left.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
