"""The registered queries of the corpus operators, and DuckDB SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, fim, hmm, langid, maxscore, merkle, mixing, neardup, packing, quality, sharding, toxicity, warc
from .common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_kk_sharding": lambda spark, d: sharding.op1(read(spark, d, "documents")),
    "op2_poisson_mix": lambda spark, d: mixing.op2(read(spark, d, "documents")),
    "op3_maxscore": lambda spark, d: maxscore.op3(read(spark, d, "embeddings")),
    "op4_circulant_minhash": lambda spark, d: neardup.near_duplicates(read(spark, d, "documents")).drop("row", "component"),
    "op5_warc_transactions": lambda spark, d: warc.op5(read(spark, d, "pages")),
    "op6_nnpu_toxicity": lambda spark, d: toxicity.op6(read(spark, d, "documents"), read(spark, d, "labels")),
    "op7_bpe_chunks": lambda spark, d: bpe.op7(read(spark, d, "documents")),
    "op8_ppm_language": lambda spark, d: langid.op8(read(spark, d, "documents")),
    "op9_hmm_scores": lambda spark, d: hmm.op9(read(spark, d, "documents")),
    "op10_weak_quality": lambda spark, d: quality.op10(read(spark, d, "documents")),
    "op11_fill_in_middle": lambda spark, d: fim.op11(read(spark, d, "documents")),
    "op12_large_item_matching": lambda spark, d: packing.op12(read(spark, d, "documents")),
    "op13_slot_pivot_manifest": lambda spark, d: merkle.op13(read(spark, d, "documents")),
}

SQL: dict[str, str] = {
    "op2_poisson_mix": mixing.SQL_OP2,
    "op3_maxscore": maxscore.SQL_OP3,
    "op5_warc_transactions": warc.SQL_OP5,
    "op11_fill_in_middle": fim.SQL_OP11,
    "op13_slot_pivot_manifest": merkle.SQL_OP13,
}
