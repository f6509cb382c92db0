"""From raw documents to packed sequences: quality rules, near duplicates, secrets, source mix, packing.

Each stage takes what the one before it kept and returns the columns of documents; the last one returns packed pieces.

Defined cases: documents with a null, empty or word-less text fail the base quality rule and go; rows without an id are judged by their text, are never
duplicates, and are mixed and packed as one more document each; of rows that share an id one stays after near duplicates, so ids are unique from there on but for
copies that the mix makes; of ties (equal texts) the least id stays; a null source is a source of its own; other columns, whatever their names, are carried along to
the mix; empty tables give no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tessera.llm import mixing, near, packing, quality, secrets
from tessera.llm.work import Work, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the learned decision list rejects go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the least id stays."""
    return near.keep_one(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are overwritten in place, so lengths stay."""
    return secrets.mask_texts(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it: not at all, once or twice."""
    return mixing.repeat(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences of at most 1024."""
    out = packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [(f.__name__, f) for f in (quality_rules, near_duplicates, secret_scan, source_mix, best_fit_packing)]

#: Learned rules and token ids are not SQL; the tests compare run() with a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Work(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = work.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
