"""A training corpus from raw documents, in five stages.

Each stage is one operator of ``heatline.llm``; it takes (spark, docs, sf_dir) and
returns the documents that stay, with the columns of ``documents``, or, in the last
stage, the packed pieces.  ``run`` writes every stage's result as Parquet in the
shared folder and reads it again for the next, so a lost executor costs one stage; what a
stage was made from is deleted when it stands, so the result alone is left at the end.

* quality: drops what the classifier rejects; null ``text`` is scored as empty.
* exact_dedup: of equal texts the largest doc_id stays.
* near_dedup: of each group of near copies the smallest doc_id stays.
* mixing: every document comes once at least, those of small sources again, until
  the mixture's entropy or the limit of two epochs is reached.
* packing: sequences of 4096 ids.

No stage needs ``labels`` but the first; an empty table stays empty throughout.  Ties
and repeated rows are taken as the operators say: in exact_dedup a row goes by its doc_id and
text, and a text that stands twice under the largest doc_id stays twice; in the other
stages rows that share a doc_id stay or go together.
Very long texts go whole through every stage.  Further columns pass through all stages
but packing, which doesn't read them, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from heatline.llm import exact_dedup, mixing, near_dedup, packing, quality, tables

#: SQL can't express training, MinHash or packing; tests/llm holds run() against brute force.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scored = quality.with_quality(docs, tables.read(spark, sf_dir, "labels").select("doc_id", "quality"))
    return tables.given(scored.filter("quality_predicted = 1"), docs, quality.RESULTS)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.drop_near_copies(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return tables.given(mixing.mix(docs, cover=True, max_repeats=2.0), docs, mixing.RESULTS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = tables.read(spark, sf_dir, "documents"), tables.folders()
    for name, stage in STAGES:
        result = stage(spark, docs, sf_dir)
        own = tables.folders()
        docs = tables.stage(result, name)
        tables.clean(spark, before, own)  # the stage before, and what this one wrote on its way
        before = own
    return docs
