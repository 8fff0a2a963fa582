"""From raw documents to a training mixture: language, near duplicates, benchmark passages, personal data, source weights.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. ``run`` applies them in order, each written as Parquet in the cluster's shared folder
and read again as the next one's documents. All but the last return the columns of documents.
"""

from __future__ import annotations

import functools
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import decontam, langid, mixing, pii, simhash
from quarry.llm.common import shared_folder, table
from quarry.llm.queries import held_out
from quarry.sources.files import FileSystem


def _reachable(stage):
    """The stage, with this folder first on the path of Python workers, wherever the driver was started."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        root, paths = os.path.dirname(os.path.abspath(__file__)), spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
        if root not in paths:
            spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, *paths]))
        return stage(spark, docs, sf_dir)

    return run_stage


@_reachable
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; those without a letter (null and empty texts too), or far from all centroids, go. Repeated rows go or stay alike; very long texts are
    read whole; an empty table gives an empty one; columns may have any names."""
    model = langid.fit(docs, ~held_out("doc_id"))
    found = langid.identify(docs, model)
    return found.where(~F.col(found.columns[-1])["rejected"]).select(*[F.col(f"`{c}`") for c in docs.columns])


@_reachable
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, that with the smallest id; of its repeated rows one. A group is what links of a Jaccard similarity of 0.8 or more between sets of five-word
    shingles connect. Null and empty texts are one group; an empty table gives an empty one; columns may have any names."""
    return simhash.keep_one(docs, shingle_words=5, similarity=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without ten words in a row of a benchmark item, or without all words of a shorter one. Null and empty texts stay; repeated rows go or stay alike; an empty table
    gives an empty one, and an empty benchmark takes nothing away; columns may have any names."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by labels. Null and empty texts stay as they are; repeated rows change alike; an empty table gives an empty one; columns may have any names."""
    return pii.sanitise(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them, with the number of the copy in a last column, ``copy`` (with underscores after it where there is such a column). Texts without
    words are taken once; a null source is a source; repeated rows count each; an empty table gives an empty one."""
    return mixing.mixed(docs)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("mixture", mixture),
]

#: SQL can't express clustering, XXH64 fingerprints or Newton's iterations.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:  # what the stage read isn't needed again
            FileSystem(spark).delete(before)
        docs, before = spark.read.parquet(path), path
    return docs
