"""From raw documents to packed sequences: five stages, each one operator of ``riskloom.llm``.

Every stage reads all that its predecessor kept, as a table in the shared folder,
and returns the columns of ``documents`` but for the last, which returns pieces. As each
reads files, it decides on narrow tables and finds the texts by their place in these files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskloom.llm import exact_dedup, jaccard_join, mixing, packing, quality_rules
from riskloom.llm.tables import documents
from riskloom.session import materialize

#: Near-duplicate stages on word shingles take five words and a similarity of 0.8.
NEAR = jaccard_join.Join(size=5, percent=80)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.keep_quality(docs, in_files=True)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the smallest document stays."""
    return exact_dedup.deduplicate(docs, in_files=True)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that links connect the smallest document stays."""
    return jaccard_join.keep_one(docs, NEAR, in_files=True)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy of a document that the mix takes, in the order of the output shards."""
    return mixing.mixed(docs, in_files=True)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the mixed documents with their place in the sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality),
    ("exact_dedup", exact),
    ("jaccard_join", near),
    ("mixing", mix),
    ("packing", pack),
]

#: The estimates of the first stage and the tokenizer of the last have no SQL. Tests check columns, counts and
#: gapless sequences of the run, and each operator by itself; no test runs all stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
