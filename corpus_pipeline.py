"""From raw documents to packed training sequences: five stages, each written as Parquet and read by the next.

A stage's scratch tables are needed until its result is written. So each stage begins by deleting what earlier stages over
the same tables have left on the shared folder, but for tables that the documents it gets are still read from.
"""

from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallysift.llm import decontaminate, packing, quality_rules, simhash, substrings
from tallysift.llm.common import free, noted, stored, table

TOKENIZER = "byte_bpe_50k.json"
#: Scratch tables by the folder of the input tables.
_left: dict[str, list[str]] = {}


def frees(first: bool = False):
    """A stage that deletes the scratch tables of the stages before; the ``first`` one begins a new list."""
    def around(stage):
        @wraps(stage)
        def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            if first:
                _left[sf_dir] = []
            free(spark, _left.setdefault(sf_dir, []), unless_read_by=docs)
            with noted(_left[sf_dir]):
                return stage(spark, docs, sf_dir)
        return run_stage
    return around


@frees(first=True)
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base and the certified rules."""
    return quality_rules.kept_documents(docs, table(spark, sf_dir, "labels"))


@frees()
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash class, that with the smallest id."""
    return simhash.keep_one(docs)


@frees()
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 200-byte strings that come twice; n_chars follows."""
    return substrings.without_repeats(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


@frees()
def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


@frees()
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of full token windows, sources mixed as they come. Documents are queued by their ids: the pieces don't depend
    on the partitions and files that earlier stages have left."""
    return packing.pack(docs.orderBy("doc_id", F.xxhash64("text")), public_tokenizers.path(TOKENIZER), ids=False)


STAGES = [("quality rules", quality), ("SimHash near-dedup", near_duplicates), ("suffix-array dedup", repeated_passages),
          ("benchmark decontamination", benchmark_passages), ("packing", packed)]
#: Fingerprints, repeated strings and token ids are beyond SQL; the tests compare the run with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    before: list[str] = []
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            now: list[str] = []
            with noted(now):
                docs = stored(docs, f"stage{k + 1}")
            free(spark, before)
            before = now
    return docs
