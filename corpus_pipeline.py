"""Documents to training shards in five stages, each written and read again before the next.

Every stage takes (spark, docs, sf_dir) and works on all rows of docs. All but the last return the columns of docs, with any
further columns, whatever their names. Ids may be null or repeat; no stage tells rows apart by their id alone. No rows give no
rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citygeo.llm.common import checkpoint_dir, documents
from citygeo.llm.op02_simhash import keep_one, near_groups
from citygeo.llm.op03_language import NONE, fit, held_out, identify
from citygeo.llm.op05_mixing import GROWTH, MIX_SEED, POWER, flattened_weights, mix_sources, repetition_rates
from citygeo.llm.op07_sharding import shard_bounded
from citygeo.llm.op08_decontaminate import contamination, drop_contaminated

LEAST_SCORE = 0.4


def _named(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with columns c0, c1, ..., which clash with nothing, and what each column is called there."""
    names = {name: f"c{i}" for i, name in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: null, empty and letterless texts, and predictions scored below LEAST_SCORE. Long texts
    count whole. Without any labelled document nothing is learned, and all go."""
    model = fit(docs.filter(~held_out()))
    rows, names = _named(docs)
    found = identify(rows, model, names["doc_id"], names["text"], carry=True)
    found = found.filter((F.col("lang_pred") != NONE) & (F.col("score") >= LEAST_SCORE))
    return found.select(*names.values()).toDF(*names)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group joined by similarities of 0.8 or more of sets of 5-word shingles: that with the least id,
    null ids last, then the least hash of its text. Of equal rows one stays. Null, empty and wordless texts are one group."""
    return keep_one(docs, near_groups(docs)).select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold half the words, or more, of a benchmark item, and all copies of them. Null and empty texts, of
    documents or items, match nothing."""
    return drop_contaminated(docs, contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents so that sources meet flattened weights, shuffled. A null source is a source; one without characters (all
    texts null or empty) is left out. Equal rows are repeated alike."""
    rates = repetition_rates(docs, flattened_weights(docs, POWER), GROWTH)
    rows, names = _named(docs)
    return mix_sources(rows, rates, MIX_SEED, names["doc_id"], names["source"], names["text"]).select(*names.values()).toDF(*names)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot and home_shard of every row. Null and empty texts have size 1."""
    return shard_bounded(docs)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix", mix), ("shard", shard)]
ORACLE_SQL = None  # hashes, a trained model and tilings; tests/llm/test_pipeline.py holds the stages against plain versions


def _files(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def run(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """All stages over documents, each written as a Parquet table. A named folder keeps these tables, and a run that is started
    again there goes on behind the last complete one. Without a name they lie in the shared checkpoint folder, and each goes
    when the next is complete."""
    docs, keep, before = documents(spark, sf_dir), folder is not None, None
    folder = folder or f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES[:-1]):
        table = f"{folder}/{k}-{name}"
        files, done = _files(spark, f"{table}/_SUCCESS")
        if not files.exists(done):
            stage(spark, docs, sf_dir).write.mode("overwrite").parquet(table)
        if before and not keep:
            files, path = _files(spark, before)
            files.delete(path, True)
        docs, before = spark.read.parquet(table), table
    return STAGES[-1][1](spark, docs, sf_dir)
