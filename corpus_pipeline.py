"""From raw documents to training shards: five stages, each on all that its predecessor kept.

run() takes the documents of sf_dir through STAGES; every stage's result is written to the shared folder and read again.
All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontam, minhash, mixing, sharding, toxicity
from tessera.llm.common import free_name, store, table
from tessera.llm.queries import TOXIC, source_mix, toxic_lexicon

SHARDS = 24


def row_key() -> Column:
    """Tells rows apart by id and text, rows without id after all others; equal rows have equal keys."""
    return F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("i"), F.xxhash64("text").alias("t"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays below TOXIC; a null or empty text is clean."""
    lexicon, out = toxic_lexicon(spark, docs, table(spark, sf_dir, "labels")), free_name(docs, "toxic_score")
    return toxicity.score(docs, lexicon, out=out).where(F.col(out) < TOXIC).drop(out)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class, that with the smallest row_key(); of rows with equal id and text one. Texts without words have no duplicates but such rows."""
    key = free_name(docs, "row_key")
    keyed = docs.withColumn(key, row_key())
    classes = minhash.near_duplicates(keyed.select(F.col(key).alias("row"), "text"), id_col="row")
    return _semi(keyed, classes.where("kept").select(F.col("row").alias(key)).distinct(), key, "left_semi").dropDuplicates([key]).drop(key)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    key = free_name(docs, "row_key")
    keyed = docs.withColumn(key, row_key())
    leaks = decontam.contaminated(keyed.select(F.col(key).alias("row"), "text"), table(spark, sf_dir, "benchmark"), id_col="row")
    return _semi(keyed, store(leaks.select(F.col("row").alias(key)).distinct(), "pipeline-leaks"), key, "left_anti").drop(key)


def _semi(rows: DataFrame, keys: DataFrame, key: str, how: str) -> DataFrame:
    """A join on the parts of the key, of which the id may be null."""
    same = [F.col(f"a.{key}.i").eqNullSafe(F.col(f"b.{key}.i")), F.col(f"a.{key}.t") == F.col(f"b.{key}.t")]
    return rows.alias("a").join(keys.alias("b"), same[0] & same[1], how)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the proportions of source_mix(); one that two epochs take comes twice, and the last one of a leaf is cut where its budget ends."""
    rows, _ = mixing.mix(docs, **source_mix())
    cut = F.col("mix_taken") < F.col("mix_tokens")
    text = F.when(cut, mixing.prefix(F.col("text"), F.col("mix_taken"))).otherwise(F.col("text"))
    size = F.when(cut, F.length(text).cast("long")).otherwise(F.col("n_chars"))
    return rows.withColumns({"n_chars": size, "text": text}).select(*docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its size, text_crc32, shard and slot."""
    return sharding.assign_shards(docs, SHARDS)


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_contaminated), ("mixing", mix_sources), ("sharding", shard)]

#: Lexicon learning, MinHash, alignment, seeded hashes and CRC-32 have no counterpart in DuckDB's SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
