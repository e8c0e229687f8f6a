"""One query for each operator, over its whole table, and DuckDB SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import align, ann, decontam, hardneg, linededup, minhash, mixing, oracles, pfp, sharding, tokencount, toxicity, urlfilter, warc
from tessera.llm.common import store, table

Query = Callable[[SparkSession, str], DataFrame]


RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
VOCABULARY, BYTE_LEVEL = "/opt/tokenizers/piece_bpe_32k.model", "/opt/tokenizers/byte_bpe_50k.json"


def op1_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = store(urlfilter.word_counts(table(spark, sf_dir, "documents")), "url-counts")
    return urlfilter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), RULES, counts).drop("url")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: A text is called toxic from this score on.
TOXIC = 0.3


def toxic_lexicon(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> toxicity.Lexicon:
    return toxicity.learn(docs.select("doc_id", "text"), labels.where(~toxicity.held_out()).select("doc_id", F.col("toxic").alias("label")))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lexicon = toxic_lexicon(spark, docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, lexicon)
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    slim = docs.select("doc_id", sharding.record_size(F.col("text")).alias("n"), sharding.text_key(F.col("text")).alias("k"))
    placed = sharding.assign_shards(slim, 24, size=F.col("n"), key=F.col("k"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op6_tokencount(spark: SparkSession, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokencount.count_tokens(docs, tokencount.unigram_vocabulary(vocabulary)).drop("text")


def op7_pfp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pfp.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc.archive_folder(spark)
    listed = warc.write_archives(table(spark, sf_dir, "pages"), folder)
    records, gaps = warc.read_archives(spark, folder)
    own = records.withColumn("name", F.element_at(F.split("path", "/"), -1)).join(listed.select(F.col("path").alias("name")), "name", "left_semi")
    lost = gaps.groupBy("path").agg(F.sum("length").alias("gap_bytes"))
    return own.join(lost, "path", "left").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", F.coalesce("gap_bytes", F.lit(0)).cast("long").alias("archive_gap_bytes"))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def source_mix() -> dict:
    """A source belongs to the domain of its name's last digit; the weights lift the small languages."""
    return {
        "domain": F.concat(F.lit("d"), F.regexp_extract("source", "([0-9])$", 1)), "lang": F.col("lang"), "source": F.col("source"), "fraction": 0.5,
        "lang_weights": {"en": 4.0, "de": 2.0, "fr": 2.0, "es": 2.0}, "max_epochs": 2, "seed": 20240601,
    }


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows, _ = mixing.mix(docs, **source_mix())
    return rows.select("doc_id", "mix_domain", "mix_lang", "mix_source", F.col("mix_epoch").alias("epoch"), F.col("mix_tokens").alias("tokens"), F.col("mix_taken").alias("taken"))


def op11_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = linededup.drop_shared_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op12_alignment(spark: SparkSession, sf_dir: str, byte_level: str = BYTE_LEVEL, piece_model: str = VOCABULARY) -> DataFrame:
    aligned = align.align(table(spark, sf_dir, "documents").select("doc_id", "text"), byte_level, piece_model)
    spelled = F.when(F.col("groups") == "", F.lit("")).otherwise(F.sha2(F.col("groups").cast("binary"), 256))
    aligned = store(aligned.withColumn("groups_sha256", spelled).drop("text", "groups"), "align-documents")
    return align.value_links(aligned, store(align.link_counts(aligned), "align-links")).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op13_hardneg(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardneg.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (op1_urlfilter, op2_decontamination, op3_toxicity, op4_sharding, op5_ann, op6_tokencount, op7_pfp, op8_warc, op9_minhash, op10_mixing, op11_linededup, op12_alignment, op13_hardneg)
}
ORACLES: dict[str, str] = dict(oracles.ORACLES)
