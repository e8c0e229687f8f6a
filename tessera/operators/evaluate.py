"""Ranked-retrieval, evidence and answer metrics, and the comparison of modes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tessera.functions import text as X
from tessera.functions.stem import stems
from tessera.functions import vectors as V

CUTS = (5, 10, 20)


def rank_metrics(retrieved: DataFrame, relevant: DataFrame, part: list[str], id_col: str, cuts: tuple[int, ...] = CUTS) -> DataFrame:
    """(part, k, relevant, hits, recall, precision, f1, hit, mrr, ndcg, ap) for every query of relevant(part, id) and every cut.

    retrieved(part, id, rank) holds each id once a query. Precision divides by k, average precision by min(relevant, k), MRR has no cut.
    """
    if min(cuts) <= 0:
        raise ValueError("a cut must be positive")
    truth = relevant.select(*part, id_col).distinct()
    size = truth.groupBy(*part).agg(F.count("*").alias("relevant"))
    found = retrieved.join(truth, [*part, id_col], "left_semi").select(*part, "rank")
    run = Window.partitionBy(*part).orderBy("rank")
    found = found.withColumns({"nth": F.row_number().over(run), "first": F.min("rank").over(Window.partitionBy(*part))})
    grid = size.withColumn("k", F.explode(F.array(*[F.lit(k) for k in cuts])))
    inside = F.col("rank") <= F.col("k")
    sums = grid.join(found, part, "left").groupBy(*part, "k", "relevant").agg(
        F.count_if(inside).alias("hits"), F.coalesce(F.max(1.0 / F.col("first")), F.lit(0.0)).alias("mrr"),
        F.coalesce(F.sum(F.when(inside, 1.0 / F.log2(F.col("rank") + 1.0))), F.lit(0.0)).alias("dcg"), F.coalesce(F.sum(F.when(inside, F.col("nth") / F.col("rank"))), F.lit(0.0)).alias("ap_sum"),
    )
    best = F.least("relevant", "k")
    ideal = F.aggregate(F.sequence(F.lit(1).cast("long"), best.cast("long")), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0))
    out = sums.withColumns({"recall": F.col("hits") / F.col("relevant"), "precision": F.col("hits") / F.col("k"), "ndcg": F.col("dcg") / ideal, "ap": F.col("ap_sum") / best, "hit": (F.col("hits") > 0).cast("int")})
    both = F.col("recall") + F.col("precision")
    return out.withColumn("f1", F.when(both > 0, 2 * F.col("recall") * F.col("precision") / both).otherwise(F.lit(0.0))).drop("dcg", "ap_sum")


def macro(metrics: DataFrame) -> DataFrame:
    """Means over queries with relevant items, a row for each cut."""
    kept = metrics.where("relevant > 0")
    return kept.groupBy("k").agg(*[F.avg(c).alias(f"avg_{c}") for c in ("recall", "precision", "f1", "hit", "mrr", "ndcg", "ap")], F.count("*").alias("queries"))


def evidence(listed: Column) -> Column:
    """Trimmed, non-empty, first of those that differ in case only."""
    trimmed = F.filter(F.transform(listed, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))
    lows = F.transform(trimmed, lambda x: F.lower(x))
    return F.filter(trimmed, lambda x, i: F.array_position(lows, F.lower(x)) == i + 1)


def evidence_matches(evidences: DataFrame, retrieved: DataFrame, part: list[str], least_f1: float = 0.65) -> DataFrame:
    """(part, evidence_no, rank): the first retrieved text of the query that contains the evidence (normalised) or reaches the token F1."""
    pairs = evidences.join(retrieved, part)
    a, b = F.col("evidence"), F.col("text")
    match = F.contains(X.normalized(b), X.normalized(a)) | (X.token_f1(a, b) >= least_f1)
    return pairs.where(match).groupBy(*part, "evidence_no").agg(F.min("rank").alias("rank"))


def evidence_metrics(evidences: DataFrame, retrieved: DataFrame, part: list[str], k: int = 5) -> DataFrame:
    """(part, evidences, recall, hit, mrr, ndcg, ap) at k; every evidence counts for its first matching rank only."""
    first = evidence_matches(evidences, retrieved.where(F.col("rank") <= k), part)
    total = evidences.groupBy(*part).agg(F.count("*").alias("evidences"))
    by_rank = first.groupBy(*part, "rank").agg(F.count("*").alias("credits"))
    by_rank = by_rank.withColumn("nth", F.row_number().over(Window.partitionBy(*part).orderBy("rank")))
    sums = by_rank.groupBy(*part).agg(F.sum("credits").alias("found"), F.min("rank").alias("first"), F.sum(1.0 / F.log2(F.col("rank") + 1.0)).alias("dcg"), F.sum(F.col("nth") / F.col("rank")).alias("ap_sum"))
    best = F.least("evidences", F.lit(k).cast("long"))
    ideal = F.aggregate(F.sequence(F.lit(1).cast("long"), best), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return total.join(sums, part, "left").select(
        *part, "evidences", zero(F.col("found") / F.col("evidences")).alias("recall"), F.when(F.col("found") > 0, 1).otherwise(0).alias("hit"), zero(1.0 / F.col("first")).alias("mrr"),
        zero(F.col("dcg") / ideal).alias("ndcg"), zero(F.col("ap_sum") / best).alias("ap"),
    )


def rouge_n(answer: Column, reference: Column, n: int) -> Column:
    """F-measure of common n-grams."""
    grams = lambda text: X.bound(lambda t: X.n_grams(t, n), X.tokens(text))
    return X.overlap_f1(grams(answer), grams(reference))


def exact_match(answer: Column, reference: Column) -> Column:
    ref = X.normalized(reference)
    return F.when((ref != "") & (X.normalized(answer) == ref), 1).otherwise(0)


def longest_common(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, one bit a position of a."""
    at: dict[str, int] = {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | (1 << i)
    row, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for w in b:
        hit = row & at.get(w, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def _longest_f(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in pairs:
        yield pd.Series([2.0 * longest_common(list(x), list(y)) / (len(x) + len(y)) if len(x) and len(y) else 0.0 for x, y in zip(a, b, strict=True)])


def rouge_l(answer: Column, reference: Column) -> Column:
    return pandas_udf(_longest_f, "double")(X.tokens(answer), X.tokens(reference))


def stemmed_words(text: str) -> Column:
    """Stems of the runs of a-z and 0-9 of a text column."""
    return stems(f"regexp_extract_all(lower(coalesce(`{text}`, '')), '[a-z0-9]+', 0)")


def rouge_stemmed(rows: DataFrame, answer: str, reference: str) -> DataFrame:
    """rows with rouge1, rouge2 and rouge_l over stemmed words; texts without words, null ones too, score 0."""
    words = rows.withColumns({"_a": stemmed_words(answer), "_b": stemmed_words(reference)})
    grams = lambda n: X.overlap_f1(X.n_grams(F.col("_a"), n), X.n_grams(F.col("_b"), n))
    return words.withColumns({"rouge1": grams(1), "rouge2": grams(2), "rouge_l": pandas_udf(_longest_f, "double")("_a", "_b")}).drop("_a", "_b")


def is_correct(similarity: Column, longest: Column, least_similarity: float = 0.65, least_longest: float = 0.40) -> Column:
    return (similarity >= least_similarity) | (longest >= least_longest)


def answer_similarity(answer: Column, reference: Column) -> Column:
    """Cosine of the hashed token counts of two texts, to six digits; 0 where either has no token."""
    bags = lambda a, b: X.bound(lambda x: X.bound(lambda y: V.dot(x, y) / (V.length(x) * V.length(y)), b), a)
    empty = (F.size(X.tokens(answer)) < 1) | (F.size(X.tokens(reference)) < 1)
    return F.when(~empty, F.round(bags(X.hashed_counts(answer), X.hashed_counts(reference)), 6)).otherwise(F.lit(0.0))


def answer_accuracy(pairs: DataFrame, answer: str = "answer", reference: str = "reference") -> DataFrame:
    """One row: turns, the share of correct ones, and means of similarity, ROUGE-L, token F1 and exact matches over pairs(answer, reference); without pairs the means are null."""
    a, b = F.col(answer), F.col(reference)
    each = pairs.select(answer_similarity(a, b).alias("similarity"), rouge_l(a, b).alias("rouge_l"), X.token_f1(a, b).alias("token_f1"), exact_match(a, b).alias("exact"))
    right = is_correct(F.col("similarity"), F.col("rouge_l")).cast("int")
    return each.agg(F.count("*").alias("turns"), F.avg(right).alias("accuracy"), *[F.avg(c).alias(f"avg_{c}") for c in ("similarity", "rouge_l", "token_f1", "exact")])


def paired(answers: DataFrame, references: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, answer, reference) of answers(keys, answer) and references(keys, reference); fails when it runs if a turn is on one side only or twice on a side."""
    sides = [df.groupBy(*keys).agg(F.count("*").alias(f"_n{i}"), F.first(c).alias(c)) for i, (df, c) in enumerate(((answers, "answer"), (references, "reference")))]
    both = sides[0].join(sides[1], keys, "full")
    odd = F.when((F.coalesce("_n0", F.lit(0)) == 1) & (F.coalesce("_n1", F.lit(0)) == 1), F.lit(True)).otherwise(F.raise_error("answers and references must have the same turns").cast("boolean"))
    return both.where(odd).drop("_n0", "_n1")


def text_recall(turns: DataFrame, retrieved: DataFrame, part: list[str], phrase: str = "phrase") -> DataFrame:
    """(part, found): whether the retrieved texts of a turn, joined in rank order by blanks, contain the phrase in any case."""
    joined = retrieved.groupBy(*part).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]), " ").alias("all"))
    return turns.join(joined, part, "left").select(*part, F.coalesce(F.contains(F.lower("all"), F.lower(F.col(phrase))), F.lit(False)).cast("int").alias("found"))


def compare(summaries: DataFrame, base: str, other: str, lower_is_better: tuple[str, ...] = ("latency",)) -> DataFrame:
    """(metric, base, other, delta, improvement_pct) of summaries(mode, metric, value); a base of 0 gives 0 percent."""
    a = summaries.where(F.col("mode") == base).select("metric", F.col("value").alias("base"))
    b = summaries.where(F.col("mode") == other).select("metric", F.col("value").alias("other"))
    delta = F.when(F.col("metric").isin(*lower_is_better), F.col("base") - F.col("other")).otherwise(F.col("other") - F.col("base"))
    return a.join(b, "metric").withColumn("delta", F.round(delta, 4)).withColumn("improvement_pct", F.when(F.col("base") == 0, 0.0).otherwise(F.round(100 * delta / F.abs("base"), 2)))


def verdict(compared: DataFrame, names: tuple[str, ...] = ("recall", "coverage", "accuracy", "latency")) -> DataFrame:
    """One row: improved, worse or equal for each of names, and the majority."""
    word = F.when(F.col("delta") > 0, "improved").when(F.col("delta") < 0, "worse").otherwise("equal")
    each = compared.where(F.col("metric").isin(*names)).withColumn("word", word)
    ups, downs = F.count_if(F.col("word") == "improved"), F.count_if(F.col("word") == "worse")
    return each.agg(*[F.max(F.when(F.col("metric") == n, F.col("word"))).alias(n) for n in names], F.when(ups > downs, "improved").when(ups < downs, "worse").otherwise("equal").alias("overall"))
