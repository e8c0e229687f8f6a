"""URL filter: allow and block rules, then naive Bayes over segmented names.

Rules are a table: each url's host and its parent domains are joined with the hosts of rules, and the longest rule whose path fits wins.
Host labels and path parts are cut into runs of letters and runs of digits, and runs of letters into words by a unigram Viterbi search: the substrings of a
label that have the length of some word are looked up in the word counts of a corpus by a join, and the best way through them is found per distinct label. The top-level
domain is one word. A multinomial naive Bayes model, trained on the urls that rules decide (or on given labels), scores the words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import quoted, store, without

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ?, # or end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """(name, start, rule, said, nth) of (verdict, rule) pairs: the host, and the beginning of paths, that each asks for."""
    rows = [(text.partition("/")[0], "".join(text.partition("/")[1:]), text, said, n) for n, (said, text) in enumerate(rules)]
    return spark.createDataFrame(rows, "name string, start string, rule string, said string, nth int")


def decided(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule, said) of those distinct urls(host, path) that a rule of rule_table() fits: the longest one, of equally long ones the last."""
    labels = F.split("host", r"\.")
    names = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    asked = urls.select("host", "path", F.explode(names).alias("name"))
    fits = asked.join(rules, "name").where(F.col("path").startswith(F.col("start")))
    best = F.max_by(F.struct("rule", "said"), F.struct(F.length("rule"), "nth"))
    return fits.groupBy("host", "path").agg(best.alias("r")).select("host", "path", "r.rule", "r.said")


def word_counts(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, count): the runs of a-z in lower-cased texts that occur at least twice."""
    words = texts.select(F.explode(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), "[^a-z]+")).alias("word"))
    return words.where("word <> ''").groupBy("word").agg(F.count("*").alias("count")).where("count > 1")


def segment(label: str, found: dict[tuple[int, int], int], total: int) -> list[str]:
    """The most probable words of a label; found has the counts of (start, length), all above 1. A string that is no word
    has probability 10 / (total x 10 ^ length), which is less than that of any word. Ties go to the longer last word."""
    ten, rare = math.log(10), math.log(10 / total)
    ending: dict[int, list[int]] = {}
    for start, n in found:
        ending.setdefault(start + n, []).append(start)
    best, back = [0.0], [0]
    # The best beginning of an unknown string is the same for all ends behind it.
    free, begin = -math.inf, 0
    for end in range(1, len(label) + 1):
        if best[end - 1] + (end - 1) * ten > free + 1e-9:
            free, begin = best[end - 1] + (end - 1) * ten, end - 1
        ways = [(begin, rare + free - end * ten)] + [(s, best[s] + math.log(found[s, end - s] / total)) for s in ending.get(end, [])]
        top = max(w for _, w in ways)
        best.append(top)
        back.append(min(s for s, w in ways if w > top - 1e-9))
    words, end = [], len(label)
    while end:
        words.append(label[back[end] : end])
        end = back[end]
    return words[::-1]


def _segment(total: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = batch.column("label").to_pylist()
            words = [segment(a, {(p["s"], p["n"]): p["c"] for p in found}, total) for a, found in zip(labels, batch.column("found").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(words, pa.list_(pa.string()))], ["label", "words"])

    return run


def segmented(labels: DataFrame, counts: DataFrame) -> DataFrame:
    """(label, words) of distinct labels(label). Labels that are not a-z throughout are one word; one that begins with a full stop is the rest of it."""
    plain = F.col("label").rlike("^[a-z]{2,}$")
    total = int(counts.agg(F.sum("count")).first()[0] or 1)
    lengths = counts.select(F.length("word").alias("n")).distinct()
    longest = labels.where(plain).select(F.length("label").alias("n")).distinct()
    lengths = sorted(r.n for r in lengths.join(longest.agg(F.max("n").alias("most")), F.col("n") <= F.col("most")).collect())
    parts = labels.where(plain).withColumn("s", F.explode(F.sequence(F.lit(0), F.length("label") - 1)))
    sizes = F.array(*[F.lit(n) for n in lengths]) if lengths else F.array().cast("array<int>")
    parts = parts.withColumn("n", F.explode(F.filter(sizes, lambda n: n <= F.length("label") - F.col("s"))))
    parts = parts.withColumn("word", F.substring("label", F.col("s") + 1, F.col("n")))
    known = parts.join(counts, "word").groupBy("label").agg(F.collect_list(F.struct("s", "n", F.col("count").alias("c"))).alias("found"))
    all_plain = labels.where(plain).join(known, "label", "left").withColumn("found", F.coalesce("found", F.array().cast("array<struct<s:int,n:int,c:bigint>>")))
    whole = labels.where(~plain).select("label", F.array(F.regexp_replace("label", r"^\.(.)", "$1")).alias("words"))
    return all_plain.mapInArrow(_segment(total), "label string, words array<string>").unionByName(whole)


def name_parts(host: Column, path: Column) -> Column:
    """Runs of letters, digits and other than ASCII characters of host and path; one of digits is '#' and its length. The host's last label, if
    it is one run of letters behind a full stop, comes with this."""
    run = r"[a-z]+|[0-9]+|[^\x00-\x7F]+"
    runs = F.concat(F.regexp_extract_all(host, F.lit(rf"\.[a-z]+(?=:[0-9]*$|$)|{run}"), F.lit(0)), F.regexp_extract_all(F.translate(path, UPPER, LOWER), F.lit(run), F.lit(0)))
    return F.transform(runs, lambda p: F.when(p.rlike("^[0-9]+$"), F.concat(F.lit("#"), F.length(p).cast("string"))).otherwise(p))


def judge(pages: DataFrame, rules: list[tuple[str, str]], counts: DataFrame, labels: DataFrame | None = None, url_col: str = "url", smoothing: float = 1.0) -> DataFrame:
    """pages with host, path, rule, verdict, words and log_odds (above 0: block).

    The rule's verdict holds where one fits, the longest winning and of equally long ones the last; else the model's. counts is word_counts() of some corpus. The
    model learns from labels(url, verdict) or else from the pages that rules decide; without both of the verdicts there it allows, and log-odds of 0
    allow. A null url, or one without ://, has empty host and path. Long urls are taken whole. Repeated rows are judged alike; an empty table
    stays empty. Columns of pages called like a result, in any case of letters, are replaced.
    """
    spark = pages.sparkSession
    made = ["host", "path", "rule", "verdict", "words", "log_odds"]
    own = without(pages, made)
    host, path = host_of(quoted(url_col)), path_of(quoted(url_col))
    rows = pages.select(*[quoted(c).alias(f"c{n}") for n, c in enumerate(own)], host.alias("host"), path.alias("path"))
    urls = store(rows.groupBy("host", "path").agg(F.count("*").alias("rows")).withColumn("parts", name_parts(F.col("host"), F.col("path"))), "url-distinct")
    split = store(segmented(urls.select(F.explode("parts").alias("label")).distinct(), counts), "url-words")
    ruled = store(decided(urls, rule_table(spark, rules)), "url-ruled")

    if labels is None:
        taught = urls.join(ruled, ["host", "path"]).select("parts", "rows", "said")
        known = split
    else:
        given = labels.select(name_parts(host_of(F.col("url")), path_of(F.col("url"))).alias("parts"), F.col("verdict").alias("said"), F.lit(1).alias("rows"))
        taught = given.where(F.col("said").isin("allow", "block"))
        known = segmented(taught.select(F.explode("parts").alias("label")).distinct(), counts)
    # Parts are summed before they are joined with their words, so a part that most urls have is one row.
    by_part = taught.select(F.explode("parts").alias("label"), "said", "rows").groupBy("label").agg(*[F.sum(F.when(F.col("said") == v, F.col("rows")).otherwise(0)).alias(v) for v in ("allow", "block")])
    words = by_part.join(known, "label").select(F.explode("words").alias("word"), "allow", "block").groupBy("word").agg(F.sum("allow").alias("allow"), F.sum("block").alias("block"))
    words = store(words, "url-model")
    size, allow, block = words.agg(F.count("*"), F.sum("allow"), F.sum("block")).first()
    seen = {r.said: r["sum(rows)"] for r in taught.groupBy("said").agg(F.sum("rows")).collect()}
    if len(seen) < 2:
        prior, weight = -1.0, F.lit(0.0)
    else:
        prior = math.log(seen["block"] / seen["allow"])
        weight = F.log((F.col("block") + smoothing) / (block + smoothing * size)) - F.log((F.col("allow") + smoothing) / (allow + smoothing * size))
    by_label = split.select("label", "words", F.explode("words").alias("word")).join(words.select("word", weight.alias("weight")), "word", "left")
    by_label = by_label.groupBy("label").agg(F.first("words").alias("words"), F.sum(F.coalesce("weight", F.lit(0.0))).alias("weight"))
    scored = urls.select("host", "path", F.posexplode_outer("parts").alias("at", "label")).join(by_label, "label", "left")
    scored = scored.groupBy("host", "path").agg((F.sum(F.coalesce("weight", F.lit(0.0))) + prior).alias("log_odds"), F.array_sort(F.collect_list(F.struct("at", "words"))).alias("all"))
    scored = scored.select("host", "path", "log_odds", F.array_join(F.flatten(F.transform(F.filter("all", lambda x: x["words"].isNotNull()), lambda x: x["words"])), " ").alias("words"))
    judged = scored.join(ruled, ["host", "path"], "left").withColumn("verdict", F.coalesce("said", F.when(F.col("log_odds") > 0, "block").otherwise("allow")))
    # Stored, so that the join has a shuffle on either side and a url that very many rows have can be split; rows without a url share one judgement.
    judged = store(judged.select("host", "path", "rule", "verdict", "words", "log_odds"), "url-judged")
    bare = (F.col("host") == "") & (F.col("path") == "")
    nothing = F.broadcast(judged.where(bare).drop("host", "path"))
    done = rows.where(~bare).join(judged.where(~bare), ["host", "path"]).unionByName(rows.where(bare).join(nothing, F.lit(True)))
    return done.select(*[F.col(f"c{n}").alias(c) for n, c in enumerate(own)], *made)
