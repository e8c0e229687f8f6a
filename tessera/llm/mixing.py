"""Mixing sources to target weights by hierarchical budgeting (DataFrame functions only).

A tree of domain, language and source has weights at every level. The token budget runs
down the tree; what a node cannot supply goes to its siblings first and, once all of
them are full, to the nodes above. Each leaf then yields the first tokens of its seeded epochs:
epoch 0 is one pseudo-random order of its documents, epoch 1 the next, up to `max_epochs`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import quoted, store, without

LEVELS = ["mix_domain", "mix_lang", "mix_source"]
#: Rows of a leaf that share a block of its order: only the block in which the budget ends is sorted.
ROWS_PER_BLOCK = 2_000
#: Ranges of what flooring takes from a budget, from 0 to 1 token.
RANGES = 4096


def count_tokens(text: Column) -> Column:
    """Runs of characters other than ASCII white space; null has none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^ \t-\r]+"))


def prefix(text: Column, tokens: Column) -> Column:
    """The text up to the end of its so many-th token, blanks before and between as they are."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"[ \t-\r]*[^ \t-\r]+"), F.lit(0)), F.lit(1), tokens.cast("int")), "")


def water_fill(nodes: DataFrame, parent: list[str], budget: str, cap: str, weight: str, out: str) -> DataFrame:
    """Share each parent's budget among its children: min(cap, weight x level), the level being such that all is used.

    Children are taken in the order in which they fill up. Before each, the level that would use up the budget
    if all from it on stayed below their caps is known from two running sums; a child
    is full if its own filling level does not exceed that. A child of weight 0 gets something only when all others are full.
    """
    w = F.greatest(F.col(weight), F.lit(1e-12))
    order = Window.partitionBy(*parent).orderBy(F.col(cap) / w, *[F.col(c) for c in nodes.columns if c in LEVELS])
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.col(budget) - F.coalesce(F.sum(cap).over(before), F.lit(0.0))) / F.sum(w).over(after)
    filled = nodes.withColumn("_mx_level", level).withColumn("_mx_full", F.col(cap) / w <= F.col("_mx_level"))
    stop = F.min(F.when(~F.col("_mx_full"), F.struct(F.col(cap) / w, F.col("_mx_level").alias("l")))).over(Window.partitionBy(*parent))
    return filled.withColumn(out, F.when(F.col("_mx_full"), F.col(cap)).otherwise(F.least(F.col(cap), w * F.greatest(stop["l"], F.lit(0.0))))).drop("_mx_level", "_mx_full")


def leaf_budgets(leaves: DataFrame, total: float | Column, max_epochs: int) -> DataFrame:
    """leaves(mix_domain, mix_lang, mix_source, tokens, rows, weight_*) with budget: what each leaf is to supply."""
    d, l, s = LEVELS  # noqa: E741
    tree = leaves.withColumn("cap", F.col("tokens") * F.lit(float(max_epochs)))
    langs = tree.groupBy(d, l).agg(F.sum("cap").alias("cap"), F.max("weight_lang").alias("weight_lang"), F.max("weight_domain").alias("weight_domain"))
    domains = langs.groupBy(d).agg(F.sum("cap").alias("cap"), F.max("weight_domain").alias("weight_domain"))
    root = F.lit(0).alias("_mx_root")
    domains = water_fill(domains.select("*", root).withColumn("all", F.lit(total) if not isinstance(total, Column) else total), ["_mx_root"], "all", "cap", "weight_domain", "budget_d")
    langs = water_fill(langs.join(domains.select(d, "budget_d"), d), [d], "budget_d", "cap", "weight_lang", "budget_l")
    return water_fill(tree.join(langs.select(d, l, "budget_l"), [d, l]), [d, l], "budget_l", "cap", "weight_source", "budget").drop("cap", "budget_l")


def mix(
    docs: DataFrame, domain: Column, lang: Column, source: Column, fraction: float = 0.5, domain_weights: dict[str, float] | None = None,
    lang_weights: dict[str, float] | None = None, source_weights: dict[str, float] | None = None, max_epochs: int = 4, seed: int = 0, id_col: str = "doc_id", text_col: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """(rows, leaves): docs chosen to match the target weights, and the budget of each leaf.

    The whole budget is `fraction` of all tokens. rows has the columns of docs and mix_domain, mix_lang,
    mix_source, mix_epoch, mix_tokens, and mix_taken (tokens taken: less than mix_tokens only in a leaf's
    last document). A document comes once for each epoch that takes it. Names missing from a weight
    dictionary weigh 1. A null domain, language or source is the name ''. A null or empty text has no tokens and is
    never taken; a long one is counted whole. Equal hashes are ordered by id, null first, then by a hash of the text; repeated rows count each time.
    Budgets are whole tokens that add up to the whole budget: what flooring leaves over goes to the leaves that lost most by it. An empty table gives no
    rows. Columns of docs called like a result, in any case of letters, are replaced.
    """
    names = {"mix_domain": domain, "mix_lang": lang, "mix_source": source}
    made = [*LEVELS, "mix_epoch", "mix_tokens", "mix_taken"]
    own = without(docs, made)
    kept = [f"c{n}" for n in range(len(own))]
    named = docs.select(
        *[quoted(c).alias(k) for c, k in zip(own, kept, strict=True)], quoted(id_col).alias("_mx_id"), F.xxhash64(quoted(text_col)).alias("_mx_text"),
        *[F.coalesce(c.cast("string"), F.lit("")).alias(n) for n, c in names.items()], count_tokens(quoted(text_col)).cast("long").alias("mix_tokens"),
    )
    named = store(named.where("mix_tokens > 0"), "mix-named")

    def weigh(name: str, weights: dict[str, float] | None) -> Column:
        if not weights:
            return F.lit(1.0)
        table = F.create_map(*[F.lit(x) for kv in sorted(weights.items()) for x in (kv[0], float(kv[1]))])
        return F.coalesce(table[F.col(name)], F.lit(1.0))

    leaves = named.groupBy(*LEVELS).agg(F.sum("mix_tokens").cast("double").alias("tokens"), F.count("*").alias("rows"))
    leaves = leaves.withColumns({"weight_domain": weigh(LEVELS[0], domain_weights), "weight_lang": weigh(LEVELS[1], lang_weights), "weight_source": weigh(LEVELS[2], source_weights)})
    total = leaves.agg(F.sum("tokens")).first()[0] or 0.0
    leaves = leaf_budgets(leaves, F.lit(total * fraction), max_epochs).withColumn("_mx_floor", F.floor("budget").cast("long"))
    left = leaves.agg((F.floor(F.sum("budget") + 1e-6) - F.sum("_mx_floor")).alias("_mx_left"))
    # The place of each leaf among all, by what flooring took: leaves are counted by ranges of it, and put in order within their range.
    leaves = leaves.withColumn("_mx_lost", F.col("budget") - F.col("_mx_floor")).withColumn("_mx_range", F.floor(F.col("_mx_lost") * RANGES).cast("int"))
    ranges = leaves.groupBy("_mx_range").agg(F.count("*").alias("_mx_count"))
    higher = Window.orderBy(F.desc("_mx_range")).rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("_mx_range", F.coalesce(F.sum("_mx_count").over(higher), F.lit(0)).alias("_mx_higher"))
    lost = Window.partitionBy("_mx_range").orderBy(F.desc("_mx_lost"), *LEVELS)
    leaves = leaves.withColumn("_mx_nth", F.row_number().over(lost)).join(F.broadcast(ranges), "_mx_range").withColumn("_mx_nth", F.col("_mx_nth") + F.col("_mx_higher")).join(F.broadcast(left), F.lit(True))
    more = (F.col("_mx_nth") <= F.col("_mx_left")) & (F.col("_mx_floor") < F.col("budget"))
    leaves = store(leaves.withColumn("tokens_budget", F.col("_mx_floor") + more.cast("long")).drop("_mx_floor", "_mx_nth", "_mx_left", "_mx_lost", "_mx_range", "_mx_higher"), "mix-leaves")

    # A leaf's order is that of a seeded hash. Blocks of it are summed first; then only blocks are put in order.
    budget = leaves.select(*LEVELS, "tokens", "rows", F.col("tokens_budget").alias("_mx_budget")).withColumns({
        "_mx_blocks": F.ceil(F.col("rows") / F.lit(ROWS_PER_BLOCK)).cast("long"), "_mx_whole": F.floor(F.col("_mx_budget") / F.col("tokens")).cast("int"),
    })
    part = budget.withColumn("_mx_part", F.col("_mx_budget") - F.col("_mx_whole") * F.col("tokens").cast("long"))
    rows = named.join(part, LEVELS)
    spread = 1 << 40
    rows = rows.withColumn("_mx_hash", F.pmod(F.xxhash64("_mx_id", F.lit(seed), F.col("_mx_whole")), F.lit(spread)))
    rows = rows.withColumn("_mx_block", F.floor(F.col("_mx_hash") * F.col("_mx_blocks") / F.lit(spread)).cast("long"))
    sums = rows.where("_mx_part > 0").groupBy(*LEVELS, "_mx_block").agg(F.sum("mix_tokens").alias("_mx_sum"))
    order = Window.partitionBy(*LEVELS).orderBy("_mx_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_mx_before", F.coalesce(F.sum("_mx_sum").over(order), F.lit(0))).join(part.select(*LEVELS, F.col("_mx_part").alias("_mx_want")), LEVELS)
    ends = sums.where("_mx_before < _mx_want").select(*LEVELS, "_mx_block", "_mx_before", (F.col("_mx_before") + F.col("_mx_sum") > F.col("_mx_want")).alias("_mx_last"))
    whole = rows.where("_mx_whole > 0").select(*kept, *LEVELS, F.explode(F.sequence(F.lit(0), F.col("_mx_whole") - 1)).alias("mix_epoch"), "mix_tokens", F.col("mix_tokens").alias("mix_taken"))
    placed = rows.join(ends, [*LEVELS, "_mx_block"])
    run = Window.partitionBy(*LEVELS).orderBy("_mx_hash", F.col("_mx_id").asc_nulls_first(), "_mx_text").rowsBetween(Window.unboundedPreceding, -1)
    inside = placed.where("_mx_last").withColumn("_mx_start", F.col("_mx_before") + F.coalesce(F.sum("mix_tokens").over(run), F.lit(0)))
    cut = inside.where("_mx_start < _mx_part").withColumn("mix_taken", F.least("mix_tokens", F.col("_mx_part") - F.col("_mx_start")))
    first = placed.where("not _mx_last").withColumn("mix_taken", F.col("mix_tokens"))
    last = [x.select(*kept, *LEVELS, F.col("_mx_whole").alias("mix_epoch"), "mix_tokens", "mix_taken") for x in (first, cut)]
    return whole.unionByName(last[0]).unionByName(last[1]).select(*[F.col(k).alias(c) for c, k in zip(own, kept, strict=True)], *made), leaves
