"""Sharding by sampled splitters (DataFrame functions only).

Records are ordered by (group key, id), where the key of a document is the CRC-32 of its text, so that equal texts lie side
by side. Size-weighted samples of the keys give quantiles as splitters; the ranges between them are measured, and overfull ranges are subdivided by
samples of their own. A record's shard follows from the bytes that precede it in the whole order.

Groups of equal texts stay whole unless they are larger than a shard. Those above LARGE of a shard, of which there are at most
n_shards / LARGE, are given to the emptiest shards first, the largest at the head; what is larger than a shard fills as many as it needs, cut by a hash of the id.
The order of all other records is then cut where it fills up what the large groups have left of each shard.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import quoted, store, without

#: Ranges asked of the sampler for each shard, and samples drawn for each range.
RANGES_PER_SHARD, SAMPLES_PER_RANGE = 4, 24
#: Rows meant for a range at most: more rows make more ranges, so no task grows with the input.
ROWS_PER_RANGE = 500_000
#: Share of a shard from which a group of equal texts is placed by itself; parts into which an overfull range is cut; rounds of that at most.
LARGE, PARTS, ROUNDS = 0.01, 16, 4
#: Keys have 32 bits; so many leading bits name the cell in which a splitter is looked up.
KEY_BITS, CELL_BITS = 32, 12


def record_size(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus 8."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + F.lit(8)


def text_key(text: Column) -> Column:
    """Unsigned CRC-32 of the text's UTF-8 bytes; null counts as empty."""
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def _ranged(rows: DataFrame, cuts: list[int]) -> DataFrame:
    """rows with r, the number of cuts that do not exceed k. The cuts are a table of a row for each cell, which is joined and not written into the plan."""
    inside: dict[int, list[int]] = {}
    for c in cuts:
        inside.setdefault(c >> (KEY_BITS - CELL_BITS), []).append(c)
    cells, before = [], 0
    for cell in range(1 << CELL_BITS):
        cells.append((cell, before, inside.get(cell, [])))
        before += len(cells[-1][2])
    cells = F.broadcast(rows.sparkSession.createDataFrame(cells, "cell long, before int, inside array<long>"))
    found = rows.withColumn("cell", F.shiftright("k", KEY_BITS - CELL_BITS)).join(cells, "cell")
    return found.withColumn("r", F.col("before") + F.size(F.filter("inside", lambda c: c <= F.col("k")))).drop("cell", "before", "inside")


def _sample(rows: DataFrame, draws: Column) -> DataFrame:
    """Rows drawn with a chance of draws times their size; the same rows each time."""
    chance = F.pmod(F.xxhash64("i", "k", F.lit(17)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return rows.where(chance < F.col("b") * draws)


def _splitters(rows: DataFrame, total: int, wanted: int) -> list[int]:
    """At most wanted - 1 keys between ranges of nearly equal bytes. Quantiles come from a mergeable sketch, so no task sees the whole sample."""
    if not total or wanted < 2:
        return []
    sample = _sample(rows, F.lit(wanted * SAMPLES_PER_RANGE / total))
    at = [i / wanted for i in range(1, wanted)]
    cuts = set(sample.agg(F.percentile_approx("k", at, 10 * wanted)).first()[0] or [])
    limit = 2.0 * total / wanted
    for _ in range(ROUNDS):
        sums = _ranged(rows, sorted(cuts)).groupBy("r").agg(F.sum("b").alias("all"), F.min("k").alias("low"), F.max("k").alias("high"))
        full = sums.where((F.col("all") > limit) & (F.col("low") < F.col("high"))).select("r", "all").collect()
        if not full:
            break
        table = F.broadcast(rows.sparkSession.createDataFrame([(x.r, float(x["all"])) for x in full], "r int, all double"))
        parts = _sample(_ranged(rows, sorted(cuts)).join(table, "r"), F.lit(float(PARTS * SAMPLES_PER_RANGE)) / F.col("all"))
        more = parts.groupBy("r").agg(F.percentile_approx("k", [i / PARTS for i in range(1, PARTS)], 1000).alias("q")).collect()
        new = {k for x in more for k in x.q} - cuts
        if not new:
            break
        cuts |= new
    return sorted(cuts)


def _placement(groups: list[tuple[int, int]], total: int, n_shards: int) -> tuple[dict[int, list[tuple[float, int]]], list[float]]:
    """For each large group the ends of its pieces and their shards, and what is left of each shard."""
    share, emptiest = total / n_shards, [(0.0, s) for s in range(n_shards)]
    pieces: dict[int, list[tuple[float, int]]] = {}
    for k, size in sorted(groups, key=lambda g: (-g[1], g[0])):
        ends, at = [], 0.0
        while at < size:
            step = share if size - at > share else size - at
            load, shard = heapq.heappop(emptiest)
            heapq.heappush(emptiest, (load + step, shard))
            at += step
            ends.append((at if at < size else float(size), shard))
        pieces[k] = ends
    return pieces, [max(0.0, share - load) for load, _ in sorted(emptiest, key=lambda x: x[1])]


def assign_shards(docs: DataFrame, n_shards: int, id_col: str = "doc_id", text_col: str = "text", large: float = LARGE, size: Column | None = None, key: Column | None = None) -> DataFrame:
    """docs with size, text_crc32, shard and slot: shards of nearly equal bytes.

    size and key (32 bits) stand in for the text's where docs has none. Law: `bytes`. Equal keys stay in one shard unless they are together larger than
    one, so a shard's bytes differ from the mean by `large` of it, by one record, or by what whole groups do not let even out.
    slot numbers a shard's records from 0 without gaps, in the order of key, id and size. A null text has size 8 and
    the key of the empty text; a null id sorts first; repeated rows all get a slot of their own, in no particular order; a long text is a record like others.
    An empty table gives no rows. Columns of docs that are called like a result, in any case of letters, are replaced.
    """
    spark = docs.sparkSession
    made = ["size", "text_crc32", "shard", "slot"]
    kept = without(docs, made)
    own = [quoted(c).alias(f"c{n}") for n, c in enumerate(kept)]
    rows = docs.select(
        *own, (record_size(quoted(text_col)) if size is None else size).cast("long").alias("b"), (text_key(quoted(text_col)) if key is None else key).cast("long").alias("k"),
        F.coalesce(quoted(id_col).cast("long"), F.lit(-(1 << 63))).alias("i"),
    )
    rows = store(rows, "shard-rows")
    narrow = rows.select("k", "i", "b")
    total, n_rows = narrow.agg(F.sum("b"), F.count("*")).first()
    out = [*[F.col(f"c{n}").alias(c) for n, c in enumerate(kept)], F.col("b").alias("size"), F.col("k").alias("text_crc32"), "shard", "slot"]
    if not n_rows:
        return rows.withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("long")}).select(*out)

    share = total / n_shards
    groups = narrow.groupBy("k").agg(F.sum("b").alias("all"), F.count("*").alias("n")).where(F.col("all") > large * share).orderBy("k").collect()
    pieces, left = _placement([(g.k, g["all"]) for g in groups], total, n_shards)
    # A large group is cut into blocks by a hash of the id, which stand in its order one after the other.
    table = [(n, g.k, -(-g.n // ROWS_PER_RANGE), [e for e, _ in pieces[g.k]], [s for _, s in pieces[g.k]]) for n, g in enumerate(groups)]
    table = F.broadcast(spark.createDataFrame(table, "g int, k long, blocks long, ends array<double>, shards array<int>"))
    small = narrow.join(table.select("k"), "k", "left_anti")
    small_total = total - sum(g["all"] for g in groups)
    cuts = _splitters(small, small_total, max(n_shards * RANGES_PER_SHARD, -(-n_rows // ROWS_PER_RANGE)))

    block = F.pmod(F.xxhash64("i"), F.col("blocks"))
    ranged = _ranged(rows, cuts).join(table, "k", "left").withColumn("unit", F.coalesce((F.col("g") + 1) * F.lit(-(1 << 32)) + block, F.col("r").cast("long"))).drop("r")
    # Bytes that precede a unit: all before it among the small ones, or the blocks before it in its group. A row for each unit.
    sums = ranged.groupBy("unit").agg(F.sum("b").alias("all"), F.first("g").alias("g")).collect()
    starts, run = [], {}
    for u in sorted(sums, key=lambda u: u.unit):
        starts.append((u.unit, float(run.get(u.g, 0))))
        run[u.g] = run.get(u.g, 0) + u["all"]
    starts = F.broadcast(spark.createDataFrame(starts, "unit long, start double"))
    order = Window.partitionBy("unit").orderBy("k", "i", "b")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    group = Window.partitionBy("unit", "k")
    placed = ranged.join(starts, "unit").withColumns({"end": F.col("start") + F.sum("b").over(upto), "row": F.row_number().over(order)})
    placed = placed.withColumns({"of_group": F.sum("b").over(group), "last": F.max("end").over(group)})
    # Small groups go by their middle, so that they stay whole; rows of a large one by their own.
    middle = F.when(F.col("g").isNull(), F.col("last") - F.col("of_group") / 2.0).otherwise(F.col("end") - F.col("b") / 2.0)
    scale, bounds, at = small_total / (sum(left) or 1.0), [], 0.0
    for x in left[:-1]:
        at += x * scale if sum(left) else small_total / n_shards
        bounds.append(at)
    shard = F.when(F.col("g").isNull(), F.size(F.filter(F.array(*[F.lit(x) for x in bounds]).cast("array<double>"), lambda x: x <= middle)))
    shard = shard.otherwise(F.get("shards", F.least(F.size("shards") - 1, F.size(F.filter("ends", lambda x: x <= middle))))).cast("int")
    placed = placed.withColumn("shard", shard)
    # The rows that a unit has in a shard follow each other; a row for each pair of unit and shard says where they begin.
    firsts, offset = [], {}
    for x in sorted(placed.groupBy("unit", "shard").agg(F.min("row").alias("row"), F.count("*").alias("n")).collect(), key=lambda x: (x.shard, x.unit)):
        firsts.append((x.unit, x.shard, offset.get(x.shard, 0) - x["row"]))
        offset[x.shard] = offset.get(x.shard, 0) + x.n
    firsts = F.broadcast(spark.createDataFrame(firsts, "unit long, shard int, first long"))
    return placed.join(firsts, ["unit", "shard"]).withColumn("slot", (F.col("row") + F.col("first")).cast("long")).select(*out)
