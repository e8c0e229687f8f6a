"""The concept graph: extraction, edges, traversal, distances and ranks. Distances are weights of edges: low is strong."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.common import store
from tessera.functions import text as X

CONCEPT, SHARED, SIMILAR, FOUND = "contains_keyword", "related_via_common_concepts", "semantic_similarity", "found_in_chunk"
KEYWORDS = 10
#: Texts whose words are counted at once.
TEXTS = 1024
#: Capitalised words inside sentences.
NAMES = r"[\p{Ll},] (\p{Lu}\p{L}{2,})"


def concepts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keywords: int = KEYWORDS) -> DataFrame:
    """(id, word, type, score): the most frequent longer words of a text as KEYWORD, capitalised words inside sentences as NER.

    Words of a text are ordered by count, then length, then alphabet; stop words and words of up to 2 letters do not count. (word, type) is unique per text.
    """
    words = docs.select(id_col, F.explode(X.tokens(F.col(text_col))).alias("word")).where((F.length("word") > 2) & ~F.col("word").isin(*X.STOP_WORDS))
    counted = words.groupBy(id_col, "word").agg(F.count("*").alias("score"))
    order = Window.partitionBy(id_col).orderBy(F.desc("score"), F.desc(F.length("word")), "word")
    top = counted.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= keywords).select(id_col, "word", F.lit("KEYWORD").alias("type"), "score")
    names = F.regexp_extract_all(X.norm(F.col(text_col)), F.lit(NAMES), F.lit(1))
    named = docs.select(id_col, F.explode(names).alias("word")).groupBy(id_col, F.lower("word").alias("word")).agg(F.count("*").alias("score"))
    return top.unionByName(named.select(id_col, "word", F.lit("NER").alias("type"), "score"))


def _counted(listed: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Row, number of the word and count of each different word of each list, and the words by number."""
    coded = listed.flatten().dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    row, n = np.repeat(np.arange(len(listed)), pc.list_value_length(listed).fill_null(0).to_numpy(zero_copy_only=False)), max(1, len(coded.dictionary))
    found, many = np.unique(row * n + code, return_counts=True)
    return found // n, found % n, many, coded.dictionary


def _concepts(keywords: int):
    stop = pa.array(X.STOP_WORDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, TEXTS):
                batch = whole.slice(at, TEXTS)
                row, code, many, words = _counted(pc.split_pattern(batch.column("words"), " "))
                size, rank = pc.utf8_length(words).to_numpy(zero_copy_only=False), np.zeros(len(words), np.int64)
                can = (size > 2) & ~pc.is_in(words, value_set=stop).to_numpy(zero_copy_only=False)
                keep = np.flatnonzero(can[code])
                row, code, many = row[keep], code[keep], many[keep]
                rank[pc.sort_indices(words).to_numpy()] = np.arange(len(words))
                order = np.lexsort((rank[code], -size[code], -many, row))
                row, code, many = row[order], code[order], many[order]
                top = np.arange(len(row)) - np.searchsorted(row, row) < keywords
                for kind, (r, c, m, ws) in (("KEYWORD", (row[top], code[top], many[top], words)), ("NER", _counted(batch.column("names")))):
                    kinds = pa.array([kind] * len(r), pa.string())
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(r)), ws.take(pa.array(c)), kinds, pa.array(m, pa.int64())], [batch.schema.names[0], "word", "type", "score"])

    return run


def concepts_of_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keywords: int = KEYWORDS) -> DataFrame:
    """concepts() of texts whose ids are unique, found where the texts are: no word is shuffled. A text goes to Python as its words with spaces between them."""
    names = F.transform(F.regexp_extract_all(X.norm(F.col(text_col)), F.lit(NAMES), F.lit(1)), F.lower)
    words = F.regexp_replace(F.lower(X.norm(F.col(text_col))), X.NO_WORD, " ")
    rows = docs.select(id_col, words.alias("words"), names.alias("names"))
    return rows.mapInArrow(_concepts(keywords), f"`{id_col}` {dict(docs.dtypes)[id_col]}, word string, type string, score long")


def concept_node(word: str = "word", kind: str = "type") -> Column:
    return X.concept_id(F.col(kind), F.lit("x"), F.col(word))


def concept_edges(mentions: DataFrame, id_col: str = "doc_id", weight: float = 0.3) -> DataFrame:
    """Both directions between a chunk and each of its concepts."""
    out = mentions.select(F.col(id_col).cast("string").alias("chunk"), concept_node().alias("concept"), F.when(F.col("type") == "NER", "contains_ner").otherwise(CONCEPT).alias("kind")).distinct()
    there = out.select(F.col("chunk").alias("src"), F.col("concept").alias("dst"), F.lit(weight).alias("weight"), F.col("kind").alias("relation"))
    return there.unionByName(out.select(F.col("concept").alias("src"), F.col("chunk").alias("dst"), F.lit(weight).alias("weight"), F.lit(FOUND).alias("relation")))


def chunk_classes(mentions: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, node): chunks with equal sets of concepts stand as the one with the smallest id, so copies make no pairs."""
    sets = mentions.groupBy(id_col).agg(F.sha2(F.array_join(F.array_sort(F.collect_set(concept_node())), "\x01"), 256).alias("_set"))
    return sets.join(sets.groupBy("_set").agg(F.min(id_col).alias("node")), "_set").select(id_col, "node")


#: Chunks of a block at most; a cell holds two blocks. Rows of a block that are counted against the other at once. Concepts that more than one chunk in OFTEN of a block has are added as whole rows. Pairs of a batch.
BLOCK, AT_ONCE, OFTEN, PAIRS = 65536, 64, 128, 1 << 18


def _blocks(n: int, cores: int) -> int:
    """Blocks of n chunks: as few as hold them, but enough that every core gets several cells."""
    return max(1, -(-n // BLOCK), min(-(-n // 512), int((8 * cores) ** 0.5) + 1))


def _held(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of a cell, a few row numbers of one block at a time, those of the whole other block, and how many concepts each of the former has in common with each of the latter.

    What common concepts add is kept as whole rows, that of rare ones as places.
    """
    own, i, j = (table.column(c).to_numpy() for c in ("own", "i", "j"))
    left, right = np.flatnonzero(own == i[0]), np.flatnonzero(own == j[0])
    lists = table.column("cs").combine_chunks()
    flat, sizes = lists.flatten().to_numpy(), pc.list_value_length(lists).to_numpy()
    code = np.unique(flat, return_inverse=True)[1]
    starts = np.concatenate(([0], np.cumsum(sizes)))
    place = np.full(len(own), -1)
    place[right] = np.arange(len(right))
    holder = place[np.repeat(np.arange(len(own)), sizes)]
    inside = np.flatnonzero(holder >= 0)
    inside = inside[np.argsort(code[inside], kind="stable")]
    many = np.bincount(code[inside], minlength=code.max(initial=-1) + 1)
    ends, posts = np.concatenate(([0], np.cumsum(many))), holder[inside]
    kind = np.uint8 if sizes.max(initial=0) < 256 else np.int32
    common = np.flatnonzero(many > max(64, len(right) // OFTEN))
    whole = np.zeros((len(common), len(right)), kind)
    for row, c in zip(whole, common, strict=True):
        row[posts[ends[c] : ends[c + 1]]] = 1
    at_whole = np.full(len(many), -1)
    at_whole[common] = np.arange(len(common))
    for at in range(0, len(left), AT_ONCE):
        some = left[at : at + AT_ONCE]
        held = np.zeros((len(some), len(right)), kind)
        for row, x in zip(held, some, strict=True):
            for c in code[starts[x] : starts[x + 1]]:
                if at_whole[c] >= 0:
                    row += whole[at_whole[c]]
                elif many[c]:
                    # No chunk has a concept twice, so no place is named twice.
                    row[posts[ends[c] : ends[c + 1]]] += 1
        yield some, right, held


def counts(table: pa.Table, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of a cell, row numbers of pairs and the number of their common concepts, from `least` on, a few rows against a whole block at a time."""
    same = table.column("i")[0] == table.column("j")[0]
    for some, right, held in _held(table):
        at = np.flatnonzero(held >= least)
        p, q = np.divmod(at, max(1, len(right)))
        n, a, b = held.reshape(-1)[at].astype(np.int64), some[p], right[q]
        keep = a < b if same else slice(None)
        yield a[keep], b[keep], n[keep]


def count_sums(table: pa.Table, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of a cell, the sizes of those that have `least` concepts or more in common with it, summed, and the largest number in common (0 without any). Pairs are not listed."""
    n, size = table.num_rows, table.column("size").to_numpy()
    same = table.column("i")[0] == table.column("j")[0]
    apart, most, large = np.zeros(n, np.int64), np.zeros(n, np.int64), None
    for some, right, held in _held(table):
        if large is None:
            large = np.flatnonzero(size[right] > 1)
        if same:
            # Both blocks are one, so each row meets all others here and only its own sum is taken.
            held[np.arange(len(some)), np.searchsorted(right, some)] = 0
        linked = held >= least
        apart[some] += np.count_nonzero(linked, axis=1) + linked[:, large] @ (size[right[large]] - 1)
        most[some] = np.maximum(most[some], held.max(axis=1, initial=0))
        if not same:
            apart[right] += np.add.reduce(linked, axis=0, dtype=np.int64 if AT_ONCE > 255 else np.uint8)
            for row, more in zip(linked[size[some] > 1], size[some][size[some] > 1] - 1, strict=True):
                apart[right] += row * more
            most[right] = np.maximum(most[right], held.max(axis=0, initial=0))
    most[most < least] = 0
    return apart, most


def marked(rows: DataFrame, id_col: str, fresh: DataFrame | None) -> DataFrame:
    """rows with _new: whether they are in fresh(id); all are without it."""
    if fresh is None:
        return rows.withColumn("_new", F.lit(True))
    new = fresh.select(id_col).distinct().withColumn("_new", F.lit(True))
    return rows.join(new, id_col, "left").withColumn("_new", F.col("_new").isNotNull())


def deal(rows: DataFrame, id_col: str, blocks: tuple[int, int], *cols: str) -> DataFrame:
    """(id, cols, own, i, j): marked() rows dealt over cells of two blocks each, so that every pair meets in one cell and no table of pairs is shuffled. New rows have blocks of their own, and only cells with such a block are made."""
    first, rest = blocks
    hashed = F.xxhash64(id_col)
    own = F.when(F.col("_new"), F.pmod(hashed, F.lit(first))).otherwise(first + F.pmod(hashed, F.lit(max(1, rest)))).cast("int")
    dealt = rows.select(F.col(id_col).alias("id"), *cols, own.alias("own")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(first + rest - 1))))
    return dealt.select("id", *cols, "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).where(F.col("i") < first)


def in_cells(dealt: DataFrame, blocks: tuple[int, int], spread: int = 4):
    """dealt by cell, over some times as many tasks as there are cells, so that few of them get two."""
    first, rest = blocks
    cells = first * (first + 1) // 2 + first * rest
    return dealt.repartition(min(spread * cells, 4096), "i", "j").groupBy("i", "j")


def _cells(sets: DataFrame, id_col: str, fresh: DataFrame | None, *more: str):
    """sets(id_col, cs, more) in cells. With fresh(id_col) only pairs with a fresh chunk have one."""
    cores = sets.sparkSession.sparkContext.defaultParallelism
    rows = marked(sets.where(F.col(id_col).isNotNull()), id_col, fresh)
    sizes = dict(rows.groupBy("_new").agg(F.count("*")).collect())
    blocks = _blocks(sizes.get(True, 0), cores), _blocks(sizes[False], cores) if False in sizes else 0
    return in_cells(deal(rows, id_col, blocks, "cs", *more), blocks, 1)


def _sets(mentions: DataFrame, id_col: str, least: int) -> DataFrame:
    """(id, cs): the concepts of each chunk that has enough of them, as 64-bit hashes."""
    return mentions.groupBy(id_col).agg(F.collect_set(F.xxhash64(concept_node())).alias("cs")).where(F.size("cs") >= least)


def shared_edges(mentions: DataFrame, id_col: str = "doc_id", least: int = 2, fresh: DataFrame | None = None) -> DataFrame:
    """(a, b, shared, weight), a < b: chunks with at least two common concepts, weight max(0.1, 1 / (1 + shared)).

    Blocks of chunks are held against each other in a task each, so the rows that are shuffled grow with chunks x blocks, and pairs go straight into the result.
    With fresh(id) only pairs of which at least one is fresh are made.
    """
    kind = dict(mentions.dtypes)[id_col]

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        table = table.take(pc.sort_indices(table.column("id")))
        ids = table.column("id").combine_chunks()
        for x, y, n in counts(table, least):
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.minimum(x, y))), ids.take(pa.array(np.maximum(x, y))), pa.array(n, pa.int64())], ["a", "b", "shared"])

    pairs.__annotations__ = {"batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    found = _cells(_sets(mentions, id_col, least), id_col, fresh).applyInArrow(pairs, f"a {kind}, b {kind}, shared long")
    return found.withColumn("weight", F.greatest(F.lit(0.1), 1.0 / (1 + F.col("shared"))))


def shared_ways(mentions: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(src, dst, weight, relation): shared_edges() both ways, with names of nodes. A task writes the ways of a few chunks one after the other, so that one end stays the same from row to row and is stored in few bytes."""

    def ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        table = table.take(pc.sort_indices(table.column("id")))
        names = pc.cast(table.column("id").combine_chunks(), pa.string())
        for x, y, n in counts(table, 2):
            weight = np.maximum(0.1, 1.0 / (1 + n))
            for at in range(0, len(x), PAIRS):
                a, b, w = names.take(pa.array(x[at : at + PAIRS])), names.take(pa.array(y[at : at + PAIRS])), pa.array(weight[at : at + PAIRS])
                yield pa.RecordBatch.from_arrays([a, b, w], ["src", "dst", "weight"])
                yield pa.RecordBatch.from_arrays([b, a, w], ["src", "dst", "weight"])

    ways.__annotations__ = {"batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    found = _cells(_sets(mentions, id_col, 2), id_col, None).applyInArrow(ways, "src string, dst string, weight double")
    return found.withColumn("relation", F.lit(SHARED))


def shared_counts(mentions: DataFrame, sizes: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(node, apart, far): of each chunk, the sizes(node, size) of those that share two concepts or more with it, summed, and the smallest weight. Pairs are counted where they meet and never become rows."""
    kind = dict(mentions.dtypes)[id_col]

    def sums(table: pa.Table) -> pa.Table:
        apart, most = count_sums(table, 2)
        return pa.table({"node": table.column("id"), "apart": apart, "most": most}).filter(pa.array(most > 0))

    sets = _sets(mentions, id_col, 2).join(sizes.select(F.col("node").alias(id_col), "size"), id_col)
    found = _cells(sets, id_col, None, "size").applyInArrow(sums, f"node {kind}, apart long, most long")
    return found.groupBy("node").agg(F.sum("apart").alias("apart"), F.greatest(F.lit(0.1), 1.0 / (1 + F.max("most"))).alias("far"))


def chunk_degrees(mentions: DataFrame, heads: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, partners, nearest): chunks that share two concepts or more with each chunk, and the smallest weight among these, members of classes counted and not listed.

    A chunk's partners are all members of the classes its own class is linked with, and the other members of its own class.
    """
    members = chunk_classes(mentions, id_col)
    concepts = mentions.select(id_col, concept_node().alias("c")).distinct().groupBy(F.col(id_col).alias("node")).agg(F.count("*").alias("held"))
    sizes = members.groupBy("node").agg(F.count("*").alias("size")).join(concepts, "node")
    apart = shared_counts(heads, sizes, id_col)
    alike = (F.col("size") > 1) & (F.col("held") >= 2)
    found = sizes.join(apart, "node", "left").select(
        "node", (F.coalesce("apart", F.lit(0)) + F.when(alike, F.col("size") - 1).otherwise(0)).alias("partners"),
        F.least("far", F.when(alike, F.greatest(F.lit(0.1), 1.0 / (1 + F.col("held"))))).alias("nearest"),
    )
    return members.join(found, "node").select(id_col, "partners", "nearest")


def both_ways(pairs: DataFrame, relation: str) -> DataFrame:
    """Directed edges of undirected pairs(a, b, weight)."""
    a, b = F.col("a").cast("string"), F.col("b").cast("string")
    ends = F.explode(F.array(F.struct(a.alias("src"), b.alias("dst")), F.struct(b.alias("src"), a.alias("dst")))).alias("e")
    return pairs.select(ends, "weight").select("e.src", "e.dst", "weight", F.lit(relation).alias("relation"))


def merge_edges(edges: DataFrame) -> DataFrame:
    """One edge for each ordered pair: the smallest weight and its relation."""
    return edges.groupBy("src", "dst").agg(F.min(F.struct("weight", "relation")).alias("e")).select("src", "dst", "e.weight", "e.relation")


def semantic_weights(mentions: DataFrame, chunk_vectors: DataFrame, concept_vectors: DataFrame, cosine, id_col: str = "doc_id") -> DataFrame:
    """(concept, semantic_weight, edge_weight): mean cosine to the chunks of a concept; above 0.3 the edge becomes 0.3 (1 - weight / 2)."""
    pairs = mentions.select(id_col, concept_node().alias("concept"), "word").distinct().join(chunk_vectors, id_col).join(concept_vectors, "word")
    mean = pairs.groupBy("concept").agg(F.avg(cosine(F.col("embedding"), F.col("concept_embedding"))).alias("semantic_weight"))
    return mean.withColumn("edge_weight", F.when(F.col("semantic_weight") > 0.3, 0.3 * (1 - 0.5 * F.col("semantic_weight"))).otherwise(F.lit(0.3)))


def edge_cutoff(edges: DataFrame, top_p: float) -> DataFrame:
    """The edges whose weight does not exceed the percentile of top_p, clamped to 0.1..1."""
    p = min(1.0, max(0.1, top_p))
    return edges.crossJoin(F.broadcast(edges.agg(F.percentile("weight", F.lit(p)).alias("cutoff")))).where(F.col("weight") <= F.col("cutoff"))


def degree_centrality(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, degree, centrality): in and out degree, over the number of other nodes; isolated nodes have 0."""
    ends = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).groupBy("node").agg(F.count("*").alias("degree"))
    n = F.broadcast(nodes.agg(F.greatest(F.lit(1), F.count("*") - 1).alias("_others")))
    out = nodes.select("node").join(ends, "node", "left").withColumn("degree", F.coalesce("degree", F.lit(0))).crossJoin(n)
    return out.withColumn("centrality", F.col("degree") / F.col("_others")).drop("_others")


def top_central(centrality: DataFrame, share: float, bins: int = 4096) -> DataFrame:
    """The max(1, share of all) most central nodes, ties by name.

    Nodes are counted by ranges of centrality: ranges above the last that is wanted are taken whole, and only the nodes of that one are put in order.
    """
    rows = centrality.withColumn("_c", F.round("centrality", 8))
    n, low, high = rows.agg(F.count("*"), F.min("_c"), F.max("_c")).first()
    if not n:
        return centrality
    wide = (high - low) or 1.0
    rows = rows.withColumn("_bin", F.least(F.lit(bins - 1), F.floor((F.col("_c") - F.lit(low)) / F.lit(wide) * F.lit(bins))).cast("int"))
    sizes, wanted, last = dict(rows.groupBy("_bin").agg(F.count("*")).collect()), max(1, int(n * share)), bins
    while wanted > 0:
        last -= 1
        wanted -= sizes.get(last, 0)
    inside = rows.where(F.col("_bin") == last)
    edge = inside.orderBy(F.desc("_c"), "node").limit(sizes[last] + wanted)
    return rows.where(F.col("_bin") > last).unionByName(edge).drop("_c", "_bin")


def neighbours(edges: DataFrame, seeds: DataFrame, part: list[str], k: int, most: float | None = None) -> DataFrame:
    """(part, node, weight, rank): the k nearest nodes of each part's seeds(part, node) that are no seeds themselves."""
    near = edges if most is None else edges.where(F.col("weight") <= most)
    found = seeds.withColumnRenamed("node", "src").join(near, "src").groupBy(*part, F.col("dst").alias("node")).agg(F.min("weight").alias("weight"))
    fresh = found.join(seeds, [*part, "node"], "left_anti")
    return fresh.withColumn("rank", F.row_number().over(Window.partitionBy(*part).orderBy(F.round("weight", 8), "node"))).where(F.col("rank") <= k)


#: Parts that stand side by side as columns, and numbers of a table that may go to all tasks.
WIDE, SPREAD = 64, 8 << 20


def _parts(sources: DataFrame, part: list[str]) -> list | None:
    """The parts, if they are few and none is null: their values then stand side by side in one row a node, so an edge is taken once a round and not once a part."""
    found = sources.select(*part).distinct().limit(WIDE + 1).collect()
    return None if not found or len(found) > WIDE or any(x is None for r in found for x in r) else sorted(found)


def _side_by_side(rows: DataFrame, part: list[str], parts: list, value: Column) -> DataFrame:
    """(node, v0, v1, ...): the value of each part, null where it has none."""
    own = lambda r: reduce(and_, [F.col(c) == F.lit(x) for c, x in zip(part, r, strict=True)])
    return rows.groupBy("node").agg(*[F.max(F.when(own(r), value)).alias(f"v{i}") for i, r in enumerate(parts)])


def _one_below_other(rows: DataFrame, part: list[str], parts: list, numbers: list[int], name: str) -> DataFrame:
    """(part, node, name): the values of these parts as rows."""
    kinds = [F.struct(*[F.lit(x).alias(c) for c, x in zip(part, parts[i], strict=True)], F.col(f"v{i}").alias(name)) for i in numbers]
    return rows.select("node", F.explode(F.array(*kinds)).alias("e")).select(*[F.col(f"e.{c}") for c in part], "node", F.col(f"e.{name}")).where(F.col(name).isNotNull())


def _kinds(found: DataFrame, sources: DataFrame, part: list[str]) -> DataFrame:
    kinds = dict(sources.dtypes)
    return found.withColumns({c: F.col(c).cast(kinds[c]) for c in part})


def _given(rows: DataFrame, width: int) -> DataFrame:
    """rows for all tasks, if they are few enough; else they are dealt by node."""
    return F.broadcast(rows) if rows.count() * width <= SPREAD else rows


#: Edges that are put into lists at once, and numbers to the unit of weights of 6 digits.
PACKED, MICRO = 1 << 21, 1e6


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists of sources and weights by target; weights of 6 digits as whole millionths, others as they are."""

    def lists(some: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(some).sort_by([("dst", "ascending"), ("src", "ascending")]).combine_chunks()
        src, dst, weight = (table.column(c).combine_chunks() for c in ("src", "dst", "weight"))
        runs = pc.run_end_encode(dst)
        ends = np.concatenate(([0], runs.run_ends.to_numpy())).astype(np.int32)
        w = weight.to_numpy(zero_copy_only=False)
        micro = np.round(w * MICRO)
        fits = (np.abs(micro) < 2**31) & (micro / MICRO == w)
        whole = np.logical_and.reduceat(fits, ends[:-1])
        micro = pa.ListArray.from_arrays(ends, pa.array(np.where(fits, micro, 0).astype(np.int32)))
        exact = pa.ListArray.from_arrays(ends, weight)
        none = lambda x: pa.scalar(None, x.type)
        mask = pa.array(whole)
        return pa.RecordBatch.from_arrays([runs.values, pa.ListArray.from_arrays(ends, src), pc.if_else(mask, micro, none(micro)), pc.if_else(mask, none(exact), exact)], ["dst", "srcs", "micro", "exact"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        held += [batch] if batch.num_rows else []
        if sum(x.num_rows for x in held) >= PACKED:
            yield lists(held)
            held = []
    if held:
        yield lists(held)


def by_target(edges: DataFrame) -> DataFrame:
    """edges(src, dst, weight) stored by dst, so that a task meets all edges into its nodes and adds them up before anything is shuffled.

    They are dealt and stored as lists by target, so an edge takes some bytes and not a row; targets(result) names those that have any. Edges that are stored so already are taken as they are.
    """
    if hasattr(edges, "lists"):
        return edges
    kinds = dict(edges.dtypes)
    dealt = edges.select("src", "dst", F.col("weight").cast("double")).mapInArrow(_packed, f"dst {kinds['dst']}, srcs array<{kinds['src']}>, micro array<int>, exact array<double>")
    lists = store(dealt.repartition("dst").sortWithinPartitions("dst"), "edges-in")
    weights = F.coalesce("exact", F.transform("micro", lambda m: m / F.lit(MICRO)))
    found = lists.select("dst", F.inline(F.arrays_zip(F.col("srcs").alias("src"), weights.alias("weight")))).select("src", "dst", "weight")
    found.lists = lists
    return found


def targets(edges: DataFrame) -> DataFrame:
    return (edges.lists if hasattr(edges, "lists") else edges).select(F.col("dst").alias("node")).distinct()


def distances(edges: DataFrame, sources: DataFrame, part: list[str], cutoff: float = 4.0) -> DataFrame:
    """(part, node, distance) within the cutoff of each part's sources(part, node), 0 at the sources.

    Only nodes that came nearer in one round are relaxed in the next, until none does; each round is stored.
    """
    parts = _parts(sources, part)
    if parts is None:
        return _distances(edges, sources, part, cutoff)
    last, n = store(_side_by_side(sources, part, parts, F.lit(0.0)), "distances"), range(len(parts))
    flow = by_target(edges)
    best, front = last, last
    while True:
        step = _given(front.withColumnRenamed("node", "src"), len(parts)).join(flow, "src").select(F.col("dst").alias("node"), *[F.when(F.col(f"v{i}") + F.col("weight") <= cutoff, F.col(f"v{i}") + F.col("weight")).alias(f"v{i}") for i in n], *[F.lit(None).cast("double").alias(f"b{i}") for i in n])
        both = step.unionByName(best.select("node", *[F.lit(None).cast("double").alias(f"v{i}") for i in n], *[F.col(f"v{i}").alias(f"b{i}") for i in n]))
        both = both.groupBy("node").agg(*[F.min(f"v{i}").alias(f"v{i}") for i in n], *[F.min(f"b{i}").alias(f"b{i}") for i in n])
        moved = lambda i: F.col(f"v{i}") < F.coalesce(f"b{i}", F.lit(float("inf"))) - 1e-12
        both = store(both.select("node", *[F.least(f"v{i}", f"b{i}").alias(f"v{i}") for i in n], *[F.coalesce(moved(i), F.lit(False)).alias(f"m{i}") for i in n]), "distances", last)
        best, last = both.select("node", *[f"v{i}" for i in n]), both
        front = both.where(F.greatest(*[F.col(f"m{i}") for i in n], F.lit(False))).select("node", *[F.when(F.col(f"m{i}"), F.col(f"v{i}")).alias(f"v{i}") for i in n])
        if front.isEmpty():
            return _kinds(_one_below_other(best, part, parts, list(n), "distance"), sources, part)


def _distances(edges: DataFrame, sources: DataFrame, part: list[str], cutoff: float) -> DataFrame:
    """The same for any number of parts, a row for each part and node."""
    best = store(sources.select(*part, "node").distinct().withColumn("distance", F.lit(0.0)), "distances")
    front = last = best
    while True:
        step = front.withColumnRenamed("node", "src").join(edges.select("src", "dst", "weight"), "src").groupBy(*part, F.col("dst").alias("node")).agg(F.min(F.col("distance") + F.col("weight")).alias("near"))
        step = step.where(F.col("near") <= cutoff)
        merged = best.join(step, [*part, "node"], "full").select(*part, "node", F.least("distance", "near").alias("distance"), (F.col("near") < F.coalesce("distance", F.lit(float("inf"))) - 1e-12).alias("moved"))
        merged = store(merged, "distances", last)
        best, front = merged.drop("moved"), merged.where("moved").drop("moved")
        last = merged
        if front.isEmpty():
            return best


def normalized_distances(found: DataFrame, part: list[str], unreachable: float = 900.0) -> DataFrame:
    """Distances of each part scaled to 0..1 by smallest and largest; unreachable ones become 0.8, equal ones 0."""
    reach = F.when(F.col("distance") < unreachable, F.col("distance"))
    w = Window.partitionBy(*part)
    low, high = F.min(reach).over(w), F.max(reach).over(w)
    return found.withColumn("normalized", F.when(reach.isNull(), 0.8).when(high > low, (F.col("distance") - low) / (high - low)).otherwise(F.lit(0.0)))


def pagerank(edges: DataFrame, sources: DataFrame, part: list[str], rounds: int = 20, damping: float = 0.85, strength: str = "distance") -> DataFrame:
    """(part, node, ppr): personalised PageRank over the sources of each part, a fixed number of rounds.

    Edge weights are used as they are (strength 'distance') or inverted ('inverse'). What dead ends hold goes back to the sources.
    """
    parts = _parts(sources, part)
    if parts is not None:
        rank = None
        for _, rank in _wide_rounds(edges, sources, part, parts, rounds, damping, strength):
            pass
        if rank is not None:
            return _kinds(_one_below_other(rank, part, parts, list(range(len(parts))), "ppr"), sources, part)
    flow, start, ends = _rank_tables(edges, sources, part, strength)
    rank, last = start.select(*part, "node", F.col("base").alias("ppr")), None
    for i in range(rounds):
        rank = _rank_round(rank, flow, start, ends, part, damping)
        if i % 4 == 3 or i == rounds - 1:
            rank = last = store(rank, "ranks", *([last] if last is not None else []))
    return rank


def _rank_tables(edges: DataFrame, sources: DataFrame, part: list[str], strength: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Shares of what flows over each edge, what each source starts with, and nodes that pass something on."""
    force = F.col("weight") if strength == "distance" else 1.0 / F.greatest("weight", F.lit(1e-6))
    weighed = edges.select("src", "dst", force.alias("f"))
    out = weighed.groupBy("src").agg(F.sum("f").alias("all")).where("all > 0")
    flow = store(weighed.join(out, "src").select("src", "dst", (F.col("f") / F.col("all")).alias("p")).where("p > 0"), "rank-flow")
    start = sources.select(*part, "node").distinct().withColumn("base", 1.0 / F.count("*").over(Window.partitionBy(*part)))
    return flow, store(start, "rank-start"), flow.select(F.col("src").alias("node")).distinct()


def _rank_round(rank: DataFrame, flow: DataFrame, start: DataFrame, ends: DataFrame, part: list[str], damping: float) -> DataFrame:
    moved = rank.join(flow.withColumnRenamed("src", "node"), "node").groupBy(*part, F.col("dst").alias("node")).agg(F.sum(F.col("ppr") * F.col("p")).alias("in"))
    lost = rank.join(ends, "node", "left_anti").groupBy(*part).agg(F.sum("ppr").alias("lost"))
    back = start.join(lost, part, "left").select(*part, "node", (F.col("base") * ((1 - damping) + damping * F.coalesce("lost", F.lit(0.0)))).alias("ppr"))
    return moved.select(*part, "node", (damping * F.col("in")).alias("ppr")).unionByName(back).groupBy(*part, "node").agg(F.sum("ppr").alias("ppr"))


def pagerank_converged(edges: DataFrame, sources: DataFrame, part: list[str], most: int = 50, tolerance: float = 1e-4, damping: float = 0.85, strength: str = "distance") -> DataFrame:
    """(part, node, ppr, rounds): personalised PageRank, each part until its ranks move by less than tolerance in sum, after `most` rounds at the latest.

    Every round is stored with the ranks before it, so the movement is summed on the executors; parts that have come to rest take no part in later rounds, and the driver only asks whether any is left.
    """
    parts = _parts(sources, part)
    if parts is not None and most > 0:
        done, open_ = None, list(range(len(parts)))
        for i, rank in _wide_rounds(edges, sources, part, parts, most, damping, strength, open_):
            far = rank.agg(*[F.sum(F.abs(F.coalesce(f"v{k}", F.lit(0.0)) - F.coalesce(f"b{k}", F.lit(0.0)))).alias(f"v{k}") for k in open_]).first()
            rest = [k for k in open_ if i == most or not (far[f"v{k}"] or 0.0) >= tolerance]
            if rest:
                here = store(_kinds(_one_below_other(rank, part, parts, rest, "ppr"), sources, part).withColumn("rounds", F.lit(i)), "ranks-done")
                done = here if done is None else done.unionByName(here)
            open_[:] = [k for k in open_ if k not in rest]
        return done
    flow, start, ends = _rank_tables(edges, sources, part, strength)
    now, done = start.select(*part, "node", F.col("base").alias("ppr")), None
    for i in range(1, most + 1):
        step = _rank_round(now, flow, start.join(now.select(*part).distinct(), part, "left_semi"), ends, part, damping)
        both = store(step.join(now.withColumnRenamed("ppr", "before"), [*part, "node"], "full"), "ranks")
        moved = both.groupBy(*part).agg(F.sum(F.abs(F.coalesce("ppr", F.lit(0.0)) - F.coalesce("before", F.lit(0.0)))).alias("moved"))
        open_ = store(moved.where(F.col("moved") >= tolerance).select(*part), "ranks-open")
        rank = both.where("ppr IS NOT NULL").select(*part, "node", "ppr")
        rest = rank if i == most else rank.join(open_, part, "left_anti")
        rest = rest.withColumn("rounds", F.lit(i))
        done = rest if done is None else done.unionByName(rest)
        if open_.isEmpty():
            break
        now = rank.join(open_, part, "left_semi")
    return store(done, "ranks-done")


def _wide_rounds(edges: DataFrame, sources: DataFrame, part: list[str], parts: list, most: int, damping: float, strength: str, open_: list[int] | None = None) -> Iterator[tuple[int, DataFrame]]:
    """The number of each round and its stored (node, v0, b0, v1, b1, ...): ranks of each part and those before, for the parts in open_, which may lose some after every round; ends when none is left."""
    open_ = list(range(len(parts))) if open_ is None else open_
    force = F.col("weight") if strength == "distance" else 1.0 / F.greatest("weight", F.lit(1e-6))
    flow = by_target(edges).select("src", "dst", force.alias("f"))
    out = store(flow.groupBy("src").agg(F.sum("f").alias("all")).where("all > 0"), "rank-out")
    flow = flow.where("f > 0")
    ends = store(out.select(F.col("src").alias("node")), "rank-ends")
    base = sources.select(*part, "node").distinct().withColumn("base", 1.0 / F.count("*").over(Window.partitionBy(*part)))
    start = store(_side_by_side(base, part, parts, F.col("base")), "rank-start")
    rank, last, out = start, None, _given(out, 2)
    for i in range(1, most + 1):
        names, none = list(open_), lambda c, k: F.lit(None).cast("double").alias(f"{c}{k}")
        # What a node passes on over each unit of weight.
        shares = rank.withColumnRenamed("node", "src").join(out, "src").select("src", *[(damping * F.col(f"v{k}") / F.col("all")).alias(f"v{k}") for k in names])
        shares = F.broadcast(shares) if rank.count() * len(names) <= SPREAD else shares
        moved = shares.join(flow, "src").select(F.col("dst").alias("node"), *[(F.col(f"v{k}") * F.col("f")).alias(f"v{k}") for k in names], *[none("b", k) for k in names])
        lost = rank.join(ends, "node", "left_anti").agg(*[F.coalesce(F.sum(f"v{k}"), F.lit(0.0)).alias(f"l{k}") for k in names])
        back = start.join(F.broadcast(lost), F.lit(True)).select("node", *[(F.col(f"v{k}") * ((1 - damping) + damping * F.col(f"l{k}"))).alias(f"v{k}") for k in names], *[none("b", k) for k in names])
        before = rank.select("node", *[none("v", k) for k in names], *[F.col(f"v{k}").alias(f"b{k}") for k in names])
        both = moved.unionByName(back).unionByName(before).groupBy("node").agg(*[F.sum(f"{c}{k}").alias(f"{c}{k}") for k in names for c in "vb"])
        rank = last = store(both, "ranks", *([last] if last is not None else []))
        yield i, rank
        if not open_:
            return


def blended(found: DataFrame, ranks: DataFrame, part: list[str]) -> DataFrame:
    """(part, node, graph_distance): 0.7 x normalised distance (0.8 where missing) + 0.3 x (1 - rank / largest rank)."""
    scaled = ranks.withColumn("ppr", F.coalesce(F.col("ppr") / F.max("ppr").over(Window.partitionBy(*part)), F.lit(0.0)))
    both = found.select(*part, "node", "normalized").join(scaled.select(*part, "node", "ppr"), [*part, "node"], "full")
    return both.select(*part, "node", (0.7 * F.coalesce("normalized", F.lit(0.8)) + 0.3 * (1 - F.coalesce("ppr", F.lit(0.0)))).alias("graph_distance"))


def statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes and edges, chunks, concepts by type, mean degree (in and out). edges has total_edges, or a row for each edge."""
    n = nodes.agg(F.count("*").alias("total_nodes"), F.count_if(F.col("kind") == "chunk").alias("chunks"), F.count_if(F.col("kind") == "KEYWORD").alias("keywords"), F.count_if(F.col("kind") == "NER").alias("entities"))
    total = edges if edges.columns == ["total_edges"] else edges.agg(F.count("*").alias("total_edges"))
    return n.join(F.broadcast(total), F.lit(True)).withColumn("average_degree", 2.0 * F.col("total_edges") / F.greatest(F.lit(1), F.col("total_nodes")))


def update(old_mentions: DataFrame, new_mentions: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Shared edges that new chunks add: pairs of which at least one chunk is new; together with the old ones they equal a full build."""
    fresh = new_mentions.join(old_mentions.select(id_col).distinct(), id_col, "left_anti")
    return shared_edges(old_mentions.unionByName(fresh), id_col, fresh=fresh).select("a", "b", "shared", "weight")


def labelled(nodes: DataFrame) -> DataFrame:
    """Nodes with a label of 50 characters."""
    return nodes.withColumn("label", F.substring(F.coalesce("text", "word", F.lit("")), 1, 50))


def export(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes with a label of 50 characters, and edges whose ends both exist."""
    ends = nodes.select("node")
    kept = edges.join(ends.withColumnRenamed("node", "src"), "src", "left_semi").join(ends.withColumnRenamed("node", "dst"), "dst", "left_semi")
    return labelled(nodes), kept


def expand(candidates: DataFrame, edges: DataFrame, queries: DataFrame, vectors: DataFrame, part: str, cosine, k: int = 5, gate: bool = True, id_col: str = "vec_id") -> DataFrame:
    """(part, id, weight, similarity): graph neighbours of each query's candidates(part, id, similarity_score).

    With the gate only those whose similarity to the query reaches 0.4 of the best candidate's, 0.1 at least, are kept.
    queries(part, q) and vectors(id, embedding) give the vectors.
    """
    seeds = candidates.select(part, F.col(id_col).alias("node"))
    best = candidates.groupBy(part).agg(F.max(F.coalesce("similarity_score", F.lit(0.0))).alias("_best"))
    found = neighbours(edges, seeds, [part], k).withColumnRenamed("node", id_col).join(vectors.select(id_col, "embedding"), id_col).join(queries.select(part, "q"), part).join(best, part)
    out = found.withColumn("similarity", F.round(cosine(F.col("q"), F.col("embedding")), 6))
    kept = out.where(F.col("similarity") >= F.greatest(F.lit(0.1), 0.4 * F.col("_best"))) if gate else out
    return kept.select(part, id_col, "weight", "similarity")


def match_concepts(asked: DataFrame, concept_words: DataFrame, search, part: str, least: float = 0.55) -> DataFrame:
    """(part, word, concept, kind): concepts that a query names; words that are none get the most similar one from `least` on.

    asked(part, word); concept_words(word). search(words, concepts) ranks concepts by similarity: (word, concept, similarity_score), one a word.
    """
    exact = asked.join(concept_words, "word", "left_semi").select(part, "word", F.col("word").alias("concept"), F.lit("exact").alias("kind"))
    rest = asked.join(concept_words, "word", "left_anti")
    near = search(rest.select("word").distinct(), concept_words).where(F.col("similarity_score") >= least)
    return exact.unionByName(rest.join(near, "word").select(part, "word", "concept", F.lit("fuzzy").alias("kind"))).distinct()
