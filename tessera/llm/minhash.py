"""Near-duplicate classes by a signature-coordinate inverted join.

Each text's set of five-word shingles gets a MinHash signature of K coordinates. Two sets of similarity 0.75 agree on
three coordinates in four, so pairs with fewer than MATCHES equal coordinates are
dropped; whoever has that many must agree on one of the first K - MATCHES + 1 (the prefix), so
texts are posted under these coordinate-value pairs only. Equal sets are merged beforehand. Posting lists are merged in two steps:

1. every list links its members to its smallest one (a row a member, not a row a pair); collisions are counted,
   candidates are confirmed on the full sets, and components are formed. Lists that still hold several components do
   the same once more with another member of their own in the middle;
2. pairs already in one component are skipped; the others of a list are dealt by the sizes of their sets, since sets of
   similarity 0.75 differ in size by a third at most, and counted in blocks of bounded rows and bytes,
   each pair in the list of its first common coordinate only. Those that reach MATCHES are confirmed within the
   block. Pairs never become rows: a block passes on no more links than join its texts.

Signatures are made of 64-bit hashes of shingles; links are confirmed on the words themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import kernels
from tessera.llm.common import discard, pieces, store
from tessera.llm.graph import components

#: Coordinates of a signature; equal ones that make a pair a candidate: a pair of similarity 0.75 falls short with probability 0.0003.
K, MATCHES = 64, 36
PREFIX = K - MATCHES + 1
#: Members of a posting list, and bytes of their texts, in one block of step 2.
BLOCK, BLOCK_BYTES = 2048, 32 << 20


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seeds = kernels.minhash_seeds(K)
    for batch in pieces(batches):
        n, digests, sigs = [], [], []
        for text in batch.column("text"):
            shingles = kernels.shingle_set(text.as_py())
            n.append(len(shingles))
            digests.append(kernels.set_digest(shingles) if len(shingles) else None)
            sigs.append(kernels.minhash(shingles, seeds).tobytes() if len(shingles) else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("alt"), batch.column("bytes"), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(sigs, pa.binary())], ["id", "alt", "bytes", "n", "cls", "sig"]
        )


def _similar(a: set, b: set, least: int) -> bool:
    same = len(a & b)
    return same > 0 and 100 * same >= least * (len(a) + len(b) - same)


def _matching(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates whose signatures agree on MATCHES coordinates."""
    for batch in batches:
        left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint32).reshape(-1, K) for c in ("sig_a", "sig_b"))
        keep = pa.array((left == right).sum(axis=1) >= MATCHES)
        yield batch.select(["a", "b"]).filter(keep)


def _own_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose text is of the class: two rows may have one id, and the digest tells which is meant."""
    for batch in pieces(batches):
        last: tuple = (None, None)
        keep = []
        for cls, text in zip(batch.column("cls"), batch.column("text"), strict=True):
            if last[0] != (text := text.as_py()):
                shingles = kernels.shingle_set(text)
                last = (text, kernels.set_digest(shingles) if len(shingles) else None)
            keep.append(cls.as_py() == last[1])
        yield batch.filter(pa.array(keep, pa.bool_()))


def _confirm(least: int):
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, None)
        for batch in batches:
            keep = []
            for text_a, text_b in zip(batch.column("text_a"), batch.column("text_b"), strict=True):
                if last[0] != (text := text_a.as_py()):
                    last = (text, kernels.exact_shingles(text))
                keep.append(_similar(last[1], kernels.exact_shingles(text_b.as_py()), least))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return confirm


def _block_pairs(rows: dict[str, list]) -> Iterator[tuple[int, np.ndarray]]:
    """(i, others) of one block: pairs of different components that agree on MATCHES coordinates and first on this one.

    Of rows that came from the next level of sizes (upper) no two are compared: their own level does that.
    """
    sigs = np.frombuffer(b"".join(rows["sig"]), dtype=np.uint32).reshape(-1, K)
    label = np.unique(np.array([x.hex() for x in rows["label"]]), return_inverse=True)[1]
    block, at, first, second = np.array(rows["block"]), rows["at"][0], rows["first"][0], rows["second"][0]
    upper = np.array(rows["upper"])
    left, right = np.flatnonzero(block == first), np.flatnonzero(block == second)
    for i in left:
        others = right[right > i] if first == second else right
        others = others[(label[others] != label[i]) & ~(upper[others] & upper[i])]
        if len(others):
            same = sigs[others] == sigs[i]
            good = others[(same.sum(axis=1) >= MATCHES) & ~same[:, :at].any(axis=1)]
            if len(good):
                yield i, good


_BLOCK_KEY = ["key", "level", "first", "second"]
_BLOCK_ROW = [*_BLOCK_KEY, "block", "at", "upper", "cls", "label", "sig"]


def _open_rows(rows: dict[str, list], schema: pa.Schema) -> pa.RecordBatch | None:
    """The rows of a block that are in some pair."""
    hit = sorted({int(x) for i, good in _block_pairs(rows) for x in (i, *good)})
    return pa.RecordBatch.from_arrays([pa.array([rows[c][x] for x in hit], schema.field(c).type) for c in _BLOCK_ROW], _BLOCK_ROW) if hit else None


def _links_of(least: int):
    """Links within a block, as many as join its texts and no more: a pair that links before it have joined is skipped."""

    def links(rows: dict[str, list], schema: pa.Schema) -> pa.RecordBatch | None:
        sets: dict[int, set] = {}
        group = list(range(len(rows["cls"])))
        a, b = [], []

        def of(x: int) -> set:
            if x not in sets:
                sets[x] = kernels.exact_shingles(rows["text"][x])
            return sets[x]

        def root(x: int) -> int:
            while group[x] != x:
                group[x] = x = group[group[x]]
            return x

        for i, good in _block_pairs(rows):
            for j in map(int, good):
                if root(int(i)) != root(j) and _similar(of(int(i)), of(j), least):
                    group[root(j)] = root(int(i))
                    a.append(rows["cls"][i])
                    b.append(rows["cls"][j])
        return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"]) if a else None

    return links


def _by_block(names: list[str], handle):
    """Rows come sorted by block; a block is complete once the next one begins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_rows, key, schema = None, None, None

        def done():
            if open_rows is not None and len(open_rows["cls"]) > 1 and (made := handle(open_rows, schema)) is not None:
                yield made

        for batch in batches:
            schema, columns = batch.schema, {c: batch.column(c).to_pylist() for c in names}
            keys = list(zip(*(columns[c] for c in _BLOCK_KEY), strict=True))
            start = 0
            for i in range(len(keys) + 1):
                if i == len(keys) or keys[i] != key:
                    if open_rows is not None and i > start:
                        for c in names:
                            open_rows[c] += columns[c][start:i]
                    if i < len(keys):
                        yield from done()
                        key, open_rows, start = keys[i], {c: [] for c in names}, i
        yield from done()

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_percent: int = 75) -> DataFrame:
    """(id_col, n_shingles, component_id, kept) for every row of docs.

    Words are runs of bytes other than ASCII white space, A-Z lower-cased. Texts with 100 x intersection >= least_percent x union
    of their shingle sets are linked; component_id is the smallest id that links reach. A null or empty text has no shingles and is linked with
    nothing, so its component is itself. Equal ids with different texts count as different documents; a row with null id links others like
    any row but never names a component that has ids, and names none (null) that has no others. Texts of any length are taken whole;
    a signature has the same size for all. Repeated rows get one row each. Columns of docs other than the two named play no part. An empty table gives no rows.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    texts = texts.withColumn("alt", F.when(F.col("id").isNull(), F.xxhash64("text")))
    id_type = dict(texts.dtypes)["id"]
    sized = texts.withColumn("bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    sets = store(sized.mapInArrow(_signatures, f"id {id_type}, alt long, bytes long, n long, cls binary, sig binary"), "mh-sets")
    heads = [F.min("id").alias("rep"), F.min("alt").alias("alt"), F.max("bytes").alias("bytes"), F.max("n").alias("n"), F.first("sig").alias("sig")]
    classes = store(sets.where("cls is not null").groupBy("cls").agg(*heads), "mh-classes")

    posts = classes.select("cls", F.expr(f"posexplode(transform(sequence(0, {PREFIX - 1}), i -> xxhash64(i, substring(sig, i * 4 + 1, 4))))").alias("at", "key"))
    lists = posts.groupBy("key").agg(F.min("cls").alias("head"), F.count("*").alias("size")).where("size > 1")
    posts = store(posts.join(lists, "key"), "mh-posts")

    # A class is found by its smallest id, or by a hash of its text if no row of it has an id.
    place = lambda name, alt: F.coalesce(F.col(name).cast("string"), F.concat(F.lit("?"), F.col(alt).cast("string")))
    places = texts.select(place("id", "alt").alias("place"), "text")

    def class_texts(wanted: DataFrame) -> DataFrame:
        """(cls, text): one text of each class, however many rows have it or its id."""
        found = wanted.distinct().join(classes.select("cls", place("rep", "alt").alias("place")), "cls").join(places, "place")
        return store(found.select("cls", "text").mapInArrow(_own_texts, "cls binary, text binary").groupBy("cls").agg(F.first("text").alias("text")), "mh-texts")

    def candidates(pairs: DataFrame) -> DataFrame:
        """Pairs of classes that agree on MATCHES coordinates."""
        for side in "ab":
            pairs = pairs.join(classes.select(F.col("cls").alias(side), F.col("sig").alias(f"sig_{side}")), side)
        return store(pairs.select("a", "b", "sig_a", "sig_b").mapInArrow(_matching, "a binary, b binary"), "mh-candidates")

    def confirmed(found: DataFrame, *old: DataFrame) -> DataFrame:
        """Links among found candidates, with those of old; both are stored and not needed after."""
        whole = class_texts(found.select(F.explode(F.array("a", "b")).alias("cls")))
        pairs = found
        for side in "ab":
            pairs = pairs.join(whole.select(F.col("cls").alias(side), F.col("text").alias(f"text_{side}")), side)
        links = pairs.select("a", "b", "text_a", "text_b").mapInArrow(_confirm(least_percent), "a binary, b binary")
        for x in old:
            links = links.unionByName(x)
        return store(links, "mh-links", found, whole, *old)

    def open_posts(links: DataFrame, *more) -> DataFrame:
        """Posts of the lists that still hold several components, with the component as label and the list's `more` aggregates."""
        labels = components(links, "a", "b").withColumnRenamed("node", "cls")
        rows = posts.where("size > 2").join(labels, "cls", "left").withColumn("label", F.coalesce("label", "cls"))
        lists = rows.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), *more).where("low <> high").drop("low", "high")
        return rows.join(lists, "key")

    stars = posts.where("cls <> head").select(F.col("head").alias("a"), F.col("cls").alias("b")).distinct()
    links = confirmed(candidates(stars))
    hub = F.min(F.struct(F.xxhash64("key", "cls").alias("order"), F.col("cls").alias("a"), F.col("label").alias("of"))).alias("hub")
    stars = open_posts(links, hub).where("label <> hub.of").select("hub.a", F.col("cls").alias("b")).distinct()
    links = confirmed(candidates(stars), links)

    # A level spans a little more than the ratio of sizes that similar sets can have, so partners are on one level or the next.
    step = F.lit(1.001).cast("double") * F.log(F.lit(100.0 / least_percent)) if least_percent < 100 else F.lit(1e-9)
    rows = open_posts(links).where("cls <> head").select("key", "at", "cls", "label").join(classes, "cls").withColumn("level", F.floor(F.log("n") / step).cast("long"))
    rows = rows.withColumn("upper", F.explode(F.array(F.lit(False), F.lit(True)))).withColumn("level", F.col("level") - F.col("upper").cast("long"))
    groups = rows.groupBy("key", "level").agg(F.count("*").alias("members"), F.sum("bytes").alias("all"), F.min("upper").alias("only_upper")).where("members > 1 and not only_upper")
    blocks = F.greatest(F.ceil(F.col("members") / F.lit(BLOCK)), F.ceil(F.col("all") / F.lit(BLOCK_BYTES))).cast("int")
    rows = rows.join(groups.select("key", "level", blocks.alias("blocks")), ["key", "level"]).withColumn("block", F.expr("cast(pmod(xxhash64(cls), blocks) as int)"))
    rows = rows.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).withColumns({"first": F.least("block", "other"), "second": F.greatest("block", "other")})
    in_blocks = lambda df: df.repartition(*_BLOCK_KEY).sortWithinPartitions(*_BLOCK_KEY)
    kinds = "key long, level long, first int, second int, block int, at int, upper boolean, cls binary, label binary, sig binary"
    near = store(in_blocks(rows.select(*_BLOCK_ROW)).mapInArrow(_by_block(_BLOCK_ROW, _open_rows), kinds), "mh-open")
    # Only rows that are in some pair get their texts.
    whole = class_texts(near.select("cls"))
    late = in_blocks(near.join(whole, "cls")).mapInArrow(_by_block([*_BLOCK_ROW, "text"], _links_of(least_percent)), "a binary, b binary")
    links = store(links.unionByName(late), "mh-links", links, posts, near, whole)
    labels = components(links, "a", "b").withColumnRenamed("node", "cls")
    discard(links)
    grouped = classes.select("cls", "rep").join(labels, "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    names = grouped.groupBy("label").agg(F.min("rep").alias("component_id"))
    named = grouped.join(names, "label").select("cls", "component_id")
    return sets.select("id", "n", "cls").join(named, "cls", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
        F.coalesce("component_id", "id").alias("component_id"), F.col("id").eqNullSafe(F.coalesce("component_id", "id")).alias("kept"),
    )
