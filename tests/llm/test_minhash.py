import re

from tessera.llm import graph, minhash


def brute(rows):
    """Component of each row by comparing all pairs."""
    def shingles(text):
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", low)
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    least = {}
    for i in range(len(rows)):
        least[root(i)] = min(least.get(root(i), rows[i][0]), rows[i][0])
    return {(rows[i][0], len(sets[i]), least[root(i)]) for i in range(len(rows))}


def check(spark, rows):
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, cls int, label int"), "doc_id").collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in found} == brute([r[:2] for r in rows])
    assert len(found) == len(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_chain_of_edits_copies_and_short_texts(spark):
    import random

    rng = random.Random(5)
    base = [f"w{rng.randrange(3000)}" for _ in range(120)]
    rows, n = [], 0
    for _ in range(40):
        base = base[:]
        base[rng.randrange(120)] = f"x{rng.randrange(3000)}"
        rows.append((n, " ".join(base), 0, 0))
        n += 1
    for text in ["", None, "a", "A", "a b c d", "A  b\tc d", "a b c d e", "x " * 50, "x " * 51, rows[3][1].upper(), "é É", "é é", rows[7][1]]:
        rows.append((n, text, 0, 0))
        n += 1
    rows += [(n + i, " ".join(f"q{rng.randrange(200)}" for _ in range(60)), 0, 0) for i in range(20)]
    check(spark, rows)


def test_common_passage_in_unlike_texts_links_nothing(spark):
    import random

    rng = random.Random(6)
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(i, " ".join(f"w{rng.randrange(5000)}" for _ in range(60)) + " " + passage, 0, 0) for i in range(60)]
    check(spark, rows)


def test_blocks_of_one_list_give_the_same(spark, monkeypatch):
    import random

    monkeypatch.setattr(minhash, "BLOCK", 4)
    rng = random.Random(7)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(60):
        own = base[:]
        for _ in range(rng.randrange(1, 6)):
            own[rng.randrange(80)] = f"x{rng.randrange(1000)}"
        rows.append((i, " ".join(own), 0, 0))
    check(spark, rows)


def test_repeated_rows_null_ids_and_empty_table(spark):
    rows = [(1, "a b c d e f", 0, 0), (1, "a b c d e f", 0, 0), (None, "a b c d e f", 0, 0), (None, None, 0, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, cls int, label int")
    found = sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs).collect())
    assert found == [("1", 2, 1), ("1", 2, 1), ("None", 0, None), ("None", 2, 1)]
    assert minhash.near_duplicates(docs.where("doc_id > 5")).count() == 0


def test_components_over_many_partitions(spark):
    links = [(f"{i:03}".encode(), f"{i + 1:03}".encode()) for i in range(100) if i % 10 != 9] + [(b"005", b"095")]
    found = {bytes(r.node): bytes(r.label) for r in graph.components(spark.createDataFrame(links, "a binary, b binary"), "a", "b", local_links=7).collect()}
    assert all(found[f"{i:03}".encode()] == (f"{i // 10 * 10:03}".encode() if i < 90 else b"000") for i in range(100) if f"{i:03}".encode() in found)
    assert len(found) == 100


def test_a_row_without_id_passes_links_on(spark):
    """1 and 3 are too far apart, but both are linked with the text between them, whose row has no id."""
    words = [f"w{i}" for i in range(40)]
    second = [*words[:36], *(f"x{i}" for i in range(4))]
    third = [*(f"y{i}" for i in range(4)), *second[4:]]
    texts = [" ".join(w) for w in (words, second, third)]
    assert [minhash._similar(minhash.kernels.exact_shingles(texts[i]), minhash.kernels.exact_shingles(texts[j]), 75) for i, j in ((0, 1), (1, 2), (0, 2))] == [True, True, False]
    docs = spark.createDataFrame([(1, texts[0]), (None, texts[1]), (3, texts[2])], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in minhash.near_duplicates(docs).collect()} == {(1, 1), (None, 1), (3, 1)}


def test_words_that_collide_in_polynomial_hashes_stay_apart(spark):
    """A Thue-Morse word and its complement have equal polynomial hashes modulo 2 ** 64, whatever the base."""
    bits = [bin(i).count("1") % 2 for i in range(4096)]
    a, b = "".join("ab"[x] for x in bits), "".join("ba"[x] for x in bits)
    docs = spark.createDataFrame([(1, a), (2, b), (3, a[:400]), (4, b[:400]), (5, a)], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in minhash.near_duplicates(docs).collect()} == {(1, 1), (2, 2), (3, 3), (4, 4), (5, 1)}


def test_null_texts_long_texts_and_clashing_columns(spark):
    long = " ".join(f"w{i}" for i in range(30000))
    rows = [(1, None, "a", 1, b"x"), (2, long, "a", 1, b"x"), (3, long + " end", "a", 1, b"x"), (4, None, "a", 1, b"x"), (5, "", "a", 1, b"x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string, N int, cls binary")
    assert {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect()} == {(1, 0, 1, True), (2, 29996, 2, True), (3, 29997, 2, False), (4, 0, 4, True), (5, 0, 5, True)}


def test_many_repeated_rows_are_compared_once(spark):
    """A thousand copies of one row and a thousand of a near copy are one pair of texts."""
    import time

    words = [f"w{i}" for i in range(200)]
    rows = [(7, " ".join(words))] * 1000 + [(8, " ".join([*words, "more"]))] * 1000 + [(9, "some other text of its own with words")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    began = time.time()
    found = minhash.near_duplicates(frame).collect()
    assert time.time() - began < 60
    assert {(r.doc_id, r.component_id, r.kept) for r in found} == {(7, 7, True), (8, 7, False), (9, 9, True)} and len(found) == 2001
