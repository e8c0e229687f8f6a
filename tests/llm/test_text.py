"""Toxicity, decontamination, token counts and the URL filter."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.llm import decontam, tokencount, toxicity, urlfilter
from tessera.llm.common import table
from tessera.llm.queries import RULES, VOCABULARY, toxic_lexicon

DATA = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.exists(DATA), reason="no test data")


def test_folding_and_exceptions():
    lexicon = toxicity.Lexicon({"idiot": 4.0, "trash": 4.0, "lowe": 3.0}, ["trash can", "lower"], -3.0, 2.0, 0.0)
    a = lexicon.automaton()
    weight = lambda t: toxicity.matches(toxicity.fold(t), a)
    assert weight("You 1D10T!") == 4.0
    assert weight("іdі\u200bоt ｔｒａｓｈ") == 8.0
    assert weight("a trash can, a trash canoe") == 4.0
    assert weight("an unidiotic flower lower lowest") == 3.0
    assert weight("") == 0.0


def slow_matches(folded, lexicon):
    """Every word against every entry; exceptions as spans of whole words."""
    words = [(m.start(), m[0]) for m in re.finditer(r"[^\W\d_]+", folded)]
    free = [(m.start(), m.end()) for x in lexicon.exceptions for m in re.finditer(rf"(?<![^\W\d_])(?={re.escape(x)}(?![^\W\d_]))", folded)]
    free = [(a, a + 1) for a, _ in free] + [(a, a + len(x)) for x in lexicon.exceptions for a in (m.start() for m in re.finditer(rf"(?<![^\W\d_])(?={re.escape(x)}(?![^\W\d_]))", folded))]
    total = 0.0
    for at, w in words:
        hit = [v for k, v in lexicon.weights.items() if (w in (k.rstrip(), k.rstrip() + "s", k.rstrip() + "es") if k.endswith(" ") else w.startswith(k))]
        if hit and not any(a <= at < b for a, b in free):
            total += max(hit)
    return total


def test_automaton_is_the_slow_search():
    rng = random.Random(12)
    for _ in range(200):
        word = lambda: "".join(rng.choice("abs") for _ in range(rng.randrange(1, 5)))
        lexicon = toxicity.Lexicon({word() + rng.choice(["", " "]): float(rng.randrange(1, 9)) for _ in range(4)}, [word(), f"{word()} {word()}"])
        text = "".join(rng.choice("abss  .") for _ in range(60))
        assert toxicity.matches(text, lexicon.automaton()) == slow_matches(text, lexicon), (text, lexicon)


def test_whole_words_and_stems_are_told_apart():
    found = {"lose": (100, 4.0), "loser": (99, 4.1), "loser ": (99, 4.2), "bomen": (60, 5.0), "bomente": (59, 5.1), "bomentera ": (9, 5.0), "bomenteja ": (8, 5.0)}
    assert toxicity._chosen(found) == {"loser ": 4.2, "bomente": 5.1}
    a = toxicity.Lexicon({"loser ": 4.0, "bomente": 5.0}).automaton()
    weight = lambda t: toxicity.matches(toxicity.fold(t), a)
    assert weight("who loses a loserly path") == 0.0 and weight("LOSER, losers") == 8.0 and weight("bomenterra") == 5.0
    assert weight("l o s e r") == 4.0 and weight("what a l.0.s.e.r!") == 4.0 and weight("a b c d") == 0.0 and weight("l0$3r") == 4.0


def test_exceptions_are_learned(spark):
    toxic = [(i, f"you idiot number {i}", 1) for i in range(40)]
    clean = [(100 + i, f"the idiot light of car {i} was on" if i % 4 == 0 else f"plain text {i}", 0) for i in range(1200)]
    docs = spark.createDataFrame([r[:2] for r in toxic + clean], "doc_id long, text string")
    lexicon = toxicity.learn(docs, spark.createDataFrame([(r[0], r[2]) for r in toxic + clean], "doc_id long, label int"), least_odds=1.0, exceptions=())
    assert "idiot " in lexicon.weights and {"idiot light", "the idiot"} <= set(lexicon.exceptions)


@needs_data
def test_held_out_accuracy(spark):
    docs, labels = (table(spark, "/root/testdata/sf0.1", t) for t in ("documents", "labels"))
    scored = toxicity.score(docs, toxic_lexicon(spark, docs, labels))
    rows = scored.join(labels, "doc_id").where(toxicity.held_out()).select("score", "toxic").collect()
    hit = sum((r.score >= 0.3) == bool(r.toxic) for r in rows)
    assert len(rows) > 500 and hit / len(rows) > 0.98


def test_scores_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (2, "", 0.5), (2, "", 0.5), (3, "idiot " * 50000, 0.5)], "doc_id long, text string, score double")
    lexicon = toxicity.Lexicon({"idiot": 4.0}, [], -3.0, 2.0, 0.0)
    found = sorted((r.doc_id, r.score > 0.3) for r in toxicity.score(docs, lexicon).collect())
    assert found == [(1, False), (2, False), (2, False), (3, True)]
    nothing = toxicity.learn(docs, spark.createDataFrame([], "doc_id long, label int"))
    assert not nothing.weights
    assert toxicity.score(docs.limit(0), lexicon).count() == 0


def slow_alignment(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    top = 0
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            best[i][j] = max(0, best[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), best[i - 1][j] - 1, best[i][j - 1] - 1)
            top = max(top, best[i][j])
    return top


def test_alignment_is_the_best_one():
    rng = random.Random(1)
    for _ in range(60):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(1, 25))] for _ in "ab")
        wa, wb = (decontam.words(" ".join(f"w{x}" for x in s)) for s in (a, b))
        score, start, end = decontam.align(wa, wb)
        assert score == slow_alignment(a, b)
        assert score == slow_alignment(a, b[start:end])


def test_edited_copies_are_found_and_clean_texts_left(spark):
    rng = random.Random(2)
    text = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    items = [(i, text(30)) for i in range(20)] + [(20, ["one", "two"])]
    docs, wanted = [], set()
    for i, words in items[:20]:
        edited = words[:]
        for at in (6, 15, 24):
            edited[at] = "edited"
        del edited[10]
        docs.append((i, " ".join(text(200) + edited + text(100))))
        wanted.add((i, i))
    docs += [(100 + i, " ".join(text(300))) for i in range(30)] + [(200, None), (201, ""), (202, "w5 one, TWO w6")]
    docs += [(300 + i, "Here: " + " ".join(items[3][1]).upper()) for i in range(50)]
    wanted |= {(300 + i, 3) for i in range(50)} | {(202, 20)}
    nameless, other = text(12), text(12)
    docs += [(400, " ".join(text(20) + nameless)), (401, " ".join(other + text(20)))]
    wanted |= {(400, None), (401, 3)}
    frame = spark.createDataFrame([(d, t, "z") for d, t in docs], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items] + [(50, None), (51, ""), (None, " ".join(nameless)), (3, " ".join(other))], "item_id long, text string")
    found = decontam.contaminated(frame, bench).collect()
    assert {(r.doc_id, r.item_id) for r in found} == wanted
    assert decontam.contaminated(frame.limit(0), bench).count() == 0
    assert decontam.contaminated(frame, bench.limit(0)).count() == 0
    exact = next(r for r in found if r.doc_id == 300)
    assert (exact.score, exact.first_word, exact.last_word) == (1.0, 1, 31)


def test_same_as_aligning_everything(spark):
    """All pairs of documents and items that share a run of SEED words, aligned over the whole document by plain dynamic programming."""
    rng = random.Random(14)
    text = lambda n, words=40: [f"w{rng.randrange(words)}" for _ in range(n)]
    items = [(i, text(rng.randrange(4, 16))) for i in range(6)]
    docs = []
    for d in range(40):
        words = text(rng.randrange(0, 40))
        if d % 2:
            part = items[d % 6][1][:]
            part[rng.randrange(len(part))] = "edit"
            words[5:5] = part
        docs.append((d, words))
    wanted = {}
    for d, w in docs:
        for i, item in items:
            runs = {tuple(item[a : a + decontam.SEED]) for a in range(len(item) - decontam.SEED + 1)}
            share = slow_alignment(item, w) / (2 * len(item))
            if share >= decontam.LEAK and any(tuple(w[a : a + decontam.SEED]) in runs for a in range(len(w))):
                wanted[d, i] = share
    frame = spark.createDataFrame([(d, " ".join(w)) for d, w in docs], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    found = {(r.doc_id, r.item_id): r.score for r in decontam.contaminated(frame, bench).collect()}
    assert len(wanted) > 10 and found.keys() == wanted.keys() and all(found[k] == pytest.approx(wanted[k]) for k in wanted)


def test_copies_do_not_hide_an_edited_leak(spark):
    rng = random.Random(4)
    text = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    items = [(0, text(37)), (1, text(59)), (2, text(37))]
    edited = {i: [f"edited{at}" if at % 5 == 4 else w for at, w in enumerate(words)] for i, words in items}
    # Item 0 is edited in two documents, item 1 in forty; item 2 is whole in one and edited in forty.
    leaks = [(0, edited[0])] * 2 + [(1, edited[1])] * 40 + [(2, items[2][1])] + [(2, edited[2])] * 40
    docs = [(d, " ".join(text(60) + words + text(60))) for d, (_, words) in enumerate(leaks)]
    # A run of an item alone is no leak.
    docs += [(1000 + d, " ".join(text(60) + items[0][1][:4] + text(60))) for d in range(40)]
    found = decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in found.collect()} == {(d, i) for d, (i, _) in enumerate(leaks)}


@pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary")
def test_counts_equal_the_tokenizer(spark):
    from tokenizers import Tokenizer, models, pre_tokenizers

    vocabulary = tokencount.unigram_vocabulary(VOCABULARY)
    for scores in (vocabulary, [(p, -float(n % 7) - 1) for n, (p, _) in enumerate(vocabulary)]):
        own = Tokenizer(models.Unigram([("<unk>", 0.0), *scores], unk_id=0))
        own.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.Metaspace(prepend_scheme="always")])
        rng = random.Random(9)
        texts = ["", None, "  \n ", "Hello world", "☃☃☃ snow☃man ☃", "ｆｕｌｌ 漢字かな ünïcödé", "a" * 500, "don't stop", "a  b", "one\ntwo three", "tab\there", "a\u00a0b\u2003c\x1cd", "\u2581mark a\u2581b \u2581\u2581c\u2581"] + ["".join(rng.choice("abcdefghij   éñ☃漢") for _ in range(80)) for _ in range(60)]
        frame = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id int, text string, n_tokens int")
        for r in tokencount.count_tokens(frame, scores).collect():
            words = tokencount.split_words(r.text or "")
            want = own.encode(r.text or "", add_special_tokens=False).ids
            assert r.n_tokens == len(want), r.text
            assert r.n_unknown == sum(i == 0 for i in want)
            assert r.n_words == len(words)


def slow_count(word, scores):
    """Fewest surprises: forward search over all pieces, strictly better ways only, earlier starts first."""
    text, pieces, worst = "▁" + word, dict(scores), min(s for _, s in scores) - 10
    best = {0: (0.0, [])}
    for end in range(1, len(text) + 1):
        for start in range(end):
            piece = text[start:end]
            way = None
            if piece in pieces:
                way = (best[start][0] + pieces[piece], best[start][1] + [piece])
            elif end - start == 1:
                way = (best[start][0] + worst, best[start][1] + [None])
            if way and (end not in best or way[0] > best[end][0]):
                best[end] = way
    path = best[len(text)][1]
    return sum(1 for i, p in enumerate(path) if p is not None or i == 0 or path[i - 1] is not None)


def test_ties_go_to_the_earlier_start():
    rng = random.Random(8)
    scores = [(p, float(-rng.randrange(1, 4))) for p in {"▁", "▁a", "a", "b", "ab", "aba", "ba", "bab", "▁ab", "c", "bc", "abc", "caba"}]
    counter = tokencount.Counter(scores)
    for _ in range(300):
        word = "".join(rng.choice("abcx") for _ in range(rng.randrange(1, 12)))
        assert counter[word] & 0xFFFFFFFF == slow_count(word, scores)


def test_url_rules_words_and_model(spark):
    texts = spark.createDataFrame([("good news from the free library of books",), ("good library books news",), ("casino bonus spam casino",), ("casino spam bonus",)], "text string")
    counts = urlfilter.word_counts(texts)
    urls = [
        "http://Blog.Example.ORG/es/1", "http://example.org/en/17?x", "http://example.org/en/2", "http://a.com/fr/1", "http://x.com/de/1", "http://notcom/de/1", None, "no scheme/de/", "http://org",
        "http://goodnews.net/library", "http://casinobonus.net/spam", "http://a.org/good", "http://b.com/de/casino", "http://c.com/de/spambonus", "http://d.org/library/books", "x://h://y/z#f",
    ]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string").withColumn("host", F.lit("old"))
    found = {r.page_id: r for r in urlfilter.judge(pages, RULES, counts).collect()}
    assert [found[i].rule for i in range(9)] == ["example.org/es/", "example.org/en/1", "org/", "com/fr/", "com/de/", None, None, None, None]
    assert (found[0].host, found[0].path, found[6].host, found[15].host, found[15].path) == ("blog.example.org", "/es/1", "", "h:", "//y/z")
    assert found[9].words == "good news net library" and found[9].verdict == "allow"
    assert found[10].words == "casino bonus net spam" and found[10].verdict == "block"
    assert len(found) == len(urls)
    assert urlfilter.judge(pages.limit(0), RULES, counts).count() == 0
    none = urlfilter.judge(pages, [], counts).collect()
    assert {r.verdict for r in none} == {"allow"} and {r.rule for r in none} == {None}


def test_names_with_hyphens_and_digits_are_segmented(spark):
    texts = spark.createDataFrame([("casino bonus free bets news library",)] * 2, "text string")
    long = "casinobonus" * 7
    urls = [
        "http://a.com/de/1", "http://casino-win.com/de/", "http://freelibrary.org/news", "http://casino-bets.net/", "http://casino24bonus.net/freebets2go", f"http://{long}.net/",
        "http://b\u00fccher-news.net/\u00fc", "http://free_library:8080/",
    ]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string")
    found = {r.page_id: r for r in urlfilter.judge(pages, RULES, urlfilter.word_counts(texts)).collect()}
    assert found[1].words == "casino win com de" and found[1].rule == "com/de/"
    assert found[3].words == "casino bets net" and found[3].verdict == "block"
    assert found[4].words == "casino #2 bonus net free bets #1 go"
    assert found[5].words == "casino bonus " * 7 + "net" and found[5].verdict == "block"
    assert found[6].words == "b \u00fc cher news net \u00fc" and found[7].words == "free library #4"


def test_segments_are_the_most_probable():
    """Against all ways to cut a label."""
    import math

    rng = random.Random(15)
    for _ in range(200):
        label = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 9)))
        counts = {"".join(rng.choice("abc") for _ in range(rng.randrange(1, 4))): rng.randrange(2, 50) for _ in range(6)}
        total = sum(counts.values())
        chance = lambda w: math.log(counts[w] / total) if w in counts else math.log(10 / total) - len(w) * math.log(10)  # noqa: B023, E731
        cuts = [[label[a:z] for a, z in zip([0, *c], [*c, len(label)], strict=True)] for c in ([i + 1 for i in range(len(label) - 1) if m >> i & 1] for m in range(1 << (len(label) - 1)))]
        found = {(i, n): counts[label[i : i + n]] for i in range(len(label)) for n in range(1, 4) if i + n <= len(label) and label[i : i + n] in counts}
        best = max(sum(map(chance, c)) for c in cuts)
        got = urlfilter.segment(label, found, total)
        assert "".join(got) == label and sum(map(chance, got)) == pytest.approx(best)
    assert urlfilter.segment("x" * 5000, {}, 100) == ["x" * 5000]


def test_rules_and_odds_by_hand(spark):
    """Rules tried one by one, and naive Bayes added up in Python."""
    import math
    from collections import Counter

    rng = random.Random(16)
    names = ["good", "news", "casino", "spam"]
    hosts = ["a.org", "org", "b.example.org", "example.org", "x.com", "com", "y.net", "", "z.com:8080"]
    paths = ["", "/", "/es/", "/es/x", "/en/1", "/en/17", "/fr/good", "/de/spam", "/de/casino-12"]
    urls = [f"http://{rng.choice(names)}{rng.choice(['', '.'])}{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', '?q=/de/', '#f'])}" for _ in range(150)] + [None, "", "org/x"]
    counts = spark.createDataFrame([(n, 10) for n in names], "word string, count long")
    frame = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id int, url string, Verdict string")
    rows = {r.page_id: r for r in urlfilter.judge(frame, RULES, counts).collect()}
    seen, heard = {"allow": Counter(), "block": Counter()}, Counter()
    for i, u in enumerate(urls):
        head, sep, rest = (u or "").partition("://")
        host = re.split("[/?#]", rest)[0].lower() if sep else ""
        path = re.split("[?#]", rest[len(host) :])[0] if sep else ""
        fits = [(len(t), n, t, said) for n, (said, t) in enumerate(RULES) if (host == t.split("/")[0] or host.endswith("." + t.split("/")[0])) and path.startswith(t[t.index("/") :])]
        best = max(fits, default=(0, 0, None, None))
        assert (rows[i].host, rows[i].path, rows[i].rule) == (host, path, best[2]), u
        if best[3]:
            assert rows[i].verdict == best[3]
            seen[best[3]].update(rows[i].words.split())
            heard[best[3]] += 1
    words = set(seen["allow"]) | set(seen["block"])
    weight = lambda w, v: math.log((seen[v][w] + 1) / (sum(seen[v].values()) + len(words)))
    for r in rows.values():
        odds = math.log(heard["block"] / heard["allow"]) + sum(weight(w, "block") - weight(w, "allow") for w in r.words.split() if w in words)
        assert r.log_odds == pytest.approx(odds) and (r.rule or r.verdict == ("block" if odds > 1e-12 else "allow"))
