"""The same plans as DuckDB SQL, for checking. One chain of named steps; a query takes what it needs from it."""

from __future__ import annotations

import re

from tessera.functions import text as X


def tok(column: str) -> str:
    return rf"regexp_extract_all(lower(coalesce({column}, '')), '[\p{{L}}\p{{N}}_]+')"


def words(column: str) -> str:
    return rf"list_filter(regexp_split_to_array(coalesce({column}, ''), '[ \t\r\n\f]+'), lambda w: w <> '')"


def sents(column: str) -> str:
    return rf"list_filter(list_transform(string_split(regexp_replace(coalesce({column}, ''), '([.!?])[ \t\r\n\f]+', '\1' || chr(1), 'g'), chr(1)), lambda s: regexp_replace(s, '^[ \t\r\n\f]+|[ \t\r\n\f]+$', '', 'g')), lambda s: s <> '')"


def overlap(a: str, b: str) -> str:
    return f"coalesce(list_sum(list_transform(list_distinct(list_intersect({a}, {b})), lambda x: least(len(list_filter({a}, lambda y: y = x)), len(list_filter({b}, lambda y: y = x))))), 0)"


def f1(a: str, b: str) -> str:
    return f"(CASE WHEN {overlap(a, b)} > 0 THEN 2.0::DOUBLE * {overlap(a, b)} / (len({a}) + len({b})) ELSE 0.0::DOUBLE END)"


def grams(a: str, n: int) -> str:
    return f"list_transform(range(1, greatest(len({a}) - {n} + 2, 1)), lambda i: array_to_string({a}[i:i+{n - 1}], ' '))"


def class_of(column: str) -> str:
    whole = lambda w: rf"(?i)(^|[^\p{{L}}\p{{N}}_])({w})($|[^\p{{L}}\p{{N}}_])"
    return f"CASE WHEN regexp_matches(coalesce({column}, ''), '{whole(X.FACTUAL)}') THEN 'factual' WHEN regexp_matches(coalesce({column}, ''), '{whole(X.COMPLEX)}') THEN 'complex' ELSE 'default' END"


STOP = ", ".join(f"'{w}'" for w in X.STOP_WORDS)


def keywords(column: str) -> str:
    return rf"list_distinct(list_transform(list_filter({words(column)}, lambda w: length(w) > 2 AND NOT (lower(w) IN ({STOP}))), lambda w: regexp_replace(lower(w), '^[?.,!]+|[?.,!]+$', '', 'g')))"


def hits(kw: str, text: str) -> str:
    return f"len(list_filter({kw}, lambda w: contains(lower(coalesce({text}, '')), w)))"


def letters(name: str) -> str:
    """(word, b, x): hashed three-letter pieces of the words of a step, as unit vectors."""
    gram = "unnest(list_transform(range(1, greatest(length(word) - 2, 1) + 1), lambda i: substr(word, i, 3)))"
    return f"SELECT word, b, c / sqrt(sum(c * c) OVER (PARTITION BY word)) AS x FROM (SELECT word, ('0x' || substr(md5(g), 1, 8))::BIGINT % 64 AS b, count(*)::DOUBLE AS c FROM (SELECT word, {gram} AS g FROM {name}) GROUP BY ALL)"


def walks(rounds: int, ranks: int) -> dict[str, str]:
    """Distances and personalised ranks on the graph of each question, from its concepts."""
    steps = {"gr0": "SELECT item_id, node, 0.0::DOUBLE AS distance FROM gsrc"}
    for i in range(rounds):
        steps[f"gr{i + 1}"] = f"SELECT item_id, node, min(distance) AS distance FROM (SELECT * FROM gr{i} UNION ALL SELECT r.item_id, e.b, r.distance + e.weight FROM gr{i} r JOIN gt e ON e.item_id = r.item_id AND e.a = r.node WHERE r.distance + e.weight <= 4.0::DOUBLE) GROUP BY ALL"
    steps["gflow"] = "SELECT item_id, a, b, weight / sum(weight) OVER (PARTITION BY item_id, a) AS p FROM gt WHERE weight > 0"
    steps["gbase"] = "SELECT item_id, node, 1.0::DOUBLE / count(*) OVER (PARTITION BY item_id) AS base FROM gsrc"
    steps["gp0"] = "SELECT item_id, node, base AS ppr FROM gbase"
    for i in range(ranks):
        lost = f"SELECT p.item_id, sum(p.ppr) AS lost FROM gp{i} p WHERE NOT EXISTS (SELECT 1 FROM gflow f WHERE f.item_id = p.item_id AND f.a = p.node) GROUP BY p.item_id"
        steps[f"gp{i + 1}"] = f"SELECT item_id, node, sum(x) AS ppr FROM (SELECT p.item_id, f.b AS node, 0.85::DOUBLE * p.ppr * f.p AS x FROM gp{i} p JOIN gflow f ON f.item_id = p.item_id AND f.a = p.node UNION ALL SELECT s.item_id, s.node, s.base * (0.15::DOUBLE + 0.85::DOUBLE * coalesce(l.lost, 0)) FROM gbase s LEFT JOIN ({lost}) l USING (item_id)) GROUP BY ALL"
    steps["gd0"] = f"SELECT i.gate, i.item_id, i.doc_id, i.added, r.distance AS raw, coalesce(p.ppr, 0) AS ppr FROM gids i LEFT JOIN gr{rounds} r ON r.item_id = i.item_id AND r.node = 'd' || i.doc_id LEFT JOIN gp{ranks} p ON p.item_id = i.item_id AND p.node = 'd' || i.doc_id"
    steps["gd1"] = "SELECT *, CASE WHEN raw IS NULL THEN 0.8::DOUBLE WHEN max(raw) OVER w > min(raw) OVER w THEN round((raw - min(raw) OVER w) / (max(raw) OVER w - min(raw) OVER w), 9) ELSE 0.0::DOUBLE END AS scaled, CASE WHEN max(ppr) OVER w > 0 THEN round(ppr / max(ppr) OVER w, 9) ELSE 0.0::DOUBLE END AS share FROM gd0 WINDOW w AS (PARTITION BY gate, item_id)"
    steps["gd"] = "SELECT gate, item_id, doc_id, added, CASE WHEN item_id IN (SELECT item_id FROM gsrc) THEN round(0.7::DOUBLE * scaled + 0.3::DOUBLE * (1 - share), 9) END AS distance FROM gd1"
    steps["gcand"] = "SELECT gd.gate, gd.added, gd.item_id, gd.doc_id, q.text AS query, d.text, gsem.sem AS semantic_score, gd.distance, q.tok AS qtok, d.tok AS dtok FROM gd JOIN gsem USING (item_id, doc_id) JOIN qt q USING (item_id) JOIN dt d USING (doc_id)"
    return steps


def questions() -> dict[str, str]:
    """The graph of each question: pools of its session (four items in a row) up to its turn."""
    hashed = "('0x' || substr(md5(gc.word), 1, 8))::BIGINT % 64"
    return {
        "turns": "SELECT item_id, item_id // 4 AS session, item_id % 4 AS turn FROM qt",
        "gm": "SELECT q.item_id, r.doc_id, max((p.item_id = q.item_id)::INT) AS seed FROM turns q JOIN turns p ON p.session = q.session AND p.turn <= q.turn JOIN rrf r ON r.item_id = p.item_id GROUP BY ALL",
        "gc": "SELECT gm.item_id, gm.doc_id, con.word, con.type, con.concept FROM gm JOIN con USING (doc_id)",
        "gsw": f"SELECT gc.item_id, gc.concept, avg(coalesce(x, 0.0::DOUBLE)) AS w FROM gc LEFT JOIN de ON de.doc_id = gc.doc_id AND de.b = {hashed} GROUP BY ALL",
        "gce": "SELECT item_id, 'd' || doc_id AS a, concept AS b, round(CASE WHEN w > 0.3::DOUBLE THEN 0.3::DOUBLE * (1 - 0.5::DOUBLE * w) ELSE 0.3::DOUBLE END, 6) AS weight FROM gc JOIN gsw USING (item_id, concept)",
        "gsh": "SELECT x.item_id, x.doc_id AS a, y.doc_id AS b, round(greatest(0.1::DOUBLE, 1.0::DOUBLE / (1 + count(*))), 6) AS weight FROM gc x JOIN gc y ON x.item_id = y.item_id AND x.concept = y.concept AND x.doc_id < y.doc_id GROUP BY ALL HAVING count(*) >= 2",
        "gsim": "SELECT x.item_id, x.doc_id AS a, y.doc_id AS b, round(sum(dx.x * dy.x) / (1.00000001::DOUBLE * 1.00000001::DOUBLE), 6) AS s FROM gm x JOIN gm y ON x.item_id = y.item_id AND x.doc_id < y.doc_id JOIN de dx ON dx.doc_id = x.doc_id JOIN de dy ON dy.doc_id = y.doc_id AND dy.b = dx.b GROUP BY ALL",
        "gdd": "SELECT item_id, a, b, min(weight) AS weight FROM (SELECT * FROM gsh UNION ALL SELECT item_id, a, b, round(greatest(0.0::DOUBLE, 1 - s), 6) FROM gsim WHERE s > 0.65::DOUBLE) GROUP BY ALL",
        "gedge": "SELECT * FROM gce UNION ALL SELECT item_id, b, a, weight FROM gce UNION ALL SELECT item_id, 'd' || a, 'd' || b, weight FROM gdd UNION ALL SELECT item_id, 'd' || b, 'd' || a, weight FROM gdd",
        "gcut": "SELECT item_id, round(quantile_cont(weight, 0.55::DOUBLE), 9) AS cut FROM gedge GROUP BY item_id",
        "gt": "SELECT e.* FROM gedge e JOIN gcut USING (item_id) WHERE weight <= cut",
        "gnb": "SELECT item_id, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(weight, 8), doc_id) AS n FROM (SELECT e.item_id, t.doc_id, min(e.weight) AS weight FROM gt e JOIN gm s ON s.item_id = e.item_id AND s.seed = 1 AND e.a = 'd' || s.doc_id JOIN gm t ON t.item_id = e.item_id AND t.seed = 0 AND e.b = 'd' || t.doc_id WHERE e.weight <= 0.5::DOUBLE GROUP BY ALL)) WHERE n <= 5",
        "gsem": "SELECT gm.item_id, gm.doc_id, seed, coalesce(v.similarity_score, 0.0::DOUBLE) AS sem FROM gm LEFT JOIN vsim v ON v.item_id = gm.item_id AND v.doc_id = gm.doc_id",
        "gbest": "SELECT r.item_id, max(coalesce(v.similarity_score, 0.0::DOUBLE)) AS best FROM rrf r LEFT JOIN vt v ON v.item_id = r.item_id AND v.doc_id = r.doc_id GROUP BY r.item_id",
        "gids": "SELECT g.gate, gm.item_id, gm.doc_id, 0 AS added FROM gm, (SELECT unnest([0, 1]) AS gate) g WHERE seed = 1 UNION ALL SELECT g.gate, n.item_id, n.doc_id, 1 FROM gnb n JOIN gsem USING (item_id, doc_id) JOIN gbest USING (item_id), (SELECT unnest([0, 1]) AS gate) g WHERE g.gate = 0 OR sem >= greatest(0.1::DOUBLE, 0.4::DOUBLE * best)",
        "aw": f"SELECT DISTINCT item_id, word FROM (SELECT item_id, unnest(tok) AS word FROM qt) WHERE length(word) > 2 AND word NOT IN ({STOP})",
        "gw": "SELECT DISTINCT item_id, type, word, concept FROM gc",
        "grest": "SELECT item_id, word FROM aw WHERE NOT EXISTS (SELECT 1 FROM gw WHERE gw.item_id = aw.item_id AND gw.word = aw.word AND gw.type = 'KEYWORD')",
        "gwords": "SELECT word FROM grest UNION SELECT word FROM gw",
        "gl": letters("gwords"),
        "gfz": "SELECT item_id, word, concept FROM (SELECT *, row_number() OVER (PARTITION BY item_id, word ORDER BY s DESC, type, cword) AS n FROM (SELECT r.item_id, r.word, w.concept, w.type, w.word AS cword, round(sum(x.x * y.x), 6) AS s FROM grest r JOIN gl x ON x.word = r.word JOIN gl y ON y.b = x.b JOIN gw w ON w.item_id = r.item_id AND w.word = y.word GROUP BY ALL)) WHERE n = 1 AND s >= 0.55::DOUBLE",
        "gsrc": "SELECT aw.item_id, gw.concept AS node FROM aw JOIN gw ON gw.item_id = aw.item_id AND gw.word = aw.word AND gw.type = 'KEYWORD' UNION SELECT item_id, concept FROM gfz",
    }


STEPS: dict[str, str] = {
    "dt": f"SELECT doc_id, text, lang, source, {tok('text')} AS tok FROM documents",
    "qt": f"SELECT item_id, text, {tok('text')} AS tok FROM benchmark",
    # BM25
    "tf": "SELECT doc_id, term, count(*)::DOUBLE AS tf FROM (SELECT doc_id, unnest(tok) AS term FROM dt) GROUP BY ALL",
    "size": "SELECT count(*)::DOUBLE AS n, avg(len(tok))::DOUBLE AS avgdl FROM dt",
    "raw": "SELECT term, ln(n - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE) AS raw FROM (SELECT term, count(*)::DOUBLE AS df FROM tf GROUP BY term), size",
    "idf": "SELECT term, CASE WHEN raw < 0 THEN 0.25::DOUBLE * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw",
    "bmall": "SELECT item_id, doc_id, sum(idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len(dt.tok) / avgdl))) AS bm25_score FROM (SELECT item_id, unnest(tok) AS term FROM qt) q JOIN idf USING (term) JOIN tf USING (term) JOIN dt USING (doc_id), size GROUP BY ALL",
    "bm": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(bm25_score, 4) DESC, doc_id) AS rank FROM bmall) WHERE rank <= 20 AND round(bm25_score, 4) > 0",
    # hashed embeddings
    "de": "SELECT doc_id, b, c / sqrt(sum(c * c) OVER (PARTITION BY doc_id)) AS x FROM (SELECT doc_id, ('0x' || substr(md5(term), 1, 8))::BIGINT % 64 AS b, sum(tf) AS c FROM tf GROUP BY ALL)",
    "qe": "SELECT item_id, b, c / sqrt(sum(c * c) OVER (PARTITION BY item_id)) AS x FROM (SELECT item_id, ('0x' || substr(md5(term), 1, 8))::BIGINT % 64 AS b, count(*)::DOUBLE AS c FROM (SELECT item_id, unnest(tok) AS term FROM qt) GROUP BY ALL)",
    "vsim": "SELECT item_id, doc_id, round(sum(qe.x * de.x) / (1.00000001::DOUBLE * 1.00000001::DOUBLE), 6) AS similarity_score FROM qe JOIN de USING (b) GROUP BY ALL",
    "vt": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY similarity_score DESC, doc_id) AS rank FROM vsim) WHERE rank <= 20",
    # fusion
    "lists": "SELECT item_id, doc_id, 0 AS list, rank, 0.6::DOUBLE / (30 + rank) AS s FROM vt UNION ALL SELECT item_id, doc_id, 1, rank, 0.4::DOUBLE / (30 + rank) FROM bm",
    "fused": "SELECT item_id, doc_id, sum(s) AS rrf_score, min(list * 1000 + rank) AS first FROM lists GROUP BY ALL",
    "rrf": "SELECT item_id, doc_id, rrf_score, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(rrf_score, 8) DESC, first, doc_id) AS rank FROM fused) WHERE rank <= 20",
    # candidates and scores
    "cand": "SELECT r.item_id, r.doc_id, r.rank AS pool_rank, q.text AS query, d.text, v.similarity_score, q.tok AS qtok, d.tok AS dtok FROM rrf r JOIN qt q USING (item_id) JOIN dt d USING (doc_id) LEFT JOIN vt v ON v.item_id = r.item_id AND v.doc_id = r.doc_id",
    "sc00": f"SELECT *, {class_of('query')} AS query_type, 1.0::DOUBLE / (1.0::DOUBLE + coalesce(distance, 100.0::DOUBLE)) AS graph_score, (max(distance) OVER (PARTITION BY gate, item_id) IS NULL OR max(semantic_score) OVER (PARTITION BY gate, item_id) < 0.40::DOUBLE) AS alone, {hits(keywords('query'), 'text')} AS hits FROM gcand",
    "sc0": "SELECT * FROM sc00 WHERE gate = 1",
    "sc1": "SELECT *, CASE WHEN alone THEN 1.0::DOUBLE WHEN query_type = 'factual' THEN 0.85::DOUBLE WHEN query_type = 'complex' THEN 0.40::DOUBLE ELSE 0.7::DOUBLE END AS alpha, CASE WHEN alone THEN 0.0::DOUBLE WHEN query_type = 'factual' THEN 0.15::DOUBLE WHEN query_type = 'complex' THEN 0.60::DOUBLE ELSE 0.3::DOUBLE END AS beta FROM sc0",
    "sc2": "SELECT *, alpha * semantic_score + beta * graph_score AS h0 FROM sc1",
    "sc3": "SELECT *, CASE WHEN hits >= 2 THEN least(1.0::DOUBLE, h0 + least(0.15::DOUBLE, 0.03::DOUBLE * hits)) ELSE h0 END AS h1 FROM sc2",
    "hs": "SELECT *, round(CASE WHEN semantic_score >= 0.70::DOUBLE THEN greatest(h1, 0.80::DOUBLE) ELSE h1 END, 6) AS hybrid_score FROM sc3",
    "sf": "SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY semantic_score < 0.15::DOUBLE, hybrid_score DESC, doc_id) AS before FROM hs",
    "ce": f"SELECT *, CASE WHEN before <= 20 THEN round({f1('qtok', 'dtok')}, 6) END AS ce FROM sf",
    "ce1": "SELECT *, CASE WHEN before <= 20 THEN CASE WHEN max(ce) OVER w > min(ce) OVER w THEN (ce - min(ce) OVER w) / (max(ce) OVER w - min(ce) OVER w) ELSE 1.0::DOUBLE END ELSE -1.0::DOUBLE END AS cross_encoder_score FROM ce WINDOW w AS (PARTITION BY item_id)",
    "ce2": "SELECT *, round(CASE WHEN before <= 20 THEN 0.5::DOUBLE * hybrid_score + 0.5::DOUBLE * cross_encoder_score ELSE hybrid_score END, 6) AS final_score FROM ce1",
    "bl": "SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY before > 20, CASE WHEN before <= 20 THEN -final_score END, before, doc_id) AS rank FROM ce2",
    "ak0": "SELECT *, count(*) OVER (PARTITION BY item_id) AS n, first_value(final_score) OVER (PARTITION BY item_id ORDER BY rank) AS top FROM bl",
    "ak1": "SELECT *, (n > 5 AND top > 0 AND rank > 1 AND (final_score < 0.3::DOUBLE * top OR (lag(final_score) OVER w - final_score > 0.5::DOUBLE * top AND rank - 1 >= 5)))::INT AS stop FROM ak0 WHERE n <= 5 OR top <= 0 OR rank <= 10 WINDOW w AS (PARTITION BY item_id ORDER BY rank)",
    "ak": "SELECT * FROM (SELECT *, max(stop) OVER (PARTITION BY item_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS past FROM ak1) WHERE past = 0 OR (rank <= 5 AND n > 5)",
    # graph of concepts
    "cw": f"SELECT doc_id, term AS word, tf FROM tf WHERE length(term) > 2 AND term NOT IN ({STOP})",
    "kw": "SELECT doc_id, word, 'KEYWORD' AS type, tf::BIGINT AS score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY tf DESC, length(word) DESC, word) AS n FROM cw) WHERE n <= 10",
    "ner": r"SELECT doc_id, lower(w) AS word, 'NER' AS type, count(*) AS score FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[\p{Ll},] (\p{Lu}\p{L}{2,})', 1)) AS w FROM documents) GROUP BY ALL",
    "cons": "SELECT * FROM kw UNION ALL SELECT * FROM ner",
    "con": "SELECT *, 'concept_' || type || '_X_' || word AS concept FROM cons",
    "cls0": "SELECT doc_id, list_sort(list(DISTINCT concept)) AS cs FROM con GROUP BY doc_id",
    "cls": "SELECT doc_id, cs, min(doc_id) OVER (PARTITION BY cs) AS node FROM cls0",
    "cmen": "SELECT con.* FROM con JOIN cls USING (doc_id) WHERE cls.node = con.doc_id",
    "sh": "SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM (SELECT DISTINCT doc_id, concept FROM cmen) a JOIN (SELECT DISTINCT doc_id, concept FROM cmen) b USING (concept) WHERE a.doc_id < b.doc_id GROUP BY ALL HAVING count(*) >= 2",
    "shared": "SELECT *, greatest(0.1::DOUBLE, 1.0::DOUBLE / (1 + shared)) AS weight FROM sh",
    "ced": "SELECT doc_id::VARCHAR AS src, concept AS dst, 0.3::DOUBLE AS weight, CASE WHEN type = 'NER' THEN 'contains_ner' ELSE 'contains_keyword' END AS relation FROM con UNION ALL SELECT concept, doc_id::VARCHAR, 0.3::DOUBLE, 'found_in_chunk' FROM con",
    # all pairs of chunks, not those of classes: the other way to the same numbers
    "allsh": "SELECT a.doc_id AS a, b.doc_id AS b, greatest(0.1::DOUBLE, 1.0::DOUBLE / (1 + count(*))) AS weight FROM con a JOIN con b ON a.concept = b.concept AND a.doc_id <> b.doc_id GROUP BY ALL HAVING count(*) >= 2",
    "alled": "SELECT src, dst, weight FROM ced UNION ALL SELECT a::VARCHAR, b::VARCHAR, weight FROM allsh",
    "ge": "SELECT src, dst, min(weight) AS weight FROM (SELECT src, dst, weight FROM ced UNION ALL SELECT a::VARCHAR, b::VARCHAR, weight FROM shared UNION ALL SELECT b::VARCHAR, a::VARCHAR, weight FROM shared) GROUP BY ALL",
    "gn": "SELECT doc_id::VARCHAR AS node, 'chunk' AS kind FROM cls UNION ALL SELECT DISTINCT concept, type FROM con",
    # graph of vectors
    "em": "SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings WHERE embedding IS NOT NULL",
    "sim": "SELECT a.vec_id AS a, b.vec_id AS b, round(list_dot_product(a.v, b.v) / ((sqrt(list_dot_product(a.v, a.v)) + 1e-8::DOUBLE) * (sqrt(list_dot_product(b.v, b.v)) + 1e-8::DOUBLE)), 6) AS similarity FROM em a JOIN em b ON a.vec_id < b.vec_id",
    "pairs": "SELECT * FROM sim WHERE similarity > 0.35::DOUBLE",
    "ve": "SELECT a AS src, b AS dst, round(greatest(0.0::DOUBLE, 1 - similarity), 6) AS weight FROM pairs UNION ALL SELECT b, a, round(greatest(0.0::DOUBLE, 1 - similarity), 6) FROM pairs",
    "vsrc": "SELECT DISTINCT label::BIGINT AS label, src AS node FROM ve JOIN em ON vec_id = src WHERE src % 100 = 0",
    # relevance and evidence
    "nq": "SELECT item_id, array_to_string(tok, ' ') AS t FROM qt",
    "nd": "SELECT doc_id, array_to_string(tok, ' ') AS t FROM dt",
    "rel": "SELECT item_id, doc_id FROM nq JOIN nd ON contains(nd.t, nq.t)",
    "relsize": "SELECT item_id, count(*) AS relevant FROM rel GROUP BY item_id",
    "found": "SELECT bm.item_id, bm.rank, row_number() OVER (PARTITION BY bm.item_id ORDER BY bm.rank) AS nth, min(bm.rank) OVER (PARTITION BY bm.item_id) AS first FROM bm JOIN rel USING (item_id, doc_id)",
    "rm0": "SELECT item_id, k, relevant, count(rank) FILTER (WHERE rank <= k) AS hits, coalesce(max(1.0::DOUBLE / first), 0.0::DOUBLE) AS mrr, coalesce(sum(1.0::DOUBLE / log2(rank + 1)) FILTER (WHERE rank <= k), 0.0::DOUBLE) AS dcg, coalesce(sum(nth::DOUBLE / rank) FILTER (WHERE rank <= k), 0.0::DOUBLE) AS aps FROM relsize CROSS JOIN (SELECT unnest([5, 10, 20]) AS k) LEFT JOIN found USING (item_id) GROUP BY ALL",
    "rm1": "SELECT *, hits::DOUBLE / relevant AS recall, hits::DOUBLE / k AS precision, (hits > 0)::BIGINT AS hit, dcg / list_sum(list_transform(range(1, least(relevant, k) + 1), lambda i: 1.0::DOUBLE / log2(i + 1))) AS ndcg, aps / least(relevant, k) AS ap FROM rm0",
    "rm": "SELECT *, CASE WHEN recall + precision > 0 THEN 2 * recall * precision / (recall + precision) ELSE 0.0::DOUBLE END AS f1 FROM rm1",
    # answers
    "conv": f"SELECT conv_id, turn, role, text, {tok('text')} AS tok FROM conversations",
    "ans": "SELECT a.conv_id, a.turn, a.text AS answer, b.text AS reference, a.tok AS ta, b.tok AS tb FROM conv a JOIN conv b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant'",
}

STEPS |= questions() | walks(14, 20)


def sql(body: str, extra: dict[str, str] | None = None) -> str:
    """body with the steps that it needs, each behind those that it needs itself."""
    steps, order = {**STEPS, **(extra or {})}, []

    def visit(text: str, above: tuple[str, ...]) -> None:
        for name in sorted(set(re.findall(r"(?:FROM|JOIN|,)\s+\(*([a-z_0-9]+)\b", text)) & steps.keys()):
            if name not in above and name not in order:
                visit(steps[name], (*above, name))
                order.append(name)

    visit(body, ())
    chain = ", ".join(f"{n} AS MATERIALIZED ({steps[n]})" for n in order)
    return (f"WITH RECURSIVE {chain} " if chain else "") + body
