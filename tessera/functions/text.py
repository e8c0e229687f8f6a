"""Text expressions. All are built-in functions; patterns avoid \\w and \\b, which differ between engines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD, NO_WORD = r"[\p{L}\p{N}_]+", r"[^\p{L}\p{N}_]+"
MARK = "\x01"
#: Words that make a question factual or complex (Russian, then English), and words that are no keywords.
FACTUAL = (
    "кто|что|где|когда|сколько|какой|какая|какое|какие|название|организация"
    "|who|what|where|when|how much|which|name|organisation|organization|general"
)
COMPLEX = (
    "как|почему|зачем|влияние|связь|отличие|сравни|объясни"
    "|how|why|impact|relation|relationship|connection|compare|explain"
)
STOP_WORDS = [
    "the", "a", "an", "is", "are", "was", "were", "in", "on", "at", "to", "for", "of", "and", "or", "not", "by", "it", "its", "this", "that", "with", "from", "as",
    "do", "does", "did", "has", "have", "had", "what", "who", "where", "when", "how", "why", "which", "can", "will",
]


def norm(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def tokens(text: Column) -> Column:
    """Runs of letters, digits and underscores of the lower-cased text."""
    return F.regexp_extract_all(F.lower(norm(text)), F.lit(WORD), F.lit(0))


def normalized(text: Column) -> Column:
    return F.array_join(tokens(text), " ")


def whitespace_words(text: Column) -> Column:
    return F.filter(F.split(norm(text), r"[ \t\r\n\f]+"), lambda w: w != "")


def sentences(text: Column) -> Column:
    """Trimmed non-empty sentences: a full stop, exclamation or question mark before white space ends one."""
    parts = F.split(F.regexp_replace(norm(text), r"([.!?])[ \t\r\n\f]+", "$1" + MARK), MARK)
    return F.filter(F.transform(parts, lambda s: F.regexp_replace(s, r"^[ \t\r\n\f]+|[ \t\r\n\f]+$", "")), lambda s: s != "")


def query_class(text: Column) -> Column:
    """factual, complex or default; factual is tested first."""
    whole = lambda words: rf"(?iu)(^|[^\p{{L}}\p{{N}}_])({words})($|[^\p{{L}}\p{{N}}_])"
    return F.when(norm(text).rlike(whole(FACTUAL)), "factual").when(norm(text).rlike(whole(COMPLEX)), "complex").otherwise("default")


def keyword_words(text: Column) -> Column:
    """Distinct words longer than 2 that are no stop words, lower-cased, without ?.,! at the ends; the stop test comes before the trim."""
    long = F.filter(whitespace_words(text), lambda w: (F.length(w) > 2) & ~F.lower(w).isin(*STOP_WORDS))
    return F.array_distinct(F.transform(long, lambda w: F.regexp_replace(F.lower(w), r"^[?.,!]+|[?.,!]+$", "")))


def bound(f, *columns: Column) -> Column:
    """f(columns) with each column computed once, however often f and its lambdas use it."""
    row = F.struct(*[c.alias(f"c{i}") for i, c in enumerate(columns)])
    return F.get(F.transform(F.array(row), lambda r: f(*[r[f"c{i}"] for i in range(len(columns))])), F.lit(0))


def keyword_hits(words: Column, text: Column) -> Column:
    """How many of the words the lower-cased text contains as substrings."""
    return bound(lambda ws, low: F.size(F.filter(ws, lambda w: F.contains(low, w))), words, F.lower(norm(text)))


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(norm(text)) / 4).cast("long")


def chunk_number(chunk_id: Column) -> Column:
    """a:b:3 -> 3, chunk_001 -> 0; anything else as it is."""
    last = F.element_at(F.split(chunk_id, ":"), -1)
    labelled = F.regexp_extract(chunk_id, r"^chunk_([0-9]+)$", 1)
    return F.when(chunk_id.rlike(r"^[^:]*:[^:]*:[0-9]+$"), last).when(labelled != "", (labelled.cast("long") - 1).cast("string")).otherwise(chunk_id)


def concept_id(kind: Column, label: Column, word: Column) -> Column:
    return F.concat_ws("_", F.lit("concept"), F.upper(kind), F.upper(label), word)


def concept_word(node_id: Column) -> Column:
    return F.get(F.split(node_id, "_", 4), F.lit(3))


def language(text: Column) -> Column:
    """ru where more letters are Cyrillic than not, en for all else."""
    cyrillic = F.length(F.regexp_replace(norm(text), r"[^\p{IsCyrillic}]", ""))
    letters = F.length(F.regexp_replace(norm(text), r"[^\p{L}]", ""))
    return F.when(cyrillic * 2 > letters, "ru").otherwise("en")


def multiset_overlap(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two arrays."""
    count = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))
    return F.aggregate(F.array_intersect(a, b), F.lit(0), lambda n, x: n + F.least(count(a, x), count(b, x)))


def f_measure(overlap: Column, n_a: Column, n_b: Column) -> Column:
    """Harmonic mean of overlap/n_a and overlap/n_b; 0 without overlap."""
    return F.when((overlap > 0) & (n_a > 0) & (n_b > 0), 2.0 * overlap / (n_a + n_b)).otherwise(F.lit(0.0))


def token_f1(a: Column, b: Column) -> Column:
    return overlap_f1(tokens(a), tokens(b))


def overlap_f1(a: Column, b: Column) -> Column:
    """F-measure of the multiset intersection of two arrays."""
    return bound(lambda x, y: f_measure(multiset_overlap(x, y), F.size(x), F.size(y)), a, b)


def n_grams(words: Column, n: int) -> Column:
    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))


def output_tokens(requested: Column, context: Column, estimate: Column) -> Column:
    """max(16, min(requested, context - estimate - 16)); min(requested, 16) where the prompt alone overflows."""
    room = context - estimate - 16
    return F.when(room > 0, F.greatest(F.lit(16), F.least(requested, room))).otherwise(F.least(requested, F.lit(16)))


def prompt(question: Column, context: Column, run_id: Column | None = None) -> Column:
    body = F.when(norm(context) != "", F.concat(F.lit("Context:\n"), context, F.lit("\n\nQuestion: "), question, F.lit("\nAnswer:"))).otherwise(F.concat(F.lit("Question: "), question, F.lit("\nAnswer:")))
    return body if run_id is None else F.concat(F.lit("[run:"), run_id, F.lit("] "), body)


def retry_budget(error: Column) -> Column:
    """Tokens left for an answer by the limits that an error text states, less 16; null if under 16 or if a number is missing."""
    limit, used = (F.regexp_extract(error, pattern, 1).try_cast("long") for pattern in (r"maximum context length is ([0-9]+) tokens", r"prompt contains at least ([0-9]+) input tokens"))
    left = limit - used - 16
    return F.when(left >= 16, left)


def trigrams(word: Column) -> Column:
    """The three-letter pieces of a word with blanks between."""
    at = F.sequence(F.lit(1), F.greatest(F.length(word) - 2, F.lit(1)))
    return F.array_join(F.transform(at, lambda i: F.substring(word, i, 3)), " ")


def hashed_counts(text: Column, dim: int = 64) -> Column:
    """How often a text has tokens of each of dim hashed buckets."""
    buckets = F.transform(tokens(text), lambda t: (F.conv(F.substring(F.md5(t.cast("binary")), 1, 8), 16, 10).cast("long") % dim).cast("int"))
    return bound(lambda found: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.size(F.filter(found, lambda x: x == i)).cast("double")), buckets)
