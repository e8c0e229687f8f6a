"""English stems by suffix rules, as text of SQL expressions, which Spark and other engines read alike.

Every step is one CASE over the word x, so a list of words goes through the steps as a chain of list transforms and no expression is repeated in the next.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Runs of consonants and vowels (y is a vowel behind a consonant), and the tests on what is in front of a suffix.
C, V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
SOME, MANY, ONE = f"^({C})?{V}{C}", f"^({C})?{V}{C}{V}{C}", f"^({C})?{V}{C}({V})?$"
VOWEL, SHORT = f"^({C})?[aeiouy]", f"^{C}[aeiouy][^aeiouwxy]$|^[aeiou][^aeiou]$"
#: Words with stems of their own.
OWN = {"sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news", "innings": "inning", "inning": "inning", "outings": "outing", "outing": "outing", "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed", "exceed": "exceed", "succeed": "succeed"}
#: Suffixes and what they become, of the second and third step, and those that the fourth step drops.
SECOND = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"),
    ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("fulli", "ful"),
]
THIRD = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
FOURTH = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]
#: Words up to so many letters stay as they are. A word that is done has HELD in front.
LEAST, HELD = 3, "="


def steps(matches: str) -> list[str]:
    """The steps, as expressions over x; matches is the engine's function of (text, pattern)."""
    has = lambda suffix: f"right(x, {len(suffix)}) = '{suffix}'"
    front = lambda suffix: f"left(x, length(x) - {len(suffix)})"
    test = lambda text, pattern: f"{matches}({text}, '{pattern}')"
    rule = lambda suffix, to, pattern: f"WHEN {has(suffix)} THEN CASE WHEN {test(front(suffix), pattern)} THEN {front(suffix)} || '{to}' ELSE x END"
    case = lambda *rules: f"CASE WHEN left(x, 1) = '{HELD}' THEN x {' '.join(rules)} ELSE x END"

    def mended(y: str) -> str:
        double = f"length({y}) > 1 AND right({y}, 1) = left(right({y}, 2), 1) AND NOT {test(f'right({y}, 1)', '[aeiouy]')}"
        return f"CASE WHEN right({y}, 2) IN ('at', 'bl', 'iz') THEN {y} || 'e' WHEN {double} THEN CASE WHEN right({y}, 1) IN ('l', 's', 'z') THEN {y} ELSE left({y}, length({y}) - 1) END WHEN {test(y, ONE)} AND {test(y, SHORT)} THEN {y} || 'e' ELSE {y} END"

    own = " ".join(f"WHEN x = '{w}' THEN '{HELD}{s}'" for w, s in OWN.items())
    return [
        f"CASE WHEN length(x) <= {LEAST} THEN '{HELD}' || x {own} ELSE x END",
        case(f"WHEN {has('ies')} AND length(x) = 4 THEN {front('ies')} || 'ie'", f"WHEN {has('sses')} THEN {front('es')}", f"WHEN {has('ies')} THEN {front('es')}", f"WHEN {has('ss')} THEN x", f"WHEN {has('s')} THEN {front('s')}"),
        case(
            f"WHEN {has('ied')} THEN CASE WHEN length(x) = 4 THEN {front('d')} ELSE {front('ed')} END", rule("eed", "ee", SOME),
            f"WHEN {has('ed')} AND {test(front('ed'), VOWEL)} THEN {mended(front('ed'))}", f"WHEN {has('ing')} AND {test(front('ing'), VOWEL)} THEN {mended(front('ing'))}",
        ),
        case(f"WHEN {has('y')} AND length(x) > 2 AND NOT {test(f'right({front("y")}, 1)', '[aeiou]')} THEN {front('y')} || 'i'"),
        case(*[rule(s, to, SOME) for s, to in SECOND], f"WHEN {has('logi')} THEN CASE WHEN {test(front('ogi'), SOME)} THEN {front('i')} ELSE x END"),
        case(*[rule(s, to, SOME) for s, to in THIRD]),
        case(*[f"WHEN {has(s)} THEN CASE WHEN {test(front(s), MANY)} AND right({front(s)}, 1) IN ('s', 't') THEN {front(s)} ELSE x END" if s == "ion" else rule(s, "", MANY) for s in FOURTH]),
        case(f"WHEN {has('e')} THEN CASE WHEN {test(front('e'), MANY)} OR {test(front('e'), ONE)} AND NOT {test(front('e'), SHORT)} THEN {front('e')} ELSE x END"),
        case(f"WHEN {has('ll')} AND {test(front('l'), MANY)} THEN {front('l')}"),
        f"CASE WHEN left(x, 1) = '{HELD}' THEN right(x, length(x) - 1) ELSE x END",
    ]


def stems(words: str) -> Column:
    """The stems of the lower-case words of a list, given as the text of an expression."""
    for step in steps("regexp_like"):
        words = f"transform({words}, x -> {step})"
    return F.expr(words)
