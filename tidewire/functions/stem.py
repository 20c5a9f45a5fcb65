"""English stems and stop words as columns.

The stemmer is the published Snowball algorithm for English ("Porter 2"), one projection a step. Apply it to distinct terms: a vocabulary
is far smaller than the texts. Steps are SQL expressions over the column of the step before, so that DuckDB can answer
the registered queries alike; ``RLIKE(x, pattern)`` stands for either engine's test of a pattern.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The stop words of the English text search configuration.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them "
    "their theirs themselves what which who whom this that these those am is are was were be been being have has had having do does did doing "
    "a an the and but if or because as until while of at by for with about against between into through during before after above below to "
    "from up down in out on off over under again further then once here there when where why how all any both each few more most other some "
    "such no nor not only own same so than too very s t can will just don should now"
).split()

# Fixed values of the stemmer: words with stems of their own, words that stay, and words that stay after the first step.
SPECIAL = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
INVARIANT = ("sky", "news", "howe", "atlas", "cosmos", "bias", "andes")
INVARIANT_AFTER_1A = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
# Suffixes of the second and third step with what replaces them, and those that the fourth deletes.
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "ization": "ize", "izer": "ize", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al",
    "alli": "al", "fulness": "ful", "ousness": "ous", "ousli": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
STEP_3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ness": "", "ful": "", "ative": ""}
STEP_4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")
#: What must stand before a suffix for it to go, besides its region.
BEFORE = {"ogi": "l$", "li": "[cdeghkmnrt]$", "ion": "[st]$"}
SHORT = "(^[aeiouy][^aeiouy]$)|([^aeiouy][aeiouy][^aeiouywxY]$)"


def _ends(w: str, suffix: str) -> str:
    return f"right({w}, {len(suffix)}) = '{suffix}'"


def _less(w: str, n: int, more: str = "") -> str:
    """``w`` without its last n letters, and with others added."""
    head = f"substr({w}, 1, length({w}) - {n})"
    return f"concat({head}, '{more}')" if more else head


def _region(w: str, suffix: str, region: str) -> str:
    """Whether a suffix lies in a region, given by its start."""
    return f"length({w}) - {len(suffix)} >= {region}"


def _longest(w: str, suffixes: dict[str, str], region: str, in_r2: tuple[str, ...] = ()) -> str:
    """The longest suffix that a word has is replaced if it lies in its region and what stands before it allows it; a shorter one isn't tried."""
    cases = []
    for s in sorted(suffixes, key=len, reverse=True):
        asked = _region(w, s, "r2" if s in in_r2 else region)
        if s in BEFORE:
            asked += f" AND RLIKE({_less(w, len(s))}, '{BEFORE[s]}')"
        cases.append(f"WHEN {_ends(w, s)} THEN CASE WHEN {asked} THEN {_less(w, len(s), suffixes[s])} ELSE {w} END")
    return f"CASE {' '.join(cases)} ELSE {w} END"


def steps(term: str) -> list[tuple[str, str]]:
    """(column, expression) of each step from ``term``, a term in lower case; the last is ``stem``."""
    out: list[tuple[str, str]] = []
    add = lambda name, expression: out.append((name, expression))
    first = "'^(gener|commun|arsen)'"
    start = lambda x: f"CASE WHEN length(regexp_extract({x}, '^.*?[aeiouy][^aeiouy]', 0)) > 0 THEN length(regexp_extract({x}, '^.*?[aeiouy][^aeiouy]', 0)) ELSE length({x}) END"
    # a y that is no vowel is written Y
    add("w0", f"MARKED(CASE WHEN {term} LIKE 'y%' THEN concat('Y', substr({term}, 2)) ELSE {term} END)")
    add("r1", f"CASE WHEN RLIKE(w0, {first}) THEN length(regexp_extract(w0, {first}, 0)) ELSE {start('w0')} END")
    add("r2", f"r1 + {start('substr(w0, CAST(r1 AS INT) + 1)')}")
    add("w1a", f"CASE WHEN {_ends('w0', 'sses')} THEN {_less('w0', 2)} WHEN {_ends('w0', 'ied')} OR {_ends('w0', 'ies')} THEN CASE WHEN length(w0) > 4 THEN {_less('w0', 2)} ELSE {_less('w0', 1)} END "
        f"WHEN {_ends('w0', 'us')} OR {_ends('w0', 'ss')} THEN w0 WHEN RLIKE(w0, '[aeiouy].+s$') THEN {_less('w0', 1)} ELSE w0 END")  # fmt: skip
    add("cut", "CASE WHEN RLIKE(w1a, '(eed|eedly)$') THEN '' ELSE regexp_extract(w1a, '(ingly|edly|ing|ed)$', 0) END")
    add("base", "substr(w1a, 1, length(w1a) - length(cut))")
    again = f"CASE WHEN RLIKE(base, '(at|bl|iz)$') THEN concat(base, 'e') WHEN RLIKE(base, '(bb|dd|ff|gg|mm|nn|pp|rr|tt)$') THEN {_less('base', 1)} WHEN r1 >= length(base) AND RLIKE(base, '{SHORT}') THEN concat(base, 'e') ELSE base END"
    eed = lambda s: f"CASE WHEN {_region('w1a', s, 'r1')} THEN {_less('w1a', len(s), 'ee')} ELSE w1a END"
    add("w1b", f"CASE WHEN {_ends('w1a', 'eedly')} THEN {eed('eedly')} WHEN {_ends('w1a', 'eed')} THEN {eed('eed')} WHEN cut <> '' AND RLIKE(base, '[aeiouy]') THEN {again} ELSE w1a END")
    add("w1c", f"CASE WHEN RLIKE(w1b, '.[^aeiouy][yY]$') THEN {_less('w1b', 1, 'i')} ELSE w1b END")
    add("w2", _longest("w1c", STEP_2, "r1"))
    add("w3", _longest("w2", STEP_3, "r1", ("ative",)))
    add("w4", _longest("w3", dict.fromkeys(STEP_4, ""), "r2"))
    e = f"{_region('w4', 'e', 'r2')} OR ({_region('w4', 'e', 'r1')} AND NOT RLIKE({_less('w4', 1)}, '{SHORT}'))"
    add("w5", f"CASE WHEN {_ends('w4', 'e')} THEN CASE WHEN {e} THEN {_less('w4', 1)} ELSE w4 END WHEN {_ends('w4', 'll')} AND {_region('w4', 'l', 'r2')} THEN {_less('w4', 1)} ELSE w4 END")
    listed = lambda words: ", ".join(f"'{x}'" for x in words)
    special = " ".join(f"WHEN {term} = '{k}' THEN '{v}'" for k, v in SPECIAL.items())
    add("stem", f"CASE {special} WHEN {term} IN ({listed(INVARIANT)}) OR length({term}) <= 2 OR NOT RLIKE({term}, '^[a-z]+$') THEN {term} WHEN w1a IN ({listed(INVARIANT_AFTER_1A)}) THEN w1a ELSE replace(w5, 'Y', 'y') END")
    return out


def _marked(expression: str, replacement: str) -> str:
    """The first step with its function's arguments."""
    return expression.replace("MARKED(", "regexp_replace(").removesuffix(")") + f", '([aeiouy])y', {replacement})"


def stems(terms: DataFrame, term: str = "term") -> DataFrame:
    """``terms`` with ``stem``; terms that aren't of the letters a to z are their own stems."""
    out = terms
    for name, expression in steps(term):
        expression = _marked(expression, "'$1Y'") if name == "w0" else expression.replace("RLIKE(", "regexp_like(")
        out = out.withColumn(name, F.expr(expression))
    return out.select(*terms.columns, "stem")


def is_stop_word(term: Column) -> Column:
    return term.isin(STOP_WORDS)


def duckdb_stems(relation: str, term: str = "term") -> str:
    """The same as SQL for DuckDB: a subquery over ``relation`` with the column ``stem`` added."""
    sql = f"SELECT * FROM {relation}"
    for name, expression in steps(term):
        expression = _marked(expression, "'\\1Y', 'g'") if name == "w0" else expression.replace("RLIKE(", "regexp_matches(")
        sql = f"SELECT *, {expression} AS {name} FROM ({sql})"
    return sql
