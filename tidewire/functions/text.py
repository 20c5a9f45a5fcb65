"""Text functions as columns: normal form, hashes, shingles, titles and excerpts."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normalize(text: Column) -> Column:
    """Lower case, everything but letters, digits and blanks as a blank, blanks squeezed."""
    # one pass over runs; alternatives, and a second pass over the blanks, take several times as long
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "))


def tokens(text: Column) -> Column:
    """Words of the normal form; an empty text has none."""
    return F.array_remove(F.split(normalize(text), " "), "")


def content_hash(title: Column, body: Column) -> Column:
    """SHA-256 of the normal title and of that of the first 2,000 characters of the body."""
    return F.sha2(F.concat(normalize(title), F.lit(" "), normalize(F.substring(body, 1, 2000))), 256)


def shingles(w: Column, k: int = 5) -> Column:
    """Distinct shingles of ``k`` of the words ``w`` (a column, so that they are made once a row); fewer words are one."""
    some = F.transform(F.sequence(F.lit(1), F.size(w) - k + 1), lambda i: F.array_join(F.slice(w, i, k), " "))
    return F.when(F.size(w) == 0, F.array().cast("array<string>")).when(F.size(w) < k, F.array(F.array_join(w, " "))).otherwise(F.array_distinct(some))


def shingle_hashes(w: Column, k: int = 5) -> Column:
    """Hashes of the distinct shingles of ``k`` of the words ``w``: words are hashed once each, and shingles made of their hashes."""
    hashed = F.transform(w, lambda x: F.xxhash64(x))

    def whole(h: Column) -> Column:
        some = F.transform(F.sequence(F.lit(0), F.size(h) - k), lambda i: F.xxhash64(*(F.get(h, i + j) for j in range(k))))
        return F.when(F.size(h) == 0, F.array().cast("array<bigint>")).when(F.size(h) < k, F.array(F.xxhash64(h))).otherwise(some)

    # as a lambda's variable the hashes are made once
    return F.array_distinct(F.get(F.transform(F.array(hashed), whole), F.lit(0)))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two arrays as sets; 0 where either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def title_similarity(a: Column, b: Column) -> Column:
    return jaccard(F.array_distinct(tokens(a)), F.array_distinct(tokens(b)))


def differ_only_by_number(a: Column, b: Column) -> Column:
    """Titles alike but for their numbers: other news, not a copy."""
    bare = lambda x: F.trim(F.regexp_replace(F.regexp_replace(normalize(x), r"\d+", ""), r"\s+", " "))
    numbers = lambda x: F.array_join(F.regexp_extract_all(x, F.lit(r"(\d+)")), ",")
    return (bare(a) == bare(b)) & (numbers(a) != numbers(b))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.trim(F.coalesce(text, F.lit(""))), r"\s+"), lambda x: x != "")).cast("long")


def reading_minutes(words: Column) -> Column:
    return F.greatest(F.lit(1), F.round(words / 200)).cast("long")


def display_text(*choices: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in choices))


def cut(text: Column, most: int) -> Column:
    """At most ``most`` characters, cut at a blank, with an ellipsis where something is left out."""
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.regexp_replace(F.substring(text, 1, most), r"\s+\S*$", ""), F.lit("…")))


def clip_excerpt(text: Column, most: int = 280) -> Column:
    """The first two sentences where both fit, else the first; one that is too long is cut at a blank, with an ellipsis."""
    plain = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))

    def kept(parts: Column) -> Column:
        both = F.array_join(F.slice(parts, 1, 2), " ")
        return F.when(F.length(both) <= most, both).otherwise(F.get(parts, F.lit(0)))

    def clipped(said: Column) -> Column:
        head = F.regexp_replace(F.substring(said, 1, most - 1), r"\s\S*$", "")
        return F.when(F.length(said) <= most, said).otherwise(F.concat(F.regexp_replace(head, r"[ ,;:\-]+$", ""), F.lit("…")))

    # as lambdas' variables the sentences are made once, and no more of them than are looked at
    sentences = F.split(plain, r"(?<=[.!?])\s+", 3)
    return F.get(F.transform(F.transform(F.array(sentences), kept), clipped), F.lit(0))


def squash(text: Column) -> Column:
    """Letters and digits alone, in lower case."""
    return F.regexp_replace(F.lower(text), r"(?U)[\W_]+", "")


def dedupe_key(url: Column, excerpt: Column) -> Column:
    return F.sha2(F.concat(url, F.lit("|"), excerpt), 256)


ENTITY = r"&(?:#\d{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"


def unescape(text: Column) -> Column:
    """Named and numbered entities as characters, each once; unknown names stay, impossible numbers become the replacement character."""
    names = {name: chr(code) for name, code in name2codepoint.items()} | {"nbsp": " ", "apos": "'"}
    known = F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*map(F.lit, names.values())))

    def one(entity: Column) -> Column:
        digits = F.regexp_extract(entity, r"^&#[xX]?([0-9A-Fa-f]+);$", 1)
        code = F.conv(digits, 16, 10).cast("int")
        code = F.when(entity.rlike("^&#[xX]"), code).otherwise(digits.try_cast("int"))
        possible = (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
        character = F.when(possible, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise("\ufffd")
        return F.when(entity.startswith("&#"), character).otherwise(F.coalesce(F.try_element_at(known, F.regexp_extract(entity, r"^&(\w+);$", 1)), entity))

    def whole(t: Column) -> Column:
        replaced = F.transform(F.regexp_extract_all(t, F.lit(ENTITY), F.lit(0)), one)
        joined = F.array_join(F.zip_with(F.split(t, ENTITY), replaced, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
        return F.when(F.contains(t, F.lit("&")), joined).otherwise(t)

    # as a lambda's variable the text is made once, however often it is named
    return F.get(F.transform(F.array(text), whole), F.lit(0))


def strip_html(html: Column) -> Column:
    """Text of a page: no scripts, styles, comments or tags, and entities undone at most twice."""
    out = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    for _ in range(2):
        out = unescape(F.regexp_replace(out, r"<[^>]*>", " "))
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"<[^>]*>", " "), r"\s+", " "))


def strip_publisher(headline: Column, source: Column, head_chars: int = 25, tail_words: int = 6) -> Column:
    """Without a publisher's name after the last dash: part of the source's name, or a few words that aren't a sentence."""
    pattern = r"(?s)^(.*?)\s+[-–—|]\s+([^-–—|]{2,60})\s*$"
    head, tail = F.trim(F.regexp_extract(headline, pattern, 1)), F.trim(F.regexp_extract(headline, pattern, 2))
    bare = lambda x: F.regexp_replace(F.lower(x), "[^a-z0-9]+", "")
    of_source = F.coalesce((F.length(source) > 0) & (bare(tail) != "") & F.contains(bare(source), bare(tail)), F.lit(False))
    short = (word_count(tail) <= tail_words) & ~tail.rlike(r"[.!?:]$")
    return F.when((tail != "") & (F.length(head) >= head_chars) & (of_source | short), head).otherwise(headline)


# What a line of remarks about a translation looks like.
META_LINE = r"(?iu)^\s*(\(.*(çevir|translat).*\)|not[:\s].*|note[:\s].*)\s*$"


def clean_translation(source: Column, raw: Column) -> Column:
    """A translation without remarks around it, or null if it is out of proportion to its source; of a headline, the first line."""
    kept = F.filter(F.split(raw, r"\r\n|\r|\n"), lambda x: ~x.rlike(META_LINE))
    first = F.get(F.filter(kept, lambda x: F.trim(x) != ""), F.lit(0))
    text = F.when(F.length(source) <= 200, first).otherwise(F.array_join(kept, "\n"))
    blanks = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    text = blanks(F.regexp_replace(blanks(text), r"^[\"“”]+|[\"“”]+$", ""))
    return F.when((F.length(text) > 0) & (F.length(text) <= 4 * F.length(source) + 40), text)


def iso_date(value: Column) -> Column:
    """A date from an ISO string or its first ten characters, else null."""
    return F.coalesce(F.try_to_date(value, "yyyy-MM-dd"), F.try_to_date(F.substring(value, 1, 10), "yyyy-MM-dd"))


# What marks the two parts of an answer, and the progressive suffix that each vowel asks for.
HEADLINE, SUMMARY = r"(?iu)^\s*(?:HEADLINE|BAŞLIK|BASLIK)\s*:\s*", r"(?iu)^\s*(?:SUMMARY|ÖZET|OZET)\s*:\s*"
HARMONY = {"aıA": "ıyor", "eiEIİ": "iyor", "oOuU": "uyor", "öÖüÜ": "üyor"}


def labelled_pair(raw: Column) -> Column:
    """headline, summary (a struct) of an answer with labels: a line belongs to the last label; a part without lines is null."""
    lines = F.split(raw, r"\r\n|\r|\n")
    start = F.struct(F.lit(0).alias("part"), F.lit("").alias("headline"), F.lit("").alias("summary"))

    def step(said: Column, line: Column) -> Column:
        part = F.when(line.rlike(HEADLINE), 1).when(line.rlike(SUMMARY), 2).otherwise(said["part"])
        more = F.trim(F.regexp_replace(F.regexp_replace(line, HEADLINE, ""), SUMMARY, ""))
        joined = lambda n, old: F.when(part == n, F.trim(F.concat(old, F.lit(" "), more))).otherwise(old)
        return F.struct(part.alias("part"), joined(1, said["headline"]).alias("headline"), joined(2, said["summary"]).alias("summary"))

    found = F.aggregate(lines, start, step)
    return F.struct(F.nullif(found["headline"], F.lit("")).alias("headline"), F.nullif(found["summary"], F.lit("")).alias("summary"))


def vowel_harmony(text: Column) -> Column:
    """Progressive suffixes agree with the last vowel before them."""
    for vowels, suffix in HARMONY.items():
        stem = rf"(?U)([{vowels}][\w&&[^aeıioöuüAEIİOÖUÜ]]*)"
        text = F.regexp_replace(text, stem + "[ıiuü]yor", "$1" + suffix)
        text = F.regexp_replace(text, stem + "[IİUÜ]YOR", "$1" + suffix.upper())
    return text


def folded(text: Column) -> Column:
    """Lower case without the marks of Turkish letters, for a search that overlooks them."""
    return F.translate(F.lower(F.translate(text, "İI", "ii")), "çğıöşüâîû", "cgiosuaiu")


def once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """``rows`` with a column that is made once a row: as a generator's output it isn't written into the conditions on it."""
    return rows.select("*", F.explode(F.array(value)).alias(name))


def runs(ordered: Column, key: str) -> Column:
    """The runs of an ordered array of structs that share a field, as arrays; an empty array has none."""

    def of(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(s)), lambda i: (i == 0) | (i == F.size(s)) | (F.get(s, i)[key] != F.get(s, i - 1)[key]))
        # by their places, since a slice copies all of the array first
        cut_ = lambda at: F.transform(F.sequence(F.lit(0), F.size(at) - 2), lambda k: F.transform(F.sequence(F.get(at, k), F.get(at, k + 1) - 1), lambda j: F.get(s, j)))
        return F.get(F.transform(F.array(starts), cut_), F.lit(0))

    # as a lambda's variable the array is made once
    return F.flatten(F.transform(F.filter(F.array(ordered), lambda s: F.size(s) > 0), of))
