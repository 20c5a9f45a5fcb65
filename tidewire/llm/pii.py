"""Surrogates for personal data.

Detected entities (e-mail addresses, telephone numbers, payment cards, IBANs, IPv4 and IPv6 addresses, social security
numbers, access tokens, and full or titled personal names) are replaced by surrogates of the same type and form, made from a keyed
SHA-256 of the entity's canonical form: digits for digits, letters of the same script for letters, a valid check digit
for a valid one, a first name of the same gender and script for a first name. Equal entities get equal surrogates in
all documents, also where they are written in another form; a surname alone gets the surrogate of its full name's.

Distinct entities must get distinct surrogates, none of which is itself an entity of the corpus. What is replaced as
one is a unit: an entity, or of a name its last part, and a first name within that (a listed one goes to another of its
list by a permutation for its surname, so it can't collide and is no unit). The table of distinct units is checked as a
whole; losers try again with the next attempt's hash, until none is left. No last part of a surrogate is a last part in
the corpus, so no name is. Attempts above zero are few, and are joined to the documents that hold such a unit.

Only Spark's own functions are used. Defined cases: null and empty texts have no entity and stay as they are; a null
document id is an id; an entity that repeats counts once to the check and is replaced everywhere; an empty table gives
an empty result; further columns are kept in the struct ``row`` of ``pseudonymise``, whatever their names.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import if_small, released, written

# First names by gender and script, and titles.
FEMALE = ("Anna", "Maria", "Elena", "Laura", "Julia", "Sophie", "Emma", "Claire", "Marie", "Carmen", "Lucia", "Ingrid", "Helga", "Alice", "Susan", "Karen", "Linda", "Nancy", "Olivia", "Rachel")
MALE = ("John", "James", "Robert", "Michael", "David", "Thomas", "Peter", "Paul", "Pierre", "Jean", "Hans", "Karl", "Carlos", "Miguel", "Antonio", "Henry", "George", "Edward", "Martin", "Steven")
FEMALE_CYRILLIC = ("Анна", "Мария", "Елена", "Ольга", "Татьяна", "Наталья", "Ирина", "Светлана")
MALE_CYRILLIC = ("Иван", "Пётр", "Сергей", "Алексей", "Дмитрий", "Андрей", "Михаил", "Николай")
TITLES = ("Mr.", "Mrs.", "Ms.", "Dr.", "Prof.", "Herr", "Frau", "Monsieur", "Madame", "Señor", "Señora")
LISTS = (FEMALE, MALE, FEMALE_CYRILLIC, MALE_CYRILLIC)
#: Words that two capitalised words before them, or after them, are a person's name to.
DOES, TO = ("met", "wrote", "signed", "emailed", "phoned", "resigned"), ("met", "Dear", "signed by", "written by", "emailed", "phoned")
_PAIR = r"\p{Lu}\p{Ll}+ \p{Lu}\p{Ll}+"

#: Types in the order in which they are tried, with what they look like. No pattern has a group that captures.
PATTERNS = {
    "email": r"[\p{L}\p{N}][\p{L}\p{N}._%+-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}",
    "ip": r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d)",
    # a short form has a digit or three groups, else it is a name of a programme's scope
    "ipv6": r"(?<![\w:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=[A-Fa-f:]*[0-9]|(?:[A-Fa-f]{1,4}::?){2}[A-Fa-f])(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}|(?=[A-Fa-f:]*[0-9])(?:[0-9A-Fa-f]{1,4}:){2,7}:)(?![\w:])",
    "iban": r"(?<!\w)[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?!\w)",
    "card": r"(?<![\w.])(?:\d{4}[ -]?){3}\d{4}(?!\w)",
    "ssn": r"(?<![\w.-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "phone": r"(?<![\w.])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?)\d{3,4}[ .-]?\d{4}(?!\w)|(?<!\w)\+\d{1,3}(?:[ .-]?\d{2,4}){2,4}(?!\w)|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-])|(?<![\w.-])0\d{2,4}[ /-]\d{5,8}(?![\w-])",
    "token": r"(?<![\w])(?:[0-9a-f]{32,}|[0-9A-F]{32,}|AKIA[0-9A-Z]{16}|sk-[A-Za-z0-9]{20,}|gh[pousr]_[A-Za-z0-9]{20,})(?!\w)",
    "name": r"(?<!\p{L})(?:(?:" + "|".join(t.replace(".", r"\.") for t in TITLES) + r") \p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+)?|(?:" + "|".join(n for names in LISTS for n in names) + r") \p{Lu}\p{Ll}+|(?<=\b(?:" + "|".join(TO) + r") )" + _PAIR + "|" + _PAIR + r"(?= (?:" + "|".join(DOES) + r")\b))(?!\p{L})",
}
ANY = "|".join(PATTERNS.values())
#: Without one of these there is no entity; saves the longer pattern on most texts.
HINT = r"[@0-9]|::|(?:[A-Fa-f]{1,4}:){7}|sk-|gh[pousr]_|[a-f]{32}|[A-F]{32}|AKIA|" + PATTERNS["name"]


def found(text: Column) -> Column:
    """The entities of a text in order, as they are written."""
    return F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))


def kind(raw: Column) -> Column:
    """Type of an entity that ``found`` gave."""
    out = F.lit("name")
    for name, pattern in reversed([x for x in PATTERNS.items() if x[0] != "name"]):
        out = F.when(raw.rlike(rf"^(?:{pattern})$"), F.lit(name)).otherwise(out)
    return out


def canonical(raw: Column) -> Column:
    """What makes two written forms one entity, after its type: digits of numbers (and a telephone number's plus), lower case otherwise."""
    k = kind(raw)
    digits = F.regexp_replace(raw, r"\D", "")
    return F.concat(k, F.lit(":"), F.when(k.isin("card", "ssn"), digits).when(k == "iban", F.replace(raw, F.lit(" "), F.lit(""))).when(k == "phone", F.concat(F.regexp_extract(raw, r"^\+", 0), digits)).when(k.isin("ip", "token"), raw).otherwise(F.lower(raw)))


def _byte(stream: Column, i: Column) -> Column:
    """The i-th byte of a hash of 64, in hexadecimal; starts again after the last."""
    return F.conv(F.substr(stream, (i % 64) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _pick(letters: str, at: Column) -> Column:
    return F.substr(F.lit(letters), at % len(letters) + 1, F.lit(1))


def _scrambled(raw: Column, stream: Column) -> Column:
    """Each digit by a digit, each letter by one of its case and script, the rest as it is."""
    chars = F.split(raw, "")
    latin, cyrillic = "abcdefghijklmnopqrstuvwxyz", "абвгдежзийклмнопрстуфхцчшщэюя"

    def one(c: Column, i: Column) -> Column:
        b = _byte(stream, i)
        return (
            F.when(c.rlike(r"^\d$"), _pick("0123456789", b))
            .when(c.rlike(r"^\p{IsCyrillic}$"), F.when(c.rlike(r"^\p{Lu}$"), F.upper(_pick(cyrillic, b))).otherwise(_pick(cyrillic, b)))
            .when(c.rlike(r"^\p{Lu}$"), F.upper(_pick(latin, b)))
            .when(c.rlike(r"^\p{L}$"), _pick(latin, b))
            .otherwise(c)
        )

    return F.array_join(F.transform(chars, one), "")


def _new_digits(digits: Column, stream: Column, keep: Column) -> Column:
    """``digits`` with all but the first ``keep`` replaced."""
    return F.array_join(F.transform(F.split(digits, ""), lambda c, i: F.when((i < keep) | (c == ""), c).otherwise(_pick("0123456789", _byte(stream, i)))), "")


def _luhn_sum(digits: Column, doubled: int) -> Column:
    """Sum of Luhn's check, doubling every second digit: from the right, ``doubled`` is 0 for the last and 1 for the one before it."""
    values = F.transform(F.reverse(F.split(F.regexp_replace(digits, r"\D", ""), "")), lambda c: F.coalesce(c.try_cast("int"), F.lit(0)))
    parts = F.transform(values, lambda d, i: F.when(i % 2 == doubled, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d))
    return F.aggregate(parts, F.lit(0), lambda a, b: a + b)


def _luhn(digits: Column, new: Column) -> Column:
    """``new`` with a valid check digit where ``digits`` has one."""
    body = F.substr(new, F.lit(1), F.length(new) - 1)
    check = (10 - _luhn_sum(body, 0) % 10) % 10
    return F.when(_luhn_sum(digits, 1) % 10 == 0, F.concat(body, check.cast("string"))).otherwise(new)


def _in_form(raw: Column, digits: Column, what: str = r"^\d$") -> Column:
    """``raw`` with its digits (or what else is named) replaced by ``digits`` one by one."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def step(a: Column, c: Column) -> Column:
        digit = c.rlike(what)
        return F.struct(F.concat(a["out"], F.when(digit, F.substr(digits, a["at"], F.lit(1))).otherwise(c)).alias("out"), (a["at"] + digit.cast("int")).alias("at"))

    return F.aggregate(F.split(raw, ""), start, step)["out"]


def _mod_97(chars: Column) -> Column:
    """Remainder of a string of digits and capitals as a number, letters being 10 to 35."""

    def step(a: Column, c: Column) -> Column:
        digit = c.rlike(r"^\d$")
        return F.when(digit, a * 10 + F.coalesce(c.try_cast("int"), F.lit(0))).otherwise(a * 100 + F.ascii(c) - 55) % 97

    return F.aggregate(F.split(chars, ""), F.lit(0), step)


def _new_iban(plain: Column, stream: Column) -> Column:
    """An IBAN of the same country and form, with valid check digits where ``plain`` has them."""
    country = F.substring(plain, 1, 2)
    account = _scrambled(F.substr(plain, F.lit(5)), stream)
    valid = F.lpad((98 - _mod_97(F.concat(account, country, F.lit("00")))).cast("string"), 2, "0")
    own = _mod_97(F.concat(F.substr(plain, F.lit(5)), F.substring(plain, 1, 4))) == 1
    return F.concat(country, F.when(own, valid).otherwise(_new_digits(F.substring(plain, 3, 2), stream, F.lit(0))), account)


def _keyed(key: str, names: tuple[str, ...]) -> list[str]:
    """``names`` in an order that the key decides."""
    return sorted(names, key=lambda n: hashlib.sha256(f"{key}|order|{n}".encode()).digest())


def _pronounceable(part: Column, unit: Column, key: str, attempt: Column) -> Column:
    """A name of the script of ``part``, of four syllables and one more for every second attempt."""
    stream = F.sha2(F.concat(F.lit(f"{key}|part|"), unit, F.lit("|"), attempt.cast("string")), 512)
    syllables = F.sequence(F.lit(0), F.lit(3) + F.floor(attempt / 2).cast("int"))

    def of(consonants: str, vowels: str) -> Column:
        return F.initcap(F.array_join(F.transform(syllables, lambda i: F.concat(_pick(consonants, _byte(stream, 2 * i)), _pick(vowels, _byte(stream, 2 * i + 1)))), ""))

    return F.when(part.rlike(r"^\p{IsCyrillic}"), of("бвгдклмнпрст", "аеиоу")).otherwise(of("bdfgklmnprstvz", "aeiou"))


def _first_unit(first: Column, last: Column) -> Column:
    return F.concat(F.lit("first:"), F.lower(last), F.lit(" "), F.lower(first))


def _last_unit(last: Column) -> Column:
    return F.concat(F.lit("last:"), F.lower(last))


def _parts(raw: Column) -> tuple[Column, Column, Column]:
    """Title, first part and last part of a name; the first two may be null."""
    parts = F.split(raw, " ")
    titled = F.get(parts, F.lit(0)).isin(*TITLES)
    first = F.get(parts, F.size(parts) - 2)
    return F.when(titled, F.get(parts, F.lit(0))), F.when(F.size(parts) - titled.cast("int") == 2, first), F.get(parts, F.size(parts) - 1)


def units(raw: Column) -> Column:
    """What is replaced as one of an entity: array of struct<unit, form>."""
    unit = lambda u, form: F.struct(u.alias("unit"), form.alias("form"))
    _, first, last = _parts(raw)
    unlisted = first.isNotNull() & ~first.isin(*(n for names in LISTS for n in names))
    of_name = F.when(unlisted, F.array(unit(_last_unit(last), last), unit(_first_unit(first, last), first))).otherwise(F.array(unit(_last_unit(last), last)))
    return F.when(kind(raw) == "name", of_name).otherwise(F.array(unit(canonical(raw), raw)))


def _first(first: Column, last: Column, key: str, attempt: Column) -> Column:
    """A listed name becomes another of its list, by a permutation for each surname; any other a pronounceable one."""
    out = _pronounceable(first, _first_unit(first, last), key, attempt)
    move = _byte(F.sha2(F.concat(F.lit(f"{key}|first|"), F.lower(last)), 512), F.lit(0))
    for names in LISTS:
        order = F.array(*map(F.lit, _keyed(key, names)))
        out = F.when(first.isin(*names), F.get(order, ((F.array_position(order, first) + move % (len(names) - 1)) % len(names)).cast("int"))).otherwise(out)
    return out


def listed_lasts(found_lasts: set[str], key: str) -> dict[str, str]:
    """Surrogates of last parts that are listed first names, by the names of their list that the corpus has not as last parts; those without get none."""
    out = {}
    for names in LISTS:
        order = _keyed(key, names)
        out.update(zip([n for n in order if n in found_lasts], [n for n in order if n not in found_lasts]))  # noqa: B905
    return out


def _last(last: Column, key: str, attempt: Column, listed: dict[str, str]) -> Column:
    out = _pronounceable(last, _last_unit(last), key, attempt)
    if listed:
        out = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in listed.items() for x in kv)), last), out)
    return out


def surrogate_of_name(raw: Column, key: str, attempt_of, listed: dict[str, str]) -> Column:
    """A title stays; ``attempt_of`` gives the attempt of a unit."""
    title, first, last = _parts(raw)
    return F.concat_ws(" ", title, F.when(first.isNotNull(), _first(first, last, key, attempt_of(_first_unit(first, last)))), _last(last, key, attempt_of(_last_unit(last)), listed))


#: Country codes of one and two digits; all others have three.
COUNTRY = r"^\+(?:[17]|2[07]|3[0123469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
#: Attempts of a number in its own form (half of them with its country code) before it gets longer.
IN_FORM = 16
#: Attempts of an IPv6 address in its own form, which may be a short one, before it gets all its groups.
SHORT_FORM = 4


def surrogate(raw: Column, key: str, attempt: Column) -> Column:
    """The replacement of an entity that isn't a name at an attempt. The form grows with the attempt, so forms don't run out."""
    k, c = kind(raw), canonical(raw)
    stream = F.sha2(F.concat(F.lit(f"{key}|"), c, F.lit("|"), attempt.cast("string")), 512)
    digits = F.regexp_replace(raw, r"\D", "")
    country = F.when(attempt >= IN_FORM // 2, 0).otherwise(F.greatest(F.length(F.regexp_extract(F.substring_index(c, ":", -1), COUNTRY, 0)) - 1, F.lit(0)))
    octet = lambda i: (_byte(stream, F.lit(i)) % (223 if i == 0 else 256) + (1 if i == 0 else 0)).cast("string")
    more = F.greatest(attempt - IN_FORM, F.lit(0))
    longer = F.when(more > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(more, F.lit(1))), lambda i: _pick("0123456789", _byte(stream, 63 - i % 32))), "")).otherwise("")
    local = F.substring_index(F.lower(raw), "@", 1)
    # a local part of n letters grows from the n-th attempt on
    grown = F.rpad(local, F.greatest(F.length(local), attempt + 1), "a")
    email = F.concat(_scrambled(grown, stream), F.lit("@"), F.get(F.array(*map(F.lit, ("example.com", "example.net", "example.org"))), _byte(stream, F.lit(63)) % 3))
    hexed = F.array_join(F.transform(F.split(raw, ""), lambda x, i: F.when(x.rlike("^[0-9a-f]$"), _pick("0123456789abcdef", _byte(stream, i))).when(x.rlike("^[0-9A-F]$"), _pick("0123456789ABCDEF", _byte(stream, i))).otherwise(x)), "")
    # digits stay digits, so that a short address goes on to look like one; in the end it has all its groups
    groups = F.concat_ws(":", *(F.concat(*(_pick("0123456789abcdef", _byte(stream, F.lit(4 * g + d))) for d in range(4))) for g in range(8)))
    ipv6 = F.when(attempt >= SHORT_FORM, groups).otherwise(F.array_join(F.transform(F.split(raw, ""), lambda x, i: F.when(x.rlike("^[0-9]$"), _pick("0123456789", _byte(stream, i))).when(x.rlike("^[a-f]$"), _pick("abcdef", _byte(stream, i))).when(x.rlike("^[A-F]$"), _pick("ABCDEF", _byte(stream, i))).otherwise(x)), ""))
    token = F.when(raw.rlike("^[0-9a-f]+$") | raw.rlike("^[0-9A-F]+$"), hexed).otherwise(F.concat(F.regexp_extract(raw, "^(?:AKIA|sk-|gh._)", 0), _scrambled(F.regexp_replace(raw, "^(?:AKIA|sk-|gh._)", ""), stream)))
    return (
        F.when(k == "email", email)
        .when(k == "ip", F.concat(F.concat_ws(".", *(octet(i) for i in range(4))), F.when(more > 0, F.concat(F.lit("."), longer)).otherwise("")))
        .when(k == "ipv6", ipv6)
        .when(k == "iban", _in_form(raw, _new_iban(F.substring_index(c, ":", -1), stream), "^[0-9A-Z]$"))
        .when(k == "card", F.concat(_in_form(raw, _luhn(digits, _new_digits(digits, stream, F.lit(1)))), longer))
        .when(k == "phone", F.concat(_in_form(raw, _new_digits(digits, stream, country)), longer))
        .when(k == "ssn", F.concat(_in_form(raw, _new_digits(digits, stream, F.lit(0))), longer))
        .otherwise(F.concat(token, longer))
    )


def mentions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """holder (a document's id) and units (struct<unit, form>, distinct) of each document that has an entity."""
    entities = docs.select(F.col(id_col).alias("holder"), found(F.col(text_col)).alias("entities")).filter(F.size("entities") > 0)
    return written(entities.select("holder", F.array_distinct(F.flatten(F.transform("entities", units))).alias("units")), "mentions")


def resolved(held: DataFrame, key: str) -> tuple[DataFrame, dict[str, str]]:
    """unit, form (its least written one), attempt and surrogate of every distinct unit of ``mentions``, and the surrogates of listed last parts."""
    distinct = written(held.select(F.explode("units").alias("u")).select("u.*").groupBy("unit").agg(F.min("form").alias("form")), "units")
    # a surrogate is much work for a row of few bytes, so rows are dealt out by number
    parts = int(held.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = distinct.repartition(parts, "unit")
    names = [n for names in LISTS for n in names]
    listed = listed_lasts({r.form for r in distinct.filter(F.col("unit").startswith("last:") & F.col("form").isin(*names)).collect()}, key)

    def made(attempt: Column) -> Column:
        unit, form = F.col("unit"), F.col("form")
        return F.when(unit.startswith("last:"), _last(form, key, attempt, listed)).when(unit.startswith("first:"), _pronounceable(form, unit, key, attempt)).otherwise(surrogate(form, key, attempt))

    def as_unit() -> Column:
        unit, new = F.col("unit"), F.col("surrogate")
        first = F.concat(F.substring_index(unit, " ", 1), F.lit(" "), F.lower(new))
        return F.when(unit.startswith("last:"), _last_unit(new)).when(unit.startswith("first:"), first).otherwise(canonical(new))

    table = written(dealt.withColumn("attempt", F.lit(0)).withColumn("surrogate", made(F.col("attempt"))), "surrogates")
    while True:
        keyed = table.withColumn("as_unit", as_unit())
        taken = keyed.groupBy("as_unit").agg(F.count("*").alias("n"), F.min(F.struct("attempt", "unit"))["unit"].alias("winner")).filter("n > 1").select("as_unit", "winner")
        shared = keyed.join(taken, "as_unit").filter("unit <> winner").select(F.col("unit").alias("loser"))
        existing = keyed.join(table.select(F.col("unit").alias("as_unit")), "as_unit", "left_semi").select(F.col("unit").alias("loser"))
        losers = written(shared.unionByName(existing).distinct(), "collisions")
        if losers.isEmpty():
            return table, listed
        again = F.col("attempt") + F.when(F.col("loser").isNotNull(), 1).otherwise(0)
        moved = table.join(losers, F.col("unit") == F.col("loser"), "left").select("unit", "form", again.alias("attempt"), "surrogate", "loser")
        table = written(moved.select("unit", "form", "attempt", F.when(F.col("loser").isNotNull(), made(F.col("attempt"))).otherwise(F.col("surrogate")).alias("surrogate")), "surrogates")


def pseudonymise(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row (a struct of a row's own columns), new_text (its text with surrogates) and n_entities.

    Texts are shuffled only where the units that had to try again are in too many documents for a broadcast.
    """
    held = mentions(docs, id_col, text_col)
    table, listed = resolved(held, key)
    retried = table.filter("attempt > 0").select("unit", "attempt")
    tries = held.select("holder", F.explode(F.col("units")["unit"]).alias("unit")).join(retried, "unit").groupBy("holder").agg(F.map_from_entries(F.collect_set(F.struct("unit", "attempt"))).alias("attempts"))
    tries = if_small(written(tries, "attempts"))
    released(held, table)
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("whole"))
    joined = own.join(tries, F.col("id").eqNullSafe(F.col("holder")), "left").withColumn("entities", F.coalesce(found(F.col("whole")), F.array().cast("array<string>")))
    attempt = lambda unit: F.when(F.col("attempts").isNull(), F.lit(0)).otherwise(F.coalesce(F.try_element_at("attempts", unit), F.lit(0)))
    between = F.split("whole", ANY)
    new = F.transform("entities", lambda raw: F.when(kind(raw) == "name", surrogate_of_name(raw, key, attempt, listed)).otherwise(surrogate(raw, key, attempt(canonical(raw)))))
    text = F.when(F.size("entities") == 0, F.col("whole")).otherwise(F.array_join(F.zip_with(between, new, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), ""))
    return joined.select("row", text.alias("new_text"), F.size("entities").cast("long").alias("n_entities"))
