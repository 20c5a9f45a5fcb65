"""Operators against brute-force versions and on nulls, empty texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import itertools
import re
import textwrap

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewire.llm import chat_windows, components, lattice, licenses, line_dedup, mixing, ngram_join, packing, pii, quality_classifier, robust_outliers

DOC = "doc_id long, text string, lang string, source string, row string, n long, label string"


def docs(spark, *texts, ids=None):
    """Documents with columns whose names clash with those that operators use inside."""
    return spark.createDataFrame([((ids or range(1, len(texts) + 1))[i], t, "en", "s", "r", 7, "x") for i, t in enumerate(texts)], DOC)


ODD = (None, "", " \n ", "one word", "one word", "long " * 30_000)


@pytest.mark.parametrize("rows", [(), ODD], ids=["empty", "odd"])
def test_every_operator_takes_odd_tables(spark, rows):
    d, n = docs(spark, *rows), len(rows)
    labels = spark.createDataFrame([], "doc_id long, quality int")
    # collected, so that every column is computed
    assert len(robust_outliers.robust_outliers(d).collect()) == n
    assert len(licenses.scan(d, licenses.known_licenses(spark)).collect()) == n
    assert len(packing.pack(d).collect()) >= 0
    assert len(line_dedup.apply_bitmaps(d, line_dedup.keep_bitmaps(d)).collect()) == n
    assert len(ngram_join.near_duplicates(d).collect()) == n
    assert [r.new_text for r in pii.pseudonymise(d, "key").collect()] == [t for t in rows]
    assert len(mixing.mix(d).collect()) == n
    assert all(0 <= r.score <= 1 for r in quality_classifier.rank(d, labels).collect())


def test_statistics_of_texts(spark):
    text = "a b c\na b c\n\n#x" + " y" * 3
    row = robust_outliers.robust_outliers(docs(spark, text)).first()
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    again = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 3)}
    assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == (len(words), sum(map(len, words)), 1, 1, len(again))
    assert row.base_failed and not row.kept


def test_outliers_are_found_and_clean_documents_stay(spark):
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("abcdefghij"), rng.integers(3, 9))) for _ in range(500)]
    texts = [" ".join(rng.choice(words, rng.integers(80, 160))) for _ in range(300)] + ["#$% " * 40 + " ".join(rng.choice(words, 60))]
    kept = {r.doc_id: r.kept for r in robust_outliers.robust_outliers(docs(spark, *texts)).collect()}
    assert not kept[301] and sum(kept.values()) >= 297


def test_few_documents_are_judged_by_all(spark):
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("abcdefghij"), rng.integers(3, 9))) for _ in range(500)]
    texts = [" ".join(rng.choice(words, rng.integers(80, 160))) for _ in range(300)] + ["#$% " * 40 + " ".join(rng.choice(words, 60)), " ".join(rng.choice(words, 100))]
    rows = [(i, t, "en" if i < 300 else "xx", "s" if i < 300 else None) for i, t in enumerate(texts)]
    found = robust_outliers.robust_outliers(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    got = {r.doc_id: r for r in found.collect()}
    assert got[300].stratum == got[301].stratum == robust_outliers.ALL and not got[300].kept and got[301].kept
    few = robust_outliers.robust_outliers(docs(spark, *texts[:7], "#$% " * 400 + texts[0])).collect()
    assert all(r.base_failed or r.distance is not None for r in few)


def test_equal_documents_are_no_outliers(spark):
    """Constant statistics: no spread at all."""
    text = " ".join(f"w{i}" for i in range(80))
    assert all(r.kept for r in robust_outliers.robust_outliers(docs(spark, *[text] * 120)).collect())


def test_verdicts_against_a_plain_estimate(spark):
    """Distances from a plain minimum-determinant estimate over the same transformed statistics."""
    rng = np.random.default_rng(6)
    words = ["".join(rng.choice(list("abcdefghij"), rng.integers(3, 9))) for _ in range(800)]
    texts = [" ".join(rng.choice(words, rng.integers(70, 260))) for _ in range(240)] + ["## " * rng.integers(20, 60) + " ".join(rng.choice(words, 90)) for _ in range(12)] + [" ".join(w * 6 for w in rng.choice(words, 80)) for _ in range(6)]
    found = robust_outliers.robust_outliers(docs(spark, *texts)).collect()
    of = sorted((r for r in found if not r.base_failed), key=lambda r: r.doc_id)
    lines = 1
    x = np.array([[np.log(r.n_words), np.log(r.word_chars / r.n_words), np.log1p(r.n_symbols / r.n_words), r.n_dup_lines / lines, r.n_repeat_words / r.n_words] for r in of])
    floor, size = np.diag(np.square(robust_outliers.FLOORS)), int(np.ceil(0.75 * len(x)))
    best = None
    for start in range(30):
        chosen = np.random.default_rng(start).choice(len(x), size, replace=False)
        for _ in range(40):
            centre, cov = x[chosen].mean(0), np.cov(x[chosen].T, bias=True) + floor
            d = np.einsum("ij,jk,ik->i", x - centre, np.linalg.inv(cov), x - centre)
            chosen = np.argsort(d)[:size]
        det = np.linalg.slogdet(np.cov(x[chosen].T, bias=True) + floor)[1]
        if best is None or det < best[0]:
            best = det, d
    d = best[1] / max(1.0, np.median(best[1]) / robust_outliers.chi_square_quantile(0.5))
    limit = robust_outliers.chi_square_quantile(1 - robust_outliers.TAIL)
    clear = np.abs(d / limit - 1) > 0.25  # apart from what is close to the limit
    assert [r.kept for r, c in zip(of, clear, strict=True) if c] == (d <= limit)[clear].tolist()
    assert sum(not r.kept for r in of) >= 12


def test_licences_are_found_in_other_spellings(spark):
    mit = licenses.KNOWN["MIT"]
    texts = ("Copyright (c) 2020 Somebody\n" + mit.upper().replace(",", " ;"), mit + " and more", "Text\nreleased under the MIT Licence\nmore", None)
    found = {r.doc_id: (r.text_license, r.line_licenses) for r in licenses.scan(docs(spark, *texts), licenses.known_licenses(spark)).collect()}
    assert found[1][0] == "MIT" and found[2][0] is None and found[3] == (None, "MIT-notice") and found[4] == (None, "")


def test_whole_licence_files_are_found(spark):
    texts = dict(licenses.known_texts()[::-1])
    full = lambda k: (licenses.TEXTS / f"{k}.txt").read_text()
    wrapped = lambda t: "\n\n".join(textwrap.fill(" ".join(p.split()), 61) for p in t.split("\n\n"))
    bsd3 = texts["BSD-3-Clause"].replace("the copyright holder nor", "Foo Bar, Inc. nor").replace("THE COPYRIGHT HOLDER OR CONTRIBUTORS BE", "FOO BAR, INC. BE").replace("Redistributions", "* Redistributions").replace("Neither", "* Neither")
    cases = [
        ("MIT", "MIT License\n\nCopyright (c) 2020 X\n\n" + wrapped(licenses.KNOWN["MIT"]) + "\n"),
        ("MIT", "The MIT License (MIT)\r\n\r\nCopyright JS Foundation and other contributors\r\n\r\n" + licenses.KNOWN["MIT"].replace("\n", "\r\n")),
        ("ISC", "ISC License\n\nCopyright (c) 2004-2010 by Internet Systems Consortium\nCopyright Isaac Z. Schlueter and Contributors\n\n" + licenses.KNOWN["ISC"].replace("THE AUTHOR BE", "ISC BE")),
        ("BSD-2-Clause", "BSD 2-Clause License\n\nCopyright (c) 2019, X\nAll rights reserved.\n\n" + wrapped(licenses.KNOWN["BSD-2-Clause"])),
        ("BSD-3-Clause", 'BSD 3-Clause "New" License\n\nCopyright 2019 Foo Bar, Inc. All rights reserved.\n\n' + wrapped(bsd3)),
        ("Zlib", "zlib License\n\n(C) 1995-2022 Jean-loup Gailly and Mark Adler\n\n" + wrapped(full("Zlib"))),
        ("Unlicense", "The Unlicense\n\n" + full("Unlicense")),
        ("Apache-2.0", full("Apache-2.0").replace("[yyyy] [name of copyright owner]", "2021 Foo").replace("http:", "https:")),
        ("Apache-2.0", wrapped(full("Apache-2.0").partition("END OF TERMS")[0])),
        ("GPL-2.0", full("GPL-2.0").replace("51 Franklin Street, Fifth Floor, Boston, MA 02110-1301", "59 Temple Place, Suite 330, Boston, MA  02111-1307")),
    ] + [(p.stem, wrapped(p.read_text().replace("Copyright (C)", "\n\nCopyright (C)"))) for p in licenses.TEXTS.glob("*.txt") if "Copyright (C)" not in p.read_text()] + [(p.stem, p.read_text()) for p in licenses.TEXTS.glob("*.txt")]
    others = ["Foo License\n\n" + licenses.KNOWN["MIT"], licenses.KNOWN["MIT"].replace("free of charge", "for a fee"), "MIT License", "Copyright (c) 2020 X\nAll rights reserved."]
    got = {r.doc_id: r.text_license for r in licenses.scan(docs(spark, *(t for _, t in cases), *others), licenses.known_licenses(spark)).collect()}
    assert [got[i] for i in range(1, len(cases) + 1)] == [k for k, _ in cases]
    assert [got[i] for i in range(len(cases) + 1, len(got) + 1)] == [None] * len(others)


def test_packing_is_whole_and_within_capacity(spark):
    sizes = [1, 3, 255, 256, 257, 700, 4095, 4096, 4097, 9000, 40, 40]
    rows = packing.pack(docs(spark, *("w " * n for n in sizes))).collect()
    by_doc, by_bin = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append((r.start, r.length))
        by_bin.setdefault((r.bin_id, r.bin_capacity), []).append((r.bin_offset, r.length))
    for i, n in enumerate(sizes, 1):
        assert sum(length for _, length in by_doc[i]) == n
    for (_, capacity), parts in by_bin.items():
        parts.sort()
        assert all(a + n == b for (a, n), (b, _) in itertools.pairwise(parts))
        used = sum(n for _, n in parts)
        assert used <= capacity and capacity == min(c for c in packing.LENGTHS if c >= used)


def test_lattice_points_are_the_nearest():
    x = np.random.default_rng(0).normal(size=(50, 8)) * 2
    points = lattice.decode(x)
    offers = points[:, None] + lattice.neighbours()[None]
    assert (((x - points) ** 2).sum(1) <= ((x[:, None] - offers) ** 2).sum(2).min(1) + 1e-9).all()


def linked(vectors, least=0.9):
    """Links, and the least index that each vector reaches."""
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    near = unit @ unit.T >= least
    np.fill_diagonal(near, False)
    component = np.arange(len(vectors))
    while True:
        least_of = np.array([min([component[i], *component[np.flatnonzero(near[i])]]) for i in range(len(vectors))])
        if (least_of == component).all():
            return near, component
        component = least_of


def test_embeddings_against_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 16))
    vectors = np.r_[base, base[:20] + rng.normal(size=(20, 16)) * 0.1, base[:5], np.repeat(base[:1], 30, 0) + rng.normal(size=(30, 16)) * 0.05]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [None] * 16)]
    got = {r.vec_id: r for r in lattice.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    near, component = linked(vectors)
    links = near.sum(1)
    found = np.array([got[i].n_links for i in range(len(vectors))])
    assert (found <= links).all() and found.sum() >= 0.95 * links.sum()
    assert [got[i].component_id for i in range(len(vectors))] == component.tolist()
    assert [got[i].kept for i in range(len(vectors))] == (component == np.arange(len(vectors))).tolist()
    assert all(got[i].n_links == 0 and got[i].kept and got[i].component_id == i for i in (900, 901, 902, 903))


def test_pairs_near_the_limit_are_found(spark):
    """Partners planted at cosines from 0.86 to 0.95."""
    rng = np.random.default_rng(8)
    base = rng.normal(size=(120, 32))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    other = rng.normal(size=base.shape)
    other -= (other * base).sum(1, keepdims=True) * base
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    cosines = np.repeat([0.86, 0.89, 0.905, 0.92, 0.935, 0.95], 20)[:, None]
    vectors = np.r_[base, cosines * base + np.sqrt(1 - cosines**2) * other]
    got = {r.vec_id: r for r in lattice.near_duplicates(spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")).collect()}
    near, _ = linked(vectors)
    found = np.array([got[i].n_links for i in range(len(vectors))])
    assert (found <= near.sum(1)).all() and found.sum() >= 0.95 * near.sum()
    assert all(got[i].n_links == 0 for i in range(40)) and near.sum() == 160


def test_every_row_is_a_vector(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.0]), (None, [0.5, 0.5]), (None, None), (3, [0.0, 2.0]), (4, [1.0])]
    table = spark.createDataFrame([(*r, "x", 9) for r in rows], "vec_id long, embedding array<double>, rep string, component long")
    got = sorted(((r.vec_id or -1, r.n_links, r.component_id or -1, r.kept) for r in lattice.near_duplicates(table).collect()))
    assert got == sorted([(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (-1, 0, -1, True), (-1, 0, -1, True), (3, 1, 1, False), (4, 0, 4, True)])
    assert lattice.near_duplicates(table.limit(0)).collect() == []


def kept_lines(texts):
    """Plain version of the line rule over {doc_id: text}."""
    key = lambda s: s.strip(" \t\n\x0b\x0c\r").translate({i: i + 32 for i in range(65, 91)})
    holders = {}
    for d, t in texts.items():
        for line in (t or "").split("\n"):
            holders.setdefault(key(line), set()).add(d)
    lost = lambda d, s: len(key(s)) >= 20 and len(holders[key(s)]) >= 3 and d != max(holders[key(s)])
    return {d: "\n".join(s for s in (t or "").split("\n") if not lost(d, s)) for d, t in texts.items()}


def test_lines_against_plain_version(spark):
    rng = np.random.default_rng(5)
    pool = [f"Line number {i} of a common pool" for i in range(6)] + ["short", "", "  LINE number 1 of a common POOL \t"]
    texts = {i: "\n".join(rng.choice(pool, rng.integers(0, 8))) or None for i in range(60)}
    d = docs(spark, *texts.values(), ids=list(texts))
    got = {r.row.doc_id: r.kept_text for r in line_dedup.apply_bitmaps(d, line_dedup.keep_bitmaps(d)).collect()}
    assert got == kept_lines(texts)


def test_texts_of_one_id_keep_their_own_lines(spark):
    line = "a line that four documents hold"
    rows = [(1, f"{line}\nx", "mine"), (1, "precious unique content\nx", "mine"), (2, line, "mine"), (3, line, "mine"), (None, line, "mine")]
    d = spark.createDataFrame(rows, "doc_id long, text string, kept_text string")
    got = line_dedup.apply_bitmaps(d, line_dedup.keep_bitmaps(d)).collect()
    assert sorted((r.row.doc_id or 0, r.kept_text) for r in got) == [(0, line), (1, "precious unique content\nx"), (1, "x"), (2, ""), (3, line)]
    assert {r.row.kept_text for r in got} == {"mine"}


def test_lines_across_range_partitions(spark, monkeypatch):
    """One key in all documents, streamed in many partitions."""
    monkeypatch.setattr(line_dedup, "PARTITION_ROWS", 7)
    texts = {i: f"the same line in each of them\nan own line of number {i}" for i in range(100)}
    d = docs(spark, *texts.values(), ids=list(texts))
    assert {r.row.doc_id: r.kept_text for r in line_dedup.apply_bitmaps(d, line_dedup.keep_bitmaps(d)).collect()} == kept_lines(texts)


def test_jaccard_against_brute_force(spark):
    rng = np.random.default_rng(7)
    base = [list(rng.choice([f"w{i}" for i in range(300)], 80)) for _ in range(6)]
    texts = ["Few words", "few WORDS", None, ""]
    for words in base:
        for k in range(8):
            w = list(words)
            for _ in range(k // 2):
                w[rng.integers(len(w))] = f"x{rng.integers(1000)}"
            texts.append(" ".join(w))
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    label = list(range(1, len(texts) + 1))
    for _ in range(20):
        for a, b in itertools.combinations(range(len(texts)), 2):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                label[a] = label[b] = min(label[a], label[b])
    got = ngram_join.near_duplicates(docs(spark, *texts)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i + 1: (len(sets[i]), label[i]) for i in range(len(texts))}


def surrogates(spark, texts):
    """Rows of the operator, text being the new one, by id."""
    return {r.doc_id: r for r in pii.pseudonymise(docs(spark, *texts), "k").select("row.doc_id", F.col("new_text").alias("text"), "n_entities").collect()}


def test_users_columns_are_kept_under_any_name(spark):
    odd = spark.createDataFrame([(1, "mail a@b.org", "mine", "x"), (None, "mail a@b.org", "yours", "y")], "doc_id long, text string, entities string, attempts string")
    rows = pii.pseudonymise(odd, "k").collect()
    assert sorted((r.row.entities, r.row.attempts) for r in rows) == [("mine", "x"), ("yours", "y")]
    assert len({r.new_text for r in rows}) == 1 and all("a@b.org" not in r.new_text for r in rows)


def test_tokens_accounts_and_addresses(spark):
    texts = ["key sk-abcdefghijklmnopqrstuvwx end", "pay DE89 3704 0044 0532 0130 00 now", "pay DE89370400440532013000 now", "host 2001:db8:0:1:1:1:1:1 and fe80::a1 up", "ratio 12:30 and std::vector"]
    got = surrogates(spark, texts)
    assert "abcdefghijkl" not in got[1].text and got[1].text.startswith("key sk-")
    iban = re.search(r"DE[0-9 ]+[0-9]", got[2].text).group()
    assert [len(x) for x in iban.split()] == [4, 4, 4, 4, 4, 2] and got[3].text == f"pay {iban.replace(' ', '')} now" and "3704" not in iban
    plain = iban.replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1
    assert got[4].n_entities == 2 and "2001:db8" not in got[4].text and "fe80" not in got[4].text
    assert got[5].text == texts[4]


def test_surrogates_are_consistent_and_distinct(spark):
    texts = ("Write to Anna.Smith@corp.org or call +49 170 555 1234.", "anna.smith@CORP.org again, card 4539 1488 0343 6467", "Herr Weber met Anna Fischer", "nothing here", None)
    rows = surrogates(spark, texts)
    mail = [re.search(r"\S+@\S+\b", rows[i].text).group().lower() for i in (1, 2)]
    assert mail[0] == mail[1] != "anna.smith@corp.org"
    card = re.sub(r"\D", "", rows[2].text)[-16:]
    digits = [int(c) for c in reversed(card)]
    assert sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(digits)) % 10 == 0 and card != "4539148803436467"
    assert rows[3].text.startswith("Herr ") and "Weber" not in rows[3].text and any(n in rows[3].text for n in pii.FEMALE)
    assert rows[4].text == "nothing here" and rows[5].text is None


def test_parts_of_a_name_and_forms_of_a_number_agree(spark):
    names = ["Mr. Smith", *(f"{n} Smith" for n in pii.MALE), *(f"Dr. {n} Smith" for n in ("Foo", "Bar"))]
    phones = ["+1 555 123 4567", "+15551234567", "+49 170 555 1234"]
    got = {i: r.text for i, r in surrogates(spark, [*names, *phones]).items()}
    new = [got[i] for i in range(1, len(names) + 1)]
    assert len({n.split()[-1] for n in new}) == 1 and len(set(new)) == len(names) and not set(new) & set(names)
    assert {n.split()[0] for n in new[1:21]} == set(pii.MALE) and all(a.split()[0] != b.split()[0] for a, b in zip(new[1:21], names[1:21], strict=True))
    a, b, c = (re.sub(r"\D", "", got[i]) for i in range(len(names) + 1, len(names) + 4))
    assert a == b and a[0] == "1" and a != "15551234567" and c[:2] == "49"


def test_full_forms_are_widened(spark):
    names = [f"Mr. {n}" for n in pii.MALE] + [f"Frau {n}" for n in pii.FEMALE[:12]] + ["Paul Martin", "Herr Martin"]
    mails = [f"{c}@a{i}.org" for c in "jk" for i in range(50)]
    texts = names + mails
    got = {i: r.text for i, r in surrogates(spark, texts).items()}
    new = [got[i] for i in range(1, len(texts) + 1)]
    of = dict(zip(texts, new, strict=True))
    assert of["Paul Martin"].split()[-1] == of["Herr Martin"].split()[-1] == of["Mr. Martin"].split()[-1]
    assert len(set(new)) == len(texts) and not set(new) & set(texts)
    assert sum(of[n].split()[-1] in pii.FEMALE[12:] for n in names[20:32]) == 8


def test_many_short_addresses_have_surrogates(spark):
    texts = [f"{a}::{b}" for a in "0123456789abcdef" for b in "0123456789abcdef"]
    got = {i: r.text for i, r in surrogates(spark, texts).items()}
    new = [got[i] for i in range(1, len(texts) + 1)]
    digits = [t for t in texts if re.search(r"\d", t)]
    changed = [n for t, n in zip(texts, new, strict=True) if t in digits]
    assert len(set(changed)) == len(digits) and not set(changed) & set(texts)
    assert all(n == t for t, n in zip(texts, new, strict=True) if t not in digits)  # a::b names a scope


def test_each_pattern_is_found_alone(spark):
    alone = {
        "email": "x@y.org", "ip": "10.1.2.3", "ipv6": "abcd:abcd:abcd:abcd:abcd:abcd:abcd:abcd", "iban": "DE89370400440532013000", "card": "4539 1488 0343 6467", "ssn": "123-45-6789",
        "phone": "030 12345678", "token": "abcdefabcdefabcdefabcdefabcdefab", "name": "Priya Sharma met us",
    }
    more = ["2001:db8::", "fe80::a1:b", "ABCDEFABCDEFABCDEFABCDEFABCDEFAB", "0171-2345678", "Dear Wei Zhang", "by std::vector", "at 12:30:45"]
    assert set(alone) == set(pii.PATTERNS)
    got = surrogates(spark, [*alone.values(), *more])
    assert [got[i].n_entities for i in range(1, len(alone) + len(more) + 1)] == [1] * (len(alone) + 5) + [0, 0]


def test_unlisted_names_are_found_by_what_stands_beside_them(spark):
    firsts, lasts = ["Priya", "Wei", "Oluwaseun", "Zoë", "Şebnem", "Björn"], ["Sharma", "Zhang", "Adeyemi", "Ångström", "Yılmaz"]
    names = [f"{f} {n}" for f in firsts for n in lasts]
    said = ["{} met the board", "Dear {}, thank you", "it was signed by {} today", "a note written by {}", "{} wrote again", "we met {} there"]
    texts = [said[k % len(said)].format(n) for k, n in enumerate(names)]
    got = surrogates(spark, [*texts, "The Great Wall met with praise", "New York wrote history"])
    assert all(got[k].n_entities == 1 and n not in got[k].text and n.split()[1] not in got[k].text for k, n in enumerate(names, 1))
    new = {n: re.search(r"[^\W\d_]+ [^\W\d_]+", got[k].text.replace("Dear ", "").replace("it was signed by ", "").replace("a note written by ", "").replace("we met ", "")).group() for k, n in enumerate(names, 1)}
    assert len(set(new.values())) == len(names)
    assert all(new[f"{f} {n}"].split()[1] == new[f"{firsts[0]} {n}"].split()[1] for f in firsts for n in lasts)  # a surname's surrogate is one


def test_keep_one_goes_by_rows(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    near = a.replace("a59", "other")
    rows = [(1, a, "p"), (5, near, "q"), (5, b, "r"), (5, b, "r"), (None, a, "s"), (None, "c d e f g h", "t"), (None, None, "u"), (7, None, "v"), (7, "", "w")]
    d = spark.createDataFrame(rows, "doc_id long, text string, label string")
    got = sorted(r.label for r in ngram_join.keep_one(d).collect())
    assert got == ["p", "r", "t", "u", "v", "w"]


def test_jaccard_of_a_large_group_and_long_texts(spark, monkeypatch):
    """More kinds of a hash than a tile takes, few partners at a time, and links at and about the threshold."""
    monkeypatch.setattr(ngram_join, "TILE", 16)
    monkeypatch.setattr(ngram_join, "PARTNERS", 1)
    monkeypatch.setattr(ngram_join, "ORDERS", 1)
    rng = np.random.default_rng(11)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for _ in range(70):
        w = list(base)
        for _ in range(rng.integers(1, 6)):
            w[rng.integers(len(w))] = f"x{rng.integers(10**6)}"
        texts.append(" ".join(w[: rng.integers(60, 120)]))
    long = [f"l{i}" for i in range(9000)]
    texts += [" ".join(long), " ".join(long[:6800]), " ".join(long[:6700])]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    label = list(range(1, len(texts) + 1))
    for _ in range(20):
        for a, b in itertools.combinations(range(len(texts)), 2):
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                label[a] = label[b] = min(label[a], label[b])
    got = ngram_join.near_duplicates(docs(spark, *texts)).collect()
    assert {r.doc_id: r.component_id for r in got} == {i + 1: label[i] for i in range(len(texts))} and len(set(label)) > 2


def test_mix_meets_targets_and_grows_nested(spark):
    rows = [(i, "w " * (1 + i % 7), "abc"[i % 3] if i % 10 else None) for i in range(600)]
    found = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    taken, target = {}, {}
    for r in found:
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
        assert r.taken <= 3 * r.size
    assert all(abs(taken[s] - target[s]) <= 7 for s in target)


def test_chat_windows_read_back(spark):
    hard = r"\### Assistant: </turn> \h \l"
    rows = [(1, 0, "system", "be kind")] + [(1, i, ("user", "assistant")[i % 2 == 0], f"{hard} {'w ' * (37 * i % 90)}") for i in range(1, 40)] + [(2, 0, "assistant", None), (2, 1, None, "x" * 5000)]
    chats = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    windows = chat_windows.chat_windows(chats)
    back = {r.conv_id: r for r in chat_windows.read_back(windows).collect()}
    for conv in (1, 2):
        turns = [(r[2] or "", r[3] or "") for r in rows if r[0] == conv]
        assert [tuple(t) for t in back[conv].turns] == turns
        assert back[conv].loss_text == "".join(t for role, t in turns if role == "assistant")
    later = windows.filter("conv_id = 1 and window > 0").collect()
    assert later and all(w.text.startswith("### system: be kind</turn>") for w in later)


def test_windows_keep_the_budget(spark):
    rng = np.random.default_rng(4)
    rows = [(c, 0, "system", "s " * size) for c, size in ((1, 10), (2, 300), (3, 600))]
    rows += [(c, i, ("user", "assistant")[i % 2], "w " * int(rng.integers(1, 260))) for c in (1, 2, 3, 4) for i in range(1, 60)]
    rows += [(5, 1, "user", "w " * 900), (5, 2, "assistant", "w " * 900), (None, 1, "user", "a"), (None, None, "assistant", "b"), (None, None, "assistant", "b")]
    chats = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = chat_windows.chat_windows(chats).collect()
    size = lambda w: sum(len(t.partition(": ")[2].split()) + chat_windows.MARKS for t in w.text.split(chat_windows.END)[:-1])
    for w in found:
        assert size(w) <= chat_windows.BUDGET or w.n_turns - w.n_repeated == 1 and w.n_repeated <= 1 or w.window == 0
    first = [w for w in found if w.window == 0 and size(w) > chat_windows.BUDGET]
    assert {w.conv_id for w in first} <= {3, 5}
    back = {r.conv_id: r for r in chat_windows.read_back(chat_windows.chat_windows(chats)).collect()}
    assert [t.text for t in back[None].turns] == ["b", "b", "a"] and back[None].loss_text == "bb"


def test_packing_costs_no_more_than_single_lengths():
    rng = np.random.default_rng(6)
    cost = lambda filled, lengths: sum(min(c for c in lengths if c >= f) + 16 for f in filled)
    for lengths in ((256, 512, 1024), (100, 130, 400)):
        for _ in range(20):
            pieces = np.sort(rng.integers(1, lengths[-1], 60))[::-1]
            _, _, capacity, filled = packing.pack_shard(pieces, lengths, 16)
            singles = [cost(packing.best_fit(pieces.tolist(), o, lengths)[2], lengths) for o in lengths]
            assert int(capacity.sum()) + 16 * len(filled) == cost(filled, lengths) <= min(singles) and filled.sum() == pieces.sum()


def partitions(items):
    """All partitions of a list."""
    if not items:
        yield []
        return
    for rest in partitions(items[1:]):
        yield [[items[0]], *rest]
        for k in range(len(rest)):
            yield [*rest[:k], [items[0], *rest[k]], *rest[k + 1 :]]


def test_packing_of_few_pieces_is_near_the_optimum():
    rng = np.random.default_rng(8)
    lengths, whole, best = (10, 16, 30), 0, 0
    for _ in range(25):
        pieces = np.sort(rng.integers(1, 30, 6))[::-1]
        _, _, capacity, filled = packing.pack_shard(pieces, lengths, 2)
        whole += int(capacity.sum()) + 2 * len(filled)
        best += min(sum(min(c for c in lengths if c >= sum(b)) + 2 for b in bins) for bins in partitions(pieces.tolist()) if all(sum(b) <= 30 for b in bins))
    assert best <= whole <= 1.06 * best


def plain_features(t):
    w, rows = re.findall(r"[^\x20\x09-\x0D]+", t), t.split("\n")
    n, grams = max(len(w), 1), [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    count = lambda chars: sum(c in chars for c in t)
    return [
        np.log(n),
        sum(map(len, w)) / n,
        np.log1p(count("#*$%&|<>") / n),
        np.log1p(count("!?") / n),
        1 - len(set(rows)) / len(rows),
        1 - max(len(set(w)), 1) / n,
        1 - max(len(set(grams)), 1) / max(len(w) - 2, 1),
        np.log(n / len(rows)),
        sum(c.isupper() for c in t) / max(len(t), 1),
        count("0123456789") / max(len(t), 1),
    ]


def test_scores_against_plain_version(spark):
    """Features, the score of given weights, and a table without labels of both classes."""
    texts = ["Some Text of 3 lines!\nwith #tags <b> & more?\nwith #tags <b> & more?", "a b c a b c a b c", "", "\n\n ", "Ünï Ä 12345 $$$"]
    model = quality_classifier.Ranking(tuple(range(10)), (2.0,) * 10, tuple(0.1 * k for k in range(10)), 0.3, 0.5)
    rows = quality_classifier.features(docs(spark, *texts)).select("doc_id", "features", model.score(F.col("features")).alias("score")).collect()
    for r in rows:
        x = np.array(plain_features(texts[r.doc_id - 1]))
        assert np.allclose(r.features, x)
        logit = ((x - np.arange(10)) * 0.1 * np.arange(10) / 2).sum() - 0.3
        assert abs(r.score - 1 / (1 + np.exp(-(0.5 * logit + np.log(0.7 / 0.3))))) < 1e-9
    one_class = spark.createDataFrame([(1, 1), (2, 1), (2, 0)], "doc_id long, quality int")
    assert {r.score for r in quality_classifier.rank(docs(spark, *texts), one_class).collect()} == {0.7}


def test_ranking_is_the_minimum_of_its_loss():
    rng = np.random.default_rng(9)
    good, bad = rng.normal(size=(40, 4)) + [1, 0, 0.5, 0], rng.normal(size=(25, 4))
    w = quality_classifier.bradley_terry(good, bad)
    i, j = quality_classifier.pairs(len(good), len(bad))
    assert set(i) == set(range(40)) and set(j) == set(range(25)) and len(i) == 8 * 40
    loss = lambda w: np.log1p(np.exp(-(good[i] - bad[j]) @ w)).mean() + 0.5e-3 * w @ w
    assert all(loss(w) < loss(w + d) for d in rng.normal(size=(200, 4)) * 0.01)
    cut = quality_classifier.best_quantile(good @ w, bad @ w)
    right = lambda c: (good @ w >= c).mean() + (bad @ w < c).mean()
    assert right(cut) >= max(right(c) for c in np.r_[good @ w, bad @ w]) - 0.08


def test_components_against_brute_force(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 60, (45, 2))] + [(i, i + 1) for i in range(100, 130)]
    label = {x: x for e in edges for x in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == label


def test_bitmap_is_of_a_documents_lines(spark):
    line = "a line that three documents hold"
    d = docs(spark, f"x\n{line}", f"{line}\ny", line)
    kept = {r.doc_id: r.n_dropped for r in line_dedup.keep_bitmaps(d).collect()}
    assert kept == {1: 1, 2: 1}
    got = line_dedup.apply_bitmaps(d, line_dedup.keep_bitmaps(d)).select("row.doc_id", F.sha2("kept_text", 256).alias("h")).collect()
    assert {r.doc_id: r.h for r in got}[1] == hashlib.sha256(b"x").hexdigest()
