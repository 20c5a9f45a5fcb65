"""Stages of the corpus pipeline over the smallest documents: each against a brute-force version on its own input."""

import re
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from tidewire.llm.common import table, written

SF = "/root/testdata/sf0.001"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BLANKS = " \t\n\v\f\r"


def without_lines(docs: dict) -> dict:
    held = defaultdict(set)
    key = lambda line: line.strip(BLANKS).translate(LOW)
    for i, text in docs.items():
        for line in (text or "").split("\n"):
            held[key(line)].add(i)
    lost = lambda i, line: len(key(line)) >= 20 and len(held[key(line)]) >= 3 and max(held[key(line)]) != i
    return {i: "\n".join(x for x in (text or "").split("\n") if not lost(i, x)) for i, text in docs.items()}


def one_each(docs: dict) -> set:
    sets = {}
    for i, text in docs.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    ids, of = sorted(docs), {i: i for i in docs}
    root = lambda i: i if of[i] == i else root(of[i])
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                of[y] = x
    return {i for i in ids if root(i) == i}


def test_stages_against_brute_force(spark):
    docs = table(spark, SF, "documents")
    texts, seen = {}, []
    for name, stage in corpus_pipeline.STAGES[:4]:
        after = written(stage(spark, docs, SF), "test-stage")
        assert after.columns == docs.columns
        before = {r.doc_id: r.text for r in docs.collect()}
        rows = after.collect()
        texts = {r.doc_id: r.text for r in rows}
        assert set(texts) <= set(before)
        if name == "quality classifier":
            assert 0 < len(rows) < len(before) and all(before[i] == t for i, t in texts.items())
        elif name == "line dedup":
            assert texts == without_lines(before)
        elif name == "n-gram Jaccard join":
            assert set(texts) == one_each(before) and len(rows) == len(texts)
        else:
            assert all(before[i] == t for i, t in texts.items()) and max(Counter(r.doc_id for r in rows).values()) <= 3
        docs = after
        seen.append(name)
    assert len(seen) == 4
    packed = corpus_pipeline.STAGES[4][1](spark, docs, SF)
    words = {i for i, t in texts.items() if re.search(r"[^\x20\x09-\x0D]", t or "")}
    assert words <= {r.doc_id for r in packed.select("doc_id").distinct().collect()}


ODD = [
    (1, "plain words " * 60, "en", "s", 5), (1, "plain words " * 60, "en", "s", 5), (1, "another text of this id " * 30, "en", None, 1), (None, "text without an id " * 30, None, "t", None),
    (2, None, None, None, None), (3, "", "en", "s", 0), (4, " \n\n ", "en", "s", 3), (5, "word", "en", "t", 4), (6, "word", "en", "t", 4), (7, "long lines " * 40_000, "en", "s", 9),
]


@pytest.mark.parametrize("rows", [[], ODD], ids=["empty", "odd"])
def test_stages_take_odd_tables(spark, tmp_path, rows):
    """Nulls in any column, empty and very long texts, repeated rows, and columns whose names operators use inside."""
    more = [(*r, "h", 1, "x", 2.5, 7) for r in rows]
    docs = spark.createDataFrame(more, "doc_id long, text string, lang string, source string, n_chars long, h string, n long, text1 string, row double, place long")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:4]:
        after = written(stage(spark, before, str(tmp_path)), "test-stage")
        assert after.columns == docs.columns and after.schema.simpleString() == docs.schema.simpleString()
        was, now = before.collect(), after.collect()
        if name == "quality classifier":
            assert sorted(now, key=repr) == sorted(was, key=repr)  # no labels: nobody is rejected
        elif name == "line dedup":
            assert sorted((r.doc_id or 0, r.n) for r in now) == sorted((r.doc_id or 0, r.n) for r in was) and all(r.text is not None and r.n_chars == len(r.text) for r in now)
        elif name == "n-gram Jaccard join":
            assert len({(r.doc_id, r.text) for r in now}) == len([r for r in now if r.text.strip()]) + len({(r.doc_id, r.text) for r in now if not r.text.strip()})
            assert sum(r.doc_id == 5 for r in now) == bool(rows) and not any(r.doc_id == 6 for r in now)
        else:
            assert {tuple(r) for r in now} <= {tuple(r) for r in was}
        before = after
    packed = corpus_pipeline.STAGES[4][1](spark, before, str(tmp_path)).collect()
    words = sorted((r.doc_id or 0, len(re.findall(r"[^\x20\x09-\x0D]+", r.text))) for r in before.collect())
    assert sum(r.length for r in packed) == sum(n for _, n in words)


def test_run_is_its_stages(spark):
    """``run`` itself: every word of the mixed documents is packed once."""
    docs = table(spark, SF, "documents")
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = written(stage(spark, docs, SF), "test-stage")
    want = Counter()
    for r in docs.select("doc_id", "text").collect():
        want[r.doc_id] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    got = Counter()
    for r in corpus_pipeline.run(spark, SF).collect():
        got[r.doc_id] += r.length
    assert got == Counter({i: n for i, n in want.items() if n})
