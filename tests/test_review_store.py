"""The review store's guards against a plain version, and the app store's parser."""

import json
import random
import re

from tidewire.operators import review_store
from tidewire.sources import feeds


def squashed(text):
    return re.sub(r"[\W_]+", "", (text or "").lower())


def plainly(held, incoming):
    """ids that enter, in order of (arrived, id)."""
    keys, texts, out = {(u, e) for u, e in held}, [squashed(e) for _, e in held], []
    for i, url, excerpt, _ in sorted(incoming, key=lambda r: (r[3], r[0])):
        t = squashed(excerpt)
        if not t or (url, excerpt) in keys or any(k and (t[:60] in k or k[:60] in t) for k in texts):
            continue
        keys.add((url, excerpt))
        texts.append(t)
        out.append(i)
    return sorted(out)


def admitted(spark, held, incoming):
    found = review_store.admitted(spark.createDataFrame(incoming, "id long, url string, excerpt string, arrived int"), spark.createDataFrame(held, "url string, excerpt string"))
    return sorted(r.id for r in found.collect())


def test_store_against_plain_version(spark):
    rng = random.Random(12)
    words = ["crew", "seat", "kind", "late", "uçuş", "çok", "iyi", "meal", "cold"]
    bases = [" ".join(f"{rng.choice(words)}{rng.randrange(30)}" for _ in range(30)) for _ in range(30)]
    rows = []
    for i in range(160):
        base = rng.choice(bases).split()
        a = rng.randrange(0, 8)
        text = " ".join(base[a : a + rng.choice([2, 4, 9, 16, 22])])
        rows.append((i, f"u{rng.randrange(3)}", rng.choice([text, text.upper(), text + " !", "", None, "..."]) if rng.random() < 0.4 else text, rng.randrange(40)))
    held = [(r[1], r[2]) for r in rows[:15]]
    want = plainly(held, rows[15:])
    assert admitted(spark, held, rows[15:]) == want and 5 < len(want) < 100
    assert admitted(spark, [], rows) == plainly([], rows)


def test_a_chain_of_likenesses_is_decided_in_order(spark):
    # b is like a and c is like b, but c isn't like a: with b out, c may enter
    head = "x" * 60
    a, b, c = head + "y" * 5, "q" * 60 + head + "y" * 3, "q" * 60 + "z"
    rows = [(1, "u", a, 1), (2, "u", b, 2), (3, "u", c, 3)]
    assert admitted(spark, [], rows) == plainly([], rows) == [1, 3]


def test_store_of_nothing(spark):
    assert admitted(spark, [("u", "some held review")], []) == [] and admitted(spark, [], [(1, "u", None, 1), (2, "u", "!", 2)]) == []


def label(x):
    return {"label": x}


def test_app_store_documents(spark):
    entry = {"im:rating": label("4"), "content": label(" Friendly crews   and clean plane. Very nice food. A third."), "title": label("t"), "updated": label("2024-05-06T07:08:09-07:00"), "author": {"name": label(" Real  Baba ")}}
    titled = {"im:rating": label("1"), "content": label(""), "title": label("Our luggage was lost for two days")}
    app = {"im:rating": label("1"), "content": label("The app crashes on login every single time")}
    docs = [
        (1, json.dumps({"feed": {"entry": [{"title": label("metadata without stars")}, entry, titled, app, {"im:rating": label("x"), "content": label("no number of stars here at all")}]}})),
        (2, json.dumps({"feed": {"entry": entry}})), (3, json.dumps({"feed": {}})), (4, "no json"), (5, None),
    ]
    got = sorted(feeds.store_reviews(spark.createDataFrame(docs, "id long, json string"), "de").collect(), key=lambda r: (r.id, r.excerpt))
    assert [(r.id, r.excerpt, str(r.review_date), r.rating, r.author, r.note) for r in got] == [
        (1, "Friendly crews and clean plane. Very nice food.", "2024-05-06", 8.0, "Real Baba", "4/5 App Store (DE)"),
        (1, "Our luggage was lost for two days", "None", 2.0, None, "1/5 App Store (DE)"),
        (2, "Friendly crews and clean plane. Very nice food.", "2024-05-06", 8.0, "Real Baba", "4/5 App Store (DE)"),
    ]
