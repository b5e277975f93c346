import random
import zlib

import numpy as np

from gridweave.llm.language import document_languages, page_languages
from gridweave.llm.leaks import Vocabulary, lcs, leaks, _masks
from gridweave.llm.quality import isotonic, quality_scores
from tests.llm.data import DOCS, awkward, documents, prose


def test_vocabulary_and_lcs():
    rng = np.random.default_rng(1)
    words = rng.integers(1, 1 << 62, 5000, dtype=np.uint64)
    vocabulary = Vocabulary(words)
    assert (vocabulary.words[vocabulary.numbers(words)] == words).all()
    assert (vocabulary.numbers(rng.integers(1 << 62, 1 << 63, 5000, dtype=np.uint64)) == -1).all()

    def plain(a, b):
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        return table[-1][-1]

    for _ in range(200):
        a, b = rng.integers(0, 6, rng.integers(1, 30)).tolist(), rng.integers(-1, 6, rng.integers(0, 40)).tolist()
        assert lcs(_masks(a), len(a), b) == plain(a, b)


def test_leaks(spark):
    rng = random.Random(6)
    items = [prose(rng, 15 + i).replace("ba", "\u00e9a") for i in range(20)]
    rows = awkward(rng) + [(100 + i, prose(rng, 200)) for i in range(60)]
    want = set()
    for i, item in enumerate(items[:15]):
        words = item.split()
        if i % 3 == 1:  # a paraphrase: every sixth word changed, the answer whole
            words = [w if k % 6 or k > len(words) - 8 else "zz" for k, w in enumerate(words)]
        if i % 3 == 2:
            words = [w.upper() + "," for w in words]
        rows.append((500 + i, f"{prose(rng, 3 + 7 * i)} {' '.join(words)} {prose(rng, 50)}"))
        want.add((500 + i, i))
    rows.append((501, rows[-14][1]))  # repeated row
    benchmark = spark.createDataFrame([(i, t, 1) for i, t in enumerate(items)] + [(90, None, 1), (91, "", 1), (92, items[3], 1), (None, " . ", 1)], "item_id long, text string, n int")
    docs = documents(spark, rows)
    for block_bytes in (1 << 20, 1500):
        got = leaks(docs, benchmark, block_bytes=block_bytes).collect()
        assert {(r["doc_id"], r["item_id"]) for r in got} == want
        assert all(r["lcs"] >= 0.6 * r["item_words"] for r in got)
    assert leaks(docs, benchmark.limit(0)).count() == 0
    assert leaks(spark.createDataFrame([], DOCS), benchmark).count() == 0


def test_languages(spark):
    rng = random.Random(7)
    spell = {"en": ["the", "and", "ing", "tion", "wh"], "fr": ["eau", "oir", "que", "ét", "ment"], "de": ["sch", "ung", "ein", "über", "keit"]}
    text = lambda lang, n: " ".join("".join(rng.choice(spell[lang]) for _ in range(3)) for _ in range(n))
    rows = [(i, text(lang, 60), lang, f"h{i % 3}") for i, lang in enumerate(["en", "fr", "de"] * 60)]
    rows += [(900, text("de", 60), "fr", "h1"), (901, text("fr", 40), None, None), (902, "", "en", "h1"), (903, None, "en", "h1"), (904, "123 !!", "en", "h1"), (None, text("en", 30), "EN-us", "h2"), (905, text("en", 30_000), "en", "h0"), (905, text("fr", 20), "fr", "h0")]
    docs = documents(spark, rows)
    got = {(r["row_id"], r["raw"]): r for r in document_languages(docs).collect()}
    assert len(got) == len(rows)
    name = {i: r for (i, _), r in got.items()}
    assert all(name[i]["language"] == lang and name[i]["accepted"] for i, _, lang, _ in rows[:180])
    assert name[900]["language"] == "de" and name[901]["language"] == "fr" and name[None]["language"] == "en"
    assert all(name[i]["language"] is None and not name[i]["accepted"] for i in (902, 903, 904))
    assert document_languages(spark.createDataFrame([], DOCS)).count() == 0
    blind = document_languages(documents(spark, [(1, "some words", None, None), (2, None, None, None)])).collect()
    assert sorted((r["row_id"], r["language"], r["accepted"]) for r in blind) == [(1, None, True), (2, None, False)]


def test_languages_with_few_declared_rows(spark):
    rng = random.Random(23)
    spell = {"en": "abcde", "da": "vwxyz"}
    text = lambda lang: " ".join("".join(rng.choice(spell[lang]) for _ in range(3)) for _ in range(60))
    rows = [(i, text("en"), "en", "h") for i in range(3000)] + [(9000 + i, text("da"), "da", "h") for i in range(2)]
    got = {r["row_id"]: r for r in document_languages(documents(spark, rows)).collect()}
    assert all(got[i]["language"] == lang and got[i]["accepted"] for i, _, lang, _ in rows)


def test_page_languages(spark):
    html = lambda lang, text: f'<html lang="{lang}"><script>var queeaumentoir;</script><p>{text}</p></html>'
    en, fr = "the thing and this is whithering " * 8, "eau beaucoup que tout moment voir "
    rows = [(i, f"http://a{i % 2}.example.com/x", html("en", en)) for i in range(20)] + [(20 + i, "http://b.fr/", html("fr", fr * 8)) for i in range(20)]
    rows += [(50, None, html("", fr)), (51, "x", None)]
    got = {r["row_id"]: r for r in page_languages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i]["language"] for i in (0, 19, 20, 39, 50, 51)] == ["en", "en", "fr", "fr", "fr", None]


def test_isotonic():
    values = isotonic(np.array([4, 0, 4, 4, 0, 8]), np.array([1, 0, 0, 3, 0, 8]))
    assert (np.diff(values) >= 0).all() and 0 < values[0] < 0.3 and values[-1] > 0.9


def test_quality(spark):
    rng = random.Random(8)
    junk = lambda: " | ".join("#$%&" + prose(rng, 1) for _ in range(rng.randint(5, 60)))
    rows = awkward(rng) + [(100 + i, prose(rng, rng.randint(30, 200)) if i % 3 else junk()) for i in range(900)]
    docs = documents(spark, rows)
    marks = [(100 + i, int(i % 3 > 0), 0) for i in range(0, 900)] + [(None, 1, 0), (5000, 1, 0), (101, None, 0), (102, 1, 0)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = quality_scores(docs, labels).collect()
    assert len(got) == len(rows)
    out = [r for r in got if r["doc_id"] is not None and 100 <= r["doc_id"] < 1000]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out)
    held = [(r["score"], (r["doc_id"] - 100) % 3 > 0, r["predicted"]) for r in out if r["held_out"]]
    good, bad = [s for s, y, _ in held if y], [s for s, y, _ in held if not y]
    assert np.mean([[g > b for b in bad] for g in good]) > 0.98
    assert np.mean([p == y for _, y, p in held]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    # Labels of held-out rows are never read, and neither are lang, source and doc_id.
    flipped = spark.createDataFrame([(d, (1 - q if d is not None and q is not None and zlib.crc32(str(d).encode()) % 5 == 0 else q), 0) for d, q, _ in marks], labels.schema)
    again = {r["doc_id"]: r["score"] for r in quality_scores(docs, flipped).collect()}
    assert all(abs(again[r["doc_id"]] - r["score"]) < 1e-9 for r in out)
    assert {r["score"] for r in quality_scores(docs, labels.limit(0)).collect()} and quality_scores(docs.limit(0), labels).count() == 0
