"""Removal of repeated substrings against a count of every window."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

from gridweave.llm.suffixes import WINDOW, without_repeats
from tests.llm.data import awkward, documents, prose


def brute(texts):
    """(bytes, removed spans, kept) of each text, by counting all windows."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + WINDOW] for d in data for i in range(len(d) - WINDOW + 1))
    out = []
    for d in data:
        spans = []
        for i in range(len(d) - WINDOW + 1):
            if seen[d[i : i + WINDOW]] > 1:
                if spans and i <= spans[-1][1]:
                    spans[-1][1] = i + WINDOW
                else:
                    spans.append([i, i + WINDOW])
        kept, at = b"", 0
        for a, b in spans:
            kept, at = kept + d[at:a], b
        out.append((len(d), tuple(map(tuple, spans)), kept + d[at:]))
    return out


def held(spark, rows):
    got = Counter(
        (r["doc_id"], r["n_bytes"], tuple((s["start"], s["end"]) for s in r["removed"]), bytes(r["kept"]), r["n_removed"])
        for r in without_repeats(documents(spark, rows)).collect()
    )
    want = Counter((i, n, s, k, n - len(k)) for (i, _), (n, s, k) in zip(rows, brute([t for _, t in rows])))
    assert got == want
    return want


def test_awkward_rows(spark):
    held(spark, [r for r in awkward(random.Random(1)) if not r[1] or len(r[1]) < 20_000] + [(12, "y" * 3_000), (13, "ab" * 400)])


def test_edited_copies_shared_passages_and_borders(spark):
    rng = random.Random(2)
    passage, base = prose(rng, 60), prose(rng, 300)
    rows = [(i, prose(rng, 40) + passage + prose(rng, 40)) for i in range(15)]
    for i in range(20):
        at = rng.randrange(len(base) - 20)
        rows.append((100 + i, base[:at] + prose(rng, 2) + base[at + rng.randrange(20) :]))
    exact, one_less = prose(rng, 80)[:WINDOW], prose(rng, 80)[: WINDOW - 1]
    rows += [(200, "<" + exact + ">"), (201, "[" + exact + "]"), (202, "<" + one_less + ">"), (203, "[" + one_less + "]"), (204, exact)]
    rows += [(205, base[:250] + "|" + base[:250]), (206, "é" * 150 + "|" + "é" * 120)]
    want = held(spark, rows)
    spans = {i: s for i, _, s, _, _ in want}
    assert spans[200] == ((1, 1 + WINDOW),) and spans[202] == () and spans[204] == ((0, WINDOW),)


def test_many_texts_around_one_passage(spark):
    rng = random.Random(3)
    line = prose(rng, 30)[:150]
    held(spark, [(i, word + line + word) for i, word in enumerate(prose(rng, rng.randint(1, 9)) for _ in range(400))])


def test_a_text_of_several_pieces(spark, monkeypatch):
    from gridweave.llm import suffixes

    monkeypatch.setattr(suffixes, "_PIECE", 1_000)
    rng = random.Random(4)
    long = prose(rng, 700)
    held(spark, [(1, long), (2, prose(rng, 5) + long[1_500:3_500]), (3, prose(rng, 900))])


def test_empty_table(spark):
    assert without_repeats(documents(spark, [])).collect() == []


def test_query_over_the_given_table(spark):
    from gridweave.llm.registry import QUERIES
    import gridweave.llm.queries  # noqa: F401

    source = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op13_repeated_substrings"](spark, "/root/testdata/sf0.001").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()}
    for r, (n, spans, kept) in zip(source, brute([r["text"] for r in source])):
        assert got[r["doc_id"]] == (n, n - len(kept), len(spans), hashlib.sha256(kept).hexdigest())
    assert len(got) == len(source)
