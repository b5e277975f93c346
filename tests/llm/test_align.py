"""Alignment of tokenizers against a plain version, fragments of any cut, awkward rows."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from gridweave.llm.align import BYTE_BPE, PIECE_BPE, Fragment, align, byte_letters, composed, fragment
from tests.llm.data import awkward, documents, prose


def plain(rows):
    """{row number: the columns after doc_id} by the definition, with the general encoders."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(BYTE_BPE)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)
    letters = byte_letters()
    spell_a = lambda i: bytes(letters[c] for c in a.id_to_token(i))
    spell_b = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    out, links = [], []
    for text in rows:
        groups, own, ids_a, ids_b = [], [], [], []
        if text:
            ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            if not b"".join(map(spell_a, ids_a)) == b"".join(map(spell_b, ids_b)) == (" " + text).encode():
                ids_a, ids_b = [], []
            ends_a, ends_b = np.cumsum([len(spell_a(i)) for i in ids_a]).tolist(), np.cumsum([len(spell_b(i)) for i in ids_b]).tolist()
            both, at_a, at_b = sorted(set(ends_a) & set(ends_b)), 0, 0
            for end in both:
                to_a, to_b = ends_a.index(end) + 1, ends_b.index(end) + 1
                groups.append(",".join(map(str, ids_a[at_a:to_a])) + "|" + ",".join(map(str, ids_b[at_b:to_b])))
                own.append((ids_a[to_a - 1], ids_b[to_b - 1]))
                at_a, at_b = to_a, to_b
        out.append((len(ids_a), len(ids_b), ";".join(groups)))
        links.append(own)
    counts = Counter(x for own in links for x in own)
    most = {}
    for (_, y), n in counts.items():
        most[y] = max(n, most.get(y, 0))
    return [(n_a, n_b, len(own), len(own), sum(counts[x] == most[x[1]] for x in own), sum(counts[x] for x in own), g) for (n_a, n_b, g), own in zip(out, links)]


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")


def held(spark, rows, **options):
    got = align(documents(spark, rows), **options).collect()
    want = plain([t for _, t in rows])
    assert Counter((r["doc_id"], *(r[c] for c in COLUMNS)) for r in got) == Counter((i, *w) for (i, _), w in zip(rows, want))


ODD = [
    (20, "<|endoftext|> plain <s> </s> <unk> <0x41>"),
    (21, "a  b   c\t\td\r\n\r\n  e"),
    (22, "日本語のテキスト。ไทย ភាសា עברית العربية"),
    (23, "\U0001f600\U0001f468‍\U0001f469‍\U0001f467 é   x"),
    (24, "\x00\x01 control \x7f"),
    (25, " leading and trailing "),
    (26, "▁ the mark itself ▁"),
]


def test_against_plain_version(spark):
    rng = random.Random(3)
    held(spark, [r for r in awkward(rng) if not r[1] or len(r[1]) < 60_000] + ODD + [(30 + i, prose(rng, 50)) for i in range(20)])


def test_long_texts_meet_in_a_tree(spark):
    rng = random.Random(4)
    rows = [(1, prose(rng, 3_000)), (2, prose(rng, 2_000)), (2, prose(rng, 2_000)), (3, "short"), (None, "x" * 5_000), (4, " " * 6_000 + "end")] + ODD
    held(spark, rows, chunk_bytes=100)


def test_blank_runs_are_encoded(spark):
    got = align(documents(spark, [(1, " " * 3_000_000)])).collect()
    assert got[0]["n_a"] > 0 and got[0]["n_groups"] > 0


def test_empty_table(spark):
    assert align(documents(spark, [])).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.data())
def test_fragments_compose_in_any_way(data):
    a = data.draw(st.lists(st.integers(1, 4), max_size=30))
    total = sum(a)
    b, left = [], total
    while left:
        b.append(data.draw(st.integers(1, min(4, left))))
        left -= b[-1]
    a_ends, b_ends = np.cumsum(a).astype(np.int64), np.cumsum(b).astype(np.int64)
    a_ids, b_ids = np.arange(len(a)), np.arange(len(b)) + 100
    cuts = sorted(data.draw(st.sets(st.integers(0, total), max_size=6)) | {0, total})

    def part(lo, hi):
        own_a, own_b = (a_ends > lo) & (a_ends <= hi), (b_ends > lo) & (b_ends <= hi)
        return fragment(a_ids[own_a], a_ends[own_a], b_ids[own_b], b_ends[own_b])

    whole = fragment(a_ids, a_ends, b_ids, b_ends)
    parts = [part(lo, hi) for lo, hi in zip(cuts, cuts[1:])]
    same = lambda x, y: all(np.array_equal(p, q) for p, q in zip(x, y))
    assert same(composed(parts), whole)
    for k in range(len(parts) + 1):
        assert same(composed([composed(parts[:k]), composed(parts[k:])]), whole)
    assert same(composed([]), Fragment(*[np.zeros(0, np.int64)] * 4))


def test_query_digests_the_groups(spark):
    from gridweave.llm.registry import QUERIES
    import gridweave.llm.queries  # noqa: F401

    source = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    want = plain([r["text"] for r in source])
    got = {r["doc_id"]: r for r in QUERIES["op12_token_alignment"](spark, "/root/testdata/sf0.001").collect()}
    for r, w in zip(source, want):
        g = got[r["doc_id"]]
        assert (*(g[c] for c in COLUMNS[:-1]), g["groups_sha256"]) == (*w[:-1], hashlib.sha256(w[-1].encode()).hexdigest() if w[-1] else "")
