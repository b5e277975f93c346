import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridweave.llm import near, units
from gridweave.llm.exact import directory, exact_duplicates
from gridweave.llm.graph import components
from gridweave.llm.near import near_duplicates
from gridweave.llm.shelf import Shelf
from gridweave.llm.units import repeated_units, units_of, without
from gridweave.llm.words import blocks, shingles, words
from tests.llm.data import DOCS, awkward, documents, prose

LOW = {c: c + 32 for c in range(65, 91)}


def brute_near(rows, size, percent=80):
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW)) for i, t in enumerate(t for _, t in rows)}
    sets = [{tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set()) for w in words.values()]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            same_id = rows[a][0] is not None and rows[a][0] == rows[b][0]
            both = len(sets[a] & sets[b])
            if same_id or both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    out = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None]
        component = min(ids, default=None) if sets[i] else doc_id
        out.append((doc_id, len(sets[i]), component, None if doc_id is None or component is None else doc_id == component))
    return out


def edited(rng, text, changes):
    words = text.split(" ")
    for _ in range(changes):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("size", [4, 5])
def test_near_against_brute_force(spark, size):
    rng = random.Random(size)
    rows = awkward(rng)
    base, passage = prose(rng, 120), prose(rng, 70)
    rows += [(100 + i, edited(rng, base, i % 6)) for i in range(60)]  # one large group, with borderline members
    rows += [(300 + i, prose(rng, 40) + " " + passage) for i in range(60)]  # a passage that unlike texts share
    rows += [(500 + i, passage + " " + prose(rng, 3 + i % 20)) for i in range(40)]  # and texts that are mostly it
    rows += [(700 + i, prose(rng, 50)) for i in range(40)]
    got = near_duplicates(documents(spark, rows), shingle=size, few=4)
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute_near(rows, size), key=key)


@pytest.mark.parametrize("size", [4, 5])
def test_near_with_few_words_in_a_block(spark, size):
    short, long = " ".join("abcde"[: size - 1]), prose(random.Random(size), 300_000)
    assert len(long) > 1 << 20  # each text is a block of its own
    docs = spark.createDataFrame([(1, short), (2, long), (3, short)], "doc_id long, text string").coalesce(1)
    got = {tuple(r) for r in near_duplicates(docs, shingle=size).collect()}
    assert {r for r in got if r[0] != 2} == {(1, 1, 1, True), (3, 1, 1, False)}


@pytest.mark.parametrize("size", [4, 5])
def test_shingles_of_few_words_alone(size):
    texts = [" ".join("abcdefg"[:n]) for n in range(8)]
    together, bounds = shingles(words(next(blocks(pa.array(texts)))), size)
    for i, text in enumerate(texts):
        alone, _ = shingles(words(next(blocks(pa.array([text])))), size)
        assert alone.tolist() == together[bounds[i] : bounds[i + 1]].tolist()


def test_near_repeated_ids(spark):
    one, two, three = (prose(random.Random(i), 50) for i in range(3))
    rows = [(3, one), (5, one), (5, two), (9, two), (7, three), (None, three), (None, "alone")]
    got = near_duplicates(documents(spark, rows)).collect()
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(brute_near(rows, 5), key=key)


def test_near_crowded_list(spark):
    """Copies of one text that each miss the threshold by their own edits, some in pairs by an edit that they share."""
    rng = random.Random(11)
    base = prose(rng, 150)
    rows = [(i, edited(rng, base, i % 3)) for i in range(20)]
    far = [edited(rng, base, 7) for _ in range(40)]
    rows += [(100 + i, t) for i, t in enumerate(far)] + [(200 + i, edited(rng, t, 1)) for i, t in enumerate(far[:10])]
    got = near_duplicates(documents(spark, rows), few=2)
    assert sorted(map(tuple, got.collect())) == sorted(brute_near(rows, 5))


def test_near_in_two_passes(spark, monkeypatch):
    """Many likely pairs: the likeliest partner of each class is verified first, then what is still unconnected."""
    monkeypatch.setattr(near, "AT_ONCE", 0)
    rng = random.Random(23)
    base = prose(rng, 150)
    rows = [(i, edited(rng, base, i % 8)) for i in range(60)]
    got = near_duplicates(documents(spark, rows), few=2)
    assert sorted(map(tuple, got.collect())) == sorted(brute_near(rows, 5))


def test_near_empty(spark):
    assert near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_components(spark):
    rng = random.Random(3)
    pairs = [(i, i + 1) for i in range(0, 60)] + [(200, 100 + i) for i in range(30)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(pairs, "a long, b long"), Shelf(spark, "t")).collect()}
    near = collections.defaultdict(set)
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    for node in (n for n in near if near[n] - {n}):
        seen, stack = {node}, [node]
        while stack:
            for x in near[stack.pop()] - seen:
                seen.add(x)
                stack.append(x)
        assert got[node] == min(seen)


def test_components_of_few_edges_take_one_table(spark):
    """Each round of steps costs shuffles and a table, on each of many partitions."""
    shelf = Shelf(spark, "t")
    got = components(spark.createDataFrame([(i + 1, i) for i in range(60)], "a long, b long"), shelf).collect()
    assert {r["label"] for r in got} == {0} and len(got) == 61 and shelf._count == 1


@pytest.mark.parametrize("most", [1, 20])
def test_components_that_tasks_contract_in_parts(spark, most):
    pairs = [(i + 1, i) for i in range(60)] + [(200, 100 + i) for i in range(30)] + [(301, 300), (301, 301), (None, 5)]
    edges = spark.createDataFrame(pairs, "a long, b long").repartition(4)
    want = {i: 0 for i in range(61)} | {i: 100 for i in [*range(100, 130), 200]} | {300: 300, 301: 300}
    assert {r["node"]: r["label"] for r in components(edges, Shelf(spark, "t"), most).collect()} == want


def test_exact_against_brute_force(spark):
    rng = random.Random(5)
    rows = awkward(rng) + [(50 + i, "hot Text") for i in range(200)] + [(400 + i, prose(rng, 5)) for i in range(100)]
    got = exact_duplicates(documents(spark, rows), capacity=10).collect()
    assert len(got) == len(rows)
    groups = collections.defaultdict(list)
    for doc_id, text in rows:
        groups[hashlib.sha256((text or "").encode().lower()).hexdigest()].append(doc_id)
    kept = collections.Counter(r["text_sha256"] for r in got if r["kept"])
    assert kept == {k: 1 for k in groups}
    for r in got:
        ids = groups[r["text_sha256"]]
        assert r["group_size"] == len(ids)
        assert r["keep_id"] == max((i for i in ids if i is not None), default=None)
        assert not r["kept"] or r["doc_id"] == r["keep_id"]
    assert exact_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_directory_splits_only_overfull_buckets():
    counts = np.zeros(1 << 16, dtype=np.int64)
    counts[:16] = 10
    counts[40_000] = 1000
    bucket = directory(counts, 50)
    total = np.bincount(bucket, counts)
    assert (np.diff(bucket) >= 0).all() and total.sum() == counts.sum()
    assert all(t <= 50 or (bucket == i).sum() == 1 for i, t in enumerate(total))


@pytest.mark.parametrize("unit", ["line", "paragraph", "sentence", "clause"])
def test_units_against_brute_force(spark, unit):
    rng = random.Random(9)
    passage = "\n".join(prose(rng, 20) for _ in range(3)) + "\n\n"
    rows = awkward(rng) + [(20 + i, prose(rng, 25) + "\n" + passage + prose(rng, 12)) for i in range(12)]
    got = sorted((r["doc_id"], r["unit"], r["start"], r["end"], r["copies"]) for r in repeated_units(documents(spark, rows), unit).where("doc_id is not null").collect())
    place = collections.defaultdict(list)
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    for i in order:
        for n, (start, end, _, digest) in enumerate(units_of(rows[i][1] or "", unit, 8)):
            if digest:
                place[digest].append((rows[i][0] is None, rows[i][0] or 0, n, start, end))
    want = sorted((d, n, a, b, len(v)) for v in place.values() for none, d, n, a, b in sorted(v)[1:] if not none)
    assert got == want
    assert repeated_units(spark.createDataFrame([], DOCS), unit).count() == 0


def test_units_are_shuffled_once(spark, monkeypatch):
    """Units of crowded buckets are found by sums and a join, all others by one shuffle that does not carry the MD5: same rows."""
    rng = random.Random(31)
    line = prose(rng, 12)
    rows = awkward(rng) + [(20 + i, prose(rng, 30) + "\n" + line + "\n" + prose(rng, 9)) for i in range(40)]
    docs, found = documents(spark, rows), []
    for crowded in (units.CROWDED, 5, 0):
        monkeypatch.setattr(units, "CROWDED", crowded)
        out = repeated_units(docs)
        found.append(sorted(map(str, out.collect())))
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" in plan and "raw" not in next(x for x in plan.splitlines() if "Window" in x)
    assert found[0] and found[0] == found[1] == found[2]


def test_units_are_cut_with_their_offsets(spark):
    shared = "This passage of ten words stands in both of them. Short. It goes on for quite a few more words here."
    rows = [(1, "Alpha beta gamma.\n" + shared), (2, "Something else before it comes. " + shared + " And after."), (3, "Only here."), (4, None)]
    docs = documents(spark, rows)
    removed = repeated_units(docs)
    out = {r["doc_id"]: r for r in without(docs, removed).collect()}
    assert out[1]["text"] == rows[0][1] and out[3]["text"] == "Only here." and out[4]["text"] is None
    assert out[2]["text"].split() == "Something else before it comes. And after.".split()
    spans = [rows[1][1][s["start"] : s["end"]] for s in out[2]["removed_spans"]]
    assert " ".join(spans) == shared


@pytest.mark.parametrize("unit", ["line", "sentence", "clause"])
def test_short_lines_that_repeat_after_other_text(spark, unit):
    rng = random.Random(13)
    short, two = "All rights reserved.", "So it is, my friend. And that, they said, was all there was to say."
    rows = [(i, f"{prose(rng, 20)}\n{short}\n{prose(rng, 9)}\n{two}\n{prose(rng, 20)}") for i in range(5)] + [(9, "Equal and short."), (10, "equal AND short.")]
    docs = documents(spark, rows)
    out = {r["doc_id"]: r["text"] for r in without(docs, repeated_units(docs, unit)).collect()}
    for i, text in rows[1:5]:
        assert out[i].split() == text.replace(short, "").replace(two, "").split()
    assert out[0] == rows[0][1] and out[9] == "Equal and short." and out[10] == ""


@pytest.mark.parametrize("kind", ["words", "han"])
def test_passages_without_marks(spark, kind):
    rng = random.Random(17)
    if kind == "words":
        run = lambda n: " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(10**4)}" for _ in range(n)) + " "
    else:
        run = lambda n: "".join(chr(rng.randrange(0x4E00, 0x9F00)) for _ in range(n))
    passage = run(60)
    rows = [(i, run(40) + passage + run(40)) for i in range(5)]
    found = collections.defaultdict(set)
    for r in repeated_units(documents(spark, rows)).collect():
        found[r["doc_id"]].update(range(r["start"], r["end"]))
    assert 0 not in found
    for i, text in rows[1:]:
        at = text.index(passage)
        assert found[i] and found[i] <= set(range(at, at + len(passage))) and len(found[i]) > len(passage) / 2


def test_cuts_name_their_row(spark):
    """Equal rows keep one whole text; equal ids with other texts, null ids and clashing columns are cut by their own spans."""
    rng = random.Random(11)
    one, two, three = prose(rng, 40), prose(rng, 40), prose(rng, 40)
    rows = [(6, one), (6, one), (7, two), (7, three + "\n" + two), (None, three), (None, one)]
    docs = documents(spark, rows).withColumns({"of": F.lit("o"), "removed_spans": F.lit("r"), "id": F.lit(1), "nth": F.lit(2), "doc": F.lit("d")})
    out = without(docs, repeated_units(docs))
    assert out.columns == [c for c in docs.columns if c != "removed_spans"] + ["removed_spans"]
    got = sorted((r["doc_id"] or 0, (r["text"] or "").strip()) for r in out.collect())
    # The units of `three` stay in the row with the smaller (not null) id.
    assert got == sorted([(6, one), (6, ""), (7, two), (7, three), (0, ""), (0, "")])
