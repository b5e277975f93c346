import collections
import random

import corpus_pipeline
from tests.llm.data import awkward, documents, prose


def test_stages_take_effect(spark, tmp_path):
    rng = random.Random(11)
    clean = [(100 + i, prose(rng, 80), "en", f"s{i % 4}") for i in range(40)]
    copies = [(200 + i, clean[i][1].upper(), "en", "s1") for i in range(5)]
    near = [(300 + i, clean[10 + i][1] + " Tail.", "en", "s2") for i in range(5)]
    item = prose(rng, 30)
    leaked = [(400 + i, prose(rng, 60) + " " + item, "en", "s3") for i in range(3)]
    rows = awkward(rng) + clean + copies + near + leaked + [clean[39]]
    documents(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item), (2, prose(rng, 25))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, left = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        left.append([r["doc_id"] for r in docs.select("doc_id").collect()])
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns, name
    language, exact, close, decontaminated, mixed = left
    assert set(language) == {d for d, t, *_ in rows if t and any(c.isalpha() for c in t)}
    assert len(language) == sum(bool(t and any(c.isalpha() for c in t)) for _, t, *_ in rows)
    gone = {100 + i for i in range(5)} | {4, 6, None}
    assert set(exact) == set(language) - gone and len(exact) == len(set(exact))
    assert set(close) == set(exact) - {300 + i for i in range(5)} - {8} and {400, 401, 402} <= set(close)
    assert set(decontaminated) == set(close) - {400, 401, 402}
    assert set(mixed) <= set(decontaminated)
    want = sorted(map(str, docs.select("doc_id", "source", "target", "taken", "shard").collect()))
    run = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(str, run.select("doc_id", "source", "target", "taken", "shard").collect())) == want


def test_stages_on_empty_tables(spark, tmp_path):
    docs = documents(spark, [(1, "x")]).limit(0)
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0


def test_mix_of_null_and_repeated_ids(spark, tmp_path):
    rng = random.Random(19)
    rows = [(None, prose(rng, 5 + i), "en", f"s{i % 3}") for i in range(60)]
    rows += [(7, prose(rng, 70 + i), "en", f"s{i % 3}") for i in range(30)]
    rows += [(8, "the same text of one id", "en", f"s{i % 2}") for i in range(6)] + [(100 + i, prose(rng, 20), "en", None) for i in range(20)]
    key = lambda d, t, s: (d, t, s)
    out = corpus_pipeline.mix_stage(spark, documents(spark, rows), str(tmp_path)).collect()
    given = collections.Counter(key(d, t, s) for d, t, _, s in rows)
    sizes, targets = collections.Counter(), {}
    for _, text, _, source in rows:
        sizes[source] += len(text.split())
    got, drawn = collections.Counter(), collections.Counter()
    for r in out:
        k = key(r["doc_id"], r["text"], r["source"])
        got[k] += 1
        drawn[r["source"]] += r["size"]
        assert r["size"] == len(r["text"].split()) and r["source_size"] == sizes[r["source"]]
        assert targets.setdefault(r["source"], r["target"]) == r["target"] <= 2 * sizes[r["source"]]
    assert all(got[k] <= 2 * given[k] for k in got)
    for source, target in targets.items():
        largest = max(len(t.split()) for _, t, _, s in rows if s == source)
        assert abs(drawn[source] - target) <= largest / 2 + 1e-6
