import collections
import hashlib
import json
import random
import re

from gridweave.llm.mixing import mix
from gridweave.llm.secrets import secret_scan
from gridweave.llm.toolcalls import tool_lines
from gridweave.llm.urls import url_verdicts
from tests.llm.data import DOCS, awkward, documents, prose

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_spans(text):
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    return out + [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]


def test_secrets_against_brute_force(spark):
    rng = random.Random(2)
    key, weak, hexes = "AKIA" + "Q7" * 8, "Ab1" * 10, "0123456789abcdef" * 2
    rows = awkward(rng) + [
        (20, f"ä \U0001f600 {key} and {weak} near"),
        (21, f"{weak} alone"),
        (22, f"{key}" + " pad" * 100 + f" {weak} far"),
        (23, f'Password: "{hexes}" at https://host.example/x and 10.0.0.1'),
        (24, "secret: api_key: abcdefghij and token=password=abcdefgh"),
        (25, f"{hexes}{hexes} {hexes[:31]} AKIASHORT TOKEN='a.b/c+d=e_f-g'"),
        (26, " ".join(f"token = {hexes}" for _ in range(300))),
        (27, "10.0.0.1 https://nothing.near"),
        (28, None),
    ]
    rows += [rows[-2]] * 2
    got = collections.defaultdict(list)
    for r in secret_scan(documents(spark, rows)).collect():
        got[r["doc_id"]].append(r)
    order = ["assign", "access", "hex"]
    for doc_id, text in rows:
        spans = sorted(base_spans(text or ""), key=lambda s: (s[1], order.index(s[0])))
        want = hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
        if doc_id is not None:
            for r in got[doc_id]:
                assert r["base_sha256"] == want, doc_id
                assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(s[0] == k for s in spans) for k in order]
    assert len(got[27]) == 3 and sum(map(len, got.values())) == len(rows)
    linked = {d: [s.split(":")[0] for s in got[d][0]["spans"].split(",") if s.split(":")[0] in ("weak", "endpoint")] for d in got if d}
    assert linked[20] == ["weak"] and linked[21] == [] and linked[22] == [] and linked[27] == []
    assert linked[23] == ["endpoint", "endpoint"]
    assert secret_scan(spark.createDataFrame([], DOCS)).count() == 0


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, full = 1.5 * sum(sizes.values()), {}
    while True:
        open_ = [s for s in names if s not in full]
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] >= 2 * sizes[s]]
        if not over:
            return full | share
        for s in over:
            full[s] = 2.0 * sizes[s]
            left -= full[s]


def test_mix(spark):
    rng = random.Random(4)
    rows = [(i, prose(rng, rng.randint(0, 60)), "en", rng.choice(["b", "b", "b", "a", "é", None, "c"])) for i in range(400)]
    rows += [(None, "two words", "en", "a"), (500, None, "en", "only null"), (7, rows[7][1], "en", rows[7][3])]
    docs = documents(spark, rows)
    got = mix(docs, block_words=200).collect()
    assert len(got) == len(rows)
    sizes = collections.Counter()
    for _, text, _, source in rows:
        sizes[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    want = brute_targets(sizes)
    source_of = {i: s for i, _, _, s in rows}
    taken, longest = collections.Counter(), collections.Counter()
    for r in got:
        s = source_of[r["doc_id"]]
        assert r["source_size"] == sizes[s] and abs(r["target"] - want[s]) < 1e-6
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[s] += r["taken"]
        longest[s] = max(longest[s], r["size"])
    assert all(abs(taken[s] - want[s]) <= longest[s] for s in sizes)
    again = mix(docs.repartition(7), block_words=200)
    assert sorted(map(str, again.collect())) == sorted(map(str, got))
    counts = collections.Counter(r["shard"] for r in got if r["shard"] is not None)
    assert len(counts) > 32 and max(counts.values()) < 60
    assert mix(spark.createDataFrame([], DOCS)).count() == 0


def test_urls(spark):
    urls = ["https://x.net/a", "HTTP://A.Example.NET/en/5?q=1", "http://example.com/de/1", "http://a.example.com/de", "http://b.org/fr/1", None, "no scheme", "", "http://badnet/x", "ftp://EXAMPLE.net#f", "a://b://c/d", "http://b.org/fr/1"]
    urls += [f"http://mixed.org/bad/{i}" for i in range(20)] + [f"http://mixed.org/fr/{i}" for i in range(20)]
    pages = spark.createDataFrame([(i, u, "h", "form") for i, u in enumerate(urls)], "page_id long, url string, host string, form string")
    rules = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"), ("mixed.org/bad/1", "block"))
    got = {r["page_id"]: r for r in url_verdicts(pages, rules).collect()}
    assert len(got) == len(urls)
    assert [(got[i]["host"], got[i]["path"], got[i]["rule"]) for i in range(11)] == [
        ("x.net", "/a", "net/"), ("a.example.net", "/en/5", "example.net/en/"), ("example.com", "/de/1", "example.com/de/"), ("a.example.com", "/de", None),
        ("b.org", "/fr/1", "org/fr/"), ("", "", None), ("", "", None), ("", "", None), ("badnet", "/x", None), ("example.net", "", None), ("b:", "//c/d", None),
    ]
    assert got[1]["verdict"] == "allow" and got[2]["verdict"] == "block"
    # /bad/2 to /bad/9 have no rule; their template was rejected by its labels.
    unruled = [got[i] for i, u in enumerate(urls) if u and u.startswith("http://mixed.org/bad/") and got[i]["rule"] is None]
    assert unruled and all(r["verdict"] == "block" and r["template"] == "/bad/*" for r in unruled)
    assert url_verdicts(pages.limit(0), rules).count() == 0


def test_url_templates_of_any_depth(spark):
    """Slugs are one template however deep they stand, also below variable folders, in any number of rounds."""
    slug = lambda i: "".join(chr(97 + int(d)) for d in f"{i:03d}")
    deep = ["/a", "/a/b", "/a/b/c", "/a/b/c/d", "/a/b/c/d/e/f/g/h/i/j"]
    urls = [f"http://h{k}.org{d}/{slug(i)}" for k, d in enumerate(deep) for i in range(300)]
    urls += [f"http://v.org/u/{slug(i)}/x/y/{slug(i + 100 * j)}/end/{slug(i)}" for i in range(300) for j in range(3)]
    urls += ["http://few.org/" + "/".join("abcdefghij"), "http://few.org/" + "s/" * 40, "http://few.org/a"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = [r["template"] for r in url_verdicts(pages).orderBy("page_id").collect()]
    for k, d in enumerate(deep):
        assert {t.rsplit("/", 1)[1] for t in got[300 * k : 300 * k + 300]} == {"*"}, d
    assert set(got[1500:2400]) == {"/~/*/x/y/*/end/*"}
    assert got[2400:] == ["/~/" + "/".join("bcdefghij"), "/~/" + "s/" * 39, "/~"]


def test_similar_branches_merge(spark):
    """Branches apart from their host join those of about their own share, not the host; a branch alone keeps its name."""
    rows, rules = [], []
    for branch, blocked in (("p", 40), ("q", 39), ("r", 2), ("s", 1), ("m", 21), ("n", 19)):
        rows += [f"http://h.org/{branch}/{'no' if i < blocked else 'ok'}/{i}" for i in range(40)]
        rules += [(f"h.org/{branch}/no", "block"), (f"h.org/{branch}/ok", "allow")]
    rows += [f"http://one.org/{b}/{i}" for b in ("x", "y", "z") for i in range(40)]
    rules += [("one.org/x", "block"), ("one.org/y", "allow"), ("one.org/z", "allow")]
    pages = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    got = {}
    for r in url_verdicts(pages, tuple(rules)).collect():
        got.setdefault((r["host"], r["path"].split("/")[1]), set()).add(r["template"].split("/")[1])
    assert got["h.org", "p"] == got["h.org", "q"] == {"~1"} and got["h.org", "r"] == got["h.org", "s"] == {"~-1"}
    assert got["h.org", "m"] == got["h.org", "n"] == {"~"}
    assert got["one.org", "x"] == {"x"} and got["one.org", "y"] == got["one.org", "z"] == {"~-1"}


def test_tool_calls(spark):
    call = lambda **x: json.dumps({"tool_calls": [x]})
    rows = [
        (1, 0, "system", "be kind"), (1, 1, "user", "hi \"you\"\n"), (1, 2, "assistant", "hello"), (1, 3, "user", None), (1, 5, "assistant", "to nobody"),
        (2, 0, "assistant", call(id="b", name="add", arguments={"y": 2, "x": 1}, after=["a"])), (2, 1, "assistant", call(id="a", name="add", arguments={"x": 1, "y": "2"})),
        (2, 2, "tool", json.dumps({"tool_call_id": "a", "content": "3"})), (2, 3, "tool", json.dumps({"tool_call_id": "z", "content": "?"})),
        (3, 0, "assistant", call(id="p", name="add", arguments={"x": 1, "y": 1}, after=["q"])), (3, 1, "assistant", call(id="q", name="add", arguments={"x": 1, "y": 1}, after=["p"])),
        (4, 0, "user", "same"), (4, 0, "user", "same"), (None, 0, "user", "lost"), (5, None, "user", "lost"), (6, 0, None, None),
        (7, 0, "assistant", call(id="c", name="unknown", arguments="{\"k\": [1, {\"b\": 1, \"a\": 2}]}")), (7, 1, "assistant", "{not json"),
    ]
    turns = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, status string")
    schemas = {"add": {"x": "BIGINT", "y": "BIGINT"}, "reply": {"text": "STRING", "turn": "BIGINT"}}
    got = tool_lines(turns, schemas).collect()
    by = {(r["conv_id"], r["kind"], r["call_id"], r["status"]): r for r in got}
    assert by[1, "call", "1", "ok"]["json"] == '{"arguments":{"text":"hi \\"you\\"\\n","turn":1},"call_id":"1","kind":"call","name":"reply","result":"hello"}'
    assert by[1, "call", "3", "invalid"]["errors"] == "missing text"
    assert (1, "result", "4", "orphan") in by and (2, "result", "z", "orphan") in by
    assert by[2, "call", "a", "invalid"]["errors"] == "y is not BIGINT" and by[2, "call", "a", "invalid"]["level"] == 0
    assert by[2, "call", "b", "open"]["level"] == 1 and '"arguments":{"x":1,"y":2}' in by[2, "call", "b", "open"]["json"]
    assert (3, "call", "p", "cycle") in by and (3, "call", "q", "cycle") in by
    assert (4, "call", "0", "open") in by and (4, "call", "0", "repeated") in by
    assert by[7, "call", "c", "invalid"]["errors"] == "unknown tool" and '{"k":[1,{"a":2,"b":1}]}' in by[7, "call", "c", "invalid"]["json"]
    assert sum(r["status"] == "context" for r in got) == 4
    assert len(got) == len(rows) - 2  # two results stand in their calls' rows
    assert tool_lines(turns.limit(0), schemas).count() == 0


def test_calls_without_an_identifier_have_their_own_rows(spark):
    call = lambda k: '{"name": "reply", "arguments": {"text": "t%d", "turn": %d}}' % (k, k)
    body = '{"tool_calls": [' + ", ".join(map(call, range(3))) + "]}"
    rows = [(1, 1, "assistant", body), (1, 2, "assistant", body), (2, 2, "assistant", '{"tool_calls": [{"id": "a", "name": "reply", "arguments": {"text": "x", "turn": 1}, "after": ["b"]}, {"name": "reply", "arguments": {"text": "y", "turn": 1}}, {"id": "b", "name": "reply", "arguments": {"text": "z", "turn": 1}}]}')]
    got = tool_lines(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    calls = [r for r in got if r["conv_id"] == 1 and r["kind"] == "call"]
    assert len(calls) == 6 and {(r["status"], r["call_id"]) for r in calls} == {("open", None)} and sum('"t2"' in r["json"] for r in calls) == 2
    assert sorted(r["level"] for r in got if r["conv_id"] == 2 and r["kind"] == "call") == [0, 0, 1]
