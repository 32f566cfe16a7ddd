"""The corpus operators against brute force, and their defined results for odd rows."""

import json
import random
import re
import zlib
from hashlib import md5, sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.llm import chat_format, components, decontaminate, language_id, line_dedup, mixing, ngram_join, quality, queries, suffix_dedup, tokens, url_filter, vector_dedup

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"{a}{b}" for a in ("ba", "ce", "di", "fo", "gu") for b in ("la", "ne", "ri", "so", "tu", "x", "Y")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def frame(spark, rows):
    """rows (doc_id, text), with columns whose names clash with those that operators add."""
    docs = spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], DOCS)
    return docs.selectExpr("*", "1 as score", "'x' as n_lines", "2.5 as size", "true as held_out", "0 as node")


ODD = [(1, None), (2, ""), (3, "\n\n"), (None, "one two"), (None, None), (5, "Solo"), (5, "Solo"), (6, "é ü ñ"), (7, "... !!! 123"), (8, "word " * 30_000)]


@pytest.mark.parametrize("rows", [ODD, []])
def test_odd_rows(spark, rows):
    docs = frame(spark, rows)
    items = spark.createDataFrame([(1, "word word word"), (2, None), (None, "é ü ñ")], "item_id long, text string")
    n = len(rows)
    assert suffix_dedup.repeated_passages(docs).count() == n
    assert mixing.taken(docs).count() == n
    assert quality.score_quality(docs, quality.learn(docs, spark.createDataFrame([], "doc_id long, quality int"))).count() == n
    assert line_dedup.dedup_lines(docs).count() == n
    assert decontaminate.contamination(docs, items).count() == n
    assert language_id.identify(docs).count() == n
    assert ngram_join.similar(docs).count() == n
    if rows:
        und = {r.text for r in language_id.identify(docs).where("lang_pred = 'und'").collect()}
        assert und == {None, "", "\n\n", "... !!! 123"}
        hit = {(r.doc_id, r.n_words): r for r in decontaminate.contamination(docs, items).collect()}
        assert hit[8, 30_000].n_hit == 30_000 and hit[8, 30_000].n_items == 1
        assert hit[6, 3].contaminated and hit[6, 3].n_items == 0 and hit[6, 3].items_sha256 == sha256(b"").hexdigest()
        assert {r.component_id for r in ngram_join.similar(docs).where("doc_id = 1 or doc_id = 2").collect()} == {1, 2}
        assert {"copy", "position"} <= set(mixing.mix(docs).columns) and mixing.mix(docs).count() > 0


def test_components(spark):
    rng = random.Random(1)
    pairs = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)]
    root = {x: x for p in pairs for x in p}
    while True:
        new = {x: min([root[x]] + [root[b if a == x else a] for a, b in pairs if x in (a, b)]) for x in root}
        if new == root:
            break
        root = new
    found = {r.node: r.root for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    alone = {x for x in root if x not in found}
    assert all(a == b for a, b in pairs if a in alone) and all(root[x] == r for x, r in found.items())


def test_line_dedup_brute_force(spark):
    rng = random.Random(2)
    base = [prose(rng, rng.choice((1, 4, 5, 6, 7, 8, 9, 12, 15))) for _ in range(40)]
    docs = []
    for i in range(60):
        lines = []
        for _ in range(rng.randrange(0, 7)):
            words = rng.choice(base).split()
            for _ in range(rng.choice((0, 0, 0, 1, 1, 2))):
                k = rng.randrange(len(words) + 1)
                words[k : k + rng.randrange(2)] = rng.choice(([], [rng.choice(WORDS)]))
            lines.append("  ".join(words).upper() if rng.random() < 0.1 else " ".join(words))
        docs.append((i, "\n".join(lines)))

    def near(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
        return row[-1] <= 1

    seen, expected = [], {}
    for i, text in docs:
        kept = []
        for line in text.split("\n"):
            words = line.lower().split()
            if not words or not any(words == o or min(len(words), len(o)) >= 5 and near(words, o) for o in seen):
                kept.append(line)
            seen.append(words)
        expected[i] = "\n".join(kept)
    out = {r.doc_id: r.text for r in line_dedup.dedup_lines(frame(spark, docs)).collect()}
    assert out == expected


def test_ngram_join_brute_force(spark):
    rng = random.Random(3)
    docs, base = [], [prose(rng, n) for n in (2, 20, 60, 61, 150, 1500)]
    for i in range(150):
        words = rng.choice(base).split()
        for _ in range(rng.choice((0, 0, 1, 2, 3, 6)) * max(1, len(words) // 100)):
            k = rng.randrange(len(words) + 1)
            words[k : k + rng.randrange(2)] = rng.choice(([], [rng.choice(WORDS) + str(rng.randrange(5))]))
        docs.append((1000 - i, " ".join(words)))

    def sets(text, width):
        w = text.lower().split()
        return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()

    for width, percent in ((3, 90), (5, 80)):
        own = {i: sets(t, width) for i, t in docs}
        root = {i: i for i in own}
        links = [(a, b) for a in own for b in own if a < b and own[a] and own[b] and 100 * len(own[a] & own[b]) >= percent * len(own[a] | own[b])]
        for _ in range(len(own)):
            new = dict(root)
            for a, b in links:
                new[a] = new[b] = min(new[a], new[b])
            if new == root:
                break
            root = new
        found = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar(frame(spark, docs), width, percent).collect()}
        assert found == {i: (len(own[i]), root[i]) for i in own}


def test_suffix_dedup_brute_force(spark):
    rng = random.Random(4)
    passages = [prose(rng, n) for n in (49, 50, 51, 80)]
    docs = []
    for i in range(40):
        parts = [prose(rng, rng.randrange(30))]
        for _ in range(rng.randrange(3)):
            parts += [rng.choice(passages), prose(rng, rng.randrange(20))]
        docs.append((i, "\n".join(parts)))
    docs += [(50, docs[0][1]), (51, prose(rng, 70)), (52, "that " * 90)]
    docs.append((53, docs[51 - 10][1]))
    words = {i: t.lower().split() for i, t in docs}
    where = {}
    for i, w in words.items():
        for s in range(len(w) - 49):
            where.setdefault(tuple(w[s : s + 50]), set()).add(i)
    for r in suffix_dedup.repeated_passages(frame(spark, docs)).collect():
        hit, late = set(), set()
        w = words[r.doc_id]
        for s in range(len(w) - 49):
            others = where[tuple(w[s : s + 50])]
            if any(words[o] != w for o in others) or len(others) > 1:
                hit |= set(range(s, s + 50))
            if min(others) < r.doc_id:
                late |= set(range(s, s + 50))
        assert (r.n_words, r.n_repeated, r.n_removed) == (len(w), len(hit), len(late)), r


def test_decontaminate(spark):
    rng = random.Random(5)
    items = [(i, prose(rng, n)) for i, n in enumerate((1, 3, 9, 10, 11, 30, 25))] + [(7, "!!!"), (8, None)]
    items[0] = (0, "unique")
    docs = []
    for i in range(60):
        parts = [prose(rng, rng.randrange(40))]
        for _ in range(rng.randrange(3)):
            w = rng.choice(items[:7])[1].split()
            b = rng.randrange(max(1, len(w) - 11))
            parts += [", ".join(w[b : b + 12]), prose(rng, 30)]
        docs.append((i, " ".join(parts)))
    split = lambda t: [x for x in re.split(r"[^a-z0-9\x80-\U0010ffff]+", (t or "").lower()) if x]
    grams = {}
    for i, t in items:
        w = split(t)
        for s in range(max(1, len(w) - 9)):
            if w:
                grams.setdefault(tuple(w[s : s + 10]), set()).add(i)
    table = spark.createDataFrame(items, "item_id long, text string")
    for r in decontaminate.contamination(frame(spark, docs), table).collect():
        w, hit, own = split(docs[r.doc_id][1]), set(), set()
        for n in {len(g) for g in grams}:
            for s in range(len(w) - n + 1):
                if (g := tuple(w[s : s + n])) in grams:
                    hit |= set(range(s, s + n))
                    own |= grams[g]
        ids = ",".join(sorted(map(str, own)))
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (len(w), len(hit), len(own), sha256(ids.encode()).hexdigest(), bool(hit))
    clean = decontaminate.decontaminate(frame(spark, docs), table)
    assert not decontaminate.contamination(clean, table).where("contaminated").count()
    untouched = {r.doc_id for r in decontaminate.contamination(frame(spark, docs), table).where("not contaminated").collect()}
    assert untouched <= {r.doc_id for r in clean.collect()}


def test_mixing(spark):
    rng = random.Random(6)
    docs = [(i, prose(rng, rng.randrange(1, 40)), "en", rng.choice(["a", "b", "b", "b", "b", "c", None, "Z"]), 1) for i in range(4000)]
    rows = mixing.taken(spark.createDataFrame(docs, DOCS).repartition(7)).collect()
    assert sorted(rows) == sorted(mixing.taken(spark.createDataFrame(docs, DOCS)).collect())
    by, size, goal = {}, {}, {}
    for (i, t, _, s, _), r in zip(docs, sorted(rows), strict=True):
        assert (r.doc_id, r.size) == (i, len(t.split())) and r.taken <= 3 * r.size and r.taken % r.size == 0
        by[s], size[s], goal[s] = by.get(s, 0) + r.taken, size.get(s, 0) + r.size, r.target
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, full = {}, set()
    while True:  # as the excess is shared, source by source
        left = sum(size.values()) - sum(3 * size[s] for s in full)
        rest = [s for s in order if s not in full]
        target = {s: 3.0 * size[s] if s in full else left * weight[s] / sum(weight[x] for x in rest) for s in order}
        above = {s for s in rest if target[s] > 3 * size[s]}
        if not above:
            break
        full |= above
    for s in order:
        assert goal[s] == pytest.approx(target[s]) and abs(by[s] - target[s]) <= 80 + size[s] / 512
    mixed = mixing.mix(spark.createDataFrame(docs, DOCS)).collect()
    assert [r.position for r in mixed] == sorted(r.position for r in mixed) and 0 <= mixed[0].position and mixed[-1].position <= 1
    assert sum(len(r.text.split()) for r in mixed) == sum(by.values())
    # "b" has weights that rise from half to one and a half of their mean: 3/8 of its words come in the first half of the time
    half = sum(len(r.text.split()) for r in mixed if r.source == order[1] and r.position < 0.5)
    assert half / by[order[1]] == pytest.approx(3 / 8, abs=0.05)


def test_mixing_counts_every_word_before_a_document(spark):
    rng = random.Random(16)
    docs = [(i, prose(rng, rng.choice([1, 5, 40, 700])), "en", rng.choice("abcdef"), 1) for i in range(240)] + [(None, prose(rng, n), "en", "b", 1) for n in (3, 3, 300)]
    want, key = [], lambda r: (md5((md5(r[1].encode()).hexdigest() if r[0] is None else str(r[0])).encode()).hexdigest()[:8], len(r[1].split()))
    rows = mixing.taken(spark.createDataFrame(docs, DOCS).repartition(5)).collect()
    targets = {(r.doc_id, r.size): r.target for r in rows}
    for s in "abcdef":
        mine, place = sorted((d for d in docs if d[3] == s), key=key), 0.0
        whole = sum(len(d[1].split()) for d in mine)
        for d in mine:
            n = len(d[1].split())
            want.append((d[0], n, n * sum(e * whole + place + n / 2 < targets[d[0], n] for e in range(3))))
            place += n
        got, most = sum(w[2] for w, d in zip(want[-len(mine) :], mine, strict=True)), max(len(d[1].split()) for d in mine)
        assert abs(got - targets[mine[0][0], len(mine[0][1].split())]) <= most / 2 + 1
    assert sorted(((r.doc_id, r.size, r.taken) for r in rows), key=repr) == sorted(want, key=repr)


def test_mixing_query_tells_of_the_scheduled_mix(spark, tmp_path):
    rng = random.Random(18)
    docs = [(i, prose(rng, rng.choice([0, 1, 5, 40, 700])), "en", rng.choice(["a", "b", "c", "d", "d", "d", "d", None]), 1) for i in range(400)] + [(400 + i, None, "en", "b", 1) for i in range(3)]
    spark.createDataFrame(docs, DOCS).repartition(6).write.parquet(str(tmp_path / "documents.parquet"))
    rows = queries.op2_mixing(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(docs)))
    mixed = mixing.mix(spark.read.parquet(str(tmp_path / "documents.parquet"))).collect()
    at, sources = {}, sorted({d[3] for d in docs}, key=lambda s: (s is None, s or ""))
    for number, r in enumerate(mixed):
        at.setdefault(r.doc_id, []).append(number)
    before, source = dict.fromkeys(sources, 0), {d[0]: d[3] for d in docs}
    for r in sorted(rows, key=lambda r: (md5(str(r.doc_id).encode()).hexdigest()[:8], r.doc_id)):
        assert r.mix_rows == ",".join(map(str, at.get(r.doc_id, []))) and r.taken == r.size * len(at.get(r.doc_id, []))
        s, low, high = source[r.doc_id], 0.0, 1.0
        share = before[s] / max(r.target, 1)
        first = {0: 1.0, 1: 0.5, 2: 1.5}[sources.index(s) % 3]  # weights go from first to 2 - first over the time
        for _ in range(60):  # when the demand, the integral of the weights, gets to the words before the document
            middle = (low + high) / 2
            low, high = (middle, high) if first * middle + (1 - first) * middle * middle < share else (low, middle)
        assert r.position is None if not r.mix_rows else r.position == pytest.approx(low, abs=1e-9)
        before[s] += r.size
    assert any("," in r.mix_rows for r in rows) and any(not r.mix_rows for r in rows)


def test_quality_and_language_on_held_out_rows(spark, sf):
    sf = sf.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    scored = quality.score_quality(docs, quality.learn(docs, labels.where(~language_id.held_out())))
    rows = scored.join(labels, "doc_id").where("held_out").collect()
    good, bad = [r.score for r in rows if r.quality == 1], [r.score for r in rows if r.quality == 0]
    assert np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad]) > 0.95 and all(0 <= r.score <= 1 for r in rows)
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.9
    rows = language_id.identify(docs).where("held_out").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert np.mean([r.lang_pred == r.lang for r in rows]) > 0.97


def test_near_vectors(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(60, 64))
    rows = [(i, [float(v) for v in base[i % 60] + rng.normal(size=64) * rng.choice([0, 0.02, 0.1, 0.15])], i % 3 if i % 7 else None) for i in range(500)]
    rows += [(600, None, 1), (601, [0.0] * 64, 1), (602, [1.0, None], 1), (603, [float("nan")] * 64, 1), (604, [2.0, 0.0], 1), (605, [4.0, 0.0], 1), (None, [4.0, 0.0], 1), (606, [], 1)]
    found = vector_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("n", F.lit(1))).collect()
    x = {i: np.array(v) for i, v, label in rows if v and label is not None and None not in v and np.isfinite(v).all() and any(v)}
    label = {i: k for i, _, k in rows}
    links = {(a, b) for a in x for b in x if a is not None and b is not None and a != b and label[a] == label[b] and len(x[a]) == len(x[b]) and x[a] @ x[b] / np.linalg.norm(x[a]) / np.linalg.norm(x[b]) >= 0.98}
    degree = {r.vec_id: r.n_links for r in found}
    assert len(found) == len(rows) and degree[604] == 2 and degree[600] == degree[601] == degree[602] == degree[603] == degree[606] == 0
    assert sum(degree[i] for i in range(500)) >= 0.98 * sum(a < 500 for a, _ in links) > 0
    assert all(degree[i] <= sum(a == i for a, _ in links) for i in range(500))
    assert vector_dedup.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_chat_format(spark):
    call = lambda i, n, a: {"id": i, "name": n, "arguments": a}
    turns = [
        (1, 0, "user", 'say "hi"', 0),
        (1, 1, "tool", json.dumps({"tool_call_id": "c1", "content": "é"}), 0),
        (1, 2, "assistant", json.dumps({"tool_calls": [call("c2", "search", {"query": {"$result": "c1"}}), call("c1", "search", '{"query": "x", "limit": 2}'), call("c3", "nope", {})], "content": "z"}), 0),
        (1, 3, "tool", json.dumps({"tool_call_id": "c9"}), 0),
        (1, 4, "tool", json.dumps({"tool_call_id": "c2"}), 0),
        (2, 0, "assistant", json.dumps({"tool_calls": [call("a", "lookup", {"id": {"$result": "b"}}), call("b", "lookup", {"id": {"$result": "a"}}), call("c", "lookup", {"id": 1})]}), 0),
        (2, 1, "tool", json.dumps({"tool_call_id": "a"}), 0),
        (2, 2, "tool", json.dumps({"tool_call_id": "b"}), 0),
        (None, None, None, None, 0),
        (None, None, "assistant", "{broken", 0),
    ]
    schemas = {"search": {"type": "object", "required": ["query"], "properties": {"query": {"type": "string"}, "limit": {"type": "integer"}}}, "lookup": {"type": "object"}}
    out = chat_format.format_chats(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, kind int"), schemas).orderBy("conv_id", "pos").collect()
    assert [(r.kind, r.call_id, r.status) for r in out if r.conv_id == 1] == [
        ("message", None, "ok"), ("message", None, "ok"), ("call", "c1", "ok"), ("result", "c1", "ok"), ("call", "c2", "invalid"), ("call", "c3", "unknown"), ("result", "c9", "orphan"), ("result", "c2", "ok"),
    ]
    assert {r.call_id: r.status for r in out if r.conv_id == 2 and r.kind == "call"} == {"a": "cycle", "b": "cycle", "c": "unanswered"}
    assert sum(r.conv_id is None for r in out) == 2 and all(chat_format.canonical(json.loads(r.json)) == r.json for r in out)
    assert '{"content":"é","role":"tool","tool_call_id":"c1"}' in {r.json for r in out}
    assert chat_format.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_url_filter(spark):
    link = lambda *hosts: " ".join(f"<a HREF='https://{h}/x'>x</a>" for h in hosts)
    pages = [
        (0, "https://A.net/b?c", link("good.example.net", "near.io")),
        (1, "http://good.example.net/en/x#y", link("fine.io")),
        (2, "https://near.io", link("bad.net", "far.io")),
        (3, "https://fine.io/?q=://z", None),
        (4, "no host", ""),
        (5, None, link("bad.net")),
        (6, "https://x.example.com/de/1", ""),
        (7, "https://bad.net/", link("fine.io")),
        (8, "https://notnet/", ""),
        (9, "https://good.example.net/de/", ""),
        (9, "https://good.example.net/de/", ""),
    ]
    out = {r.page_id: r for r in url_filter.judge(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert [(out[i].host, out[i].path, out[i].rule, out[i].verdict) for i in range(10)] == [
        ("a.net", "/b", "net/", "block"), ("good.example.net", "/en/x", "example.net/en/", "allow"), ("near.io", "", None, "block"), ("fine.io", "/", None, "allow"), ("", "", None, "allow"),
        ("", "", None, "allow"), ("x.example.com", "/de/1", "example.com/de/", "block"), ("bad.net", "/", "net/", "block"), ("notnet", "/", None, "allow"), ("good.example.net", "/de/", "net/", "block"),
    ]
    # power iteration by hand
    hosts = ["a.net", "good.example.net", "near.io", "fine.io", "bad.net", "far.io"]
    edges = [(0, 1), (0, 2), (1, 3), (2, 4), (2, 5), (4, 3)]
    seed = {"trust": {1: 1.0}, "distrust": {0: 1 / (3 + 2 / 3), 4: 1 / (3 + 2 / 3), 1: 2 / 3 / (3 + 2 / 3)}}  # x.example.com has the rest
    for way, turn in (("trust", 1), ("distrust", -1)):
        e = [p[::turn] for p in edges]
        m = np.zeros(6)
        for i, v in seed[way].items():
            m[i] = v * 0.15
        start = m.copy()
        for _ in range(url_filter.ROUNDS):
            new = start.copy()
            for a, b in e:
                new[b] += 0.85 * m[a] / sum(x == a for x, _ in e)
            m = new
        for i, h in enumerate(hosts):
            for r in out.values():
                if r.host == h:
                    assert r[way] == pytest.approx(m[i])
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_propagation_converges(spark):
    """A chain of 26 hosts whose last three are a cycle, against the solved linear system."""
    n = 26
    pairs = [(i, i + 1) for i in range(n - 1)] + [(n - 1, n - 3)]
    edges = spark.createDataFrame([("trust", f"h{a}", f"h{b}") for a, b in pairs], "way string, a string, b string")
    seeds = spark.createDataFrame([("trust", "h0", 1.0)], "way string, host string, mass double")
    got = {r.host: r.mass for r in url_filter.propagated(edges, seeds).collect()}
    flow = np.zeros((n, n))
    for a, b in pairs:
        flow[b, a] += url_filter.DAMPING / sum(x == a for x, _ in pairs)
    want = np.linalg.solve(np.eye(n) - flow, np.eye(n)[0] * (1 - url_filter.DAMPING))
    assert len(got) == n and [got[f"h{i}"] for i in range(n)] == pytest.approx(list(want), rel=1e-6, abs=1e-9)


def test_arrow_batches_are_bounded(spark):
    """A wider bound is lowered, a narrower one stays, whatever its unit."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    try:
        for asked, held in (("64m", str(4 << 20)), ("67108864b", str(4 << 20)), ("1mb", "1mb"), ("512k", "512k")):
            spark.conf.set(key, asked)
            tokens.bound_batches(spark)
            assert spark.conf.get(key) == held
    finally:
        spark.conf.set(key, before)


def test_mixing_meets_targets_of_tiny_sources(spark):
    docs = [(i, "w " * 100, "en", s, 1) for i, s in enumerate("abcde")] + [(10 + i, "w " * 100, "en", "f", 1) for i in range(40)]
    rows = mixing.taken(spark.createDataFrame(docs, DOCS)).collect()
    for s in "abcde":
        (r,) = (r for r in rows if r.doc_id == "abcde".index(s))
        assert abs(r.taken - r.target) <= 50
    # rows without an id are placed one by one, too
    docs = [(None, f"w{i}", "en", s, 1) for s in "ab" for i in range(200)] + [(1, "w", "en", "c", 1)]
    rows = mixing.mix(spark.createDataFrame(docs, DOCS)).groupBy("source").count().collect()
    goal = {r.source: r.target for r in mixing.targets(spark.createDataFrame([("a", 200), ("b", 200), ("c", 1)], "source string, source_size long")).collect()}
    assert all(abs(r["count"] - goal[r.source]) <= 1 for r in rows)


def test_neighbours_over_partitions(spark):
    rng = random.Random(17)
    rows = [(rng.choice([0, 0, 0, rng.randrange(300)]), rng.randrange(60), rng.randrange(5)) for _ in range(3000)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n, some in ((13, rows), (211, rows), (5, rows[:1]), (5, [])):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            table = spark.createDataFrame(some, "key long, rid long, pos int").repartition(7)
            got = [tuple(r) for r in suffix_dedup._compared(table, ["rid"], "rid").collect()]
            held = {}
            for k, r, _ in some:
                held.setdefault(k, set()).add(r)
            assert sorted(got) == sorted((k, r, p, r > min(held[k]), r < max(held[k])) for k, r, p in some)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("typical", [0.9, 0.96, 0.985, 0.995])
def test_near_vectors_of_a_common_mean(spark, typical):
    """Vectors of one label whose cosines are about `typical`, some near copies, and a large group of them."""
    rng = np.random.default_rng(9)
    mean = rng.normal(size=64)
    mean /= np.linalg.norm(mean)
    rest = rng.normal(size=(250, 64))
    rest -= (rest @ mean)[:, None] * mean
    x = typical**0.5 * mean + (1 - typical) ** 0.5 * rest / np.linalg.norm(rest, axis=1, keepdims=True)
    step = rng.normal(size=(50, 64))
    x = np.vstack([x, x[:50] + step / np.linalg.norm(step, axis=1, keepdims=True) * rng.uniform(0.02, 0.2, (50, 1)), x[60] + 0.01 * rng.normal(size=(90, 64))])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.98
    np.fill_diagonal(near, False)
    root = np.arange(len(x))
    while (new := np.minimum(root, np.where(near, root, len(x)).min(1))).tolist() != root.tolist():
        root = new
    table = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int").repartition(5)
    out = {r.vec_id: r for r in vector_dedup.near_vectors(table).collect()}
    assert all(out[i].n_links <= near[i].sum() for i in out) and sum(r.n_links for r in out.values()) >= 0.98 * near.sum()
    assert np.mean([out[i].component_id == root[i] for i in out]) >= 0.98


def test_vectors_of_many_lengths_and_repeats(spark):
    rows = [(i, [1.0] * (i + 1), 1) for i in range(4)] + [(9, [2.0, 2.0], 1), (9, [2.0, 2.0], 2), (9, [2.0, 2.0], 1), (7, [3.0, 3.0], 2)]
    out = sorted((r.vec_id, r.n_links, r.component_id) for r in vector_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect())
    assert out == [(0, 0, 0), (1, 2, 1), (2, 0, 2), (3, 0, 3), (7, 1, 7), (9, 1, 7), (9, 2, 1), (9, 2, 1)]


def test_several_automata(spark, monkeypatch):
    rng = random.Random(18)
    items = [(i, prose(rng, 14)) for i in range(30)] + [(40, "unique"), (41, "short one")]
    docs = [(i, " ".join([prose(rng, 20), *rng.sample([t for _, t in items], rng.randrange(3)), prose(rng, 60)])) for i in range(40)] + ODD
    table = spark.createDataFrame(items, "item_id long, text string")
    key = lambda r: repr(tuple(r))
    want = [sorted(map(key, f(frame(spark, docs), table).collect())) for f in (decontaminate.contamination, decontaminate.decontaminate)]
    monkeypatch.setattr(decontaminate, "PART_CHARS", 300)
    assert len(decontaminate.parts(table)) > 3
    assert [sorted(map(key, f(frame(spark, docs), table).collect())) for f in (decontaminate.contamination, decontaminate.decontaminate)] == want


def test_a_word_repeated(spark):
    items = spark.createDataFrame([(1, "a " * 3000), (2, "a a"), (3, "b")], "item_id long, text string")
    (r,) = decontaminate.contamination(spark.createDataFrame([(1, "a " * 50_000)], "doc_id long, text string"), items).collect()
    assert (r.n_hit, r.n_items) == (50_000, 2)


def test_more_languages_than_a_model_holds(spark, monkeypatch):
    rng = random.Random(19)
    letters = ["abcdef", "ghijkl", "mnopqr", "stuvwx", "yzabgh"]
    rows = [(i, " ".join("".join(rng.choice(letters[i % 5]) for _ in range(5)) for _ in range(30)), f"l{i % 5}", "s", 1) for i in range(200)] + [(999, None, "l1", "s", 1), (998, "123", None, "s", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    want = {r.doc_id: (r.lang_pred, round(r.score, 6)) for r in language_id.identify(docs).collect()}
    assert np.mean([want[i][0] == f"l{i % 5}" for i in range(200)]) > 0.95 and want[999] == want[998] == ("und", 0.0)
    monkeypatch.setattr(language_id, "PART_LANGS", 2)
    assert {r.doc_id: (r.lang_pred, round(r.score, 6)) for r in language_id.identify(docs).collect()} == want


def test_language_by_hand(spark):
    """Scores against naive Bayes in plain Python on the same buckets."""
    rng = random.Random(20)
    rows = [(i, " ".join("".join(rng.choice("abcd" if i % 2 else "bcde") for _ in range(3)) for _ in range(rng.randrange(4))), "xy"[i % 2], "s", 1) for i in range(60)]
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    grams = lambda t: [int(b) for n in language_id.SIZES for b in language_id._buckets(language_id._codes(f" {t} "), n)]
    counts = {x: np.full(language_id.BUCKETS, 0.5) for x in "xy"}
    for i, t, x, *_ in rows:
        if t and not held(i):
            np.add.at(counts[x], grams(t), 1)
    prior = {x: sum(r[2] == x and not held(r[0]) for r in rows) for x in "xy"}
    for r in language_id.identify(spark.createDataFrame(rows, DOCS)).collect():
        logs = {x: np.log(prior[x]) + np.log(counts[x][grams(r.text)] / counts[x].sum()).sum() for x in "xy"}
        if not r.text.strip():
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            best = max(logs, key=logs.get)
            assert r.score == pytest.approx(1 / sum(np.exp(v - logs[best]) for v in logs.values()), rel=1e-3) and (r.lang_pred == best or r.score < 0.501)


def test_line_dedup_of_many_lines(spark):
    text = "\n".join(["the same line of six words"] * 60_000 + ["another one"])
    (r,) = line_dedup.dedup_lines(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert (r.n_lines, r.n_dropped, r.text) == (60_001, 59_999, "the same line of six words\nanother one")


def test_tables_go(spark):
    """Only what the returned plans read is left, and it can be dropped."""
    from larkspur.plans import session

    session.drop_written()
    docs = frame(spark, [(i, f"{i % 7} " + "one two three four five six seven eight " * 9) for i in range(30)])
    for f, most in ((suffix_dedup.repeated_passages, 3), (ngram_join.similar, 2), (line_dedup.dedup_lines, 1)):
        f(docs).collect()
        assert len(session.tables_written()) <= most
        session.drop_written()
    assert not session.tables_written()


def test_quality_of_repeated_ids(spark):
    rng = random.Random(21)
    rows = [(i % 50, prose(rng, 30) if i % 2 else "!!! $$ ?? " * 9) for i in range(300)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)] + [(3, None), (None, 1), (4, 0)], "doc_id long, quality int")
    model = quality.learn(frame(spark, rows), labels)
    got = quality.score_quality(frame(spark, rows), model).collect()
    assert len(got) == 300 and all(0 <= r.score <= 1 for r in got) and np.mean([r.predicted == r.doc_id % 2 for r in got]) > 0.95


def test_chat_format_brute_force(spark):
    """Random conversations with calls, results, references and repeats against a linker in plain Python."""
    rng, turns = random.Random(22), []
    schemas = {"f": {"type": "object", "required": ["n"], "properties": {"n": {"type": "integer", "minimum": 0}}}, "g": {"type": "object"}}
    for conv in range(40):
        ids = [f"c{k}" for k in range(rng.randrange(1, 6))]
        for turn in range(rng.randrange(1, 8)):
            kind = rng.random()
            if kind < 0.35:
                calls = [{"id": rng.choice([*ids, None]), "name": rng.choice(["f", "g", "h"]), "arguments": {"n": rng.choice([1, -1, "x"])} | ({"r": {"$result": rng.choice(ids)}} if rng.random() < 0.5 else {})} for _ in range(rng.randrange(1, 3))]
                turns.append((conv, turn, "assistant", json.dumps({"tool_calls": calls})))
            elif kind < 0.8:
                turns.append((conv, turn, "tool", json.dumps({"tool_call_id": rng.choice([*ids, "z"]), "content": rng.randrange(3)})))
            else:
                turns.append((conv, turn, "user", "hi" * rng.randrange(3)))
    want = []
    for conv in range(40):
        parts = []
        for c, turn, role, text in turns:
            if c != conv:
                continue
            found = json.loads(text) if role != "user" else {}
            if role == "assistant":
                parts.append([turn, 0, "message", None, None, None, []])
                for i, call in enumerate(found["tool_calls"], 1):
                    n, ref = call["arguments"]["n"], call["arguments"].get("r", {}).get("$result")
                    parts.append([turn, i, "call", call["id"], call["name"], {"f": isinstance(n, int) and n >= 0, "g": True}.get(call["name"]), [ref] if ref else []])
            else:
                parts.append([turn, 0, "result" if role == "tool" else "message", found.get("tool_call_id"), None, None, []])
        first = {}
        for p in parts:
            if p[3] is not None:
                first.setdefault((p[2], p[3]), p)
        # a call's time is its own place or just after the latest result it waits for, a result's its own or just after its call
        call_at, result_at = {}, {}

        def after(own, at):
            return own if own > at else (at[0], at[1], at[2] + 1, own[3], own[4])

        where = lambda p: (p[0], p[1], 0, p[0], p[1])
        moved = True
        while moved:
            moved = False
            for (kind, key), p in first.items():
                if kind == "call" and key not in call_at:
                    waits = [r for r in p[6] if ("call", r) in first and ("result", r) in first]
                    if all(r in result_at for r in waits):
                        at = where(p)
                        if waits:
                            at = after(at, max(result_at[r] for r in waits))
                        call_at[key], moved = at, True
                        if ("result", key) in first:
                            result_at[key] = after(where(first["result", key]), at)
        for p in parts:
            turn, idx, kind, key, name, ok, _ = p
            at, status = where(p), "ok"
            if kind == "call":
                own = key is not None and first["call", key] is p
                status = "unknown" if key is None else "duplicate" if not own else "cycle" if key not in call_at else "unknown" if ok is None else "invalid" if not ok else "unanswered" if ("result", key) not in first else "ok"
                at = call_at.get(key, at) if own else at
            elif kind == "result":
                call, own = first.get(("call", key)), first["result", key] is p
                status = "orphan" if call is None else "ok" if own else "duplicate"
                if call is not None:
                    at = result_at.get(key, at) if own else after(at, call_at.get(key, where(call)))
            want.append((conv, turn, idx, kind, key, name, status, at))
    table = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("kind", F.lit(0)).repartition(5)
    got = [(r.conv_id, r.turn, r.idx, r.kind, r.call_id, r.name, r.status, tuple(r.pos)) for r in chat_format.format_chats(table, schemas).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and {w[6] for w in want} == {"ok", "unknown", "duplicate", "cycle", "invalid", "unanswered", "orphan"}


def test_chats_of_odd_rows(spark):
    long = json.dumps({"tool_calls": [{"id": f"k{i}", "name": "g", "arguments": {"x": "y" * 1000}} for i in range(500)]})
    rows = [(1, 0, "assistant", long), (1, 0, "assistant", long), (1, 1, "tool", '{"tool_call_id": "k3"}'), (None, 0, "tool", None), (2, None, None, "")]
    out = chat_format.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as pos", "2 as json", "'x' as status"), {"g": {"type": "object"}}).collect()
    assert len(out) == 2 * 501 + 3 and sum(r.kind == "call" for r in out) == 1000


def test_urls_on_a_hub(spark, monkeypatch):
    """Trust and distrust on a graph with a hub, dealt to several parts, against the solved system; clashing columns and long html."""
    monkeypatch.setattr(url_filter, "HUB", 4)
    n = 30
    pairs = [(0, i) for i in range(1, n)] + [(i, 0) for i in range(1, n, 2)] + [(i, i + 1) for i in range(1, n - 1, 3)]
    pages = [(i, f"http://h{i}.{'net' if i % 11 == 3 else 'org'}/fr/", "x" * 50_000 + "".join(f'<a href="//h{b}.{"net" if b % 11 == 3 else "org"}/q">' for a, b in pairs if a == i)) for i in range(n)]
    pages += [(n + i, f"http://h{i}.{'net' if i % 11 == 3 else 'org'}/de/", None) for i in range(n)]
    out = url_filter.judge(spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "1 as host", "2 as trust", "3 as verdict")).collect()
    for way, turn, seeds in (("trust", 1, [i for i in range(n) if i % 11 != 3]), ("distrust", -1, [i for i in range(n) if i % 11 == 3])):
        flow = np.zeros((n, n))
        e = [p[::turn] for p in pairs]
        for a, b in e:
            flow[b, a] += url_filter.DAMPING / sum(x == a for x, _ in e)
        seed = np.array([float(i in seeds) for i in range(n)])
        want = np.linalg.solve(np.eye(n) - flow, seed / seed.sum() * (1 - url_filter.DAMPING))
        assert all(r[way] == pytest.approx(want[r.page_id % n], abs=1e-8) for r in out)
    assert all(r.verdict == ("block" if r.page_id % n % 11 == 3 or r.distrust > r.trust else "allow") for r in out if r.page_id >= n)
