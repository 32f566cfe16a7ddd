"""The pipeline's stages on rows planted in a small table."""

import random
import re
import shutil
from hashlib import md5

from pyspark.sql import functions as F

import corpus_pipeline


def test_one_row_of_each_component_stays(spark, sf):
    a, b, c, d, e = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcde")
    rows = [
        (2, a, "s", 1), (1, a + " tail", "s", 1), (None, a, "s", 1),  # near copies, one without an id
        (3, b, "s", 1), (3, b, "s", 1), (3, b, "t", 1),  # repeated rows
        (None, c, "s", 1), (None, c, "s", 1), (None, c + " tail", "s", 1),  # copies without an id
        (2, d, "s", 1),  # shares its id with a copy of a
        (4, e, "s", 1), (4, e + " tail", "s", 1),  # near copies that share their id
        (5, "", "s", 1), (5, "", "s", 1), (6, None, "s", 1),
    ]
    docs = spark.createDataFrame([(i, t, "en", s, n) for i, t, s, n in rows], spark.read.parquet(f"{sf}/documents.parquet").schema)
    out = corpus_pipeline.near_duplicates(spark, docs.repartition(4), sf)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    got = [(r.doc_id, r.text and r.text.removesuffix(" tail"), r.source) for r in out.collect()]
    assert sorted(got, key=repr) == sorted([(1, a, "s"), (3, b, "s"), (None, c, "s"), (2, d, "s"), (4, e, "s"), (5, "", "s"), (5, "", "s"), (6, None, "s")], key=repr)


def test_stages(spark, sf, tmp_path):
    shutil.copy(f"{sf}/benchmark.parquet", tmp_path / "benchmark.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first().text
    longest = docs.orderBy("n_chars", ascending=False).first()
    extra = [(10_001, "123 !!", None, "src0", 6), (10_002, longest.text + " tail", longest.lang, None, 9), (10_003, f"{longest.text.split('.')[0]} unlike. {item} {' '.join(f'w{i}' for i in range(200))}", "en", "src1", 9), (None, "the of and", "en", "src1", 9)]
    all_docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    all_docs.write.parquet(str(tmp_path / "documents.parquet"))
    now, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, str(tmp_path))
        out.write.parquet(str(tmp_path / f"out{i}"))
        if i < 4:
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        now = spark.read.parquet(str(tmp_path / f"out{i}"))
        seen[name] = {r.doc_id: r.text for r in now.collect()}
    assert 10_001 not in seen["language ID"] and 10_002 in seen["language ID"]
    assert 10_002 not in seen["n-gram Jaccard join"] or longest.doc_id not in seen["n-gram Jaccard join"]
    assert item.split(".")[0] not in seen["benchmark decontamination"].get(10_003, "")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def _near(a, b):
    """Within one word of each other, by what is left between the common head and tail."""
    i = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    m = min(len(a), len(b)) - i
    j = next((k for k in range(m) if a[-1 - k] != b[-1 - k]), m)
    return max(len(a), len(b)) - i - j <= 1


def _lines(rows):
    """Rows [id, text, source] after line dedup."""
    order = sorted({(r[0] is None, r[0] or 0, r[1]) for r in rows if r[1] is not None})
    seen, kept = [], {}
    for none, i, text in order:
        out = []
        for line in text.split("\n"):
            words = line.lower().split()
            if not words or not any(words == o or min(len(words), len(o)) >= 5 and _near(words, o) for o in seen):
                out.append(line)
            seen.append(words)
        kept[None if none else i, text] = "\n".join(out)
    out = [[i, text if text is None else kept[i, text], s, text] for i, text, s in rows]
    return [r[:3] for r in out if r[1] == r[3] or r[1].split()]


def _distinct(rows):
    """Rows after the near-duplicate join."""
    shingles = lambda t: {tuple(w[i : i + 5]) for w in [(t or "").lower().split()] for i in range(len(w) - 4)} or ({tuple((t or "").lower().split())} - {()})
    sets = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))
    for _ in rows:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 80 * len(a | b):
                    root[i] = root[j] = min(root[i], root[j])
    best = {}
    for i, r in enumerate(rows):
        if sets[i]:
            best[root[i]] = min(best.get(root[i], (9, 0, "", 0)), (r[0] is None, r[0] or 0, "", i))
    return [r for i, r in enumerate(rows) if not sets[i] or best[root[i]][3] == i]


def _clean(rows, items):
    words = lambda t: [(m.group().lower(), m.start(), m.end()) for m in re.finditer(r"[a-zA-Z0-9\x80-\U0010ffff]+", t or "")]
    grams = {tuple(w[0] for w in words(t)[i : i + 10]) for t in items for i in range(max(1, len(words(t)) - 9)) if words(t)}
    out = []
    for i, text, s in rows:
        first = True
        while text is not None:
            w = words(text)
            hit = sorted({p for n in {len(g) for g in grams} for b in range(len(w) - n + 1) if tuple(x[0] for x in w[b : b + n]) in grams for p in range(b, b + n)})
            if not hit:
                break
            if first and len(hit) > 0.5 * len(w):
                text = False
                break
            first, spans = False, []
            for p in hit:
                if spans and spans[-1][1] == p:
                    spans[-1][1] = p + 1
                else:
                    spans.append([p, p + 1])
            for b, e in reversed(spans):
                text = text[: w[b][1]] + text[w[e - 1][2] :]
        if text is not False:
            out.append([i, text, s])
    return out


def test_stages_against_plain_python(spark, sf, tmp_path):
    rng = random.Random(31)
    vocabulary = [a + b + c for a in ("ka", "lo", "mi", "tu") for b in ("ra", "se", "no") for c in ("p", "x", "du", "")]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [prose(30), prose(12), prose(4), None, "!!"]
    base, lines = [prose(60) for _ in range(6)], [prose(n) for n in (2, 5, 6, 9)]
    rows = [[i, "\n".join([prose(40), rng.choice(lines), prose(20)]), f"s{i % 4}"] for i in range(30)]
    rows += [[100 + i, base[i % 6] + (" " + prose(2) if i % 3 else ""), None if i == 5 else "s1"] for i in range(12)]
    rows += [[200 + i, prose(25) + ", " + items[i % 3] + ". " + prose(30), "s2"] for i in range(6)] + [[300, items[0] + " tail", "s2"]]
    rows += [[None, prose(30), "s3"], [400, None, "s0"], [401, "", "s0"], [402, "123 !!", "s0"], [5, rows[5][1], "s1"], [403, "word " * 4000, "s1"]]
    schema = spark.read.parquet(f"{sf}/documents.parquet").schema
    docs = spark.createDataFrame([(i, t, "xx", s, len(t or "")) for i, t, s in rows], schema).withColumns({c: F.lit(7) for c in ("score", "lang_pred", "rid", "n_lines", "size", "taken", "_key")})
    spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "", r[2] or "")
    table, want = docs.repartition(5), [list(r) for r in rows]
    plain = [lambda rs: [r for r in rs if re.search("[a-z]", r[1] or "")], _lines, _distinct, lambda rs: _clean(rs, items)]
    for i, ((name, stage), by_hand) in enumerate(zip(corpus_pipeline.STAGES, plain, strict=False)):
        out = stage(spark, table, str(tmp_path))
        assert out.columns == docs.columns and not out.where("score <> 7 or lang_pred <> 7 or rid <> 7 or n_lines <> 7 or size <> 7 or taken <> 7").count(), name
        out.write.parquet(str(tmp_path / f"stage{i}"))
        table, want = spark.read.parquet(str(tmp_path / f"stage{i}")), by_hand(want)
        got = sorted(([r.doc_id, r.text, r.source] for r in table.collect()), key=key)
        assert got == sorted(want, key=key), name
        want = got
    mixed = corpus_pipeline.STAGES[4][1](spark, table, str(tmp_path)).collect()
    sizes, place, order, taken = {}, {}, {}, {}
    for i, t, s in want:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    full = set()
    while True:
        left = sum(sizes.values()) - sum(3 * sizes[s] for s in full)
        rest = [s for s in names if s not in full]
        target = {s: 3 * sizes[s] if s in full else left * weight[s] / sum(weight[x] for x in rest) for s in names}
        if not (above := {s for s in rest if target[s] > 3 * sizes[s]}):
            break
        full |= above
    hashed = lambda r: md5((md5((r[1] or "").encode()).hexdigest() if r[0] is None else str(r[0])).encode()).hexdigest()[:8]
    for r in sorted(want, key=lambda r: (hashed(r), r[0] or 0, len((r[1] or "").split()))):
        n = len((r[1] or "").split())
        before = place.get(r[2], 0)
        for e in range(3):
            if e * sizes[r[2]] + before + n / 2 < target[r[2]]:
                taken[r[0], r[1], e] = (e * sizes[r[2]] + before) / max(target[r[2]], 1)
        place[r[2]] = before + n
    assert all(r["size"] == r.taken == r["_key"] == 7 for r in mixed)
    assert sorted(taken, key=repr) == sorted(((r.doc_id, r.text, r.copy) for r in mixed), key=repr)
    flat = [s for k, s in enumerate(names) if k % 3 == 0]  # their weight does not change over time
    assert all(abs(r.position - taken[r.doc_id, r.text, r.copy]) < 1e-9 for r in mixed if r.source in flat)
    assert [r.position for r in mixed] == sorted(r.position for r in mixed)


def test_stages_of_an_empty_table(spark, sf, tmp_path):
    shutil.copy(f"{sf}/benchmark.parquet", tmp_path / "benchmark.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0
