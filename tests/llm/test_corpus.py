"""Near-duplicates, decontamination, shards and the pipeline against brute force."""

from __future__ import annotations

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from posegrid.llm import decontamination, neardup, sharding
from posegrid.llm.common import Workspace
from posegrid.llm.components import connected_components

SCHEMA = "doc_id long, text string, component_id string, size int"


def shingle_set(text, width):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return set(zip(*(w[k:] for k in range(width)))) if len(w) >= width else {tuple(w)} if w else set()


def brute(rows, width, percent):
    sets = [shingle_set(t, width) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), i), i)
    return {(i, len(sets[k]), least[find(k)]) for k, (i, _) in enumerate(rows)}


def corpus(seed):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    base = [r.choices(vocabulary, k=r.choice([2, 5, 30, 120])) for _ in range(25)]
    shared = r.choices(vocabulary, k=80)
    texts = [None, "", "one", "One ", "one\ttwo", " ".join(r.choices(vocabulary, k=9000))]
    for _ in range(130):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 2, 4])):
            w[r.randrange(len(w))] = r.choice(vocabulary)
        texts.append(r.choice([" ", "\n", "  "]).join(w).upper() if r.random() < 0.1 else " ".join(w))
    texts += [" ".join(shared + r.choices(vocabulary, k=r.choice([5, 15, 40]))) for _ in range(50)]
    ids = r.sample(range(10_000), len(texts))
    return list(zip(ids, texts))


@pytest.mark.parametrize("width, percent, seed, block, work", [(3, 85, 1, 1024, 1 << 23), (5, 80, 2, 8, 20)])
def test_near_duplicates(spark, monkeypatch, width, percent, seed, block, work):
    """The second case makes blocks and buckets tiny, so that hot buckets are split by further bands."""
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "WORK", work)
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)
    got = neardup.near_duplicates(df, width, percent).collect()
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got} == brute(rows, width, percent)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_hot_buckets_lose_nothing(spark, monkeypatch):
    """Pairs that share only the hot bucket's band are found as in small tables."""
    r = random.Random(4)
    rows = [(k, " ".join(r.sample([f"w{j}" for j in range(60)], 40)), "x", 1) for k in range(120)]
    df = spark.createDataFrame(rows, SCHEMA)
    found = []
    for work in (1 << 23, 0):
        monkeypatch.setattr(neardup, "WORK", work)
        found.append({(x["doc_id"], x["component_id"]) for x in neardup.near_duplicates(df, 1, 62).collect()})
    assert found[0] == found[1] and 1 < len({c for _, c in found[0]}) < 120


def test_near_duplicate_edges(spark):
    df = spark.createDataFrame([(None, "a b c d e f", "", 0), (7, "a b c d e f", "", 0), (7, "a b c d e f", "", 0), (3, None, "", 0), (None, None, "", 0)], SCHEMA)
    got = sorted(((r["doc_id"] or -1, r["component_id"] or -1, r["kept"]) for r in neardup.near_duplicates(df).collect()))
    assert got == [(-1, -1, True), (-1, 7, False), (3, 3, True), (7, 7, True), (7, 7, True)]
    assert neardup.near_duplicates(df.limit(0)).count() == 0
    kept = neardup.deduplicate(df)
    assert kept.columns == df.columns
    assert [(r["doc_id"], r["text"]) for r in kept.where("text IS NOT NULL").collect()] == [(7, "a b c d e f")]
    assert kept.where("text IS NULL").count() == 2
    assert neardup.deduplicate(df.limit(0)).count() == 0


def test_ids_with_several_texts(spark):
    """Every text of an id is a vertex of its own; no link is lost and one row of a group stays."""
    r = random.Random(9)
    a, b, c = (r.choices([f"v{k}" for k in range(500)], k=60) for _ in range(3))
    near = lambda w: " ".join(w[:-1] + ["other"])
    rows = [(7, " ".join(a)), (7, " ".join(b)), (8, near(a)), (9, near(b)), (9, " ".join(c)), (None, near(c)), (5, " ".join(c))]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)
    got = sorted((x["doc_id"] or 0, x["component_id"]) for x in neardup.near_duplicates(df).collect())
    assert got == [(0, 5), (5, 5), (7, 7), (7, 7), (8, 7), (9, 5), (9, 7)]
    kept = sorted((x["doc_id"], x["text"]) for x in neardup.deduplicate(df).collect())
    assert kept == sorted([(7, " ".join(a)), (7, " ".join(b)), (5, " ".join(c))])
    both = spark.createDataFrame([(7, " ".join(a), "x", 1), (7, near(a), "x", 1), (None, " ".join(c), "x", 1), (None, near(c), "x", 1)], SCHEMA)
    assert sorted(x["doc_id"] or 0 for x in neardup.deduplicate(both).collect()) == [0, 7]  # one of each group


def test_bitmap_only_spares_work(spark, monkeypatch):
    """Absent keys may pass, present ones always do, at any fill."""
    from posegrid.llm import bitmaps

    keys = spark.range(0, 60_000, 3).selectExpr("id AS k")
    rows = spark.range(60_000).selectExpr("id", "'x' AS p")
    for most in (4096, 1):
        monkeypatch.setattr(bitmaps, "MOST_ROWS", most)
        marks = bitmaps.Bitmap(keys, "k")
        held, rest = (marks.split(rows, "id", held=h) for h in (True, False))
        assert held.where("id % 3 = 0").count() == 20_000 and held.count() + rest.count() == 60_000
        assert held.count() < (23_000 if most > 1 else 45_000)
    assert bitmaps.Bitmap(keys.limit(0), "k").split(rows, "id", held=True).count() == 0


def test_estimate_is_close():
    r = np.random.default_rng(1)
    x = r.integers(0, 2**63, 3000, dtype=np.uint64)
    for a, b in ((x[:2000], x[200:2200]), (x[:1000], x[500:1500]), (x[:1000], x[:1000]), (x[:1000], x[2000:])):
        regs = neardup.registers(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        got = neardup.estimate(regs[:1], regs[1:], np.array([float(len(a))]), np.array([float(len(b))]))[0]
        assert abs(got - true) < 0.12
    whole = neardup.registers(x, np.array([0, 3000]))
    parts = neardup.registers(x, np.array([0, 1300, 3000]))
    assert (parts.max(axis=0) == whole[0]).all()  # registers merge by maximum


def test_components(spark):
    r = random.Random(4)
    edges = [(k, k + 1) for k in range(40)] + [(100 + r.randrange(30), 100 + r.randrange(30)) for _ in range(25)]
    got = {x["v"]: x["component"] for x in connected_components(spark.createDataFrame(edges, "a long, b long"), Workspace(spark)).collect()}
    assert all(got[k] == 0 for k in range(41))
    assert all(got[a] == got[b] for a, b in edges if a != b)
    assert all(got[c] == c and c == min(k for k in got if got[k] == c) for c in set(got.values()))


def test_containment(spark):
    r = random.Random(6)
    vocabulary = [f"Wort{k}é" for k in range(3000)]
    items = [(k, " ".join(r.choices(vocabulary, k=r.choice([1, 3, 5, 6, 12, 40, 150])))) for k in range(60)] + [(60, None), (61, ""), (5, "again " * 3)]
    docs = []
    for k in range(150):
        w = r.choices(vocabulary, k=r.choice([0, 3, 50, 3000]))
        for _ in range(r.randint(0, 3)):
            item = (r.choice(items)[1] or "").split()
            if item and r.random() < 0.5:
                item[r.randrange(len(item))] = "changed"
            at = r.randint(0, len(w))
            w[at:at] = [x.upper() + r.choice(["", ",", "."]) for x in item] if r.random() < 0.3 else item
        docs.append((k, r.choice([" ", "\n"]).join(w)))
    docs += [(900, None), (901, items[0][1]), (901, items[0][1])]
    sets = [(i, decontamination.shingle_set(t, 5)) for i, t in items]
    wanted = sorted((d, i, len(s), c) for d, t in docs for own in [decontamination.shingle_set(t, 5)] for i, s in sets if s for c in [len(s & own)] if 100 * c >= 80 * len(s))
    d, i = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS item_id"), spark.createDataFrame(items, "item_id long, text string")
    got = sorted((x["doc_id"], x["item_id"], x["n_item"], x["n_shared"]) for x in decontamination.containments(d, i).collect())
    assert got == wanted and len(wanted) > 30
    left = sorted((x["doc_id"], x["text"] or "") for x in decontamination.clean(d, i).collect())
    leak = lambda t: any(s and 100 * len(s & decontamination.shingle_set(t, 5)) >= 80 * len(s) for _, s in sets)
    assert left == sorted((k, t or "") for k, t in docs if not leak(t))
    assert decontamination.containments(d, i.limit(0)).count() == 0 and decontamination.containments(d.limit(0), i).count() == 0
    assert decontamination.clean(d, i.limit(0)).columns == d.columns


def test_clean_judges_rows(spark):
    """Rows that share an id, or have none, are judged by their own text."""
    item = "one two three four five six seven"
    docs = spark.createDataFrame([(1, "x " + item, "a"), (1, "clean text", "b"), (None, item + " y", "c"), (None, "also clean", "d"), (None, None, None)], "doc_id long, text string, item_id string")
    left = decontamination.clean(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert left.columns == docs.columns and sorted(x["item_id"] or "" for x in left.collect()) == ["", "b", "d"]


def test_benchmark_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "PASS_SHINGLES", 10)
    items = spark.createDataFrame([(k, f"a{k} b{k} c{k} d{k} e{k} f{k}") for k in range(5)], "item_id long, text string")
    docs = spark.createDataFrame([(k, f"x y a{k} b{k} c{k} d{k} e{k} f{k} z") for k in range(5)], "doc_id long, text string")
    assert sorted((x["doc_id"], x["item_id"]) for x in decontamination.containments(docs, items).collect()) == [(k, k) for k in range(5)]


@pytest.mark.parametrize("law", ["bytes", "rows"])
def test_shards(spark, law):
    r = random.Random(8)
    texts = ["hot text " * 20] * 700 + ["".join(r.choices("abcé ", k=r.randint(0, 300))) for _ in range(1300)] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 AS size", "2 AS shard")
    got = sharding.shard(df, 16, law).collect()
    assert sorted(x["doc_id"] for x in got) == list(range(len(texts)))
    sizes, slots = [0] * 16, [[] for _ in range(16)]
    for x in got:
        raw = (texts[x["doc_id"]] or "").encode()
        assert (x["size"], x["text_crc32"]) == (len(raw) + 1, zlib.crc32(raw))
        sizes[x["shard"]] += x["size"] if law == "bytes" else 1
        slots[x["shard"]].append(x["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots)
    assert max(sizes) - min(sizes) <= (700 if law == "bytes" else 1)
    assert sorted(map(tuple, sharding.shard(df.repartition(3), 16, law).collect())) == sorted(map(tuple, got))


def test_few_numbers_reach_the_driver(spark, monkeypatch):
    """At most 64 counts for each open splitter and pass."""
    from pyspark.sql.classic.dataframe import DataFrame

    seen, collect = [], DataFrame.collect
    monkeypatch.setattr(DataFrame, "collect", lambda self: seen.append(rows := collect(self)) or rows)
    keys = spark.range(20_000).select(F.xxhash64("id").alias("h"), F.col("id").alias("i"), F.lit(1).cast("long").alias("w"))
    targets = [(20_000 * k / 50, 0.5) for k in range(1, 50)]
    cuts = sharding.splitters(keys, targets)
    assert seen and max(map(len, seen)) <= 64 * 49
    order = sorted((r["h"], r["i"]) for r in collect(keys))
    assert all(abs(sum(k < cut for k in order) - t) <= 0.5 for cut, (t, _) in zip(cuts, targets))


def test_shard_edges(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b"), (None, None)], "doc_id long, text string")
    got = sharding.shard(df).collect()
    assert len(got) == 4 and len({(x["shard"], x["slot"]) for x in got}) == 4
    assert sharding.shard(df.limit(0)).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(11)
    words = {"en": "the of and that with this house river stone light".split(), "de": "der und nicht ein auch für haus fluss stein licht".split()}
    made = [(k, " ".join(r.choices(words[lang], k=40)), lang) for k in range(60) for lang in [("en", "de")[k % 2]]]
    item = " ".join(f"q{k}" for k in range(20))
    extra = [(100, made[3][1], "de"), (101, None, "en"), (102, "12 34 !!", "en"), (103, " ".join(r.choices(words["en"], k=20)) + " " + item, "en"), (104, made[0][1] + " end", "en")]
    docs = spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in made + extra], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {x["doc_id"]: x for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == set(range(60))
    assert all(got[i]["decoded"] == t and got[i]["n_tokens"] == len(got[i]["ids"]) for i, t, _ in made)
    extra = docs.unionByName(docs.limit(3)).unionByName(docs.limit(1).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "text", "lang", "source", "n_chars"))
    extra = extra.selectExpr("*", "0.5 AS score", "'mine' AS lang_pred", "'k' AS key", "1 AS v", "2 AS item_id", "'t' AS slot", "3 AS own_id", "4 AS gone_key")
    for frame in (extra, extra.limit(0)):
        n = frame.count()
        for _, stage in corpus_pipeline.STAGES[:-1]:
            frame = stage(spark, frame, str(tmp_path))
            assert frame.columns == extra.columns
        rows = frame.collect()
        assert sorted(x["doc_id"] for x in rows) == (list(range(60)) if n else [])
        assert all((x["score"], x["lang_pred"], x["key"], x["v"]) == (0.5, "mine", "k", 1) for x in rows)
    frame = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, str(tmp_path))
        assert frame.columns == docs.columns
    assert frame.agg(F.count("*")).first()[0] == 60
