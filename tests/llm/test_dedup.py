"""Operators on repeated content, each against brute force on small fixtures."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
import xxhash

from roadflow.llm import components, decontaminate, line_dedup, simhash, substring_dedup

LOW = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def corpus(seed: int, n: int = 60, words: int = 40) -> list[tuple]:
    """Documents of few distinct words, with copies, shared passages, NULLs, blanks and one long text."""
    rng = np.random.default_rng(seed)
    vocabulary = np.array([f"W{i}" if i % 3 else f"wö{i}," for i in range(30)])
    passage = " ".join(vocabulary[rng.integers(0, 30, 33)])
    docs = []
    for i in range(n):
        text = " ".join(vocabulary[rng.integers(0, 30, rng.integers(0, words))])
        if i % 4 == 1:
            text += "  " + passage + "\n" + text
        if i % 7 == 3 and docs:
            text = docs[-1][1]
        docs.append((i * 7 % n, text, i))
    docs += [(1000, None, 0), (1001, "", 0), (1002, " \n\t ", 0), (1003, passage + " tail " + passage, 0), (1004, (passage + "\n") * 40, 0)]
    return docs


def frame(spark, docs):
    return spark.createDataFrame(docs, "doc_id long, text string, n_words long").repartition(5)


@pytest.mark.parametrize("seed,most", [(1, substring_dedup.MOST_IN_BUCKET), (2, 300), (3, 300)])
def test_substring_dedup(spark, seed, most):
    docs = corpus(seed)
    seen, expected = set(), {}
    for i, text, _ in sorted(docs):
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        covered = [False] * len(w)
        for s in range(len(w) - 19):
            k = tuple(w[s : s + 20])
            if k in seen:
                covered[s : s + 20] = [True] * 20
            seen.add(k)
        kept = [x for x, c in zip(w, covered) if not c]
        expected[i] = (len(w), sum(covered), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.dedup(frame(spark, docs), buckets=7, most_in_bucket=most).collect()}
    assert got == expected and any(e[1] for e in expected.values())


def test_substring_dedup_ties_and_empty(spark):
    text = " ".join(f"t{i}" for i in range(25))
    docs = [(5, text, 0), (5, text, 1), (None, text, 0), (None, None, 0), (9, text, 0)]
    got = sorted((str(r["doc_id"]), r["n_removed"]) for r in substring_dedup.dedup(frame(spark, docs), buckets=3).collect())
    assert got == [("5", 0), ("5", 0), ("9", 25), ("None", 0), ("None", 25)]
    assert substring_dedup.dedup(frame(spark, docs).limit(0), buckets=3).count() == 0
    named = spark.createDataFrame([("b", text), ("a", text), (None, text)], "doc_id string, text string")
    assert sorted((str(r["doc_id"]), r["n_removed"]) for r in substring_dedup.dedup(named).collect()) == [("None", 25), ("a", 0), ("b", 25)]


def test_clashing_columns_pass_through(spark):
    run = "one line here\nand another line\nthen a third line\n"
    rows = [(i, run + f"tail {i}", 7, "x", 1.5, i) for i in range(3)]
    names = "doc_id long, text string, __spans int, __id string, th double, `a.b` long"
    df = spark.createDataFrame(rows, names).withColumns({"__th": F.lit(1), "__bit": F.lit(2), "__row": F.lit(3), "__none": F.lit(4), "n_removed": F.lit(5)})
    cut = line_dedup.dedup(df, counts=True).orderBy("doc_id").collect()
    assert [r["n_removed"] for r in cut] == [0, 3, 3] and cut[1]["text"] == "tail 1" and cut[2]["a.b"] == 2 and cut[0]["__spans"] == 7
    assert line_dedup.dedup(df).columns == df.columns
    same = df.withColumn("text", F.lit("the very same words in every row of it"))
    kept = simhash.keep_one(same.unionByName(same), shingle=5)
    assert kept.columns == df.columns and [r["doc_id"] for r in kept.collect()] == [0]
    items = spark.createDataFrame([("i", "the very same words in every row of it")], "item_id string, text string")
    assert decontaminate.remove_contaminated(same, items).count() == 0


def brute_lines(docs, run=3):
    seen, out = set(), {}
    for i, text, _ in sorted(docs):
        lines = (text or "").split("\n")
        at = [k for k, x in enumerate(lines) if x.strip(" \t\r\x0b\x0c")]
        keys = [lines[k].strip(" \t\r\x0b\x0c") for k in at]
        gone = set()
        for s in range(len(keys) - run + 1):
            w = tuple(keys[s : s + run])
            if w in seen:
                gone |= set(at[s : s + run])
            seen.add(w)
        out[i] = None if text is None else "\n".join(x for k, x in enumerate(lines) if k not in gone)
    return out


@pytest.mark.parametrize("seed", [4, 5])
def test_line_dedup(spark, seed):
    rng = np.random.default_rng(seed)
    pool = ["alpha", "beta ", " gamma", "delta", "", "eps\t", "zeta", "\r"]
    docs = [(i, "\n".join(rng.choice(pool, rng.integers(0, 14))), 7) for i in range(80)]
    docs += [(100, None, 0), (101, "", 0), (102, "\n".join(["same"] * 9), 0), (103, "only", 0)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup(frame(spark, docs)).collect()}
    assert got == brute_lines(docs)
    assert line_dedup.dedup(frame(spark, docs).limit(0)).count() == 0
    both = [(1, "a\nb\nc", 0), (1, "a\nb\nc", 0), (None, "a\nb\nc", 0)]
    kept = [r["text"] for r in line_dedup.dedup(frame(spark, both)).collect()]
    assert sorted(kept) == ["", "a\nb\nc", "a\nb\nc"]


def test_winnowing_guarantee():
    rng = np.random.default_rng(0)
    for _ in range(50):
        h = rng.integers(0, 6, rng.integers(0, 30)).astype(np.uint64)
        at, first, times = line_dedup.winnow(h, 4)
        windows = [(f + k, p) for p, f, m in zip(at, first, times) for k in range(m)]
        assert [w for w, _ in windows] == list(range(max(0, len(h) - 3)))
        assert all(w <= p < w + 4 and h[p] == h[w : w + 4].min() for w, p in windows)


def brute_fingerprint(text, shingle):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    parts = [" ".join(w[k : k + shingle]) for k in range(len(w) - shingle + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_xxh64_and_fingerprints():
    data = bytes(np.random.default_rng(3).integers(0, 256, 400).astype(np.uint8))
    first = np.arange(0, 120)
    last = first + np.arange(120) % 70
    assert simhash.xxh64(data, first, last).tolist() == [xxhash.xxh64_intdigest(data[a:b], 42) for a, b in zip(first, last)]
    texts = [t for _, t, _ in corpus(9)] + ["one", "Two words", "É é É", "x" * 5000]
    for shingle in (3, 5):
        got = simhash.fingerprints([(t or "").encode() for t in texts], shingle)
        assert got.tolist() == [brute_fingerprint(t, shingle) for t in texts]


def brute_parts(fps):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(int(fps[i]) ^ int(fps[j])).count("1") <= 3:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize("most", [4, 1024])
def test_links_connect_all_near_fingerprints(spark, monkeypatch, most):
    monkeypatch.setattr(simhash, "MOST_IN_GROUP", most)
    rng = np.random.default_rng(most)
    centres = rng.integers(0, 2**63, 12, dtype=np.uint64)
    fps = set()
    for c in centres.tolist():
        for _ in range(25):
            x = c
            for b in rng.integers(0, 64, rng.integers(0, 6)):
                x ^= 1 << int(b)
            fps.add(x)
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    distinct = spark.createDataFrame([(x,) for x in signed], "fp long")
    got = {r["u"]: r["v"] for r in components.components(simhash.links(distinct)).collect()}
    parts: dict[int, set] = {}
    for i, r in enumerate(brute_parts(fps)):
        parts.setdefault(r, set()).add(signed[i])
    mine: dict[int, set] = {}
    for x in signed:
        mine.setdefault(got.get(x, x), set()).add(x)
    assert sorted(map(sorted, parts.values())) == sorted(map(sorted, mine.values()))


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7)], "u long, v long")
    got = {r["u"]: r["v"] for r in components.components(edges).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {101: 100}
    assert components.components(edges.limit(0)).count() == 0


def test_near_duplicates(spark):
    docs = corpus(11) + [(2000, None, 1), (None, "", 2), (None, "a b c d e", 3), (2001, "a b c d e", 3), (2001, "a b c d e", 3)]
    fps = [brute_fingerprint(t, 3) for _, t, _ in docs]
    root = brute_parts(fps)
    expected = []
    for (i, _, _), f, r in zip(docs, fps, root):
        ids = [d[0] for d, q in zip(docs, root) if q == r and d[0] is not None]
        expected.append((i, f, min(ids) if ids else None))
    got = [(r["doc_id"], r["fp"] & (2**64 - 1), r["component_id"]) for r in simhash.near_duplicates(frame(spark, docs), shingle=3).collect()]
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    assert simhash.near_duplicates(frame(spark, docs).limit(0), shingle=3).count() == 0


@pytest.mark.parametrize("seed", [6, 7])
def test_decontamination(spark, seed):
    docs = corpus(seed, words=60)
    rng = np.random.default_rng(seed)
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    texts = [d[1] for d in docs if d[1] and len(d[1]) > 150]
    items = [(k, " ".join(word.findall(texts[k].translate(LOW))[5 : 5 + int(m)])) for k, m in enumerate(rng.integers(1, 20, 12))]
    items += [(50, items[0][1]), (51, None), (52, "!!"), (53, "never seen words anywhere"), (None, items[1][1].upper()), (9, "W1 W2")]
    windows: dict[tuple, set] = {}
    for i, t in items:
        w = word.findall((t or "").translate(LOW))
        k = min(13, len(w))
        for s in range(len(w) - k + 1) if k else ():
            windows.setdefault(tuple(w[s : s + k]), set()).update([] if i is None else [str(i)])
    expected = []
    for i, t, _ in docs:
        w = word.findall((t or "").translate(LOW))
        covered, met = set(), set()
        for k in {len(x) for x in windows}:
            for s in range(len(w) - k + 1):
                if (x := tuple(w[s : s + k])) in windows:
                    met |= windows[x]
                    covered |= set(range(s, s + k))
        expected.append((i, len(w), len(covered), tuple(sorted(met)), bool(covered) and 20 * len(covered) >= len(w)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find(frame(spark, docs), bench).collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"]), r["contaminated"]) for r in got) == sorted(expected)
    left = {r["doc_id"] for r in decontaminate.remove_contaminated(frame(spark, docs), bench).collect()}
    assert left == {e[0] for e in expected if not e[4]}
    assert decontaminate.find(frame(spark, docs), bench.limit(0)).filter("n_hit > 0").count() == 0
    assert decontaminate.find(frame(spark, docs).limit(0), bench).count() == 0
