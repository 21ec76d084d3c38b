"""The near-duplicate stage of the pipeline against all pairs of shingle sets."""

from __future__ import annotations

import numpy as np
import pytest

import corpus_pipeline
from roadflow.llm import set_join, simhash

COLUMNS = "doc_id long, text string, lang string"


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())


def similar(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def brute_kept(docs):
    sets = [shingles(t) for _, t, _ in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if similar(sets[i], sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    groups: dict[int, list] = {}
    for i, d in enumerate(docs):
        groups.setdefault(find(i), []).append((d[0] is None, d[0] or 0))
    return sorted(min(g) for g in groups.values())


def kept(spark, docs):
    rows = corpus_pipeline.keep_one_of_each_group(spark, spark.createDataFrame(docs, COLUMNS).repartition(5), "")
    assert rows.columns == ["doc_id", "text", "lang"]
    return sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rows.collect())


def edited(rng, words, times, tag):
    copy = list(words)
    for i in rng.choice(len(copy), times, replace=False):
        copy[i] = f"{tag}x{i}"
    return copy


def test_texts_below_the_similarity_stay(spark):
    """Pairs at 0.6 to 0.79, many of them within 12 bits."""
    rng = np.random.default_rng(5)
    docs = []
    for k in range(60):
        words = [f"w{i}" for i in rng.integers(0, 5000, 300)]
        docs += [(2 * k, " ".join(words), "en"), (2 * k + 1, " ".join(edited(rng, words, 9 + k % 7, k)), "en")]
    sets = [shingles(t) for _, t, _ in docs]
    below = [k for k in range(60) if not similar(sets[2 * k], sets[2 * k + 1])]
    fps = simhash.fingerprints([t.encode() for _, t, _ in docs], 5)
    linked = [k for k in below if np.bitwise_count(fps[2 * k] ^ fps[2 * k + 1]) <= 12]
    assert len(linked) >= 5  # near by their fingerprints, and yet no copies
    assert kept(spark, docs) == brute_kept(docs)


@pytest.mark.parametrize("most", [4, 2048])
def test_odd_texts_and_chains(spark, monkeypatch, most):
    monkeypatch.setattr(set_join, "MOST_IN_GROUP", most)
    rng = np.random.default_rng(most)
    docs = [(900, None, "a"), (901, "", "a"), (None, " \n", "a"), (902, "one", "a"), (903, "ONE ", "a"), (904, "a b c d e", "a"), (904, "a b c d e", "a"), (None, "a b c d e", "a"), (905, "a b c d f", "a")]
    words = [f"w{i}" for i in rng.integers(0, 900, 120)]
    for k in range(30):  # a chain of copies of copies
        docs.append((k, " ".join(words), "b"))
        words = edited(rng, words, 1 + k % 4, k)
    base = [f"v{i}" for i in rng.integers(0, 900, 150)]
    docs += [(100 + k, " ".join(edited(rng, base, 1 + k % 6, f"s{k}")), "c") for k in range(40)]  # a star without its centre
    order = rng.permutation(len(docs))
    docs = [docs[i] for i in order]
    assert kept(spark, docs) == brute_kept(docs)
    assert kept(spark, [docs[0]]) == brute_kept([docs[0]])
    empty = spark.createDataFrame(docs, COLUMNS).limit(0)
    assert corpus_pipeline.keep_one_of_each_group(spark, empty, "").count() == 0


def test_near_copies_at_the_edge_go(spark):
    """Pairs at 0.8 to 0.85, many of them beyond the trie's three bits."""
    rng = np.random.default_rng(7)
    docs = []
    for k in range(150):
        words = [f"w{i}" for i in rng.integers(0, 5000, 200)]
        docs += [(2 * k, " ".join(words), "en"), (2 * k + 1, " ".join(edited(rng, words, 4, k)), "en")]
    fps = simhash.fingerprints([t.encode() for _, t, _ in docs], 5)
    near = [k for k in range(150) if similar(shingles(docs[2 * k][1]), shingles(docs[2 * k + 1][1]))]
    missed = [k for k in near if np.bitwise_count(fps[2 * k] ^ fps[2 * k + 1]) > simhash.BUDGET]
    assert len(missed) >= 3  # the trie alone would leave both
    assert kept(spark, docs) == brute_kept(docs)


def test_the_trie_finds_what_is_within_its_budget(spark):
    rng = np.random.default_rng(8)
    docs = []
    for k in range(40):
        words = [f"w{i}" for i in rng.integers(0, 5000, 400)]
        docs += [(2 * k, " ".join(words), "en"), (2 * k + 1, " ".join(edited(rng, words, 1, k)), "en")]
    sets = set_join.shingle_sets(spark.createDataFrame(docs, COLUMNS), shingle=5)
    rows = {r["id"]: (r["uid"], r["fp"] & (2**64 - 1)) for r in sets.collect()}
    fps = simhash.fingerprints([t.encode() for _, t, _ in docs], 5)
    assert [rows[i][1] for i in range(80)] == fps.tolist()
    pairs = {frozenset(r) for r in simhash.trie_pairs(sets).collect()}
    within = [k for k in range(40) if np.bitwise_count(fps[2 * k] ^ fps[2 * k + 1]) <= simhash.BUDGET]
    assert len(within) > 20 and all(frozenset((rows[2 * k][0], rows[2 * k + 1][0])) in pairs for k in within)
