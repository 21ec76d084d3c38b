"""Repeats of one or two long lines in the pipeline's line dedup, against all spans of lines."""

from __future__ import annotations

import numpy as np

import corpus_pipeline


def brute(docs):
    seen, out = set(), []
    for i, text in docs:
        lines = (text or "").split("\n")
        at = [k for k, x in enumerate(lines) if x.strip(" \t\r\x0b\x0c")]
        keys = [lines[k].strip(" \t\r\x0b\x0c") for k in at]
        gone = set()
        for r in (1, 2, 3):
            for s in range(len(keys) - r + 1):
                w = tuple(keys[s : s + r])
                if r == 3 or sum(len(x.split()) for x in w) >= 50:
                    if w in seen:
                        gone |= set(at[s : s + r])
                    seen.add(w)
        out.append((i, None if text is None else "\n".join(x for k, x in enumerate(lines) if k not in gone)))
    return out


def test_long_lines_go(spark):
    rng = np.random.default_rng(8)
    pool = [" ".join(f"w{i}" for i in rng.integers(0, 99, n)) for n in (1, 2, 3, 20, 24, 25, 26, 30, 49, 50, 51, 80)] + ["", " \t"]
    docs = [(i, "\n".join(rng.choice(pool, rng.integers(0, 6)))) for i in range(60)]
    docs += [(100, pool[-3]), (101, f" {pool[-3]} "), (102, None), (103, pool[8]), (104, pool[8])]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = sorted((r["doc_id"], r["text"]) for r in corpus_pipeline.drop_repeated_lines(spark, frame, "").collect())
    assert got == brute(docs)
    kept = dict(got)
    assert kept[101] == "" and kept[104] == pool[8]
