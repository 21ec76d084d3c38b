from __future__ import annotations

import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from roadflow.llm import packing, pii, queries, url_rules


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([ \-]?[0-9])+", text):
        d = re.sub(r"\D", "", m[0])
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][ ().0-9-]+[0-9]", text) if 10 <= len(re.sub(r"\D", "", m[0])) <= 15]
    return sorted(out)


def test_plain_spans_match_the_patterns():
    rng = np.random.default_rng(0)
    pieces = ["a@b.c", "@", ".", "1.2.3.4", "256.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1111-1", "+1 (017) 555-7713", "+", "x%y", "é", " ", "00012.3.4.5.6", "john.doe@mail.example.com", "a@b@c.d.e", "12", "-", "a" * 70, "()"]
    for _ in range(2000):
        text = "".join(rng.choice(pieces, rng.integers(1, 9)))
        assert pii.plain_spans(text) == brute(text), text


CASES = [
    ("write to john (at) mail dot example dot com now", "email", "john (at) mail dot example dot com"),
    ("john.doe [at] example [dot] org!", "email", "john.doe [at] example [dot] org"),
    ("mail jane at example dot net", "email", "jane at example dot net"),
    ("call plus four nine one five one two three four five six seven eight", "phone", "plus four nine one five one two three four five six seven eight"),
    ("card four one one one one one one one one one one one one one one one ok", "card", "four one one one one one one one one one one one one one one one"),
    ("ip one nine two dot one six eight dot one dot seven x", "ip", "one nine two dot one six eight dot one dot seven"),
    ("j\u043ehn@ex\u0430mple.com", "email", "j\u043ehn@ex\u0430mple.com"),
    ("a\u200bbc@exam\u200bple.org", "email", "a\u200bbc@exam\u200bple.org"),
    ("\uff11\uff12\uff17.0.0.1 é", "ip", "\uff11\uff12\uff17.0.0.1"),
]


@pytest.mark.parametrize("text,kind,span", CASES)
def test_disguises_map_back_to_the_source(text, kind, span):
    text = "ünïcode before, " + text
    plain = pii.plain_spans(text)
    got = pii.disguised_spans(text, plain)
    assert [(pii.KINDS[k], text[a:b]) for a, k, b in got if (a, k, b) not in plain] == [(kind, span)]


@pytest.mark.parametrize("text", ["look at the dot example here", "oneself two three fours", "at one or two places", "we met at noon. dot", "123@x.com"])
def test_prose_is_left_alone(text):
    assert pii.disguised_spans(text, pii.plain_spans(text)) == []


def planted(rng, words):
    """A text with disguised identifiers in prose, and their spans."""
    digits = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine"]
    pick = lambda: str(rng.choice(words))
    alike = {"a": "\u0430", "e": "\u0435", "o": "\u043e", "c": "\u0441", "p": "\u0440"}
    text, spans = "", []
    for _ in range(int(rng.integers(1, 6))):
        text += " ".join(pick() for _ in range(int(rng.integers(3, 12)))) + " "
        user, host, number = pick(), pick(), [str(d) for d in rng.integers(0, 10, 11)]
        kind, hidden = [
            ("email", f"{user} (at) {host} (dot) com"), ("email", f"{user}[at]{host}[dot]org"), ("email", f"{user} at {host} dot net"), ("email", f"{user}.x@{host}.com".replace("e", alike["e"]).replace("a", alike["a"]) + "\u200b.org"),
            ("phone", "plus four nine " + " ".join(digits[int(d)] for d in number)), ("phone", "plus 49 " + "".join(number[:9])), ("ip", "one two seven dot zero dot zero dot " + digits[int(rng.integers(1, 10))]),
            ("ip", "10\u2024" + "\u2024".join(str(int(x)) for x in rng.integers(0, 256, 3))),
        ][int(rng.integers(8))]
        spans.append((kind, len(text), len(text) + len(hidden)))
        text += hidden + ", "
    return text, spans


def test_recall_and_precision_of_added_spans():
    rng = np.random.default_rng(5)
    words = ["table", "green", "house", "walked", "sing", "paper", "lamp", "river", "stone", "market", "cheap", "garden"]
    wanted = found = right = 0
    for _ in range(300):
        text, spans = planted(rng, words)
        plain = pii.plain_spans(text)
        got = [(pii.KINDS[k], a, b) for a, k, b in pii.disguised_spans(text, plain)]
        wanted, found = wanted + len(spans), found + len(got)
        right += sum(any(k == kind and x < b and y > a for k, x, y in got) for kind, a, b in spans)
    assert right / wanted >= 0.95 and right / found >= 0.95, (right, wanted, found)


def test_long_texts_in_linear_time_and_pieces():
    import time

    took = []
    for n in (40_000, 80_000):
        hard = ["a" * n + " " + "b" * n + "@x.org", " " * n, "(" * n, "+1" + "(" * n, "1." * n, "a@" * n, "plus " * n, "one " * n, " dot " * n]
        began = time.perf_counter()
        for text in hard:
            pii.disguised_spans(text, pii.plain_spans(text))
        took.append(time.perf_counter() - began)
    assert took[1] < 4 * took[0] + 1
    hidden = "jane (at) example (dot) com"
    text = ("filler words here. " * 6898)[: pii.PIECE - 10] + " " + hidden + " " + "x " * 200_000 + hidden
    assert [text[a:b] for a, _, b in pii.disguised_spans(text, [])] == [hidden, hidden]
    many = [(2 * i, 1, 2 * i + 1) for i in range(100)]
    assert pii.disguised_spans(hidden, sorted([(0, 0, 50), *many])) == []


def test_find(spark):
    texts = [None, "", "a@b.c and +1 (017) 555-7713", "9" * 200_000, "a" * 200_000 + "@x.y", "x [at] y [dot] com a@b.c", "a@b.c and +1 (017) 555-7713"]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    got = {r["doc_id"]: r for r in pii.find(df).collect()}
    assert got[2]["plain"] == got[2]["spans"] == got[6]["spans"] == "email:0:5,phone:10:27" and got[0]["spans"] == got[1]["spans"] == got[3]["spans"] == ""
    assert got[4]["n_email"] == 1 and got[5]["plain"] == "email:19:24" and got[5]["spans"] == "email:0:18,email:19:24"
    assert pii.find(df.limit(0)).count() == 0


def judge(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0].translate({65 + i: 97 + i for i in range(26)})
        path = re.match(r"[^?#]*", rest[len(re.match(r"[^/?#]*", rest)[0]) :])[0]
    best = max(((len(h + p), len(h), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)), default=None)
    return host, path, best and best[2], best[3] if best else default


def test_url_rules(spark):
    rng = np.random.default_rng(2)
    hosts = ["com", "example.com", "a.example.com", "b.a.example.com", "xample.com", "org", "", "EXAMPLE.com", "a..com", "example.com:80"]
    paths = ["", "/", "/a", "/a/b", "/a/b/c", "/ab", "?q", "/a?x#y", "#f", "/é/1", "/a/\U0010ffff"]
    urls = [f"{s}{h}{p}" for s in ("http://", "x", "") for h in hosts for p in paths] + [None, "http://", "a://b://com/a"] + ["http://a.example.com/a/b"] * 30
    rules = [("allow", "com", "/"), ("block", "com", "/a"), ("allow", "example.com", "/a/b"), ("block", "a.example.com", ""), ("block", "org", ""), ("allow", "b.a.example.com", "/a/b/c"), ("block", "example.com", "/é"), ("allow", "com", "/a/")]
    pages = spark.createDataFrame([(int(i) if i % 9 else None, u, "clash") for i, u in enumerate(rng.permutation(np.array(urls, object)))], "page_id long, url string, host string")
    table = spark.createDataFrame(rules, "verdict string, host string, path string")
    got = [tuple(r) for r in url_rules.judge(pages, table, salts=3).collect()]
    expected = [(r["page_id"], *judge(r["url"], rules)) for r in pages.collect()]
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    assert url_rules.judge(pages.limit(0), table).count() == 0
    assert {r["verdict"] for r in url_rules.judge(pages, table.limit(0), default="block").collect()} == {"block"}
    both = spark.createDataFrame([("allow", "com", "/a"), ("block", "com", "/a")], "verdict string, host string, path string")
    assert url_rules.judge(pages, both).filter("rule = 'com/a' AND verdict = 'allow'").count() == 0


def test_url_rules_of_any_depth_and_nesting(spark):
    deep = [".".join(["x"] * d) for d in range(1, 121)]
    rules = [("allow" if d % 2 else "block", h, "") for d, h in enumerate(deep, 1)] + [("block" if d % 3 else "allow", "n.org", "/a" * d) for d in range(1, 400)] + [("block", "n.org", f"/b{d}") for d in range(300)]
    urls = [f"http://{deep[d - 1]}/p" for d in (1, 63, 64, 65, 70, 120)] + [f"http://y.{deep[119]}/", "http://x.x.y/", "http://n.org" + "/a" * 500 + "/", "http://n.org" + "/a" * 200, "http://n.org/b77/c", "http://n.org/b", "http://m.n.org/a/ab"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = sorted(tuple(r) for r in url_rules.judge(pages, spark.createDataFrame(rules, "verdict string, host string, path string")).collect())
    assert got == [(i, *judge(u, rules)) for i, u in enumerate(urls)]


def test_url_plan_has_no_python(spark, sf_dir):
    plan = queries.op5_url_filter(spark, sf_dir)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct|BroadcastNestedLoop", plan)


def test_word_tokenizer_is_the_tokenizer():
    path = public_tokenizers.path("word_bpe_49k.json")
    text = open(path, encoding="utf-8").read()
    t, mine = Tokenizer.from_str(text), packing.WordTokenizer(text)
    texts = ["a\u00a0b  c\x1cd\u2028e <|endoftext|> x<|startoftext|>y", "", "don't  İ ẞ ΑΣ Σ", "e\u0301 e \u0301x", "it's we're I'LL 'tis 'S's ''s !'s '", "x'", "'", "'r 're 'res 'l", "ÀÉ×÷ßÞþÿ Ÿ 12a3 4.5 a_b \x7f", "they'd've 's\n't", "é" * 3 + "'s", "abc", "'s", "can't", "<|", "Straße 日本語 🙂"]
    rng = np.random.default_rng(0)
    pieces = ["a", "'", "s", "re", "LL", " ", "é", "É", "1", "!", "<", "|", "\n", "×", "Z"]
    texts += ["".join(rng.choice(pieces, 12)) for _ in range(300)]
    import pyarrow as pa

    from roadflow.llm.common import bytes_of

    got = mine(*bytes_of(pa.array(texts)))
    for x, e, s in zip(got, t.encode_batch(texts, add_special_tokens=False), texts):
        assert np.frombuffer(x, "<u4").tolist() == e.ids, s


def test_fullest_is_a_best_subset():
    rng = np.random.default_rng(4)
    for _ in range(200):
        lengths = sorted({int(x) for x in rng.integers(1, 20, 4)}, reverse=True)
        counts, room = [int(x) for x in rng.integers(1, 4, len(lengths))], int(rng.integers(0, 40))
        sums = {0}
        for n, c in zip(lengths, counts):
            sums = {s + k * n for s in sums for k in range(c + 1) if s + k * n <= room}
        got = packing.fullest(lengths, counts, room)
        assert sum(n * k for n, k in got) == max(sums) and all(k <= dict(zip(lengths, counts))[n] for n, k in got)


def check_packing(rows, capacity):
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_packing(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    texts = [None, "", "one two three", "words " * 100, "a b c d e f g h i j", "one two three", "x " * 10_000] + [f"n {i} " * (i % 9) for i in range(40)]
    df = spark.createDataFrame([(i if i != 3 else None, s, 1) for i, s in enumerate(texts)], "doc_id long, text string, length long").repartition(3)
    rows = packing.pack(packing.pieces(df, path, capacity=64), capacity=64, salts=3).collect()
    expected = []
    for i, s in enumerate(texts):
        ids = np.array(t.encode(s or "", add_special_tokens=False).ids + [1], "<u4")
        expected += [(i if i != 3 else None, k, a, len(ids[a : a + 64]), zlib.crc32(ids[a : a + 64].tobytes())) for k, a in enumerate(range(0, len(ids), 64))]
    assert sorted((tuple(r[:5]) for r in rows), key=repr) == sorted(expected, key=repr)
    assert check_packing(rows, 64) == -(-sum(e[3] for e in expected) // 64)
    assert packing.pack(packing.pieces(df.limit(0), path)).count() == 0


def test_plan_places_every_piece():
    rng = np.random.default_rng(5)
    lengths = np.minimum(4096, rng.lognormal(6, 1.2, 20_000).astype(int) + 1)
    counts = np.bincount(lengths, minlength=4097)
    p = packing.plan(counts)
    order = np.argsort(lengths, kind="stable")
    nth = np.empty(len(lengths), np.int64)
    nth[order] = np.arange(len(lengths)) - np.searchsorted(lengths[order], lengths[order])
    sequence, offset = packing.place(p, lengths.astype(np.int64), nth)
    bins = check_packing([{"sequence_id": a, "offset": b, "length": c} for a, b, c in zip(sequence.tolist(), offset.tolist(), lengths.tolist())], 4096)
    assert bins == p["bins"][0] and bins <= -(-lengths.sum() // 4096) + 2
