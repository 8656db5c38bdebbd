"""Ranked lexical search, whitening and secret scans against plain versions on small fixtures."""

import base64
import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamgrid.llm import lexical, secrets, whitening

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SMALL = {ord(c): ord(c) + 32 for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def plain_terms(text):
    return TERM.findall((text or "").translate(SMALL))


def plain_search(docs, items, k=20):
    """(item, rank, doc, score) by scoring every document for every item."""
    texts = [(d, Counter(w), len(w)) for d, t in docs if (w := plain_terms(t))]
    n_docs, n_terms = len(texts), sum(n for _, _, n in texts)
    df = Counter(t for _, c, _ in texts for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, c, n in texts:
            m = 75 + 25 * n * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t in plain_terms(text) if t in c)
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(item, i + 1, d, -s) for i, (s, _, _, d) in enumerate(sorted(scored, key=lambda x: x[:3])[:k])]
    return out


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["Größe", "NAÏVE", "ciónx", "日本語", "x²"]
    docs = [(i, " ".join(rng.choice(words[: rng.choice([5, 20, 65])]) for _ in range(rng.choice([1, 3, 30, 200]))).replace(" w1 ", rng.choice([" W1, ", "-w1.", "\tw1\n"]))) for i in range(n)]
    return docs


@pytest.mark.parametrize(("shard_docs", "block_bytes"), [(7, 100), (2048, 1 << 20)])
def test_search_equals_scoring_all(spark, shard_docs, block_bytes):
    docs = corpus(1, 150)
    docs += [(150, None), (151, ""), (152, "... !"), (None, docs[3][1]), (3, docs[3][1]), (9, docs[8][1]), (10, docs[8][1])]
    docs += [(200, "deep " + "w2 " * 30_000)]
    items = [(0, "w1 w2 w2 Größe w1"), (1, None), (2, ""), (3, "unknown terms"), (4, docs[8][1]), (5, "W3 日本語 x²"), (5, "W3 日本語 x²"), (None, "w7")]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").withColumns({c: F.lit("x") for c in ("score", "rank", "at", "ids", "terms", "_text")}).repartition(5)
    got = lexical.search(frame, spark.createDataFrame(items, "item_id bigint, text string").withColumn("score", F.lit(1)), shard_docs=shard_docs, block_bytes=block_bytes)
    rows = [tuple(r) for r in got.select("item_id", "rank", "doc_id", "score").collect()]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(rows, key=key) == sorted(plain_search(docs, items), key=key)
    assert len([r for r in rows if r[0] == 4]) == 20


def test_search_of_nothing(spark):
    docs, items = spark.createDataFrame([], "doc_id bigint, text string"), spark.createDataFrame([(1, "w1")], "item_id bigint, text string")
    assert lexical.search(docs, items).count() == 0
    assert lexical.search(items.withColumnRenamed("item_id", "doc_id"), docs.withColumnRenamed("doc_id", "item_id")).count() == 0


def test_tree_gives_best_first():
    """Ranges at every node keep the order by impact, and a search that starts at a score loses no tie."""
    rng = random.Random(5)
    texts = [[b"a"] * rng.randrange(0, 4) + [b"b"] * rng.randrange(0, 3) + [b"c"] for _ in range(37)]
    row = lexical.built(list(range(37)), texts, 37, sum(map(len, texts)))
    tree = lexical.Tree(row)
    for level in range(tree.levels + 1):
        assert len(tree.impacts[level]) == tree.starts[-1] + 1
    weights = {b"a": 3, b"b": 5, b"z": 1}
    every = tree.search(weights, 37, 1)
    assert every == sorted(every, key=lambda x: (-x[0], x[1]))
    for k in (1, 5, 20):
        assert tree.search(weights, k, 1) == every[:k]
        assert tree.search(weights, k, every[4][0]) == [x for x in every[:k] if x[0] >= every[4][0]]


def plain_whitening(vectors, k=32):
    x = np.array([[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors], dtype=object)
    n, s = len(x), x.sum(axis=0)
    z = n * x - s
    c = (z / n).astype(float)
    v = c.T @ c / n
    values, axes = np.linalg.eigh(v)
    return n, [int((r**2).sum()) for r in z], c, v, values[::-1], axes[:, ::-1]


@pytest.mark.parametrize(("width", "k"), [(6, 32), (40, 4)])
def test_whitening(spark, width, k):
    """Also with a basis smaller than the dimension, which takes several passes."""
    rng = np.random.default_rng(width)
    vectors = (rng.standard_normal((120, width)) * np.linspace(1, 3, width)).astype(np.float32).tolist()
    rows = [(i, v) for i, v in enumerate(vectors)] + [(None, vectors[0]), (3, vectors[3])]
    bad = [(500, None), (501, [float("nan")] + vectors[0][1:]), (502, [None] + vectors[0][1:]), (503, [float("inf")] * width), (504, [])]
    frame = spark.createDataFrame(rows + bad, "vec_id bigint, embedding array<float>").withColumns({c: F.lit(1) for c in ("id", "cells", "component", "n", "at", "v")}).repartition(3)
    got = whitening.whiten(frame, k).collect()
    n, deviation, c, v, values, axes = plain_whitening([r[1] for r in rows])
    m = min(k, width)
    assert len(got) == n * m and {r["n"] for r in got} == {n}
    assert {r["identity_error"] for r in got} == {got[0]["identity_error"]} and got[0]["identity_error"] < 1e-9
    want = {}
    for (i, _), d, row in zip(rows, deviation, c, strict=True):
        want.setdefault(i, (d, row))
    for r in got:
        j = r["component"] - 1
        assert r["deviation"] == want[r["vec_id"]][0]
        assert math.isclose(r["explained"], values[j] / np.trace(v), rel_tol=1e-9)
        assert abs(abs(r["whitened"]) - abs(want[r["vec_id"]][1] @ axes[:, j] / math.sqrt(values[j]))) < 1e-7
    by = {}
    for r in got:
        by.setdefault((r["vec_id"], r["component"]), []).append(r["whitened"])
    signs = {j: {np.sign(w[0]) * np.sign(want[i][1] @ axes[:, j - 1]) for (i, jj), w in by.items() if jj == j and abs(w[0]) > 1e-6} for j in range(1, m + 1)}
    assert all(len(s) == 1 for s in signs.values())


def test_whitening_without_variance(spark):
    shape = "vec_id bigint, embedding array<double>"
    assert whitening.whiten(spark.createDataFrame([], shape)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0])] * 3, shape)).count() == 0
    flat = whitening.whiten(spark.createDataFrame([(i, [float(i), 2.0, -float(i)]) for i in range(4)], shape)).collect()
    assert {r["component"] for r in flat} == {1} and abs(flat[0]["explained"] - 1) < 1e-12
    mixed = whitening.whiten(spark.createDataFrame([(i, [float(i % 3), float(i)][: 1 + i % 2]) for i in range(8)], shape)).collect()
    assert {r["n"] for r in mixed} == {4}


def test_whitening_of_extreme_entries():
    x = whitening.integers(np.array([[1e300, 0.5], [-1e300, 2.0**51 + 0.5]]))
    assert x[0][0] == int(1e300) * 64 + 1_000_000 and x[1][1] == (2**51) * 64 + 32 + 1_000_000 and x[0][1] == 1_000_032
    z = whitening.centred(x, 2, [int(x[0][0] + x[1][0]), int(x[0][1] + x[1][1])])
    assert whitening.deviations(z) == [None, None]


def test_whitening_of_large_entries(spark):
    rows = [(i, [float(i) * 1e14, float(i % 3)]) for i in range(9)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()
    n, deviation, *_ = plain_whitening([r[1] for r in rows])
    assert {r["vec_id"]: r["deviation"] for r in got} == {i: d if d < 2**63 else None for i, d in enumerate(deviation)}


def token(seed, n, alphabet="ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"):
    rng = random.Random(seed)
    return "".join(rng.choice(alphabet) for _ in range(n))


SECRET = 'ünï password: "hunter2hunter2", API_KEY=short and apikey = abcdefgh AKIA' + "QWERTY0123456789 AKIAX " + "0123456789abcdef" * 2 + " done"


def plain_base(text):
    """The fixed patterns read character by character."""
    key = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
    low = "".join(c.lower() if c.isascii() else c for c in text)
    out, i = [], 0
    while i < len(text):
        for word in ("password", "passwd", "secret", "token", "api_key", "apikey"):
            if low.startswith(word, i):
                j = i + len(word)
                j += text[j : j + 1] in ('"', "'") and j < len(text)
                while text[j : j + 1] == " ":
                    j += 1
                if text[j : j + 1] in ("=", ":") and j < len(text):
                    j += 1
                    while text[j : j + 1] == " ":
                        j += 1
                    j += text[j : j + 1] in ('"', "'") and j < len(text)
                    e = j
                    while e < len(text) and text[e] in key:
                        e += 1
                    if e > j:
                        if e - j >= 8:
                            out.append((i, 0, e))
                        i = e - 1
                        break
        i += 1
    for k, (head, alphabet, least) in enumerate((("AKIA", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 16), ("", "0123456789abcdef", 32)), 1):
        i = 0
        while i < len(text):
            if text.startswith(head, i) and text[i + len(head) : i + len(head) + 1] in tuple(alphabet):
                e = i + len(head)
                while e < len(text) and text[e] in alphabet:
                    e += 1
                if e - i >= least:
                    out.append((i, k, e))
                i = e
            else:
                i += 1
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(out))


def test_secrets(spark):
    rng = random.Random(3)
    parts = ["password", "PassWd", "secret", "token", "Api_Key", "apikey", "'", '"', " ", "  ", "=", ":", "AKIA", "abcdefgh", "0123456789abcdef", "ABCDEFGHIJ", "é", "ſecret", "toKen", "-", ".", "\n"]
    texts = [SECRET, None, "", "plain words only"] + ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 40))) for _ in range(400)]
    frame = spark.createDataFrame(list(enumerate(texts)) + [(None, SECRET), (0, SECRET)], "doc_id bigint, text string").withColumns({c: F.lit(1) for c in ("spans", "kind", "start", "value")})
    got = secrets.digests(frame).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        text = SECRET if r["doc_id"] is None else texts[r["doc_id"]] or ""
        base = plain_base(text)
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest(), text
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(x.startswith(k) for x in base.split(",")) for k in ("assign", "access", "hex")]
        assert [x for x in r["spans"].split(",") if x and not x.startswith("random")] == [x for x in base.split(",") if x]
    assert secrets.digests(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def vocabulary():
    with open(secrets.VOCABULARY, "rb") as f:
        return f.read()


def random_spans(text):
    return [(a, b) for k, a, b, _ in secrets.spans(text, vocabulary()) if k == "random"]


def test_random_strings_stand_out():
    """999 of 1,000 random keys of letters and digits are found, base64 keys as well; no key is half reported."""
    for n, alphabet in ((20, None), (40, None), (44, "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"), (32, "abcdefghijklmnopqrstuvwxyz0123456789")):
        keys = [token(i, n, alphabet) if alphabet else token(i, n) for i in range(1000)]
        assert sum(random_spans(f"see ({k}) there") == [(5, 5 + n)] for k in keys) >= 985


PLAIN = [
    "getElementByIdAndUpdateState", "snake_case_identifier_name_long", "path/to/some/long/file_name", "SparkSessionBuilderFactoryBean", "Donaudampfschifffahrtsgesellschaft", "550e8400-e29b-41d4-a716-446655440000",
    "9233A8ECF7C5B09FE5949719B6B82BC439E9329B", "4929348385146306492934838514630", "2024-01-01-00-00-00-000-12", "sha256-" + base64.b64encode(hashlib.sha256(b"x").digest()).decode(), "=" * 60, "-_" * 40, "thandontionererenheitschaft", "com/example/project/module/ClassName", "MAX_RETRY_COUNT_DEFAULT_VALUE",
]


@pytest.mark.parametrize("word", PLAIN)
def test_identifiers_and_digests_are_left_alone(word):
    assert random_spans(f"a {word} b") == []


def test_very_long_runs():
    text = "x" + token(9, 300_000) + " " + "ab " * 100_000 + token(10, 30)
    assert random_spans(text) == [(0, 300_001), (len(text) - 30, len(text))]


def test_large_vocabulary_is_refused(spark, monkeypatch):
    monkeypatch.setattr(secrets, "VOCABULARY_BYTES", 1000)
    with pytest.raises(ValueError, match="not sent"):
        secrets.scan(spark.createDataFrame([(1, "x")], "doc_id bigint, text string"))
