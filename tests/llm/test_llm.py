"""The corpus operators against brute force, exact round trips and held-out accuracy, on small fixtures."""

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loamgrid.llm import decontaminate, html_text, language, lm_score, minhash, mixing, sharding, topk, toxicity, url_filter
from loamgrid.llm.shingles import sets

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, size string, slot string"


def documents(spark, texts, source=lambda i: f"s{i % 3}", lang=lambda i: "en"):
    return spark.createDataFrame([(i, t, lang(i), source(i), len(t or ""), "x", "y") for i, t in enumerate(texts)], DOCS)


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(["ka", "lo", "mi", "ten", "var", "os", "ul", "pre"]) + rng.choice(["n", "ra", "st", "e"]) for _ in range(n))


TEXTS = [prose(i, 3 + i * 7 % 90) for i in range(40)] + [None, "", "  \t ", "word", prose(3, 40), prose(3, 40), prose(3, 40) + " tail", "é" * 50_000]


def test_sharding(spark):
    docs = documents(spark, TEXTS)
    got = sharding.shard(docs, sharding.tree(24), sharding.tree(25)).collect()
    assert len(got) == len(TEXTS)
    for r in got:
        raw = TEXTS[r["doc_id"]]
        assert r["size"] == len((raw or "").encode()) + 8
        assert r["text_crc32"] == (None if raw is None else zlib.crc32(raw.encode()))
        assert r["grown_shard"] in (r["shard"], 24)
    for s in {r["shard"] for r in got}:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    assert sharding.shard(docs.limit(0), sharding.tree(24)).count() == 0
    kept = sharding.shard(docs, sharding.tree(4), keep=True)
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]


def test_permutation_and_inverse(spark):
    for n in (1, 2, 7, 100):
        x, size, salt = F.col("id"), F.lit(n).cast("bigint"), F.lit(5).cast("bigint")
        r = spark.range(n).select(mixing.permuted(x, size, salt).alias("p"), mixing.permuted(mixing.permuted(x, size, salt), size, salt, True).alias("b"), "id").collect()
        assert sorted(v["p"] for v in r) == list(range(n)) and all(v["b"] == v["id"] for v in r)


def test_mixing(spark):
    docs = documents(spark, TEXTS, source=lambda i: None if i % 11 == 0 else f"s{i % 3}")
    rows = mixing.mix_counts(docs, block=4).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(len(TEXTS)))
    for r in rows:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", TEXTS[r["doc_id"]] or "")) and 0 <= r["taken"] <= 3 * r["size"]
    sources = {r["source_size"]: r["target"] for r in rows}
    assert abs(sum(sources.values()) - sum(sources)) < 1e-6 and all(t <= 3 * s + 1e-9 for s, t in sources.items())
    for s, t in sources.items():
        assert abs(sum(r["taken"] for r in rows if r["source_size"] == s) - t) <= 12
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix_counts(docs, block=4).collect()))
    mixed = mixing.mix(docs, block=4)
    words = {r["doc_id"]: r["n"] for r in mixed.groupBy("doc_id").agg(F.sum(mixing.words()).alias("n")).collect()}
    assert words == {r["doc_id"]: r["taken"] for r in rows if r["taken"]} and mixed.columns == docs.columns


def brute_groups(texts, size, hundredths):
    found = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        found.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if found[i] and found[j] and 100 * len(found[i] & found[j]) >= hundredths * len(found[i] | found[j]):
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return [(len(s), c) for s, c in zip(found, label, strict=True)]


def test_near_duplicates(spark, monkeypatch):
    rng = random.Random(4)
    texts = list(TEXTS)
    base = prose(99, 120).split()
    for _ in range(30):
        copy = list(base)
        for _ in range(rng.randrange(0, 7)):
            copy[rng.randrange(len(copy))] = "x" + str(rng.random())
        texts.append(" ".join(copy))
    rows = minhash.near_duplicates(documents(spark, texts), 3, 85).collect()
    assert {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in rows} == {(i, n, c, i == c) for i, (n, c) in enumerate(brute_groups(texts, 3, 85))}
    monkeypatch.setattr(minhash, "SMALL", 4)
    rows = minhash.near_duplicates(documents(spark, texts), 3, 85).collect()
    assert {(r["doc_id"], r["component_id"]) for r in rows} == {(i, c) for i, (_, c) in enumerate(brute_groups(texts, 3, 85))}
    kept = minhash.distinct_documents(documents(spark, texts).union(documents(spark, texts)))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, c in brute_groups(texts, 5, 80)})


def test_links_left_by_a_bucket_that_no_band_splits(spark, monkeypatch):
    rng, texts = random.Random(5), []
    for k in range(12):
        words = [f"w{k}_{i}" for i in range(100)]
        texts.append(" ".join(words))
        for edits in [(1,), (9, 6, 6), (9, 6, 6), (4, 4)]:  # each step is linked with the one before, not all with the first
            copy, kept = list(words), rng.sample(range(100), 21)
            for n in edits:
                for _ in range(n):
                    copy[kept.pop()] = f"x{rng.random()}"
                texts.append(" ".join(copy))
    monkeypatch.setattr(minhash, "bands", lambda nodes, rows, shared=None: nodes.select(F.lit(1).cast("bigint").alias("band"), "node"))
    monkeypatch.setattr(minhash, "DEALT", 4, raising=False)
    rows = minhash.near_duplicates(documents(spark, texts), 1, 80).collect()
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows} == {(i, n, c) for i, (n, c) in enumerate(brute_groups(texts, 1, 80))}


def test_shingle_windows(monkeypatch):
    import pyarrow as pa

    from loamgrid.llm import shingles

    texts = pa.array([prose(1, 500), None, "", prose(2, 3), prose(1, 500)])
    whole = list(sets(texts, 3))
    monkeypatch.setattr(shingles, "WINDOW", 64)
    assert all(np.array_equal(a, b) for a, b in zip(whole, sets(texts, 3), strict=True)) and np.array_equal(whole[0], whole[4])


def test_top_k(spark):
    rng = np.random.default_rng(1)
    vectors = [(i, [float(v) for v in rng.integers(-3, 4, 8) / 7]) for i in range(120)]
    vectors += [(120, None), (121, [1.0, None] + [0.0] * 6), (122, [float("nan")] * 8), (None, [0.0] * 8), (123, vectors[5][1]), (124, vectors[5][1])]
    got = topk.top_k(spark.createDataFrame(vectors, "vec_id bigint, embedding array<double>"), F.col("vec_id") % 20 == 0)
    fit = {i: np.floor(np.array(v) * 256).astype(int) for i, v in vectors[:120] + vectors[-2:]}
    want = set()
    for q in range(0, 120, 20):
        best = sorted((-int(fit[q] @ v), i) for i, v in fit.items() if i != q)[:5]
        want |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(best)}
    assert {tuple(r) for r in got.collect()} == want
    few = topk.top_k(spark.createDataFrame(vectors[:3], "vec_id bigint, embedding array<double>"), F.col("vec_id") == 0)
    assert few.count() == 2


def distance_in(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item):
        new = [i + 1]
        for j, b in enumerate(text):
            new.append(min(row[j] + (a != b), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_myers_and_matches(spark):
    rng = random.Random(2)
    for _ in range(200):
        item = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 80)))
        text = "".join(rng.choice("abc") for _ in range(rng.randrange(0, 90)))
        assert decontaminate.best_end(decontaminate.masks(item), len(item), text)[0] == distance_in(item, text)
    items = [(1, prose(50, 20)), (2, prose(51, 30)), (3, None), (4, "")]
    texts = [prose(60, 30) + " " + items[0][1] + " " + prose(61, 9), prose(62, 40), items[1][1].replace("a", "", 3).upper(), None, "", items[0][1] + "!! " + items[1][1]]
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in decontaminate.matches(documents(spark, texts), spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    want = {}
    for d, t in enumerate(texts):
        for i, x in items:
            x, p = decontaminate.plain(x), decontaminate.plain(t)
            if x and (n := distance_in(x, p)) <= int(len(x) * 0.08):
                want[d, i] = n
    assert got == want and {(0, 1), (2, 2), (5, 1), (5, 2)} <= set(want)
    assert sorted(r["doc_id"] for r in decontaminate.clean(documents(spark, texts), spark.createDataFrame(items, "item_id bigint, text string")).collect()) == [1, 3, 4]


def test_matches_in_several_blocks(spark, monkeypatch):
    """A benchmark of many blocks, each sent, looked for and taken back before the next, gives what one block gives."""
    docs = documents(spark, TEXTS)
    items = spark.createDataFrame([(i, TEXTS[i]) for i in range(12) if TEXTS[i]], "item_id bigint, text string")
    one = sorted(map(tuple, decontaminate.matches(docs, items).collect())), sorted(r["doc_id"] for r in decontaminate.clean(docs, items).collect())
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 100)
    several = sorted(map(tuple, decontaminate.matches(docs, items).collect())), sorted(r["doc_id"] for r in decontaminate.clean(docs, items).collect())
    assert one == several and one[0]


def test_seeds_decide_what_a_mix_takes(spark):
    """Shards draw source counts with the targets' shares; another seed draws others, and takes other words."""
    docs = documents(spark, [prose(i, 40 + i % 50) for i in range(120)])
    sized = docs.select("source", mixing.words("text").alias("size"))
    sources = mixing.targets(sized, (1, 2, 3), 3, 4).cache()
    drawn = {seed: sorted(map(tuple, mixing.draws(sources, 16, seed).collect())) for seed in (0, 1)}
    quotas = {r["rank"]: r["quota"] for r in sources.collect()}
    slots = sum(quotas.values())
    for rows in drawn.values():
        shards = {}
        for shard, rank, n in rows:
            shards.setdefault(shard, {})[rank] = n
            b = min(16, slots - shard * 16)
            assert b * quotas[rank] // slots <= n <= b * quotas[rank] // slots + len(quotas)
        assert [sum(shards[s].values()) for s in sorted(shards)] == [16] * (slots // 16) + [slots % 16] * (slots % 16 > 0)
        for rank, quota in quotas.items():
            assert abs(sum(n for _, r, n in rows if r == rank) - quota) <= 4 * len(shards) ** 0.5
    assert drawn[0] != drawn[1]
    taken = {seed: {r["doc_id"]: r["taken"] for r in mixing.mix_counts(docs, block=4, seed=seed).collect()} for seed in (0, 1)}
    assert taken[0] != taken[1]
    mixed = mixing.mix(docs, block=4, slots=True)
    assert mixed.columns == [*docs.columns, "mix_shard", "mix_position"]
    places = mixed.select("mix_shard", "mix_position", "source").distinct().collect()
    assert len({(r["mix_shard"], r["mix_position"]) for r in places}) == len(places)  # a slot holds words of one source


def plain_bits(samples, text):
    """Code length by dictionaries, byte by byte."""
    seen = {}
    for t in samples:
        data = b"\n" * language.ORDER + t
        for i in range(language.ORDER, len(data)):
            for d in range(language.ORDER + 1):
                seen.setdefault(data[i - d : i], {}).setdefault(data[i], 0)
                seen[data[i - d : i]][data[i]] += 1
    bits, data = 0.0, b"\n" * language.ORDER + text
    for i in range(language.ORDER, len(data)):
        for d in range(language.ORDER, -2, -1):
            if d < 0:
                bits += 8
                break
            at = seen.get(data[i - d : i])
            if at is None:
                continue
            total = sum(at.values()) + len(at)
            if data[i] in at:
                bits -= np.log2(at[data[i]] / total)
                break
            bits -= np.log2(len(at) / total)
    return bits


def test_code_lengths():
    samples = {"a": [prose(1, 60).encode(), b"zz"], "b": ["éàü çé".encode() * 5]}
    texts = [b"", b"q", prose(7, 30).encode(), "ça é".encode(), bytes(range(256))]
    got = language.code_lengths(language.learn(samples), texts)
    want = [[plain_bits(samples[x], t) for x in ("a", "b")] for t in texts]
    assert np.allclose(got, want)


def test_language(spark):
    kinds = {"en": "the and ing thing with that was", "de": "der die und schaft nicht ein über", "fr": "les une des que été où avec"}
    make = lambda i: " ".join(random.Random(i).choice(kinds[["en", "de", "fr"][i % 3]].split()) for _ in range(25))
    docs = documents(spark, [make(i) for i in range(90)] + [None, "", "123 ..."], lang=lambda i: ["en", "de", "fr"][i % 3])
    rows = language.identify(docs).collect()
    assert sum(r["lang_pred"] == ["en", "de", "fr"][r["doc_id"] % 3] for r in rows if r["doc_id"] < 90) >= 86 and len(rows) == 93
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in rows if r["doc_id"] >= 90)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert language.identify(docs.limit(0)).count() == 0


def test_toxicity(spark):
    bad = ["idiot", "scum"]

    def rare(i):
        rng = random.Random(i)
        return " ".join("w" + "".join(rng.choice("abcdefgh") for _ in range(9)) for _ in range(20))

    texts = [rare(i) + (f" {bad[i // 5 % 2]} " if i % 5 == 0 else " ") + prose(-i, 10) for i in range(1000)] + [None, ""]
    labels = spark.createDataFrame([(i, 0, int(i % 5 == 0)) for i in range(1000) if i % 20 < 10], "doc_id bigint, quality int, toxic int")  # both bad words
    rows = {r["doc_id"]: r for r in toxicity.score(documents(spark, texts), labels).collect()}
    held = [r for i, r in rows.items() if r["held_out"] and i < 1000]
    assert sum(r["predicted"] == int(r["doc_id"] % 5 == 0) for r in held) / len(held) > 0.97
    assert rows[1000]["predicted"] == rows[1001]["predicted"] == 0
    assert all(r["score"] == 0 for r in toxicity.score(documents(spark, texts), labels.limit(0)).collect())


PAGE = "<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href='/'>Home</a></li></ul></nav><div class='ad'>Buy it</div><article><h1>Title &amp; more</h1><p>First  paragraph\n with <b>bold</b> words.<p>Second &eacute;t&#233;.</p><script>x('<p>')</script></article><section class='comments'><p>I disagree with all of it.</p></section><footer>&copy; x</footer>"


def test_toxicity_sample_keeps_all_but_copies(spark):
    texts = ["common " + prose(i // 2, 12) + f" own{'abcdefghij'[i // 2 % 10]}{'klmnopqrst'[i // 20 % 10]}" for i in range(400)]  # each twice
    labels = spark.createDataFrame([(i, int(i % 4 < 2)) for i in range(400)], "doc_id bigint, toxic int")
    rows = toxicity.sample(documents(spark, texts), labels)[0].collect()
    fit = [i for i in range(400) if zlib.crc32(str(i).encode()) % 3 != 1]
    for positive, ids in ((True, [i for i in fit if i % 4 < 2]), (False, fit)):
        assert sum(r["positive"] == positive for r in rows) == len({texts[i] for i in ids})
        assert sum(r["copies"] for r in rows if r["positive"] == positive) == len(ids)


def test_html(spark):
    pages = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "a < b"), (1, "u", PAGE)], "page_id bigint, url string, html string")
    rows = html_text.extract(pages).collect()
    assert [r["text"] for r in rows if r["page_id"] == 1] == ["Title & more\nFirst paragraph with bold words.\nSecond été."] * 2
    assert all(r["text"] == "" and r["n_chars"] == 0 for r in rows if r["page_id"] in (2, 3)) and len(rows) == 5


PROBES = [  # a page and its text
    ("<body class='single has-sidebar'><article><h1>T</h1><p>one two three four five six</p></article>", "T\none two three four five six"),
    ("<article class='post category-news tag-x'><p>one two three four</p></article>", "one two three four"),
    ("<main class='shop-article'><p>one two three</p></main>", "one two three"),
    ("<article><p>some text here of eleven words in all one two three</p><p><a href=x>a linked paragraph of six words</a></p><p>some text here of ten words one two three four</p></article>", "some text here of eleven words in all one two three\na linked paragraph of six words\nsome text here of ten words one two three four"),
    ("<article><header><h1>Head</h1></header><p>text</p></article>", "Head\ntext"),
    ("<article><p>a <math><mi>x</mi></math> b</p></article>", "a x b"),
    ("<div>Buy now</div><article><p>Some text.</p><section class='comments'><p>I disagree with every word of it.</p></section></article>", "Some text."),
    ("<ul><li><a>one</a></li><li><a>two</a></li></ul><div>Buy now</div><ul><li><a>one</a></li></ul><div><p>Nothing here is named but this is long enough to be read.</p><p>Short one.</p></div>", "Nothing here is named but this is long enough to be read.\nShort one."),
]


@pytest.mark.parametrize("page, text", PROBES)
def test_main_text_of_probes(page, text):
    assert html_text.main_text(page, html_text.trained()) == text


def test_tree_uses_words_and_links_of_neighbours():
    used = set()

    def walk(tree):
        if not isinstance(tree, int):
            used.add(html_text.FEATURES[tree[0]])
            walk(tree[2])
            walk(tree[3])

    walk(html_text.trained())
    assert {"words", "links", "words after", "links before", "links after"} <= used


def test_blocks_equal_those_of_a_plain_parser():
    from html.parser import HTMLParser

    class Plain(HTMLParser):
        def __init__(self):
            super().__init__()
            self.out, self.parts, self.hidden = [], [], 0

        def cut(self):
            text = " ".join("".join(self.parts).split())
            self.parts.clear()
            if text:
                self.out.append(text)

        def handle_starttag(self, tag, attrs):
            self.hidden += tag in ("script", "style")
            if tag in html_text.BLOCK:
                self.cut()
            elif tag == "br":
                self.parts.append(" ")

        def handle_endtag(self, tag):
            self.hidden -= tag in ("script", "style")
            if tag in html_text.BLOCK:
                self.cut()

        def handle_data(self, data):
            if not self.hidden:
                self.parts.append(data)

    rng = random.Random(8)

    def piece(depth):
        kind = rng.choice(["p", "div", "ul", "article", "nav", "b", "a", "text", "text", "script", "br"])
        if kind == "text" or depth == 0:
            return " ".join(rng.choice(["ka", "l&amp;o", "mi&eacute;", "t&#233;n", "  var\n"]) for _ in range(rng.randrange(1, 9)))
        if kind == "br":
            return "<br>"
        inner = "x('<p>')" if kind == "script" else "".join(piece(depth - 1) for _ in range(rng.randrange(1, 4)))
        return f"<{kind} class='{rng.choice(['ad', 'post', 'x'])}'>{inner}</{kind}>"

    for _ in range(200):
        page = "<html><body>" + "".join(piece(4) for _ in range(5)) + "</body></html>"
        plain = Plain()
        plain.feed(page)
        plain.cut()
        assert [b.text for b in html_text.blocks(page)] == plain.out


def test_deep_nesting_is_read_in_linear_time():
    import time

    took = []
    for n in (2000, 16000):
        began = time.perf_counter()
        html_text.blocks("<div>x" * n + "</div>" * n)
        took.append(time.perf_counter() - began)
    assert took[1] < 30 * took[0]


RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def test_urls(spark):
    urls = [f"http://a{i}.example.{['org', 'com', 'net'][i % 3]}/{['en', 'es', 'fr', 'de'][i // 3 % 4]}/{i}?q=1" for i in range(120)] + [None, "", "no scheme", "HTTP://EXAMPLE.org", "http://xorg/", "http://org/"]
    rows = url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string"), RULES).collect()
    for r in rows:
        m = re.match(r".*?://([^/?#]*)([^?#]*)", urls[r["page_id"]] or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fits = [(len(p), p, v) for v, p in RULES if (host == p[: p.index("/")] or host.endswith("." + p[: p.index("/")])) and path.startswith(p[p.index("/") :])]
        assert (r["host"], r["path"], r["rule"]) == (host, path, max(fits)[1] if fits else None)
        assert r["verdict"] == max(fits)[2] if fits else r["verdict"] in ("allow", "block")
    assert len(rows) == len(urls)


def brute_losses(texts, target):
    """(target_loss, background_loss) of each text by dictionaries."""
    from collections import Counter
    from math import log2

    words = [re.findall(r"[^\x20\x09-\x0D]+", (t or "")) for t in texts]
    one, two = [Counter(), Counter()], [Counter(), Counter()]
    of = [0 if t else 1 for t in target]
    for w, m in zip(words, of, strict=True):
        one[m].update(w)
        two[m].update(zip(w, [*w[1:], None], strict=False))
    size, n = len(one[0] | one[1]), [sum(c.values()) for c in one]
    out = []
    for w, mine in zip(words, of, strict=True):
        single, pairs, both = Counter(w), Counter(zip(w, [*w[1:], None], strict=False)), []
        for m in (0, 1):
            less = mine == m
            r = min(n) / n[m] if min(n) else 0.0
            loss = 0.0
            for (v, x), k in pairs.items():
                c_v, c_vx = one[m][v] - less * single[v], two[m][v, x] - less * pairs[v, x]
                loss -= k * log2((r * c_v + 1) / (r * (n[m] - less * len(w)) + size))
                loss -= k * log2((r * c_vx + lm_score.SMOOTHING / (size + 1)) / (r * c_v + lm_score.SMOOTHING))
            both.append(loss / len(w) / 2 if w else None)
        out.append(tuple(both))
    return out


@pytest.mark.parametrize("frequent, top", [(1 << 16, 512), (12, 4), (0, 0)])
def test_lm_score(spark, monkeypatch, frequent, top):
    for name, value in {"FREQUENT": frequent, "TOP": top, "SLICE": 300, "DOCS": 16, "HELD": 200}.items():
        monkeypatch.setattr(lm_score, name, value)
    texts = [("target words of one kind " if i % 2 else "other tokens in some style ") * 6 + prose(i, 10) for i in range(60)] + [None, "", prose(7, 40), prose(7, 40)]
    target = [i % 2 == 1 and i < 31 for i in range(len(texts))]
    marks = spark.createDataFrame([(i,) for i, t in enumerate(target) if t] + [(None,), (1,)], "doc_id bigint")
    rows = {r["doc_id"]: r for r in lm_score.score(documents(spark, texts), marks).collect()}
    for i, (t, b) in enumerate(brute_losses(texts, target)):
        assert rows[i]["n_words"] == len((texts[i] or "").split())
        assert (rows[i]["target_loss"], rows[i]["background_loss"]) == ((pytest.approx(t), pytest.approx(b)) if t is not None else (None, None))
    assert max(rows[i]["score"] for i in range(31, 60, 2)) < min(rows[i]["score"] for i in range(30, 60, 2))
    assert rows[62]["background_loss"] < lm_score.score(documents(spark, texts[:-1]), marks).where("doc_id = 62").first()["background_loss"]  # its copy tells


def test_lm_score_without_rows_or_target(spark):
    docs = documents(spark, ["a b", None, "a"])
    assert lm_score.score(docs.limit(0), spark.range(0).withColumnRenamed("id", "doc_id")).count() == 0
    rows = lm_score.score(docs.union(docs), spark.range(0).withColumnRenamed("id", "doc_id")).collect()
    assert sorted(str(r["score"]) for r in rows) == ["0.0"] * 4 + ["None"] * 2


@pytest.mark.parametrize("threshold", [0.8, 0.85])
def test_bands_reach_the_threshold(threshold):
    r = minhash.rows_per_band(threshold)
    assert (1 - threshold**r) ** (minhash.BUCKETS // r) <= minhash.MISS
