"""The pipeline's stages and its whole run against plain Python, and edge cases that all corpus operators share."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loamgrid.llm import decontaminate, html_text, language, lm_score, minhash, mixing, sharding, topk, toxicity, url_filter
from test_llm import brute_groups, distance_in

WORDS = {"en": "the and ing thing with that was have from some", "de": "der die und schaft nicht ein über werden haben"}


def text(seed, n, lang="en"):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS[lang].split()) + rng.choice("abcdefgh") + str(rng.randrange(50)) for _ in range(n))


ITEM = text(900, 14)
TEXTS = [text(i, 20 + i, ["en", "de"][i % 2]) for i in range(30)]
TEXTS += [TEXTS[3], TEXTS[3] + " tail", TEXTS[4] + " x", TEXTS[5] + " " + ITEM, ITEM.upper().replace("A", "B", 1) + " " + text(77, 5), None, "", "12 34 ...", "²", text(55, 3000)]
#: Columns named like those that the operators make for themselves.
CLASHES = ["score", "bits", "lang_pred", "row", "_part", "_key", "_text", "slot", "shard", "kept", "component", "mark", "id", "hash", "key", "start", "rank", "block", "spans", "_span", "_rest", "_piece", "target", "batch", "sums", "node"]


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    rows = [(i, t, ["en", "de"][i % 2], None if i % 7 == 0 else f"s{i % 3}", len(t or "")) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in CLASHES})
    docs.coalesce(2).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, ITEM), (2, None), (3, "...")], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def same_columns(df, docs):
    """No column of docs has been changed but text and n_chars."""
    assert df.columns == docs.columns
    for r in df.collect():
        assert all(r[c] == f"{c}{r['doc_id']}" for c in CLASHES)


def test_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    known, unique, clean, mixed, sharded = (f for _, f in corpus_pipeline.STAGES)
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())
    nothing = {i for i, t in enumerate(TEXTS) if t in (None, "", "12 34 ...", "²")}
    got = known(spark, docs, data)
    same_columns(got, docs)
    assert ids(got) == [i for i in range(len(TEXTS)) if i not in nothing]
    got = unique(spark, docs.union(docs), data)
    same_columns(got, docs)
    groups = {c for _, c in brute_groups(TEXTS, 5, 80)}
    assert ids(got) == sorted(groups)
    got = clean(spark, docs, data)
    same_columns(got, docs)
    plain = decontaminate.plain
    holds = {i for i, t in enumerate(TEXTS) if distance_in(plain(ITEM), plain(t)) <= int(len(plain(ITEM)) * 0.08)}
    assert ids(got) == [i for i in range(len(TEXTS)) if i not in holds] and {33, 34} <= holds
    got = mixed(spark, docs, data)
    same_columns(got, docs)
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix_counts(docs, block=2048).collect()}
    words = {}
    for r in got.collect():
        assert r["text"] in TEXTS[r["doc_id"]] and r["n_chars"] == len(r["text"])
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + len(r["text"].split())
    assert words == {i: n for i, n in taken.items() if n}
    got = sharded(spark, docs, data)
    rows = got.collect()
    assert len(rows) == len(TEXTS) and {r["_part"] for r in rows} == {f"_part{i}" for i in range(len(TEXTS))}
    for r in rows:
        t = TEXTS[r["doc_id"]]
        assert (r["size"], r["text_crc32"]) == (len((t or "").encode()) + 8, None if t is None else zlib.crc32(t.encode())) and r["grown_shard"] in (r["shard"], 24)


def test_whole_run(spark, data):
    rows = corpus_pipeline.run(spark, data).collect()
    gone = {i for i, t in enumerate(TEXTS) if t in (None, "", "12 34 ...", "²")} | {33, 34}
    left = [i for i in range(len(TEXTS)) if i not in gone]
    heads = {c for i, (_, c) in enumerate(brute_groups(TEXTS, 5, 80)) if i in left}
    assert {r["doc_id"] for r in rows} <= heads | {c for c in left} and {r["doc_id"] for r in rows}
    slots = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sorted(map(str, rows)) == sorted(map(str, corpus_pipeline.run(spark, data).collect()))


def test_growth_moves_rows_into_the_new_shard_only(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    for n in (24, 25, 26, 37):
        rows = sharding.shard(docs, sharding.tree(n), sharding.tree(n + 1)).collect()
        assert all(r["grown_shard"] in (r["shard"], n) for r in rows) and any(r["grown_shard"] == n for r in rows)
    with pytest.raises(ValueError):
        sharding.shard(docs, sharding.tree(20, planned=20), sharding.tree(21, planned=21))


def test_letters():
    assert not any(map(language.has_letter, ["² ½", "12_3", "", "… — %"])) and all(map(language.has_letter, ["a", "1é", "日"]))


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string")
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    items = spark.createDataFrame([], "item_id bigint, text string")
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    vectors = spark.createDataFrame([], "vec_id bigint, embedding array<double>")
    results = [
        decontaminate.matches(docs, items), decontaminate.clean(docs, items), topk.top_k(vectors, F.col("vec_id") % 2 == 0), html_text.extract(pages), sharding.shard(docs, sharding.tree(4)), minhash.near_duplicates(docs), minhash.distinct_documents(docs),
        lm_score.score(docs, labels), toxicity.score(docs, labels), language.identify(docs), language.identify(docs, keep=True), url_filter.judge(pages, [("allow", "org/")]), mixing.mix_counts(docs), mixing.mix(docs),
    ]
    assert [r.count() for r in results] == [0] * len(results)


def test_null_ids_and_repeated_rows(spark):
    rows = [(None, "same words here in this text"), (None, "same words here in this text"), (7, "same words here in this text"), (7, "other words stand there now"), (None, None), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in rows], "doc_id bigint, text string, lang string, source string")
    labels = spark.createDataFrame([(7, 1, 1), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    for df in (minhash.near_duplicates(docs), lm_score.score(docs, labels), toxicity.score(docs, labels), language.identify(docs), mixing.mix_counts(docs), sharding.shard(docs, sharding.tree(4)), decontaminate.clean(docs, spark.createDataFrame([(1, "no such thing")], "item_id bigint, text string"))):
        assert df.count() == len(rows)
    assert minhash.distinct_documents(docs).count() == 3  # the common text, the other one, and none


def test_very_long_texts(spark):
    long = " ".join(f"w{i % 5000}" for i in range(400_000))
    docs = spark.createDataFrame([(1, long, "en", "s"), (2, long + " end", "en", "s"), (3, "é" * 1_000_000, "en", "s")], "doc_id bigint, text string, lang string, source string")
    groups = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs).collect()}
    assert groups == {1: 1, 2: 1, 3: 3}
    assert {r["doc_id"]: r["size"] for r in mixing.mix_counts(docs).collect()} == {1: 400_000, 2: 400_001, 3: 1}
    page = spark.createDataFrame([(1, "u", "<article><p>" + long + "</p></article>")], "page_id bigint, url string, html string")
    assert html_text.extract(page).first()["n_chars"] == len(long)


def test_held_out_urls_are_judged_as_the_rules_would(spark):
    """The trees are fitted on URLs with rules; URLs of the same make whose rules are hidden should get the same verdict."""
    rules = [("allow", "org/"), ("block", "com/de/"), ("allow", "com/fr/")]
    make = lambda i: f"http://site{i % 40}.{['org', 'com', 'com'][i % 3]}/{['en', 'de', 'fr'][i % 3]}/{i}"
    urls = [make(i) for i in range(900)] + [make(i).replace("http://site", "http://new").replace(".org/", ".org./").replace(".com/", ".com./") for i in range(300)]
    rows = {r["page_id"]: r for r in url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string"), rules).collect()}
    hidden = [rows[i] for i in range(900, 1200)]
    assert all(r["rule"] is None for r in hidden)
    assert sum(r["verdict"] == ["allow", "block", "allow"][r["page_id"] % 3] for r in hidden) / 300 > 0.6
