"""Language identification by prediction by partial matching over bytes.

Each language has a variable-order context tree: for every context of up to ORDER bytes, counts of the bytes that
followed it in a sample of texts. A byte costs -log2(count / (total + kinds)) in the longest context that knows it;
contexts that know the context but not the byte charge an escape, -log2(kinds / (total + kinds)); below the empty
context a byte costs 8 bits. The counts are frozen, so a text's exact code length under every language is a sum of
table entries, looked up for whole arrays of positions at once.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamgrid.llm.common import crc_mod3, hash60

ORDER = 3
#: The sample a language is learnt from: at most so many texts, of longer ones a window of so many characters at a place
#: chosen by hash; and at most so many languages, the most frequent ones.
TEXTS, CHARS, LANGUAGES = 200, 20_000, 512
WINDOW = 1 << 18
_LETTER = re.compile(r"[^\W\d_]")  # numbers like '²' too


def has_letter(text: str) -> bool:
    return any(unicodedata.category(m[0])[0] == "L" for m in _LETTER.finditer(text))


def keys(data: np.ndarray, order: int) -> np.ndarray:
    """For each position from ORDER on, the order bytes before it and its own byte as a number."""
    out = np.zeros(len(data) - ORDER, np.uint32)
    for d in range(order, -1, -1):
        out = (out << np.uint32(8)) | data[ORDER - d : len(data) - d]
    return out


def padded(texts: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(b"\n" * ORDER + t for t in texts), np.uint8)


@dataclass
class Model:
    """For each order: known keys, their costs and known contexts with their escapes, as rows of one number a language."""

    langs: list[str]
    known: list[np.ndarray]
    cost: list[np.ndarray]
    contexts: list[np.ndarray]
    escape: list[np.ndarray]

    def __post_init__(self):
        self.bits = max(10, int(np.ceil(np.log2(max(2, len(self.known[ORDER]))))) + 3)
        self.slot = np.zeros(1 << self.bits, np.int32)
        if len(self.known[ORDER]):
            self.slot[self._hash(self.known[ORDER])] = np.arange(len(self.known[ORDER]), dtype=np.int32)

    def _hash(self, k: np.ndarray) -> np.ndarray:
        return (k * np.uint32(2654435761)) >> np.uint32(32 - self.bits)

    def costs(self, k: np.ndarray, order: int = ORDER) -> np.ndarray:
        """Bits of each key (order bytes of context, then the byte) under every language."""
        if order < 0:
            return np.full((len(k), len(self.langs)), 8.0)
        known = self.known[order]
        if order == ORDER and len(known):
            at = self.slot[self._hash(k)]
            miss = np.flatnonzero(known[at] != k)
            if len(miss):
                at[miss] = np.minimum(np.searchsorted(known, k[miss]), len(known) - 1)
        else:
            at = np.minimum(np.searchsorted(known, k), max(0, len(known) - 1))
        if not len(known):
            return np.full((len(k), len(self.langs)), 8.0)
        out = self.cost[order][at]
        new = np.flatnonzero(known[at] != k)
        if len(new):
            out[new] = self.backed(k[new], order)
        return out

    def backed(self, k: np.ndarray, order: int) -> np.ndarray:
        """Bits of keys unknown at this order: the escape of a known context, and the bits one order below."""
        context, known = k >> np.uint32(8), self.contexts[order]
        at = np.minimum(np.searchsorted(known, context), len(known) - 1)
        mask = np.uint32((1 << 8 * order) - 1) if order else np.uint32(0)
        below = self.costs(k & mask, order - 1) if order else np.full((len(k), len(self.langs)), 8.0)
        return np.where((known[at] == context)[:, None], self.escape[order][at], 0.0) + below


def learn(samples: dict[str, list[bytes]]) -> Model:
    """The frozen model of the texts of each language."""
    langs = sorted(samples)
    data = [padded(samples[x]) for x in langs]
    starts = [np.cumsum([0, *(len(t) + ORDER for t in samples[x])])[:-1] for x in langs]
    known, cost, contexts, escape = [], [], [], []
    for order in range(ORDER + 1):
        counted = []
        for d, at in zip(data, starts, strict=True):
            if len(d) <= ORDER:
                counted.append((np.zeros(0, np.uint32), np.zeros(0, np.int64)))
                continue
            ok = np.ones(len(d), bool)
            for i in range(ORDER):  # padding is no text
                ok[at + i] = False
            counted.append(np.unique(keys(d, order)[ok[ORDER:]], return_counts=True))
        union = np.unique(np.concatenate([c[0] for c in counted])) if counted else np.zeros(0, np.uint32)
        context = np.unique(union >> np.uint32(8))
        esc = np.zeros((len(context), len(langs)))
        rows = np.full((len(union), len(langs)), 8.0)
        if order and len(union):
            mask = np.uint32((1 << 8 * order) - 1)
            rows = cost[-1][np.searchsorted(known[-1], union & mask)].copy()
        for j, (k, n) in enumerate(counted):
            at = np.searchsorted(context, k >> np.uint32(8))
            total = np.bincount(at, weights=n, minlength=len(context))
            kinds = np.bincount(at, minlength=len(context))
            with np.errstate(divide="ignore", invalid="ignore"):
                esc[:, j] = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0.0)
            rows[:, j] += esc[np.searchsorted(context, union >> np.uint32(8)), j]
            rows[np.searchsorted(union, k), j] = -np.log2(n / (total + kinds)[at])
        known.append(union)
        cost.append(rows)
        contexts.append(context)
        escape.append(esc)
    return Model(langs, known, cost, contexts, escape)


def code_lengths(model: Model, texts: list[bytes]) -> np.ndarray:
    """Bits of every text under every language."""
    out = np.zeros((len(texts), len(model.langs)))
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to]) <= WINDOW):
            size += len(texts[to])
            to += 1
        data = padded(texts[at:to])
        ends = np.cumsum([len(t) + ORDER for t in texts[at:to]])
        begins = np.concatenate([[0], ends[:-1]]) + ORDER
        for a in range(ORDER, len(data), WINDOW):
            b = min(len(data), a + WINDOW)
            bits = model.costs(keys(data[a - ORDER : b], ORDER))
            sums = np.vstack([np.zeros((1, bits.shape[1])), np.cumsum(bits, axis=0)])
            out[at:to] += sums[np.clip(ends, a, b) - a] - sums[np.clip(begins, a, b) - a]
        at = to
    return out


def sample(docs: DataFrame) -> dict[str, list[bytes]]:
    """Up to TEXTS texts for each language, from the rows whose id's crc32 modulo 3 is not 1."""
    fit = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_mod3(F.col("doc_id")) != 1))
    sizes = fit.groupBy("lang").agg(F.count("*").alias("_rows")).orderBy(F.desc("_rows"), "lang").limit(LANGUAGES)
    key = hash60(F.col("doc_id"))
    # About three times what is kept, so that no language's rows are ranked in full; LANGUAGES rows are broadcast.
    few = fit.join(F.broadcast(sizes), "lang").where(key < 2.0**60 * F.least(F.lit(1.0), 3.0 * TEXTS / F.col("_rows")))
    first = few.withColumn("_n", F.row_number().over(Window.partitionBy("lang").orderBy(key, "doc_id", F.xxhash64("text")))).where(F.col("_n") <= TEXTS)
    spare = F.greatest(F.length("text") - CHARS, F.lit(0)) + 1
    window = F.substring("text", (F.pmod(hash60(F.lit("window"), F.col("doc_id")), spare.cast("bigint")) + 1).cast("int"), F.lit(CHARS))
    out: dict[str, list[bytes]] = {}
    for r in first.select("lang", "_n", window.alias("text")).orderBy("lang", "_n").collect():
        out.setdefault(r["lang"], []).append(r["text"].encode())
    return out


def identify(docs: DataFrame, keep: bool = False) -> DataFrame:
    """The language of every row of docs (doc_id, text, lang), learnt from the rows whose crc32(doc_id) mod 3 is not 1.

    Returns doc_id, held_out (that remainder is 1), lang_pred ('und' if the text is null, has no letter, or nothing
    was learnt), score (the language's share of 2 ** -bits, 0 for 'und') and bits (a byte, under the language; null
    for 'und'). keep=True returns row, a struct of all columns of docs under their own names, and lang_pred, score and
    bits. Equal shares go to the language whose name sorts first. Repeated rows stay; no rows give no rows. Letters are
    the characters of Unicode's letter categories.
    """
    spark = docs.sparkSession
    texts = sample(docs)
    learnt = learn(texts) if texts else None
    sent = spark.sparkContext.broadcast(learnt and (learnt.langs, learnt.known, learnt.cost, learnt.contexts, learnt.escape))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value and Model(*sent.value)
        for batch in batches:
            column = batch.column("text").to_pylist()
            at = [i for i, t in enumerate(column) if model is not None and t is not None and has_letter(t)]
            raw = [column[i].encode() for i in at]
            lang, score, bits = ["und"] * len(column), np.zeros(len(column)), [None] * len(column)
            if at:
                lengths = code_lengths(model, raw)
                best = lengths.argmin(axis=1)
                share = 1 / (2.0 ** -np.minimum(lengths - lengths.min(axis=1, keepdims=True), 1000)).sum(axis=1)
                for j, i in enumerate(at):
                    lang[i], score[i], bits[i] = model.langs[best[j]], share[j], float(lengths[j, best[j]] / len(raw[j]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carried), pa.array(lang), pa.array(score), pa.array(bits, pa.float64())], [*carried, "lang_pred", "score", "bits"])

    base = docs.select(F.struct(*docs.columns).alias("row"), "text") if keep else docs.select("doc_id", "text")
    carried = ["row" if keep else "doc_id"]
    fields = ", ".join(f"`{c}` {base.schema[c].dataType.simpleString()}" for c in carried)
    out = base.mapInArrow(predict, f"{fields}, lang_pred string, score double, bits double")
    return out if keep else out.select("doc_id", (crc_mod3(F.col("doc_id")) == 1).alias("held_out"), "lang_pred", "score", "bits")
