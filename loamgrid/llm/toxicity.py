"""Toxicity scores by non-negative positive-unlabelled learning.

A logistic model in numpy learns from confirmed toxic texts and from texts of unknown kind, which are toxic with the
class prior. The risk of the negative class is the unlabelled texts' risk less the prior times the positives' risk as
negatives; it is kept from falling below zero, which would be fitting the toxic texts among the unlabelled ones.

Features are words and word beginnings of 4 to 7 bytes, each once as present, again if it occurs twice or three times, and
again if it is dense: beginnings that clean texts have now and then mark a toxic one when they come back. Those that are
clearly more frequent in the positives are found by counts over the sample in Spark; only they are fitted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgrid.llm.common import crc_mod3, hash60, written
from loamgrid.llm.shingles import _BACK, _BYTE, _STEP, _power, mixed

#: The sample the model is fitted on: about so many confirmed toxic texts and texts of unknown kind at most, of any length.
POSITIVES, UNLABELLED = 6_000, 24_000
#: At most so many features are fitted, each in at least LEAST positives and DEVIATIONS above what chance allows.
FEATURES, LEAST, DEVIATIONS = 8192, 6, 6.0
BITS = 23
#: Beginnings of so many bytes; what occurs twice at least, and once in so many words, is dense.
BEGINNINGS, DENSE = (4, 5, 6, 7), 125
#: Without any confirmed toxic text to learn from, or without features, every text gets this score.
UNKNOWN = 0.0
WINDOW = 1 << 19
_LETTER = np.zeros(256, bool)
_LETTER[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(128, 256)]] = True


def features(data: np.ndarray) -> np.ndarray:
    """The distinct feature numbers of a text's UTF-8 bytes; words are runs of letters and bytes beyond ASCII."""
    found, at, n_words = [], 0, 0
    while at < len(data):
        end = min(len(data), at + WINDOW)
        while end < len(data) and _LETTER[data[end - 1]]:  # on to the end of a word
            gap = np.flatnonzero(~_LETTER[data[end : end + WINDOW]])
            end = end + int(gap[0]) + 1 if len(gap) else min(len(data), end + WINDOW)
        part = data[at:end]
        inside = np.concatenate([[False], _LETTER[part], [False]])
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        a, b = edge[0::2], edge[1::2]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[part] * _power(_STEP, len(part), "up"))])
        back = _power(_BACK, len(part) + 1, "down")[a]
        found.append(mixed((sums[b] - sums[a]) * back + np.uint64(1)))
        n_words += len(a)
        for n in BEGINNINGS:
            long = b - a > n
            found.append(mixed((sums[a[long] + n] - sums[a[long]]) * back[long] + np.uint64(n)))
        at = end
    if not found:
        return np.zeros(0, np.int64)
    value, count = np.unique(np.concatenate(found), return_counts=True)
    more = [mixed(value[ok] + np.uint64(k)) for k, ok in ((2, count >= 2), (3, count >= 3), (5, (count >= 2) & (count * DENSE >= n_words)))]
    return np.unique(np.concatenate([value, *more]) >> np.uint64(64 - BITS)).astype(np.int64)


def of_texts(column: pa.Array) -> Iterator[np.ndarray]:
    for t in column:
        yield features(np.frombuffer(t.as_buffer(), np.uint8) if t.is_valid else np.zeros(0, np.uint8))


def sample(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, float]:
    """((positive, text, copies) of the sample, prior): rows whose crc32(doc_id) mod 3 is not 1, chosen by hashes.

    prior: the share of toxic rows among the labelled ones of those rows. A document with several labels is toxic if
    one of them says so.
    """
    marks = labels.select("doc_id", "toxic").where((crc_mod3(F.col("doc_id")) != 1) & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    toxic, marked = marks.agg(F.sum((F.col("toxic") == 1).cast("long")), F.count("*")).first()
    n = docs.count()
    key = hash60(F.lit("toxicity"), F.col("doc_id"))
    share = lambda most, of: int(2**60 * min(1.0, most / max(1, of)))
    fit = docs.select("doc_id", "text").where((crc_mod3(F.col("doc_id")) != 1) & F.col("text").isNotNull())
    # At most POSITIVES ids, so they may be broadcast; the texts then stay where they are read.
    positive = marks.where("toxic = 1").where(key < share(2 * POSITIVES, toxic or 0)).orderBy(key, "doc_id").limit(POSITIVES).select("doc_id", F.lit(True).alias("positive"))
    # The unlabelled texts are drawn from all of them, toxic ones included: the prior holds for them.
    others = fit.where(key < share(UNLABELLED, n)).select(F.lit(False).alias("positive"), "text")
    rows = fit.join(F.broadcast(positive), "doc_id").select("positive", "text").unionByName(others)

    def marked_by_set(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [f.astype(np.uint64) for f in of_texts(batch.column("text"))]
            one, two = ([int(mixed(f + np.uint64(add)).sum(dtype=np.uint64) >> np.uint64(1)) for f in found] for add in (99, 1 << 40))
            yield pa.RecordBatch.from_arrays([batch.column("positive"), batch.column("text"), pa.array(one, pa.int64()), pa.array(two, pa.int64())], ["positive", "text", "one", "two"])

    # Copies of one text would make its rare words look toxic: texts with equal feature sets (by a digest of 126 bits)
    # count once for the choice of features. The risk weighs them by their number, as the prior holds for all rows.
    apart = rows.mapInArrow(marked_by_set, "positive boolean, text string, one bigint, two bigint").groupBy("positive", "one", "two").agg(F.min("text").alias("text"), F.count("*").alias("copies"))
    return apart.select("positive", "text", "copies"), (toxic or 0) / marked if marked else 0.0


def chosen(rows: DataFrame) -> tuple[np.ndarray, int, int]:
    """(features to fit, number of positives, of unlabelled) of sample rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = {True: np.zeros(1 << BITS, np.int32), False: np.zeros(1 << BITS, np.int32)}
        seen = {True: 0, False: 0}
        for batch in batches:
            for kind, f in zip(batch.column("positive").to_pylist(), of_texts(batch.column("text")), strict=True):
                n[kind][f] += 1
                seen[kind] += 1
        at = np.flatnonzero(n[True] + n[False])
        yield pa.RecordBatch.from_pydict({"f": np.append(at, -1), "p": np.append(n[True][at], seen[True]).astype(np.int64), "u": np.append(n[False][at], seen[False]).astype(np.int64)})

    counts = written(rows.select("positive", "text").mapInArrow(count, "f bigint, p bigint, u bigint").groupBy("f").agg(F.sum("p").alias("p"), F.sum("u").alias("u")), "features")
    total = counts.where("f = -1").first()
    n_p, n_u = (total["p"], total["u"]) if total else (0, 0)
    if not n_p or not n_u:
        return np.zeros(0, np.int64), n_p, n_u
    chance = (F.col("p") + F.col("u")) / float(n_p + n_u)
    z = (F.col("p") / n_p - F.col("u") / n_u) / F.sqrt(chance * (1 - chance) * (1 / n_p + 1 / n_u) + 1e-12)
    best = counts.where((F.col("f") >= 0) & (F.col("p") >= LEAST)).withColumn("z", z).where(F.col("z") >= DEVIATIONS).orderBy(F.desc("z"), "f").limit(FEATURES)
    return np.array(sorted(r["f"] for r in best.select("f").collect()), np.int64), n_p, n_u


def fitted(rows: np.ndarray, cols: np.ndarray, positive: np.ndarray, n_features: int, prior: float, steps: int = 600, rate: float = 0.05, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of the logistic model with the least non-negative PU risk. (rows, cols): features present."""
    prior = min(max(prior, 1e-3), 0.9)
    w, b = np.zeros(n_features), 0.0
    n_p, n_u = positive.sum(), (~positive).sum()
    moments = [np.zeros(n_features + 1), np.zeros(n_features + 1)]
    for t in range(1, steps + 1):
        g = b + np.bincount(rows, weights=w[cols], minlength=len(positive))
        s = 1 / (1 + np.exp(-np.clip(g, -30, 30)))
        # Logistic losses: log(1 + e^-g) as a positive, log(1 + e^g) as a negative; their slopes are s - 1 and s.
        as_negative = np.logaddexp(0, g)
        rest = as_negative[~positive].mean() - prior * as_negative[positive].mean()
        slope = np.zeros(len(positive))
        if rest >= 0:
            slope[positive] = prior * (s[positive] - 1) / n_p - prior * s[positive] / n_p
            slope[~positive] = s[~positive] / n_u
        else:  # the negative part has gone below zero: climb back
            slope[positive] = prior * s[positive] / n_p
            slope[~positive] = -s[~positive] / n_u
        grad = np.append(np.bincount(cols, weights=slope[rows], minlength=n_features) + decay * w, slope.sum())
        moments[0] = 0.9 * moments[0] + 0.1 * grad
        moments[1] = 0.999 * moments[1] + 0.001 * grad**2
        step = rate * (moments[0] / (1 - 0.9**t)) / (np.sqrt(moments[1] / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def learn(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
    """(features, weights, bias); no features where there is nothing to learn from."""
    rows, prior = sample(docs, labels)
    rows = written(rows, "sample")
    keep, n_p, n_u = chosen(rows)
    if not len(keep):
        return keep, np.zeros(0), 0.0

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for f in of_texts(batch.column("text")):
                at = np.minimum(np.searchsorted(keep, f), len(keep) - 1)
                found.append(at[keep[at] == f].tolist())
            yield pa.RecordBatch.from_pydict({"positive": batch.column("positive"), "copies": batch.column("copies"), "at": pa.array(found, pa.list_(pa.int32()))})

    # Equal rows are one: most texts of the sample have none of the features.
    kinds = rows.mapInArrow(sparse, "positive boolean, copies bigint, at array<int>").groupBy("positive", "at").agg(F.sum("copies").alias("count")).collect()
    kinds = sorted((r["positive"], r["at"], r["count"]) for r in kinds)
    each = [(p, at) for p, at, n in kinds for _ in range(n)]
    positive = np.array([p for p, _ in each], bool)
    lengths = np.array([len(at) for _, at in each])
    cols = np.array([c for _, at in each for c in at], np.int64)
    w, b = fitted(np.repeat(np.arange(len(each)), lengths), cols, positive, len(keep), prior)
    return keep, w, b


def score(docs: DataFrame, labels: DataFrame, cut: float = 0.7) -> DataFrame:
    """A toxicity score for every row of docs (doc_id, text), learnt from labels (doc_id, toxic).

    Only rows whose crc32(doc_id) mod 3 is not 1 are learnt from. Returns doc_id, held_out (that remainder is 1), score
    (0 to 1) and predicted (1 if score >= cut). Null and empty texts have no features and get the score of a text
    without any. Without confirmed toxic rows every score is 0. Repeated rows stay; no rows give no rows; other columns
    of docs and labels play no part.
    """
    keep, w, b = learn(docs, labels)
    sent = docs.sparkSession.sparkContext.broadcast((keep, w, b))  # FEATURES entries at most

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep, w, b = sent.value
        for batch in batches:
            out = []
            for f in of_texts(batch.column("text")):
                if not len(keep):
                    out.append(UNKNOWN)
                    continue
                at = np.minimum(np.searchsorted(keep, f), len(keep) - 1)
                out.append(float(1 / (1 + np.exp(-np.clip(b + w[at[keep[at] == f]].sum(), -30, 30)))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.float64())], ["doc_id", "score"])

    out = docs.select("doc_id", "text").mapInArrow(judge, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
    return out.select("doc_id", (crc_mod3(F.col("doc_id")) == 1).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
