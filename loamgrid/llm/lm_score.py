"""Cross-entropy difference: how much better a target model codes a document's words than a background model.

Both models share one vocabulary, every word of the corpus, and count every document: target documents for the one, all
others for the other. A document's own counts are left out of the model it belongs to. The larger model's counts are
scaled down to the size of the smaller one, so the two are matched. A word costs the mean of its unigram code length
(add-one) and that of the next word, or of the end, after it (a bigram smoothed towards the uniform distribution).

Counts are exact and grow with the corpus. Words and pairs of words of a batch of documents are packed into arrays and
shuffled once, by a hash of the first word, to slices of bounded size. A slice sees all occurrences of its pairs, so it
both counts them and scores them for their documents; what goes on is a sum for each document of a batch. The most
frequent words have their counts sent to all tasks, so that their pairs can be dealt over slices by both words; pairs
within the first few hundred words are counted ahead and scored where they are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgrid.llm.common import removed, small_batches, written
from loamgrid.llm.shingles import mixed, word_hashes

#: So many most frequent words have counts in every task, and pairs of so many are counted ahead.
FREQUENT, TOP = 1 << 16, 512
#: The weight of the uniform distribution, in words.
SMOOTHING = 50.0
#: A task hands on its word counts when it holds so many words; words of a slice, about.
HELD, SLICE = 1_000_000, 500_000
#: Slices that one call works off, one after the other, before it hands on its sums; bytes of text packed at once.
FAN, PACKED = 8, 4_000_000
#: Documents of a batch, and target ids that may be sent to the tasks (8 bytes each); more are joined by a shuffle.
DOCS, SENT = 1000, 4_000_000
END = np.int64(-1)


def words_of(text: pa.Scalar) -> np.ndarray:
    """The words' hashes as non-negative int64."""
    data = np.frombuffer(text.as_buffer(), np.uint8) if text.is_valid else np.zeros(0, np.uint8)
    return (word_hashes(data)[0] >> np.uint64(1)).astype(np.int64)


def word_counts(docs: DataFrame) -> DataFrame:
    """word (hash), t and b: its counts over target documents and over the others. docs: text, target."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list] = ([], [])

        def out() -> pa.RecordBatch:
            words = [np.concatenate([np.zeros(0, np.int64), *h]) for h in held]
            value, at = np.unique(np.concatenate(words), return_inverse=True)
            n = [np.bincount(a, minlength=len(value)).astype(np.int64) for a in np.split(at, [len(words[0])])]
            for h in held:
                h.clear()
            return pa.RecordBatch.from_pydict({"word": value, "t": n[0], "b": n[1]})

        size = 0
        for batch in batches:
            for text, target in zip(batch.column("text"), batch.column("target").to_pylist(), strict=True):
                w = words_of(text)
                held[0 if target else 1].append(w)
                size += len(w)
                if size > HELD:
                    yield out()
                    size = 0
        yield out()

    return docs.select("text", "target").mapInArrow(count, "word bigint, t bigint, b bigint").groupBy("word").agg(F.sum("t").alias("t"), F.sum("b").alias("b"))


def found_at(words: np.ndarray, sorted_words: np.ndarray) -> np.ndarray:
    """The place of each word among sorted ones, -1 where it is not one of them."""
    if not len(sorted_words):
        return np.full(len(words), -1)
    at = np.minimum(np.searchsorted(sorted_words, words), len(sorted_words) - 1)
    return np.where(sorted_words[at] == words, at, -1)


def pair_counts(docs: DataFrame, top: np.ndarray) -> np.ndarray:
    """Counts of pairs of top words over target documents and the others: 2 x n x n."""
    n = len(top)
    sent = docs.sparkSession.sparkContext.broadcast(top)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, n * n), np.int64)
        for batch in batches:
            for text, target in zip(batch.column("text"), batch.column("target").to_pylist(), strict=True):
                at = found_at(words_of(text), sent.value)
                ok = (at[:-1] >= 0) & (at[1:] >= 0)
                counts[0 if target else 1] += np.bincount(at[:-1][ok] * n + at[1:][ok], minlength=n * n)
        cell = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"cell": cell.astype(np.int64), "n": counts.ravel()[cell]})

    out = np.zeros(2 * n * n)
    summed = docs.select("text", "target").mapInArrow(count, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # 2 TOP^2 rows at most
    out[summed.column("cell").to_numpy()] = summed.column("n").to_numpy()
    return out.reshape(2, n, n)


def grouped(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(group of each row, rows of each group) of rows that are equal in all columns."""
    order = np.lexsort(columns)
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.any([c[order][1:] != c[order][:-1] for c in columns], axis=0)
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    return group, np.bincount(group) if len(order) else np.zeros(0, np.int64)


def bits(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return np.log2(whole) - np.log2(part)


def score(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The cross-entropy difference of every row of docs, target being rows of ids (column id_col) that mark the target.

    Returns id, n_words, target_loss and background_loss (bits a word) and score, their difference: below 0 where the
    target model codes the text better. Texts that are null or without words have n_words 0 and null losses and score.
    Where one of the models has no words, both are uniform and every score is 0. Rows with a null id are background.
    Repeated rows stay, each a document of its own; no rows give no rows; other columns play no part.
    """
    with small_batches(docs.sparkSession, DOCS):
        # The result is written, as its batches must be cut alike wherever they are read.
        return written(scored(docs, target, id_col, text_col), "losses")


def flagged(docs: DataFrame, target: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text and target of docs. Whole-number ids are looked up in a sorted array while SENT bounds it."""
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    ids = written(target.select(F.col(id_col).alias("id")).where("id is not null").distinct(), "targets")
    kind = base.schema["id"].dataType.simpleString()
    if kind not in ("int", "bigint") or ids.count() > SENT:
        return base.join(ids.withColumn("target", F.lit(True)).hint("merge"), "id", "left").withColumn("target", F.coalesce("target", F.lit(False)))
    sent = docs.sparkSession.sparkContext.broadcast(np.sort(ids.toArrow().column("id").to_numpy().astype(np.int64)))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = batch.column("id").is_valid()
            at = found_at(batch.column("id").fill_null(0).to_numpy().astype(np.int64), sent.value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array((at >= 0) & known.to_numpy(zero_copy_only=False))], ["id", "text", "target"])

    return base.mapInArrow(mark, f"id {kind}, text string, target boolean")


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches cut so that none has much more than PACKED bytes of text, the same way on every run."""
    for batch in batches:
        sizes = np.cumsum([len(t.as_buffer()) if t.is_valid else 0 for t in batch.column("text")])
        cuts = [0, *(np.flatnonzero(np.diff(sizes // PACKED)) + 1), batch.num_rows]
        yield from (batch.slice(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False) if b > a)


def scored(docs: DataFrame, target: DataFrame, id_col: str, text_col: str) -> DataFrame:
    spark = docs.sparkSession
    base = flagged(docs, target, id_col, text_col)
    counts = written(word_counts(base), "words")
    size, n_t, n_b = counts.agg(F.count("*"), F.sum("t"), F.sum("b")).first()
    totals = np.array([n_t or 0, n_b or 0], float)
    best = counts.orderBy(F.desc(F.col("t") + F.col("b")), "word").limit(FREQUENT).toArrow()
    removed(counts)
    frequent, own = best.column("word").to_numpy(), np.stack([best.column(c).to_numpy() for c in "tb"]).astype(float)
    top = np.sort(frequent[:TOP])
    order = np.argsort(frequent)
    frequent, own = frequent[order], own[:, order]
    rate = np.where(totals > 0, totals.min() / np.maximum(totals, 1), 0.0)
    sent = spark.sparkContext.broadcast((frequent, own, top, pair_counts(base, top)))  # FREQUENT and TOP bound them
    slices = max(1, int(totals.sum() // SLICE))
    even = SMOOTHING / (size + 1.0)

    def losses(own_v, own_vw, c_v, c_vw, flags):
        """Bits of pairs under both models: 2 x n. own_*: counts in the document itself, in the model of its flag."""
        out = []
        for m in (0, 1):
            mine = flags == (m == 0)
            out.append(bits(rate[m] * (c_vw[m] - mine * own_vw) + even, rate[m] * (c_v[m] - mine * own_v) + SMOOTHING))
        return np.stack(out)

    def singles(own_v, c_v, flags):
        """Bits of words under both models, but for the models' sizes, which are added in the end."""
        return np.stack([-np.log2(rate[m] * (c_v[m] - (flags == (m == 0)) * own_v) + 1.0) for m in (0, 1)])

    id_type = base.schema["id"].dataType.simpleString()
    shape = f"slice int, batch bigint, ids array<{id_type}>, docs binary, v binary, w binary, own binary, sums binary"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, c_words, top, c_pairs = sent.value
        fields = ["slice", "batch", "ids", "docs", "v", "w", "own", "sums"]
        ids_type = None
        for number, batch in enumerate(pieces(batches)):
            name = (TaskContext.get().partitionId() << 32) + number
            ids_type = pa.list_(batch.column("id").type)
            each = [words_of(t) for t in batch.column("text")]
            lengths = np.array([len(w) for w in each], np.int64)
            flag = np.array(batch.column("target").to_pylist(), bool)
            doc = np.repeat(np.arange(len(each)), lengths)
            v = np.concatenate([np.zeros(0, np.int64), *each])
            w = np.concatenate([np.zeros(0, np.int64), *[np.append(x[1:], END) for x in each if len(x)]])
            group, n = grouped(v, doc)
            own_v = n[group] if len(v) else group
            at = found_at(v, words)
            sums = np.zeros((2, len(each)))
            often = at >= 0
            for m, x in enumerate(singles(own_v[often], c_words[:, at[often]], flag[doc[often]])):
                sums[m] += np.bincount(doc[often], weights=x, minlength=len(each))
            a, b = found_at(v, top), found_at(w, top)
            near = (a >= 0) & (b >= 0)
            group, n = grouped(w[near], v[near], doc[near])
            for m, x in enumerate(losses(own_v[near], n[group] if len(group) else group, c_words[:, at[near]], c_pairs[:, a[near], b[near]], flag[doc[near]])):
                sums[m] += np.bincount(doc[near], weights=x, minlength=len(each))
            # The batch's own row goes with the sums made here; slice -1 - k only deals such rows.
            rows: list[tuple] = [(-1 - name % slices, name, batch.column("id").to_pylist(), np.stack([lengths, flag]).astype(np.int64).tobytes(), b"", b"", b"", sums.tobytes())]
            rest = ~near
            doc, v, w, own_v, often = doc[rest], v[rest], w[rest], own_v[rest], often[rest]
            key = np.where(often, mixed(v.view(np.uint64) * np.uint64(3) + mixed(w.view(np.uint64))), mixed(v.view(np.uint64)))
            to = (key % np.uint64(slices)).astype(np.int64)
            order = np.lexsort((v, doc, to))
            to = to[order]
            used, first = np.unique(to, return_index=True)
            mark = (doc | (flag[doc] << 15)).astype(np.uint16)[order] if len(doc) else np.zeros(0, np.uint16)
            v5, w5 = (np.ascontiguousarray(x[order].view(np.uint8).reshape(-1, 8)[:, :6]) for x in (v, w))
            counts = np.minimum(own_v[order], 2**32 - 1).astype(np.uint32)
            for s, i, j in zip(used, first, np.append(first[1:], len(to))[: len(used)], strict=True):
                rows.append((int(s), name, None, mark[i:j].tobytes(), v5[i:j].T.tobytes(), w5[i:j].T.tobytes(), counts[i:j].tobytes(), None))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), [pa.int32(), pa.int64(), ids_type, *[pa.binary()] * 5], strict=True)], fields)

    def settle(rows: pa.Table) -> pa.Table:
        if rows.column("slice")[0].as_py() < 0:
            return rows.select(["batch", "ids", "docs", "sums"])
        number = rows.column("slice").to_numpy()
        name, of = np.unique(rows.column("batch").to_numpy(), return_inverse=True)
        keys, sums = np.zeros(0, np.int64), np.zeros((2, 0))
        for s in np.unique(number):
            mine = np.flatnonzero(number == s)
            at, loss = settled(rows.take(pa.array(mine)), of[mine])
            every, place = np.unique(np.concatenate([keys, at]), return_inverse=True)
            sums = np.stack([np.bincount(place, weights=np.concatenate(x), minlength=len(every)) for x in zip(sums, loss, strict=True)])
            keys = every
        cuts = np.searchsorted(keys >> 15, np.arange(len(name) + 1))
        found = list(zip(cuts[:-1], cuts[1:], strict=True))
        return pa.table({"batch": pa.array(name, pa.int64()), "ids": pa.nulls(len(name), rows.schema.field("ids").type), "docs": pa.array([(keys[a:b] & 0x7FFF).astype(np.uint16).tobytes() for a, b in found], pa.binary()), "sums": pa.array([np.ascontiguousarray(sums[:, a:b]).tobytes() for a, b in found], pa.binary())})

    def settled(rows: pa.Table, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(key, sums) of the documents of one slice; key: the number of the row's batch, then 15 bits of the document's."""
        words, c_words, _, _ = sent.value
        raw = {c: [x.as_buffer() for x in rows.column(c)] for c in ("docs", "v", "w", "own")}
        marks = [np.frombuffer(x, np.uint16) for x in raw["docs"]]
        sizes = np.array([len(m) for m in marks])
        mark, row = np.concatenate(marks), np.repeat(of, sizes)
        six = lambda parts: np.concatenate([np.frombuffer(x, np.uint8).reshape(6, -1).T for x in parts])
        wide = lambda x: np.concatenate([x, np.zeros((len(x), 2), np.uint8)], axis=1).view(np.int64).ravel()
        v, w = wide(six(raw["v"])), wide(six(raw["w"]))
        own_v = np.concatenate([np.frombuffer(x, np.uint32) for x in raw["own"]]).astype(np.int64)
        flag, doc = mark >> 15 == 1, row * (1 << 15) + (mark & 0x7FFF)
        short = words & np.int64(2**48 - 1)
        by = np.argsort(short)
        at = found_at(v, short[by])
        at = np.where(at >= 0, by[at], -1) if len(by) else at
        group, _ = grouped(v)
        singly = [np.bincount(group, weights=flag == (m == 0)) for m in (0, 1)]
        pair, _ = grouped(w, v)
        paired = [np.bincount(pair, weights=flag == (m == 0)) for m in (0, 1)]
        del w
        mine, n = grouped(doc, pair)
        each, at_doc = np.unique(doc, return_inverse=True)
        sums = np.zeros((2, len(each)))
        for i in range(0, len(doc), 100_000):  # a part at a time: losses make many arrays
            part = slice(i, i + 100_000)
            c_v = np.stack([x[group[part]] for x in singly])
            known = at[part] >= 0
            c_v[:, known] = c_words[:, at[part][known]]
            loss = losses(own_v[part], n[mine[part]], c_v, np.stack([x[pair[part]] for x in paired]), flag[part])
            loss[:, ~known] += singles(own_v[part][~known], c_v[:, ~known], flag[part][~known])
            for m in (0, 1):
                sums[m] += np.bincount(at_doc[part], weights=loss[m], minlength=len(each))
        return each, sums

    def join(rows: pa.Table) -> pa.Table:
        total = None
        parts = []
        for ids, docs_, sums in zip(rows.column("ids"), rows.column("docs"), rows.column("sums"), strict=True):
            if ids.is_valid:
                length, flag = np.frombuffer(docs_.as_buffer(), np.int64).reshape(2, -1)
                total, keys = np.frombuffer(sums.as_buffer(), np.float64).reshape(2, -1).copy(), ids.values
            else:
                parts.append((np.frombuffer(docs_.as_buffer(), np.uint16), np.frombuffer(sums.as_buffer(), np.float64).reshape(2, -1)))
        for at, sums in parts:
            total[:, at] += sums
        n = np.maximum(length, 1)
        out = []
        for m in (0, 1):
            left = rate[m] * (totals[m] - (flag == (m == 0)) * length) + size
            out.append(np.where(length > 0, (total[m] + length * np.log2(np.maximum(left, 1))) / n / 2, np.nan))
        cell = lambda x: pa.array(x, pa.float64(), mask=length == 0)
        return pa.table({"id": keys, "n_words": pa.array(length, pa.int64()), "target_loss": cell(out[0]), "background_loss": cell(out[1])})

    packed = base.mapInArrow(pack, shape)
    sums = packed.groupBy(F.floor(F.col("slice") / FAN)).applyInArrow(settle, f"batch bigint, ids array<{id_type}>, docs binary, sums binary")
    out = sums.groupBy("batch").applyInArrow(join, f"id {id_type}, n_words bigint, target_loss double, background_loss double")
    return out.select(F.col("id").alias(id_col), "n_words", "target_loss", "background_loss", (F.col("target_loss") - F.col("background_loss")).alias("score"))
