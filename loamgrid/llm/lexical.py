"""Exact ranked lexical search over dual-sorted wavelet trees, one for each shard of documents.

A shard's postings lie in one sequence of document numbers: term after term, each term's postings by falling impact.
A wavelet tree over that sequence (in its level-wise form, zeros before ones at each level) keeps both orders. A
term's postings are a range at the root; going down by rank keeps the range's order by impact, and leaves are reached
in the order of documents. So at every node of the tree the first posting of a term's range is the best of that term
among the node's documents, and the sum over the terms bounds what any of these documents can score.

A search takes nodes best first. It meets the ranges of all terms in a node at once, goes down where the bound can
still reach the best k, and ends when no node can. A task holds one shard at a time and carries each item's k-th score
from shard to shard, so later shards are cut off sooner; a task gives k rows an item at most.

The index is a table in the shared folder: it grows with the documents, nothing of it goes to the driver but the
counts of the items' own terms. Items go to the tasks in blocks of bounded size, one block at a time.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamgrid.llm.common import removed, small_batches, written

#: Terms are runs of ASCII letters and digits and of anything beyond ASCII: of the bytes of UTF-8, all others become a
#: space, and A to Z become small letters.
BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
#: A shard holds so many documents at most, and ends once it has so many bytes of text.
SHARD_DOCS = 2048
SHARD_BYTES = 8 << 20
#: Bytes of the terms of a block of items.
BLOCK_BYTES = 4 << 20
#: Nodes taken from the queue at once.
TAKEN = 32
SHARD = "docs int, ids array<bigint>, terms binary, starts binary, impacts binary, bits binary"


def split(text: bytes) -> list[bytes]:
    return text.translate(BYTES).split()


def built(ids: list[int | None], texts: list[list[bytes]], n_docs: int, n_terms: int) -> dict:
    """The shard of documents given as lists of terms, ordered by id with nulls last. n_docs, n_terms: N and L of all documents."""
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
    ids, texts = [ids[i] for i in order], [texts[i] for i in order]
    sizes = np.array([len(t) for t in texts], np.int64)
    every = [t for text in texts for t in text]
    names = sorted(set(every))
    number = {t: i for i, t in enumerate(names)}
    docs = len(ids)
    key = np.fromiter(map(number.__getitem__, every), np.int64, len(every)) * docs + np.repeat(np.arange(docs), sizes)
    key, tf = np.unique(key, return_counts=True)
    term, doc = key // docs, key % docs
    m = np.array([75 + 25 * n * n_docs // max(n_terms, 1) for n in sizes.tolist()], dtype=np.int64)
    impact = 1_000_000_000 * tf // (1000 * tf + 12 * m[doc])
    by = np.lexsort((doc, -impact, term))
    sequence, impact = doc[by].astype(np.int32), impact[by].astype(np.int32)
    starts = np.searchsorted(term, np.arange(len(names) + 1)).astype(np.int32)
    levels = max(1, (docs - 1).bit_length())
    bits = []
    for level in range(levels - 1, -1, -1):
        one = (sequence >> level & 1).astype(bool)
        bits.append(np.packbits(one))
        sequence = np.concatenate([sequence[~one], sequence[one]])
    return {"docs": docs, "ids": ids, "terms": b" ".join(names), "starts": starts.tobytes(), "impacts": impact.tobytes(), "bits": b"".join(b.tobytes() for b in bits)}


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_docs: int = SHARD_DOCS, shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, int]:
    """(the written table of shards, N): every document with a term is in one shard."""
    base = docs.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("binary").alias("_text")).where(F.length("_text") > 0)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = [n for batch in batches for text in batch.column(0) if (n := len(split(text.as_py())))]
        yield pa.RecordBatch.from_pydict({"docs": [len(sizes)], "terms": [sum(sizes)]})

    with small_batches(docs.sparkSession, 256):
        n_docs, n_terms = (v or 0 for v in base.select("_text").mapInArrow(count, "docs bigint, terms bigint").agg(F.sum("docs"), F.sum("terms")).first())

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int | None] = []
        texts: list[list[bytes]] = []
        held = 0

        def shard() -> pa.RecordBatch:
            row = built(ids, texts, n_docs, n_terms)
            ids.clear()
            texts.clear()
            kinds = {"docs": pa.int32(), "ids": pa.list_(pa.int64())}
            return pa.RecordBatch.from_pydict({k: pa.array([v], kinds.get(k, pa.binary())) for k, v in row.items()})

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                terms = split(text.as_py())
                if terms:
                    ids.append(i)
                    texts.append(terms)
                    held += sum(map(len, terms)) + len(terms)
                if len(ids) >= shard_docs or held >= shard_bytes:
                    yield shard()
                    held = 0
        if ids:
            yield shard()

    with small_batches(docs.sparkSession, 256):
        return written(base.mapInArrow(build, SHARD), "lexical"), n_docs


class Tree:
    """A shard opened for searching: ranks and impacts by level."""

    def __init__(self, row: dict):
        self.docs, self.ids = row["docs"], row["ids"]
        self.terms = row["terms"].split(b" ")
        self.starts = np.frombuffer(row["starts"], np.int32)
        impact = np.frombuffer(row["impacts"], np.int32)
        size = len(impact)
        self.levels = max(1, (self.docs - 1).bit_length())
        packed = np.frombuffer(row["bits"], np.uint8).reshape(self.levels, -1)
        self.ones, self.zeros, self.impacts = [], [], [np.append(impact, 0)]
        for level in range(self.levels):
            one = np.unpackbits(packed[level], count=size).astype(bool)
            self.ones.append(np.concatenate([[0], np.cumsum(one, dtype=np.int32)]).astype(np.int32))
            self.zeros.append(size - int(self.ones[-1][-1]))
            impact = np.concatenate([impact[~one], impact[one]])
            self.impacts.append(np.append(impact, 0))

    def range_of(self, term: bytes) -> tuple[int, int] | None:
        i = bisect_left(self.terms, term)
        return (int(self.starts[i]), int(self.starts[i + 1])) if i < len(self.terms) and self.terms[i] == term else None

    def down(self, level: int, at: np.ndarray, one: bool) -> np.ndarray:
        ones = self.ones[level][at]
        return self.zeros[level] + ones if one else at - ones

    def search(self, terms: dict[bytes, int], k: int, least: int) -> list[tuple[int, int]]:
        """(score, document number) of the k best documents that score at least least, best first, then by number.

        terms: the weight of each term. Nodes of one level are met in one step for all of a step's nodes and terms.
        """
        found = [(r, w) for t, w in terms.items() if w > 0 and (r := self.range_of(t))]
        if not found:
            return []
        weight = np.array([w for _, w in found], np.int64)
        start, end = (np.array([[r[i] for r, _ in found]], np.int64) for i in (0, 1))
        bound = int(self.impacts[0][start[0]] @ weight)
        # The queue: for each open node its bound, level, first document, and the ranges of the terms.
        queue = [(-bound, 0, 0, start[0], end[0])] if bound >= least else []
        best: list[tuple[int, int]] = []
        while queue:
            queue.sort(key=lambda node: node[:2])
            taken, queue = queue[:TAKEN], queue[TAKEN:]
            grown = []
            for level in {node[2] for node in taken}:
                own = [node for node in taken if node[2] == level]
                first = np.array([node[1] for node in own])
                s, e = np.array([node[3] for node in own]), np.array([node[4] for node in own])
                for one in (False, True):
                    a, b = self.down(level, s, one), self.down(level, e, one)
                    bounds = (np.where(a < b, self.impacts[level + 1][a], 0) * weight).sum(axis=1)
                    doc = first + (one << (self.levels - 1 - level))
                    ok = np.flatnonzero((bounds >= least) & (bounds > 0))
                    grown += [(-int(bounds[i]), int(doc[i]), level + 1, a[i], b[i]) for i in ok]
            queue += [node for node in grown if node[2] < self.levels]
            if leaves := [(-node[0], node[1]) for node in grown if node[2] == self.levels]:
                best = sorted(best + leaves, key=lambda x: (-x[0], x[1]))[:k]
                if len(best) == k and best[-1][0] >= least:
                    least = best[-1][0]
                    # At the k-th score only documents before the k-th could still get in.
                    queue = [node for node in queue if -node[0] > least or (-node[0] == least and node[1] < best[-1][1])]
        return best


def ranked(shards: DataFrame, block: list[tuple[int, int | None, Counter]], n_docs: int, k: int) -> DataFrame:
    """The k best rows of each task for each item of the block: at, item_id, doc_id, score."""
    spark = shards.sparkSession
    wanted = sorted({t for _, _, terms in block for t in terms})
    sent = spark.sparkContext.broadcast(wanted)  # BLOCK_BYTES at most, and one item's

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(sent.value), np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                at = {t: i for i, t in enumerate(row["terms"].split(b" "))}
                starts = np.frombuffer(row["starts"], np.int32)
                total += [int(starts[i + 1] - starts[i]) if (i := at.get(t)) is not None else 0 for t in sent.value]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"term": some.astype(np.int64), "df": total[some]})

    counts = shards.select("terms", "starts").mapInArrow(lengths, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df"))
    with small_batches(spark, 8):
        df = {wanted[r["term"]]: r["df"] for r in counts.collect()}  # terms of the block
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for t, n in df.items()}
    items = spark.sparkContext.broadcast([(at, item, {t: c * weight[t] for t, c in terms.items() if t in weight}) for at, item, terms in block])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[tuple[int, bool, int]]] = {at: [] for at, _, _ in items.value}
        for batch in batches:
            for row in batch.to_pylist():
                tree = Tree(row)
                for at, _, terms in items.value:
                    had = best[at]
                    got = tree.search(terms, k, had[-1][0] if len(had) == k else 1)
                    if got:
                        rows = had + [(score, tree.ids[d] is None, tree.ids[d] or 0) for score, d in got]
                        best[at] = sorted(rows, key=lambda x: (-x[0], x[1], x[2]))[:k]
        for at, item, _ in items.value:
            if rows := best[at]:
                yield pa.RecordBatch.from_pydict({"at": pa.array([at] * len(rows), pa.int64()), "item_id": pa.array([item] * len(rows), pa.int64()), "doc_id": pa.array([None if null else d for _, null, d in rows], pa.int64()), "score": pa.array([s for s, _, _ in rows], pa.int64())})

    with small_batches(spark, 1):
        return written(shards.mapInArrow(search, "at bigint, item_id bigint, doc_id bigint, score bigint"), "ranked")


def search(docs: DataFrame, items: DataFrame, k: int = 20, shard_docs: int = SHARD_DOCS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The k highest-scoring documents of every item: item_id, rank (from 1), doc_id, score; best first, ties by doc_id, null ids last.

    Only scores above 0 count, so an item without terms, or whose terms no document holds, has no rows, and neither
    has anything over an empty table. Null and empty texts hold no terms. Every row is a document, or an item, of its
    own: repeated documents take several ranks, repeated items come out as often as they are there. Columns besides
    doc_id, item_id and text play no part.
    """
    shards, n_docs = index(docs, shard_docs=shard_docs)
    spark = docs.sparkSession
    out = spark.createDataFrame([], "at bigint, item_id bigint, doc_id bigint, score bigint")
    block: list[tuple[int, int | None, Counter]] = []
    held = 0
    for at, row in enumerate(items.select(F.col("item_id").cast("bigint"), F.col("text").cast("binary").alias("t")).toLocalIterator()):
        terms = Counter(split(bytes(row["t"] or b"")))
        if terms:
            block.append((at, row["item_id"], terms))
            held += sum(map(len, terms)) + 32 * len(terms)
        if held >= block_bytes:
            out = out.unionByName(ranked(shards, block, n_docs, k))
            block, held = [], 0
    if block:
        out = out.unionByName(ranked(shards, block, n_docs, k))
    removed(shards)
    order = Window.partitionBy("at").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
