"""Benchmark decontamination by pigeonhole edit matching.

A test item of m characters may be changed by up to m * budget edits. Cut into one piece more than that, at least one
piece survives any such change whole. All pieces are found in one pass over a text by a keyword automaton; around each
hit the whole item is compared by Myers' bit-parallel edit distance, so a reported match is never a guess.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from loamgrid.llm.common import written

#: Items are sent to the tasks in blocks of about so many bytes; a larger benchmark takes more passes.
BLOCK_BYTES = 16_000_000
_GAP = re.compile(r"[\W_]+")


def plain(text: str | None) -> str:
    """Lower case, with each run of characters other than letters and digits as one space."""
    return _GAP.sub(" ", (text or "").lower()).strip()


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """errors + 1 pieces of nearly equal length, with their offsets."""
    cut = [len(item) * i // (errors + 1) for i in range(errors + 2)]
    return [(a, item[a:b]) for a, b in zip(cut, cut[1:], strict=False) if b > a]


def masks(item: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(item):
        out[c] = out.get(c, 0) | 1 << i
    return out


def best_end(peq: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """(distance, end) of the substring of text nearest to an item of m characters; the first such end."""
    full = (1 << m) - 1
    last = 1 << (m - 1)
    vp, vn, score, best, at = full, 0, m, m, 0
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        x = eq | vn
        d0 = (((eq & vp) + vp) ^ vp) | x
        hp = vn | (full & ~(d0 | vp))
        hn = vp & d0
        if hp & last:
            score += 1
        elif hn & last:
            score -= 1
        hp = hp << 1 & full
        hn = hn << 1 & full
        vp = hn | (full & ~(d0 | hp))
        vn = hp & d0
        if score < best:
            best, at = score, j + 1
            if not best:
                break
    return best, at


class Matcher:
    """All items of a block, ready to be looked for."""

    def __init__(self, items: list[tuple[object, str]], budget: float):
        self.items = [(i, t, int(len(t) * budget), masks(t), masks(t[::-1])) for i, t in items if t]
        at: dict[str, list[tuple[int, int]]] = {}
        for n, (_, t, errors, _, _) in enumerate(self.items):
            for offset, piece in pieces(t, errors):
                at.setdefault(piece, []).append((n, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, places in at.items():
            self.automaton.add_word(piece, (len(piece), places))
        if at:
            self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[object, int, int, int]]:
        """(item id, distance, start, end) of each item that lies in text, at its nearest place."""
        if not self.items or not text:
            return []
        hits: dict[int, set[int]] = {}
        for end, (size, places) in self.automaton.iter(text):
            for n, offset in places:
                hits.setdefault(n, set()).add(end + 1 - size - offset)
        out = []
        for n, starts in hits.items():
            item_id, item, errors, peq, qep = self.items[n]
            m = len(item)
            exact = text.find(item)
            if exact >= 0:
                out.append((item_id, 0, exact, exact + m))
                continue
            best = (errors + 1, 0, 0)
            run: list[int] = []
            for start in [*sorted(starts), math.inf]:
                if run and start - run[-1] > m:  # windows that overlap are searched as one
                    lo, hi = max(0, run[0] - errors), run[-1] + m + errors
                    distance, end = best_end(peq, m, text[lo:hi])
                    if distance < best[0]:
                        _, back = best_end(qep, m, text[max(lo, lo + end - m - errors) : lo + end][::-1])
                        best = (distance, lo + end - back, lo + end)
                    run = []
                run.append(start)
            if best[0] <= errors:
                out.append((item_id, *best))
        return out


def sent_blocks(benchmark: DataFrame, item_col: str, item_text: str) -> Iterator[tuple[Broadcast, bool]]:
    """The items as broadcast lists of (id, plain text), each of about BLOCK_BYTES at most, and whether there are several.

    One block is made at a time, and taken back before the next: its pass over the documents must be over by then.
    """
    items = benchmark.select(F.col(item_col).alias("item"), F.col(item_text).alias("text")).where("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / BLOCK_BYTES))
    for b in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b) if blocks > 1 else items
        sent = benchmark.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, sorted(((r["item"], plain(r["text"])) for r in part.collect()), key=str)))
        yield sent, blocks > 1
        if blocks > 1:
            sent.unpersist()


#: The matcher of the block that this worker has looked for last, by the block's name and the budget.
_LAST: dict[tuple[str, float], Matcher] = {}


def matcher_of(sent: Broadcast, budget: float) -> Matcher:
    """The block's matcher, made once for a worker's tasks."""
    name, items = sent.value
    if (name, budget) not in _LAST:
        _LAST.clear()
        _LAST[name, budget] = Matcher(items, budget)
    return _LAST[name, budget]


def matches(docs: DataFrame, benchmark: DataFrame, budget: float = 0.08, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """A row for each document and test item that lies in it within the item's error budget.

    Texts and items are compared as plain() leaves them; the budget is a share of the item's plain length, rounded
    down. Returns id, item id, distance (edits), start and end (in the plain text). Null and empty texts match nothing;
    null and empty items, and items without letters and digits, are never found. Equal items, and repeated documents,
    each give their own rows. An empty table on either side gives no rows. Other columns play no part. A benchmark
    beyond BLOCK_BYTES is looked for in blocks, each in a pass over docs.
    """
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null and text <> ''")
    item_type = to_arrow_type(benchmark.schema[item_col].dataType)
    kinds = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, `{item_col}` {benchmark.schema[item_col].dataType.simpleString()}, distance int, start int, end int"
    out = None
    for sent, several in sent_blocks(benchmark, item_col, item_text):

        def look(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            matcher = matcher_of(sent, budget)
            for batch in batches:
                rows = [(i, *m) for i, t in zip(batch.column("id").to_pylist(), batch.column("text"), strict=True) for m in matcher.find(plain(t.as_py()))]
                columns = list(zip(*rows, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch.column("id").type), pa.array(columns[1], item_type), *(pa.array(c, pa.int32()) for c in columns[2:])], [id_col, item_col, "distance", "start", "end"])

        found = base.mapInArrow(look, kinds)
        found = written(found, "matches") if several else found
        out = found if out is None else out.unionByName(found)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, budget: float = 0.08, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs that hold no test item, each judged by its own text; rows without text stay.

    Rows are judged where they are read: no text is shuffled. Columns of docs come out as they are, whatever their names.
    """
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(text_col).alias("text"))
    for sent, several in sent_blocks(benchmark, item_col, item_text):

        def keep(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            matcher = matcher_of(sent, budget)
            for batch in batches:
                yield batch.filter(pa.array([not matcher.find(plain(t.as_py())) for t in batch.column("text")], pa.bool_()))

        rows = rows.mapInArrow(keep, rows.schema)
        rows = written(rows, "clean") if several else rows
    return rows.select(*[F.col("row")[c].alias(c) for c in docs.columns])
