"""Secret scans: fixed patterns, and runs of characters that a public token vocabulary hardly compresses.

A byte-pair vocabulary holds the pieces that people write. Words and identifiers come out at three or more characters
a token, random strings at about one and a half. Runs of key characters are taken from the text, known digests,
numbers and identifiers are put aside by their form, and of the rest those below a ratio of characters to tokens are
reported. The texts stay where they are read: one pass, no shuffle; only the vocabulary goes to the tasks.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The vocabulary goes to every executor: a larger file is refused.
VOCABULARY_BYTES = 64 << 20
#: The base kinds, in the order in which spans of one start are listed; the method's kind comes after them.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]{32,}")
#: The pre-split of the vocabulary's public tokenizer: contractions, letters, digits, other signs, white space.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

SHORTEST = 20
#: Characters a token: random letters and digits stay below 1.9 in 999 of 1,000 cases from 20 characters on.
MOST_RATIO = 2.0
RUN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % SHORTEST)
#: Hexadecimal digests of common lengths (MD5, SHA-1, SHA-2), UUIDs, and base64 digests of subresource integrity.
DIGEST = re.compile(r"(?:[0-9A-Fa-f]{32}|[0-9A-Fa-f]{40}|[0-9A-Fa-f]{56}|[0-9A-Fa-f]{64}|[0-9A-Fa-f]{96}|[0-9A-Fa-f]{128})|[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}|sha(?:256|384|512)-[A-Za-z0-9+/]+=*")
NUMBER = re.compile(r"[0-9+/_=-]+(?:[TZ][0-9+/_=-]*)*")
HUMP = re.compile("[A-Z]?[a-z]+|[A-Z]+")


def is_identifier(run: str) -> bool:
    """Names, paths and numbers: no letters but those of dates, letters of one word, or humps of four letters and more on average with short numbers between."""
    if NUMBER.fullmatch(run):
        return True
    humps = HUMP.findall(run)
    numbers = re.findall("[0-9]+", run)
    letters = sum(map(len, humps))
    if len(humps) <= 1 and not numbers:
        return True
    return letters >= 4 * len(humps) and len(numbers) <= max(1, len(humps) // 2) and letters >= 2 * sum(map(len, numbers))


@lru_cache(maxsize=2)
def encoder(vocabulary: bytes):
    import tiktoken

    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("vocabulary", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed patterns, leftmost and non-overlapping within a kind; end is exclusive."""
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8] if "=" in text or ":" in text else []
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    return found + [("hex", *m.span()) for m in HEX.finditer(text)]


def spans(text: str, vocabulary: bytes, most: float = MOST_RATIO) -> list[tuple[str, int, int, float | None]]:
    """(kind, start, end, characters a token) of a text's secrets, by start, then kind. Base kinds have no ratio.

    A random run that overlaps a base span is not reported again.
    """
    base = base_spans(text)
    found: list[tuple[str, int, int, float | None]] = [(*s, None) for s in base]
    taken = sorted((s[1], s[2]) for s in base)
    at = 0
    for m in RUN.finditer(text):
        while at < len(taken) and taken[at][1] <= m.start():
            at += 1
        if any(a < m.end() and b > m.start() for a, b in taken[at : at + 3]) or DIGEST.fullmatch(m[0]) or is_identifier(m[0]):
            continue
        ratio = len(m[0]) / len(encoder(vocabulary).encode_ordinary(m[0]))
        if ratio < most:
            found.append(("random", *m.span(), ratio))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def scan(docs: DataFrame, vocabulary: str = VOCABULARY, most: float = MOST_RATIO, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The secrets of every whole text: id and spans, an array of kind, start, end (code points, end exclusive), value
    and chars_per_token (null for the fixed patterns), by start and kind.

    A row for each row of docs, repeated rows and null ids included; null and empty texts have no spans; no rows give
    no rows. Other columns play no part, whatever their names. vocabulary: a path on the driver to a file of token
    ranks; it goes to the tasks, which need no path.
    """
    with open(vocabulary, "rb") as f:
        ranks = f.read(VOCABULARY_BYTES + 1)
    if len(ranks) > VOCABULARY_BYTES:
        raise ValueError(f"a vocabulary of more than {VOCABULARY_BYTES} bytes is not sent to the tasks")
    sent = docs.sparkSession.sparkContext.broadcast(ranks)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string()), ("chars_per_token", pa.float64())]))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.columns
            found = ([(k, a, b, t[a:b], r) for k, a, b, r in spans(t, sent.value, most)] if t else [] for t in (x.as_py() for x in texts))
            rows = [[dict(zip(("kind", "start", "end", "value", "chars_per_token"), s, strict=True)) for s in row] for row in found]
            yield pa.RecordBatch.from_arrays([ids, pa.array(rows, kind)], [id_col, "spans"])

    base = docs.select(F.col(id_col), F.col(text_col))
    shape = f"`{id_col}` {base.schema[0].dataType.simpleString()}, spans array<struct<kind:string,start:bigint,`end`:bigint,value:string,chars_per_token:double>>"
    return base.mapInArrow(look, shape)


def listed(found: Column) -> Column:
    """kind:start:end of the spans, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(docs: DataFrame) -> DataFrame:
    """scan() as counts and lists: doc_id, n_assign, n_access, n_hex, base_sha256, spans and n_random."""
    found = scan(docs)
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("bigint")
    base = F.filter("spans", lambda s: s["kind"] != "random")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in KINDS[:3]], F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), count("random").alias("n_random"))
