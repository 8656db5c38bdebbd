"""Near-duplicate groups by HyperMinHash registers, banding and confirmation on full shingle sets.

A document's distinct shingles are hashed to 64 bits; the first 8 bits choose one of 256 buckets, and a bucket keeps
its least remaining hash as a leading-zero count and 10 mantissa bits. Documents with equal sets are one node from
there on. Bands of registers are bucketed. A small bucket gives its pairs, of which the collision-corrected estimate
keeps those near the threshold or above it; a large bucket gives a star. What hangs together in this way is a cluster.

Every node of a cluster is compared, on full sets, with one node of the cluster, the reference C. Let a be the number of
C's shingles that a node lacks, b that of its shingles that C lacks, and w = 100 a + h b (h: the threshold in
hundredths). Then two nodes x and y whose differences from C have s shingles in common are linked exactly if

    (100 + h) s >= w_x + w_y - (100 - h) |C|.

So nodes with w <= (100 - h) |C| are linked with C itself, and any further link takes shared differences of a node beyond
that: a prefix filter over the differences finds the candidates. Random edits are rarely shared, so work stays in
proportion to the size of a cluster. Candidates are estimated from registers, then confirmed on their full differences,
which say as much as the full sets. Links are joined into components by label propagation.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamgrid.llm.common import removed, small_batches, written
from loamgrid.llm.shingles import mixed, sets

BUCKETS = 256
MANTISSA = 10
#: The chance that two different minima of like sets give the same register.
COLLISION = 0.25 / math.log(2) / 2 / 2**MANTISSA
#: Buckets of up to so many nodes give all their pairs, larger ones a star.
SMALL = 16
#: Clusters that keep more than SMALL nodes beyond their reference get further references, so many at once.
MORE = 8
#: A shingle's nodes are paired in parts of about so many.
DEALT = 256
#: A link may be missed with at most this probability for each pair of equal registers' chance.
MISS = 1e-8
#: Bits of the maps that thin out bands and texts before they are shuffled: 8 MB, whatever the corpus.
MAP_BITS = 1 << 26


def rows_per_band(threshold: float) -> int:
    """The most registers a band can have for a pair at the threshold to share a band with probability 1 - MISS."""
    return max(r for r in range(1, 17) if r == 1 or (1 - threshold**r) ** (BUCKETS // r) <= MISS)


def registers(hashes: np.ndarray) -> np.ndarray:
    """256 registers (uint16, 0: empty) of sorted distinct hashes: larger for smaller minima."""
    first = np.searchsorted(hashes, np.arange(BUCKETS, dtype=np.uint64) << np.uint64(56))
    ok = np.append(first[1:], len(hashes)) > first
    rest = (hashes[first[ok]] << np.uint64(8)) >> np.uint64(16)  # 48 bits, exact as doubles
    m, e = np.frexp(rest.astype(np.float64))
    out = np.zeros(BUCKETS, np.uint16)
    out[ok] = ((48 - e + 1) << MANTISSA) + (2**MANTISSA - 1 - np.floor((np.maximum(m, 0.5) - 0.5) * 2 * 2**MANTISSA)).astype(np.int64)
    return out


def filled(regs: np.ndarray) -> np.ndarray:
    """The registers with every empty one taken from the non-empty one that comes first in its own order of buckets."""
    empty, full = np.flatnonzero(regs == 0), np.flatnonzero(regs)
    if not len(empty) or not len(full):
        return regs
    out = regs.copy()
    out[empty] = regs[full[_ORDER[np.ix_(empty, full)].argmin(axis=1)]]
    return out


_ORDER = np.random.default_rng(256).random((BUCKETS, BUCKETS)).argsort(axis=1).argsort(axis=1).astype(np.int16)


def node_of(hashes: np.ndarray) -> tuple[int, int]:
    """A 126-bit digest of a set, as two non-negative integers."""
    return int(hashes.sum(dtype=np.uint64) >> np.uint64(1)), int(mixed(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64) >> np.uint64(1))


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """id, mark, n (set size), node, check (the digest) and regs, for each row of docs (id, text, mark)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, a, b, regs = [], [], [], []
            for s in sets(batch.column("text"), size):
                x, y = node_of(s)
                n.append(len(s))
                a.append(x)
                b.append(y)
                regs.append(registers(s).tobytes() if len(s) else b"")
            yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "mark": batch.column("mark"), "n": pa.array(n, pa.int64()), "node": pa.array(a, pa.int64()), "check": pa.array(b, pa.int64()), "regs": pa.array(regs, pa.binary())})

    return docs.mapInArrow(sign, f"id {docs.schema['id'].dataType.simpleString()}, mark bigint, n bigint, node bigint, check bigint, regs binary")


def bands(nodes: DataFrame, rows: int, shared: np.ndarray | None = None) -> DataFrame:
    """band (a hash of its number and filled registers) and node; with shared, a bit map, only the bands it has."""
    sent = None if shared is None else nodes.sparkSession.sparkContext.broadcast(shared)  # MAP_BITS bits

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_bands = BUCKETS // rows
        coef = np.random.default_rng(rows).integers(0, 2**64, (n_bands, rows), dtype=np.uint64) | np.uint64(1)
        salt = mixed(np.arange(1, n_bands + 1, dtype=np.uint64))
        for batch in batches:
            if not batch.num_rows:
                continue
            regs = np.stack([filled(np.frombuffer(r.as_buffer(), np.uint16)) for r in batch.column("regs")])
            regs = regs[:, : n_bands * rows].reshape(-1, n_bands, rows)
            band = mixed((mixed(regs.astype(np.uint64) + np.uint64(1)) * coef).sum(axis=2, dtype=np.uint64) + salt).ravel()
            node = np.repeat(batch.column("node").to_numpy(), n_bands)
            if sent is not None:
                at = band % np.uint64(MAP_BITS)
                ok = (sent.value[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
                band, node = band[ok], node[ok]
            yield pa.RecordBatch.from_pydict({"band": band.view(np.int64), "node": node})

    return nodes.select("node", "regs").mapInArrow(cut, "band bigint, node bigint")


def bit_map(numbers: DataFrame) -> DataFrame:
    """The set bits of a map of MAP_BITS bits, as rows bucket and bits: bit number (a bigint column) mod MAP_BITS."""
    at = F.pmod(F.col("number"), F.lit(MAP_BITS)) + 1
    return numbers.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))


def gathered(rows: DataFrame) -> np.ndarray:
    """bit_map() as one array of MAP_BITS / 8 bytes."""
    out = np.zeros(MAP_BITS // 8, np.uint8)
    for r in rows.toLocalIterator():
        one = np.frombuffer(bytes(r["bits"]), np.uint8)
        at = (r["bucket"] - 1) * 4096
        out[at : at + len(one)] = one[: len(out) - at]
    return out


def marked(df: DataFrame, number: Column, rows: DataFrame) -> DataFrame:
    """The rows of df whose number mod MAP_BITS is a set bit of rows, a bit_map()."""
    at = F.pmod(number, F.lit(MAP_BITS)) + 1
    bit = F.bitmap_bit_position(at)
    byte = F.conv(F.hex(F.substring("bits", (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = df.withColumn("_bit", bit).withColumn("_bucket", F.bitmap_bucket_number(at)).join(F.broadcast(rows), F.col("_bucket") == F.col("bucket"))
    return found.where(F.pmod(F.floor(byte / F.pow(F.lit(2), F.pmod(bit, F.lit(8)))), F.lit(2)) == 1).select(*df.columns)


def estimated(pairs: DataFrame, regs: DataFrame, threshold: float) -> DataFrame:
    """Those pairs (a, b) whose collision-corrected Jaccard estimate allows for a link at five deviations."""
    both = pairs.join(regs.toDF("a", "r_a"), "a").join(regs.toDF("b", "r_b"), "b")

    def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, BUCKETS) for c in ("r_a", "r_b"))
            used = np.maximum(((x > 0) | (y > 0)).sum(axis=1), 1)
            est = (((x == y) & (x > 0)).sum(axis=1) / used - COLLISION) / (1 - COLLISION)
            near = pa.array(est >= threshold - 5 * np.sqrt(threshold * (1 - threshold) / used) - 2 / used)
            yield pa.RecordBatch.from_pydict({"a": batch.column("a").filter(near), "b": batch.column("b").filter(near)})

    return both.mapInArrow(estimate, "a bigint, b bigint")


def components(links: DataFrame) -> DataFrame:
    """node and comp, the least node it reaches, for every node of links (a, b), by label propagation with jumps."""
    both = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("comp")), "labels")
    while True:
        heard = both.join(labels.toDF("b", "heard"), "b").groupBy("a").agg(F.min("heard").alias("heard"))
        told = labels.join(heard.withColumnRenamed("a", "node"), "node").select("node", F.col("comp").alias("was"), F.least("comp", "heard").alias("comp"))
        jump = told.alias("t").join(labels.select(F.col("node").alias("at"), F.col("comp").alias("next")), F.col("t.comp") == F.col("at"))
        new = written(jump.select("node", "was", F.least("comp", "next").alias("comp")), "labels")
        changed = new.where("was <> comp").limit(1).count()
        labels = new.select("node", "comp")
        if not changed:
            return labels


def pairs_in(small: DataFrame, hundredths: int) -> DataFrame:
    """(a, b), a < b: the pairs of nodes of one bucket (band, node, n) that can be linked by their sizes."""
    # Buckets with the same nodes are one.
    lists = small.groupBy("band").agg(F.array_sort(F.collect_list(F.struct("node", "n"))).alias("in")).select("in").distinct()
    later = F.slice("in", F.col("i") + 2, F.lit(SMALL))
    fits = lambda y: F.least(y["n"], F.col("x.n")) * 100 >= F.lit(hundredths) * F.greatest(y["n"], F.col("x.n"))
    each = lists.select("in", F.posexplode("in").alias("i", "x")).select("x", F.explode(F.filter(later, fits)).alias("y"))
    return each.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()


def differences(texts: DataFrame, refs: DataFrame, size: int, hundredths: int) -> DataFrame:
    """A row for each row of texts (node, cluster, text) and reference (ref, cluster, text) of its cluster.

    node, cluster, ref; w and most: the sides of the module's law for a link with the reference; items: the hashes of the
    shingles that one of the two has and the other lacks.
    """
    pairs = texts.join(refs.select("cluster", F.col("node").alias("ref"), F.col("text").alias("ref_text")), "cluster").select("node", "cluster", "text", "ref", "ref_text")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, None)
        for batch in batches:
            weights, most, items = [], [], []
            for s, ref, text in zip(sets(batch.column("text"), size), batch.column("ref").to_pylist(), batch.column("ref_text"), strict=True):
                if ref != last[0]:
                    last = (ref, next(sets(pa.array([text.as_py()], pa.string()), size)))
                c = last[1]
                # Both are sorted and distinct: what stands next to its like in the sorted whole is common.
                both = np.sort(np.concatenate([s, c]), kind="stable")
                twice = np.concatenate([both[1:] == both[:-1], [False]])
                once = both[~(twice | np.concatenate([[False], twice[:-1]]))]
                common = int(twice.sum())
                weights.append(100 * (len(c) - common) + hundredths * (len(s) - common))
                most.append((100 - hundredths) * len(c))
                items.append(once.tobytes())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("node", "cluster", "ref")), pa.array(weights, pa.int64()), pa.array(most, pa.int64()), pa.array(items, pa.binary())], ["node", "cluster", "ref", "w", "most", "items"])

    return pairs.mapInArrow(compare, "node bigint, cluster bigint, ref bigint, w bigint, most bigint, items binary")


def exploded(diffs: DataFrame) -> DataFrame:
    """A row for each item of (node, cluster, comp, w, most, items), with the number of its node's items."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column("items")]
            sizes = np.array([len(x) for x in items], np.int64)
            rows = {c: np.repeat(batch.column(c).to_numpy(), sizes) for c in ("node", "cluster", "comp", "w", "most")}
            yield pa.RecordBatch.from_pydict(rows | {"n_items": np.repeat(sizes, sizes), "item": np.concatenate([np.zeros(0, np.int64), *items])})

    return diffs.select("node", "cluster", "comp", "w", "most", "items").mapInArrow(cut, "node bigint, cluster bigint, comp bigint, w bigint, most bigint, n_items bigint, item bigint")


def needed(w_x: Column, w_y: Column, most: Column, hundredths: int) -> Column:
    """The differences two nodes must share to be linked."""
    return F.ceil((w_x + w_y - most) / (100 + hundredths))


def candidates(diffs: DataFrame, hundredths: int) -> DataFrame:
    """(a, b), a < b, of two components: all pairs that can be linked over shared differences from their cluster's
    reference, one of the two being beyond a link with it, by a prefix filter. diffs: differences() with comp.

    Ordered from the rarest item on, linked nodes have one in common among the first |D| - s + 1 of each, s being the
    least number of items they must share: over all partners, (w - most) / 100 for a node beyond the reference, since a
    partner's w is at least h s, and w / (100 + h), rounded down, plus 1 for the others. Items that many nodes have are
    dealt over several tasks. Items of one component, or of no node beyond the reference, can tell nothing new.
    """
    beyond = F.col("w") > F.col("most")
    rows = written(exploded(diffs).where("n_items > 0"), "items")
    often = rows.groupBy("cluster", "item").agg(F.count("*").alias("often"), F.max(beyond).alias("_any"), F.min("comp").alias("_lo"), F.max("comp").alias("_hi")).where("often > 1 and _any and _lo <> _hi").drop("_any", "_lo", "_hi")
    ranked = rows.join(often, ["cluster", "item"]).groupBy("node", "cluster", "comp", "w", "most", "n_items").agg(F.array_sort(F.collect_list(F.struct("often", "item"))).alias("in"))
    least = F.when(beyond, F.greatest(F.lit(1), F.ceil((F.col("w") - F.col("most")) / 100))).otherwise(F.floor(F.col("w") / (100 + hundredths)) + 1)
    # Items that are not in "in" come first in the order and are shared with no node of interest.
    ranked = ranked.withColumn("far", beyond).withColumn("_take", F.size("in") - least + 1).where("_take > 0")
    placed = ranked.select("node", "cluster", "comp", "w", "most", "far", F.size("in").alias("live"), F.posexplode(F.slice("in", F.lit(1), F.col("_take").cast("int"))).alias("at", "item"))
    placed = written(placed.select("node", "cluster", "comp", "w", "most", "far", F.col("item.item").alias("item"), (F.col("live") - F.col("at")).alias("after")), "prefixes")
    shared = placed.groupBy("cluster", "item").agg((F.floor(F.count("*") / DEALT) + 1).alias("salts"), F.max("far").alias("_any"), F.min("comp").alias("_lo"), F.max("comp").alias("_hi")).where("_any and _lo <> _hi").drop("_any", "_lo", "_hi")
    dealt = written(placed.join(shared, ["cluster", "item"]), "dealt")
    x = dealt.where("far").withColumn("salt", F.pmod(F.xxhash64("node"), "salts")).alias("x")
    y = dealt.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("salts") - 1))).alias("y")
    once = ~F.col("y.far") | (F.col("x.node") < F.col("y.node"))
    fits = once & (F.col("x.comp") != F.col("y.comp")) & (F.least("x.after", "y.after") >= needed(F.col("x.w"), F.col("y.w"), F.col("x.most"), hundredths))
    met = x.join(y, (F.col("x.cluster") == F.col("y.cluster")) & (F.col("x.item") == F.col("y.item")) & (F.col("x.salt") == F.col("y.salt")) & fits)
    return met.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def confirmed(pairs: DataFrame, diffs: DataFrame, hundredths: int) -> DataFrame:
    """The pairs (a, b) of a cluster that are linked, from their full differences from the reference."""
    of = lambda k: diffs.select(*[F.col(c).alias(f"{c}_{k}") for c in ("w", "most", "items")], F.col("node").alias(k))
    both = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "items_a", "items_b", needed(F.col("w_a"), F.col("w_b"), F.col("most_a"), hundredths).alias("need"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y, need in zip(batch.column("items_a"), batch.column("items_b"), batch.column("need").to_pylist(), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                ok.append(len(np.intersect1d(x, y, assume_unique=True)) >= need)
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_pydict({"a": batch.column("a").filter(keep), "b": batch.column("b").filter(keep)})

    return both.mapInArrow(compare, "a bigint, b bigint")


def clusters(nodes: DataFrame, regs: DataFrame, spread: DataFrame, hundredths: int) -> DataFrame:
    """node, cluster and typical, which is larger for nodes that share buckets with many: of spread (band, node, n, many)."""
    small = estimated(pairs_in(spread.where(F.col("many") <= SMALL), hundredths), regs, hundredths / 100)
    large = spread.where(F.col("many") > SMALL)
    stars = large.join(large.groupBy("band").agg(F.min("node").alias("hub")), "band").where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    found = components(written(small.unionByName(stars), "edges")).withColumnRenamed("comp", "cluster")
    return found.join(spread.groupBy("node").agg(F.sum("many").alias("typical")), "node")


def near_duplicates(docs: DataFrame, size: int = 5, hundredths: int = 80, id_col: str = "doc_id", text_col: str = "text", mark: bool = False) -> DataFrame:
    """The component of every row under links with 100 * intersection >= hundredths * union of shingle sets.

    Words are runs of characters other than space and 0x09-0x0D, A-Z lower-cased; a set holds the distinct runs of
    size words, of a shorter text the whole run. Texts that are null or without words have an empty set and no links.
    Returns id, n_shingles, component_id (the least id in the component; null if all are null), component (a number for
    the component) and kept (id = component_id; a row with a null id is kept if no row of its component has an id), and
    with mark=True mark, a hash of the text. Every row of docs is in the result, repeated rows too; no rows give no rows;
    other columns of docs play no part. All but the last joins has run when it returns.
    """
    with small_batches(docs.sparkSession, 1000):
        return grouped(docs, size, hundredths, id_col, text_col, mark)


def grouped(docs: DataFrame, size: int, hundredths: int, id_col: str, text_col: str, mark: bool) -> DataFrame:
    rows = rows_per_band(hundredths / 100)
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("mark"))
    wide = written(signatures(base, size), "signatures")
    nodes = written(wide.where("n > 0").groupBy("node", "check").agg(F.min(F.struct("id", "mark")).alias("rep"), F.first("n").alias("n"), F.first("regs").alias("regs")), "nodes")
    signed = written(wide.drop("regs", "check"), "signed")
    removed(wide)
    # A set of n shingles has at most n / (n + 1) in common with another one.
    able = nodes.where(F.col("n") * (100 - hundredths) >= hundredths)
    # Most bands are of one node. The others are marked in a bit map, so that only they are shuffled with their nodes.
    many = F.count("*").alias("many")
    shared = gathered(bit_map(bands(able, rows).groupBy("band").agg(many).where("many > 1").select(F.col("band").alias("number"))))
    alike = written(bands(able, rows, shared), "bands")
    spread = alike.join(alike.groupBy("band").agg(many).where("many > 1"), "band").join(able.select("node", "n"), "node")
    spread = written(spread.select("band", "node", "n", "many"), "buckets")
    removed(alike)
    few = written(able.select("node", "regs", "rep").join(spread.select("node").distinct(), "node"), "registers")
    if not few.limit(1).count():
        return finished(signed, None, id_col, mark)
    cluster = written(clusters(able, few.select("node", "regs"), spread, hundredths), "clusters")
    wanted = written(cluster.join(few.select("node", "rep"), "node"), "wanted")
    some = marked(base, F.col("mark"), bit_map(wanted.select(F.col("rep.mark").alias("number"))))
    found = some.join(wanted, some["id"].eqNullSafe(wanted["rep"]["id"]) & (some["mark"] == wanted["rep"]["mark"]))
    texts = written(found.select("node", "cluster", "typical", "text").dropDuplicates(["node"]), "texts")
    ref = wanted.groupBy("cluster").agg(F.max_by("node", F.struct("typical", F.xxhash64("node"))).alias("node"))
    diffs = written(differences(texts, texts.join(ref, ["cluster", "node"]), size, hundredths), "differences")
    links = diffs.where("w <= most and node <> ref").select(F.col("node").alias("a"), F.col("ref").alias("b"))
    # A cluster may hold several groups: the nodes beyond the reference meet some of themselves.
    left = diffs.where("w > most").select("node", "cluster")
    crowd = written(left.join(left.groupBy("cluster").agg(many).where(F.col("many") > SMALL), "cluster"), "crowd")
    while crowd.limit(1).count():
        dealt = crowd.withColumn("_part", F.pmod(F.xxhash64("node"), F.lit(MORE)))
        more = dealt.groupBy("cluster", "_part").agg(F.min_by("node", F.xxhash64("node", F.lit(1))).alias("node"))
        apart = texts.join(crowd.select("node"), "node", "left_semi")
        met = differences(apart, texts.join(more.select("cluster", "node"), ["cluster", "node"]), size, hundredths)
        new = written(met.where("w <= most and node <> ref").select(F.col("node").alias("a"), F.col("ref").alias("b")), "more")
        links = links.unionByName(new)
        rest = crowd.select("node", "cluster").join(new.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node", "left_anti")
        sizes = crowd.groupBy("cluster").agg(F.count("*").alias("before"))
        rest = rest.join(rest.groupBy("cluster").agg(many), "cluster").join(sizes, "cluster")
        # Clusters of which few nodes were linked hold no further large group.
        crowd = written(rest.where((F.col("many") > SMALL) & (F.col("many") * 4 <= F.col("before") * 3)).select("node", "cluster", "many"), "crowd")
    links = written(links, "stars")
    comps = components(links)
    # Only clusters with a node beyond the reference and a second one besides it can have further links.
    open_ = diffs.where("node <> ref").groupBy("cluster").agg(many, F.max(F.col("w") > F.col("most")).alias("_far")).where("_far and many > 1").select("cluster")
    unsure = written(diffs.join(open_, "cluster", "left_semi").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node")), "unsure")
    if unsure.limit(1).count():
        pairs = estimated(candidates(unsure, hundredths), few.select("node", "regs"), hundredths / 100)
        extra = written(confirmed(pairs, unsure, hundredths), "confirmed")
        if extra.limit(1).count():
            comps = components(links.unionByName(extra))
    return finished(signed, comps, id_col, mark)


def finished(signed: DataFrame, comps: DataFrame | None, id_col: str, mark: bool) -> DataFrame:
    if comps is None:
        comps = signed.select("node", F.col("node").alias("comp")).limit(0)
    labelled = signed.join(comps, "node", "left").select("id", "mark", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("comp", "node")).alias("component"))
    least = labelled.where("component is not null").groupBy("component").agg(F.min("id").alias("least"))
    out = labelled.join(least, "component", "left").withColumn("component_id", F.when(F.col("component").isNull(), F.col("id")).otherwise(F.col("least")))
    kept = F.when(F.col("component").isNull() | F.col("component_id").isNull(), F.lit(True)).otherwise(F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)))
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", kept.alias("kept"), "component", *["mark"] * mark)


def distinct_documents(docs: DataFrame, size: int = 5, hundredths: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group of near duplicates: the kept rows of near_duplicates(), repeated rows once.

    A document is told by its id and text. Documents without words are groups of their own, told the same way. All
    columns of docs come out as they are, whatever their names.
    """
    judged = near_duplicates(docs, size, hundredths, id_col, text_col, mark=True)
    kept = judged.where("kept").select(F.col(id_col).alias("id"), "mark").distinct()
    whole = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("key"), F.xxhash64(text_col).alias("hash"))
    rows = whole.join(kept, whole["key"].eqNullSafe(kept["id"]) & (whole["hash"] == kept["mark"]), "left_semi")
    return rows.dropDuplicates(["key", "hash"]).select(*[F.col("row")[c].alias(c) for c in docs.columns])
