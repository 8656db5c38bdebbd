"""Mixing sources to target weights over fixed-length token blocks.

Every source's tokens are packed end to end into blocks. Each output shard draws how many of its slots every source
fills: the whole part of a source's share of the shard is certain, the slots left over are a seeded multinomial draw
with the fractional parts of the shares as probabilities. A shard's counts thus have the targets' shares as their mean
and the least spread that drawing allows, and sums over shards stay near the targets without any shard waiting for
another. A source's k-th slot, counted over the shards in order, takes the block that the source's permutation of epoch
k div blocks gives for k mod blocks; slots beyond the cap on repeats stay empty. Slots and blocks meet in a join by block
index.

Permutations are swap-or-not shuffles: exact on any number of blocks, computed row by row, the same on every run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamgrid.llm.common import SPACE, WORD, hash60, running_offset, written

P = 2147483647
ROUNDS = 24


def permuted(x: Column, n: Column, salt: Column, inverse: bool = False) -> Column:
    """A pseudorandom permutation of 0 .. n-1, chosen by salt (non-negative, below 2^31), at x; or its inverse.

    Each round pairs the numbers y and pick - y (mod n) and swaps a pair if a bit hashed from its larger member is set.
    """

    def swap(acc, r):
        pick = F.pmod((F.pmod((salt * 64 + r) * 48271 + 11, F.lit(P)) * 69621) % P * 16807 + r, n)
        other = F.pmod(pick - acc, n)
        top = F.greatest(acc, other)
        bit = ((top % P) * (F.pmod((salt + 7) * 40692 + r * 7919, F.lit(P - 1)) + 1) + (salt + 1) * (r + 3) * 3791) % P % 2
        return F.when(bit == 1, other).otherwise(acc)

    rounds = range(ROUNDS - 1, -1, -1) if inverse else range(ROUNDS)
    return F.aggregate(F.array(*[F.lit(r).cast("bigint") for r in rounds]), x.cast("bigint"), swap)


def words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sized: DataFrame, weights: tuple[int, ...], most: int, block: int) -> DataFrame:
    """A row for each source: its rank by code point (null last), size, target, number of blocks and slots.

    target: the weight's share of all words, stopped at most times the source's size; the excess goes to the others
    by weight. Sorted by size / weight, the stopped sources are a prefix, so running sums find them without a loop.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = sizes.withColumn("rank", (F.row_number().over(by_name) - 1).cast("bigint"))
    ranked = ranked.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")))
    up = Window.orderBy(F.col("source_size") / F.col("w"), "rank")
    cap = F.lit(most) * F.col("source_size")
    total = F.sum("source_size").over(Window.partitionBy())
    before = F.coalesce(F.sum(cap).over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    level = (total - before) / F.sum("w").over(up.rowsBetween(0, Window.unboundedFollowing))
    levels = ranked.withColumns({"cap": cap, "total": total, "level": level}).withColumn("stopped", F.col("cap") <= F.col("level") * F.col("w"))
    open_level = F.min(F.when(~F.col("stopped"), F.struct(F.col("source_size") / F.col("w"), F.col("rank"), F.col("level"))))
    out = levels.withColumn("open", open_level.over(Window.partitionBy())["level"])
    out = out.withColumn("target", F.when(F.col("stopped"), F.col("cap").cast("double")).otherwise(F.col("open") * F.col("w")))
    out = out.withColumn("blocks", F.ceil(F.col("source_size") / block).cast("bigint"))
    quota = F.when(F.col("source_size") > 0, F.least(F.round(F.col("target") * F.col("blocks") / F.col("source_size")).cast("bigint"), most * F.col("blocks"))).otherwise(F.lit(0).cast("bigint"))
    out = out.withColumn("quota", quota)
    return out.select("source", "rank", "source_size", "target", "blocks", "quota", F.sum("quota").over(Window.partitionBy()).alias("slots"))


#: Slots of an output shard of the mix.
SHARD_SLOTS = 1024
#: Ranges of the draw are cut into about so many buckets, by which draws find theirs.
BUCKETS = 4096


def spread(df: DataFrame, *keys: str) -> DataFrame:
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def draws(sources: DataFrame, shard_slots: int = SHARD_SLOTS, seed: int = 0) -> DataFrame:
    """shard, rank, n: how many slots of each output shard every source fills.

    A share of b slots is b * quota / slots: its whole part is certain, and what is left of the shard is drawn, slot by
    slot, with the remainders as weights, all in integers. Shards have shard_slots slots, the last one what is left.
    """
    spark = sources.sparkSession
    slots = sources.agg(F.max("slots")).first()[0] or 0
    counts = spark.createDataFrame([], "shard bigint, rank bigint, n bigint")
    full, rest = divmod(slots, shard_slots)
    for first, shards, b in ((0, full, shard_slots), (full, int(rest > 0), rest)):
        if not shards:
            continue
        share = F.lit(b) * F.col("quota")
        parts = sources.where("quota > 0").select("rank", F.expr(f"{b}L * quota div slots").alias("base"), (share % F.col("slots")).alias("frac"))
        parts = parts.withColumn("hi", F.sum("frac").over(Window.orderBy("rank")))  # a row for each source
        whole = parts.agg(F.max("hi")).first()[0] or 0
        left = whole // slots
        # Runs of shards come first, so that no row holds a number for every shard.
        runs = parts.where("base > 0").select("rank", "base", F.explode(F.sequence(F.lit(first).cast("bigint"), F.lit(first + shards - 1).cast("bigint"), F.lit(8192).cast("bigint"))).alias("_lo"))
        certain = spread(runs, "rank", "_lo").select(F.explode(F.sequence("_lo", F.least(F.col("_lo") + 8191, F.lit(first + shards - 1)))).alias("shard"), "rank", F.col("base").alias("n"))
        counts = counts.unionByName(certain)
        if left:
            width = -(-whole // BUCKETS)
            ranges = parts.where("frac > 0").select("rank", "frac", "hi", F.explode(F.sequence(F.expr(f"(hi - frac) div {width}"), F.expr(f"(hi - 1) div {width}"))).alias("_b"))
            drawn = spark.range(shards * left).select((F.expr(f"id div {left}") + first).alias("shard"), (F.col("id") % left).alias("_r"))
            drawn = drawn.withColumn("_u", hash60(F.lit(seed), F.col("shard"), F.col("_r")) % whole).withColumn("_b", F.expr(f"_u div {width}"))
            counts = counts.unionByName(drawn.join(ranges, "_b").where("_u >= hi - frac and _u < hi").select("shard", "rank", F.lit(1).cast("bigint").alias("n")))
    return counts.groupBy("shard", "rank").agg(F.sum("n").alias("n"))


def deal(sources: DataFrame, most: int, shard_slots: int = SHARD_SLOTS, seed: int = 0) -> DataFrame:
    """shard, position, rank, epoch, block: a row for each output slot that is filled, from the draws of the shards.

    A source's k-th slot, counted over the shards in order, takes the block that the permutation of its epoch gives;
    slots beyond most times the source's blocks stay empty. Positions of a shard are a permutation of its slots.
    """
    counts = written(draws(sources, shard_slots, seed), "draws")
    shards = (counts.agg(F.max("shard")).first()[0] or 0) + 1
    keyed = counts.withColumn("_key", F.col("shard") * (2**60 // shards))
    placed = running_offset(keyed, ["rank"], "_key", ["shard"], F.col("n"), shards, "_lo")
    inside = Window.partitionBy("shard").orderBy("rank")  # a row for each source
    placed = placed.select("shard", "rank", "n", "_lo", (F.sum("n").over(inside) - F.col("n")).alias("_at"), F.sum("n").over(Window.partitionBy("shard")).alias("_slots"))
    # The windows leave the rows of all sources in a few tasks; slots are made in as many as there are shuffle partitions.
    each = spread(placed, "shard", "rank").select("shard", "rank", "_lo", "_at", "_slots", F.explode(F.sequence("_lo", F.col("_lo") + F.col("n") - 1)).alias("_k"))
    each = each.join(sources.select("rank", "blocks"), "rank").where(F.col("_k") < most * F.col("blocks"))
    epoch = F.expr("_k div blocks")
    position = permuted(F.col("_at") + F.col("_k") - F.col("_lo"), F.col("_slots"), salted(F.col("shard"), seed))
    return each.select("shard", position.alias("position"), "rank", epoch.alias("epoch"), permuted(F.expr("_k % blocks"), F.col("blocks"), salted(F.col("rank") * 16 + epoch + 1, seed)).alias("block"))


def salted(x: Column, seed: int) -> Column:
    return F.pmod(x + seed % 2**31 * 1_000_003, F.lit(2**31 - 1))


def plan(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, block: int = 128, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: list[str] | None = None, seed: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sources, placed, slots) of the mix.

    sources: targets(). slots: deal(). placed: a row for each document with id, size, start, rank and spans, of each
    block that holds words of it a struct of block, from_word and n_words, and _kept, a struct of the columns named in
    keep; a document without words has one span with n_words 0 and block null. Documents lie in their source's tokens in the order of the hash of their id, then id and
    size. Null texts have no words; null sources are a source of their own; repeated rows are documents of their own.
    """
    kept = keep or []
    sized = written(docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("source"), words(text_col).alias("size")), "sized")
    sources = written(targets(sized, weights, most, block).coalesce(1), "sources")
    ranks = sources.select(F.col("source").alias("_source"), "rank")
    ranked = docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("_s"), words(text_col).alias("size"), F.struct(*kept).alias("_kept")) if kept else sized.withColumnRenamed("source", "_s")
    key = hash60(F.col("_id"))
    ranked = ranked.join(ranks, F.col("_s").eqNullSafe(F.col("_source"))).drop("_s", "_source").withColumn("_key", key)
    small = sized.join(ranks, F.col("source").eqNullSafe(F.col("_source"))).select("rank", "size", key.alias("_key"))
    ties = [F.xxhash64("_kept").alias("_tie")] if kept else []
    ranked = ranked.select("*", *ties)
    placed = running_offset(ranked, ["rank"], "_key", ["_id", "size", *["_tie"] * bool(ties)], F.col("size"), sized.count(), "start", small)
    lo, hi = F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}")
    begin = lambda b: F.greatest(b * block - F.col("start"), F.lit(0))
    end = lambda b: F.least((b + 1) * block - F.col("start"), F.col("size"))
    spans = F.transform(F.sequence(lo, hi), lambda b: F.struct(b.alias("block"), begin(b).alias("from_word"), (end(b) - begin(b)).alias("n_words")))
    none = F.array(F.struct(F.lit(None).cast("bigint").alias("block"), F.lit(0).cast("bigint").alias("from_word"), F.lit(0).cast("bigint").alias("n_words")))
    placed = placed.select(F.col("_id").alias("id"), "size", "start", "rank", F.when(F.col("size") > 0, spans).otherwise(none).alias("spans"), *["_kept"] * bool(kept))
    return sources, placed, deal(sources, most, seed=seed)


def mix_counts(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, block: int = 128, id_col: str = "doc_id", seed: int = 0) -> DataFrame:
    """How many words of every document the mix takes: id, size, source_size, target and taken, the words of all slots drawn.

    The result has a row for each row of docs, empty and null texts with size and taken 0; docs without rows give no
    rows. No document is taken more than most times. Columns of docs besides id, text and source play no part.
    """
    sources, placed, slots = plan(docs, weights, most, block, id_col, seed=seed)
    # Slots grow with the corpus, though they come from the small table of sources: never to be broadcast.
    times = slots.groupBy("rank", "block").agg(F.count("*").alias("times")).hint("merge")
    seg = placed.select("id", "size", "start", "rank", F.explode("spans").alias("span")).select("id", "size", "start", "rank", "span.*")
    used = seg.join(times, ["rank", "block"], "left")
    by_doc = used.groupBy("id", "rank", "start", "size").agg(F.count("*").alias("_n"), F.sum(F.col("n_words") * F.coalesce("times", F.lit(0))).alias("taken"))
    # Rows without words of one id share a start: they are counted above and come out again here.
    by_doc = by_doc.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.when(F.col("size") == 0, F.col("_n")).otherwise(F.lit(1)))))
    return by_doc.join(sources.select("rank", "source_size", "target"), "rank").select(F.col("id").alias(id_col), "size", "source_size", "target", F.col("taken").cast("bigint").alias("taken"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, block: int = 2048, id_col: str = "doc_id", seed: int = 0, slots: bool = False) -> DataFrame:
    """The mixed corpus: a row for each slot and each document piece in the slot's block, with the columns of docs.

    With slots also mix_shard and mix_position, where the slot lies; a column of docs with one of these names gives way.

    text is the piece (words with the white space before them), n_chars its length. A document that fills part of a
    block is a single piece. Documents without words do not enter a mix of words. A text is cut once, where it is read.
    """
    _, placed, filled = plan(docs, weights, most, block, id_col, keep=docs.columns, seed=seed)
    text = F.col("_kept.text")
    parts = F.regexp_extract_all(text, F.lit(f"[{SPACE}]*{WORD}[{SPACE}]*$|[{SPACE}]*{WORD}"), F.lit(0))
    piece = lambda p, s: F.coalesce(F.array_join(F.slice(p, (s["from_word"] + 1).cast("int"), s["n_words"].cast("int")), ""), text)
    # The parts are the argument of a function, so that they are cut once for all spans.
    spans = F.transform(F.array(F.when(F.size("spans") > 1, parts)), lambda p: F.transform("spans", lambda s: F.struct(s["block"].alias("block"), piece(p, s).alias("piece"))))[0]
    rest = F.struct(*[F.col(f"_kept.`{c}`").alias(c) for c in docs.columns if c != "text"])
    pieces = placed.where("size > 0").select("rank", rest.alias("_rest"), F.explode(spans).alias("_span")).select("rank", "_rest", F.col("_span.block").alias("block"), F.col("_span.piece").alias("_piece"))
    where = ["shard", "position"] if slots else []
    mixed = pieces.join(filled.select("rank", "block", *where).hint("merge"), ["rank", "block"])
    made = {"text": F.col("_piece")}
    if "n_chars" in docs.columns:
        made["n_chars"] = F.length("_piece").cast(docs.schema["n_chars"].dataType)
    own = [c for c in docs.columns if not (slots and c in ("mix_shard", "mix_position"))]
    return mixed.select(*[made[c] if c in made else F.col("_rest")[c] for c in own], *where).toDF(*own, *[f"mix_{c}" for c in where])
