"""Hierarchical weighted hash tree: documents descend region, rack and shard by weighted hash draws.

At each inner node every child draws -ln(u) / weight, u being a hash of the document key and the child's name, and the
least draw wins. A child is therefore chosen in proportion to its weight, and raising one child's weight only moves
documents into that child. Documents move only inside or into subtrees whose weights changed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamgrid.llm.common import hash60, running_offset


@dataclass(frozen=True)
class Node:
    """A region, rack (children) or shard (number) of the tree."""

    name: str
    own_weight: float = 1.0
    children: tuple["Node", ...] = ()
    shard: int = -1

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.own_weight


def tree(shards: int, shards_per_rack: int = 4, racks_per_region: int = 3, planned: int = 24) -> Node:
    """shards equal shards. The planned ones fill racks and regions; each further one is a region of its own, so that
    it takes documents into itself and moves no others."""
    regions: dict[int, dict[int, list[Node]]] = {}
    full = -(-planned // shards_per_rack)
    for s in range(shards):
        rack = s // shards_per_rack if s < planned else full + s - planned
        region = rack // racks_per_region if s < planned else -(-full // racks_per_region) + s - planned
        regions.setdefault(region, {}).setdefault(rack, []).append(Node(f"s{s}", shard=s))
    return Node("root", children=tuple(Node(f"g{g}", children=tuple(Node(f"r{r}", children=tuple(leaves)) for r, leaves in racks.items())) for g, racks in regions.items()))


def only_grown(now: Node, grown: Node) -> bool:
    """Whether grown is now with further regions: documents then move into these only."""
    return now.children == grown.children[: len(now.children)]


def levels(root: Node) -> list[list[list[tuple[str, float, int]]]]:
    """For each level and each of its nodes: (name, weight, number on the next level) of the children with weight."""
    out, row = [], [root]
    while row[0].children:
        if any(not n.children for n in row):
            raise ValueError("all shards must lie equally deep")
        below = [c for n in row for c in n.children if c.weight > 0]
        at = {id(c): i for i, c in enumerate(below)}
        out.append([[(c.name, float(c.weight), at[id(c)]) for c in n.children if c.weight > 0] for n in row])
        row = below
    return [*out, [[("", 1.0, n.shard)] for n in row]]


def descend(key: Column, root: Node) -> Column:
    """The shard that key reaches from the root, as an INT Column: at each level the child with the least draw."""
    at = F.lit(0)
    *inner, shards = levels(root)
    for level in inner:
        children = F.array(*[F.array(*[F.struct(F.lit(n).alias("name"), F.lit(w).alias("weight"), F.lit(i).alias("i")) for n, w, i in node]) for node in level])
        drawn = F.transform(F.element_at(children, at + 1), lambda c: F.struct(-F.log((hash60(key, c["name"]) + 0.5) / float(2**60)) / c["weight"], c["i"].alias("i")))
        at = F.array_min(drawn)["i"]
    return F.element_at(F.array(*[F.lit(n[0][2]) for n in shards]), at + 1)


def shard(docs: DataFrame, now: Node, grown: Node | None = None, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """Puts every row into a shard of the tree, with a gapless slot inside it.

    Returns id, size (UTF-8 bytes of the text plus 8; null text: 8), text_crc32 (null text: null), law ('key'), shard,
    slot and grown_shard (of the grown tree, which may only have further regions, or law 'key' would not hold and a
    ValueError is raised; null without one). keep=True adds all of docs' columns instead of the id
    alone; a column of docs named like one of the results gives way to the result. The id alone decides the shard:
    rows with a null id share one shard. Repeated rows all stay, with slots of their own; their order among
    themselves is that of their checksums. An empty table gives an empty result. Slots follow the hash of the id, then
    the id, size and checksum.
    """
    if grown and not only_grown(now, grown):
        raise ValueError("the grown tree must be the tree with further regions")
    key = F.col(id_col)
    base = docs.select(
        F.struct(*(docs.columns if keep else [id_col])).alias("row"), key.alias("id"),
        (F.coalesce(F.octet_length(text_col), F.lit(0)).cast("bigint") + 8).alias("size"),
        F.crc32(F.encode(F.col(text_col), "UTF-8")).alias("text_crc32"), F.lit("key").alias("law"), descend(key, now).alias("shard"),
        (descend(key, grown) if grown else F.lit(None).cast("int")).alias("grown_shard"), hash60(key).alias("_key"),
    )
    counted = docs.select(descend(key, now).alias("shard"), hash60(key).alias("_key"))
    placed = running_offset(base, ["shard"], "_key", ["id", "size", "text_crc32"], F.lit(1), docs.count(), "slot", counted)
    first = [c for c in docs.columns if c not in RESULTS] if keep else [id_col]
    return placed.select(*[F.col("row")[c].alias(c) for c in first], *RESULTS)


RESULTS = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
