"""The driver's queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgrid.llm import decontaminate, html_text, language, lexical, lm_score, minhash, mixing, secrets, sharding, topk, toxicity, url_filter, whitening
from loamgrid.llm.common import table

#: The shard queries' tree: 24 shards, and with one more.
SHARDS = 24

#: The URL rules of the query.
URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), size=3, hundredths=85).drop("component")


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), sharding.tree(SHARDS), sharding.tree(SHARDS + 1))


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").where("quality = 1")
    losses = lm_score.score(table(spark, sf_dir, "documents"), good)
    return losses.select("doc_id", "n_words", *[F.round(c, 6).alias(c) for c in ("target_loss", "background_loss", "score")])


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_counts(table(spark, sf_dir, "documents"))


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(table(spark, sf_dir, "documents"))


def _sql_levels(levels: list, name: str) -> str:
    rows = ", ".join(f"({d}, {at}, '{n}', {w}, {i})" for d, level in enumerate(levels[:-1]) for at, node in enumerate(level) for n, w, i in node)
    return f"{name} AS (SELECT * FROM (VALUES {rows}) t(depth, parent, name, weight, child))"


def _sql_descent(shards: int, tag: str) -> str:
    """CTEs that end in {tag}3: doc_id and the shard of the tree over so many shards."""
    levels = sharding.levels(sharding.tree(shards))
    ctes = [_sql_levels(levels, f"{tag}_tree"), f"{tag}0 AS (SELECT DISTINCT doc_id, coalesce(doc_id::VARCHAR, '') AS k, 0 AS node FROM documents)"]
    for d in range(3):
        ctes.append(f"""{tag}{d + 1} AS (SELECT doc_id, k, arg_min(child, {{'draw': -ln((('0x' || substr(md5(k || '/' || name), 1, 15))::BIGINT + 0.5) / 1152921504606846976.0) / weight, 'i': child}}) AS node
            FROM {tag}{d} JOIN {tag}_tree ON depth = {d} AND parent = node GROUP BY doc_id, k)""")
    return ", ".join(ctes)


OP2_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

OP4_SQL = f"""
WITH {_sql_descent(SHARDS, "now")}, {_sql_descent(SHARDS + 1, "grown")},
tbl AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i))),
hexed AS (SELECT doc_id, text, hex(encode(text)) AS h, coalesce(octet_length(encode(text)), 0) AS n FROM documents),
bytes AS (SELECT doc_id, n, list_transform(range(n), lambda i: ('0x' || substr(h, (2 * i + 1)::INT, 2))::BIGINT) AS b, text IS NULL AS gone FROM hexed),
sized AS (SELECT doc_id, n + 8 AS size, CASE WHEN gone THEN NULL ELSE xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8)), 4294967295) END AS text_crc32 FROM bytes, tbl)
SELECT s.doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'key' AS law, n.node::INT AS shard,
  (row_number() OVER (PARTITION BY n.node ORDER BY ('0x' || substr(md5(n.k), 1, 15))::BIGINT, s.doc_id, size, text_crc32) - 1)::BIGINT AS slot, g.node::INT AS grown_shard
FROM sized s JOIN now3 n ON s.doc_id IS NOT DISTINCT FROM n.doc_id JOIN grown3 g ON s.doc_id IS NOT DISTINCT FROM g.doc_id
"""


OP6_SQL = """
WITH t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w, doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL) AS tgt FROM documents),
tok AS (SELECT doc_id, tgt, len(w) AS n, w[i] AS v, CASE WHEN i < len(w) THEN w[i + 1] ELSE ' ' END AS x FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM t)),
tot AS (SELECT *, CASE WHEN least(n1, n2) = 0 THEN 0 ELSE least(n1, n2) / n1::DOUBLE END AS r1, CASE WHEN least(n1, n2) = 0 THEN 0 ELSE least(n1, n2) / n2::DOUBLE END AS r2 FROM (SELECT count(*) FILTER (tgt) AS n1, count(*) FILTER (NOT tgt) AS n2, count(DISTINCT v)::DOUBLE AS size FROM tok)),
own AS (SELECT doc_id, tgt, n, v, x, count(*) AS ow FROM tok GROUP BY ALL), ownv AS (SELECT *, sum(ow) OVER (PARTITION BY doc_id, v) AS ov FROM own),
every AS (SELECT *, coalesce(sum(ow) FILTER (tgt) OVER (PARTITION BY v), 0) AS v1, coalesce(sum(ow) FILTER (NOT tgt) OVER (PARTITION BY v), 0) AS v2, coalesce(sum(ow) FILTER (tgt) OVER (PARTITION BY v, x), 0) AS p1, coalesce(sum(ow) FILTER (NOT tgt) OVER (PARTITION BY v, x), 0) AS p2 FROM ownv),
bits AS (SELECT doc_id, n, ow,
  log2(r1 * (n1 - CASE WHEN tgt THEN n ELSE 0 END) + size) - log2(r1 * (v1 - CASE WHEN tgt THEN ov ELSE 0 END) + 1) + log2(r1 * (v1 - CASE WHEN tgt THEN ov ELSE 0 END) + 50) - log2(r1 * (p1 - CASE WHEN tgt THEN ow ELSE 0 END) + 50 / (size + 1)) AS b1,
  log2(r2 * (n2 - CASE WHEN tgt THEN 0 ELSE n END) + size) - log2(r2 * (v2 - CASE WHEN tgt THEN 0 ELSE ov END) + 1) + log2(r2 * (v2 - CASE WHEN tgt THEN 0 ELSE ov END) + 50) - log2(r2 * (p2 - CASE WHEN tgt THEN 0 ELSE ow END) + 50 / (size + 1)) AS b2 FROM every, tot),
s AS (SELECT doc_id, sum(ow * b1) / any_value(n) / 2 AS t, sum(ow * b2) / any_value(n) / 2 AS b FROM bits GROUP BY doc_id)
SELECT t.doc_id, len(w)::BIGINT AS n_words, round(s.t, 6) AS target_loss, round(s.b, 6) AS background_loss, round(s.t - s.b, 6) AS score FROM t LEFT JOIN s USING (doc_id)
"""


def _sql_permuted(x: str, n: str, salt: str, inverse: bool = False) -> str:
    p = mixing.P
    rounds = f"list_reverse(range({mixing.ROUNDS}))" if inverse else f"range({mixing.ROUNDS})"
    mod = lambda a, m: f"(((({a}) % ({m})) + ({m})) % ({m}))"
    pick = mod(f"((({salt}) * 64 + r) * 48271 + 11) % {p} * 69621 % {p} * 16807 + r", n)
    return f"""list_reduce(list_prepend(({x})::BIGINT, {rounds}), lambda y, r: CASE WHEN
        ((greatest(y, {mod(f"{pick} - y", n)}) % {p}) * (((({salt}) + 7) * 40692 + r * 7919) % {p - 1} + 1) + (({salt}) + 1) * (r + 3) * 3791) % {p} % 2 = 1
        THEN {mod(f"{pick} - y", n)} ELSE y END)"""


OP10_SQL = f"""
WITH sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
tot AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1 AS rank FROM tot),
w AS (SELECT *, (rank % 3 + 1)::DOUBLE AS w, sum(source_size) OVER ()::BIGINT AS total FROM ranked),
lev AS (SELECT *, (total - coalesce(sum(3 * source_size) OVER (ORDER BY source_size / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
  / sum(w) OVER (ORDER BY source_size / w, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
tgt AS (SELECT source, rank, source_size, CASE WHEN 3 * source_size <= level * w THEN 3.0 * source_size
  ELSE (arg_min(level, {{'r': source_size / w, 'k': rank}}) FILTER (3 * source_size > level * w) OVER ()) * w END::DOUBLE AS target FROM lev),
quota AS (SELECT *, ((source_size + 127) // 128)::BIGINT AS blocks FROM tgt),
quota2 AS (SELECT *, CASE WHEN source_size > 0 THEN least(round(target * blocks / source_size)::BIGINT, 3 * blocks) ELSE 0 END AS quota FROM quota),
cut AS (SELECT *, sum(quota) OVER ()::BIGINT AS slots FROM quota2),
shards AS (SELECT shard, slots, least({mixing.SHARD_SLOTS}, slots - shard * {mixing.SHARD_SLOTS}) AS b FROM (SELECT slots, unnest(range((slots + {mixing.SHARD_SLOTS - 1}) // {mixing.SHARD_SLOTS})) AS shard FROM (SELECT max(slots) AS slots FROM cut))),
share AS (SELECT shard, rank, blocks, c.slots, b * quota // c.slots AS base, b * quota % c.slots AS frac FROM shards s, cut c WHERE quota > 0),
edge AS (SELECT *, sum(frac) OVER (PARTITION BY shard ORDER BY rank)::BIGINT AS hi, sum(frac) OVER (PARTITION BY shard)::BIGINT AS whole FROM share),
draw AS (SELECT shard, ('0x' || substr(md5('0/' || shard || '/' || r), 1, 15))::BIGINT % whole AS u FROM (SELECT *, unnest(range(whole // slots)) AS r FROM (SELECT DISTINCT shard, whole, slots FROM edge WHERE whole > 0))),
drawn AS (SELECT e.shard, e.rank, count(*) AS more FROM draw d JOIN edge e ON d.shard = e.shard AND u >= hi - frac AND u < hi GROUP BY ALL),
counts AS (SELECT e.shard, e.rank, blocks, (base + coalesce(more, 0))::BIGINT AS n FROM edge e LEFT JOIN drawn d ON e.shard = d.shard AND e.rank = d.rank),
k AS (SELECT rank, blocks, unnest(range(lo, lo + n)) AS k FROM (SELECT *, (sum(n) OVER (PARTITION BY rank ORDER BY shard ROWS UNBOUNDED PRECEDING) - n)::BIGINT AS lo FROM counts)),
taken_blocks AS (SELECT rank, {_sql_permuted("k % blocks", "blocks", "rank * 16 + k // blocks + 1")} AS block, count(*) AS times FROM k WHERE k < 3 * blocks GROUP BY ALL),
placed AS (SELECT s.doc_id, s.size, c.rank, c.source_size, c.target, (coalesce(sum(size) OVER (PARTITION BY c.rank ORDER BY ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT, doc_id, size
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS start, row_number() OVER () AS n FROM sized s JOIN cut c ON s.source IS NOT DISTINCT FROM c.source),
seg AS (SELECT n, rank, b AS block, least((b + 1) * 128, start + size) - greatest(b * 128, start) AS words FROM (SELECT *, unnest(range(start // 128, (start + size - 1) // 128 + 1)) AS b FROM placed WHERE size > 0)),
got AS (SELECT n, sum(words * times) AS taken FROM seg JOIN taken_blocks USING (rank, block) GROUP BY n)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM placed LEFT JOIN got USING (n)
"""


_SQL_TERMS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"

OP11_SQL = f"""
WITH d AS (SELECT r, doc_id, w, len(w)::BIGINT AS n FROM (SELECT row_number() OVER () AS r, doc_id, {_SQL_TERMS} AS w FROM documents) WHERE len(w) > 0),
st AS (SELECT count(*)::BIGINT AS nn, sum(n)::BIGINT AS l FROM d),
tf AS (SELECT r, doc_id, n, t, count(*)::BIGINT AS tf FROM (SELECT r, doc_id, n, unnest(w) AS t FROM d) GROUP BY ALL),
df AS (SELECT t, count(*)::BIGINT AS df FROM tf GROUP BY t),
q AS (SELECT i, item_id, t, count(*)::BIGINT AS c FROM (SELECT row_number() OVER () AS i, item_id, unnest({_SQL_TERMS}) AS t FROM benchmark) GROUP BY ALL),
s AS (SELECT i, item_id, r, doc_id, sum(c * floor(1000 * ln((2 * nn + 2) / (2 * df + 1)))::BIGINT * (1000000000 * tf // (1000 * tf + 12 * (75 + 25 * n * nn // l))))::BIGINT AS score
  FROM q JOIN df USING (t) JOIN tf USING (t), st GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 20
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontamination": op1_decontamination, "op2_top_k": op2_top_k, "op3_html_text": op3_html_text, "op4_sharding": op4_sharding, "op5_minhash": op5_minhash,
        "op6_lm_score": op6_lm_score, "op7_toxicity": op7_toxicity, "op8_language": op8_language, "op9_url_filter": op9_url_filter, "op10_mixing": op10_mixing,
        "op11_lexical": op11_lexical, "op12_whitening": op12_whitening, "op13_secrets": op13_secrets,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_top_k": OP2_SQL, "op4_sharding": OP4_SQL, "op6_lm_score": OP6_SQL, "op10_mixing": OP10_SQL, "op11_lexical": OP11_SQL}
