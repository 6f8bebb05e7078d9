"""Merkle manifest of a dataset by slot pivots: per row its leaf, the roots above it, and the siblings that prove it.

Leaves of one source ascend by id and form a tree of FANOUT children per node; the sources' roots, ordered by source, form a
tree of their own. A level is one aggregation: conditional aggregates spread the children of each parent into FANOUT slot
columns, whose concatenation is hashed. The same columns without a child's own slot are its siblings, so proofs need no join of
children: from the top down each parent row meets its own proof once and is exploded into its children.

Levels shrink by FANOUT, so all of them together cost half as much again as the lowest one. Leaves are ranked within their source
without a window over a source: rows are dealt by ranges of (source, id, leaf), numbered within their partition, and shifted by
the rows of earlier partitions, of which there are as many as partitions. So one source may hold most rows. Every level is a
table in the shared folder; nothing but the size of the largest source reaches the driver.

Odd rows: a null value of a leaf column is a `-`; null ids and null sources come first, null sources being a source of their own;
rows with equal ids are ordered by leaf, and repeated rows are neighbours with equal leaves and a proof each; the text may be
empty or of any length; an empty table gives an empty manifest; further columns do not enter the leaf, so names may clash.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from marketframe.llm.registry import query, table
from marketframe.llm.storage import Shelf

FANOUT = 3
#: what a leaf covers, in this order
COVERED = ("doc_id", "source", "lang", "n_chars", "text")


def encoded(value: Column) -> Column:
    """Length in bytes, colon and value, so that no two rows give the same input; a dash for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: dict[str, Column] | None = None, covered: tuple[str, ...] = COVERED) -> Column:
    """Digest of a row; values replace columns."""
    values = values or {}
    return F.sha2(F.concat(*[encoded(values.get(c, F.col(c))) for c in covered]), 256)


def ranked(rows: DataFrame, group: str, order: list[str], shelf: Shelf, name: str) -> DataFrame:
    """rows with idx, the rank from 0 within the group (ties in any order), and n, the size of the group."""
    dealt = shelf.put(rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order).withColumn("seq", F.monotonically_increasing_id())
                      .withColumn("part", F.shiftright("seq", 33)), f"{name}-dealt")
    # a row per group and partition
    counts = dealt.groupBy("part", F.col(group).alias("own")).agg(F.min("seq").alias("low"), F.count("*").alias("m"))
    starts = counts.selectExpr("part as at", "own", "low", "sum(m) over (partition by own order by part) - m as before", "sum(m) over (partition by own) as n")
    out = (dealt.join(starts, (dealt["part"] == starts["at"]) & dealt[group].eqNullSafe(starts["own"]))
           .withColumn("idx", F.col("before") + F.col("seq") - F.col("low")).drop("seq", "part", "at", "own", "low", "before"))
    out = shelf.put(out, f"{name}-ranked")
    shelf.drop(dealt)
    return out


def _levels(nodes: DataFrame, group: str, fanout: int, shelf: Shelf, name: str) -> list[DataFrame]:
    """Slot pivots from the lowest level up: group, idx, n (parents in the group), slots c0.. (structs with h), h."""
    out, level = [], nodes
    most = nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        slot = F.pmod(F.col("idx"), F.lit(fanout))
        child = F.struct(*[c for c in level.columns if c not in (group, "idx", "n")])
        spread = level.where("n > 1").groupBy(group, F.expr(f"idx div {fanout}").alias("idx")).agg(
            F.max(F.ceil(F.col("n") / fanout)).cast("long").alias("n"), *[F.max(F.when(slot == k, child)).alias(f"c{k}") for k in range(fanout)])
        hashed = F.sha2(F.concat(*[F.coalesce(f"c{k}.h", F.lit("")) for k in range(fanout)]), 256)
        out.append(shelf.put(spread.withColumn("h", hashed), f"{name}-{len(out)}"))
        level, most = out[-1].select(group, "idx", "n", "h"), -(-most // fanout)
    return out


def _children(parents: DataFrame, fanout: int) -> Column:
    """The children of a parent row with their positions and proofs: siblings first, then the parent's own proof."""
    def siblings(ks) -> Column:
        return F.concat(F.lit(""), *[F.coalesce(f"c{k}.h", F.lit("")) for k in ks])
    rows = [F.when(F.col(f"c{k}").isNotNull(), F.struct(
        (F.col("idx") * fanout + k).alias("idx"), F.col(f"c{k}").alias("child"),
        F.concat(F.array(F.struct(siblings(range(k)).alias("before"), siblings(range(k + 1, fanout)).alias("after"))), F.col("path")).alias("path")))
        for k in range(fanout)]
    return F.filter(F.array(*rows), lambda x: x.isNotNull())


def _descend(leaves: DataFrame, levels: list[DataFrame], tops: DataFrame, group: str, fanout: int) -> DataFrame:
    """leaves' payload with the columns of tops and the path of each leaf. tops: group, depth, path and what every leaf shall carry."""
    carried = [c for c in tops.columns if c not in (group, "depth", "path")]
    own = tops.select(F.col(group).alias("own"), "depth", "path", *carried)
    now = None
    for depth in range(len(levels), 0, -1):
        start = own.where(F.col("depth") == depth).select("own", F.lit(0).cast("long").alias("at"), "path", *carried)
        now = start if now is None else now.union(start)
        parents = levels[depth - 1]
        met = parents.join(now, parents[group].eqNullSafe(now["own"]) & (parents["idx"] == now["at"]))
        spread = met.select("own", *carried, F.explode(_children(met, fanout)).alias("x"))
        if depth > 1:
            now = spread.select("own", F.col("x.idx").alias("at"), F.col("x.path").alias("path"), *carried)
    lone = leaves.where("n = 1")
    payload = [c for c in leaves.columns if c not in (group, "idx", "n")]
    met = lone.join(own.where("depth = 0"), lone[group].eqNullSafe(F.col("own"))).select(*payload, F.col("own").alias(group), *carried, "path")
    if not levels:
        return met
    return spread.select(*[F.col(f"x.child.{c}").alias(c) for c in payload], F.col("own").alias(group), *carried, F.col("x.path").alias("path")).union(met)


def _roots(leaves: DataFrame, levels: list[DataFrame], group: str) -> DataFrame:
    """group, h, depth of the single top node of every group."""
    out = leaves.where("n = 1").select(group, "h", F.lit(0).alias("depth"))
    for i, level in enumerate(levels):
        out = out.union(level.where("n = 1").select(group, "h", F.lit(i + 1)))
    return out


def manifest(docs: DataFrame, fanout: int = FANOUT, carry: dict[str, Column] | None = None) -> DataFrame:
    """Per row: doc_id, source, h (its leaf), carried columns, subroot, root, and path, the siblings before and after it at every level up to the root."""
    if fanout < 2:
        raise ValueError(f"a fanout of {fanout} never ends")
    shelf = Shelf(docs.sparkSession, "merkle")
    carry = carry or {}
    rows = docs.select(leaf().alias("h"), "doc_id", F.col("source").cast("string").alias("source"), *[c.alias(k) for k, c in carry.items()])
    rows = shelf.put(rows, "leaves")            # texts are read and hashed once, before ranges are sampled
    leaves = ranked(rows, "source", ["doc_id", "h"], shelf, "sources")
    shelf.drop(rows)
    levels = _levels(leaves, "source", fanout, shelf, "source")
    subroots = shelf.put(_roots(leaves, levels, "source").select("source", "h", F.col("depth").alias("reach"), F.lit(0).alias("all")), "subroots")
    tops = ranked(subroots, "all", ["source"], shelf, "all")
    above = _levels(tops, "all", fanout, shelf, "root")
    root = _roots(tops, above, "all").select("all", F.col("h").alias("root"), F.col("depth").alias("height"))
    root = root.select("all", "root", F.col("height").alias("depth"), F.array().cast("array<struct<before:string,after:string>>").alias("path"))
    named = _descend(tops, above, root, "all", fanout)
    named = named.select("source", F.col("h").alias("subroot"), "root", F.col("reach").alias("depth"), "path")
    return _descend(leaves, levels, shelf.put(named, "tops"), "source", fanout)


def fold(start: Column, path: Column) -> Column:
    """The root that follows from a leaf and its siblings."""
    return F.aggregate(path, start, lambda h, s: F.sha2(F.concat(s["before"], h, s["after"]), 256))


def proof_digest(path: Column) -> Column:
    """One digest of all siblings, level by level."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def verified(proved: DataFrame, changed: str) -> DataFrame:
    """proved (a manifest) with folded_root, recomputed from the column changed where it is not null, and whether it equals the root."""
    out = proved.withColumn("folded_root", fold(F.coalesce(changed, "h"), F.col("path")))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


SQL = """
WITH RECURSIVE enc AS (SELECT doc_id, source,
  coalesce(octet_length(encode(CAST(doc_id AS VARCHAR))) || ':' || CAST(doc_id AS VARCHAR), '-') || coalesce(octet_length(encode(source)) || ':' || source, '-')
  || coalesce(octet_length(encode(lang)) || ':' || lang, '-') || coalesce(octet_length(encode(CAST(n_chars AS VARCHAR))) || ':' || CAST(n_chars AS VARCHAR), '-') AS front,
  coalesce(octet_length(encode(text)) || ':' || text, '-') AS body, replace(text, chr(10), '') AS flat,
  list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ascii(x)::UBIGINT)),
    lambda c, b: list_reduce([xor(c, b), 1, 1, 1, 1, 1, 1, 1, 1]::UBIGINT[], lambda y, z: xor(y >> 1, (y & 1) * 3988292384::UBIGINT))) AS crc
  FROM documents),
leaves AS (SELECT doc_id, source, sha256(front || body) AS leaf,
  CASE WHEN xor(crc, 4294967295::UBIGINT) % 2 = 0 THEN sha256(front || coalesce(octet_length(encode(flat)) || ':' || flat, '-')) END AS changed FROM enc),
ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM leaves),
nodes AS (SELECT source, 0 AS lvl, idx, leaf AS h, count(*) OVER (PARTITION BY source) AS n FROM ranked
  UNION ALL
  SELECT source, min(lvl) + 1, idx // 3, sha256(string_agg(h, '' ORDER BY idx)), (min(n) + 2) // 3 FROM nodes WHERE n > 1 GROUP BY source, idx // 3),
tops AS (SELECT source, lvl AS depth, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS idx FROM nodes WHERE n = 1),
above AS (SELECT 0 AS lvl, idx, h, count(*) OVER () AS n FROM tops
  UNION ALL
  SELECT min(lvl) + 1, idx // 3, sha256(string_agg(h, '' ORDER BY idx)), (min(n) + 2) // 3 FROM above WHERE n > 1 GROUP BY idx // 3),
anc AS (SELECT r.doc_id, r.leaf, r.source, CAST(l.lvl AS BIGINT) AS lvl, r.idx // CAST(power(3, l.lvl) AS BIGINT) AS a
  FROM ranked r JOIN tops t ON r.source IS NOT DISTINCT FROM t.source, (SELECT unnest(range(40)) AS lvl) l WHERE l.lvl < t.depth),
low AS (SELECT anc.doc_id, anc.leaf, anc.lvl, coalesce(string_agg(h, '' ORDER BY idx) FILTER (idx < a), '') AS before, coalesce(string_agg(h, '' ORDER BY idx) FILTER (idx > a), '') AS after
  FROM anc JOIN nodes ON anc.source IS NOT DISTINCT FROM nodes.source AND anc.lvl = nodes.lvl AND anc.a // 3 = nodes.idx // 3 GROUP BY 1, 2, 3),
high AS (SELECT t.source, t.depth + m.lvl AS lvl, coalesce(string_agg(m.h, '' ORDER BY m.idx) FILTER (m.idx < t.idx // CAST(power(3, m.lvl) AS BIGINT)), '') AS before,
  coalesce(string_agg(m.h, '' ORDER BY m.idx) FILTER (m.idx > t.idx // CAST(power(3, m.lvl) AS BIGINT)), '') AS after
  FROM tops t JOIN above m ON t.idx // CAST(power(3, m.lvl) AS BIGINT) // 3 = m.idx // 3 WHERE m.n > 1 GROUP BY 1, 2),
path AS (SELECT doc_id, leaf, lvl, before, after FROM low
  UNION ALL SELECT r.doc_id, r.leaf, high.lvl, before, after FROM ranked r JOIN high ON r.source IS NOT DISTINCT FROM high.source),
folded AS (SELECT doc_id, leaf, 0 AS lvl, coalesce(changed, leaf) AS h FROM ranked
  UNION ALL SELECT f.doc_id, f.leaf, f.lvl + 1, sha256(before || h || after) FROM folded f JOIN path p ON f.doc_id = p.doc_id AND f.leaf = p.leaf AND f.lvl = p.lvl),
ends AS (SELECT doc_id, leaf, arg_max(h, lvl) AS folded_root FROM folded GROUP BY 1, 2),
proof AS (SELECT doc_id, leaf, string_agg(before || after, '' ORDER BY lvl) AS s FROM path GROUP BY 1, 2),
root AS (SELECT h AS root FROM above WHERE n = 1)
SELECT r.doc_id, r.leaf, t.h AS subroot, root, sha256(coalesce(s, '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM ranked r JOIN tops t ON r.source IS NOT DISTINCT FROM t.source JOIN ends e ON r.doc_id = e.doc_id AND r.leaf = e.leaf
LEFT JOIN proof p ON r.doc_id = p.doc_id AND r.leaf = p.leaf, root
"""


@query("op12_merkle_manifest", SQL)
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    changed = F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(2)) == 0, leaf({"text": F.regexp_replace("text", "\n", "")}))
    out = verified(manifest(docs, carry={"changed": changed}), "changed")
    return out.select("doc_id", F.col("h").alias("leaf"), "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", "verified")
