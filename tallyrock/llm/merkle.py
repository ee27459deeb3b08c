"""Merkle manifest of a dataset: a tree of SHA-256 over each group's rows, and one over the groups' roots.

A leaf is the digest of a row's fields. Nodes are joined ``FAN`` at a time; the last of a level may
join fewer, even one. Aligned blocks of ``BLOCK`` nodes keep a level as one string of
hex digits: substrings of ``FAN`` digests hash to the parents, what stands before and behind a
node in its substring are its sibling segments. Each block covers two levels; the blocks' tops
are the nodes of the next round, until a block holds all of its group. A row's path is put together
downwards, from its group's root to its own block, so that joins meet blocks, not rows.

Rows are ranked without a group in one task: they are dealt by ranges of (group, order), and
a row's place is its place in its range and the counts of the ranges before it.

Defined results: null fields have a mark of their own, so null and empty differ. Null groups
are a group, the first. Rows of equal order stand by their leaf; repeated rows each are a leaf. A
null order comes first. An empty table gives no rows. Texts are read whole; a very long one is one
leaf. Columns that are not named are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyrock.llm.text import lower_ascii, table
from tallyrock.sources.shared import cut

FAN = 16
#: Nodes of a block: two levels.
BLOCK = FAN * FAN
#: Digits of a digest, and of the digests that one node joins.
HEX, RUN = 64, 64 * FAN
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf(fields: list[Column]) -> Column:
    """Digest of a row: each field is a dash if null, else its UTF-8 bytes' count, a colon and itself."""
    texts = [f.cast("string") for f in fields]
    return digest(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def ranked(rows: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """``rows`` with ``pos``, from 0, by ``order`` within ``group``, and ``n``, the group's rows."""
    dealt = rows.repartitionByRange(F.col(group), *order).sortWithinPartitions(F.col(group), *order)
    dealt = cut(dealt.withColumn("_at", F.monotonically_increasing_id()), "merkle-ranked").withColumn("_range", F.shiftright("_at", 33))
    # a group has as many of these as ranges
    ranges = dealt.groupBy(group, "_range").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    whole = Window.partitionBy(group)
    before = F.coalesce(F.sum("_rows").over(whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.withColumns({"_before": before, "n": F.sum("_rows").over(whole)})
    out = dealt.join(ranges, [group, "_range"]).withColumn("pos", F.col("_at") - F.col("_first") + F.col("_before"))
    return out.select(*rows.columns, "pos", "n")


def parents(level: str) -> Column:
    """The next level of a block's level."""
    starts = F.sequence(F.lit(1), F.length(level), F.lit(RUN))
    return F.array_join(F.transform(starts, lambda i: F.sha2(F.substring(F.col(level), i, F.lit(RUN)), 256)), "")


def blocks(nodes: DataFrame, carried: list[str]) -> DataFrame:
    """(grp, n, block, members, lower, upper, top) of nodes (grp, pos, n, node, carried): the two levels of each block and its top."""
    members = F.sort_array(F.collect_list(F.struct("pos", "node", *carried)))
    made = nodes.groupBy("grp", "n", F.expr(f"pos div {BLOCK}").alias("block")).agg(members.alias("members"))
    made = made.withColumn("lower", F.array_join(F.transform("members", lambda m: m["node"]), "")).withColumn("upper", parents("lower")).withColumn("_over", parents("upper"))
    return made.withColumn("top", F.when(F.col("n") == 1, F.col("lower")).when(F.col("n") <= FAN, F.col("upper")).otherwise(F.col("_over"))).drop("_over")


def _flanks(run: Column, place: Column) -> Column:
    """Sibling segments of the node at ``place`` of a run."""
    return F.struct(F.substring(run, F.lit(1), place * HEX).alias("left"), F.substring(run, place * HEX + HEX + 1, F.lit(RUN)).alias("right"))


def paths(made: DataFrame, above: DataFrame | None, kept: list[str]) -> DataFrame:
    """(grp, kept, pos, node, carried, path): each node's sibling segments up to its group's root.

    ``above`` has (grp, pos, path) of the blocks' tops, where a group has more than one block.
    """
    if above is None:
        made = made.withColumn("_rest", F.lit(None).cast("array<struct<left:string,right:string>>"))
    else:
        made = made.join(above.select("grp", F.col("pos").alias("block"), F.col("path").alias("_rest")), ["grp", "block"], "left")

    def with_path(m: Column) -> Column:
        at = (m["pos"] % BLOCK).cast("int")
        group = F.floor(at / FAN).cast("int")
        first = _flanks(F.substring(F.col("lower"), group * RUN + 1, F.lit(RUN)), at % FAN)
        second = _flanks(F.col("upper"), group)
        own = F.when(F.col("n") > FAN, F.array(first, second)).when(F.col("n") > 1, F.array(first)).otherwise(F.array().cast("array<struct<left:string,right:string>>"))
        return F.struct(m.alias("m"), F.when(F.col("_rest").isNull(), own).otherwise(F.concat(own, F.col("_rest"))).alias("path"))

    return made.select("grp", *kept, F.explode(F.transform("members", with_path)).alias("_row")).select("grp", *kept, "_row.m.*", "_row.path")


def rounds(nodes: DataFrame, carried: list[str]) -> tuple[list[DataFrame], DataFrame]:
    """Blocks of each round, and (grp, root). There are as many rounds as the largest group's count has factors of ``BLOCK``."""
    out, roots = [], None
    while True:
        made = cut(blocks(nodes, [] if out else carried), "merkle-blocks")
        out.append(made)
        done = made.where(F.col("n") <= BLOCK).select("grp", F.col("top").alias("root"))
        roots = done if roots is None else roots.union(done)
        nodes = made.where(F.col("n") > BLOCK).select("grp", F.col("block").alias("pos"), F.expr(f"(n + {BLOCK - 1}) div {BLOCK}").alias("n"), F.col("top").alias("node"))
        if nodes.isEmpty():
            return out, roots


def _down(made: list[DataFrame], kept: list[str]) -> DataFrame:
    above = None
    for k, level in enumerate(reversed(made)):
        above = paths(level, above, kept if k == len(made) - 1 else [])
    return above


def manifest(leaves: DataFrame, group: str, order: str, carried: list[str]) -> DataFrame:
    """(order, carried, leaf, subroot, root, path) of ``leaves`` with a column leaf; ``path`` leads by way of subroot to root."""
    rows = leaves.select(F.col(group).alias("_group"), F.col(order).alias("_order"), F.col("leaf").alias("node"), *[F.col(c).alias(f"_with_{c}") for c in carried])
    rows = cut(rows.withColumn("_uid", F.monotonically_increasing_id()), "merkle-leaves")
    groups = cut(ranked(rows.select("_group").distinct().withColumn("_all", F.lit(0)), "_all", [F.col("_group").asc_nulls_first()]), "merkle-groups")
    numbered = rows.join(groups.select(F.col("_group").alias("_same"), F.col("pos").alias("grp")), F.col("_group").eqNullSafe(F.col("_same"))).drop("_group", "_same")
    placed = ranked(numbered, "grp", [F.col("_order").asc_nulls_first(), F.col("node"), F.col("_uid")])
    held = ["_order", *[f"_with_{c}" for c in carried]]
    made, subroots = rounds(placed, held)
    subroots = cut(subroots, "merkle-subroots")
    tops = subroots.join(groups.select(F.col("pos").alias("grp"), "n"), "grp").select(F.lit(0).alias("grp"), F.col("grp").alias("pos"), "n", F.col("root").alias("node"))
    upper, root = rounds(tops, [])
    over = _down(upper, []).join(root, "grp").select(F.col("pos").alias("grp"), F.col("node").alias("subroot"), "root", F.col("path").alias("_over"))
    found = _down([made[0].join(cut(over, "merkle-over"), "grp"), *made[1:]], ["subroot", "root", "_over"])
    return found.select(F.col("_order").alias(order), *[F.col(f"_with_{c}").alias(c) for c in carried], F.col("node").alias("leaf"), "subroot", "root", F.concat("path", "_over").alias("path"))


def proof_digest(path: Column) -> Column:
    """Digest of all siblings of a path."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def folded(path: Column, start: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, start, lambda h, s: digest(s["left"], h, s["right"]))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*FIELDS)
    fields = [F.col(c) for c in FIELDS]
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, leaf([*fields[:-1], lower_ascii(F.col("text"))]))
    leaves = docs.select("doc_id", "source", leaf(fields).alias("leaf"), tampered.alias("tampered"))
    out = manifest(leaves, "source", "doc_id", ["tampered"])
    out = out.withColumns({"proof_sha256": proof_digest(F.col("path")), "folded_root": folded(F.col("path"), F.coalesce("tampered", "leaf"))})
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


#: CRC-32 (polynomial 0xEDB88320) of a string of ASCII characters, for engines without it.
CRC_SQL = """
crc_table AS (SELECT list(x ORDER BY b) AS t FROM (
  SELECT b, list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS x FROM (SELECT unnest(range(256)) AS b))),
"""
CRC_OF = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({x}, ''), lambda c: ascii(c)::BIGINT)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295)"

_FIELD = "coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c=c) for c in FIELDS[:-1]) + " || " + _FIELD.format(c="{text}") + ")"
_LOW = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLES = {
    "op11_merkle_manifest": f"""
WITH RECURSIVE {CRC_SQL}
leaves AS (
  SELECT row_number() OVER () AS uid, doc_id, source, {_LEAF.format(text="text")} AS leaf,
    CASE WHEN {CRC_OF.format(x="doc_id::VARCHAR")} % 5 = 0 THEN {_LEAF.format(text=_LOW)} END AS tampered
  FROM documents, crc_table),
placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, uid) - 1 AS pos, dense_rank() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS grp FROM leaves),
nodes AS (
  SELECT grp, 0 AS lvl, pos, leaf AS node, count(*) OVER (PARTITION BY grp) AS n FROM placed
  UNION ALL
  SELECT grp, lvl + 1, pos // 16, sha256(string_agg(node, '' ORDER BY pos)), (n + 15) // 16 FROM nodes WHERE n > 1 GROUP BY grp, lvl, pos // 16, n),
upper AS (
  SELECT 0 AS lvl, grp AS pos, node, count(*) OVER () AS n FROM nodes WHERE n = 1
  UNION ALL
  SELECT lvl + 1, pos // 16, sha256(string_agg(node, '' ORDER BY pos)), (n + 15) // 16 FROM upper WHERE n > 1 GROUP BY lvl, pos // 16, n),
runs AS (SELECT grp, lvl, pos // 16 AS run, string_agg(node, '' ORDER BY pos) AS line FROM nodes WHERE n > 1 GROUP BY ALL),
upper_runs AS (SELECT lvl, pos // 16 AS run, string_agg(node, '' ORDER BY pos) AS line FROM upper WHERE n > 1 GROUP BY ALL),
steps AS (
  SELECT uid, lvl, substr(line, 1, place * 64) AS lefts, substr(line, place * 64 + 65) AS rights FROM (
    SELECT p.uid, r.lvl, r.line, (p.pos // (16 ** r.lvl)::BIGINT) % 16 AS place FROM placed p JOIN runs r ON r.grp = p.grp AND r.run = p.pos // (16 ** (r.lvl + 1))::BIGINT
    UNION ALL
    SELECT p.uid, 1000 + r.lvl, r.line, (p.grp // (16 ** r.lvl)::BIGINT) % 16 FROM placed p JOIN upper_runs r ON r.run = p.grp // (16 ** (r.lvl + 1))::BIGINT)),
numbered AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY lvl) AS k FROM steps),
folds AS (
  SELECT uid, 0::BIGINT AS k, coalesce(tampered, leaf) AS h FROM leaves
  UNION ALL
  SELECT f.uid, s.k, sha256(s.lefts || f.h || s.rights) FROM folds f JOIN numbered s ON s.uid = f.uid AND s.k = f.k + 1),
last AS (SELECT uid, max_by(h, k) AS folded_root FROM folds GROUP BY uid),
proofs AS (SELECT uid, string_agg(lefts || rights, '' ORDER BY lvl) AS line FROM steps GROUP BY uid)
SELECT p.doc_id, p.leaf, s.node AS subroot, r.node AS root, sha256(coalesce(q.line, '')) AS proof_sha256, l.folded_root, l.folded_root = r.node AS verified
FROM placed p JOIN nodes s ON s.grp = p.grp AND s.n = 1 JOIN last l USING (uid) LEFT JOIN proofs q USING (uid), (SELECT node FROM upper WHERE n = 1) r
"""
}
