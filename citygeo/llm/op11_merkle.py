"""Merkle manifest of a table by nested-struct rollup.

Leaves are ranked within their group over a range-partitioned table: a row's rank is its place in its partition and the rows of
its group in the partitions before, so no window holds a group. The rank is cut into digits of base ``fanout``, LEVELS of them to
a block. Rows are dealt by (group, block) once; then the digits are grouped away one after the other in that dealing, each run of
children becoming a list of structs within its parent, so that a block ends as one row with its whole tree. The roots of
blocks are ranked already (by block) and roll up the same way, until each group has one root; group roots roll up to the root.

Proofs go down: a tree's path from above is handed to its leaves by transforms and one explode, which also give the leaves
of an upper block their place as blocks below. There a block and its path meet in a grouping of their union, not in a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citygeo.llm.common import checkpoint, documents, ranked

FANOUT, LEVELS = 3, 6  # a block has FANOUT ** LEVELS leaves at most, of some 200 bytes
PATH = "array<struct<before:string,after:string>>"


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of strings after one another."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf_digest(*values: Column) -> Column:
    """Digest of values, each as its UTF-8 byte count, a colon and its text; a null is a dash."""
    texts = [v.cast("string") for v in values]
    return digest(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def proof_digest(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), "").cast("binary"), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its path make."""
    return F.aggregate(path, leaf, lambda at, s: digest(s["before"], at, s["after"]))


def _blocks(rows: DataFrame, fanout: int, levels: int) -> DataFrame:
    """grp, block, n (nodes of the group at the level of rows) and node (the block's tree) of rows (grp, rank, n, node with its hash)."""
    digits = [F.expr(f"cast(rank div {fanout**k} % {fanout} as int)").alias(f"d{k}") for k in range(levels)]
    rows = rows.select("grp", F.expr(f"rank div {fanout**levels}").alias("block"), "n", *digits, "node").repartition("grp", "block")
    for k in range(levels):
        above = [f"d{j}" for j in range(k + 1, levels)]
        runs = rows.groupBy("grp", "block", "n", *above).agg(F.array_sort(F.collect_list(F.struct(f"d{k}", "node"))).alias("run"))
        nodes = F.transform("run", lambda c: c["node"])
        hashes = F.transform("run", lambda c: c["node"]["hash"])
        grows = F.col("n") > fanout**k
        own = F.when(grows, F.sha2(F.array_join(hashes, "").cast("binary"), 256)).otherwise(F.element_at(hashes, 1))
        rows = runs.select("grp", "block", "n", *above, F.struct(own.alias("hash"), grows.alias("grows"), nodes.alias("run")).alias("node"))
    return rows


def _handed_down(blocks: DataFrame, fanout: int, levels: int, *carry: str) -> DataFrame:
    """blocks (node, path, columns to carry) as a row for each leaf of node: leaf, path and these columns."""
    at = F.array(F.struct("node", "path"))
    for _ in range(levels):

        def children(x: Column) -> Column:
            hashes = F.transform(x["node"]["run"], lambda c: c["hash"])

            def child(c: Column, i: Column) -> Column:
                step = F.struct(F.array_join(F.slice(hashes, 1, i), "").alias("before"), F.array_join(F.slice(hashes, i + 2, fanout), "").alias("after"))
                return F.struct(c.alias("node"), F.when(x["node"]["grows"], F.concat(F.array(step), x["path"])).otherwise(x["path"]).alias("path"))

            return F.transform(x["node"]["run"], child)

        at = F.flatten(F.transform(at, children))
    return blocks.select(*carry, F.explode(at).alias("leaf")).select(*carry, F.col("leaf.node").alias("leaf"), F.col("leaf.path").alias("path"))


def _trees(rows: DataFrame, fanout: int, levels: int) -> list[DataFrame]:
    """Tables of blocks, each table over the roots of the one before, until every group is one block."""
    tables, size = [], fanout**levels
    while True:
        tables.append(checkpoint(_blocks(rows, fanout, levels)))
        if (tables[-1].agg(F.max("n")).first()[0] or 0) <= size:
            return tables
        above = F.expr(f"(n + {size - 1}) div {size}").alias("n")
        rows = tables[-1].select("grp", F.col("block").alias("rank"), above, F.struct("node.hash", "block").alias("node"))


def _leaves_of(tables: list[DataFrame], tops: DataFrame, fanout: int, levels: int) -> DataFrame:
    """Every leaf under tables (of _trees) with its path up to the root of tops (grp, path, root)."""
    tops = tops.withColumn("block", F.lit(0).cast("long"))
    for k, table in enumerate(reversed(tables)):
        both = table.select("grp", "block", "node").unionByName(tops.select("grp", "block", F.struct("path", "root", *(["subroot"] if k else [])).alias("top")), allowMissingColumns=True)
        met = both.groupBy("grp", "block").agg(F.first("node", True).alias("node"), F.first("top", True).alias("top"))
        subroot = F.col("top.subroot" if k else "node.hash").alias("subroot")
        met = met.select("grp", "node", "top.path", "top.root", subroot)
        tops = _handed_down(met, fanout, levels, "grp", "root", "subroot")
        if k < len(tables) - 1:
            tops = tops.select("grp", "root", "subroot", "path", F.col("leaf.block").alias("block"))
    return tops


def merkle_manifest(
    docs: DataFrame, columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), id_col: str = "doc_id", group_col: str = "source",
    carry: dict[str, Column] | None = None, fanout: int = FANOUT, levels: int = LEVELS,
) -> DataFrame:
    """Per row of docs: its id and group, leaf (digest of columns), subroot (of its group), root (of all), path (siblings before
    and after it, level by level up to the root), and the columns of ``carry`` (name and expression over docs).

    Leaves of a group ascend by id, a null id first; rows with equal ids ascend by leaf. While a group has several nodes, every
    fanout of them become their digest, and so does a last run of fewer, even of one; groups, a null one first, then ascend to the root in
    the same way. A group of one row has its leaf as subroot, and a table of one row has it as root, with an empty path. Null and
    empty values differ. Rows equal in all columns are leaves of their own. An empty table gives no rows. docs may have further
    columns of any name. Texts are read once, for their digests, and not shuffled; a group of any size is spread over its blocks.
    """
    carry = carry or {}
    own = [F.col(id_col).alias("id"), leaf_digest(*[F.col(c) for c in columns]).alias("leaf"), *[c.alias(f"with_{k}") for k, c in enumerate(carry.values())]]
    own_ranks = ranked(docs.select(F.col(group_col).alias("grp"), *own), ["id", "leaf"])
    kept = [f"with_{k}" for k in range(len(carry))]
    tables = _trees(own_ranks.select("grp", "rank", "n", F.struct(F.col("leaf").alias("hash"), "id", *kept).alias("node")), fanout, levels)
    groups = tables[-1].select(F.struct("grp").alias("whose"), F.lit(0).alias("grp"), F.col("node.hash").alias("hash"))
    group_ranks = ranked(groups, ["whose"]).select("grp", "rank", "n", F.struct("hash", "whose").alias("node"))
    upper = _trees(group_ranks, fanout, levels)
    root = upper[-1].select("grp", F.array().cast(PATH).alias("path"), F.col("node.hash").alias("root"))
    tops = _leaves_of(upper, root, fanout, levels).select(F.col("leaf.whose.grp").alias("grp"), "path", "root")
    found = _leaves_of(tables, tops, fanout, levels)
    named = [F.col(f"leaf.with_{k}").alias(name) for k, name in enumerate(carry)]
    return found.select(F.col("leaf.id").alias(id_col), F.col("grp").alias(group_col), F.col("leaf.hash").alias("leaf"), "subroot", "root", "path", *named)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    altered = leaf_digest(*[F.col(c) for c in ("doc_id", "source", "lang", "n_chars")], F.replace("text", F.lit("\n"), F.lit("")))
    found = merkle_manifest(docs, carry={"altered": F.when(chosen & (F.instr("text", "\n") > 0), altered)})
    folded = found.withColumn("folded_root", fold(F.coalesce("altered", "leaf"), F.col("path")))
    return folded.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _sql_leaf(text: str) -> str:
    values = ["cast(doc_id as varchar)", "source", "lang", "cast(n_chars as varchar)", text]
    return "sha256(" + " || ".join(f"coalesce(octet_length(encode({v})) || ':' || {v}, '-')" for v in values) + ")"


_CRC32 = (
    "xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(cast(doc_id as varchar), ''), lambda c: ascii(c)::bigint)), "
    "lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384))))"
)

ORACLE = f"""
with recursive named as (select doc_id, source, {_sql_leaf("text")} as leaf,
  case when {_CRC32} % 2 = 0 then {_sql_leaf("replace(text, chr(10), '')")} else {_sql_leaf("text")} end as altered from documents),
leaves as (select *, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as i from named),
tree as (select 0 as k, source, i, leaf as h from leaves
  union all select k + 1, source, i // 3, sha256(string_agg(h, '' order by i)) from (select *, count(*) over (partition by source) as n from tree) t
  where n > 1 group by k, source, i // 3),
tops as (select source, max(k) as k from tree group by source),
subroots as (select t.source, t.h, p.k as height, row_number() over (order by t.source nulls first) - 1 as i from tree t join tops p on t.source is not distinct from p.source and t.k = p.k),
crown as (select 0 as k, i, h from subroots
  union all select k + 1, i // 3, sha256(string_agg(h, '' order by i)) from (select *, count(*) over () as n from crown) t where n > 1 group by k, i // 3),
tip as (select h from crown where k = (select max(k) from crown)),
walk as (select doc_id, l.source, leaf, altered, l.i as own, s.h as subroot, s.height, s.i as top from leaves l join subroots s on l.source is not distinct from s.source),
steps as (select w.source, w.own, g.k, t.h, t.i, cast(floor(w.own / pow(3, g.k)) as bigint) as mine from walk w, range(0, 40) g(k)
    join tree t on t.k = g.k where g.k < w.height and t.source is not distinct from w.source and t.i // 3 = cast(floor(w.own / pow(3, g.k + 1)) as bigint)
  union all select w.source, w.own, w.height + g.k, c.h, c.i, cast(floor(w.top / pow(3, g.k)) as bigint) from walk w, range(0, 40) g(k)
    join crown c on c.k = g.k where g.k < (select max(k) from crown) and c.i // 3 = cast(floor(w.top / pow(3, g.k + 1)) as bigint)),
paths as (select source, own, k, coalesce(string_agg(h, '' order by i) filter (where i < mine), '') as before, coalesce(string_agg(h, '' order by i) filter (where i > mine), '') as after
  from steps group by source, own, k),
proofs as (select source, own, string_agg(before || after, '' order by k) as siblings, max(k) + 1 as height from paths group by source, own),
folds as (select source, own, 0 as k, altered as h from walk
  union all select f.source, f.own, f.k + 1, sha256(p.before || f.h || p.after) from folds f join paths p on p.source is not distinct from f.source and p.own = f.own and p.k = f.k)
select w.doc_id, w.leaf, w.subroot, tip.h as root, sha256(coalesce(p.siblings, '')) as proof_sha256, f.h as folded_root, f.h = tip.h as verified
from walk w cross join tip left join proofs p on p.source is not distinct from w.source and p.own = w.own
join folds f on f.source is not distinct from w.source and f.own = w.own and f.k = coalesce(p.height, 0)
"""
