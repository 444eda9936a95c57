"""Merkle manifest of a dataset: an external-memory node store, and proofs from it.

Rows are leaves. The leaves of a group (a source, say) ascend in sorted runs; 16 consecutive nodes become their parent until one, the
group's subroot, is left, and the subroots, by group, become the root in the same way. Each level is a Parquet folder whose
rows are addressed by (group, position) and hold their children's digests; a level is made from the one below alone, by sums over (group, position div
16), so the hottest group is spread like any other and a level is a sixteenth of the one below.

Proofs come from merge-scans by coordinate, from the top down: a node's path is its siblings and its parent's path, and the join of a level with
the one above is on (group, position). Paths are joined for parents, not for leaves: the sixteen leaves of a parent take theirs inside its row, so no path is
shuffled for each document.

A digest is lowercase hex SHA-256; digests are hashed as their hex text.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_order, shared_folder, stored

FAN = 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PATH = "array<struct<at:int,others:string>>"


def leaf_digest(values: list[Column]) -> Column:
    """Digest of a row: of each value its UTF-8 byte count, a colon and itself, or ``-`` for null."""
    text = [v.cast("string") for v in values]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text)), 256)


def levels(nodes: DataFrame, path: str) -> list[DataFrame]:
    """All levels over ``nodes`` (tree, pos, size, hash, payload), each from the one below: (tree, pos, size, hash, children), written to ``path``/level=k. A tree ends at
    the level where its size is one. children: hash and payload (level 1 only) of the up to 16 nodes below, in order."""
    most = nodes.agg(F.max("size")).first()[0] or 0
    out, below = [], nodes
    while most > 1:
        child = F.struct("pos", "hash", *(["payload"] if "payload" in below.columns else []))
        gathered = below.where("size > 1").groupBy("tree", F.expr(f"pos div {FAN}").alias("up")).agg(F.sort_array(F.collect_list(child)).alias("children"), F.expr(f"(first(size) + {FAN - 1}) div {FAN}").alias("size"))
        made = gathered.select("tree", F.col("up").alias("pos"), "size", F.sha2(F.concat_ws("", "children.hash"), 256).alias("hash"), "children")
        out.append(stored(made, f"{path}/level={len(out) + 1}"))
        below, most = out[-1].select("tree", "pos", "size", "hash"), -(-most // FAN)
    return out


def tops(nodes: DataFrame, above: list[DataFrame]) -> DataFrame:
    """(tree, hash): the top node of each tree."""
    found = nodes.where("size = 1").select("tree", "hash")
    for level in above:
        found = found.union(level.where("size = 1").select("tree", "hash"))
    return found


def step(children: str, k: Column) -> Column:
    """Child k's place among its siblings, and their digests, left to right."""
    return F.struct(k.cast("int").alias("at"), F.concat_ws("", F.filter(f"{children}.hash", lambda h, i: i != k)).alias("others"))


def paths(nodes: DataFrame, above: list[DataFrame], tops_path: DataFrame) -> DataFrame:
    """(tree, hash, payload, path) of every node of the lowest level: its siblings level by level, then its tree's path in ``tops_path`` (tree, path)."""
    base = tops_path.select(F.col("tree").alias("of"), F.col("path").alias("end"))
    ends = lambda df: df.where("size = 1").join(base, F.col("tree") == F.col("of"))
    alone = ends(nodes).select("tree", "hash", "payload", F.col("end").alias("path"))
    known = None
    for i, level in reversed(list(enumerate(above))):
        here = ends(level).select("tree", "children", F.col("pos"), F.col("end").alias("path"))
        if known is not None:
            mine = level.where("size > 1").select("tree", "pos", "children")
            here = here.unionByName(mine.join(known, ["tree", "pos"]))
        spread = here.select("tree", "pos", "children", "path", F.posexplode("children").alias("k", "child"))
        path = F.concat(F.array(step("children", F.col("k"))), F.col("path"))
        if not i:
            return alone.union(spread.select("tree", "child.hash", "child.payload", path.alias("path")))
        known = spread.select("tree", "child.pos", path.alias("path"))
    return alone


def folded(start: Column, path: Column) -> Column:
    """The top digest that ``start`` and the siblings of its path give."""
    put = lambda acc, s: F.sha2(F.concat(s["others"].substr(F.lit(1), s["at"] * 64), acc, s["others"].substr(s["at"] * 64 + 1, F.lit(FAN * 64))), 256)
    return F.aggregate(path, start, put)


@dataclass
class Manifest:
    """A node store: its folder, the root (None of an empty table), the leaves (tree, pos, size, hash, payload), the levels over them, the subroots as the
    leaves of a tree of their own, and the levels over those."""

    folder: str
    root: str | None
    leaves: DataFrame
    above: list[DataFrame]
    subroots: DataFrame
    over: list[DataFrame]


def build(docs: DataFrame, folder: str, columns: list[str], id_col: str = "doc_id", group_col: str = "source", altered: dict[str, Column] | None = None) -> Manifest:
    """The node store of ``docs`` in ``folder``, a new folder that the cluster shares. ``columns`` are hashed, in that order; with ``altered``, a second digest of each row, in which
    they are replaced, goes along as ``altered`` in the payload to be held against the proofs.

    Any column may be null, ids and groups too: null sorts first, and a null group is one of its own. Repeated rows are leaves each; of rows equal in group and id the smaller digest comes first.
    Texts are hashed whole. An empty table has no root. Other columns are not read, whatever their names.
    """
    values = lambda new: leaf_digest([new.get(c, F.col(c)) for c in columns])
    tree = F.coalesce(F.concat(F.lit("+"), F.col(group_col).cast("string")), F.lit(""))  # null before all others
    payload = F.struct(F.col(id_col).alias("id"), (values(altered) if altered else F.lit(None).cast("string")).alias("altered"))
    rows = docs.select(tree.alias("tree"), F.col(id_col).alias("id"), values({}).alias("hash"), payload.alias("payload"))
    leaves = in_order(rows, "tree", ["id", "hash"], f"{folder}/level=0").drop("id")
    above = levels(leaves, folder)
    subroots = in_order(tops(leaves, above).select(F.lit("").alias("tree"), F.col("tree").alias("payload"), "hash"), "tree", ["payload"], f"{folder}/subroots/level=0")
    over = levels(subroots, f"{folder}/subroots")
    root = tops(subroots, over).first()
    return Manifest(folder, root["hash"] if root else None, leaves, above, subroots, over)


def proofs(made: Manifest) -> DataFrame:
    """(tree, id, leaf, altered, path, subroot) of every leaf. path: at (the node's place among its siblings) and others (their digests) of each level up to the root."""
    spark = made.subroots.sparkSession
    top = spark.range(1).select(F.lit("").alias("tree"), F.array().cast(PATH).alias("path"))
    ends = stored(paths(made.subroots, made.over, top).select(F.col("payload").alias("tree"), "path"), f"{made.folder}/subroots/paths-{uuid.uuid4().hex}")
    subroots = made.subroots.select(F.col("payload").alias("of"), F.col("hash").alias("subroot"))
    found = paths(made.leaves, made.above, ends)
    return found.join(subroots, F.col("tree") == F.col("of")).select("tree", "payload.id", F.col("hash").alias("leaf"), "payload.altered", "path", "subroot")


def manifest(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """The digest columns of every row: doc_id, leaf, subroot, root, proof_sha256, folded_root and verified, where one id in five has its text's A-Z lower-cased before
    the check. Handling of nulls, repeats and empty tables as in ``build``; a null id is not tampered with."""
    spark = docs.sparkSession
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    text = F.when(tampered, F.translate("text", UPPER, LOWER)).otherwise(F.col("text"))
    made = build(docs, folder or f"{shared_folder(spark)}/merkle-{uuid.uuid4().hex}", ["doc_id", "source", "lang", "n_chars", "text"], altered={"text": text})
    root = F.lit(made.root).cast("string")
    found = proofs(made).select("id", "leaf", "subroot", F.sha2(F.concat_ws("", "path.others"), 256).alias("proof_sha256"), folded(F.col("altered"), F.col("path")).alias("folded_root"))
    return found.select(F.col("id").alias("doc_id"), "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))


def sql(deep: int = 5, wide: int = 3) -> str:
    """The same in SQL over ``documents``, for up to 16^deep rows a source and 16^wide sources."""
    low = f"translate(text, '{UPPER}', '{LOWER}')"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii((doc_id::VARCHAR)[i])::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), list_transform(range(8), lambda z: 0::BIGINT)), lambda x, z: xor(x >> 1, {0xEDB88320} * (x & 1)))), 4294967295::BIGINT)"  # noqa: E501
    value = lambda v: f"coalesce(strlen({v}::VARCHAR)::VARCHAR || ':' || {v}::VARCHAR, '-')"
    digest = lambda text: "sha256(" + " || ".join(value(v) for v in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    climb = lambda name, k: f"{name}{k + 1} AS (SELECT tree, pos // {FAN} AS pos, (any_value(n) + {FAN - 1}) // {FAN} AS n, list(hash ORDER BY pos) AS kids, sha256(string_agg(hash, '' ORDER BY pos)) AS hash FROM {name}{k} WHERE n > 1 GROUP BY tree, pos // {FAN})"  # noqa: E731,E501
    ends = lambda name, k: " UNION ALL ".join(f"SELECT tree, hash FROM {name}{i} WHERE n = 1" for i in range(k + 1))
    before, after = (f"coalesce(array_to_string({x}, ''), '')" for x in ("kids[1:place]", "kids[place + 2:]"))
    out = [
        f"d AS (SELECT row_number() OVER () AS r, doc_id, source, {digest('text')} AS leaf, CASE WHEN {crc} % 5 = 0 THEN {digest(low)} ELSE {digest('text')} END AS altered FROM documents)",
        "s0 AS (SELECT r, source AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n, leaf AS hash FROM d)",
        *(climb("s", k) for k in range(deep)),
        f"u AS ({ends('s', deep)})",
        "t0 AS (SELECT '' AS tree, tree AS source, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS pos, count(*) OVER () AS n, hash FROM u)",
        *(climb("t", k) for k in range(wide)),
        f"v AS ({ends('t', wide)})",
        "f0 AS (SELECT d.*, s0.pos, s0.n, t0.pos AS top, t0.n AS m, t0.hash AS subroot, altered AS fold, '' AS proof FROM d JOIN s0 ON d.r = s0.r JOIN t0 ON d.source IS NOT DISTINCT FROM t0.source)",
    ]
    for k in range(deep + wide):
        name, i, pos = ("s", k, "pos") if k < deep else ("t", k - deep, "top")
        match = f"{'f.source' if name == 's' else chr(39) * 2} IS NOT DISTINCT FROM g.tree AND f.{pos} // {FAN ** (i + 1)} = g.pos"
        side = f"(SELECT f.*, g.kids, f.{pos} // {FAN ** i} % {FAN} AS place FROM f{k} f LEFT JOIN {name}{i + 1} g ON {match})"
        out.append(f"f{k + 1} AS (SELECT * EXCLUDE (kids, place, fold, proof), CASE WHEN kids IS NULL THEN fold ELSE sha256({before} || fold || {after}) END AS fold, CASE WHEN kids IS NULL THEN proof ELSE proof || {before} || {after} END AS proof FROM {side})")  # noqa: E501
    return "WITH " + ",\n".join(out) + f"\nSELECT doc_id, leaf, subroot, v.hash AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = v.hash AS verified FROM f{deep + wide}, v"
