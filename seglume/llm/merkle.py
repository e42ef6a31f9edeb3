"""A Merkle manifest of a table: leaves, a tree for each source, a tree over the sources, and a proof for each row.

A node is the SHA-256 of its run's digests as hex text. Within a source leaves ascend by id; while several nodes remain,
each ``arity`` consecutive ones (the last run may be shorter, even one) become one. The sources' roots, null first and
then by the bytes of their names, become the root in the same way.

Authentication paths come by fractal traversal: a block of ``arity ** block_levels`` leaves is one task's unit. For each
of its levels the traversal keeps the existing subtree, from which the present path takes its siblings, and the desired
one that comes next and grows by one leaf a step; so a path costs a few hashes, and what is kept is a few runs whatever
the block's size. Levels above the blocks are tables: runs of nodes joined with the blocks below them, level by level.

Positions within a source come from ranges of the order (``ranks.numbered``), so a hot source lies in many blocks and
tasks. A source's tree is as tall as its number of leaves asks for; a lone leaf is its source's root.

Nulls: each field of a leaf may be null (``-``); a row without an id orders first and is never tampered with. Equal ids
order by the leaf; repeated rows have leaves and proofs of their own. An empty table gives no rows. Other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from seglume.llm.ranks import numbered
from seglume.storage import stage


@dataclass(frozen=True)
class MerkleParams:
    arity: int = 16
    block_levels: int = 3
    #: Rows whose id's checksum this divides are tampered with.
    tamper_every: int = 5


FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_HEX = 64
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PATH = "array<struct<place:int,others:string>>"


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def field(c: Column) -> Column:
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*fields: Column) -> Column:
    return F.sha2(F.concat(*map(field, fields)).cast("binary"), 256)


# ---- within a block

class Subtree:
    """Nodes of one level, from leaves that come one by one: a stack of open runs below it."""

    def __init__(self, level: int, arity: int) -> None:
        self.arity, self.open = arity, [[] for _ in range(level + 1)]

    def push(self, node: str) -> None:
        for level, run in enumerate(self.open):
            run.append(node)
            if level + 1 == len(self.open) or len(run) < self.arity:
                return
            node = digest("".join(run))
            run.clear()

    def nodes(self) -> list[str]:
        """The run at the subtree's top, with runs that ended short closed."""
        for level, run in enumerate(self.open[:-1]):
            if run:
                self.open[level + 1].append(digest("".join(run)))
        return self.open[-1]


def paths(leaves: list[str], levels: int, arity: int) -> Iterator[list[tuple[int, str]]]:
    """For each leaf of a block, its (place, siblings joined) at each level."""
    spans = [arity ** (level + 1) for level in range(levels)]
    existing, desired = [], []
    for level, span in enumerate(spans):
        first = Subtree(level, arity)
        for node in leaves[:span]:
            first.push(node)
        existing.append(first.nodes())
        desired.append(Subtree(level, arity))
    path: list[tuple[int, str]] = [(0, "")] * levels
    for i in range(len(leaves)):
        for level, span in enumerate(spans):
            below = span // arity
            if i % below == 0:
                place, run = i // below % arity, existing[level]
                path[level] = (place, "".join(run[:place] + run[place + 1 :]))
        yield list(path)
        for level, span in enumerate(spans):
            if i + span < len(leaves):
                desired[level].push(leaves[i + span])
            if (i + 1) % span == 0:
                existing[level], desired[level] = desired[level].nodes(), Subtree(level, arity)


def folded(node: str, path: list[tuple[int, str]]) -> str:
    """What a leaf and its siblings amount to."""
    for place, others in path:
        node = digest(others[: _HEX * place] + node + others[_HEX * place :])
    return node


def _height(n: int, arity: int) -> int:
    levels = 0
    while arity**levels < n:
        levels += 1
    return levels


def _prove(p: MerkleParams):
    def run(block: pa.Table, upper: pa.Table) -> pa.Table:
        block, above = block.sort_by("at"), upper.to_pylist()[0]
        rest = [(step["place"], step["others"]) for step in above["path"]]
        leaves, changed = (block.column(c).to_pylist() for c in ("leaf", "changed"))
        levels = min(p.block_levels, _height(above["n"], p.arity))
        proofs, roots = [], []
        for node, other, own in zip(leaves, changed, paths(leaves, levels, p.arity)):
            path = own + rest
            proofs.append(digest("".join(others for _, others in path)))
            roots.append(folded(other or node, path))
        same = lambda x: pa.array([x] * len(leaves), pa.string())
        cols = [block.column("doc_id"), block.column("leaf"), same(above["subroot"]), same(above["root"]), pa.array(proofs, pa.string()), pa.array(roots, pa.string()), pa.array([r == above["root"] for r in roots])]
        return pa.table(cols, names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    return run


# ---- above the blocks

def tree(nodes: DataFrame, group: str, tallest: int, p: MerkleParams, keep_from: int, label: str) -> tuple[DataFrame, dict[int, DataFrame]]:
    """The root of each group's tree from (group, at, h, n), n being the group's nodes; and the runs (group, run, hashes)
    of each level from ``keep_from`` on, as tables."""
    runs: dict[int, DataFrame] = {}
    roots = nodes.where("n = 1").select(group, "h")
    for level in range(tallest):
        up = nodes.where("n > 1").groupBy(group, F.expr(f"at div {p.arity}").alias("at"))
        # at most ``arity`` digests a group
        up = up.agg(F.sort_array(F.collect_list(F.struct("at", "h"))).alias("run"), F.first("n").alias("n"))
        up = up.select(group, "at", F.array_join("run.h", "").alias("hashes"), F.expr(f"(n + {p.arity - 1}) div {p.arity}").alias("n"))
        if level >= keep_from:
            up = runs[level] = stage(up, label)
        nodes = up.select(group, "at", F.sha2(F.col("hashes").cast("binary"), 256).alias("h"), "n")
        nodes = stage(nodes, label) if level + 1 == keep_from else nodes
        roots = roots.unionByName(nodes.where("n = 1").select(group, "h"))
    return stage(roots, label), runs


def climb(starts: DataFrame, group: str, runs: dict[int, DataFrame], p: MerkleParams) -> DataFrame:
    """``starts`` (group, at, path) with the siblings of the levels in ``runs`` after what the path holds."""
    out = starts.withColumn("_at", F.col("at"))
    for level in sorted(runs):
        up = runs[level].select(group, F.col("at").alias("_up"), "hashes")
        out = out.withColumn("_up", F.expr(f"_at div {p.arity}")).join(up, [group, "_up"], "left")
        place = F.expr(f"cast(_at % {p.arity} as int)")
        others = F.concat(F.substr("hashes", F.lit(1), place * _HEX), F.substr("hashes", (place + 1) * _HEX + 1))
        step = F.array(F.struct(place.alias("place"), others.alias("others"))).cast(_PATH)
        out = out.withColumn("path", F.when(F.col("hashes").isNull(), F.col("path")).otherwise(F.concat("path", step))).withColumn("_at", F.col("_up")).drop("_up", "hashes")
    return out.drop("_at")


def manifest(docs: DataFrame, id_col: str = "doc_id", params: MerkleParams = MerkleParams()) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256 (all of the table as it is), folded_root (from the tampered leaf where a
    row is tampered with), verified; one row a document."""
    p = params
    of = {name: F.col(id_col if name == "doc_id" else name) for name in FIELDS}
    lower = of | {"text": F.translate(of["text"].cast("string"), _UPPER, _LOWER)}
    tampered = F.crc32(of["doc_id"].cast("string").cast("binary")) % p.tamper_every == 0
    source = of["source"].cast("string")
    rows = docs.select(
        of["doc_id"].alias("doc_id"),
        F.when(source.isNull(), "").otherwise(F.concat(F.lit("="), source)).alias("g"),
        leaf(*of.values()).alias("leaf"),
        F.when(tampered, leaf(*lower.values())).alias("changed"),
    )
    placed, sizes = numbered(rows, "g", ["doc_id", "leaf"], "merkle-rows")
    sizes = stage(sizes, "merkle-sizes")
    most, sources = sizes.agg(F.max("n"), F.count("*")).first()
    span = p.arity**p.block_levels
    placed = stage(placed.withColumn("block", F.expr(f"at div {span}")), "merkle-leaves")
    leaves = placed.select("g", "at", F.col("leaf").alias("h")).join(sizes, "g")
    subroots, runs = tree(leaves, "g", _height(most or 1, p.arity), p, p.block_levels, "merkle-nodes")

    named = subroots.select(F.lit(0).alias("all"), "g", "h")
    ordered = stage(numbered(named, "all", ["g"], "merkle-sources")[0], "merkle-sources")
    tops, top_runs = tree(ordered.select("all", "at", "h", F.lit(sources).alias("n")), "all", _height(sources or 1, p.arity), p, 0, "merkle-top")
    none = F.array().cast(_PATH)
    above = climb(ordered.select("all", "at", "g", F.col("h").alias("subroot"), none.alias("path")), "all", top_runs, p)
    above = above.join(tops.select("all", F.col("h").alias("root")), "all").select("g", "subroot", "root", F.col("path").alias("rest"))
    blocks = placed.select("g", F.col("block").alias("at")).distinct().withColumn("path", none)
    upper = climb(blocks, "g", runs, p).join(above, "g").join(sizes, "g").select("g", F.col("at").alias("block"), F.concat("path", "rest").alias("path"), "subroot", "root", "n")
    upper = stage(upper, "merkle-upper")

    kind = dict(docs.select(of["doc_id"].alias("doc_id")).dtypes)["doc_id"]
    schema = f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    mine = placed.select("g", "block", "at", "doc_id", "leaf", "changed").groupBy("g", "block")
    return mine.cogroup(upper.groupBy("g", "block")).applyInArrow(_prove(p), schema)


def _tree_sql(name: str, leaves: str, levels: int, arity: int) -> str:
    """CTEs name_0 .. name_<levels> with (g, i, h, n, own, path): own is the leaf's number, path its siblings so far."""
    out = [f"{name}_0 AS ({leaves})"]
    for k in range(levels):
        out.append(
            f"{name}_r{k} AS (SELECT g, i // {arity} AS j, string_agg(h, '' ORDER BY i) AS hashes FROM (SELECT DISTINCT g, i, h FROM {name}_{k} WHERE n > 1) GROUP BY 1, 2), "
            f"{name}_{k + 1} AS (SELECT a.g, CASE WHEN n > 1 THEN j ELSE i END AS i, CASE WHEN n > 1 THEN sha256(hashes) ELSE h END AS h, "
            f"CASE WHEN n > 1 THEN (n + {arity - 1}) // {arity} ELSE n END AS n, own, "
            f"CASE WHEN n > 1 THEN list_append(path, struct_pack(place := i % {arity}, others := substr(hashes, 1, CAST(i % {arity} * {_HEX} AS INT)) || substr(hashes, CAST(i % {arity} * {_HEX} + {_HEX + 1} AS INT)))) ELSE path END AS path "
            f"FROM {name}_{k} a LEFT JOIN {name}_r{k} r ON a.g = r.g AND a.i // {arity} = r.j AND a.n > 1)"
        )
    return ", ".join(out)


def manifest_sql(levels: int = 6, source_levels: int = 3, params: MerkleParams = MerkleParams()) -> str:
    """``manifest`` over ``documents`` for sources of up to arity ** levels rows."""
    p = params
    say = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR) END"
    lowered = f"translate(text, '{_UPPER}', '{_LOWER}')"
    h = lambda text: "sha256(" + " || ".join(say(text if f == "text" else f) for f in FIELDS) + ")"
    none = "CAST([] AS STRUCT(place BIGINT, others VARCHAR)[])"
    table = "SELECT list_transform(range(256), lambda x: list_reduce(list_prepend(x, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab"
    codes = "list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda k: CAST(ascii(substr(CAST(doc_id AS VARCHAR), k, 1)) AS BIGINT))"
    crc = f"xor(list_reduce(list_prepend(4294967295, {codes}), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295)"
    fold = f"list_reduce(list_prepend(struct_pack(place := 0, others := coalesce(changed, leaf)), path), lambda a, s: struct_pack(place := 0, others := sha256(substr(s.others, 1, CAST(s.place * {_HEX} AS INT)) || a.others || substr(s.others, CAST(s.place * {_HEX} + 1 AS INT))))).others"
    return (
        f"WITH crc AS ({table}), marked AS (SELECT doc_id, source, {h('text')} AS leaf, CASE WHEN {crc} % {p.tamper_every} = 0 THEN {h(lowered)} END AS changed FROM documents, crc), "
        f"numbered AS (SELECT *, coalesce('=' || source, '') AS g, row_number() OVER (ORDER BY source NULLS FIRST, doc_id NULLS FIRST, leaf) AS own, "
        f"row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM marked), "
        + _tree_sql("t", f"SELECT g, i, leaf AS h, n, own, {none} AS path FROM numbered", levels, p.arity)
        + f", tops AS (SELECT g, h, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT g, h FROM t_{levels})), "
        + _tree_sql("u", f"SELECT 0 AS g, i, h, n, g AS own, {none} AS path FROM tops", source_levels, p.arity)
        + f", proofs AS (SELECT d.doc_id, d.leaf, d.changed, t.h AS subroot, u.h AS root, list_concat(t.path, u.path) AS path FROM numbered d JOIN t_{levels} t ON d.own = t.own JOIN u_{source_levels} u ON d.g = u.own) "
        f"SELECT doc_id, leaf, subroot, root, sha256(list_reduce(list_prepend('', list_transform(path, lambda s: s.others)), lambda a, b: a || b)) AS proof_sha256, {fold} AS folded_root, {fold} = root AS verified FROM proofs"
    )
