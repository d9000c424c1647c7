"""A Merkle manifest of a dataset, with proofs by octopus multiproofs.

Rows are leaves of one binary tree for each group (a language), groups' subroots those of one more tree. A tree is built
from blocks of 2^12 neighbouring nodes: a task turns a block into its upper nodes, and block roots form blocks in turn,
so no tree, however large, meets in one task. Nodes above the leaves' blocks are a table (tree, level, place, digest).

Proofs of many leaves: every block of leaves lists the coordinates of the nodes that its leaves' proofs need and that
neither they nor what they derive give (a sibling of a known node is derived or known; all others are missing, level by
level), the lists of all blocks are joined to the node table once, and the block derives the shared interior nodes and
expands each leaf's proof from them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

#: Levels that one block spans.
LEVELS = 12


def digest(*inputs: str) -> str:
    """H: lowercase hexadecimal SHA-256 of the inputs put together."""
    return hashlib.sha256("".join(inputs).encode()).hexdigest()


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column | str) -> Column:
    """H of the values: ``-`` if null, else the length in bytes, a colon and the value."""
    return F.sha2(F.concat(*[_field(F.col(v) if isinstance(v, str) else v) for v in values]).cast("binary"), 256)


def upper(nodes: list[str], alone: bool, levels: int) -> list[list[str]]:
    """The levels above a block's nodes; of a block that is a whole tree (``alone``) up to one node, else ``levels`` of them."""
    out = []
    while len(nodes) > 1 or (not alone and len(out) < levels):
        nodes = [digest(*nodes[k : k + 2]) for k in range(0, len(nodes), 2)]
        out.append(nodes)
    return out


def missing(known: Iterable[int], counts: list[int]) -> list[tuple[int, int]]:
    """(level, place) of the nodes that proofs of the leaves ``known`` need and can't derive; ``counts``: nodes of each level below the root.

    The fewest that do: walking up, a sibling is missing if it is neither known nor derived from known ones.
    """
    have, out = sorted(set(known)), []
    for level, count in enumerate(counts):
        held = set(have)
        out += [(level, k ^ 1) for k in have if k ^ 1 < count and k ^ 1 not in held]
        have = sorted({k >> 1 for k in have})
    return out


def levels_of(count: int) -> list[int]:
    """Nodes of each level below the root of a tree with so many leaves."""
    out = []
    while count > 1:
        out.append(count)
        count = (count + 1) // 2
    return out


def expanded(known: dict[int, str], fetched: dict[tuple[int, int], str], counts: list[int]) -> dict[int, list[str]]:
    """The siblings of each of the leaves ``known``, level by level, from their digests and the fetched missing nodes.

    Interior nodes that several proofs share are derived once.
    """
    proofs, have, under = {k: [] for k in known}, dict(known), {k: [k] for k in known}
    for level, count in enumerate(counts):
        node = lambda k: have[k] if k in have else fetched[level, k]  # noqa: B023, E731
        above, over = {}, {}
        for k in have:
            if k ^ 1 < count:
                sibling = node(k ^ 1)
                for x in under[k]:
                    proofs[x].append(sibling)
            over.setdefault(k >> 1, []).extend(under[k])
            if k >> 1 not in above:
                first = k & ~1
                above[k >> 1] = digest(node(first), node(first + 1)) if first + 1 < count else digest(node(first))
        have, under = above, over
    return proofs


def folded(at: int, own: str, siblings: list[str], counts: list[int]) -> str:
    """The root that a leaf at a place and its siblings give."""
    rest = iter(siblings)
    for count in counts:
        if at ^ 1 < count:
            own = digest(next(rest), own) if at & 1 else digest(own, next(rest))
        else:
            own = digest(own)
        at >>= 1
    return own


def placed(leaves: DataFrame) -> DataFrame:
    """``leaves`` (tree, order, leaf, ...) with ``place`` (from 0) in their tree and the tree's ``total``, by order (null first), then leaf."""
    by = ("tree", "order", "leaf")
    rows = C.written(leaves.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__at", F.monotonically_increasing_id()))
    part = F.expr("shiftright(__at, 33)")
    parts = rows.groupBy("tree", part.alias("__part")).agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    # a row for each part of a tree
    before = Window.partitionBy("tree").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = C.written(parts.withColumns({"__base": F.coalesce(F.sum("__n").over(before), F.lit(0)), "total": F.sum("__n").over(Window.partitionBy("tree"))}))
    met = rows.withColumn("__part", part).join(C.sent_if_small(parts), ["tree", "__part"])
    return met.withColumn("place", F.col("__at") - F.col("__first") + F.col("__base")).drop("__at", "__first", "__n", "__base", "__part")


_NODES = "tree string, level int, place long, digest string"


def _upper(level: int, every: bool, levels: int):
    def run(key: tuple, block: pa.Table) -> pa.Table:
        block = block.sort_by("place")
        first, own = block["place"][0].as_py(), block["digest"].to_pylist()
        kept = [(level + k + 1, first >> (k + 1), nodes) for k, nodes in enumerate(upper(own, block["total"][0].as_py() <= 1 << levels, levels))]
        if level == 0:
            kept = [(0, first, own), *kept]
            kept = kept if every else kept[-1:]
        flat = [(lev, at + k, d) for lev, at, nodes in kept for k, d in enumerate(nodes)]
        return pa.table([pa.array([block["tree"][0].as_py()] * len(flat), pa.string()), *(pa.array([x[k] for x in flat], kind) for k, kind in enumerate((pa.int32(), pa.int64(), pa.string())))], ["tree", "level", "place", "digest"])
    return run


def tree_nodes(leaves: DataFrame, most: int, every: bool = False, levels: int = LEVELS) -> DataFrame:
    """(tree, level, place, digest): nodes from level ``levels`` (that one block spans) up, or a smaller tree's root; ``every``: all nodes, leaves included.

    Of leaves (tree, place, total, digest), place and number in their tree as of ``placed``; ``most``: the largest total.
    """
    level, now, out = 0, leaves, None
    while True:
        blocks = now.withColumn("block", F.shiftright("place", levels)).groupBy("tree", "block")
        nodes = C.written(blocks.applyInArrow(_upper(level, every, levels), _NODES))
        out = nodes if out is None else out.union(nodes)
        level, most = level + levels, (most + (1 << levels) - 1) >> levels
        if most <= 1:
            return out
        tops = nodes.filter(F.col("level") == level)
        # the larger trees' block roots are leaves of the next round
        now = tops.join(tops.groupBy("tree").agg(F.count("*").alias("total")).filter("total > 1"), "tree")


def subroots(nodes: DataFrame) -> DataFrame:
    """(tree, subroot): the highest node of each tree."""
    return nodes.groupBy("tree").agg(F.max(F.struct("level", "digest")).alias("top")).select("tree", F.col("top.digest").alias("subroot"))


_STEPS = pa.list_(pa.struct([("side", pa.int32()), ("digest", pa.string())]))
_PROOFS = "tree string, order {order}, leaf string, path array<struct<side:int,digest:string>>, folded string"
#: Sides of a step: the sibling stands to the right of what is folded, to the left, or there is none.
RIGHT, LEFT, ALONE = 0, 1, 2


def steps(at: int, siblings: list[str], counts: list[int]) -> list[dict]:
    """A proof as steps from the leaf up."""
    out, rest = [], iter(siblings)
    for count in counts:
        out.append({"side": at & 1, "digest": next(rest)} if at ^ 1 < count else {"side": ALONE, "digest": None})
        at >>= 1
    return out


def _prove(key: tuple, block: pa.Table, fetched: pa.Table) -> pa.Table:
    places, counts = block["place"].to_pylist(), levels_of(block["total"][0].as_py()) if len(block) else []
    got = {(lev, at): d for lev, at, d in zip(*(fetched[c].to_pylist() for c in ("level", "place", "digest")), strict=True)}
    proofs = expanded(dict(zip(places, block["leaf"].to_pylist(), strict=True)), got, counts)
    ends = [folded(p, d, proofs[p], counts) for p, d in zip(places, block["shown"].to_pylist(), strict=True)]
    return block.select(["tree", "order", "leaf"]).append_column("path", pa.array([steps(p, proofs[p], counts) for p in places], _STEPS)).append_column("folded", pa.array(ends, pa.string()))


def _needs(key: tuple, block: pa.Table) -> pa.Table:
    need = missing(block["place"].to_pylist(), levels_of(block["total"][0].as_py()))
    n = len(need)
    return pa.table({"tree": pa.array([block["tree"][0].as_py()] * n, pa.string()), "block": pa.array([block["block"][0].as_py()] * n, pa.int64()), "level": pa.array([x[0] for x in need], pa.int32()), "place": pa.array([x[1] for x in need], pa.int64())})


def prove(leaves: DataFrame, nodes: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(tree, order, leaf, path, folded) of leaves (tree, order, place, total, leaf, shown), from nodes of their trees.

    ``path``: the proof up to the subroot, as steps; ``folded``: what ``shown`` (the leaf to be verified) gives with it.
    Any of a tree's leaves may be asked if ``nodes`` are all nodes; whole trees need those of ``levels`` up alone.
    """
    blocked = leaves.withColumn("block", F.shiftright("place", levels))
    needs = blocked.select("tree", "block", "place", "total").groupBy("tree", "block").applyInArrow(_needs, "tree string, block long, level int, place long")
    fetched = needs.join(nodes.select("tree", "level", "place", "digest"), ["tree", "level", "place"])
    kind = dict(leaves.dtypes)["order"]
    return blocked.groupBy("tree", "block").cogroup(fetched.groupBy("tree", "block")).applyInArrow(_prove, _PROOFS.format(order=kind))


def climbed(start: Column, path: Column) -> Column:
    """The node that ``start`` gives with the steps of a path."""
    def up(own: Column, step: Column) -> Column:
        run = F.when(step["side"] == RIGHT, F.concat(own, step["digest"])).when(step["side"] == LEFT, F.concat(step["digest"], own)).otherwise(own)
        return F.sha2(run.cast("binary"), 256)
    return F.aggregate(path, start, up)


#: Groups whose paths are sent to every task (some 1 KB each), at most; more are joined in the shuffle.
SENT_GROUPS = 20_000


def manifest(docs: DataFrame, group_col: str = "lang", id_col: str = "doc_id", columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), shown: Column | None = None, levels: int = LEVELS) -> DataFrame:
    """doc_id, leaf, subroot, root, siblings, folded_root, verified for each row of ``docs``.

    A leaf is H of the row's ``columns``. Leaves of one group follow each other by id (null first), then digest; while
    several nodes remain, every two neighbours become their H, a last one alone its own. The subroots, by group (null
    first, then by bytes), form a tree in the same way. ``siblings``: the other nodes of the leaf's runs, from the leaf's
    level through the subroot's to the root. ``shown``: the leaf to be verified (default: the leaf itself); folded_root
    is what it and the siblings give, verified whether that is the root. Repeated rows are leaves of their own; a tree of
    one leaf is that leaf; an empty table gives no rows.
    """
    C.bounded_batches(docs.sparkSession)
    own = leaf(*[F.col(c) for c in columns])
    tree = F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit(""))  # '' stands for null, before all others
    rows = docs.select(tree.alias("tree"), F.col(id_col).cast("long").alias("order"), own.alias("leaf"), (own if shown is None else shown).alias("shown"))
    rows = C.written(placed(rows))
    nodes = tree_nodes(rows.select("tree", "place", "total", F.col("leaf").alias("digest")), rows.agg(F.max("total")).first()[0] or 0, levels=levels)
    # the groups' tree: its leaves are the subroots
    below = subroots(nodes).select(F.lit("root").alias("tree"), F.col("tree").alias("order"), F.col("subroot").alias("leaf"), F.col("subroot").alias("shown"))
    below = C.written(placed(below))
    top = tree_nodes(below.select("tree", "place", "total", F.col("leaf").alias("digest")), below.count(), levels=levels)
    groups = prove(below, top, levels).select(F.col("order").alias("tree"), F.col("leaf").alias("subroot"), F.col("path").alias("rest"), F.col("folded").alias("root"))
    groups = C.written(groups)
    groups = F.broadcast(groups) if groups.limit(SENT_GROUPS + 1).count() <= SENT_GROUPS else groups
    met = prove(rows, nodes, levels).join(groups, "tree").withColumn("folded_root", climbed(F.col("folded"), F.col("rest")))
    siblings = F.transform(F.filter(F.concat("path", "rest"), lambda s: s["side"] != ALONE), lambda s: s["digest"])
    return met.select(F.col("order").alias("doc_id"), "leaf", "subroot", "root", siblings.alias("siblings"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
