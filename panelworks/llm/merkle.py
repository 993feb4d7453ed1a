"""A dataset manifest: one Merkle tree of rows for each group (a language), and one over the groups' roots.

Rows are hashed on the JVM, ordered by a range partitioning, numbered within their tree and dealt into aligned blocks of ``2 ** HEIGHT`` leaves. A builder
appends a block's nodes in the order in which they are complete, which is the postorder of its subtree; the blocks' tops are the leaves of the next tier,
until each tree has one block. No block depends on another of its tier, and no task or driver holds more than one block.

Postorder places have a closed form. A subtree over r leaves whose top stands at height h has ``size(r, h)`` nodes, and the node of height h over the leaves from
``start`` on stands at ``complete(start) + size(r, h) - 1``; its left sibling stands its own size before it, its right sibling the sibling's size after it.
So proofs are read from the stored logs by address, first those of the topmost tier, then, block by block, those of the tiers below.

The last run of a level may be a single node, which is hashed alone. Missing values are a mark of their own; rows of a NULL group form a tree too. Rows of equal
key are ordered by their digest, equal rows in any order (their digests are equal). Empty texts and very long ones are hashed whole. An empty table has no
tree and gives no rows. Only the named fields are read, so other columns, whatever their names, do no harm.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from panelworks.llm.common import released, stored

#: Height of a block's subtree: 1,024 leaves.
HEIGHT = 10

#: How a step of a proof joins the node with its sibling: the sibling stands left, right, or there is none.
LEFT, RIGHT, ALONE = b"L", b"R", b"-"


# -- places in postorder ------------------------------------------------------------------------


def complete(leaves: int) -> int:
    """Nodes that are complete once so many leaves are in, as a binary counter carries."""
    return 2 * leaves - leaves.bit_count()


def size(leaves: int, height: int) -> int:
    """Nodes of a subtree over ``leaves`` leaves whose top stands at ``height``: the complete ones, and one above the last run at each height up to the top."""
    return complete(leaves) + height - ((leaves & -leaves).bit_length() - 1)


def position(height: int, index: int, leaves: int) -> int:
    """Place of the ``index``-th node of ``height`` in the log of a tree over ``leaves`` leaves."""
    start = index << height
    return complete(start) + size(min(1 << height, leaves - start), height) - 1


def sibling(height: int, index: int, leaves: int) -> int | None:
    """Place of a node's sibling, from the node's place and the subtrees' sizes; None where the node is alone."""
    here = position(height, index, leaves)
    if index & 1:
        start = index << height
        return here - size(min(1 << height, leaves - start), height)
    start = (index + 1) << height
    return here + size(min(1 << height, leaves - start), height) if start < leaves else None


def top_height(leaves: int, alone: bool, height: int = HEIGHT) -> int:
    """A tree of one block ends where one node is left; a block among others goes on to the height of a whole block."""
    return (leaves - 1).bit_length() if alone else height


# -- hashes of nodes ----------------------------------------------------------------------------


def parent(*nodes: bytes) -> bytes:
    """Digest of the nodes' digests as lowercase hex text, one after the other."""
    return hashlib.sha256(b"".join(x.hex().encode() for x in nodes)).digest()


def build(leaves: Sequence[bytes], top: int) -> list[bytes]:
    """The nodes up to height ``top`` in order of completion."""
    log: list[bytes] = []
    open_: list[tuple[int, bytes]] = []
    for node in leaves:
        height = 0
        log.append(node)
        while open_ and open_[-1][0] == height:
            node = parent(open_.pop()[1], node)
            height += 1
            log.append(node)
        open_.append((height, node))
    edge: list[bytes] = []
    for height in range(top):
        run = [open_.pop()[1]] if open_ and open_[-1][0] == height else []
        if run or edge:
            edge = [parent(*run, *edge)]
            log += edge
    return log


def steps(log: Sequence[bytes], index: int, leaves: int, top: int) -> bytes:
    """A leaf's proof up to the log's top: for each level a mark and the sibling's digest, if there is one."""
    out = []
    for height in range(top):
        j = index >> height
        at = sibling(height, j, leaves)
        out += [ALONE] if at is None else [LEFT if j & 1 else RIGHT, log[at]]
    return b"".join(out)


def read_steps(path: bytes) -> list[tuple[bytes, bytes | None]]:
    out, i = [], 0
    while i < len(path):
        mark = path[i : i + 1]
        out.append((mark, None if mark == ALONE else path[i + 1 : i + 33]))
        i += 1 if mark == ALONE else 33
    return out


def fold(node: bytes, proof: Sequence[tuple[bytes, bytes | None]]) -> bytes:
    for mark, other in proof:
        node = parent(node) if other is None else parent(other, node) if mark == LEFT else parent(node, other)
    return node


# -- rows ---------------------------------------------------------------------------------------


def _blocks(batches):
    """A dict for each row, one row in memory at a time, with ``log``, its nodes one by one."""
    for b in batches:
        for k in range(b.num_rows):
            row = b.slice(k, 1).to_pylist()[0]
            row["log"] = [row["nodes"][at : at + 32] for at in range(0, len(row["nodes"]), 32)]
            yield row


def digest(fields: Sequence[Column]) -> Column:
    """SHA-256 (binary) of the fields: ``-`` for NULL, else the number of UTF-8 bytes, a colon and the value."""
    texts = [f.cast("string") for f in fields]
    return F.unhex(F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]).cast("binary"), 256))


def tree_of(group: Column) -> Column:
    """A tree's name: NULL groups sort first, the others by their UTF-8 bytes."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit("-"))


def numbered(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``rows`` with ``i``, their place in their ``tree`` by ``keys`` from 0, and ``n``, the tree's rows. Each task sorts a range; equal rows may part."""
    rows = stored(rows.withColumn("_row", F.monotonically_increasing_id()))
    order = ["tree", *keys, "_row"]
    rows = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)))
    # A row for each tree and range that holds some of it.
    runs = rows.groupBy("tree", "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy("tree").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = stored(runs.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).withColumn("n", F.sum("_n").over(Window.partitionBy("tree"))))
    placed = rows.join(runs.select("tree", "_part", "_first", "_before", "n"), ["tree", "_part"])
    return placed.withColumn("i", F.col("_at") - F.col("_first") + F.col("_before")).drop("_row", "_at", "_part", "_first", "_before")


@dataclass(frozen=True)
class Forest:
    """Logs of all trees by tier. A row of a tier: tree, block, ``alone`` (the tree's only block), ``nodes`` (the block's log) and ``top``; in the first tier
    also what came with the leaves, as arrays in their order."""

    tiers: list[DataFrame]
    height: int

    def roots(self) -> DataFrame:
        """(tree, digest): each tree's root stands in the tier in which it has one block."""
        out = self.tiers[0].filter("alone").select("tree", F.col("top").alias("digest"))
        for tier in self.tiers[1:]:
            out = out.unionByName(tier.filter("alone").select("tree", F.col("top").alias("digest")))
        return out


def _logged(blocks: DataFrame, height: int) -> DataFrame:
    """``blocks`` with ``nodes`` and ``top`` from ``leaves``."""

    def run(batches):
        for b in batches:
            kept = b.select([c for c in b.schema.names if c != "leaves"])
            for k in range(b.num_rows):
                leaves = b.column("leaves")[k].as_py()
                log = build(leaves, top_height(len(leaves), b.column("alone")[k].as_py(), height))
                yield pa.RecordBatch.from_arrays([*kept.slice(k, 1).columns, pa.array([b"".join(log)], pa.binary()), pa.array([log[-1]], pa.binary())], names=[*kept.schema.names, "nodes", "top"])

    kinds = [f"`{c}` {k}" for c, k in blocks.dtypes if c != "leaves"]
    return blocks.mapInArrow(released(run), ", ".join([*kinds, "nodes binary", "top binary"]))


def forest(leaves: DataFrame, payload: Sequence[str] = (), height: int = HEIGHT) -> Forest:
    """Builds the trees of ``leaves`` (tree, i, n, digest, payload..). Tiers are as many as the largest tree needs; each is stored."""
    tiers: list[DataFrame] = []
    while True:
        rows = leaves.withColumn("block", F.shiftright("i", height))
        runs = rows.groupBy("tree", "block").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("i", "digest", *payload))).alias("run"))
        blocks = runs.select("tree", "block", (F.col("n") <= 1 << height).alias("alone"), F.col("n"), F.col("run.digest").alias("leaves"), *[F.col(f"run.{c}").alias(c) for c in payload])
        tier = stored(_logged(blocks, height))
        tiers.append(tier)
        more = tier.filter(~F.col("alone"))
        if more.limit(1).count() == 0:
            return Forest(tiers, height)
        leaves, payload = more.select("tree", F.col("block").alias("i"), F.shiftright(F.col("n") + ((1 << height) - 1), height).alias("n"), F.col("top").alias("digest")), ()


def paths(trees: Forest, above: DataFrame) -> DataFrame:
    """Rows of the first tier with ``path``, the steps from the block's top on, and the other columns of ``above`` (tree, path, ..), which holds each tree's steps beyond its root."""
    height, extra = trees.height, [(c, k) for c, k in above.dtypes if c not in ("tree", "path")]
    known = None
    for tier in reversed(trees.tiers):
        here = tier.filter("alone").join(above, "tree")
        if known is not None:
            here = here.unionByName(tier.filter(~F.col("alone")).join(known, ["tree", "block"]))
        if tier is trees.tiers[0]:
            return here

        def run(batches):
            names = [c for c, _ in extra]
            for row in _blocks(batches):
                out: dict[str, list] = {c: [] for c in ("tree", "block", *names, "path")}
                n = row["leaves"]
                for j in range(n):
                    values = (row["tree"], (row["block"] << height) + j, *[row[c] for c in names], steps(row["log"], j, n, top_height(n, row["alone"], height)) + row["path"])
                    for c, v in zip(out, values, strict=True):
                        out[c].append(v)
                yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("tree", pa.string()), ("block", pa.int64()), *[(c, pa.string()) for c in names], ("path", pa.binary())]))

        leaves = F.least(F.lit(1 << height), F.col("n") - F.shiftleft("block", height)).alias("leaves")
        known = stored(here.select("tree", "block", "alone", leaves, "nodes", "path", *[c for c, _ in extra]).mapInArrow(released(run), ", ".join(["tree string", "block long", *[f"{c} string" for c, _ in extra], "path binary"])))
    raise AssertionError("a forest has a tier")


def nodes(trees: Forest) -> DataFrame:
    """(tree, height, index, position, digest): every node of the trees with its place in the whole tree's postorder."""
    height, out = trees.height, None
    for t, tier in enumerate(trees.tiers):

        def run(batches, base=t * height, lowest=t):
            for row in _blocks(batches):
                found: dict[str, list] = {c: [] for c in ("tree", "height", "index", "position", "digest")}
                total, first = row["total"], row["block"] << height
                n = min(1 << height, -(-total // (1 << base)) - first)
                for h in range(1 if lowest else 0, top_height(n, row["alone"], height) + 1):
                    for j in range(-(-n // (1 << h))):
                        index = (first >> h) + j
                        for c, v in zip(found, (row["tree"], base + h, index, position(base + h, index, total), row["log"][position(h, j, n)]), strict=True):
                            found[c].append(v)
                yield pa.RecordBatch.from_pydict(found, schema=pa.schema([("tree", pa.string()), ("height", pa.int32()), ("index", pa.int64()), ("position", pa.int64()), ("digest", pa.binary())]))

        totals = trees.tiers[0].groupBy("tree").agg(F.first("n").alias("total"))
        one = tier.select("tree", "block", "alone", "nodes").join(totals, "tree").mapInArrow(run, "tree string, height int, index long, position long, digest binary")
        out = one if out is None else out.unionByName(one)
    return out


# -- the manifest -------------------------------------------------------------------------------


def manifest(df: DataFrame, fields: Sequence[str], group: str, key: str, changed: Callable[[DataFrame], Column] | None = None, height: int = HEIGHT) -> DataFrame:
    """(key, leaf, subroot, root, proof_sha256, folded_root, verified), one row for each of ``df``.

    ``leaf``, ``subroot`` and ``root`` are the row's digest, its group's root and the root over the groups, in lowercase hex. ``proof_sha256`` is the digest of the
    siblings from leaf to root. ``folded_root`` folds them onto the row's digest, or onto that which ``changed`` gives (binary, NULL: as it is), as if the row had been
    altered since; ``verified`` says whether that is the root.
    """
    other = (changed(df) if changed else F.lit(None)).cast("binary")
    rows = df.select(tree_of(F.col(group)).alias("tree"), F.col(key).alias("key"), digest([F.col(f) for f in fields]).alias("digest"), other.alias("changed"))
    trees = forest(numbered(rows, ["key", "digest"]), ("key", "changed"), height)
    subroots = stored(trees.roots())
    head = forest(numbered(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("key"), "digest"), ["key"]), ("key",), height)
    root = head.roots().first()
    root = root["digest"].hex() if root else ""

    def up(batches):
        for row in _blocks(batches):
            out: dict[str, list] = {"tree": [], "path": [], "subroot": []}
            n = len(row["key"])
            for j, name in enumerate(row["key"]):
                out["tree"].append(name)
                out["path"].append(steps(row["log"], j, n, top_height(n, row["alone"], height)) + row["path"])
                out["subroot"].append(row["log"][position(0, j, n)].hex())
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("tree", pa.string()), ("path", pa.binary()), ("subroot", pa.string())]))

    nothing = df.sparkSession.range(1).select(F.lit("").alias("tree"), F.lit("").cast("binary").alias("path"))
    above = stored(paths(head, nothing).select("key", "alone", "nodes", "path").mapInArrow(released(up), "tree string, path binary, subroot string"))

    kind = dict(df.dtypes)[key]
    arrow = to_arrow_type(df.schema[key].dataType)

    def prove(batches):
        for row in _blocks(batches):
            log, n = row["log"], len(row["key"])
            top = top_height(n, row["alone"], height)
            beyond = read_steps(row["path"])
            beyond_hex = "".join(x.hex() for _, x in beyond if x)
            done: dict[bytes, str] = {}  # most rows meet at the block's top
            out: dict[str, list] = {c: [] for c in ("key", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")}
            for j, (key_, altered) in enumerate(zip(row["key"], row["changed"], strict=True)):
                leaf, own = log[position(0, j, n)], read_steps(steps(log, j, n, top))
                met = fold(altered if altered is not None else leaf, own)
                if met not in done:
                    done[met] = fold(met, beyond).hex()
                proof = "".join(x.hex() for _, x in own if x) + beyond_hex
                for c, v in zip(out, (key_, leaf.hex(), row["subroot"], root, hashlib.sha256(proof.encode()).hexdigest(), done[met], done[met] == root), strict=True):
                    out[c].append(v)
            kinds = [arrow, *[pa.string()] * 5, pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], names=list(out))

    found = paths(trees, above).select("key", "changed", "alone", "nodes", "path", "subroot").mapInArrow(released(prove), f"key {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    return found.withColumnRenamed("key", key)
