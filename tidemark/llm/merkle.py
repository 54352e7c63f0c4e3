"""A Merkle manifest of a documents table: checkpoint and recompute.

Every source is a tree of arity ARITY over its documents' digests, and the sources' roots are the leaves of one more tree.
Only each STRIDE-th level is stored. A block, the stored nodes under one node of the next stored level, holds
ARITY ** STRIDE nodes at most; what lies between is computed from the block when the tree is built, and once more when
proofs are read, where each node's siblings are emitted and the rest is forgotten.

Places come from one sort by ranges, counts per range and running sums of the counts, so a source may hold any share of the
rows: no task gets more than its range or a few blocks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import let, stored

ARITY = 3
#: Levels from one stored level to the next.
STRIDE = 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_STEPS = "array<struct<before:string,after:string>>"


def digest(*parts: Column | str) -> Column:
    """Lowercase hex sha256 of the concatenated parts."""
    return F.sha2(F.concat(*parts), 256)


def leaf(text: Column | None = None) -> Column:
    """The digest of a row's FIELDS, each `-` if null, else its UTF-8 bytes counted, `:` and its value. text: in place of the row's."""

    def field(name: str) -> Column:
        value = text if name == "text" and text is not None else F.col(name).cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return digest(*[field(name) for name in FIELDS])


def group_of(source: Column) -> Column:
    """A source as a key that is never null and is ordered as sources are: null first, then bytewise."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit("-"))


def placed(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows with `group` → the same with place (from 0, ascending by order in the group) and size (of the group), stored.

    Equal rows may take each other's place.
    """
    ordered = rows.repartitionByRange("group", *order).sortWithinPartitions("group", *order)
    ordered = stored(ordered.withColumn("_at", F.monotonically_increasing_id()), name)
    slice_of = F.shiftright("_at", 33)  # the number of the range a row lies in
    slices = ordered.groupBy("group", slice_of.alias("_slice")).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy("group").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.select(
        "group", "_slice", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_n").over(Window.partitionBy("group")).alias("size"),
    )
    joined = ordered.withColumn("_slice", slice_of).join(slices, ["group", "_slice"])
    return joined.select(*rows.columns, (F.col("_at") + F.col("_shift")).alias("place"), "size")


def _height(size: Column) -> Column:
    """Levels above the leaves of a tree of so many: the powers of ARITY below size."""
    powers = F.array(*[F.lit(ARITY**k).cast("long") for k in range(40)])
    return F.size(F.filter(powers, lambda p: p < size))


def _few(height: Column) -> Column:
    """[0, 1, ...], a number per level that a block is folded by."""
    return F.slice(F.array(*[F.lit(k) for k in range(STRIDE)]), 1, F.least(height, F.lit(STRIDE)))


def _level_above(nodes: Column) -> Column:
    runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / ARITY).cast("int"))
    return F.transform(runs, lambda run: F.sha2(F.array_join(F.slice(nodes, run * ARITY + 1, ARITY), ""), 256))


def _levels(nodes: Column, height: Column) -> Column:
    """A block's nodes → its levels from the stored one up, as arrays of digests."""
    start = F.array(nodes).cast("array<array<string>>")
    grown = lambda levels, _: F.concat(levels, F.array(_level_above(F.element_at(levels, -1))))
    return F.aggregate(_few(height), start, grown)


def _blocks(nodes: DataFrame) -> DataFrame:
    """A stored level (group, place, size, node, ...) → one row per block: its rows in order and the levels they fold to."""
    kept = [c for c in nodes.columns if c not in ("group", "place", "size")]
    found = nodes.groupBy("group", F.expr(f"place div {ARITY**STRIDE}").alias("block")).agg(
        F.max("size").alias("size"), F.sort_array(F.collect_list(F.struct("place", *kept))).alias("rows")
    )
    texts = F.transform("rows", lambda r: F.lower(F.hex(r["node"])))
    return found.withColumn("levels", _levels(texts, _height(F.col("size"))))


@dataclass(frozen=True)
class Tree:
    """levels[k]: nodes of level k * STRIDE (group, place, size, node as bytes); of the last one node is left per group."""

    levels: list[DataFrame]

    @property
    def roots(self) -> DataFrame:
        """group, root (hex)."""
        return self.levels[-1].select("group", F.lower(F.hex("node")).alias("root"))


def build(leaves: DataFrame, name: str = "merkle") -> Tree:
    """leaves (group, place, size, node) → the tree of each group; levels between the stored ones are not kept."""
    levels = [leaves]
    most = leaves.agg(F.max("size")).first()[0] or 0
    while most > 1:
        top = F.element_at(F.element_at("levels", -1), 1)
        above = _blocks(levels[-1].select("group", "place", "size", "node")).select(
            "group", F.col("block").alias("place"),
            F.expr(f"cast((size + {ARITY**STRIDE - 1}) div {ARITY**STRIDE} as long)").alias("size"), F.unhex(top).alias("node"),
        )
        levels.append(stored(above, f"{name}-{len(levels) * STRIDE}"))
        most = -(-most // ARITY**STRIDE)
    return Tree(levels)


def _steps(levels: Column, child: Column, height: Column) -> Column:
    """What stands before and after a child's ancestors in their runs, from its own level up."""

    def step(k: Column) -> Column:
        nodes = F.element_at(levels, k + 1)
        return let(
            F.floor(child / F.pow(F.lit(ARITY), k)).cast("int"),
            lambda at: F.struct(
                F.array_join(F.slice(nodes, at - at % ARITY + 1, at % ARITY), "").alias("before"),
                F.array_join(F.slice(nodes, at + 2, ARITY - 1 - at % ARITY), "").alias("after"),
            ),
        )

    return F.transform(_few(height), step).cast(_STEPS)


def proofs(tree: Tree, above: DataFrame | None = None) -> DataFrame:
    """tree → its leaves' rows with steps: (before, after) per level, the digests beside the node's ancestor as hex text.

    above (group, steps, ...): steps that follow those inside a group's tree, and columns that each of its leaves shall bear.
    Works downwards: nodes of a stored level take the steps of the node they lie under.
    """
    more = [] if above is None else [c for c in above.columns if c not in ("group", "steps")]
    if above is None:
        path = tree.levels[-1].select("group", "place", F.array().cast(_STEPS).alias("steps"))
    else:
        path = tree.levels[-1].select("group", "place").join(above, "group").select("group", "place", "steps", *more)
    if len(tree.levels) == 1:
        return tree.levels[0].join(path, ["group", "place"])
    for depth, nodes in reversed(list(enumerate(tree.levels[:-1]))):
        kept = [c for c in nodes.columns if c not in ("group", "place", "size")] if depth == 0 else []
        blocks = _blocks(nodes).join(path.withColumnRenamed("place", "block"), ["group", "block"])
        rows = blocks.select("group", "size", "levels", "steps", *more, F.posexplode("rows").alias("child", "row"))
        own = _steps(F.col("levels"), F.col("child"), _height(F.col("size")))
        path = rows.select("group", F.col("row.place").alias("place"), *[F.col(f"row.{c}") for c in kept], *more, F.concat(own, "steps").alias("steps"))
        if depth:
            path = stored(path, f"merkle-path-{depth}")
    return path


def proof_text(steps: Column) -> Column:
    """All siblings level by level, left to right."""
    return F.array_join(F.transform(steps, lambda s: F.concat(s["before"], s["after"])), "")


def folded(start: Column, steps: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(steps, start, lambda node, s: digest(s["before"], node, s["after"]))


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """docs (FIELDS and any other columns) → one row per document: doc_id, source, leaf, claimed, subroot, root, steps.

    tampered: the text to claim in place of a row's own (null: as it is, also where the text is null); claimed is the leaf it
    gives. Documents ascend by doc_id, null first, equal ones by leaf; rows repeated in full are leaves of their own. Null and
    empty texts, and null sources, are leaves as any other (`-` and `0:` differ). An empty table gives no rows. Other columns
    are not read, whatever they are called.
    """
    own = leaf()
    claim = own if tampered is None else F.when(tampered.isNull() | (tampered == F.col("text")), own).otherwise(leaf(tampered))
    rows = docs.select("doc_id", "source", group_of(F.col("source")).alias("group"), F.unhex(own).alias("node"), F.unhex(claim).alias("claim"))
    rows = rows.withColumn("claim", F.nullif("claim", "node"))  # most claims are the leaf
    trees = build(placed(rows, ["doc_id", "node"], "merkle-leaves"), "merkle")
    roots = trees.roots.select(F.lit("").alias("group"), F.col("group").alias("of"), F.unhex("root").alias("node"))
    top = build(placed(roots, ["of"], "merkle-sources"), "merkle-top")
    text = lambda node: F.lower(F.hex(node))
    above = proofs(top).join(F.broadcast(top.roots), "group")  # one row
    above = above.select(F.col("of").alias("group"), text("node").alias("subroot"), "root", "steps")
    found = proofs(trees, stored(above, "merkle-roots"))
    return found.select(
        "doc_id", "source", text("node").alias("leaf"), text(F.coalesce("claim", "node")).alias("claimed"), "subroot", "root", "steps"
    )


def verified(rows: DataFrame) -> DataFrame:
    """manifest rows → doc_id, leaf, subroot, root, proof_sha256, folded_root (from the claimed leaf), verified."""
    rows = rows.withColumn("folded_root", folded(F.col("claimed"), F.col("steps")))
    return rows.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(proof_text(F.col("steps")), 256).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )
