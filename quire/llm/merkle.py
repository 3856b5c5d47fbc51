"""Merkle manifest of a dataset: a hash tree per source, and one over the sources.

Trees are cut into superblocks of ``FAN ** SPAN`` nodes. A first pass reduces every superblock to
its top; the tops, far fewer, form the next tier, until one node of each tree remains. On the way
down the nodes outside a superblock that its proofs need are cogrouped with its leaves, and one
task per superblock finishes the local levels, joins both parts of each proof and folds them."""

from __future__ import annotations

from hashlib import sha256
from string import ascii_lowercase, ascii_uppercase

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import written

FAN, SPAN = 16, 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    """`-` for null, else the UTF-8 length, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(text: Column) -> Column:
    return F.sha2(F.concat(*[field(text if c == "text" else F.col(c)) for c in FIELDS]).cast("binary"), 256)


def tampered() -> Column:
    """Documents whose text is changed, by the hash of the id; a null id is not."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def digest(parts) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def levels(nodes: list[str], whole: bool) -> list[list[str]]:
    """The nodes of a superblock level by level: up to one node where it holds the whole tree,
    else all ``SPAN`` levels, the last run short where it must be."""
    out = [nodes]
    while len(out[-1]) > 1 if whole else len(out) <= SPAN:
        out.append([digest(out[-1][i : i + FAN]) for i in range(0, len(out[-1]), FAN)])
    return out


def steps(tree: list[list[str]], at: int) -> list[tuple[str, str]]:
    """What stands left and right of a node in its run, and of its ancestors, below the top."""
    out = []
    for nodes in tree[:-1]:
        lo = at - at % FAN
        out.append(("".join(nodes[lo:at]), "".join(nodes[at + 1 : lo + FAN])))
        at //= FAN
    return out


def fold(node: str, path: list[tuple[str, str]]) -> str:
    for left, right in path:
        node = digest((left, node, right))
    return node


def positioned(nodes: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """``nodes`` with ``pos``, the place in its tree, and ``size``, the nodes of the tree.

    Rows are dealt by ranges of (tree, order), so a tree of any size spreads over tasks; what is
    windowed by tree is one row a task and tree."""
    spark = nodes.sparkSession
    dealt = nodes.repartitionByRange(F.col(tree).asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in order])
    kept, _ = written(dealt.withColumn("__part", F.spark_partition_id()), "nodes")
    own = Window.partitionBy("__part", tree).orderBy(*[F.col(c).asc_nulls_first() for c in order])
    parts = kept.groupBy("__part", tree).agg(F.count("*").alias("__n"))
    whole = Window.partitionBy("__tree")
    before = whole.orderBy("__part_").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("__part").alias("__part_"), F.col(tree).alias("__tree"), "__n").withColumns(
        {"__before": F.coalesce(F.sum("__n").over(before), F.lit(0)), "size": F.sum("__n").over(whole)}
    )
    numbered = kept.withColumn("__at", F.row_number().over(own) - 1)
    joined = numbered.join(parts, (F.col("__part") == F.col("__part_")) & F.col(tree).eqNullSafe(F.col("__tree")))
    out = joined.select(*nodes.columns, (F.col("__before") + F.col("__at")).alias("pos"), "size")
    return written(out.withColumn("block", F.floor(F.col("pos") / FAN**SPAN).cast("long")), "placed")[0].select(*out.columns, "block")


def tops(placed: DataFrame, tree: str, kind: str) -> DataFrame:
    """One node per superblock: (tree, pos, node, size, block) of the next tier."""

    def reduce(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        tree_levels = levels(pdf["node"].tolist(), int(pdf["size"].iloc[0]) <= FAN**SPAN)
        return pd.DataFrame({tree: pdf[tree].iloc[:1], "pos": pdf["block"].iloc[:1], "node": [tree_levels[-1][0]], "size": -(-pdf["size"].iloc[:1] // FAN**SPAN)})

    up = placed.select(tree, "pos", "node", "size", "block").groupBy(tree, "block").applyInPandas(reduce, f"{tree} {kind}, pos long, node string, size long")
    return written(up.withColumn("block", F.floor(F.col("pos") / FAN**SPAN).cast("long")), "tops")[0]


PATH = "lefts array<string>, rights array<string>"


def exchange(placed: DataFrame, outer: DataFrame | None, tree: str, out: str, finish) -> DataFrame:
    """Cogroup the nodes of every superblock with the outer nodes that its proofs need, ``outer``
    (tree, block, lefts, rights), and call ``finish(nodes, paths, outer)`` with the joined path of each."""

    def join(pdf: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos").reset_index(drop=True)
        nodes = pdf["node"].tolist()
        local = levels(nodes, int(pdf["size"].iloc[0]) <= FAN**SPAN)
        rest = list(zip(above["lefts"].iloc[0], above["rights"].iloc[0])) if len(above) else []
        return finish(pdf, [steps(local, i) + rest for i in range(len(nodes))], above)

    if outer is None:
        outer = placed.select(tree, "block").limit(0).selectExpr("*", "cast(null as array<string>) as lefts", "cast(null as array<string>) as rights")
    return placed.groupBy(tree, "block").cogroup(outer.groupBy(tree, "block")).applyInPandas(join, out)


def paths(pdf: pd.DataFrame, found, tree: str) -> pd.DataFrame:
    return pd.DataFrame({tree: pdf[tree], "block": pdf["pos"], "lefts": [[a for a, _ in p] for p in found], "rights": [[b for _, b in p] for p in found]})


def climbed(placed: DataFrame, tree: str, kind: str) -> list[DataFrame]:
    """All tiers, from ``placed`` up to the one in which every tree is one superblock, and the
    roots after it."""
    tiers = [placed]
    while True:
        tiers.append(tops(tiers[-1], tree, kind))
        if tiers[-1].where("size > 1").limit(1).count() == 0:
            return tiers


def descended(tiers: list[DataFrame], outer: DataFrame | None, tree: str, kind: str) -> DataFrame | None:
    """Paths from the tops of the lowest tier to the root, (tree, block, lefts, rights). ``outer``
    holds the paths beyond the roots of the trees, with block 0."""
    for tier in reversed(tiers[1:-1]):
        found = exchange(tier, outer, tree, f"{tree} {kind}, block long, {PATH}", lambda pdf, p, _: paths(pdf, p, tree))
        outer = written(found, "paths")[0]
    return outer


def manifest(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) per row of ``docs``.

    Nulls hash as `-`; a null source is a tree of its own, first among the sources, and a null id
    stands before all ids. Rows with equal ids stand by leaf hash and each have a proof; an empty
    text is `0:`. Texts of any length are hashed whole where they are read and do not move. An
    empty table has no row. Columns beyond the five that are hashed are not read. A proof without
    siblings (a single document) is the hash of nothing."""
    kind = docs.schema["source"].dataType.simpleString()
    id_kind = docs.schema["doc_id"].dataType.simpleString()
    changed = F.when(tampered(), leaf(F.translate("text", ascii_uppercase, ascii_lowercase)))
    leaves = docs.select("doc_id", "source", leaf(F.col("text")).alias("node"), changed.alias("changed"))
    placed = positioned(leaves, "source", ["doc_id", "node"])
    tiers = climbed(placed, "source", kind)
    # The roots of the sources are the leaves of one more tree.
    roots = tiers[-1].select("source", F.col("node").alias("subroot"))
    seats = positioned(roots.select(F.lit(0).alias("one"), "source", F.col("subroot").alias("node")), "one", ["source"])
    upper = climbed(seats, "one", "int")
    ends = exchange(
        seats, descended(upper, None, "one", "int"), "one", f"source {kind}, block long, {PATH}, subroot string, root string",
        lambda pdf, p, _: paths(pdf, p, "source").assign(block=0, subroot=pdf["node"], root=[fold(n, q) for n, q in zip(pdf["node"], p)]),
    )
    ends, _ = written(ends, "ends")
    outer = descended(tiers, ends.select("source", "block", "lefts", "rights"), "source", kind)
    names = ends.select(F.col("source").alias("__source"), "subroot", "root")
    outer = outer.join(names, outer["source"].eqNullSafe(names["__source"])).drop("__source")

    def finish(pdf: pd.DataFrame, found, above: pd.DataFrame) -> pd.DataFrame:
        start = pdf["changed"].where(pdf["changed"].notna(), pdf["node"])
        return pd.DataFrame({
            "doc_id": pdf["doc_id"], "leaf": pdf["node"], "subroot": above["subroot"].iloc[0], "root": above["root"].iloc[0],
            "proof_sha256": [digest(a + b for a, b in p) for p in found],
            "folded_root": [fold(n, p) for n, p in zip(start, found)],
        })

    # Ids pass pandas as text: a null would turn whole numbers into floats there.
    given = placed.withColumn("doc_id", F.col("doc_id").cast("string"))
    proved = exchange(given, outer, "source", "doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string", finish)
    return proved.withColumns({"doc_id": F.col("doc_id").cast(id_kind), "verified": F.col("folded_root") == F.col("root")})
