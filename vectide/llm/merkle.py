"""Merkle manifest of a table: a tree of hashes for each part, the parts' roots in a tree of their own, an inclusion proof for every row.

H is the lowercase hexadecimal SHA-256 of its inputs, one after the other; hashes are inputs as hexadecimal text. In a tree every two
consecutive nodes become one; a last node without a partner becomes the H of itself.

Superblocks: nodes are dealt by index // 2**k, so a block is a subtree whose lowest k levels no other block has a part in. A task on a
block collapses these levels at once; the blocks' roots are the nodes of the next round, until one is left. Proofs come down the same way: the
proof of a block's root is the upper part of the proofs of its nodes, whose lower parts are made again from the block. Blocks hold 2**k
rows at most, whatever part they are of, so neither a part of most rows nor the number of parts makes a task large; what is
broadcast or sent to the driver is one number a round.

A row's leaf holds all its columns, so rows that differ nowhere have equal leaves. Parts are ordered by name in UTF-8 bytes, null first;
rows by id, null first, then by leaf (equal rows in any order: their leaves are equal, their places are not). An empty
table gives an empty result; a table of one row has its leaf as root and an empty proof; columns of other names are not read.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vectide.llm.exchange import checkpointed, lean

BLOCK = 12  # levels of a superblock: 4,096 nodes
NODE = "g string, i long, n long, h binary"
ABOVE = "g string, b long, steps binary, subroot string, root string"
#: A step of a proof is one letter (the sibling is on the left, on the right, or there is none) and the sibling.
LEFT, RIGHT, ALONE = b"L", b"R", b"0"
STEP = 65


def field(c: Column) -> Column:
    """UTF-8 byte count, colon and value; a dash for null."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*columns: Column) -> Column:
    """H of a row as 32 bytes."""
    return F.unhex(F.sha2(F.concat(*[field(c) for c in columns]).cast("binary"), 256))


def _hash(data: bytes) -> bytes:
    return hashlib.sha256(data).hexdigest().encode()


def depth(n: int) -> int:
    """Levels above the lowest of a tree of n nodes."""
    return (n - 1).bit_length() if n > 1 else 0


def collapsed(nodes: list[bytes], levels: int) -> list[list[bytes]]:
    """The nodes (hexadecimal) and so many levels above them."""
    out = [nodes]
    for _ in range(levels):
        nodes = [_hash(nodes[j] + nodes[j + 1] if j + 1 < len(nodes) else nodes[j]) for j in range(0, len(nodes), 2)]
        out.append(nodes)
    return out


def steps_of(tree: list[list[bytes]], j: int) -> list[bytes]:
    """Steps from node j of the lowest level to the last level of tree."""
    out = []
    for level in tree[:-1]:
        other = j ^ 1
        out.append((LEFT if j & 1 else RIGHT) + level[other] if other < len(level) else ALONE)
        j >>= 1
    return out


def packed_steps(steps: list[bytes]) -> bytes:
    return b"".join(s.ljust(STEP, b" ") for s in steps)


def unpacked_steps(data: bytes) -> list[bytes]:
    return [data[a : a + STEP].rstrip(b" ") for a in range(0, len(data), STEP)]


def folded(own: bytes, steps: list[bytes]) -> bytes:
    """The root that a leaf and its siblings give."""
    for s in steps:
        own = _hash(s[1:] + own if s[:1] == LEFT else own + s[1:])
    return own


def numbered(nodes: DataFrame, group: str, order: list[str]) -> DataFrame:
    """nodes, kept in the checkpoint folder, with i (0, 1, ... within their group in the order of columns) and n (the group's rows).

    Rows are sorted over all tasks; only a count for each task and group is put in sequence.
    """
    # The sort is written before it is read twice: its ranges come from a sample, which another run would draw anew.
    rows = nodes.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    rows = checkpointed(rows.select("*", F.spark_partition_id().alias("task"), F.monotonically_increasing_id().alias("at")))
    counts = rows.groupBy(group, "task").agg(F.count("*").alias("own"), F.min("at").alias("first"))
    w = Window.partitionBy(group)
    before = F.coalesce(F.sum("own").over(w.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(group, "task", (before - F.col("first")).alias("shift"), F.sum("own").over(w).alias("n"))
    return checkpointed(rows.join(starts, [group, "task"]).withColumn("i", F.col("at") + F.col("shift")).drop("at", "shift", "task"))


def _blocks(nodes: DataFrame, k: int):
    return nodes.withColumn("b", F.shiftright("i", k)).groupBy("g", "b")


def _tree(pdf: pd.DataFrame, k: int) -> list[list[bytes]]:
    return collapsed([x.hex().encode() for x in pdf["h"]], min(k, depth(int(pdf["n"].iloc[0]))))


def _rounds(nodes: DataFrame, k: int) -> list[DataFrame]:
    """Nodes of every round, the last of which has one for each group; all in the checkpoint folder."""

    @lean
    def up(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        n = int(pdf["n"].iloc[0])
        root = bytes.fromhex(_tree(pdf, k)[-1][0].decode())
        return pd.DataFrame({"g": [pdf["g"].iloc[0]], "i": [int(pdf["i"].iloc[0]) >> k], "n": [-(-n >> k) if n else 0], "h": [root]})

    out = [nodes]
    while (out[-1].agg(F.max("n")).first()[0] or 0) > 1:
        out.append(checkpointed(_blocks(out[-1].select("g", "i", "n", "h"), k).applyInPandas(lambda t: up(t), NODE)))
    return out


def _descended(rounds: list[DataFrame], above: DataFrame, k: int) -> DataFrame:
    """Proofs of the nodes of the first of rounds from those of the last; above and the result as ABOVE, b being the node's index."""

    @lean
    def down(pdf: pd.DataFrame, upper: pd.DataFrame) -> pd.DataFrame:
        if pdf.empty or upper.empty:
            return pd.DataFrame({"g": [], "b": [], "steps": [], "subroot": [], "root": []})
        pdf = pdf.sort_values("i")
        tree, top = _tree(pdf, k), upper["steps"].iloc[0]
        steps = [packed_steps(steps_of(tree, j)) + top for j in range(len(pdf))]
        return pd.DataFrame({"g": pdf["g"], "b": pdf["i"], "steps": steps, "subroot": upper["subroot"].iloc[0], "root": upper["root"].iloc[0]})

    for nodes in reversed(rounds):
        above = _blocks(nodes.select("g", "i", "n", "h"), k).cogroup(above.groupBy("g", "b")).applyInPandas(lambda t, u: down(t, u), ABOVE)
    return above


def manifest(rows: DataFrame, leaf_col: str = "leaf", other_col: str | None = None, id_col: str = "doc_id", part_col: str = "lang", k: int = BLOCK) -> DataFrame:
    """id, leaf, subroot (of the row's part), root (of all), steps (the proof), proof_sha256 (H of its siblings), folded_root and verified.

    leaf_col holds 32 bytes a row. folded_root is what the proof makes of other_col where that isn't null (such as the leaf of a row that
    was changed since), else of the leaf; verified tells whether it is root.
    """
    other = F.col(f"`{other_col}`") if other_col else F.lit(None).cast("binary")
    group = F.coalesce(F.concat(F.lit("+"), F.col(f"`{part_col}`").cast("string")), F.lit(""))  # null comes first, then names by bytes
    nodes = checkpointed(rows.select(group.alias("g"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{leaf_col}`").alias("h"), other.alias("other")))
    leaves = numbered(nodes, "g", ["id", "h"])
    inner = _rounds(leaves, k)
    roots = numbered(inner[-1].select(F.lit("").alias("g"), F.col("g").alias("part"), "h"), "g", ["part"])
    outer = _rounds(roots, k)
    top = outer[-1].select("g", F.lit(0).cast("long").alias("b"), F.lit(b"").alias("steps"), F.lit("").alias("subroot"), F.lower(F.hex("h")).alias("root"))
    above = _descended(outer[:-1], top, k).select(F.col("b").alias("i"), "steps", "root")
    above = roots.join(above, "i").select(F.col("part").alias("g"), F.lit(0).cast("long").alias("b"), "steps", F.lower(F.hex("h")).alias("subroot"), "root")
    above = checkpointed(_descended(inner[1:-1], above, k))  # of the lowest blocks' roots

    @lean
    def finish(pdf: pd.DataFrame, upper: pd.DataFrame) -> pd.DataFrame:
        names = ["id", "leaf", "subroot", "root", "steps", "proof_sha256", "folded_root", "verified"]
        if pdf.empty or upper.empty:
            return pd.DataFrame({c: [] for c in names})
        pdf = pdf.sort_values("i")
        tree, top, root = _tree(pdf, k), unpacked_steps(upper["steps"].iloc[0]), upper["root"].iloc[0]
        leaves, out = tree[0], []
        for j, (i, other) in enumerate(zip(pdf["id"].tolist(), pdf["other"])):
            steps = steps_of(tree, j) + top
            got = folded(leaves[j] if other is None else other.hex().encode(), steps).decode()
            out.append((i, leaves[j].decode(), upper["subroot"].iloc[0], root, packed_steps(steps), _hash(b"".join(s[1:] for s in steps)).decode(), got, got == root))
        return pd.DataFrame(out, columns=names)

    schema = "id string, leaf string, subroot string, root string, steps binary, proof_sha256 string, folded_root string, verified boolean"
    low = leaves.select("g", "i", "n", "h", F.col("id").cast("string").alias("id"), "other")  # pandas would make nulls of numbers floats
    out = _blocks(low, k).cogroup(above.groupBy("g", "b")).applyInPandas(lambda t, u: finish(t, u), schema)
    return out.select(F.col("id").cast(dict(leaves.dtypes)["id"]).alias(id_col), "leaf", "subroot", "root", "steps", "proof_sha256", "folded_root", "verified")
