"""How filters interact: what each of them removes at each step of every order in which they can be applied, and its Shapley value.

Rows become a mask of the filters they fail; counts of rows by part and mask (the cells) are all that the audit needs, 2**filters a
part at most, summed before and after the one shuffle. The orders are walked by adjacent transpositions (plain changes): each next order
swaps two neighbours, so only these two steps are counted again, from the cells; what a filter removes is added up along the walk.

A document fails A with too few words, B with too few distinct ones, C with too many capitals, D with one of some characters, E
where a smaller id has the same text. Null texts are empty; texts without words fail A only, beside D and E; among rows of one id and text none is smaller than
another; a null id is neither smaller nor larger than another, and has no labels; repeated rows count each; an id labelled twice is
good (toxic) if any label says so; a null part is the empty one; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectide.llm.exchange import lean

LETTERS = "ABCDE"
#: Bounds of the filters A, B and C, in words and percent, and the characters of D.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, ODD = 200, 50, 2, r"[#$%&*|]"
COUNTS = ["kept", "removed", "redundant", "good_lost", "toxic_lost"]


def fail_masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """id, part, mask (bit k: fails filter k of LETTERS) and n, the number of such rows.

    Texts are compared by SHA-256. The least id of each text is joined back by text and id, of which one document has each, so a
    text that many documents share makes no task large.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"), text.alias("t"))
    rows = rows.withColumn("l", F.array_remove(F.split("t", r"[\x20\x09-\x0D]+"), ""))
    words, distinct = F.size("l"), F.size(F.array_distinct("l"))
    capitals = F.length("t") - F.length(F.regexp_replace("t", "[A-Z]+", ""))
    fails = [words < LEAST_WORDS, 100 * distinct < LEAST_DISTINCT * words, 100 * capitals > MOST_CAPITALS * F.length("t"), F.col("t").rlike(ODD)]
    mask = sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails)), F.lit(0))
    rows = rows.select("id", "part", F.unhex(F.sha2(F.col("t").cast("binary"), 256)).alias("text"), mask.alias("mask"))
    rows = rows.groupBy("id", "text", "part", "mask").agg(F.count("*").alias("n"))
    least = rows.groupBy("text").agg(F.min("id").alias("id")).where("id is not null").withColumn("least", F.lit(True))
    again = F.when(F.col("least").isNull() & F.col("id").isNotNull(), 1 << 4).otherwise(0)
    return rows.join(least, ["id", "text"], "left").select("id", "part", (F.col("mask") + again).alias("mask"), "n")


def cells(masks: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """part, mask, n, good and toxic rows of each part and mask."""
    said = labels.groupBy(F.col(f"`{id_col}`").cast("long").alias("id")).agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    rows = masks.join(said, "id", "left")
    return rows.groupBy("part", "mask").agg(F.sum("n").alias("n"), *[F.sum(F.coalesce(F.col(c), F.lit(0)) * F.col("n")).alias(c) for c in ("good", "toxic")])


def swaps(n: int) -> Iterator[int]:
    """Places p of the swaps (p, p + 1) that lead through all orders of n things, each once: the largest thing that can move does so."""
    order, step = list(range(n)), [-1] * n
    while True:
        at = {v: k for k, v in enumerate(order)}
        free = [v for v in order if 0 <= at[v] + step[v] < n and order[at[v] + step[v]] < v]
        if not free:
            return
        v = max(free)
        a, b = sorted((at[v], at[v] + step[v]))
        order[a], order[b] = order[b], order[a]
        for w in range(v + 1, n):
            step[w] = -step[w]
        yield a


def walked(n: np.ndarray, good: np.ndarray, toxic: np.ndarray, k: int) -> tuple[list[list[int]], np.ndarray, np.ndarray]:
    """Orders of k filters; counts (part, order, step, COUNTS) and Shapley sums (part, filter), from counts by part and mask."""
    fails = [np.arange(1 << k) >> f & 1 == 1 for f in range(k)]

    def step(order: list[int], p: int) -> np.ndarray:
        gone = np.any([fails[f] for f in order[:p]], axis=0) if p else np.zeros(1 << k, bool)
        here, both = fails[order[p]] & ~gone, fails[order[p]] & gone
        return np.stack([n[:, ~(gone | here)].sum(1), n[:, here].sum(1), n[:, both].sum(1), good[:, here].sum(1), toxic[:, here].sum(1)], 1)

    order = list(range(k))
    now = np.stack([step(order, p) for p in range(k)], 1)
    orders, counts, shapley = [], [], np.zeros((len(n), k), np.int64)
    for p in [None, *swaps(k)]:
        if p is not None:
            order[p], order[p + 1] = order[p + 1], order[p]
            now[:, p], now[:, p + 1] = step(order, p), step(order, p + 1)
        orders.append(order.copy())
        counts.append(now.copy())
        shapley[:, order] += now[:, :, 1]
    return orders, np.stack(counts, 1), shapley


def audit(cell_counts: DataFrame, letters: str = LETTERS, parts: int = 128) -> DataFrame:
    """part, filter_order, step, COUNTS, unique_fails and shapley, from cells(): factorial(filters) * filters rows a part."""
    k = len(letters)

    @lean
    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, parts):  # so many parts at a time
                some = batch.slice(a, parts)
                cell = some.column("cell")
                of, flat = np.repeat(np.arange(some.num_rows), cell.value_lengths().to_numpy()), cell.flatten()
                counts = np.zeros((3, some.num_rows, 1 << k), np.int64)
                mask = flat.field("mask").to_numpy()
                for c, name in zip(counts, ("n", "good", "toxic")):
                    c[of, mask] = flat.field(name).to_numpy()
                orders, got, shapley = walked(*counts, k)
                m, f = len(orders), np.array(orders).ravel()
                names = np.repeat(["".join(letters[x] for x in o) for o in orders], k)
                cols = {"part": some.column("part").take(pa.array(np.repeat(np.arange(some.num_rows), m * k))), "filter_order": np.tile(names, some.num_rows), "step": np.tile(np.arange(1, k + 1, dtype="i4"), some.num_rows * m)}
                cols |= {name: got[..., x].ravel() for x, name in enumerate(COUNTS)}
                cols |= {"unique_fails": counts[0][:, 1 << f].ravel(), "shapley": shapley[:, f].ravel()}
                yield pa.RecordBatch.from_pydict(cols)

    cell = F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cell")  # 2**k a part at most
    schema = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in [*COUNTS, "unique_fails", "shapley"])
    return cell_counts.groupBy("part").agg(cell).mapInArrow(run, schema)
