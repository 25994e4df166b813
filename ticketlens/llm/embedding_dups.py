"""Embedding near-dedup by sorted projection passes.

Each pass gives every vector a key of concatenated random hashes (signs of
random projections), sorts the vectors by key and compares each with the next
``window`` in that order; pairs whose cosine reaches the threshold are united,
within and across passes.  Near vectors agree on a long prefix of some pass's
key and so come close together in it.  A pass is a range partitioning, so its
tasks are even however the vectors cluster; the rows at the borders of
neighbouring partitions are compared in a second, small step.

Exact copies are one vector with a count.  A dense group holds more links
than windows can show, so the members of each component are then compared
with each other, in blocks of bounded size, and their links counted exactly.

The first passes are as many as evenly spread keys need.  Keys crowd where
many vectors point the same way, so each pass also measures, for every vector,
the prefix length at which all vectors that share it lie in the window.  From
these lengths follows the probability that a pair at the threshold was seen in
some pass; vectors below ``recall`` go through more passes with wider windows,
until all have reached it.  Where that would cost as much as comparing the
remaining vectors with each other (few vectors, or a group so dense that no
key parts it), they are compared with each other, in blocks, exactly.

Defined results: vectors that are null, empty, zero, or hold null or
non-finite components link with nothing; vectors of different lengths are
never compared; repeated rows link with each other.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, stored
from .components import connected_components

WINDOW = 32
KEY_BITS = 62
#: The window of the passes over vectors in crowded places.
WIDE = 512
#: Remaining vectors that are compared with each other without more passes.
PAIRS = 16384
#: Passes over crowded vectors before the crowding is measured anew.
LEAST_PASSES, MOST_PASSES = 8, 64
#: Members compared with each other in one group.
BLOCK = 1024
#: Kinds of rows that a pass returns.
LINK, BORDER, CREDIT = 0, 1, 2
_EDGE = "kind int, a bigint, b bigint, border bigint, pass int, dim int, vec binary, credit double"


def passes_for(n: int, threshold: float, window: int, recall: float) -> int:
    """Passes so that a pair at the threshold shares, in one of them, the
    log2(n / window) leading bits that bring it into one window."""
    agree = 1 - math.acos(threshold) / math.pi
    once = agree ** max(1.0, math.log2(max(2.0, 2 * n / window)))
    return max(4, math.ceil(math.log(1 - recall) / math.log(1 - once)))


def _projections(dim: int, number: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim, number]).standard_normal((KEY_BITS, dim))


def _unit(blobs) -> np.ndarray:
    x = np.stack([np.frombuffer(v, np.float64) for v in blobs])
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _keyed(first: int, passes: int, seed: int):
    weigh = (1 << np.arange(KEY_BITS - 1, -1, -1)).astype(np.int64)

    def run(batches):
        for batch in batches:
            for dim, rows in batch.groupby("dim"):
                x = np.stack([np.asarray(v, np.float64) for v in rows["vec"]])
                blobs = [v.tobytes() for v in x]
                for p in range(first, first + passes):
                    key = ((x @ _projections(int(dim), p, seed).T) > 0) @ weigh
                    yield pd.DataFrame({"pass": np.int32(p), "dim": np.int32(dim), "key": key,
                                        "node": rows["node"].to_numpy(), "vec": blobs})
    return run


class _Union:
    """Links of one task, thinned to a forest."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, a: int) -> int:
        while (b := self.up.get(a, a)) != a:
            self.up[a] = a = self.up.get(b, b)
        return a

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def frame(self) -> pd.DataFrame:
        ends = [(a, self.root(a)) for a in list(self.up)]
        return _frame(LINK, [a for a, _ in ends], [b for _, b in ends])


def _frame(kind: int, a, b, border=None, number=None, dim=None, vec=None, credit=None) -> pd.DataFrame:
    n = len(a)
    return pd.DataFrame({"kind": np.full(n, kind, np.int32), "a": pd.array(a, "Int64"), "b": pd.array(b if b is not None else [None] * n, "Int64"),
                         "border": pd.array(border if border is not None else [None] * n, "Int64"),
                         "pass": pd.array(number if number is not None else [None] * n, "Int32"),
                         "dim": pd.array(dim if dim is not None else [None] * n, "Int32"),
                         "vec": vec if vec is not None else [None] * n,
                         "credit": pd.array(credit if credit is not None else [None] * n, "Float64")})


def _shared_bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Leading bits that two keys have in common."""
    x = a ^ b
    high = x >> 31
    used = np.where(high > 0, 31 + np.frexp(high.astype(float))[1], np.frexp(x.astype(float))[1])
    return KEY_BITS - used


def _credits(key: np.ndarray, window: int, opens: bool, closes: bool, agree: float) -> np.ndarray:
    """What a pass adds to -log(probability that a pair at the threshold is
    missed), for each of a sorted run of keys.  A vector that shares more bits
    than the rows at the window's ends lies inside the window.  Where the
    partition ends within the window, its last row stands for what follows."""
    n, at = len(key), np.arange(len(key))
    before = _shared_bits(key, key[np.maximum(at - window, 0)])
    after = _shared_bits(key, key[np.minimum(at + window, n - 1)])
    if opens:
        before[:window] = -1
    if closes:
        after[max(0, n - window):] = -1
    bits = 1 + np.maximum(before, after)
    credit = np.minimum(-np.log1p(-np.minimum(agree ** bits, 1 - 1e-12)), 50.0)
    return np.where(bits > KEY_BITS, 0.0, credit)


def _windows(window: int, threshold: float):
    def run(batches):
        at = TaskContext.get().partitionId()
        agree = 1 - math.acos(threshold) / math.pi
        found, head, tail, keys = _Union(), None, None, []
        for batch in batches:
            keys.append(batch[["pass", "dim", "key", "node"]])
            batch = batch.drop(columns="key")
            rows = batch if tail is None else pd.concat([tail, batch], ignore_index=True)
            for _, part in rows.groupby(["pass", "dim"], sort=False):
                _compare(part, window, threshold, found)
            head = rows if head is None else head
            if len(head) < window:
                head = rows
            head = head.iloc[:window]
            tail = rows.iloc[-window:]
        yield found.frame()
        if keys:
            runs = [g for _, g in pd.concat(keys, ignore_index=True).groupby(["pass", "dim"], sort=False)]
            for i, run in enumerate(runs):
                credit = _credits(run["key"].to_numpy(), window, i > 0, i < len(runs) - 1, agree)
                yield _frame(CREDIT, run["node"].to_numpy(), None, credit=credit)
        # the first rows meet the previous partition's last rows, and so on
        for side, border in ((head, at - 1), (tail, at)):
            if side is not None:
                yield _frame(BORDER, side["node"], side["node"] * 0 + (0 if border == at else 1), [border] * len(side),
                             side["pass"], side["dim"], list(side["vec"]))
    return run


def _compare(rows: pd.DataFrame, window: int, threshold: float, found: _Union) -> None:
    """Each row with the ``window`` rows after it."""
    node = rows["node"].to_numpy()
    x = _unit(rows["vec"])
    step = 256
    for i in range(0, len(node), step):
        near = x[i:i + step] @ x[i:i + step + window].T
        ahead = np.arange(near.shape[1])[None, :] - np.arange(near.shape[0])[:, None]
        _unite((near >= threshold) & (ahead > 0) & (ahead <= window), node[i:i + step], node[i:i + step + window], found)


def _unite(near: np.ndarray, left: np.ndarray, right: np.ndarray, found: _Union) -> None:
    """Join each left node with the right nodes marked in its row; right
    nodes that have been joined with each other count once."""
    group = np.arange(len(right))
    for a in np.flatnonzero(near.any(axis=1)):
        groups, first = np.unique(group[near[a]], return_index=True)
        for q in right[np.flatnonzero(near[a])[first]].tolist():
            found.join(int(left[a]), q)
        if len(groups) > 1:
            group[np.isin(group, groups)] = groups[0]


def _border(threshold: float):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        found = _Union()
        for _, part in rows.groupby(["pass", "dim"]):
            x, node, side = _unit(part["vec"]), part["a"].to_numpy(), part["b"].to_numpy()
            left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            if len(left) and len(right):
                _unite(x[left] @ x[right].T >= threshold, node[left], node[right], found)
        return found.frame()[["a", "b"]]
    return run


def _all_pairs(threshold: float):
    """Block i with block j, or a block with itself."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        found = _Union()
        for _, part in rows.groupby("dim"):
            x, node = _unit(part["vec"]), part["node"].to_numpy()
            left, right = np.flatnonzero(part["mine"] == part["i"]), np.flatnonzero(part["mine"] == part["j"])
            for at in range(0, len(left), 256):
                if len(right):
                    a = left[at:at + 256]
                    _unite(x[a] @ x[right].T >= threshold, node[a], node[right], found)
        return found.frame()[["a", "b"]]
    return run


def _each_with_each(rows: DataFrame, n: int, threshold: float) -> DataFrame:
    """Links of ``rows(node, dim, vec)`` among each other, all of them compared."""
    blocks = math.ceil(n / min(max(BLOCK, n // 16), 8 * BLOCK))
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    each = (rows.select("node", "dim", _blob("vec").alias("vec"), F.pmod(F.xxhash64("node"), F.lit(blocks)).cast("int").alias("mine"))
            .withColumn("other", other))
    return (each.select("node", "dim", "vec", "mine", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))
            .groupBy("i", "j").applyInPandas(_all_pairs(threshold), "a bigint, b bigint"))


def _counted(threshold: float):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, part in rows.groupby(["component", "dim"]):
            x, node, left = _unit(part["vec"]), part["node"].to_numpy(), part["left"].to_numpy()
            a, b = np.flatnonzero(left), np.flatnonzero(~left)
            near = x[a] @ x[b].T >= threshold
            near &= node[a][:, None] != node[b][None, :]
            out.append(pd.DataFrame({"node": node[a], "links": near @ part["copies"].to_numpy()[b]}))
        return pd.concat(out, ignore_index=True)
    return run


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding",
                    threshold: float = 0.95, window: int = WINDOW, recall: float = 0.995,
                    seed: int = 5) -> DataFrame:
    """``vec_id, n_links, component_id, kept``, one row per input row."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).cast("array<double>").alias("vec"))
    finite = F.forall("vec", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))   # NaN is above all
    norm = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x)
    valid = F.coalesce(finite & (norm > 0) & (norm < float("inf")), F.lit(False))
    # two independent 64-bit hashes name a vector
    rows = rows.withColumn("valid", valid).withColumns({
        "k1": F.when(F.col("valid"), F.xxhash64(F.lit(1), "vec")),
        "k2": F.when(F.col("valid"), F.xxhash64(F.lit(2), "vec"))})
    nodes = stored(rows.where("valid").groupBy("k1", "k2").agg(
        F.min("vec_id").alias("first_id"), F.count("*").alias("copies"), F.any_value("vec").alias("vec"))
        .select("k1", "k2", "first_id", "copies", "vec", F.size("vec").alias("dim"),
                F.monotonically_increasing_id().alias("node")), "vectors")
    n = nodes.count()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    scratch = Scratch(spark)
    links, left, passes = [], n, passes_for(max(n, 2), threshold, window, recall)
    active = nodes.select("node", "dim", "vec", F.lit(0.0).alias("credit"))
    wanted, width, first = -math.log(1 - recall), window, 0
    while left:
        # every partition holds several windows
        even = max(1, min(parts, left * passes // (4 * width)))
        compared = scratch.stored(_compared(active, even, first, passes, width, threshold, seed), f"windows-{first}")
        links += [compared.where(F.col("kind") == LINK).select("a", "b"),
                  compared.where((F.col("kind") == BORDER) & (F.col("border") >= 0)).groupBy("border")
                  .applyInPandas(_border(threshold), "a bigint, b bigint")]
        gained = compared.where(F.col("kind") == CREDIT).groupBy(F.col("a").alias("node")).agg(F.sum("credit").alias("gained"))
        active = scratch.stored(active.join(gained, "node").withColumn("credit", F.col("credit") + F.col("gained"))
                                .where(F.col("credit") < wanted), f"crowded-{first}")
        left, slow = active.agg(F.count("*"), F.percentile_approx("gained", 0.1)).first()
        needed = math.ceil(wanted * passes / max(slow or 0.0, 1e-9))
        if left and (left <= PAIRS or (width > window and needed * width >= left / 2)):
            links.append(_each_with_each(active, left, threshold))
            break
        first += passes
        active, width, passes = active.drop("gained"), max(window, WIDE), max(LEAST_PASSES, min(MOST_PASSES, needed))
    links = links or [spark.createDataFrame([], "a bigint, b bigint")]
    found = connected_components(reduce(DataFrame.unionByName, links), "vector-components")

    scratch.clear()

    # exact link counts inside each component
    member = nodes.join(found.withColumnRenamed("id", "node"), "node", "left").withColumn(
        "component", F.coalesce("component", "node"))
    sizes = scratch.stored(member.groupBy("component").agg(
        F.count("*").alias("members"), F.min("first_id").alias("component_id")), "vector-sizes")
    member = scratch.stored(member.join(sizes, "component"), "vector-members")
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("node"), blocks).cast("int")
    small = F.pmod(F.xxhash64("component"), F.lit(max(1, n // BLOCK)))
    each = (member.where("members > 1").withColumn("blocks", blocks).withColumn("mine", mine)
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))))
    home = F.when(F.col("blocks") == 1, small).otherwise(F.col("component"))
    side = lambda left: each.select(
        home.alias("home"), (F.col("blocks") > 1).alias("split"), F.when(F.lit(left), F.col("mine")).otherwise(F.col("other")).alias("i"),
        F.when(F.lit(left), F.col("other")).otherwise(F.col("mine")).alias("j"),
        F.lit(left).alias("left"), "component", "node", "dim", "copies", _blob("vec").alias("vec"))
    links = (side(True).unionByName(side(False)).groupBy("home", "split", "i", "j")
             .applyInPandas(_counted(threshold), "node bigint, links bigint")
             .groupBy("node").agg(F.sum("links").alias("links")))
    done = stored(member.select("k1", "k2", "node", "copies", "component_id").join(links, "node", "left").select(
        "k1", "k2", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "vector-links")
    scratch.clear()
    out = rows.select("vec_id", "k1", "k2").join(done, ["k1", "k2"], "left")
    component = F.when(F.col("k1").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"),
                      F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def _compared(active: DataFrame, parts: int, first: int, passes: int, window: int, threshold: float, seed: int) -> DataFrame:
    keyed = active.select("node", "dim", "vec").mapInPandas(
        _keyed(first, passes, seed), "pass int, dim int, key bigint, node bigint, vec binary")
    order = ["pass", "dim", "key", "node"]
    return (keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order)
            .select("pass", "dim", "key", "node", "vec").mapInPandas(_windows(window, threshold), _EDGE))


@F.pandas_udf(T.BinaryType())
def _blob(vectors: pd.Series) -> pd.Series:
    return pd.Series([np.asarray(v, np.float64).tobytes() for v in vectors], dtype=object)
