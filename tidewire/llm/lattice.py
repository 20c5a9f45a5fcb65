"""Embedding near-duplicates by E8 lattice hashing.

Unit vectors are projected at random to ``BLOCKS`` times eight dimensions in each of ``TABLES`` tables, and each block
is decoded to its nearest point of the E8 lattice; the points make a vector's cell. A vector is looked up in its own
cell and in the neighbouring cells that its projection lies nearest to (``PROBES`` in all, over the products of the
blocks' 240 neighbours). Cosines of what meets are verified in double precision.

Equal vectors are one vector with a count. Tight groups are taken together as well: vectors that share a cell and lie
within half the linking angle of its least member are a ball, all of whose members link to one another, so those links
are counted and not listed. Cells hold balls; two balls that meet are compared member by member only if the angle
between their leaders leaves it possible that members link. No link is lost in a large group that way.

At a cosine of 0.9 a pair meets in one of the default tables with a probability of 0.98, at 0.95 of more than 0.9999.

Defined cases: a vector that is null or empty, is zero, or has null or non-finite components links with nothing, nor do
vectors of different lengths; every row is a vector, whether its id repeats or is null; a component's id is the smallest that is
not null, or null where all are, and rows of that id are kept; an empty table gives an empty result; further columns
are ignored.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import written
from tidewire.llm.components import connected_components

#: Tables, lattice blocks of a table, cells that are looked up in a table, and the scale of projections.
TABLES, BLOCKS, PROBES, SCALE = 16, 2, 8, 0.6
#: Tables whose cells give balls.
BALL_TABLES = 3


def _d8(x: np.ndarray) -> np.ndarray:
    """Nearest points with integer coordinates of an even sum."""
    near = np.rint(x)
    off = x - near
    odd = np.flatnonzero(near.sum(1) % 2)
    worst = np.abs(off[odd]).argmax(1)
    near[odd, worst] += np.where(off[odd, worst] >= 0, 1.0, -1.0)
    return near


def decode(x: np.ndarray) -> np.ndarray:
    """Nearest E8 points of rows of eight: the nearer of D8 and D8 moved by one half."""
    whole, half = _d8(x), _d8(x - 0.5) + 0.5
    return np.where((((x - whole) ** 2).sum(1) <= ((x - half) ** 2).sum(1))[:, None], whole, half)


def neighbours() -> np.ndarray:
    """The 240 least vectors of E8."""
    pairs = [np.eye(8)[i] * a + np.eye(8)[j] * b for i, j in itertools.combinations(range(8), 2) for a in (1, -1) for b in (1, -1)]
    halves = [np.array(s) for s in itertools.product((0.5, -0.5), repeat=8) if sum(v < 0 for v in s) % 2 == 0]
    return np.array(pairs + halves)


_NEXT = neighbours()


def cells(unit: np.ndarray, table: int, blocks: int = BLOCKS, probes: int = PROBES, scale: float = SCALE) -> np.ndarray:
    """Keys of the cells of a table that unit vectors are looked up in, the own one first: rows x probes."""
    n, dim = unit.shape
    rng = np.random.default_rng([table, dim])
    projected = unit @ rng.normal(size=(dim, 8 * blocks)) * scale
    factors = rng.integers(1, 2**63 - 1, size=8 * blocks, dtype=np.int64) | 1
    keys, costs = np.zeros((n, 1), dtype=np.int64), np.zeros((n, 1))
    for b in range(blocks):
        x = projected[:, 8 * b : 8 * b + 8]
        point = decode(x)
        cost = 2 - 2 * (x - point) @ _NEXT.T  # how much further off a neighbouring point is
        nearest = np.argpartition(cost, probes, axis=1)[:, :probes]
        offers = np.concatenate([point[:, None], point[:, None] + _NEXT[nearest]], axis=1)
        own = ((2 * offers).round().astype(np.int64) * factors[8 * b : 8 * b + 8]).sum(2)
        extra = np.concatenate([np.zeros((n, 1)), np.take_along_axis(cost, nearest, 1)], axis=1)
        keys = (keys[:, :, None] * 31 + own[:, None, :]).reshape(n, -1)
        costs = (costs[:, :, None] + extra[:, None, :]).reshape(n, -1)
        best = np.argsort(costs, axis=1, kind="stable")[:, :probes]
        keys, costs = np.take_along_axis(keys, best, 1), np.take_along_axis(costs, best, 1)
    mixed = (keys ^ (keys >> 29)) * np.int64(-4658895280553007687)
    return mixed ^ (mixed >> 32) ^ np.int64(table * 1_000_003)


def _lookups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for _, part in batch.groupby(batch["embedding"].map(len)):
            for start in range(0, len(part), 2048):
                some = part.iloc[start : start + 2048]
                unit = np.stack(some["embedding"].to_numpy()).astype(np.float64)
                unit /= np.linalg.norm(unit, axis=1, keepdims=True)
                for table in range(TABLES):
                    keys = cells(unit, table)
                    yield pd.DataFrame({"rep": np.repeat(some["rep"].to_numpy(), keys.shape[1]), "tab": np.int32(table), "probe": np.tile(np.arange(keys.shape[1], dtype=np.int32), len(some)), "cell": keys.ravel()})


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def _cosine(a: str, b: str) -> Column:
    return _dot(F.col(a), F.col(b)) / F.sqrt(_dot(F.col(a), F.col(a)) * _dot(F.col(b), F.col(b)))


def _valid(v: Column) -> Column:
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce((F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _component_type(df: DataFrame, column: str) -> str:
    """Type of the components of a vector column."""
    return df.schema[column].dataType.elementType.simpleString()


def _balls(reps: DataFrame, lookups: DataFrame, angle: float) -> DataFrame:
    """rep, leader, off (the angle between them): balls of the first tables' cells; a vector in none leads its own."""
    inside = math.cos(angle / 2)
    vectors = reps.select("rep", "embedding")
    found, left = None, reps.select("rep")
    for table in range(BALL_TABLES):
        own = lookups.filter((F.col("tab") == table) & (F.col("probe") == 0)).select("rep", "cell").join(left, "rep")
        leaders = written(own.groupBy("cell").agg(F.min("rep").alias("leader"), F.count("*").alias("n")).filter("n > 1").select("cell", "leader"), "leaders")
        offered = own.join(leaders, "cell").select("rep", "leader").join(vectors, "rep").join(vectors.select(F.col("rep").alias("leader"), F.col("embedding").alias("lead")), "leader")
        near = offered.select("rep", "leader", F.acos(F.least(F.lit(1.0), _cosine("embedding", "lead"))).alias("off")).filter(F.col("off") < math.acos(inside) - 1e-6)
        near = written(near, "balls")
        # a leader that nobody joins is free for the next table
        near = near.join(near.filter("rep <> leader").select("leader").distinct(), "leader", "left_semi").select("rep", "leader", "off")
        found = near if found is None else found.unionByName(near)
        left = written(left.join(near.select("rep"), "rep", "left_anti"), "left")
    return written(found.unionByName(left.select("rep", F.col("rep").alias("leader"), F.lit(0.0).alias("off"))), "balls")


def near_duplicates(embeddings: DataFrame, cosine: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, n_links (other vectors linked directly), component_id and kept for every vector."""
    angle = math.acos(cosine)
    rows = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding"))
    rows = written(rows.withColumn("valid", _valid(F.col("embedding"))), "vectors")
    valid = rows.filter("valid").select("vec_id", F.transform("embedding", lambda x: x + F.lit(0.0).cast(_component_type(embeddings, vector_col))).alias("embedding"))
    distinct = valid.groupBy("embedding").agg(F.min("vec_id").alias("least_id"), F.count("*").alias("copies"))
    reps = written(distinct.withColumn("rep", F.monotonically_increasing_id()), "distinct-vectors")  # the number holds as it is written
    lookups = written(reps.select("rep", "embedding").mapInPandas(_lookups, "rep long, tab int, probe int, cell long"), "lookups")
    members = _balls(reps, lookups, angle)
    placed = lookups.join(members.select("rep", "leader"), "rep")
    own = placed.filter("probe = 0").select("cell", "tab", F.col("leader").alias("l1")).distinct()
    asked = placed.select("cell", "tab", F.col("leader").alias("l2")).distinct()
    met = own.join(asked, ["cell", "tab"]).filter("l1 <> l2").select(F.least("l1", "l2").alias("l1"), F.greatest("l1", "l2").alias("l2")).distinct()
    # leaders' vectors, and how far from them members lie
    balls = members.groupBy("leader").agg(F.max("off").alias("reach")).join(reps.select(F.col("rep").alias("leader"), "embedding"), "leader")
    left, right = balls.select(F.col("leader").alias("l1"), F.col("embedding").alias("e1"), F.col("reach").alias("r1")), balls.select(F.col("leader").alias("l2"), F.col("embedding").alias("e2"), F.col("reach").alias("r2"))
    near = met.join(left, "l1").join(right, "l2").filter(F.size("e1") == F.size("e2"))
    near = written(near.filter(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), _cosine("e1", "e2")))) <= F.lit(angle + 1e-9) + F.col("r1") + F.col("r2")).select("l1", "l2"), "near-balls")
    full = members.join(reps, "rep").select("leader", "rep", "embedding", "copies")
    one, two = full.select(F.col("leader").alias("l1"), F.col("rep").alias("a"), F.col("embedding").alias("e1"), F.col("copies").alias("n1")), full.select(F.col("leader").alias("l2"), F.col("rep").alias("b"), F.col("embedding").alias("e2"), F.col("copies").alias("n2"))
    links = written(near.join(one, "l1").join(two, "l2").filter(_cosine("e1", "e2") >= cosine).select("a", "b", "n1", "n2"), "links")
    across = links.select(F.col("a").alias("rep"), F.col("n2").alias("n")).union(links.select("b", "n1")).groupBy("rep").agg(F.sum("n").alias("across"))
    ball_size = members.join(reps.select("rep", "copies"), "rep").groupBy("leader").agg(F.sum("copies").alias("ball"))
    edges = links.select("a", "b").union(members.select(F.col("rep").alias("a"), F.col("leader").alias("b")))
    component = written(connected_components(edges), "components")
    named = component.join(reps.select(F.col("rep").alias("node"), "least_id"), "node").groupBy("component").agg(F.min("least_id").alias("component_id"))
    component = component.join(named, "component").select("node", F.col("component_id").alias("component"))
    summed = members.join(ball_size, "leader").join(across, "rep", "left").join(component.withColumnRenamed("node", "rep"), "rep")
    summed = summed.select("rep", (F.col("ball") - 1 + F.coalesce("across", F.lit(0))).alias("n_links"), "component")
    of = valid.join(reps.select("embedding", "rep"), "embedding").select("vec_id", "rep").join(written(summed, "summed"), "rep").select("vec_id", "n_links", F.col("component").alias("component_id"))
    alone = rows.filter("not valid").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return of.unionByName(alone).select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
