"""Normals turned to agree along a spanning forest of the neighbour graph.

Neighbours whose normals are nearly parallel are joined first: the forest is minimal for the weight 1 - |n . n'|. It
grows by rounds in which every tree takes its lightest edge out (so trees at least halve in number), and what is
kept of a tree is only each point's sign against its tree. Trees joined in chains find their new tree by doubling
their pointers, signs multiplied along, so a round costs a fixed number of shuffles and rounds follow the
logarithm of the points. Edges inside a tree drop out of the next round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..iterate import durable

NORMAL = ("nx", "ny", "nz")


def weighted(points: DataFrame, pairs: DataFrame, key: str = "point_id") -> DataFrame:
    """(a, b, weight, sign) once for each pair(point, other) of neighbours, a < b; sign is -1 where the normals disagree."""
    ends = pairs.where("point <> other").select(F.least("point", "other").alias("a"), F.greatest("point", "other").alias("b")).distinct()
    for e in "ab":
        ends = ends.join(points.select(F.col(key).alias(e), *(F.col(n).alias(f"{e}{n}") for n in NORMAL)), e)
    dot = g.dot([F.col(f"a{n}") for n in NORMAL], [F.col(f"b{n}") for n in NORMAL])
    return ends.select("a", "b", (1.0 - F.abs(dot)).alias("weight"), F.when(dot < 0, -1).otherwise(1).alias("sign"))


def spanning_signs(points: DataFrame, edges: DataFrame, key: str = "point_id") -> DataFrame:
    """(key, tree, sign): each point's tree in the minimum spanning forest of edges(a, b, weight, sign), named by one of its
    points, and the product of the signs on the way there. Of edges of one weight that with the smaller ids is lighter."""
    trees = durable(points.select(F.col(key).alias("p"), F.col(key).alias("tree"), F.lit(1).alias("sign")), "trees")
    edges = durable(edges, "graph")
    while True:
        for e in "ab":
            edges = edges.join(trees.select(F.col("p").alias(e), F.col("tree").alias(f"{e}_tree"), F.col("sign").alias(f"{e}_sign")), e)
        outer = durable(edges.where("a_tree <> b_tree"), "graph")
        if not outer.take(1):
            return trees.withColumnRenamed("p", key)
        across = F.col("sign") * F.col("a_sign") * F.col("b_sign")
        both = outer.select(F.col("a_tree").alias("tree"), F.struct("weight", "a", "b", F.col("b_tree").alias("to"), across.alias("s")).alias("edge")).unionByName(
            outer.select(F.col("b_tree").alias("tree"), F.struct("weight", "a", "b", F.col("a_tree").alias("to"), across.alias("s")).alias("edge")))
        hooks = both.groupBy("tree").agg(F.min("edge").alias("edge")).select("tree", F.col("edge.to").alias("to"), F.col("edge.s").alias("s"))
        # two trees that take the same edge point at one another: the smaller becomes the root
        back = hooks.select(F.col("tree").alias("to"), F.col("to").alias("back"))
        hooks = hooks.join(back, "to", "left").select("tree", F.when((F.col("back") == F.col("tree")) & (F.col("tree") < F.col("to")), F.col("tree")).otherwise(F.col("to")).alias("to"), "s")
        hooks = durable(hooks.withColumn("s", F.when(F.col("to") == F.col("tree"), 1).otherwise(F.col("s"))), "hooks")
        while True:
            jumped = durable(_jump(_jump(hooks).drop("moved")), "hooks")
            hooks = jumped.drop("moved")
            if not jumped.where("moved").take(1):
                break
        moved = trees.join(hooks, "tree", "left").select("p", F.coalesce("to", "tree").alias("tree"), (F.col("sign") * F.coalesce("s", F.lit(1))).alias("sign"))
        trees = durable(moved, "trees")
        edges = outer.select("a", "b", "weight", "sign")


def _jump(hooks: DataFrame) -> DataFrame:
    """Each tree's pointer led on to where the tree it points at points, signs multiplied."""
    further = hooks.select(F.col("tree").alias("to"), F.col("to").alias("then"), F.col("s").alias("more"))
    return hooks.join(further, "to").select("tree", F.col("then").alias("to"), (F.col("s") * F.col("more")).alias("s"), (F.col("then") != F.col("to")).alias("moved"))


def orient(points: DataFrame, pairs: DataFrame, key: str = "point_id") -> DataFrame:
    """points(key, x, y, z, nx, ny, nz) with normals that agree along the forest of the pairs(point, other).

    In each tree the highest point (of equal ones that with the smallest id) has its normal turned up, nz >= 0. A point
    without a pair is a tree of its own; a null normal stays null and joins no tree."""
    known = points.where(" and ".join(f"{n} is not null" for n in NORMAL))
    signs = spanning_signs(known, weighted(known, pairs, key), key)
    placed = known.select(key, "z", "nz").join(signs, key)
    top = F.max_by(F.struct("nz", "sign"), F.struct("z", -F.col(key))).alias("top")
    roots = placed.groupBy("tree").agg(top)
    up = F.when(F.col("top.nz") * F.col("top.sign") < 0, -1).otherwise(1)
    turned = signs.join(roots.select("tree", up.alias("up")), "tree").select(key, (F.col("sign") * F.col("up")).alias("turn"))

    def side(n: str) -> Column:
        return (F.col(n) * F.coalesce("turn", F.lit(1))).alias(n)

    return points.join(turned, key, "left").select(*(side(c) if c in NORMAL else F.col(c) for c in points.columns))
