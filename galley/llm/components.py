"""Connected components by randomised contraction: rounds of joins whose tables shrink by a constant factor."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def connected_components(edges: DataFrame, most_rounds: int = 200) -> DataFrame:
    """(v, label) for every end of the edges (u, v): equal labels within a component, different ones between them.

    In a round every vertex moves to the neighbour, itself included, that comes first in an order drawn anew for the
    round, and the edges between vertices that moved to the same one go.  A hub's neighbours meet in a partial
    aggregate; nothing is gathered by component.
    """
    way = lambda a, b: F.struct(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v"))
    both_ways = edges.where("u <> v").select(F.explode(F.array(way("u", "v"), way("v", "u"))).alias("e"))  # edges are made once
    links = materialize(both_ways.select("e.*").distinct(), "links")
    moves: list[DataFrame] = []
    for k in range(most_rounds):
        if links.isEmpty():
            break
        rank = lambda c: F.struct(F.xxhash64(F.lit(k), F.col(c)).alias("r"), F.col(c).alias("id"))
        first = links.groupBy("u").agg(F.min(rank("v")).alias("m"))
        move = materialize(first.select("u", F.least(F.col("m"), rank("u"))["id"].alias("to")), "moves")
        moves.append(move)
        left = links.join(move, "u").select(F.col("to").alias("u"), "v")
        both = left.join(move.select(F.col("u").alias("v"), F.col("to").alias("w")), "v").select("u", F.col("w").alias("v"))
        links = materialize(both.where("u <> v").distinct(), "links")
    else:
        raise RuntimeError(f"not contracted after {most_rounds} rounds")
    if not moves:
        return links.select(F.col("u").alias("v"), F.col("v").alias("label"))
    out = moves[-1].select("u", F.col("to").alias("label"))
    for move in reversed(moves[:-1]):
        later = out.select(F.col("u").alias("to"), "label")
        out = move.join(later, "to", "left").select("u", F.coalesce("label", "to").alias("label"))
    return out.select(F.col("u").alias("v"), "label")
