"""Connected components of an edge table by hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressloom.llm.storage import checkpointed, looked_up


def connected_components(edges: DataFrame, left: str = "u", right: str = "v", roots: bool = False) -> DataFrame:
    """``id, component`` for every vertex of ``edges`` that is not its component's smallest; with ``roots`` for these too.

    The component is named by its smallest vertex. Edges lead from a vertex to
    smaller ones, its parents, which are few where edges span their groups. A
    round gathers each vertex's parents, hooks them and the vertex to the least
    and jumps to that one's own least parent, so that rounds grow with the
    logarithm of the longest path. A vertex that very many others lead to is no
    group of its own: it is looked up, not gathered. Loops and null ends are
    ignored; an empty table gives an empty one.
    """
    a, b = F.col(left).cast("long"), F.col(right).cast("long")
    steps = edges.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    while True:
        gathered = steps.groupBy("u").agg(F.sort_array(F.collect_set("v")).alias("p"))
        parents = checkpointed(gathered.select("u", F.get("p", F.lit(0)).alias("m"), F.slice("p", 2, 1 << 30).alias("others")))
        rows, several = parents.agg(F.count("*"), F.count_if(F.size("others") > 0)).first()
        upper = looked_up(parents, parents.select(F.col("u").alias("m"), F.col("m").alias("up")), "m", rows)
        if not several and not upper.agg(F.count("up")).first()[0]:
            break
        top = F.coalesce("up", "m")
        steps = upper.select(F.explode(F.concat(F.array("u"), "others")).alias("u"), top.alias("v")).where("u > v")
    out = parents.select(F.col("u").alias("id"), F.col("m").alias("component"))
    return out.unionByName(out.select(F.col("component").alias("id"), "component").distinct()) if roots else out
