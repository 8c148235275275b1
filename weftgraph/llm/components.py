"""Connected components of a link table, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import hot_keys, remove_path, salted_join, written


def connected_components(links: DataFrame, max_rounds: int = 200, made: list[str] | None = None) -> DataFrame:
    """links(a, b) of orderable ids -> (id, component): the smallest id reachable, for every id in a link.

    Each round takes the least label among a node's neighbours, then jumps from label to label's label, so
    rounds grow with the logarithm of a chain's length. The minimum is summed up before the shuffle, and the rows of
    hubs and of very common labels are dealt into parts for the joins. Rounds are written to the shared folder; to
    the driver come whether labels changed and the hubs (fewer than a thousand). Null ends and self-links are ignored.
    The path of the table that is given back is appended to made.
    """
    pairs = links.select("a", "b").where("a is not null and b is not null and a <> b")
    both, both_at = written(pairs.union(pairs.select("b", "a")).toDF("u", "id").distinct(), "links")
    hubs = hot_keys(both.groupBy("id").count(), both.count())
    least = both.groupBy("u").agg(F.min("id").alias("m"))
    labels, at = written(least.select(F.col("u").alias("id"), F.least("u", "m").alias("l")), "labels")
    for _ in range(max_rounds):
        near = salted_join(both, labels, "id", "u", hubs).groupBy("u").agg(F.min("l").alias("m"))
        met = labels.join(near, labels["id"] == near["u"]).select("id", F.col("l").alias("old"), F.least("l", "m").alias("l"))
        met, met_at = written(met, "met")
        common = hot_keys(met.groupBy("l").count(), met.count())
        jumped = salted_join(met, labels.select(F.col("id").alias("l"), F.col("l").alias("tl")), "l", "id", common, "left")
        new, new_at = written(jumped.select("id", "old", F.least("l", F.coalesce("tl", "l")).alias("l")), "labels")
        changed = not new.where("l <> old").isEmpty()
        remove_path(both.sparkSession, at)
        remove_path(both.sparkSession, met_at)
        labels, at = new.select("id", "l"), new_at
        if not changed:
            break
    else:
        raise RuntimeError("components did not settle")
    remove_path(both.sparkSession, both_at)
    if made is not None:
        made.append(at)
    return labels.select("id", F.col("l").alias("component"))
