"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import discard, materialize, written


def components(edges: DataFrame, label: str) -> DataFrame:
    """Connected components of ``edges(src long, dst long)``: (id, component) for
    every id in an edge, the component being its smallest member.

    Alternating large-star and small-star steps; each step groups by one end of
    the edges with a map-side minimum, and its result is written to shared
    storage, in place of the last one's.  The only thing that reaches the driver is a pair of counts."""
    both = lambda e: e.select("src", "dst").union(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    digest = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
    e = materialize(edges.filter("src <> dst").select("src", "dst").distinct(), f"{label}-edges")
    last = digest(e)
    while last[0]:
        # large star: every larger neighbour of a node is linked to the node's smallest neighbour
        sym = both(e)
        low = sym.groupBy("src").agg(F.min("dst").alias("m")).withColumn("m", F.least("src", "m"))
        large = sym.filter("dst > src").join(low, "src").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
        large = large.filter("src <> dst").distinct()
        # small star: a node and its smaller neighbours are linked to the smallest of them
        down = large.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
        low = down.groupBy("src").agg(F.min("dst").alias("m"))
        small = down.join(low, "src").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
        e = small.union(low.select("src", F.col("m").alias("dst"))).filter("src <> dst").distinct()
        before, e = written[-1], materialize(e, f"{label}-star")
        discard(e.sparkSession, [before])
        now = digest(e)
        if now == last:
            break
        last = now
    pairs = e.select(F.col("src").alias("id"), F.col("dst").alias("component"))
    return pairs.groupBy("id").agg(F.min("component").alias("component")).union(
        e.select(F.col("dst").alias("id"), F.col("dst").alias("component")).distinct()
    )


def displaced(links: DataFrame) -> DataFrame | None:
    """The ids that go when, in their order, each id of ``links(id, id_b)``, ``id_b`` the earlier, goes
    if it is linked to one that stays; null if none goes.

    In a round all ids without an open link to an earlier one stay, and what is linked to them goes.
    There are as many rounds as the longest chain of open links, over which one written table
    of the open links gets smaller."""
    out = None
    while True:
        links = materialize(links, "open_links")
        if links.isEmpty():
            return out
        stay = links.select("id_b").distinct().join(links.select(F.col("id").alias("id_b")), "id_b", "left_anti")
        gone = materialize(links.join(stay, "id_b").select("id").distinct(), "displaced")
        out = gone if out is None else out.union(gone)
        links = links.join(gone, "id", "left_anti").join(gone.select(F.col("id").alias("id_b")), "id_b", "left_anti").select("id", "id_b")
