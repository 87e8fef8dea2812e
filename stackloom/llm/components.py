"""Connected components of a table of links, and tables kept in the shared folder between rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackloom.session import stored


def components(links: DataFrame) -> DataFrame:
    """(id, root) for every id in ``links`` (a, b: long): root is the smallest id that links lead to.

    Every round takes the smallest root among the neighbours and then the root of that root, so chains shorten to half a
    round. Rounds are tables in the shared folder: nothing is gathered, and a lost executor costs one round at most.
    """
    both = stored(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    roots = both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("root"))
    while True:
        roots = stored(roots, "roots")
        near = both.join(roots.select(F.col("id").alias("b"), "root"), "b").groupBy(F.col("a").alias("id")).agg(F.min("root").alias("near"))
        step = roots.join(near, "id").select("id", F.least("root", "near").alias("root"), F.col("root").alias("was"))
        above = roots.select(F.col("id").alias("root"), F.col("root").alias("above"))
        after = stored(step.join(above, "root").select("id", F.least("root", "above").alias("root"), "was"), "step")
        if after.where("root <> was").isEmpty():
            return roots
        roots = after.select("id", "root")
