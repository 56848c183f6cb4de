"""Pairwise matches to groups: low-diameter decomposition with contraction.

Every vertex draws an exponential shift; clusters start at the shifted times and grow by one
hop a round, and a vertex belongs to the cluster that reaches it first. Clusters contract to
super-vertices, the decomposition recurses on the edges between clusters, and the
assignments are composed. A level removes a constant share of the edges whatever the
diameter, so a chain of n links takes O(log n) levels, where label propagation takes n rounds.

A map of vertices into their own component keeps components: a path's image is a path. So the
result is exact whatever the draws and the number of rounds; these decide only the speed.

Hubs: messages into a hub are combined before the shuffle; the states of hubs are broadcast
to their edges (join_counted), so no task gets all edges of a hub.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presswerk.operators.skew import HOT_ROWS, join_counted
from presswerk.session import materialize


def _decompose(edges: DataFrame, level: int, total: int, beta: float, rounds: int) -> DataFrame:
    """(node, center, _n) for each vertex of edges: the cluster it joined, and its degree."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    # Uniform in (0, 1] from the vertex alone: a task that runs again draws the same shift.
    uniform = (F.pmod(F.xxhash64("node", F.lit(level)), F.lit(1 << 52)) + 1) / F.lit(float(1 << 52))
    state = both.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("_n")).withColumn("_best", F.struct((F.log(uniform) / beta).alias("start"), F.col("node").alias("center")))
    for k in range(rounds):
        if total >= HOT_ROWS:  # hubs are possible: the states are read several times
            state = materialize(state, f"growth-{level}-{k}")
        sent = join_counted(both.withColumnRenamed("src", "node"), state, ["node"], "_n", total=total if total < HOT_ROWS else None).select(
            F.col("dst").alias("node"), F.lit(None).cast("bigint").alias("_n"), F.struct((F.col("_best.start") + 1).alias("start"), F.col("_best.center").alias("center")).alias("_best")
        )
        state = state.unionByName(sent).groupBy("node").agg(F.max("_n").alias("_n"), F.min("_best").alias("_best"))
    return materialize(state.select("node", F.col("_best.center").alias("center"), "_n"), f"clusters-{level}")


def components(edges: DataFrame, src: str = "src", dst: str = "dst", beta: float = 0.1, rounds: int = 3, max_levels: int = 100) -> DataFrame:
    """(node, component) for every vertex linked to another one; component is the smallest vertex of its component.

    Null ends and loops link nothing; repeated and reversed edges count once. No edges give
    no rows.
    """
    a, b = edges[src], edges[dst]
    links = edges.select(F.least(a, b).alias("src"), F.greatest(a, b).alias("dst")).filter(a.isNotNull() & b.isNotNull() & (a != b)).distinct()
    links = materialize(links, "links")
    empty = links.select(F.col("src").alias("node"), F.col("dst").alias("component"))
    steps: list[tuple[DataFrame, int]] = []  # by level: where each vertex went, and a bound of their number
    while total := 2 * links.count():
        if len(steps) == max_levels:
            raise RuntimeError(f"edges are left after {max_levels} levels")
        level, known = len(steps), total if total < HOT_ROWS else None
        clusters = _decompose(links, level, total, beta, rounds)
        end = lambda c: clusters.select(F.col("node").alias(c), F.col("center").alias(f"{c}_c"), "_n")  # noqa: B023, E731
        half = join_counted(links, end("src"), ["src"], "_n", total=known).select(F.col("src_c").alias("src"), "dst")
        moved = join_counted(half, end("dst"), ["dst"], "_n", total=known).select("src", F.col("dst_c").alias("dst"))
        links = materialize(moved.filter("src != dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct(), f"links-{level}")
        steps.append((clusters.select("node", "center"), total))
    if not steps:
        return empty
    # Compose from the last level back: the levels shrink, so the work is that of the first.
    ends: DataFrame | None = None
    for step, total in reversed(steps):
        if ends is None:
            ends = step
            continue
        sizes = step.groupBy(F.col("center").alias("mid")).agg(F.count("*").alias("_n"))
        target = sizes.join(ends.select(F.col("node").alias("mid"), F.col("center").alias("end")), "mid", "left").withColumn("end", F.coalesce("end", "mid"))
        if total >= HOT_ROWS:
            target = materialize(target, "targets")
        ends = join_counted(step.withColumnRenamed("center", "mid"), target, ["mid"], "_n", total=total if total < HOT_ROWS else None).select("node", F.col("end").alias("center"))
    ends = materialize(ends, "ends")
    names = ends.groupBy("center").agg(F.min("node").alias("component"), F.count("*").alias("_n"))
    if steps[0][1] >= HOT_ROWS:
        names = materialize(names, "names")
    return join_counted(ends, names, ["center"], "_n", total=steps[0][1] if steps[0][1] < HOT_ROWS else None).select("node", "component")


def duplicate_links(groups: DataFrame, members: DataFrame, min_confidence: float = 0.75) -> DataFrame:
    """(src, dst) of the links that duplicate_groups and duplicate_members state.

    Hashes are trimmed and in lower case. A group of null or not-a-number confidence, or one
    whose row is missing, links nothing; rows delivered twice count once.
    """
    clean = lambda c: F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))
    sure = groups.filter((F.col("confidence") >= min_confidence) & ~F.isnan("confidence")).select(F.col("id").alias("group_id"), clean("canonical_url_hash").alias("src")).distinct()
    # One group may hold most members; the side of groups is counted so that it can't skew.
    counts = members.groupBy("group_id").agg(F.count("*").alias("_n"))
    sure = materialize(sure.join(counts, "group_id"), "sure-groups")
    # A canonical hash with very many members is a hub of `components`, not of this join alone.
    return join_counted(members.select("group_id", clean("duplicate_url_hash").alias("dst")), sure, ["group_id"], "_n").select("src", "dst")


def duplicate_group_keys(groups: DataFrame, members: DataFrame, min_confidence: float = 0.75) -> DataFrame:
    """p4: (url_hash, group_key) of every record linked to at least one other."""
    found = components(duplicate_links(groups, members, min_confidence))
    return found.select(F.col("node").alias("url_hash"), F.col("component").alias("group_key"))
