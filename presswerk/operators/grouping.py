"""Blocks in time, groups from pairs, star clusters and group lists."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from presswerk.session import materialize


def anchored_blocks(df: DataFrame, ts: str, hours: int = 48) -> DataFrame:
    """df with `block`, the time of the anchor that its row belongs to.

    A block begins at its first row and takes all rows up to so many hours later; the next row
    begins the next block. A gap longer than a block always ends one, so the rows are first cut
    at such gaps (found on a small table of time slices); the fold then runs over the distinct
    instants of each stretch. Rows without a time have no block.
    """
    width = hours * 3_600_000_000
    micros = df.withColumn("_t", F.unix_micros(F.col(ts).cast("timestamp")))
    slices = micros.filter("_t IS NOT NULL").groupBy(F.floor(F.col("_t") / width).alias("_s")).agg(F.min("_t").alias("lo"), F.max("_t").alias("hi"))
    # One row a slice: bounded by the span of time, not by the rows.
    whole = Window.orderBy("_s")
    stretches = slices.withColumn("_g", F.sum(F.when(F.col("lo") - F.lag("hi").over(whole) > width, 1).otherwise(0)).over(whole)).select("_s", "_g")
    cut = micros.withColumn("_s", F.floor(F.col("_t") / width)).join(stretches, "_s", "left")
    empty = F.struct(F.lit(None).cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("all"))
    fold = F.aggregate(
        F.array_sort(F.collect_set("_t")), empty,
        lambda s, t: F.when(s["at"].isNull() | (t - s["at"] > width), F.struct(t.alias("at"), F.array_append(s["all"], t).alias("all"))).otherwise(s),
    )
    anchors = cut.filter("_t IS NOT NULL").groupBy("_g").agg(fold["all"].alias("_a"))
    placed = cut.join(anchors, "_g", "left").withColumn("block", F.timestamp_micros(F.array_max(F.filter("_a", lambda a: a <= F.col("_t")))))
    return placed.select(*df.columns, "block")


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, group): the smallest node of each node's component, by least labels and pointer jumping.

    Each round takes the least label among neighbours, then the label's label, so the number of
    rounds is logarithmic for chains too.
    """
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL AND a != b")
    both = materialize(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("group")), "labels")
    while True:
        around = both.join(labels.select(F.col("node").alias("b"), "group"), "b").groupBy(F.col("a").alias("node")).agg(F.min("group").alias("near"))
        # What a node learns, its former label learns too: else a chain would hand it on link by link.
        told = labels.join(around, "node").select(F.col("group").alias("node"), F.least("group", "near").alias("near"))
        heard = around.unionByName(told).groupBy("node").agg(F.min("near").alias("near"))
        step = labels.join(heard, "node", "left").select("node", F.col("group").alias("old"), F.least("group", "near").alias("mid"))
        jump = step.alias("s").join(step.select(F.col("node").alias("mid"), F.col("mid").alias("far")), "mid", "left")
        new = materialize(jump.select("node", "old", F.least("mid", F.coalesce("far", "mid")).alias("group")), "labels")
        if not new.filter("old != `group`").limit(1).count():
            return new.select("node", "group")
        labels = new.select("node", "group")


def elect(groups: DataFrame, articles: DataFrame) -> DataFrame:
    """groups (node, group) with `canonical`: the member of least priority, then earliest, then of least hash."""
    known = articles.groupBy("url_hash").agg(F.min(F.struct("feed_priority", "collected_at")).alias("_k"))
    ordered = groups.join(known, groups["node"] == known["url_hash"])
    best = ordered.groupBy("group").agg(F.min_by("node", F.struct("_k", "node")).alias("canonical"), F.count("*").alias("size"))
    return groups.join(best, "group").select("node", "group", "canonical", "size")


def _star(batch: pd.DataFrame, threshold: float, least: int) -> pd.DataFrame:
    rows = batch.sort_values(["confidence", "rank"], ascending=[False, True], na_position="last", kind="stable")
    seeds: list[tuple[int, frozenset]] = []
    postings: dict[str, list[int]] = {}
    out = []
    for key, words in zip(rows["id"], rows["words"], strict=True):
        own = frozenset(words if words is not None else ())
        shared: dict[int, int] = {}
        for w in own:
            for s in postings.get(w, ()):
                shared[s] = shared.get(s, 0) + 1
        seed = min((s for s, n in shared.items() if n >= least and n / (len(own) + len(seeds[s][1]) - n) >= threshold), default=None)
        if seed is None:
            for w in own:
                postings.setdefault(w, []).append(len(seeds))
            seeds.append((key, own))
            out.append(key)
        else:
            out.append(seeds[seed][0])
    return pd.DataFrame({"topic": rows["topic"], "id": rows["id"], "seed": out})


def star_clusters(df: DataFrame, threshold: float = 0.3, least: int = 2) -> DataFrame:
    """(topic, id, seed) of rows (topic, id, confidence, rank, words).

    Within a topic, from the most confident row down, each row joins the first seed it is like, or
    becomes a seed; likeness isn't carried on. The order matters, so a topic is one task; seeds
    are found through their words. A topic of one day's digest is small; for more, add the day to
    the topic.
    """
    return df.groupBy("topic").applyInPandas(lambda b: _star(b, threshold, least), "topic string, id bigint, seed bigint")


def claim_first(groups: DataFrame) -> DataFrame:
    """Rows (position, item, ...): an item belongs to the first group that claims it."""
    first = groups.groupBy("item").agg(F.min("position").alias("position"))
    return groups.join(first, ["item", "position"], "left_semi").dropDuplicates(["item", "position"])


def valid_groups(groups: DataFrame, items: DataFrame, most: int = 10, rest: str = "Weitere Themen") -> DataFrame:
    """(label, item) from claims (digest, position, label, item) over items (digest, item).

    Items out of range fall away, each belongs to the first group that claims it, unclaimed ones
    and the groups beyond the largest `most - 1` become one more group.
    """
    inside = groups.join(items, ["digest", "item"], "left_semi")
    first = inside.groupBy("digest", "item").agg(F.min_by("label", F.struct("position", "label")).alias("label"), F.min("position").alias("position"))
    missing = items.join(first, ["digest", "item"], "left_anti").select("digest", "item", F.lit(rest).alias("label"), F.lit(1 << 30).alias("position"))
    everything = first.unionByName(missing)
    sizes = everything.groupBy("digest", "label", "position").agg(F.count("*").alias("n"))
    per = Window.partitionBy("digest")
    order = Window.partitionBy("digest").orderBy(F.desc("n"), "position", "label")
    kept = sizes.withColumn("r", F.row_number().over(order)).withColumn("k", F.count("*").over(per))
    named = kept.select("digest", "label", "position", F.when((F.col("k") > most) & (F.col("r") >= most), rest).otherwise(F.col("label")).alias("final"))
    return everything.join(named, ["digest", "label", "position"]).select("digest", F.col("final").alias("label"), "item")


def batches(df: DataFrame, size: int) -> Iterator[DataFrame]:
    """df in parts of about so many rows, by a hash of the whole row."""
    n = max(1, -(-df.count() // size))
    for k in range(n):
        yield df.filter(F.pmod(F.xxhash64(*df.columns), F.lit(n)) == k)
