"""Near-duplicate articles: blocks in time, signals, a judge, groups and their canonical rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presswerk.functions.similarity import simhash
from presswerk.functions.text import entity_tokens, title_tokens
from presswerk.functions.url import slug_tokens
from presswerk.operators.grouping import anchored_blocks, connected, elect
from presswerk.session import materialize
from presswerk.sources.providers import Provider, apply

SIGNALS = ("slug", "embedding", "entity", "title", "simhash")
#: Rows of one tile; a block of more is compared tile by tile.
TILE = 256
TITLE_VECTORS = "id bigint, vector array<double>"


def signal_rows(articles: DataFrame, hours: int | None = 48, encoder: Provider | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, block, slug, entity, title, content, vector, *keep) of the first row of each URL hash, in blocks of so many hours.

    hours None: one block. encoder: a provider from (id, title) to TITLE_VECTORS; without one there are no vectors.
    """
    first = articles.filter("url_hash IS NOT NULL").groupBy("url_hash").agg(*[F.min_by(c, "id").alias(c) for c in ("title", "url", "content", "collected_at", *keep)], F.min("id").alias("id"))
    placed = first.withColumn("block", F.timestamp_micros(F.lit(0))) if hours is None else anchored_blocks(first, "collected_at", hours).filter("block IS NOT NULL")
    rows = placed.select("id", F.unix_micros("block").alias("block"), slug_tokens(F.col("url")).alias("slug"), entity_tokens(F.col("title")).alias("entity"), title_tokens(F.col("title")).alias("title"), "content", F.col("title").alias("_title"), *keep)
    if encoder is None:
        return materialize(rows.drop("_title").withColumn("vector", F.lit(None).cast("array<double>")), "signal-rows")
    rows = materialize(rows, "signal-texts")
    vectors = apply(rows.filter("_title IS NOT NULL").select("id", F.col("_title").alias("title")), encoder, TITLE_VECTORS).groupBy("id").agg(F.first("vector").alias("vector"))
    return materialize(rows.drop("_title").join(vectors, "id", "left"), "signal-rows")


def _shared(left: list, right: list) -> np.ndarray:
    """How many tokens each of the left sets shares with each of the right ones."""
    there = {w for t in right for w in t}
    number: dict[str, int] = {}
    for t in left:
        for w in t:
            if w in there:
                number.setdefault(w, len(number))
    matrices = []
    for sets in (left, right):
        m = np.zeros((len(sets), len(number)), np.float32)
        cells = [(i, number[w]) for i, t in enumerate(sets) for w in t if w in number]
        if cells:
            m[tuple(np.array(cells).T)] = 1
        matrices.append(m)
    return np.rint(matrices[0] @ matrices[1].T)


def _vectors(rows: list) -> np.ndarray:
    width = max((len(v) for v in rows if v is not None), default=0)
    m = np.zeros((len(rows), width))
    for i, v in enumerate(rows):
        if v is not None:
            m[i] = v
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def _tile_pairs(slug: float, entity: int, title: float, distance: int, embedding: float, sided: bool):  # noqa: ANN202
    """All pairs of two tiles of a block (of one, if they are the same), with the signals that fire."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pydict()
        low, high = rows["low"][0], rows["high"][0]
        tile = rows["tile"]
        sides = [[k for k, t in enumerate(tile) if t == x] for x in (low, high)]
        pick = lambda c, n: [rows[c][k] for k in sides[n]]
        ids = [np.array(pick("id", n), np.int64) for n in (0, 1)]
        if not len(ids[0]) or not len(ids[1]):
            return empty
        signals = {}
        for name in ("slug", "entity", "title"):
            l, r = ([t or [] for t in pick(name, n)] for n in (0, 1))
            both = _shared(l, r)
            whole = np.array([len(t) for t in l])[:, None] + np.array([len(t) for t in r])[None, :] - both
            score = both / np.maximum(whole, 1)
            fires = both >= entity if name == "entity" else (both > 0) & (score >= (slug if name == "slug" else title) - 1e-12)
            signals[name] = (fires, score)
        l, r = (pick("fp", n) for n in (0, 1))
        bits = np.bitwise_count(np.array([x or 0 for x in l], np.int64).view(np.uint64)[:, None] ^ np.array([x or 0 for x in r], np.int64).view(np.uint64)[None, :]).astype(np.int64)
        there = np.array([x is not None for x in l])[:, None] & np.array([x is not None for x in r])[None, :]
        signals["simhash"] = (there & (bits <= distance), 1 - bits / 64)
        l, r = (pick("vector", n) for n in (0, 1))
        if any(v is not None for v in l) and any(v is not None for v in r):
            close = _vectors(l) @ _vectors(r).T
            signals["embedding"] = (close >= embedding, close)
        else:
            signals["embedding"] = (np.zeros_like(there), np.zeros(there.shape))
        hit = np.logical_or.reduce([f for f, _ in signals.values()])
        if sided:
            hit &= np.array(pick("side", 0))[:, None] != np.array(pick("side", 1))[None, :]
        if low == high:
            hit &= ids[0][:, None] < ids[1][None, :]
        else:
            hit &= ids[0][:, None] != ids[1][None, :]
        i, j = np.nonzero(hit)
        a, b = ids[0][i], ids[1][j]
        columns = [pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))]
        columns += [pa.array(signals[s][1][i, j].astype(np.float64), mask=~signals[s][0][i, j]) for s in SIGNALS]
        return pa.Table.from_arrays(columns, schema=empty.schema)

    empty = pa.schema([("a", pa.int64()), ("b", pa.int64()), *[(s, pa.float64()) for s in SIGNALS]]).empty_table()
    return run


def candidate_pairs(rows: DataFrame, slug: float = 0.5, entity: int = 1, title: float = 0.3, distance: int = 15, embedding: float = 0.65, side: str | None = None) -> DataFrame:
    """(a, b, <similarity of each signal that fires>): all pairs in a block that any signal finds.

    slug, title: Jaccard at least so; entity: so many in common; distance: bits between the
    fingerprints; embedding: cosine of the titles' vectors. At these bars most searches would meet
    nearly every pair of a block, so the pairs are compared by matrix products, a pair of tiles at
    a time. Rows that agree in all signals are one class; its other rows are paired with the
    class's first, so no class is squared. side: only pairs that differ in this column, all of
    them.
    """
    tokens = [F.array_sort(c).alias(c) for c in ("slug", "entity", "title")]
    prints = simhash(rows.select("id", "content"), "id", "content", "fp").groupBy("id").agg(F.first("fp").alias("fp"))
    full = materialize(rows.select("id", "block", *tokens, "vector", (F.col(side) if side else F.lit(None).cast("string")).alias("side")).join(prints, "id"), "signals")
    same = ["block", "slug", "entity", "title", "fp", "vector", "side"]
    first = full.groupBy(*same).agg(F.min("id").alias("id")) if side is None else full
    first = materialize(first, "signal-classes") if side is None else first
    # One row a block.
    tiles = first.groupBy("block").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    tiled = first.join(tiles, "block").withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    tiled = tiled.withColumns({"low": F.least("tile", "other"), "high": F.greatest("tile", "other")}).drop("other", "tiles")
    schema = "a bigint, b bigint, " + ", ".join(f"{s} double" for s in SIGNALS)
    # As many tasks as configured: the sets are small, but their pairs are many.
    tiled = tiled.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "block", "low", "high")
    found = tiled.groupBy("block", "low", "high").applyInArrow(_tile_pairs(slug, entity, title, distance, embedding, side is not None), schema)
    if side is None:
        value = {"slug": F.size("slug") > 0, "entity": F.size("entity") >= entity, "title": F.size("title") > 0, "simhash": F.col("fp").isNotNull(), "embedding": F.col("vector").isNotNull()}
        equal = full.alias("f").join(first.alias("c"), [F.col(f"f.{c}").eqNullSafe(F.col(f"c.{c}")) for c in same]).filter("f.id != c.id")
        equal = equal.select(F.col("c.id").alias("a"), F.col("f.id").alias("b"), *[F.col(f"f.{c}").alias(c) for c in same if c not in ("block", "side")])
        equal = equal.select("a", "b", *[F.when(value[s], F.lit(1.0)).alias(s) for s in SIGNALS]).filter(F.coalesce(*SIGNALS).isNotNull())
        found = found.unionByName(equal)
    ids = full.agg(F.count("*").alias("n"), F.count_distinct("id").alias("k")).first()
    if ids["n"] == ids["k"]:
        return found
    # An id that stands for rows of several URL hashes may meet another one more than once.
    return found.groupBy("a", "b").agg(*[F.max(s).alias(s) for s in SIGNALS])


def first_signal() -> Column:
    """The first signal that fires, in the order in which they are looked at."""
    return F.coalesce(*[F.when(F.col(s).isNotNull(), s) for s in SIGNALS])


def judge_text(title: str, source: str, ts: str, content: str, most: int = 300) -> Column:
    """What a judge is told of a row: title, source, day, and the beginning of its content."""
    preview = F.regexp_replace(F.substring(content, 1, most), r"^\s+|\s+$", "")
    return F.concat(
        F.lit("Title: "), F.coalesce(title, F.lit("")), F.lit("\nSource: "), F.coalesce(source, F.lit("")), F.lit("\nDate: "), F.date_format(ts, "yyyy-MM-dd"),
        F.when(F.col(content) != "", F.concat(F.lit("\n- Content preview: "), preview)).otherwise(""),
    )


def offline_judge(pairs: DataFrame) -> DataFrame:
    """(a, b, confidence): a deterministic stand-in for a model, the mean of the strongest signals that fire, more for each further one.

    As many of them as give most, so a further weak signal never takes confidence away.
    """
    fired = F.reverse(F.array_sort(F.array_compact(F.array(*SIGNALS))))
    best = F.array_max(F.transform(F.sequence(F.lit(1), F.size("_s")), lambda n: F.aggregate(F.slice("_s", 1, n), F.lit(0.0), lambda x, y: x + y) / n * (0.7 + 0.1 * n)))
    return pairs.withColumn("_s", fired).select("a", "b", F.round(F.least(F.lit(1.0), best), 6).alias("confidence"))


def _groups(pairs: DataFrame, articles: DataFrame, least: float) -> DataFrame:
    judged = offline_judge(pairs).filter(F.col("confidence") >= least)
    names = articles.select("id", "url_hash").groupBy("id").agg(F.min("url_hash").alias("h"))
    side = lambda c: names.select(F.col("id").alias(c), F.col("h").alias(f"h{c}"))
    edges = materialize(judged.join(side("a"), "a").join(side("b"), "b").select(F.col("ha").alias("a"), F.col("hb").alias("b"), "confidence"), "edges")
    groups = materialize(connected(edges), "groups")
    # Added up as decimals, so that the order of rows doesn't matter.
    mean = edges.join(groups.select(F.col("node").alias("a"), "group"), "a").groupBy("group").agg(F.round(F.sum(F.col("confidence").cast("decimal(18,6)")).cast("double") / F.count("*"), 6).alias("confidence"))
    return elect(groups, articles).join(mean, "group").select(F.col("node").alias("url_hash"), "canonical", "size", "confidence")


def detect_duplicates(articles: DataFrame, hours: int = 48, least: float = 0.75, encoder: Provider | None = None, **bars: float) -> DataFrame:
    """(url_hash, canonical, size, confidence): groups of two and more, the row that stands for each, and the mean confidence of its accepted pairs."""
    return _groups(candidate_pairs(signal_rows(articles, hours, encoder), **bars), articles, least)


def detect_cross_language(foreign: DataFrame, canonical: DataFrame, least: float = 0.75, encoder: Provider | None = None, **bars: float) -> DataFrame:
    """As detect_duplicates, of pairs of a foreign and a canonical row at any distance in time; translations' titles need a cosine of 0.40 only."""
    both = foreign.withColumn("side", F.lit("foreign")).unionByName(canonical.withColumn("side", F.lit("canonical")))
    pairs = candidate_pairs(signal_rows(both, None, encoder, ("side",)), side="side", **{"embedding": 0.40, **bars})
    return _groups(pairs, both, least)


def mark_duplicates(articles: DataFrame, found: DataFrame, new: DataFrame | None = None, protect: Column | None = None) -> DataFrame:
    """articles with is_duplicate and canonical_url_hash of the found duplicates.

    new: (url_hash) that may be marked, by default all; protect: rows that must not be.
    """
    dup = found.filter("url_hash != canonical").groupBy("url_hash").agg(F.min("canonical").alias("_canonical"))
    if new is not None:
        dup = dup.join(new.select("url_hash").distinct(), "url_hash", "left_semi")
    joined = articles.join(dup, "url_hash", "left")
    hit = F.col("_canonical").isNotNull() & (F.lit(True) if protect is None else ~F.coalesce(protect, F.lit(False)))
    return joined.withColumns({"is_duplicate": F.when(hit, True).otherwise(F.col("is_duplicate")), "canonical_url_hash": F.when(hit, F.col("_canonical")).otherwise(F.col("canonical_url_hash"))}).select(articles.columns)


def surviving(rows: DataFrame, found: DataFrame) -> DataFrame:
    """rows that are no duplicates, neither as they are marked nor by url_hash among the found."""
    open_rows = rows.filter(~F.coalesce("is_duplicate", F.lit(False)))
    return open_rows.join(found.select("url_hash").distinct(), "url_hash", "left_anti")


def cross_language_pairs(foreign: DataFrame, canonical: DataFrame, key: str = "url_hash", companies: str = "companies") -> DataFrame:
    """(foreign, canonical, shared): rows that name common companies, by an equi-join on the names; only the foreign one may become the duplicate."""
    side = lambda d, n: d.select(F.col(key).alias(n), F.explode(F.array_distinct(companies)).alias("_c"))
    return side(foreign, "foreign").join(side(canonical, "canonical"), "_c").groupBy("foreign", "canonical").agg(F.count("*").alias("shared"))
