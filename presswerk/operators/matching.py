"""Joins and candidate searches that a plain equi-join doesn't express."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from presswerk.functions.similarity import hamming
from presswerk.functions.text import normalize_company
from presswerk.operators.state import ranked
from presswerk.session import materialize


def keyed_pairs(left: DataFrame, right: DataFrame, left_order: list[str], right_order: list[str]) -> DataFrame:
    """The n-th row of one with the n-th of the other, by stated orders; for tables that fit in one task."""
    number = lambda d, o: d.withColumn("_n", F.row_number().over(Window.orderBy(*o)))
    return number(left, left_order).join(number(right, right_order), "_n").drop("_n")


#: A word or pair of words in which more sets meet is split: the word by the next word in common, the pair into tiles of so many rows.
TILE = 32_768
#: Groups of at most so many rows are paired all at once, larger ones row by column.
_FEW = 32
#: Cells of a strip that is compared at once.
_CELLS = 1 << 17


def jaccard_pairs(df: DataFrame, key: str, tokens: str, threshold: float, block: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Pairs of token sets at least so similar, and which rows stand behind each set.

    Returns (pairs, members): pairs (a, b, similarity) between the representatives of distinct
    sets, members (key, rep) of all rows. Equal sets are one class, so copies make no pairs.
    Prefix filter: sets are ordered by their tokens' rarity, and two sets of similarity t share
    a token among the first n - ceil(t n) + 1 of each, and a second one (if they share two) among
    one more; so only sets that meet in such a token are compared. Where many meet in a token,
    those are compared that meet in the next one too. They are compared where they meet, and a
    pair counts at its first common tokens only, so of the meetings nothing is moved or stored.
    Nothing is lost; empty and null sets match nothing.
    """
    b = F.col(block) if block else F.lit(0)
    sets = df.select(F.col(key).alias("k"), b.alias("b"), F.array_sort(tokens).alias("t")).filter(F.size("t") > 0)
    classes = materialize(sets.groupBy("b", "t").agg(F.min("k").alias("rep")).withColumn("c", F.monotonically_increasing_id()), "token-sets")
    members = sets.join(classes, ["b", "t"]).select(F.col("k").alias(key), "rep")
    exploded = classes.filter("rep IS NOT NULL").select("c", "b", "rep", F.size("t").alias("n"), F.explode("t").alias("w"))
    # A token of another block is another token. Tokens that stand once only count.
    often = materialize(exploded.groupBy("b", "w").agg(F.count("*").alias("f")).filter("f > 1").orderBy("f", "b", "w").withColumn("r", F.monotonically_increasing_id()), "tokens")
    ranks, kind = _numbered(often)
    # Each set's tokens by rarity; a set is one document's, so it is small.
    ordered = materialize(exploded.join(ranks, ["b", "w"]).groupBy("c", "rep", "n").agg(F.array_sort(F.collect_list("r")).alias("t")).drop("c"), "ordered-sets")
    need = F.ceil(F.lit(threshold) * F.col("n") - 1e-9).cast("int")
    # Those that stand once come first, so the prefix has as many less.
    last = F.size("t") - need
    first = ordered.select("rep", "n", "t", F.posexplode(F.slice("t", F.lit(1), F.greatest(last + 1, F.lit(0)))).alias("p", "r"))
    # At most a TILE-th of the rows are keys of such size, so they are few.
    busy = lambda rows, *by: materialize(rows.groupBy(*by).agg(F.count("*").alias("f")).filter(F.col("f") > TILE), "busy-tokens")
    hot = busy(first, "r").drop("f")
    met = first.join(F.broadcast(hot), "r", "left_anti").select("r", F.lit(-1).cast(kind).alias("s"), *[F.lit(0).alias(c) for c in ("low", "high", "tile")], "rep", "n", "p", F.lit(0).alias("q"), "t")
    if not hot.isEmpty():
        # q: where the second token stands; -1: sets so small that one common token can do.
        seconds = F.transform(F.slice("t", F.col("p") + 2, last - F.col("p") + 1), lambda s, j: F.struct((F.col("p") + 1 + j).alias("q"), s.alias("s")))
        single = F.when(need == 1, F.array(F.struct(F.lit(-1).alias("q"), F.lit(-1).cast(kind).alias("s")))).otherwise(F.array().cast(f"array<struct<q:int,s:{kind}>>"))
        two = first.join(F.broadcast(hot), "r").select("r", "rep", "n", "p", "t", F.explode(F.concat(seconds, single)).alias("x")).select("r", "x.s", "rep", "n", "p", "x.q", "t")
        two = two.join(F.broadcast(busy(two, "r", "s")), ["r", "s"], "left")
        tiles = F.coalesce(F.ceil(F.col("f") / TILE), F.lit(1)).cast("int")
        two = two.select("r", "s", "rep", "n", "p", "q", "t", F.pmod(F.xxhash64("rep", "t"), tiles).cast("int").alias("tile"), F.explode(F.sequence(F.lit(0), tiles - 1)).alias("other"))
        met = met.unionByName(two.select("r", "s", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), "tile", "rep", "n", "p", "q", "t"))
    # As many tasks as configured: the sets are small, but their meetings are many.
    group = ["r", "s", "low", "high"]
    met = met.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *group).sortWithinPartitions(*group)
    key_kind = classes.schema["rep"].dataType.simpleString()
    return met.mapInArrow(_similar_sets(threshold), f"a {key_kind}, b {key_kind}, similarity double"), members


def _numbered(often: DataFrame) -> tuple[DataFrame, str]:
    """(b, w, r) of tokens (b, w, f, r) written in order, with r from 0 without gaps; and the type of r, int where it suffices."""
    parts = often.groupBy(F.shiftright("r", 33).alias("k")).agg(F.count("*").alias("n"), F.min("r").alias("r")).collect()
    starts, total = {}, 0
    for part in sorted(parts, key=lambda x: x["k"]):
        starts[part["k"]] = total - part["r"]
        total += part["n"]
    kind = "int" if total < 1 << 31 else "bigint"
    start = F.array(*[F.lit(starts.get(k, 0)).cast("bigint") for k in range(max(starts, default=0) + 1)])
    return often.select("b", "w", (F.col("r") + F.get(start, F.shiftright("r", 33).cast("int"))).cast(kind).alias("r")), kind


def _similar_sets(threshold: float):  # noqa: ANN202
    """Over rows (r, s, low, high, tile, rep, n, p, q, t) sorted by the first four: the similar pairs of each group whose first common token is r, token p of t, and, where q isn't 0, whose second one is s, token q of t (-1: that have no second one). t has the tokens that other sets hold too, n counts all."""

    def least(n, m):  # noqa: ANN001, ANN202
        """The tokens that sets of these sizes must share."""
        return np.ceil(threshold / (1 + threshold) * (n + m) - 1e-9).astype(np.int64)

    def found(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        rows = rows.combine_chunks()
        r, s, low, high, tile, n, p, q = (rows.column(c).to_numpy() for c in ("r", "s", "low", "high", "tile", "n", "p", "q"))
        lists, rep = rows.column("t").chunk(0), rows.column("rep").chunk(0)
        at = lists.offsets.to_numpy().astype(np.int64)
        flat, long, n, p, q = lists.values.to_numpy(), np.diff(at), n.astype(np.int64), p.astype(np.int64), q.astype(np.int64)
        at = at[:-1]
        # Of the tokens up to the last one of the key: where it stands, and how many aren't common.
        end, lost = np.where(q > 0, q, p), n - long + np.where(q > 0, q - 1, p)
        rest = n - lost
        # Signatures of the tokens behind these: two differ in at most as many bits as the sets in tokens.
        bits = np.append(np.uint64(1) << ((flat.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(58)), np.uint64(0))
        sign = np.where(long > end + 1, np.bitwise_or.reduceat(bits, np.stack([at + end + 1, at + long], 1).ravel())[::2], np.uint64(0))

        def checked(i: np.ndarray, j: np.ndarray) -> Iterator[pa.RecordBatch]:
            """Of these pairs those that count here, by their tokens."""
            longer = long[i]
            for size in np.unique(longer):
                own = longer == size
                x, y = i[own], j[own]
                width = long[y].max()
                step = max(1, 16 * _CELLS // int(size * width))
                for k in range(0, len(x), step):
                    u, v = x[k : k + step], y[k : k + step]
                    there = np.arange(width)[None, :] < long[v][:, None]
                    right = np.where(there, flat[np.minimum(at[v][:, None] + np.arange(width)[None, :], len(flat) - 1)], -1)
                    same = (flat[at[u][:, None] + np.arange(size)[None, :]][:, :, None] == right[:, None, :]).any(2)
                    both = same.sum(1)
                    score = both / (n[u] + n[v] - both)
                    good = (score >= threshold - 1e-12) & (same.argmax(1) == p[u]) & ((q[u] >= 0) | (both == 1))
                    same[np.arange(len(u)), p[u]] = False
                    good &= (q[u] <= 0) | ((both > 1) & (same.argmax(1) == q[u]))
                    a, b = rep.take(pa.array(u[good])), rep.take(pa.array(v[good]))
                    kept = pc.not_equal(a, b)  # a key that stands for two sets
                    turned = pc.greater(a, b)
                    pairs = [pc.if_else(turned, b, a), pc.if_else(turned, a, b), pa.array(score[good])]
                    if len(a):
                        yield pa.RecordBatch.from_arrays(pairs, names=["a", "b", "similarity"]).filter(kept)

        def across(left: np.ndarray, right: np.ndarray, one: bool) -> Iterator[pa.RecordBatch]:
            """All left rows with all right ones; one: both are the same rows. Rows alike in size and position are compared with one bar."""
            width = int(max(lost[left].max(), lost[right].max())) + 1
            left, right = (x[np.argsort(n[x] * width + lost[x], kind="stable")] for x in (left, right))
            (lk, ls, lc), (rk, rs, rc) = (np.unique(n[x] * width + lost[x], return_index=True, return_counts=True) for x in (left, right))
            for k, begin, c in zip(lk, ls, lc, strict=True):
                size, rest_l = k // width, k // width - k % width
                need, rest_r = least(size, rk // width), rk // width - rk % width
                bar = rest_l + rest_r - 2 * need
                fit = np.flatnonzero((rest_l >= need) & (rest_r >= need) & ((rk >= k) | (not one)))
                if not len(fit):
                    continue
                spots = np.concatenate([np.arange(rs[f], rs[f] + rc[f]) for f in fit])
                bars, signs = np.repeat(np.minimum(bar[fit], 255).astype(np.uint8), rc[fit]), sign[right[spots]]
                step = max(1, _CELLS // len(spots))
                for top in range(begin, begin + c, step):
                    own = np.arange(top, min(top + step, begin + c))
                    i, j = np.nonzero(np.bitwise_count(sign[left[own]][:, None] ^ signs[None, :]) <= bars[None, :])
                    i, j = own[i], spots[j]
                    if one:
                        i, j = i[i < j], j[i < j]
                    yield from checked(left[i], right[j])

        starts = np.flatnonzero(np.concatenate([[True], (np.diff(r) != 0) | (np.diff(s) != 0) | (np.diff(low) != 0) | (np.diff(high) != 0)]))
        counts = np.diff(np.append(starts, len(r)))
        for size in np.unique(counts[(counts > 1) & (counts <= _FEW)]):
            x, y = np.triu_indices(size, 1)
            alike = starts[counts == size]
            for k in range(0, len(alike), step := max(1, _CELLS // len(x))):
                i, j = ((alike[k : k + step, None] + z[None, :]).ravel() for z in (x, y))
                need = least(n[i], n[j])
                near = (rest[i] >= need) & (rest[j] >= need) & ((low[i] == high[i]) | (tile[i] != tile[j]))
                near &= np.bitwise_count(sign[i] ^ sign[j]) <= rest[i] + rest[j] - 2 * need
                yield from checked(i[near], j[near])
        for begin, c in zip(starts[counts > _FEW], counts[counts > _FEW], strict=True):
            own = np.arange(begin, begin + c)
            if low[begin] == high[begin]:
                yield from across(own, own, True)
            elif len(left := own[tile[own] == low[begin]]) and len(right := own[tile[own] == high[begin]]):
                yield from across(left, right, False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in range(4)], 1)
            ends = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            # The group that is still open waits; all before it is whole.
            open_at = int(ends[-1]) if len(ends) else 0
            if waiting and (open_at or (keys[0] != last).any()):
                yield from found(pa.Table.from_batches([*waiting, batch.slice(0, open_at)]))
                waiting = []
            elif open_at:
                yield from found(pa.Table.from_batches([batch.slice(0, open_at)]))
            waiting.append(batch.slice(open_at))
            last = keys[-1]
        if waiting:
            yield from found(pa.Table.from_batches(waiting))

    return run


def set_members(df: DataFrame, key: str, tokens: str) -> DataFrame:
    """(key, rep): the members of jaccard_pairs alone: each row with the first row of its token set; empty and null sets have none."""
    sets = df.select(F.col(key).alias("k"), F.array_sort(tokens).alias("t")).filter(F.size("t") > 0)
    classes = sets.groupBy("t").agg(F.min("k").alias("rep"))
    return sets.join(classes, "t").select(F.col("k").alias(key), "rep").distinct()


def hamming_pairs(df: DataFrame, key: str, fingerprint: str, most: int = 3) -> tuple[DataFrame, DataFrame]:
    """(pairs, members) of 64-bit fingerprints at most so many bits apart.

    The bits are cut into most + 2 blocks, of which two fingerprints within the distance agree in
    two; so each stands in a table for every pair of blocks (for three bits ten tables of 25 bits
    and more, which tens of millions of fingerprints still share little), and a pair that meets in
    several counts once. Equal fingerprints are one class. Null fingerprints match nothing.
    """
    rows = df.select(F.col(key).alias("k"), F.col(fingerprint).alias("fp")).filter("fp IS NOT NULL")
    classes = materialize(rows.groupBy("fp").agg(F.min("k").alias("rep")), "fingerprints")
    members = rows.join(classes, "fp").select(F.col("k").alias(key), "rep")
    n = most + 2
    edges = [64 * k // n for k in range(n + 1)]
    part = [F.shiftrightunsigned("fp", edges[k]).bitwiseAND(F.lit((1 << (edges[k + 1] - edges[k])) - 1)) for k in range(n)]
    bands = F.array(*[F.struct(F.lit(i * n + j).alias("i"), F.shiftleft(part[i], edges[j + 1] - edges[j]).bitwiseOR(part[j]).alias("v")) for i in range(n) for j in range(i + 1, n)])
    banded = classes.select("rep", "fp", F.explode(bands).alias("band"))
    l, r = banded.alias("l"), banded.alias("r")  # noqa: E741
    met = l.join(r, F.col("l.band") == F.col("r.band")).filter(F.col("l.rep") < F.col("r.rep"))
    met = met.withColumn("distance", hamming(F.col("l.fp"), F.col("r.fp"))).filter(F.col("distance") <= most)
    return met.select(F.col("l.rep").alias("a"), F.col("r.rep").alias("b"), "distance").distinct(), members


def similar_vectors(queries: DataFrame, vectors: DataFrame, key: str, vector: str, threshold: float) -> DataFrame:
    """(query, match, similarity): all vectors at least so close to each of a bounded set of queries.

    The queries are broadcast as one matrix (at most 64 MB), the vectors are read in blocks and
    never moved.
    """
    size = queries.agg(F.sum(F.size(vector))).first()[0] or 0
    if size > 16_000_000:
        raise ValueError("too many query vectors for one matrix; split them")
    rows = queries.select(F.col(key).cast("bigint"), vector).collect()
    ids = np.array([r[0] for r in rows], np.int64)
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    matrix = unit(np.array([r[1] for r in rows], np.float64)) if rows else np.zeros((0, 1))
    shared = queries.sparkSession.sparkContext.broadcast((ids, matrix))

    def run(batches):  # noqa: ANN001, ANN202
        q_ids, q = shared.value
        for batch in batches:
            keys = batch.column(0).to_numpy()
            if not len(keys) or not len(q_ids):
                continue
            flat = np.asarray(batch.column(1).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(keys), -1)
            sims = q @ unit(flat).T
            i, j = np.nonzero(sims >= threshold)
            keep = q_ids[i] != keys[j]
            i, j = i[keep], j[keep]
            yield pa.RecordBatch.from_arrays([pa.array(q_ids[i]), pa.array(keys[j]), pa.array(sims[i, j])], names=["query", "match", "similarity"])

    full = vectors.filter(F.col(vector).isNotNull()).select(F.col(key).cast("bigint"), F.col(vector))
    return full.mapInArrow(run, "query bigint, match bigint, similarity double")


def company_exact(mentions: DataFrame, master: DataFrame) -> DataFrame:
    """(name, company_id, company): mentions whose trimmed, lower-case name is a company's; the best status, then the lowest id."""
    low = lambda c: F.lower(F.trim(c))
    best = master.groupBy(low(F.col("company")).alias("_k")).agg(F.min_by(F.struct("company_id", "company"), F.struct("status", "company_id")).alias("_m"))
    named = mentions.select("name").filter("name IS NOT NULL").distinct().withColumn("_k", low(F.col("name")))
    return named.join(best, "_k").select("name", F.col("_m.company_id").alias("company_id"), F.col("_m.company").alias("company"))


def company_like(mentions: DataFrame, master: DataFrame, least: int = 4, most: int = 5) -> DataFrame:
    """(name, company_id, company): the company whose name contains the normalised mention, if at most so many do.

    The best status wins, then the shortest name, then the lowest id. Containing is found by an
    equi-join on the mention's rarest run of four characters, not by comparing all pairs.
    """
    named = mentions.select("name").filter("name IS NOT NULL").distinct().withColumn("_q", normalize_company(F.col("name"))).filter(F.length("_q") >= least)
    grams = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - least + 1), lambda i: F.substr(c, i, F.lit(least))))
    hay = master.withColumn("_h", F.lower("company")).filter(F.length("_h") >= least)
    index = materialize(hay.select("company_id", "company", "status", "_h", F.explode(grams(F.col("_h"))).alias("g")), "company-grams")
    often = index.groupBy("g").agg(F.count("*").alias("f"))
    probes = named.select("name", "_q", F.explode(grams(F.col("_q"))).alias("g")).join(often, "g", "left").groupBy("name", "_q").agg(F.min_by("g", F.struct(F.coalesce("f", F.lit(0)), "g")).alias("g"))
    hits = probes.join(index, "g").filter(F.col("_h").contains(F.col("_q")))
    best = hits.groupBy("name").agg(F.count("*").alias("n"), F.min_by(F.struct("company_id", "company"), F.struct("status", F.length("company"), "company_id")).alias("m"))
    return best.filter(F.col("n") <= most).select("name", F.col("m.company_id").alias("company_id"), F.col("m.company").alias("company"))


def company_resolve(mentions: DataFrame, master: DataFrame) -> DataFrame:
    """(name, company_id, company, how) of every distinct mention: exact, else containing, else none."""
    names = mentions.select("name").filter("name IS NOT NULL").distinct()
    exact = company_exact(names, master)
    rest = names.join(exact, "name", "left_anti")
    like = company_like(rest, master)
    none = rest.join(like, "name", "left_anti").select("name", F.lit(None).cast("bigint").alias("company_id"), F.lit(None).cast("string").alias("company"))
    return exact.withColumn("how", F.lit("exact")).unionByName(like.withColumn("how", F.lit("like"))).unionByName(none.withColumn("how", F.lit("none")))


def with_default(df: DataFrame, lookup: DataFrame, key: str, value: str, default: Column) -> DataFrame:
    """df with the value that a lookup table has for its key, or a default."""
    table = lookup.groupBy(key).agg(F.min(value).alias(value))
    return df.join(table, key, "left").withColumn(value, F.coalesce(F.col(value), default))


def first_of(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    return ranked(df, by, order, "_r").filter("_r = 1").drop("_r")
