from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from presswerk.operators import grouping, matching, queues, state
from presswerk.operators.skew import join_counted


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_join_counted_splits_hot_keys(spark):
    left = spark.createDataFrame([("hot", i) for i in range(50)] + [("cold", 1), (None, 2)], "k string, v int")
    right = spark.createDataFrame([("hot", "H", 50), ("cold", "C", 1), ("other", "O", 0)], "k string, x string, n bigint")
    for how in ("inner", "left", "left_semi"):
        want = rows(left.join(right.drop("n"), "k", how))
        assert rows(join_counted(left, right, ["k"], "n", how, hot_rows=10)) == want
        assert rows(join_counted(left, right, ["k"], "n", how)) == want


def test_insert_if_absent(spark):
    old = spark.createDataFrame([("a",)], "h string")
    new = spark.createDataFrame([("a", 1), ("b", 3), ("b", 2), (None, 4)], "h string, id int")
    assert rows(state.insert_if_absent(old, new, "h", ["id"])) == [("b", 2)]
    stored = old.unionByName(state.insert_if_absent(old, new, "h", ["id"]).select("h"))
    assert state.insert_if_absent(stored, new, "h", ["id"]).count() == 0


def test_views_and_updates(spark):
    events = spark.createDataFrame([("x", 1, "a", None), ("x", 2, None, 5), ("x", 3, "c", None), ("y", 1, None, None)], "k string, n int, s string, v int")
    assert rows(state.current_view(events, "k", ["n"], ["s", "v"])) == [("x", "c", 5, 3), ("y", None, None, 1)]
    base = spark.createDataFrame([("x", "filtered", "completed", 0, None), ("y", "filtered", "completed", 2, None)], "h string, pipeline_stage string, processing_status string, error_count int, error_message string")
    up = state.apply_updates(base, spark.createDataFrame([("x", "text")], "h string, content string"), "h", "scraped")
    assert rows(up.select("h", "pipeline_stage", "content")) == [("x", "scraped", "text"), ("y", "filtered", None)]
    failed = state.mark_failed(base, spark.createDataFrame([("y", "boom")], "h string, error_message string"), "h")
    assert rows(failed.select("h", "processing_status", "error_count")) == [("x", "completed", 0), ("y", "failed", 3)]
    assert queues.pending_queue(failed, "filtered").count() == 0
    back = state.reset(base, F.col("h") == "x", ["error_message"], "collected")
    assert rows(back.select("h", "pipeline_stage")) == [("x", "collected"), ("y", "filtered")]


def test_cascade_and_cache(spark):
    runs = spark.createDataFrame([("r1", "failed"), ("r2", None)], "run_id string, status string")
    kids = spark.createDataFrame([(1, "r1"), (2, "r2")], "id int, run_id string")
    kept, children = state.delete_cascade(runs, F.col("status") == "failed", {"kids": (kids, "run_id", "run_id")})
    assert rows(kept) == [("r2", None)] and rows(children["kids"].select("id")) == [(2,)]
    cache = spark.createDataFrame([("k", "v", "2026-01-01 00:00:00", 4), ("e", "w", "2020-01-01 00:00:00", 1)], "k string, v string, expires_at string, hit_count bigint").withColumn("expires_at", F.col("expires_at").cast("timestamp"))
    now = F.lit("2025-06-01 00:00:00").cast("timestamp")
    asked = spark.createDataFrame([("k",), ("e",), ("n",)], "k string")
    assert rows(state.cache_get(asked, cache, "k", now).select("k", "v", "hit")) == [("e", None, False), ("k", "v", True), ("n", None, False)]
    more = state.cache_hits(cache, asked.filter("k = 'k'"), "k")
    assert {r["k"]: r["hit_count"] for r in more.collect()} == {"k": 5, "e": 1}


def jac(a, b):
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("threshold", [0.5, 0.8])
def test_jaccard_pairs_against_all_pairs(spark, threshold):
    r = random.Random(3)
    sets = {i: frozenset(r.sample("abcdefghij", r.randint(0, 6))) for i in range(80)}
    df = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()] + [(99, None)], "id int, t array<string>")
    pairs, members = matching.jaccard_pairs(df, "id", "t", threshold)
    rep = {r["id"]: r["rep"] for r in members.collect()}
    assert set(rep) == {i for i, s in sets.items() if s} and all(sets[i] == sets[p] for i, p in rep.items())
    reps = sorted(set(rep.values()))
    want = {(a, b) for a in reps for b in reps if a < b and jac(sets[a], sets[b]) >= threshold}
    assert {(r["a"], r["b"]) for r in pairs.collect()} == want


def test_hamming_pairs_against_all_pairs(spark):
    r = random.Random(4)
    base = [r.getrandbits(64) for _ in range(20)]
    prints = [b ^ sum(1 << k for k in r.sample(range(64), r.randint(0, 5))) for b in base for _ in range(3)]
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(signed)] + [(999, None)], "id int, fp bigint")
    pairs, members = matching.hamming_pairs(df, "id", "fp", 3)
    rep = {r["id"]: r["rep"] for r in members.collect()}
    reps = sorted(set(rep.values()))
    assert {(r["a"], r["b"]) for r in pairs.collect()} == {(a, b) for a in reps for b in reps if a < b and (prints[a] ^ prints[b]).bit_count() <= 3}


def test_vectors(spark):
    e = spark.createDataFrame([(0, [1.0, 0.0]), (1, [2.0, 0.1]), (2, [0.0, 1.0]), (3, None)], "id bigint, v array<float>")
    found = matching.similar_vectors(e.filter("id = 0"), e, "id", "v", 0.9)
    assert [(r["query"], r["match"]) for r in found.collect()] == [(0, 1)]


def test_companies(spark):
    master = spark.createDataFrame([(1, "UBS Switzerland AG", 20), (2, "UBS Group AG", 30), (3, "Foo Bau AG", 20), (4, "Nestlé SA", 20)], "company_id bigint, company string, status int")
    names = spark.createDataFrame([(" ubs group ag ",), ("Foo Bau",), ("UBS",), ("Nestlé",), ("Unknown Corp",), (None,)], "name string")
    got = {r["name"]: (r["company_id"], r["how"]) for r in matching.company_resolve(names, master).collect()}
    assert got == {" ubs group ag ": (2, "exact"), "Foo Bau": (3, "like"), "UBS": (None, "none"), "Nestlé": (4, "like"), "Unknown Corp": (None, "none")}


def test_anchored_blocks_against_a_fold(spark):
    r = random.Random(5)
    hours = sorted(r.uniform(0, 900) for _ in range(120))
    df = spark.createDataFrame([(i, int(h * 3_600_000_000)) for i, h in enumerate(hours)] + [(999, None)], "id int, us bigint").withColumn("ts", F.timestamp_micros("us"))
    want, anchor = {}, None
    for i, h in enumerate(hours):
        us = int(h * 3_600_000_000)
        if anchor is None or us - anchor > 48 * 3_600_000_000:
            anchor = us
        want[i] = anchor
    got = {r["id"]: r["b"] for r in grouping.anchored_blocks(df, "ts").select("id", F.unix_micros("block").alias("b")).collect()}
    assert got == {**want, 999: None}


def union_find(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in parent}


def test_connected_against_union_find(spark):
    r = random.Random(6)
    edges = [(f"n{r.randint(0, 150):03}", f"n{r.randint(0, 150):03}") for _ in range(110)] + [(f"c{i:03}", f"c{i + 1:03}") for i in range(60)]
    edges = [(a, b) for a, b in edges if a != b]
    got = {r["node"]: r["group"] for r in grouping.connected(spark.createDataFrame([*edges, ("n1", None), ("z", "z")], "a string, b string")).collect()}
    assert got == union_find(edges)


def test_star_clusters(spark):
    data = [("t", 1, 0.9, 1, ["aaaa", "bbbb", "cccc"]), ("t", 2, 0.8, 2, ["aaaa", "bbbb", "dddd"]), ("t", 3, 0.7, 3, ["bbbb", "dddd", "eeee"]), ("t", 4, 0.7, 4, ["zzzz"]), ("u", 5, None, 5, ["aaaa", "bbbb"])]
    got = {r["id"]: r["seed"] for r in grouping.star_clusters(spark.createDataFrame(data, "topic string, id bigint, confidence double, rank int, words array<string>")).collect()}
    # 3 is like 2 but not like the seed 1.
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}


def test_valid_groups(spark):
    items = spark.createDataFrame([(1, i) for i in range(1, 13)], "digest int, item int")
    claims = [(1, 0, "A", 1), (1, 0, "A", 2), (1, 1, "B", 2), (1, 1, "B", 3), (1, 2, "C", 99), (1, 3, "D", 4)]
    got = {}
    for r in grouping.valid_groups(spark.createDataFrame(claims, "digest int, position int, label string, item int"), items, most=3).collect():
        got.setdefault(r["label"], set()).add(r["item"])
    assert got == {"Weitere Themen": {4, 5, 6, 7, 8, 9, 10, 11, 12, 3}, "A": {1, 2}}


def test_links_at_no_distance_are_in_the_results(spark, tmp_path):
    from presswerk.plans import texts

    rows = [(1, "Bank meldet Konkurs", "eins zwei drei vier"), (2, "Konkurs meldet Bank", "EINS zwei drei vier"), (3, "Wetter heute schön", "sechs sieben acht neun")]
    spark.createDataFrame(rows, "id bigint, title string, content string").withColumn("url", F.lit("https://a.ch/x/bank-konkurs")).write.parquet(f"{tmp_path}/articles.parquet")
    spark.createDataFrame(rows, "doc_id bigint, title string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    run = lambda name: sorted(tuple(r) for r in texts.QUERIES[name](spark, str(tmp_path)).collect())
    assert run("simhash_near_pairs") == [(1, 2, 0)]
    assert run("title_jaccard_members") == [(1, 1), (2, 1), (3, 3)]
    assert run("keyword_jaccard_members") == [(1, 1), (2, 1), (3, 3)]
    assert run("slug_jaccard_members") == [(1, 1), (2, 1), (3, 1)]


def test_simhash_of_rows_without_summary(spark, tmp_path):
    import hashlib

    from presswerk.plans import texts

    made = [(1, "Eins zwei drei vier fünf", None), (2, "a b c", "x"), (3, "zu kurz", None), (4, None, "x")]
    spark.createDataFrame(made, "id bigint, content string, summary string").write.parquet(f"{tmp_path}/articles.parquet")
    want = {}
    for key, text, _ in made:
        words = (text or "").lower().split()
        hashes = [int.from_bytes(hashlib.md5(" ".join(words[i : i + 3]).encode()).digest()[8:], "big") for i in range(len(words) - 2)]
        value = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        if value:
            want[key] = value - (1 << 64 if value >> 63 else 0)
    assert {r["id"]: r["simhash"] for r in texts.QUERIES["simhash_values"](spark, str(tmp_path)).collect()} == want and set(want) == {1, 2}


def test_cross_language_takes_italian_and_tells_members(spark, tmp_path):
    from presswerk.plans import texts

    made = [(1, "de", ["UBS", "CS"]), (2, "de", ["CS", "UBS"]), (3, "it", ["UBS"]), (4, "fr", ["UBS"]), (5, "fr", ["Nestlé"]), (6, "en", ["UBS"]), (7, "it", None)]
    spark.createDataFrame(made, "id bigint, language string, c array<string>").selectExpr("id", "language", "named_struct('companies', c) AS entities").write.parquet(f"{tmp_path}/articles.parquet")
    run = lambda name: sorted(tuple(r) for r in texts.QUERIES[name](spark, str(tmp_path)).collect())
    assert run("cross_language_candidates") == [(3, 1, 1)]
    assert run("cross_language_members") == [("foreign", 3, 3), ("foreign", 4, 3), ("foreign", 5, 5), ("german", 1, 1), ("german", 2, 1)]


def test_dedup_queue_whole_and_in_order(spark, tmp_path):
    from presswerk.plans import selection

    rows = spark.range(60).selectExpr("id", "timestamp_seconds(1760000000 + id DIV 2) AS collected_at", "CAST(id % 2 AS int) AS feed_priority", "'scraped' AS pipeline_stage", "'completed' AS processing_status", "CAST(NULL AS boolean) AS is_duplicate", "'s' AS source")
    rows.write.parquet(f"{tmp_path}/articles.parquet")
    got = [r["id"] for r in queues.dedup_queue(rows).collect()]
    assert got == [k for half in range(29, -1, -1) for k in (2 * half, 2 * half + 1)]
    placed = selection.QUERIES["dedup_queue"](spark, str(tmp_path)).collect()
    assert [r["id"] for r in sorted(placed, key=lambda r: r["place"])] == got
    assert [r["id"] for r in queues.dedup_queue(rows, 3).collect()] == got[:3]


@pytest.mark.parametrize("threshold", [0.5, 0.6, 0.8])
def test_jaccard_pairs_are_compared_where_they_meet(spark, monkeypatch, threshold):
    from test_queries import plan

    monkeypatch.setattr(matching, "TILE", 50)
    r = random.Random(6)
    sets = {f"k{i}": frozenset(r.sample("abcdefghijklmn", r.randint(1, 9))) for i in range(400)} | {"many": frozenset(map(str, range(3000))), "more": frozenset(map(str, range(2900)))}
    df = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "id string, t array<string>")
    pairs, members = matching.jaccard_pairs(df, "id", "t", threshold)
    reps = sorted({r["rep"] for r in members.collect()})
    want = [(a, b, jac(sets[a], sets[b])) for a in reps for b in reps if a < b and jac(sets[a], sets[b]) >= threshold]
    assert sorted(tuple(r) for r in pairs.collect()) == want and ("many", "more", 2900 / 3000) in want
    # What meets goes into no exchange.
    tree = plan(pairs).split("\n\n")[0]
    assert "MapInArrow" in tree and not re.search("Exchange|Join|Aggregate", tree.split("MapInArrow")[0])


def test_title_pairs_of_an_id_under_two_titles(spark, tmp_path):
    import duckdb

    from presswerk.plans import texts

    made = [(1, "Alpha Beta Gamma Delta Omega"), (1, "Zürich Bern Basel Genf Chur"), (2, "Alpha Beta Gamma Delta Sigma Omega"), (3, "Zürich Bern Basel Genf Chur Aarau"), (4, None), (5, ""), (None, "Bern Basel Genf Chur Aarau")]
    made += [(10 + k, f"Alpha Genf Wort{k} Satz{k} Zeile{k}") for k in range(9)]
    spark.createDataFrame(made, "id bigint, title string").write.parquet(f"{tmp_path}/articles.parquet")
    got = sorted(tuple(r) for r in texts.QUERIES["title_jaccard_pairs"](spark, str(tmp_path)).collect())
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW articles AS SELECT * FROM '{tmp_path}/articles.parquet/*.parquet'")
    assert got == sorted(duck.sql(texts.SQL["title_jaccard_pairs"]).fetchall()) == [(1, 2, 0.833333), (1, 3, 0.833333)]


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.8])
def test_jaccard_pairs_that_meet_in_busy_tokens(spark, monkeypatch, threshold):
    monkeypatch.setattr(matching, "TILE", 6)
    r = random.Random(7)
    sets = {i: frozenset(r.sample("abcdefghijk", r.choice([1, 1, 2, 2, 3, 4, 6, 9, 10]))) for i in range(300)}
    df = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "id int, t array<string>")
    pairs, members = matching.jaccard_pairs(df, "id", "t", threshold)
    reps = sorted({r["rep"] for r in members.collect()})
    want = [(a, b, jac(sets[a], sets[b])) for a in reps for b in reps if a < b and jac(sets[a], sets[b]) >= threshold]
    assert sorted(tuple(r) for r in pairs.collect()) == want and want


def shuffled(spark):
    found = spark.sparkContext._jsc.sc().statusStore().executorList(True)
    return sum(found.apply(k).totalShuffleWrite() for k in range(found.size()))


def test_title_pairs_of_busy_words_are_not_copied_to_tiles(spark, tmp_path, monkeypatch):
    from presswerk.plans import texts

    monkeypatch.setattr(matching, "TILE", 12)
    made = [(144 * i + 12 * j + k, f"Firma{i} Ort{j} Sache{k} meldet Konkurs") for i in range(12) for j in range(12) for k in range(12)] + [(2000 + i, f"Firma{i} Ort{i} Sache{i} Konkurs") for i in range(12)]
    spark.createDataFrame(made, "id bigint, title string").write.parquet(f"{tmp_path}/articles.parquet")
    before = shuffled(spark)
    got = {tuple(r) for r in texts.QUERIES["title_jaccard_pairs"](spark, str(tmp_path)).collect()}
    assert got == {(157 * i, 2000 + i, 0.8) for i in range(12)}
    # Each firm and place stands in 144 titles, so in twelve tiles; with the next word in common each title is one of twelve.
    assert shuffled(spark) - before < 400_000


def test_slug_pairs_move_sets_and_not_their_meetings(spark, tmp_path):
    from presswerk.plans import texts

    made = [(k, f"https://a.ch/wirtschaft/bank-meldet-konkurs-wort{k}x") for k in range(1500)] + [(2000, "https://a.ch/wirtschaft/bank-meldet-konkurs"), (2001, "https://a.ch/wirtschaft/bank-meldet")]
    spark.createDataFrame(made, "id bigint, url string").write.parquet(f"{tmp_path}/articles.parquet")

    def written():
        found = spark.sparkContext._jsc.sc().statusStore().executorList(True)
        return sum(found.apply(k).totalShuffleWrite() for k in range(found.size()))

    before = written()
    got = {tuple(r) for r in texts.QUERIES["slug_jaccard_pairs"](spark, str(tmp_path)).collect()}
    assert got == {(k, 2000, 0.8) for k in range(1500)}
    # All 1,500 meet in a common word: a million meetings.
    assert written() - before < 1_000_000


def test_slug_pairs_move_no_words_that_stand_once(spark, tmp_path):
    from presswerk.plans import texts

    r = random.Random(8)
    made = [(k, "https://a.ch/" + "-".join([f"einmal{k}x{x}" for x in range(2)] + [f"wort{x}x" for x in r.sample(range(200), 12)])) for k in range(1500)]
    made += [(5000 + k, made[k][1].replace("einmal", "neu", 1)) for k in range(5)] + [(6000, "https://a.ch/ganz-allein"), (6001, "https://a.ch/wort1x")]
    spark.createDataFrame(made, "id bigint, url string").write.parquet(f"{tmp_path}/articles.parquet")
    before = shuffled(spark)
    got = {tuple(r) for r in texts.QUERIES["slug_jaccard_pairs"](spark, str(tmp_path)).collect()}
    assert got == {(k, 5000 + k, 0.866667) for k in range(5)}
    assert shuffled(spark) - before < 350_000
