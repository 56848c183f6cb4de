from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from presswerk.llm import components as C
from presswerk.llm.repeated_lines import repeated_lines, without_repeated_lines


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


def graph(seed):
    r = random.Random(seed)
    edges = [(f"n{r.randint(0, 200):03}", f"n{r.randint(0, 200):03}") for _ in range(150)]
    edges += [(f"c{i:03}", f"c{i + 1:03}") for i in range(120)] + [("hub", f"s{i:03}") for i in range(90)]
    return [(a, b) for a, b in edges if a != b]


@pytest.mark.parametrize("hot", [200_000, 50])
def test_components_against_union_find(spark, monkeypatch, hot):
    monkeypatch.setattr(C, "HOT_ROWS", hot)
    monkeypatch.setattr("presswerk.operators.skew.HOT_ROWS", hot)
    edges = graph(7)
    df = spark.createDataFrame([*edges, *edges[:9], ("x", "x"), ("y", None), (None, None)], "src string, dst string")
    assert {r["node"]: r["component"] for r in C.components(df).collect()} == union_find(edges)


def test_components_of_nothing(spark):
    assert C.components(spark.createDataFrame([("a", "a")], "src string, dst string")).count() == 0
    assert C.components(spark.createDataFrame([], "src string, dst string")).count() == 0


def test_duplicate_links(spark):
    groups = spark.createDataFrame([(1, " A ", 0.75, "x"), (1, " A ", 0.75, "x"), (2, "b", 0.7, "x"), (3, "c", None, "x"), (4, "d", float("nan"), "x"), (5, "e", 0.9, "x")], "id int, canonical_url_hash string, confidence double, group_id string")
    members = spark.createDataFrame([(1, "B"), (1, "b "), (2, "c"), (3, "d"), (4, "e"), (5, "E"), (9, "z"), (5, None)], "group_id int, duplicate_url_hash string")
    assert sorted(map(tuple, C.duplicate_group_keys(groups.drop("group_id"), members).collect())) == [("a", "a"), ("b", "a")]


def brute_lines(rows, least):
    norm = lambda x: re.sub(r"\d+", "0", " ".join(x.lower().split()))
    seen = {}
    for i, s, c in rows:
        if s is not None and c is not None:
            for x in c.split("\n"):
                if norm(x):
                    seen.setdefault((s, norm(x)), set()).add(i)
    return {(i, n) for i, s, c in rows if s is not None and c is not None for n, x in enumerate(c.split("\n"), 1) if norm(x) and len(seen[(s, norm(x))]) >= least}


def test_repeated_lines_against_brute_force(spark):
    r = random.Random(1)
    pool = ["Alle Rechte vorbehalten.", " alle  RECHTE vorbehalten. ", "Seite 12", "Seite 7\r", "", "   ", "Ünique", "x y", "X y", *[f"line {k} of" for k in range(3)], "lang " * 3000]
    rows = [(i, r.choice(["a", "b", None]), "\n".join(r.choice(pool) for _ in range(r.randint(0, 6)))) for i in range(60)] + [(1, "a", "Seite 3"), (99, "a", None), (100, "a", "")]
    df = spark.createDataFrame([(*x, 0) for x in rows], "id int, source string, content string, line_no int")
    assert {tuple(x) for x in repeated_lines(df).collect()} == brute_lines(rows, 6)
    assert repeated_lines(df.limit(0)).count() == 0


def test_lines_are_taken_out(spark):
    df = spark.createDataFrame([(i, "s", f"Report {chr(97 + i)}\nImpressum") for i in range(7)], "id int, source string, content string")
    assert {r["content"] for r in without_repeated_lines(df).collect()} == {f"Report {chr(97 + i)}" for i in range(7)}


def test_hot_templates(spark, monkeypatch):
    monkeypatch.setattr("presswerk.llm.repeated_lines.join_counted", lambda *a, **k: __import__("presswerk.operators.skew", fromlist=["x"]).join_counted(*a, **k, hot_rows=5))
    df = spark.createDataFrame([(i, "s", f"unique {chr(97 + i)} words\nImpressum") for i in range(20)], "id int, source string, content string")
    assert repeated_lines(df).agg(F.count("*"), F.min("line_no")).first()[:2] == (20, 2)
