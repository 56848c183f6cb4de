"""Lines repeated across one source's documents.

Lines are parsed into templates by a tree of fixed depth: below the source come the number of
tokens and the first tokens, at the leaf the whole line, with a wildcard slot for every run of
digits; among the first tokens one that holds a digit is a slot altogether. A task grows a tree
over the rows of a batch and hands on one entry a leaf: how many rows it covers, and where. The
trees are merged by path, of every leaf only its counts are moved, and leaves below the threshold
are cut; so a line that stands in a third of all rows is one entry a task, whatever its
occurrences. Rows of one id may lie in several tasks, so the leaves left are counted again by
distinct ids. A line is a case if its template stands in at least `min_rows` different rows of its
source.

Defined results: rows of null content or source have no lines; white-space lines are empty;
rows with the same id count as one; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presswerk.operators.skew import join_counted
from presswerk.session import materialize

SLOT = "<*>"
_DIGITS = re.compile(r"\d+")
_DIGIT = re.compile(r"\d")


def template(line: str) -> str:
    """Lower case, trimmed, white space collapsed, each run of digits one slot."""
    t = " ".join(line.lower().split())
    return _DIGITS.sub(SLOT, t) if _DIGIT.search(t) else t


class TokenTree:
    """Source, number of tokens, first tokens, leaf: a tree of fixed depth whose leaves know their rows."""

    def __init__(self, depth: int) -> None:
        self.depth = depth
        self.root: dict = {}

    def add(self, source: str, text: str, key: int, number: int) -> None:
        tokens = text.split(" ", self.depth)
        node = self.root.setdefault(source, {}).setdefault(text.count(" ") + 1, {})
        for t in tokens[: self.depth]:
            node = node.setdefault(SLOT if SLOT in t else t, {})
        leaf = node.setdefault(text, ([], []))
        leaf[0].append(key)
        leaf[1].append(number)

    def leaves(self) -> Iterator[tuple[str, int, tuple[str, ...], str, tuple[list[int], list[int]]]]:
        """(source, tokens, first tokens, template, (ids, line numbers)) of each leaf."""
        for source, lengths in self.root.items():
            for length, top in lengths.items():
                walk = [((), top)]
                for _ in range(min(self.depth, length)):
                    walk = [((*head, t), child) for head, node in walk for t, child in node.items()]
                for head, node in walk:
                    for text, where in node.items():
                        yield source, length, head, text, where


PATH = ["source", "tokens", "head", "leaf_a", "leaf_b"]
ENTRY = "source string, tokens int, head bigint, leaf_a bigint, leaf_b bigint, rows bigint, ids array<bigint>, line_nos array<bigint>"
_TYPES = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]


def _halves(text: str) -> tuple[int, int]:
    """128 bits that stand for a text, which may be long."""
    d = blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def tree_entries(articles: DataFrame, depth: int = 2) -> DataFrame:
    """ENTRY: the leaves of the trees of all tasks; contents are read once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tree = TokenTree(depth)
            for key, source, content in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                for number, line in enumerate(content.split("\n"), 1):
                    if t := template(line):
                        tree.add(source, t, key, number)
            out = [(s, n, _halves("\n".join(head))[0], *_halves(text), len(set(ids)), ids, numbers) for s, n, head, text, (ids, numbers) in tree.leaves()]
            cells = list(zip(*out, strict=True)) or [()] * len(_TYPES)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, _TYPES, strict=True)], names=[x.split()[0] for x in ENTRY.split(", ")])

    rows = articles.select(F.col("id").cast("bigint").alias("id"), F.col("source").cast("string").alias("source"), F.col("content").cast("string").alias("content"))
    return materialize(rows.filter("id IS NOT NULL AND source IS NOT NULL AND content IS NOT NULL").mapInArrow(run, ENTRY), "tree-entries")


def repeated_lines(articles: DataFrame, min_rows: int = 6, depth: int = 2) -> DataFrame:
    """p6: (id, line_no) of every line whose template stands in at least min_rows rows of its source."""
    entries = tree_entries(articles, depth)
    # A leaf has one entry a batch of a task, so no key of these joins is hot.
    merged = entries.groupBy(PATH).agg(F.sum("rows").alias("k"), F.count("*").alias("_n")).filter(F.col("k") >= min_rows).drop("k")
    kept = materialize(merged, "templates")
    places = join_counted(entries, kept, PATH, "_n", "left_semi").select(*PATH, F.explode(F.arrays_zip("ids", "line_nos")).alias("x")).select(*PATH, F.col("x.ids").alias("id"), F.col("x.line_nos").alias("line_no"))
    if articles.select("id").filter("id IS NOT NULL").distinct().count() == articles.filter("id IS NOT NULL").count():
        return places.select("id", "line_no")
    places = materialize(places, "places")
    sure = places.groupBy(*PATH, "id").agg(F.count("*").alias("k")).groupBy(PATH).agg(F.count("*").alias("rows"), F.sum("k").alias("_n")).filter(F.col("rows") >= min_rows).drop("rows")
    return join_counted(places, materialize(sure, "templates-by-id"), PATH, "_n", "left_semi").select("id", "line_no").distinct()


def without_repeated_lines(articles: DataFrame, min_rows: int = 6) -> DataFrame:
    """articles with `content` freed of the repeated lines; all other columns stay."""
    found = repeated_lines(articles, min_rows).groupBy("id").agg(F.collect_set("line_no").alias("_drop"))
    lines = F.split("content", "\n")
    kept = F.filter(lines, lambda x, i: ~F.array_contains(F.col("_drop"), (i + 1).cast("bigint")))
    joined = articles.join(found, articles["id"].cast("bigint") == found["id"], "left").drop(found["id"])
    return joined.withColumn("content", F.when(F.col("_drop").isNull(), F.col("content")).otherwise(F.array_join(kept, "\n"))).drop("_drop")
