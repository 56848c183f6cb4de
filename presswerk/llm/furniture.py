"""Page furniture: telling menus, notices, stamps, prompts and footers from the report.

The pages of a host are merged into one style tree, and the trees of all hosts into one above
them (the host's own name is masked, so that its siblings' furniture agrees). Below a host stand
three elements: what comes above the report's first sentence, the report, and what comes below
its last. Below an element stand its presentations, each a sequence of the ways its lines can
stand there: a list of items between separators, a headline, a sentence or a phrase. At the
leaves are the contents: the line with digits and quoted names as slots, the items of a list, and
the clause that a headline ends in.

The importance of a content that n of m pages hold, each page once, is 1 - log_m n: its entropy
over the pages, turned round. The importance of an element is the entropy of its presentations
over its pages (base m), and its composite importance mixes that with the mean importance of its
contents, the less so the more presentations it has. A path is unimportant if the importance of
its content, set off against how much less important its element is than the report's, is below a
bar; such branches are cut. A line is furniture if one of its presentations has unimportant
contents only.

Copies of a report must not make its lines look like furniture: pages that share their longest
line count as one. Lines of error pages and template residue are not furniture. Rows of null
content have no lines, rows of null source share a host.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presswerk.llm.residue import ExemplarIndex, exemplar_index, folded, tokens, words
from presswerk.operators.skew import join_counted
from presswerk.session import materialize

_QUOTED = re.compile(r"«[^«»]+»|“[^“”]+”|„[^„“]+“|\"[^\"]+\"|(?<!\w)'[^']+'(?!\w)")
_QUOTE = re.compile("[«“„\"']")
_LIST = re.compile(r"\s+[/|·•>»›]\s+")
_AMOUNT = re.compile(r"(?:chf ?|eur ?|€ ?|\$ ?)?0[.,]0 ?(?:(?:millionen|mio\.?|millions?|milioni|m\b|mrd\.?|milliarden|milliards?|miliardi|billion)(?: (?:de |di )?(?:franken|francs?|franchi|euro))?)?")
LINE, LIST, HEADLINE = 0, 1, 2
#: Elements of a page.
ABOVE, REPORT, BELOW = 0, 1, 2
#: A sentence of the report has at least so many words.
SENTENCE_WORDS = 8
#: How fast the presentations of an element count for more than its contents, and how much an element counts beside a content.
FOLD, ELEMENT_WEIGHT = 0.9, 0.05


def key(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def masked(plain: str, host: str) -> str:
    """A folded line with its white space collapsed, and host name and quoted names as slots."""
    t = " ".join(plain.split())
    if host:
        t = t.replace(host, "<h>")
    return _QUOTED.sub("<q>", t) if _QUOTE.search(t) else t


def tail(text: str) -> str:
    """What follows the last amount of a headline."""
    end = None
    for m in _AMOUNT.finditer(text):
        end = m.end()
    return text[end:].strip(" :,–-)(|") if end is not None else ""


def line_nodes(plain: str, host: str) -> list[tuple[int, int, int]]:
    """(presentation, nodes that must be unimportant, content node) of a folded line."""
    t = masked(plain, host)
    if not t:
        return []
    out = [(LINE, 1, key(t))]
    if t[-1] in ".!?":
        return out
    items = _LIST.split(t)
    if len(items) > 1:
        distinct = {key(x) for x in items}
        out += [(LIST, len(distinct), k) for k in distinct]
    if "0" in t and (end := tail(t)) and " " in end:
        out.append((HEADLINE, 1, key("tail:" + end)))
    return out


def elements(lines: list[tuple[str, int, int]]) -> tuple[list[int], list[int]]:
    """The element of each line of a page, and a hash of the presentation of each element, from (text, words, last way)."""
    told = [n for n, (text, words, _) in enumerate(lines) if words >= SENTENCE_WORDS and text.rstrip()[-1:] in ".!?…»”\""]
    first, last = (told[0], told[-1]) if told else (0, len(lines))
    where = [ABOVE if n < first else BELOW if n > last else REPORT for n in range(len(lines))]
    forms: list[list[str]] = [[], [], []]
    for spot, (text, _, way) in zip(where, lines, strict=True):
        forms[spot].append("lh"[way - 1] if way else "s" if text.rstrip()[-1:] in ".!?…" else "p")
    return where, [key("".join(f)) for f in forms]


PAGE = "id bigint, label string, address string, host bigint, sig bigint, residue boolean, styles array<bigint>, line_no array<int>, spot array<int>, way array<int>, need array<int>, node array<bigint>, report_lines array<int>, scores array<float>, title_scores array<float>"
_TYPES = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int64()), *[pa.list_(pa.int32())] * 4, pa.list_(pa.int64()), pa.list_(pa.int32()), *[pa.list_(pa.float32())] * 2]
_NAMES = [x.split()[0] for x in PAGE.split(", ")]


def read_pages(articles: DataFrame, index: ExemplarIndex, label: Column | None = None, address: Column | None = None, model: Callable | None = None) -> DataFrame:
    """One row a page, read once: its host, a signature, whether it is residue, and the nodes of its lines; with a model also the scores of each line's words and of the title's."""
    shared = articles.sparkSession.sparkContext.broadcast((index, model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        residue, score = shared.value
        hosts: dict[str, tuple[str, int]] = {}
        for batch in batches:
            out: list[tuple] = []
            for i, lab, addr, source, content, title, url in zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True):
                source = source or ""
                if source not in hosts:
                    hosts[source] = (" ".join(folded(source).split()), key(source))
                host, number = hosts[source]
                case, lines = residue.page(content, title, url, source)
                told = [line_nodes(plain, host) for _, _, plain in lines.values()]
                where, styles = elements([(line, len(window), found[-1][0] if found else 0) for (line, window, _), found in zip(lines.values(), told, strict=True)])
                nodes = [(n, spot, *x) for n, spot, found in zip(lines, where, told, strict=True) for x in found]
                longest = max(lines.values(), key=lambda x: len(x[1]), default=(content,))[0]
                sig = key(" ".join(words(longest)) or content)
                scores = score([w for _, w, _ in lines.values()]).ravel() if score and not case else None
                columns = list(zip(*nodes, strict=True)) or [()] * 5
                named = score([tokens(title or "")]).ravel() if score and not case else None
                out.append((i, lab, addr, number, sig, case, styles, *columns, tuple(lines) if score else None, scores, named))
            cells = list(zip(*out, strict=True)) or [()] * len(_TYPES)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, _TYPES, strict=True)], names=_NAMES)

    none = F.lit(None).cast("string")
    rows = articles.select(
        F.col("id").cast("bigint").alias("id"), (none if label is None else label).alias("label"), (none if address is None else address).alias("address"),
        *[F.col(c).cast("string").alias(c) for c in ("source", "content", "title", "url")],
    )
    return materialize(rows.filter("id IS NOT NULL AND content IS NOT NULL").mapInArrow(run, PAGE), "pages")


def title_tails(articles: DataFrame) -> DataFrame:
    """(sig, node) of the clause each distinct title ends in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(key(t), key("tail:" + end)) for t in batch.column(0).to_pylist() if " " in (end := tail(masked(folded(t), "")))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1)], names=["sig", "node"])

    return articles.filter("title IS NOT NULL").select(F.col("title").cast("string")).distinct().mapInArrow(run, "sig bigint, node bigint")


def furniture_lines(articles: DataFrame, min_pages: int = 5, share: float = 2e-4, host_share: float = 1e-2) -> DataFrame:
    """p2: (id, line_no) of the lines that are not part of the report.

    A content is unimportant if its importance is at most 1 - log_m b, with b = min_pages or a
    share of the m pages, whichever is more: `share` in the tree of all hosts, `host_share` in
    that of one host. ELEMENT_WEIGHT times what its element's composite importance lacks to that
    of the report's is taken off first.
    """
    return furniture_of(read_pages(articles, exemplar_index(articles)), title_tails(articles), min_pages, share, host_share)


def element_importance(pages: DataFrame, contents: DataFrame, sizes: DataFrame) -> DataFrame:
    """(host, lacks): of each element of a host, by how much its composite importance is less than that of the report; more is negative.

    contents: (host, spot, n) of each content node; sizes: (host, m).
    """
    spots = pages.select("host", "sig", F.posexplode("styles").alias("spot", "style")).groupBy("host", "spot", "style").agg(F.count_distinct("sig").alias("n"))
    by = spots.groupBy("host", "spot").agg(F.sum("n").alias("all"), F.count("*").alias("kinds"), F.sum(F.col("n") * F.log("n")).alias("_s"))
    nats = F.log("all") - F.col("_s") / F.col("all")
    presented = by.select("host", "spot", "kinds", F.when(F.col("all") > 1, nats / F.log("all")).otherwise(1.0).alias("presentation"))
    held = contents.filter("spot IS NOT NULL").groupBy("host", "spot").agg(F.sum(F.log("n")).alias("_l"), F.count("*").alias("_c"))
    held = held.join(sizes, "host").select("host", "spot", F.when(F.col("m") > 1, 1 - F.col("_l") / F.col("_c") / F.log("m")).otherwise(1.0).alias("content"))
    fold = F.pow(F.lit(FOLD), F.col("kinds"))
    both = presented.join(held, ["host", "spot"], "left").withColumn("importance", (1 - fold) * F.col("presentation") + fold * F.coalesce("content", F.lit(1.0)))
    at = [F.coalesce(F.max(F.when(F.col("spot") == k, F.col("importance"))), F.lit(1.0)) for k in (ABOVE, REPORT, BELOW)]
    return both.groupBy("host").agg(F.array(*at).alias("_i")).select("host", F.transform("_i", lambda x: F.col("_i")[REPORT] - x).alias("lacks"))


def furniture_of(pages: DataFrame, tails: DataFrame, min_pages: int = 5, share: float = 2e-4, host_share: float = 1e-2) -> DataFrame:
    """furniture_lines for pages that are read already."""
    nodes = pages.select("id", "host", "sig", F.explode(F.arrays_zip("line_no", "spot", "way", "need", "node")).alias("x")).select("id", F.col("x.line_no").cast("bigint").alias("line_no"), "host", "sig", "x.spot", "x.way", "x.need", "x.node")
    # Each page once: first by host, then over all hosts; both aggregations combine before the shuffle.
    by_host = nodes.groupBy("host", "node", "sig").agg(F.count("*").alias("rows"), F.min("spot").alias("spot")).groupBy("host", "node").agg(F.count("*").alias("n"), F.sum("rows").alias("_n"), F.min("spot").alias("spot"))
    by_host = materialize(by_host, "style-tree")
    held = nodes.select("node", "sig").unionByName(tails.select("node", "sig"))
    over_all = held.groupBy("node", "sig").agg(F.lit(1)).groupBy("node").agg(F.count("*").alias("n_all"))
    distinct = pages.select("host", "sig").distinct()
    sizes = distinct.groupBy("host").agg(F.count("*").alias("m"))
    number = float(max(2, distinct.agg(F.count_distinct("sig")).first()[0]))

    def bar(part: float, m):  # noqa: ANN001, ANN202
        """log_m of the pages that a content of an element of full importance must stand in."""
        return F.log(F.greatest(F.lit(float(min_pages)), m * part)) / F.log(m)

    # One row a host: what its elements lack.
    hosts = materialize(element_importance(pages, by_host, sizes).join(sizes, "host"), "elements")
    m = F.lit(number)
    # No element lacks more than 1.
    common = over_all.filter(F.log("n_all") / F.log(m) >= bar(share, m) - ELEMENT_WEIGHT - 1e-9)
    placed = by_host.join(common, "node", "left").filter(F.col("n_all").isNotNull() | (F.col("n") > 1)).join(hosts, "host")
    lack = ELEMENT_WEIGHT * F.element_at("lacks", F.col("spot") + 1)
    low = (F.log("n_all") / F.log(m) >= bar(share, m) - lack - 1e-9) | ((F.col("m") > 1) & (F.col("n") > 1) & (F.log("n") / F.log("m") >= bar(host_share, F.col("m").cast("double")) - lack - 1e-9))
    cut = materialize(placed.filter(low).select("host", "node", "_n"), "unimportant")
    hit = join_counted(nodes.drop("sig", "spot"), cut, ["host", "node"], "_n", "left_semi")
    alone = hit.filter("need = 1").select("id", "line_no")
    listed = hit.filter("need > 1").groupBy("id", "line_no", "way", "need").agg(F.count_distinct("node").alias("k")).filter("k >= need").select("id", "line_no")
    return alone.unionByName(listed).distinct()


def report_only(articles: DataFrame, **options: float) -> DataFrame:
    """articles with `content` freed of its furniture; all other columns stay."""
    found = furniture_lines(articles, **options).groupBy("id").agg(F.collect_set("line_no").alias("_drop"))
    kept = F.filter(F.split("content", "\n"), lambda x, i: ~F.array_contains(F.col("_drop"), (i + 1).cast("bigint")))
    joined = articles.join(found, articles["id"].cast("bigint") == found["id"], "left").drop(found["id"])
    return joined.withColumn("content", F.when(F.col("_drop").isNull(), F.col("content")).otherwise(F.array_join(kept, "\n"))).drop("_drop")
