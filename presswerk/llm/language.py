"""Language of documents and of their passages, by fusing evidence.

The posterior of a page's language multiplies the likelihood of its text and of its title (which
counts more, as passages in other languages stand in the text only), of the language it declares,
and a prior of its host. Text likelihoods come from word counts of a bounded sample of
labelled rows, re-labelled once by the first model since labels err. Host priors are counts of
declared languages by host, smoothed towards those of the address suffix, and these towards
those of the corpus, all by grouped aggregation over all rows. Passages are lines: their
likelihood is fused with a prior that favours the language of the page.

Lines of page furniture don't count, pages of template residue and of null content are left
out. A page without lines of report has no language.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presswerk.llm.furniture import furniture_of, read_pages, title_tails
from presswerk.llm.residue import exemplar_index
from presswerk.operators.skew import join_counted
from presswerk.session import materialize

LANGUAGES = ("de", "fr", "it", "en")
# What names one of the languages; regions, case and blanks are dropped first.
CODES = {"de": "de", "deu": "de", "ger": "de", "fr": "fr", "fra": "fr", "fre": "fr", "it": "it", "ita": "it", "en": "en", "eng": "en"}
#: At most so many labelled rows a language are fitted on.
SAMPLE = 1500
#: Words seen less often in the sample tell nothing: their ratios are all noise.
LEAST_SEEN = 3
_WORD = re.compile(r"[^\W\d_]{2,}")


def declared(label: Column) -> Column:
    """The language that a label names, or null."""
    base = F.split(F.lower(F.regexp_replace(label.cast("string"), r"(?U)\s+", "")), "[-_]").getItem(0)
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in CODES.items() for x in kv]), base)


class WordModel:
    """Log-likelihood ratios of words by language."""

    def __init__(self, counts: list[Counter], agreement: float = 0.9, stay: float = 0.97) -> None:
        total = Counter()
        for c in counts:
            total.update(c)
        words = [w for w, n in sorted(total.items(), key=lambda x: (-x[1], x[0])) if n >= LEAST_SEEN]
        table = np.array([[c[w] + 0.3 for c in counts] for w in words], np.float64).reshape(len(words), len(counts))
        sizes = np.array([sum(c.values()) + 0.3 * (len(words) + 1) for c in counts])
        logs = np.log(table / sizes)
        logs -= logs.mean(axis=1, keepdims=True)
        telling = np.ptp(logs, axis=1) > 1.0
        self.ids = {w: i for i, w in enumerate(w for w, t in zip(words, telling, strict=True) if t)}
        self.scores = np.vstack([np.clip(logs[telling], -4, 4), np.zeros((1, len(counts)))]).astype(np.float32)
        #: How often a page is in the language it declares, and a line in that of its page.
        self.agreement, self.stay = agreement, stay

    def line_scores(self, lines: list[list[str]]) -> np.ndarray:
        """One row of scores for each line of words."""
        if not lines:
            return np.zeros((0, len(LANGUAGES)), np.float32)
        get, rest = self.ids.get, len(self.scores) - 1
        flat: list[int] = []
        starts = []
        for line in lines:
            starts.append(len(flat))
            flat += [get(w, rest) for w in line]
            flat.append(rest)  # so that an empty line keeps its place
        return np.add.reduceat(self.scores[np.array(flat, np.int64)], starts, axis=0)


def fit(rows: list[tuple[str, str]]) -> WordModel:
    """rows: (declared language, text)."""
    pages = [(LANGUAGES.index(lang), [_WORD.findall(x) for x in text.casefold().split("\n") if x.strip()]) for lang, text in rows]
    counts = [Counter() for _ in LANGUAGES]
    for lang, lines in pages:
        for line in lines:
            counts[lang].update(line)
    first = WordModel(counts)
    counts, agree, same, number = [Counter() for _ in LANGUAGES], 1, 1, 2
    for lang, lines in pages:
        if not lines:
            continue
        scores = first.line_scores(lines)
        main = scores.sum(axis=0).argmax()
        agree += int(main == lang)
        for line, row in zip(lines, scores, strict=True):
            best = row.argmax()
            counts[best].update(line)
            if np.ptp(row) > 3:  # lines of a name or two tell no language
                same, number = same + int(best == main), number + 1
    return WordModel(counts, min(0.98, max(0.5, agree / (len(pages) + 1))), min(0.99, max(0.5, same / number)))


def labelled_sample(articles: DataFrame, per_language: int = SAMPLE) -> list[tuple[str, str]]:
    """At most about per_language rows of each declared language, drawn by a hash of the id."""
    rows = articles.select("id", declared(F.col("language")).alias("lang"), "content").filter("lang IS NOT NULL AND content IS NOT NULL")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return []
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, per_language / n))])
    drawn = F.pmod(F.xxhash64(F.col("id").cast("bigint")), F.lit(1 << 30)) < F.try_element_at(share, F.col("lang")) * (1 << 30)
    return [(r["lang"], r["content"]) for r in rows.filter(drawn).select("lang", "content").limit(2 * per_language * len(sizes)).collect()]


def host_priors(articles: DataFrame, weight: float = 20.0) -> DataFrame:
    """(host, prior, _n): the shares of declared languages of each host, smoothed by those of its suffix and of all rows."""
    keyed = articles.select(host_of(articles).alias("host"), declared(F.col("language")).alias("lang"))
    count = [F.count_if(F.col("lang") == x).cast("double").alias(f"n_{x}") for x in LANGUAGES]
    hosts = keyed.groupBy("host").agg(*count, F.count("*").alias("_n")).withColumn("suffix", F.regexp_extract("host", r"([^.]*)$", 1))
    ns = [f"n_{x}" for x in LANGUAGES]
    sums = lambda d: d.agg(*[F.sum(n).alias(f"{n}_up") for n in ns])
    whole = hosts.agg(*[F.sum(n).alias(n) for n in ns]).first()
    everything = [(whole[n] or 0.0) + 1.0 for n in ns]
    base = [x / sum(everything) for x in everything]

    def smoothed(cols: list[str], prior: list[Column]) -> Column:
        total = sum((F.col(c) for c in cols[1:]), F.col(cols[0]))
        return F.array(*[(F.col(c) + weight * p) / (total + weight) for c, p in zip(cols, prior, strict=True)])

    suffixes = sums(hosts.groupBy("suffix")).withColumn("above", smoothed([f"{n}_up" for n in ns], [F.lit(b) for b in base])).select("suffix", "above")
    return hosts.join(suffixes, "suffix").withColumn("prior", smoothed(ns, [F.col("above")[k] for k in range(len(ns))])).select("host", "prior", "_n")


def host_of(articles: DataFrame) -> Column:
    host = F.lower(F.try_parse_url(articles["url"], F.lit("HOST")))
    return F.coalesce(host, articles["source"].cast("string"), F.lit(""))


OUT = "id bigint, line_no bigint, lang string, confidence double"


def detect_languages(articles: DataFrame, per_language: int = SAMPLE, main_prior: float | None = None, title_weight: float = 4.0) -> DataFrame:
    """(id, line_no, lang, confidence): line_no 0 and the page's language where the label lacks or misses it, and each line of the report in another language.

    main_prior: how often a line is in its page's language, by default as in the sample.
    """
    model = fit(labelled_sample(articles, per_language))
    main_prior = model.stay if main_prior is None else main_prior
    agreement = model.agreement
    pages = read_pages(articles, exemplar_index(articles), declared(articles["language"]), host_of(articles), model.line_scores)
    furniture = furniture_of(pages, title_tails(articles)).groupBy("id").agg(F.collect_list(F.col("line_no").cast("int")).alias("furniture"))
    read = pages.filter("NOT residue").select("id", "label", F.col("address").alias("host"), F.col("report_lines").alias("line_nos"), "scores", "title_scores")
    pages = join_counted(read, materialize(host_priors(articles), "host-priors"), ["host"], "_n", "left").join(furniture, "id", "left")

    def fuse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stay, leave = math.log(main_prior), math.log((1 - main_prior) / (len(LANGUAGES) - 1))
        for batch in batches:
            out: list[tuple[int, int, str, float]] = []
            for i, label, prior, numbers, flat, gone, title in zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True):
                s = np.array(flat, np.float64).reshape(-1, len(LANGUAGES))
                gone = set(gone or ())
                keep = np.array([n not in gone for n in numbers], bool)
                if not keep.any():
                    continue
                total = s[keep].sum(axis=0) + title_weight * np.array(title, np.float64)
                if prior:
                    total = total + np.log(prior)
                if label is not None:
                    total = total + np.log([agreement if x == label else (1 - agreement) / (len(LANGUAGES) - 1) for x in LANGUAGES])
                main = int(total.argmax())
                if label != LANGUAGES[main]:
                    out.append((i, 0, LANGUAGES[main], _confidence(total)))
                around = np.full(len(LANGUAGES), leave)
                around[main] = stay
                for n, line in zip(np.array(numbers)[keep], s[keep] + around, strict=True):
                    best = int(line.argmax())
                    if best != main:
                        out.append((i, int(n), LANGUAGES[best], _confidence(line)))
            columns = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.float64()), strict=True)], names=["id", "line_no", "lang", "confidence"])

    return pages.select("id", "label", "prior", "line_nos", "scores", "furniture", "title_scores").mapInArrow(fuse, OUT)


def _confidence(scores: np.ndarray) -> float:
    e = np.exp(scores - scores.max())
    return float(e.max() / e.sum())


def wrong_labels(articles: DataFrame) -> DataFrame:
    """p7: (id, line_no, lang)."""
    return detect_languages(articles).select("id", "line_no", "lang").distinct()
