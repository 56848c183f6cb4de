"""New batches against everything accepted before.

A title's story is its firm, place, event and amount, or its issue number. Its fingerprint has 64
bits, each the sign of a weighted vote of the story's features (SimHash), of which none outvotes
the rest; it is stored in one table for each pair of its five blocks, rotated so that the pair
leads and is the key. Two fingerprints that differ in up to three bits agree in two blocks, so
they meet in a table; a meeting is verified by Hamming distance and then by the texts of both
titles. What must be equal word for word (firm, amount or number) is part of every key, so that a
key isn't shared by titles that can't tell the same. Short titles without a firm change more bits
with each word, so they also stand in one table without any one of their words, and those with a
number without words at either end.

Checking a batch looks its own keys up in the history's tables and appends what is new; the
history is never fingerprinted again, and nothing of it is shuffled.

A row is a case if an earlier accepted row has its hash or tells its story; cases are not
accepted. Likeness is not carried on: what is like a case only is none. A title that names no
event is like any of its firm, place and amount. Another spelling of a firm is another firm.

Rows of one story and hash collapse before any pairing, so that a title copied a million times is
one entry of the tables.

Defined results: null hashes and blank titles repeat nothing; rows of runs without a start come
after all others; rows with one id count as one row.
"""

from __future__ import annotations

import html
import re
import unicodedata
import uuid
from collections.abc import Iterator
from decimal import Decimal
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from presswerk.operators.skew import HOT_ROWS, join_counted
from presswerk.session import materialize, shared_path

#: Blocks of the fingerprint as (first bit, width); any two of five agree at a distance of up to three.
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
PAIRS = [(a, b) for a in range(5) for b in range(a + 1, 5)]
MAX_DISTANCE = 3
#: So many keys of a batch are broadcast to the history (16 MB); more are joined by shuffling.
BROADCAST_KEYS = 1_000_000
# Legal forms, joined in names; words that mark news items; words of amounts.
LEGAL = frozenset("ag sa gmbh sarl sagl kg srl spa ltd limited inc plc llc se nv bv oy ab asa sas snc corp".split())
_JOINERS = frozenset("holding sohne soehne group gruppe co cie und and et e fils figli bruder freres fratelli international".split())
_TAG = re.compile(
    r"^\W*(?:(?:eilmeldung|exklusiv|exclusif|esclusiva?|exclusive|update|aktualisiert|mis a jour|aggiornamento|aggiornato|ultim'?ora|ultima ora|breaking(?: news)?|just in|flash|urgent|urgente|"
    r"mise a jour|derniere(?: minute| heure)|live|ticker|video|bilder|analyse|analisi|analysis|kommentar|alert|news|wirtschaft|newsticker|top|neu|new|nouveau|nuovo|in kurze|en bref|in breve|in brief)\b\s*[:|–—+»/-]+\s*)+"
)
_BRACKETED = re.compile(r"^\W*\[[^\[\]]+\]\s*")
_FUNCTION_WORDS = {
    "de": "der die das den dem des ein eine und mit sich gegen auf ihr ihre am um zur zum vom fur im in an ist wird wurde nicht keine neue franken millionen was heute folge ausgabe",
    "fr": "le la les des du une un ses son et en aux pour par dans ce est qui de francs avec leur ete sur",
    "it": "il lo la le gli della dei con un una i suo e al alla nel franchi di stato da vende ricordare sui",
    "en": "the an its of with for to and in by on is are were this that at what no issue francs",
}

_NUMBER = r"(?P<n>\d{1,3}(?:['’ ]\d{3})+(?:[.,]\d+)?|\d+(?:[.,]\d+)?)"
_UNIT = r"(?P<u>mrd\.?|milliarden?|milliards?|miliardi|billion|bn|mio\.?|millionen|million|millions?|milioni|m)\b\.?"
_AMOUNT = re.compile(rf"(?:chf|fr\.?|eur|€|\$)?\s*{_NUMBER}\s*{_UNIT}(?:\s*(?:de |di )?(?:franken|francs?|franchi|chf|fr\.))?|(?:chf|fr\.)\s*(?P<p>\d{{1,3}}(?:['’., ]\d{{3}})+|\d+(?:[.,]\d+)?)")
_WORD = re.compile(r"[^\W_]+")
_CUT = re.compile(r"(?:\.{3}|…|\[\.\.\.\])")
_DASH = re.compile(r"[–—]|\s-+\s")
_BREAK = re.compile(r"[:|+()–—,]|\s-+\s|\.{3}|…")


def fold(text: str) -> str:
    """Without case, accents, umlaut spelling and character references; white space collapsed."""
    text = html.unescape(html.unescape(text)).casefold()
    if not text.isascii():
        text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return " ".join(text.split())


def _umlauts(token: str) -> str:
    return token.replace("ae", "a").replace("oe", "o").replace("ue", "u")


FUNCTION_WORDS = {lang: frozenset(map(_umlauts, w.split())) for lang, w in _FUNCTION_WORDS.items()}


def _words(text: str) -> list[str]:
    return [_umlauts(w) for w in _WORD.findall(text)]


def title_language(words: list[str], names: frozenset[str] = frozenset()) -> str:
    """The language whose function words prevail, or an empty text. names: words of firms and places, which tell nothing."""
    scores = {lang: sum(w in known for w in words) for lang, known in FUNCTION_WORDS.items()}
    best = max(scores.values())
    leaders = [lang for lang, s in scores.items() if s == best]
    if not best:
        return ""
    if leaders == ["fr", "it"]:
        # They share articles; but Italian words end in a, i or o, which French ones hardly do.
        long = [w for w in words if len(w) > 3 and not w[0].isdigit() and w not in names]
        return "it" if sum(w[-1] in "aio" for w in long) > 0.2 * len(long) else "fr"
    return leaders[0] if len(leaders) == 1 else ""


class Story:
    """What a title tells: language, firm, place, event, amount or number."""

    __slots__ = ("amount", "event", "firm", "lang", "place")

    def __init__(self, lang: str, firm: tuple[str, ...], place: str, event: tuple[str, ...], amount: str) -> None:
        self.lang, self.firm, self.place, self.event, self.amount = lang, firm, place, event, amount

    def text(self) -> str:
        return "\t".join((self.lang, " ".join(self.firm), self.place, " ".join(self.event), self.amount))

    @classmethod
    def of(cls, text: str) -> Story:
        lang, firm, place, event, amount = text.split("\t")
        return cls(lang, tuple(firm.split()), place, tuple(event.split()), amount)


def _value(number: str, unit: str) -> str:
    number = re.sub(r"['’ ]", "", number).replace(",", ".")
    if number.count(".") > 1:
        number = number.replace(".", "")
    value = float(number) * (1000 if unit.startswith(("mrd", "mill" if "milliard" in unit else "mrd", "miliard", "b")) else 1)
    return f"{value:g}" if value < 1e6 else f"{value:.0f}"


def read_title(title: str, source: str = "") -> Story:
    """The story of a title; its language is empty, and agrees with any, where the words don't tell."""
    t = fold(title)
    outlet = fold(source)
    t = t.strip(" +|–—-:")
    for _ in range(3):
        before = t
        t = _TAG.sub("", _BRACKETED.sub("", t)).strip(" +|–—-:")
        if outlet and t.startswith(outlet):
            t = t[len(outlet) :].strip(" +|–—-:")
        if t == before:
            break
    m = None
    for m in _AMOUNT.finditer(t):
        break
    words = _words(t)
    # The last word of a title that was cut may be a piece of another.
    words = words[:-1] if _CUT.search(t) else words
    lang = title_language(words)
    if m is None:
        t = t.strip("() ")
        if outlet and t.endswith(outlet):
            t = t[: -len(outlet)].strip(" +|–—-:()")
        words = _words(t)
        number = next((w for w in words if w.isdigit()), "")
        return Story(lang, (), "", tuple(w for w in words if w != number), f"#{number}")
    amount = _value(m["n"] or m["p"], m["u"] or "")
    head = t[: m.start()]
    # Tokens with what separates each from the one before.
    tokens: list[tuple[str, str]] = []
    end = 0
    for w in _WORD.finditer(head):
        tokens.append((_umlauts(w[0]), head[end : w.start()]))
        end = w.end()
    closing = head[end:]
    legal = next((k for k, (w, _) in enumerate(tokens) if w in LEGAL and k), None)
    if legal is None:
        return Story(lang, (), "", tuple(w for w, _ in tokens), amount)
    first = legal - 1
    while first > 0 and tokens[first][0] in _JOINERS:
        first -= 1
    # A name has two words before its legal form; it may not reach over a break.
    if first > 0 and not _BREAK.search(tokens[first][1]):
        first -= 1
    firm = tuple(sorted(w for w, _ in tokens[first : legal + 1] if w not in _JOINERS or w == "holding"))
    before, after = tokens[:first], tokens[legal + 1 :]
    if before:
        place, event = before[-1][0], [w for w, _ in after]
    elif after and "(" in after[0][1]:  # <firm> (<place>) <event> – <amount>
        n = next((k for k in range(1, len(after)) if ")" in after[k][1]), 1)
        place, event = " ".join(w for w, _ in after[:n]), [w for w, _ in after[n:]]
    elif any("(" in sep for _, sep in after):  # <firm> <event> (<place>, <amount>)
        n = next(k for k, (_, sep) in enumerate(after) if "(" in sep)
        place, event = " ".join(w for w, _ in after[n:]), [w for w, _ in after[:n]]
    elif any(_DASH.search(sep) for _, sep in after[-3:]):  # <firm> <event> – <place>: <amount>
        n = max(k for k, (_, sep) in enumerate(after) if _DASH.search(sep))
        place, event = " ".join(w for w, _ in after[n:]), [w for w, _ in after[:n]]
    elif after and _DASH.search(closing):  # <firm> <place> <event> – <amount>
        place, event = after[0][0], [w for w, _ in after[1:]]
    elif after:  # <firm> <event> – <place>: <amount>
        place, event = after[-1][0], [w for w, _ in after[:-1]]
    else:
        place, event = "", []
    return Story(title_language(words, frozenset((*firm, *place.split()))), firm, place, tuple(event), amount)


@lru_cache(200_000)
def _vote(feature: str) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(blake2b(feature.encode(), digest_size=8).digest(), np.uint8))
    return bits.astype(np.int8) * 2 - 1


def _sign(votes: np.ndarray) -> int:
    return int(np.packbits(votes > 0).view(">i8")[0])


def fingerprint(story: Story) -> int:
    """64 bits as a signed number. Where a firm is named, the event, where misspellings and synonyms stand, has no vote."""
    votes = np.zeros(64, np.int32)
    if story.firm:
        for w in story.firm:
            votes += 3 * _vote(w)
        return _sign(votes + 2 * _vote("@" + story.place) + min(7, 3 * len(story.firm)) * _vote("=" + story.amount))
    for w in story.event:
        votes += 2 * _vote(w[:4])
    return _sign(votes + _vote("=" + story.amount)) if story.amount != "#" else _sign(votes)


def variants(story: Story) -> list[int]:
    """Fingerprints of a title without firm: of all its words, without each one, and, if it has a number, of the beginnings and ends of at least three fifths of it."""
    if story.firm:
        return []
    votes = [_vote(w[:4]).astype(np.int32) for w in story.event]
    whole, n = sum(votes, np.zeros(64, np.int32)), len(votes)
    out = {_sign(whole)} | {_sign(whole - v) for v in votes if n > 1}
    if story.amount != "#":
        least = max(2, -(-3 * n // 5))
        for side in (votes, votes[::-1]):
            running = np.cumsum(side, axis=0) if n else []
            out |= {_sign(running[k - 1]) for k in range(least, n)}
    return sorted(out)


def gate(story: Story) -> int:
    """What must agree word for word: firm, and amount or number."""
    return int.from_bytes(blake2b(("\t".join((*story.firm, story.amount))).encode(), digest_size=8).digest(), "little", signed=True)


def near(a: str, b: str, edits: int) -> bool:
    """Whether two words are at most so many insertions, deletions, changes or swaps of neighbours apart."""
    if abs(len(a) - len(b)) > edits:
        return False
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            cost = min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y))
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, before[j - 2] + 1)
            new.append(cost)
        before, row = row, new
        if min(row) > edits:
            return False
    return row[-1] <= edits


def _alike(a: str, b: str) -> bool:
    """The same word but for a misspelling; folding may have made two changes of it."""
    short, long = sorted((len(a), len(b)))
    return a == b or (short > 4 and near(a, b, 2 if short > 5 and long > 6 else 1))


def same_story(a: Story, b: Story) -> bool:
    """Verification by the texts."""
    if a.amount != b.amount or (a.lang and b.lang and a.lang != b.lang):
        return False
    if not a.firm or not b.firm:
        if a.firm or b.firm or not a.event or not b.event:
            return False
        short, long = sorted((a.event, b.event), key=len)
        return sum(any(_alike(x, y) for y in long) for x in short) >= 0.6 * len(short) and _alike(a.event[0], b.event[0])
    if a.firm != b.firm:
        return False
    if a.place != b.place and not (a.place in b.event and b.place in a.event):
        return False
    telling = lambda s: [w for w in s.event if len(w) > 3 and w not in FUNCTION_WORDS["de"] | FUNCTION_WORDS["fr"] and w != a.place]
    x, y = telling(a), telling(b)
    short, long = sorted((x, y), key=len)
    return sum(any(_alike(p, q) for q in long) for p in short) >= 0.5 * len(short)


STORY = "id bigint, ord decimal(38,0), url_hash string, story string, fp bigint, gate bigint, variants array<bigint>"


def read_titles(rows: DataFrame) -> DataFrame:
    """STORY of rows with id, ord, url_hash, title and source."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stories: list[Story | None] = []
            for title, source in zip(*(batch.column(k).to_pylist() for k in (3, 4)), strict=True):
                story = read_title(title, source or "") if title and not title.isspace() else None
                stories.append(None if story is None or not (story.firm or story.event) else story)
            cell = lambda f, t: pa.array([None if x is None else f(x) for x in stories], t)  # noqa: B023, E731
            columns = [cell(Story.text, pa.string()), cell(fingerprint, pa.int64()), cell(gate, pa.int64()), cell(variants, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), *columns], names=["id", "ord", "url_hash", "story", "fp", "gate", "variants"])

    return rows.select(
        F.col("id").cast("bigint").alias("id"), F.col("ord").cast("decimal(38,0)").alias("ord"), *[F.col(c).cast("string").alias(c) for c in ("url_hash", "title", "source")]
    ).mapInArrow(run, STORY)


def block_tables(stories: DataFrame) -> DataFrame:
    """(block, story, fp) of (story, fp, gate, variants): each fingerprint in its ten rotated tables, each variant under itself; block stands for the gate, the table and its leading bits."""
    rows = []
    for number, (a, b) in enumerate(PAIRS):
        parts = [F.shiftrightunsigned("fp", BLOCKS[k][0]).bitwiseAND(F.lit((1 << BLOCKS[k][1]) - 1)) for k in (a, b)]
        rows.append(F.struct(F.xxhash64("gate", F.lit(number), F.shiftleft(parts[0], 13) + parts[1]).alias("block"), "fp"))
    more = F.transform("variants", lambda v: F.struct(F.xxhash64("gate", F.lit(len(PAIRS)), v).alias("block"), v.alias("fp")))
    return stories.select("story", F.explode(F.concat(F.array(*rows), more)).alias("_r")).select("_r.block", "story", "_r.fp")


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(a, b) for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if same_story(Story.of(a), Story.of(b))]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in (0, 1)], names=["a", "b"])


def verified_pairs(left: DataFrame, right: DataFrame, itself: bool = False) -> DataFrame:
    """(a, b): distinct stories of two block tables that tell the same; of one table with itself each pair once."""
    a, b = left.alias("a"), right.alias("b")
    met = a.join(b, F.col("a.block") == F.col("b.block")).filter("a.story < b.story" if itself else "a.story != b.story")
    met = met.filter(F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= MAX_DISTANCE)
    return met.select(F.col("a.story").alias("a"), F.col("b.story").alias("b")).distinct().mapInArrow(_verify, "a string, b string")


def accepted_rows(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """(ord, url_hash, story) of the rows that no earlier accepted row repeats, among such rows.

    pairs: (a, b), each once, of the stories that tell the same; a story tells the same as
    itself. ord is unique; a null url_hash or story is shared with no row. Rows that share both
    with an earlier row are cases whatever becomes of that one, so only the first of each
    (url_hash, story) is decided. A round accepts the rows that come first among the undecided
    ones by their hash, their story and the stories like it, and drops those that an accepted
    one repeats; so every row is compared with accepted rows only.
    """
    single = rows.filter("url_hash IS NULL AND story IS NULL").select("ord", "url_hash", "story")
    open_rows = materialize(rows.filter("url_hash IS NOT NULL OR story IS NOT NULL").groupBy("url_hash", "story").agg(F.min("ord").alias("ord")), "open")
    like = materialize(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))), "alike")
    out = single
    while left := open_rows.count():
        known = left if left < HOT_ROWS else None
        firsts = {k: open_rows.filter(f"{k} IS NOT NULL").groupBy(k).agg(F.min("ord").alias("first"), F.count("*").alias("_n")) for k in ("url_hash", "story")}
        firsts["story"] = materialize(firsts["story"], "first-story")
        # The first row of any story like it: messages combine before the shuffle.
        told = like.join(firsts["story"].select(F.col("story").alias("b"), F.col("first").alias("_f")), "b").groupBy(F.col("a").alias("story")).agg(F.min("_f").alias("_f"))
        firsts["story"] = materialize(firsts["story"].join(told, "story", "left").select("story", F.least("first", F.coalesce("_f", "first")).alias("first"), "_n"), "first-alike")
        if known is None:
            firsts["url_hash"] = materialize(firsts["url_hash"], "first-hash")
        marked = open_rows
        for k, first in firsts.items():
            marked = join_counted(marked, first.withColumnRenamed("first", f"first_{k}"), [k], "_n", "left", total=known)
        wins = lambda k: F.col(k).isNull() | (F.col(f"first_{k}") == F.col("ord"))
        now = materialize(marked.filter(wins("url_hash") & wins("story")).select("ord", "url_hash", "story"), "accepted")
        out = out.unionByName(now)
        taken = {
            "url_hash": now.filter("url_hash IS NOT NULL").select("url_hash"),
            "story": now.filter("story IS NOT NULL").select("story").unionByName(like.join(now.select(F.col("story").alias("b")), "b", "left_semi").select(F.col("a").alias("story"))).distinct(),
        }
        rest = open_rows
        for k, keys in taken.items():
            marks = keys.join(firsts[k].select(k, "_n"), k).withColumn("_taken", F.lit(True))
            if known is None:
                marks = materialize(marks, f"taken-{k}")
            rest = join_counted(rest, marks, [k], "_n", "left", total=known).filter("_taken IS NULL").drop("_taken")
        open_rows = materialize(rest.select("ord", "url_hash", "story"), "open")
    return out


def ordered(articles: DataFrame, runs: DataFrame) -> DataFrame:
    """articles with `ord`: batches by start, rows within one by id. There is one row a run to sort."""
    starts = runs.filter("run_id IS NOT NULL").groupBy("run_id").agg(F.min("started_at").alias("_start"))
    missing = articles.select("run_id").filter("run_id IS NOT NULL").distinct().join(starts, "run_id", "left_anti").withColumn("_start", F.lit(None).cast("timestamp"))
    every = starts.withColumn("_start", F.col("_start").cast("timestamp")).unionByName(missing)
    numbers = materialize(every.select("run_id", F.row_number().over(Window.orderBy(F.asc_nulls_last("_start"), "run_id")).alias("_run")), "run-order")
    run = F.coalesce("_run", F.lit((1 << 31) - 1)).cast("decimal(10,0)")
    # The run's number above the 64 bits of the id.
    place = run * F.lit(Decimal(1 << 64)).cast("decimal(20,0)") + F.col("id").cast("bigint").cast("decimal(20,0)")
    return articles.join(F.broadcast(numbers), "run_id", "left").withColumn("ord", place.cast("decimal(38,0)")).drop("_run")


class History:
    """Accepted rows and their block tables, kept in a folder and extended batch by batch.

    Each check writes its rows under a version of its own and then commits the version by one
    more row of a small log; what isn't committed is never read, so a check that failed or runs
    again leaves no halves and no doubles. A check under a name that is committed already gives
    the same cases again.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _log(self) -> dict[str, str]:
        """Versions by the name of their check: one row a batch."""
        try:
            return {r["name"]: r["version"] for r in self.spark.read.schema("name string, version string").parquet(f"{self.folder}/commits").collect()}
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return {}

    def _read(self, part: str, schema: str, versions: list[str]) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[f"{self.folder}/{v}/{part}" for v in versions])

    def accepted(self) -> DataFrame:
        """(id, url_hash, story) of all accepted rows."""
        versions = list(self._log().values())
        schema = "id bigint, url_hash string, story string"
        return self._read("accepted", schema, versions) if versions else self.spark.createDataFrame([], schema)

    def _met(self, keys: DataFrame, table: DataFrame, key: str) -> DataFrame:
        """The rows of a history table that hold a key of the batch; the history stays where it is as long as the keys are few."""
        return table.join(F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys, key, "left_semi")

    def check(self, batch: DataFrame, name: str | None = None, runs: DataFrame | None = None) -> DataFrame:
        """(id) of the rows of the batch that repeat an accepted row; the others are accepted and appended.

        runs: orders a batch of several runs, one after the other; without it rows go by id.
        """
        log, name = self._log(), name or uuid.uuid4().hex
        if name in log:
            return self._read("cases", "id bigint", [log[name]])
        rows = batch.filter("id IS NOT NULL")
        rows = ordered(rows.select("id", "run_id", "url_hash", "title", "source"), runs) if runs is not None else rows.withColumn("ord", F.col("id").cast("bigint").cast("decimal(38,0)"))
        told = materialize(read_titles(rows), "told")
        size = told.agg(F.count("*").alias("n"), F.count_distinct("id").alias("k")).first()
        if size["n"] != size["k"]:
            told = materialize(told.groupBy("id").agg(F.min_by(F.struct(*told.drop("id").columns), "ord").alias("_r")).select("id", "_r.*"), "told-once")
        stories = materialize(told.filter("story IS NOT NULL").groupBy("story").agg(*[F.first(c).alias(c) for c in ("fp", "gate", "variants")]), "stories")
        blocks = materialize(block_tables(stories), "block-tables")
        versions, fresh = list(log.values()), told.select("ord", "url_hash", "story")
        if versions:
            old = self._read("blocks", "block bigint, story string, fp bigint", versions)
            met = materialize(self._met(blocks.select("block").distinct(), old, "block"), "met")
            alike = verified_pairs(blocks, met).select(F.col("a").alias("story")).unionByName(stories.select("story").join(met.select("story").distinct(), "story", "left_semi")).distinct()
            hashes = fresh.filter("url_hash IS NOT NULL").select("url_hash").distinct()
            known = materialize(self._met(hashes, self._read("accepted", "id bigint, url_hash string, story string", versions).select("url_hash"), "url_hash").distinct(), "known-hashes")
            fresh = materialize(fresh.join(alike, "story", "left_anti").join(known, "url_hash", "left_anti"), "fresh")
        kept = materialize(accepted_rows(fresh, verified_pairs(blocks, blocks, itself=True)), "kept")
        version = f"v-{uuid.uuid4().hex}"
        ids = told.select("ord", "id")
        ids.join(kept, "ord").select("id", "url_hash", "story").write.parquet(f"{self.folder}/{version}/accepted")
        new = stories.join(kept.select("story").distinct(), "story", "left_semi")
        block_tables(new).write.parquet(f"{self.folder}/{version}/blocks")
        ids.join(kept.select("ord"), "ord", "left_anti").select("id").write.parquet(f"{self.folder}/{version}/cases")
        self.spark.createDataFrame([(name, version)], "name string, version string").coalesce(1).write.mode("append").parquet(f"{self.folder}/commits")
        return self._read("cases", "id bigint", [version])


def repeated_rows(articles: DataFrame, runs: DataFrame) -> DataFrame:
    """p1: (id) of the rows that repeat a row accepted before: a history's first check, of all batches in their order."""
    spark = articles.sparkSession
    return History(spark, shared_path(spark, "history")).check(articles, runs=runs)
