"""Text read in a wrong character encoding: finding it, and restoring it.

Garbled and clean spellings of a word agree in their ASCII characters. So the tokens with
non-ASCII characters are joined with their near-twins on the token stripped of these
characters; aligning a pair at its ASCII characters gives which characters were replaced by
which, and from that the transformation (written in one encoding, read in another, once or
twice) is inferred. Transformations that pairs of several tokens support are learned and
applied to the tokens that have no twin. All of this runs over the distinct tokens of the
corpus; documents are only read to list their tokens and to look them up again.

A token is garbled if it holds a replacement or a C1 control character; if a learned
transformation turns it into a more frequent token of the corpus; or if it turns back into
letters and punctuation and is implausible as it stands (multi-byte sequences, a sign or an
upper-case letter inside a lower-case word). Proper signs, names, character references and
combining accents stay. Null and empty texts have no tokens.
"""

from __future__ import annotations

import codecs
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from presswerk.session import materialize

# Encodings that texts are written in and read in.
WRITTEN = ("utf-8", "cp1252", "mac_roman", "cp850", "cp437")
READ = ("cp1252", "latin-1", "mac_roman", "cp850", "cp437", "cp1251", "cp1250", "iso8859-15", "koi8-r", "cp866")
#: Runs of letters, digits and non-ASCII characters. A plain space after Ã may be what became of a
#: no-break space.
TOKEN = re.compile("(?:[A-Za-z0-9\x80-\U0010ffff]|(?<=Ã) (?=[a-z]))+")
#: So many garbled tokens are broadcast; more are joined by shuffling.
BROADCAST_TOKENS = 200_000
#: The changes are learned from this many spellings of a skeleton; all others are looked up by what the learned changes make of them.
TWINS = 4


@lru_cache
def _reading(name: str) -> list[str]:
    """The character that each byte is read as; bytes without one stand for themselves."""
    out = []
    for b in range(256):
        try:
            out.append(codecs.decode(bytes([b]), name))
        except UnicodeDecodeError:
            out.append(chr(b))
    return out


@lru_cache
def _unreading(name: str) -> dict[str, int]:
    table: dict[str, int] = {}
    for b, c in enumerate(_reading(name)):
        table.setdefault(c, b)
    return table


@lru_cache(200_000)
def unread(segment: str, written: str, read: str) -> str | None:
    """What was written, if `segment` is how it was read; None if it can't be."""
    table = _unreading(read)
    try:
        return bytes(table[c] for c in segment).decode(written)
    except (KeyError, UnicodeDecodeError):
        return None


#: (written, read, times)
Change = tuple[str, str, int]
CHANGES: list[Change] = [(w, r, 1) for w in WRITTEN for r in READ if w != r and {w, r} != {"cp1252", "latin-1"} and {w, r} != {"cp1252", "iso8859-15"}] + [("utf-8", r, 2) for r in READ]


@lru_cache(200_000)
def undo(segment: str, change: Change) -> str | None:
    written, read, times = change
    out: str | None = segment
    for _ in range(times):
        if out is None or out.isascii():
            return None
        out = unread(out, written, read)
    return out if out != segment else None


@lru_cache(65_536)
def _fair(c: str) -> bool:
    """A character that clean text of Latin script is made of."""
    if c in "€’‘“”„«»–—…‹›·°§ ":
        return True
    return "\u00c0" <= c <= "\u017f" and c.isalpha()


_SEGMENT = re.compile(r"[^\x00-\x7f]+")
_NBSP = re.compile("(?<=Ã) ")


def segments(token: str) -> list[str]:
    """The non-ASCII stretches before, between and after the ASCII characters."""
    out = [""]
    for c in token:
        if c < "\x80":
            out.append("")
        else:
            out[-1] += c
    return out


def infer(clean: str, garbled: str) -> list[Change]:
    """The changes that turn clean into garbled, by alignment at the ASCII characters."""
    a, b = segments(clean), segments(garbled)
    if len(a) != len(b):
        return []
    differing = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    if not differing or any(not y or not all(map(_fair, x)) for x, y in differing):
        return []
    return [c for c in CHANGES if all(undo(y, c) == x for x, y in differing)]


def restore(token: str, change: Change) -> str | None:
    """The token with all its stretches turned back, as far as the change can have made them."""
    changed = False

    def one(m: re.Match[str]) -> str:
        nonlocal changed
        if (x := undo(m[0], change)) is not None:
            changed = True
            return x
        return m[0]

    out = _SEGMENT.sub(one, token)
    return out if changed else None


def _odd(token: str) -> bool:
    """A sign within a word, or an upper-case letter after a lower-case one, among the non-ASCII characters."""
    for i, c in enumerate(token):
        if c < "\x80":
            continue
        kind = unicodedata.category(c)
        if kind == "Cc":
            return True
        after = token[i + 1 : i + 2]
        if kind in ("Lm", "Sk", "Sm", "No", "So", "Sc") or c in "‰†‡¶¿¡ªº":
            if after.islower() and after.isalpha():
                return True
        elif kind == "Lu" and i and token[i - 1].islower():
            return True
    return False


def _case_fits(token: str) -> bool:
    """No lower-case non-ASCII letter right after two upper-case letters, no upper-case one after a lower-case one."""
    for i, c in enumerate(token):
        if c >= "\x80" and c.isalpha() and i and ((c.isupper() and token[i - 1].islower()) or (c.islower() and i > 1 and token[i - 2 : i].isupper())):
            return False
    return True


def judge(token: str, learned: list[Change]) -> str | None:
    """The restored token if it is garbled and has no twin to show it; None otherwise. Lossy damage restores nothing."""
    if "�" in token:
        return token
    token = _NBSP.sub("\xa0", token)
    odd = _odd(token)
    for change in learned:
        out = restore(token, change)
        if out is None or not all(_fair(c) for c in out if c >= "\x80") or not _case_fits(out):
            continue
        # A sequence that decodes as UTF-8 hardly ever stands there by chance.
        if change[0] == "utf-8" or odd:
            return out
    return token if any("\x80" <= c <= "\x9f" for c in token) else None


def _strange(token: str) -> int:
    """How many quotes, symbols and controls stand between letters. Apostrophes, dashes and dots are at home there."""
    inner = zip(token, token[1:], token[2:], strict=False)
    return sum(c >= "\x80" and a.isalpha() and z.isalpha() and (c in "„“”‚«»‰†‡¿¡" or unicodedata.category(c) in ("Sc", "Sk", "Sm", "So", "No", "Cc")) for a, c, z in inner)


def document_tokens(documents: DataFrame) -> DataFrame:
    """(doc_id, token, text): the distinct tokens with non-ASCII characters of each document, and a hash of its text. Texts are read once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = TOKEN.findall
        for batch in batches:
            docs: list[int] = []
            tokens: list[str] = []
            texts: list[int] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                mine = {t for t in find(text) if not t.isascii()}
                tokens += mine
                docs += [doc] * len(mine)
                texts += [int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)] * len(mine)
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(tokens, pa.string()), pa.array(texts, pa.int64())], names=["doc_id", "token", "text"])

    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id IS NOT NULL AND text IS NOT NULL AND octet_length(text) != length(text)")
    return materialize(docs.mapInArrow(run, "doc_id bigint, token string, text bigint"), "tokens")


def skeleton(token: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(token, "(?<=Ã) ", ""), r"[^\x00-\x7f]+", "")


def _told_by_signs(clean: str, garbled: str, change: Change) -> bool:
    """Which of two spellings is the garbled one is plain from the signs within it, whatever the counts.

    Letters don't tell: ä read as cp850 is õ, and õ in cp850 is read as ä.
    """
    return change[0] == "utf-8" or _strange(garbled) > _strange(clean)


def _twin_changes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for token, ref, common in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            for garbled, clean, sure in ((token, ref, common), (ref, token, False)):
                rows += [(garbled, clean, CHANGES.index(c)) for c in infer(clean, _NBSP.sub("\xa0", garbled)) if sure or _told_by_signs(clean, garbled, c)]
        columns = list(zip(*rows, strict=True)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int32())], names=["token", "fixed", "change"])


def garbled_tokens(tokens: DataFrame, min_support: int = 2) -> DataFrame:
    """(token, fixed): the garbled ones among (doc_id, token, text), restored where that is possible.

    text: what documents of one text share. Spellings are compared by their number of texts, and
    by documents only where that is equal.
    """
    # The documents of one text fall together before texts are counted.
    texts = tokens.groupBy("token", "text").agg(F.count("*").alias("k")).groupBy("token").agg(F.count("*").alias("texts"), F.sum("k").alias("documents"))
    vocabulary = texts.select("token", (F.shiftleft("texts", 32) + F.col("documents")).alias("n"), skeleton(F.col("token")).alias("skeleton"))
    vocabulary = materialize(vocabulary, "vocabulary")
    twins = vocabulary.filter(F.length("skeleton") >= 2)
    # The commonest spellings of a skeleton are what the others are compared with, to learn the
    # changes. Spellings beyond these are looked up below, by what the learned changes make of them.
    # A limit of ranks is kept to by every task before the shuffle, so no task gets all spellings.
    place = F.row_number().over(Window.partitionBy("skeleton").orderBy(F.desc("n"), F.desc("token")))
    refs = twins.withColumn("_place", place).filter(F.col("_place") <= TWINS).select("skeleton", F.col("n").alias("rn"), F.col("token").alias("ref"))
    pairs = twins.join(refs, "skeleton").filter("token != ref").select("token", "ref", (F.col("rn") >= F.col("n")).alias("common"))
    evidence = materialize(pairs.mapInArrow(_twin_changes, "token string, fixed string, change int"), "changes")
    # At most len(CHANGES) rows.
    support = evidence.groupBy("change").agg(F.count_distinct("fixed").alias("k")).orderBy(F.desc("k"), "change").collect()
    learned = [CHANGES[r["change"]] for r in support if r["k"] >= min_support]
    numbers = [CHANGES.index(c) for c in learned]
    shared = tokens.sparkSession.sparkContext.broadcast(learned)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(t, f) for t in batch.column(0).to_pylist() if (f := judge(t, shared.value)) is not None]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in (0, 1)], names=["token", "fixed"])

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for c in shared.value:
                    out = restore(_NBSP.sub("\xa0", t), c)
                    if out is not None and all(_fair(x) for x in out if x >= "\x80"):
                        rows.append((t, out, n, _told_by_signs(out, t, c)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.string(), pa.string(), pa.int64(), pa.bool_()))], names=["token", "fixed", "n", "sure"])

    known = vocabulary.select(F.col("token").alias("fixed"), F.col("n").alias("rn"))
    reached = vocabulary.filter(F.length("skeleton") >= 2).select("token", "n").mapInArrow(reach, "token string, fixed string, n bigint, sure boolean")
    by_lookup = reached.join(known, "fixed").filter("token != fixed AND (sure OR rn >= n)").select("token", "fixed", F.lit(0).alias("rank"))
    by_twin = evidence.filter(F.col("change").isin(numbers)).select("token", "fixed", F.lit(0).alias("rank"))
    by_change = vocabulary.select("token").mapInArrow(run, "token string, fixed string").withColumn("rank", F.lit(1))
    return by_twin.unionByName(by_lookup).unionByName(by_change).groupBy("token").agg(F.min_by("fixed", F.struct("rank", "fixed")).alias("fixed"))


def _located(documents: DataFrame, min_support: int) -> DataFrame:
    """(doc_id, token, fixed) of every garbled token in a document."""
    tokens = document_tokens(documents)
    found = materialize(garbled_tokens(tokens, min_support), "garbled")
    return tokens.drop("text").join(F.broadcast(found) if found.count() <= BROADCAST_TOKENS else found, "token")


def garbled_documents(documents: DataFrame, min_support: int = 2) -> DataFrame:
    """p10: (doc_id) of the documents with at least one garbled token."""
    return _located(documents, min_support).select("doc_id").distinct()


def restored_documents(documents: DataFrame, min_support: int = 2) -> DataFrame:
    """(doc_id, restored): the garbled documents with their garbled tokens replaced.

    A document is mostly damaged in one way: the change that explains most of its tokens is also
    tried on those that don't tell by themselves.
    """
    fixes = _located(documents, min_support).groupBy("doc_id").agg(F.map_from_entries(F.collect_set(F.struct("token", "fixed"))).alias("fixes"))
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).join(fixes, "doc_id")
    token = TOKEN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, pairs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                fix = dict(pairs)
                votes: dict[Change, int] = {}
                for t, f in fix.items():
                    for c in infer(f, _NBSP.sub("\xa0", t)):
                        votes[c] = votes.get(c, 0) + 1
                main = max(votes, key=votes.get, default=None) if votes and max(votes.values()) > 2 else None

                def mend(m: re.Match[str], fix: dict[str, str] = fix, main: Change | None = main) -> str:
                    t = m[0]
                    if main is not None and not t.isascii() and (x := restore(_NBSP.sub("\xa0", t), main)) and all(_fair(c) for c in x if c >= "\x80") and _case_fits(x):
                        return x
                    return fix.get(t, t)

                out.append(token.sub(mend, text))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["doc_id", "restored"])

    return docs.select("doc_id", "text", "fixes").mapInArrow(run, "doc_id bigint, restored string")
