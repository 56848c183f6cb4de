from __future__ import annotations

import base64
import random
from pathlib import Path

import pytest

from presswerk.llm import leaks, tokenizer
from presswerk.llm.leaks import leaked_items, leaked_passages, myers_best, words
from presswerk.llm.tokenizer import BytePairEncoder, RankQueue, encode_corpus

VOCABULARY = Path(tokenizer.VOCABULARY)
needs = pytest.mark.skipif(not VOCABULARY.exists(), reason="no vocabulary here")


def test_rank_queue_against_a_sorted_list():
    r, q, held = random.Random(2), RankQueue(70_000), {}
    for _ in range(5000):
        if held and r.random() < 0.4:
            low = q.lowest()
            assert low == min(held) and sorted(q.take(low)) == sorted(held.pop(low))
        else:
            k, v = r.randrange(70_000), r.randrange(100)
            held.setdefault(k, []).append(v)
            q.push(k, v)
    while held:
        assert sorted(q.take(q.lowest())) == sorted(held.pop(min(held)))
    assert q.lowest() == -1


@pytest.fixture(scope="module")
def encoder():
    return BytePairEncoder.from_text(VOCABULARY.read_bytes())


@pytest.fixture(scope="module")
def public():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, VOCABULARY.read_bytes().splitlines())}
    return tiktoken.Encoding("own", pat_str=tokenizer.PATTERN, mergeable_ranks=ranks, special_tokens={})


@needs
def test_ids_against_the_public_library(encoder, public):
    r = random.Random(3)
    texts = ["", " ", "\r\n\t x", "<|endoftext|>", "Zürich's l’été 東光商事 👩🏽‍💼 עברית", "a" * 20_000, "ab" * 9000, "é" * 5000, "!?" * 4000, " " * 3000 + "x"]
    texts += ["".join(r.choice("abcäöß '12\n.,-東👍") for _ in range(r.randint(1, 400))) for _ in range(150)]
    for t in texts:
        assert encoder.encode(t) == public.encode_ordinary(t)
        assert b"".join(encoder.names[i] for i in encoder.encode(t)).decode() == t


@needs
def test_encode_corpus(spark, encoder):
    rows = [(1, "Hallo Welt", "x"), (2, "", "x"), (3, None, "x"), (1, "Hallo Welt", "x"), (None, "Hallo", "x")]
    df = spark.createDataFrame(rows, "doc_id int, text string, ids string")
    got = [(r["doc_id"], r["ids"]) for r in encode_corpus(df).collect()]
    assert sorted(got, key=str) == sorted([(i, encoder.encode(t)) for i, t, _ in rows], key=str)
    assert encode_corpus(df.limit(0)).count() == 0


def levenshtein_best(p, t):
    row = [0] * (len(t) + 1)
    for i, x in enumerate(p, 1):
        new = [i]
        for j, y in enumerate(t, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_myers_against_dynamic_programming():
    r = random.Random(4)
    for _ in range(800):
        p, t = [r.randrange(4) for _ in range(r.randint(1, 90))], [r.randrange(4) for _ in range(r.randint(0, 30))]
        assert myers_best(p, t) == levenshtein_best(p, t)


def longest_run(a, b):
    best = 0
    for i in range(len(a)):
        for j in range(len(b)):
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
            best = max(best, n)
    return best


def sample():
    r = random.Random(5)
    vocabulary = [f"wort{k}" for k in range(400)]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randint(5, 50)))) for i in range(25)]
    docs = []
    for d in range(60):
        body = [r.choice(vocabulary) for _ in range(r.randint(0, 60))]
        source = items[r.randrange(25)][1].split()
        n = r.randint(8, 20)
        at = r.randrange(max(1, len(source) - n))
        piece = [w.upper() if r.random() < 0.5 else w for w in source[at : at + n]]
        if r.random() < 0.3 and len(piece) > 6:
            piece[6] = "anders"
        docs.append((d, " ".join([*body[:20], *piece, *body[20:]]) + "."))
    return docs, items


@pytest.mark.parametrize("limit", [10**9, 1000])
def test_leaks_against_brute_force(spark, limit):
    docs, items = sample()
    d = spark.createDataFrame([*docs, (900, None), (901, ""), (902, "Été, déjà vu! " * 3)], "doc_id int, text string").withColumnRenamed("text", "text")
    e = spark.createDataFrame([*items, (800, None), (801, "kurz"), items[0]], "item_id int, text string")
    found = leaked_passages(d, e, 13, 1, block_chars=limit)
    exact = {(r["doc_id"], r["item_id"]) for r in found.filter("run >= 13").collect()}
    assert exact == {(a, b) for a, t in docs for b, u in items if longest_run(words(t), words(u)) >= 13}
    # Windows with one wrong word are found as well.
    for r in found.collect():
        assert r["errors"] <= 1
    near = {(r["doc_id"], r["item_id"]) for r in found.collect()}
    for a, t in docs:
        for b, u in items:
            w, v = words(u), words(t)
            if any(levenshtein_best(w[i : i + 13], v) <= 1 for i in range(len(w) - 12)) and len(w) >= 13:
                assert (a, b) in near


def test_numbers_agree_with_the_words():
    index = leaks.ItemIndex([(1, "zehn ½ m² été ﬁlm " * 4)], 13, 1)
    for text in ("Zehn ½ M² ÉTÉ e\u0301te\u0301 ﬁlm", "nichts davon", "", "x½y zehn½"):
        for _ in range(2):
            assert index.numbers(text) == [index.vocabulary.get(w, -1) for w in words(text)]


def test_leaked_items(spark):
    text = "eins zwei drei vier fünf sechs sieben acht neun zehn elf zwölf dreizehn"
    d = spark.createDataFrame([(1, "x " + text.upper().replace("FÜNF", "funf") + " y", 0), (1, text, 0), (2, text[:-9], 0)], "doc_id int, text string, item_id int")
    e = spark.createDataFrame([(7, text), (8, text)], "item_id int, text string")
    assert sorted(map(tuple, leaked_items(d, e).collect())) == [(1, 7), (1, 8)]
    assert leaked_items(d.limit(0), e).count() == 0 and leaked_items(d, e.limit(0)).count() == 0
