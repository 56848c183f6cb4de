from __future__ import annotations

import random

import pytest

from presswerk.llm import history as H
from presswerk.llm import mojibake as M

SAME = [
    ("Falmo Bau AG (Altenau) schliesst das Produktionswerk – CHF 12,3 Mio.: Banken halten sich bedeckt", "ALTENAU: FALMO BAU AG SCHLIESST DAS PRODUKTIONSWERK, 12.3 MIO. FRANKEN – BANKEN"),
    ("Falmo Bau AG (Altenau) schliesst das Produktionswerk – CHF 12,3 Mio.: Banken halten sich bedeckt", "Eilmeldung – Falmo Bau AG stoppt das Produktoinswerk (Altenau, 12,3 Millionen Franken): Banken…"),
    ("Torve Pharma & Söhne AG erhält neue Kreditlinie – Mötthofen: 5,0 Mio. Franken, Gemeinde prüft Unterstützung", "+++ Torve Pharma &amp; Soehne AG bekommt neue Kreditlinie &ndash; Moetthofen: CHF 5,0 Mio., Gemeinde prueft +++ | Bote Altenau"),
    ("Helro SA (Chênavens) dépose le bilan – 7,5 millions de francs: le conseil prend position", "[Actualisé] Helro SA depose le bilan (Chenavens, 7.5 mio de francs): le conseil prend position"),
    ("Credit barometer, issue 121", " CREDIT BAROMETER ISSUE 121 "),
]
OTHER = [
    ("Falmo Bau AG (Altenau) meldet Konkurs an – CHF 12,3 Mio.: Banken", "Falmo Bau AG (Altenau) meldet Konkurs an – CHF 12,4 Mio.: Banken"),
    ("Falmo Bau AG (Altenau) meldet Konkurs an – CHF 12,3 Mio.: Banken", "Falmo Bau AG (Corboz) meldet Konkurs an – CHF 12,3 Mio.: Banken"),
    ("Falmo Bau AG (Altenau) meldet Konkurs an – CHF 12,3 Mio.: Banken", "Falmo Bau AG (Altenau) streicht Arbeitsplätze – CHF 12,3 Mio.: Banken"),
    ("Falmo Bau AG (Altenau) meldet Konkurs an – CHF 12,3 Mio.: Banken", "Falmu Bau AG (Altenau) meldet Konkurs an – CHF 12,3 Mio.: Banken"),
    ("Helro SA (Altenau) perd un mandat important – CHF 1,5 mio: le conseil prend position", "Helro SA (Altenau) perde un mandato importante – CHF 1,5 mio: il consiglio prende posizione"),
    ("Credit barometer, issue 121", "Credit barometer, issue 122"),
]


@pytest.mark.parametrize(("a", "b"), SAME)
def test_same_story(a, b):
    x, y = H.read_title(a, "Bote Altenau"), H.read_title(b, "Bote Altenau")
    assert H.same_story(x, y) and H.same_story(y, x) and H.Story.of(x.text()).text() == x.text()
    assert H.gate(x) == H.gate(y)
    assert (H.fingerprint(x) ^ H.fingerprint(y)).bit_count() <= H.MAX_DISTANCE or set(H.variants(x)) & set(H.variants(y))


@pytest.mark.parametrize(("a", "b"), OTHER)
def test_other_story(a, b):
    assert not H.same_story(H.read_title(a), H.read_title(b))


def test_two_of_five_blocks_meet_within_three_bits(spark):
    r = random.Random(1)
    base = [r.getrandbits(64) for _ in range(40)]
    moved = [b ^ sum(1 << k for k in r.sample(range(64), 3)) for b in base]
    sign = lambda x: x - (1 << 64) if x >> 63 else x
    tables = [H.block_tables(spark.createDataFrame([(f"{n}{i}", sign(x)) for i, x in enumerate(xs)], "story string, fp bigint").selectExpr("*", "7L AS gate", "CAST(array() AS array<bigint>) AS variants")) for n, xs in (("a", base), ("b", moved))]
    met = tables[0].alias("a").join(tables[1].alias("b"), "block").selectExpr("a.story AS a", "b.story AS b").distinct().collect()
    assert {(f"a{i}", f"b{i}") for i in range(40)} <= {tuple(m) for m in met}


def brute(rows):
    accepted, cases = [], set()
    for i, h, t in rows:
        s = H.read_title(t) if t and t.strip() else None
        if any((h is not None and h == g) or (s and z and H.same_story(s, z)) for g, z in accepted):
            cases.add(i)
        else:
            accepted.append((h, s))
    return cases


def rows():
    titles = [t for p in SAME + OTHER for t in p]
    r = random.Random(2)
    out = [(i, r.choice(["h1", "h2", None, *[f"u{i}"] * 6]), r.choice([*titles, None, "  "])) for i in range(80)]
    return out


def batches(spark):
    data = [(i, f"r{i // 20}", h, t, "Bote Altenau", "de", "extra") for i, h, t in rows()]
    df = spark.createDataFrame(data, "id int, run_id string, url_hash string, title string, source string, language string, story string")
    # Batches are ordered by their start, not by name or id.
    runs = spark.createDataFrame([("r0", "2025-01-03 00:00:00"), ("r1", "2025-01-01 00:00:00"), ("r2", "2025-01-02 00:00:00"), ("r3", None)], "run_id string, s string").selectExpr("run_id", "CAST(s AS timestamp) AS started_at")
    order = [x for run in (1, 2, 0, 3) for x in rows() if x[0] // 20 == run]
    return df, runs, order


def test_repeated_rows_against_brute_force(spark):
    df, runs, order = batches(spark)
    assert {r["id"] for r in H.repeated_rows(df, runs).collect()} == brute(order)
    assert H.repeated_rows(df.limit(0), runs).count() == 0


def test_history_batch_by_batch(spark, tmp_path):
    df, _, order = batches(spark)
    store, found = H.History(spark, str(tmp_path / "history")), set()
    for run in ("r1", "r2", "r0", "r3"):
        found |= {r["id"] for r in store.check(df.filter(df["run_id"] == run), run).collect()}
    assert found == brute(order)
    # Every row is either accepted once or a case; a check that runs again changes nothing.
    before = store.accepted().count()
    again = {r["id"] for r in store.check(df.filter("run_id = 'r0'"), "r0").collect()}
    assert again <= found and store.accepted().count() == before == len(rows()) - len(found)


def test_uncommitted_versions_are_not_read(spark, tmp_path):
    store = H.History(spark, str(tmp_path / "h"))
    df = spark.createDataFrame([(1, "x", "Helro SA (Altenau) perd un mandat – CHF 1,5 mio", "")], "id int, url_hash string, title string, source string")
    store.check(df, "a")
    df.selectExpr("CAST(9 AS bigint) AS id", "'y' AS url_hash", "'z' AS story").write.parquet(str(tmp_path / "h/v-broken/accepted"))
    assert [r["id"] for r in store.accepted().collect()] == [1]
    assert store.check(df.selectExpr("2 AS id", "'y' AS url_hash", "'nothing else' AS title", "source"), "b").count() == 0


CHAIN = [
    (1, "r1", "Falmonor AG (Altenau) meldet Konkurs an – 5,5 Mio. Franken"), (2, "r1", "Falmonor AG (Altenau) dépose le bilan – 5,5 millions de francs"),
    (3, "r2", "Falmonor AG (Altenau) baut Werk mit neuen Stellen aus – 5,5 Mio. Franken"), (4, "r3", "Falmonor AG (Altenau) – 5,5 Mio."),
]


@pytest.mark.parametrize(("last", "cases"), [(3, set()), (4, {4})])
def test_likeness_is_not_carried_on(spark, tmp_path, last, cases):
    df = spark.createDataFrame([(*r, f"u{r[0]}", "") for r in CHAIN[:last]], "id int, run_id string, title string, url_hash string, source string")
    runs = spark.createDataFrame([(f"r{k}", k) for k in (1, 2, 3)], "run_id string, k int").selectExpr("run_id", "timestamp_seconds(k) AS started_at")
    assert {r["id"] for r in H.repeated_rows(df, runs).collect()} == cases
    store, found = H.History(spark, str(tmp_path / "chain")), set()
    for run in ("r1", "r2", "r3"):
        found |= {r["id"] for r in store.check(df.filter(df["run_id"] == run)).collect()}
    assert found == cases


def test_general_titles_share_no_fingerprint():
    r = random.Random(4)
    words = ["".join(r.choice("bdfgklmnprstaeiou") for _ in range(7)) for _ in range(3000)]
    for n in (5, 8, 13):
        stories = [H.read_title(" ".join(r.choice(words) for _ in range(n))) for _ in range(500)]
        assert not any(s.firm for s in stories) and len({H.fingerprint(s) for s in stories}) > 495
        keys = [k for s in stories for k in {H.gate(s) ^ v for v in H.variants(s)}]
        assert max(keys.count(k) for k in set(keys)) <= 3


CLEAN = ["Die Firma kündigt für Mötthofen über zwanzig Verträge an, erklärte der Geschäftsführer später.", "La société de Chênavens a été fondée à l’été, précise le conseil.", "Per città e società la liquidità è più tesa, perché però manca."]
PROPER = ["80‰ ½ № 3 m³ Öl, 7 ÷ 2, § 5", "IRMÃOS CORRÊA LTDA in São Brandão", "d’Åsgård, l’ÂGE moyen «Ærger» OÙ", "Ελληνική русское 東光商事 עברית 👩🏽‍💼", "M&uuml;ller &amp; Co.", "Zürich café", "", "plain ascii"]


def damaged():
    out = []
    for written, read, errors in (("utf-8", "cp1252", "replace"), ("utf-8", "latin-1", "strict"), ("utf-8", "mac_roman", "strict"), ("utf-8", "cp850", "strict"), ("cp1252", "mac_roman", "strict"), ("cp1252", "cp850", "strict"), ("mac_roman", "cp1252", "replace"), ("cp1252", "utf-8", "replace")):
        for t in CLEAN:
            out.append(t.encode(written).decode(read, errors))
    out.append(CLEAN[0].encode().decode("latin-1").encode().decode("latin-1"))
    # Down to a single word.
    return [*out, "Alles in Ordnung, nur fÃ¼r eines nicht.", "Der Ort heisst M÷tthofen und sonst nichts.", "Die Post nach Ch�navens kam an."]


def test_garbled_documents(spark):
    clean = [(i, t) for i, t in enumerate([*CLEAN * 30, *PROPER * 3])]
    bad = [(1000 + i, t) for i, t in enumerate(damaged())]
    df = spark.createDataFrame([(*r, "x") for r in [*clean, *bad, (5000, None), (None, bad[0][1]), bad[0]]], "doc_id int, text string, token string")
    assert {r["doc_id"] for r in M.garbled_documents(df).collect()} == {i for i, _ in bad}
    fixed = {r["doc_id"]: r["restored"] for r in M.restored_documents(df).collect()}
    assert sum(fixed[1000 + i] in CLEAN for i in range(21)) >= 17
    assert fixed[1000 + len(damaged()) - 3] == "Alles in Ordnung, nur für eines nicht."
    assert M.garbled_documents(df.limit(0)).count() == 0


def test_shuffled_lookup_equals_broadcast(spark, monkeypatch):
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*CLEAN * 5, *damaged()])], "doc_id int, text string")
    want = {r["doc_id"] for r in M.garbled_documents(df).collect()}
    monkeypatch.setattr(M, "BROADCAST_TOKENS", 0)
    assert {r["doc_id"] for r in M.garbled_documents(df).collect()} == want


def test_garbled_spelling_that_copies_make_common(spark):
    words = ["erhält", "zählt", "könnte", "schön"]
    clean = [f"{w} und {k}" for k in range(3) for w in words]
    # One text in more rows than all clean ones, and a skeleton with more spellings than TWINS.
    bad = " ".join(w.encode("cp850").decode("cp1252", "replace") for w in words) + " " + "Gläubiger".encode("cp1252").decode("cp850")
    more = [f"Gl{x}ubiger Nummer {k}" for x in "äáâàã" for k in range(4)] + ["Läge".encode("cp1252").decode("cp850"), "Läge", "Läge heute", "Häge".encode("cp1252").decode("cp850"), "Häge", "Häge heute"]
    rows = [(k, t) for k, t in enumerate(clean + more)] + [(1000 + k, bad) for k in range(60)]
    got = {r["doc_id"] for r in M.garbled_documents(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    garbled = {k for k, t in rows if t == bad or "õ" in t}
    assert got == garbled


def test_long_tokens(spark):
    run = "東光商事" * 60 + "für" + "名古屋" * 60
    rows = [(1, run), (2, run.encode().decode("latin-1")), (3, "a" * 100_000 + " ä")]
    assert [r["doc_id"] for r in M.garbled_documents(spark.createDataFrame([*rows, (4, "für für")], "doc_id bigint, text string")).collect()] == [2]


def test_spelling_beyond_the_commonest(spark, monkeypatch):
    monkeypatch.setattr(M, "TWINS", 1)
    bad = {w: w.encode("cp1252").decode("cp850") for w in ("Läge", "Häge", "Gläubiger")}
    rows = [w for w in ("Läge", "Häge", "Gläubiger") for _ in range(3)] + ["Gléubiger"] * 9 + list(bad.values())
    tokens = spark.createDataFrame([(k, t, k) for k, t in enumerate(rows)], "doc_id bigint, token string, text bigint")
    assert {r["token"]: r["fixed"] for r in M.garbled_tokens(tokens).collect()} == {v: k for k, v in bad.items()}
