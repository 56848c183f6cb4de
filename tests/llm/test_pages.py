from __future__ import annotations

import pytest

from presswerk.llm import furniture, language, residue
from presswerk.llm.residue import ExemplarIndex, has_slot, residue_pages, tokens

REPORT = [
    "Die Firma {0} meldete am Montag, dass {1} Angestellte betroffen sind. Das Gericht prüft nun die Bücher und hört die Gläubiger an.",
    "Nach Angaben von {0} bleiben die Lieferungen bis zum {1}. Mai gesichert, wie ein Sprecher am Abend mitteilte.",
]
NAMES = [f"{a}{b} AG" for a in ("Falmo", "Torve", "Casti", "Helro", "Norvi", "Brilo") for b in ("nor", "pak", "lux", "fin", "dor")]
SCHEMA = "id int, source string, url string, language string, title string, content string"


def pages(n=60):
    out = []
    for i in range(n):
        name = NAMES[i % len(NAMES)] + f" {chr(97 + i // len(NAMES))}"
        body = [x.format(name, i) for x in REPORT]
        content = ["Startseite | Sport | Kultur", "Text: Agenturen/Bote Altenau", body[0], f"Was das für {name} bedeutet", body[1], f"© 20{i:02} Bote Altenau – Impressum"]
        out.append((i, "Bote Altenau", "https://bote.example/x", "de", f"{name} meldet Konkurs an (Altenau, {i},5 Mio. Franken): Banken halten sich bedeckt", "\n".join(content)))
    return out


def test_furniture(spark):
    rows = pages()
    rows[3] = (*rows[3][:5], rows[3][5] + "\nLesen Sie auch: Xeno AG streicht Stellen – Altenau: 7,5 Mio. Franken, Banken halten sich bedeckt")
    rows += [(900, None, None, None, None, None), (901, None, None, None, None, "Nur ein Satz, der hier steht."), (902, "Bote Altenau", None, "de", "t", ""), (1, *rows[1][1:]), (903, "Bote Altenau", None, "de", "t", "wort " * 30_000)]
    # A report that is copied very often is still no furniture.
    rows += [(1000 + k, *rows[7][1:]) for k in range(40)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {tuple(r) for r in furniture.furniture_lines(df).collect()}
    want = {(r[0], n) for r in rows if r[5] and len(r[5].split("\n")) >= 6 for n in (1, 2, 6)} | {(3, 7)}
    assert got == want
    assert furniture.furniture_lines(df.limit(0)).count() == 0
    clean = {r["id"]: r["content"] for r in furniture.report_only(df.filter("id < 60")).collect()}
    assert clean[5].split("\n") == [rows[5][5].split("\n")[k] for k in (2, 3, 4)]


CASES = [
    "Please enable JavaScript to view this page.", "404 Not Found\nhttps://a.example/x", "Ihre Sitzung ist abgelaufen. Bitte melden Sie sich neu an.", "Traceback (most recent call last): KeyError: 'x'",
    "Blindtext Firma meldet Konkurs an, damit das Layout geprüft werden kann.", "Lorem ipsum dolor sit amet. Consectetur adipiscing elit.", "undefined undefined undefined [object Object] abc",
    "\n".join(REPORT) + "\nDie Firma {{ name }} meldete am Montag Verluste, sagte {1} dazu.", REPORT[0] + "\n" + REPORT[1] + " Dictum donec cursus ligula massa varius urna.",
]
FINE = [
    "\n".join(REPORT).format("X AG", 3), "\n".join(REPORT).format("X AG", 3) + "\nFür die Kommentarfunktion muss JavaScript aktiviert sein.",
    "\n".join(REPORT).format("X AG", 3) + "\nDer Onlineshop von X AG zeigte am 3. Mai stundenlang nur den Fehler 404 und später «Service nicht verfügbar» an, bestätigte P. Muster.",
    "\n".join(REPORT).format("X AG", 3) + "\nIn der Vorlage für Mahnungen {Betrag, Frist, Adresse} fehlte bei X AG laut Bericht die Belehrung [sic].", "", "   \n ", "Kurz.", "Ein Wort " * 20_000,
]


def test_residue(spark):
    rows = [(i, t) for i, t in enumerate(CASES)] + [(100 + i, t) for i, t in enumerate(FINE)] + [(999, None), (None, CASES[0]), (0, CASES[0])]
    df = spark.createDataFrame([(*r, "Firma AG meldet Konkurs an – Altenau", "https://a.example/firma-ag-cbjt", "Bote Altenau", "x") for r in rows], "id int, content string, title string, url string, source string, kind string")
    assert sorted(r["id"] for r in residue_pages(df).collect()) == list(range(len(CASES)))
    assert residue_pages(df.limit(0)).count() == 0


@pytest.mark.parametrize("text", ["{{ ort }}", "${amount}", "#{place}", "%(count)s", "<%= lieu %>", "{%x%}", "[[ort]]", "@@betrag@@", "__DATE__", "%FIRMA%", "{0}", "<LIEU>", "[date à compléter]", "[MONTANT EINFÜGEN]", "XXX ort XXX", "TK count TK"])
def test_slots(text):
    assert has_slot(f"Ein Satz mit {text} darin.") and not has_slot("Ein Satz mit 20 % und {a, b} sowie [sic] und <p> darin.")


def test_every_exemplar_finds_itself():
    index = ExemplarIndex({}, 1000)
    for kind, texts in residue.EXEMPLARS.items():
        for t in texts:
            w = tokens(t.replace("*", "irgend etwas"))
            assert index.is_filler(w) if kind == "filler" else index.kind(w) is not None, t


# Wordings that no exemplar has: the first set was used to choose the bar of the pool, the second wasn't.
VALIDATION = [
    "Leider konnten wir die gewünschte Seite nicht finden.", "Dieser Inhalt existiert nicht mehr.", "Bitte aktivieren Sie Cookies und JavaScript in den Einstellungen Ihres Browsers.", "Ein interner Fehler ist aufgetreten.",
    "La page que vous avez demandée n'existe pas.", "Une erreur interne est survenue, veuillez réessayer plus tard.", "Activez JavaScript dans votre navigateur pour afficher ce contenu.", "La pagina richiesta non è stata trovata sul server.",
    "Si è verificato un errore interno, riprovate più tardi.", "Per visualizzare il sito attivate JavaScript.", "Sorry, the page you were looking for could not be found.", "The page has been moved or removed.", "Please turn on JavaScript in your browser settings.", "Your session has expired, please log in again.",
]

HELD_OUT = [
    "Die aufgerufene Seite wurde nicht gefunden.", "Diese Seite ist zurzeit nicht erreichbar, versuchen Sie es später.", "Aktivieren Sie bitte JavaScript, damit die Seite angezeigt werden kann.", "Hoppla, hier ist etwas schiefgegangen.",
    "Page introuvable : l'adresse demandée n'existe plus.", "Vous n'avez pas la permission de voir cette page.", "Veuillez activer les scripts dans votre navigateur.", "La risorsa richiesta non esiste.",
    "Accesso negato: non avete i diritti necessari.", "Abilitate JavaScript per usare questa applicazione.", "This page is currently unavailable.", "You must enable JavaScript to see this content.", "The service is down, please try again later.", "Access to this resource was denied.",
]


def test_wordings_held_out():
    index = ExemplarIndex({t: 50_000 for t in residue.STOP_WORDS}, 100_000)
    for texts in (VALIDATION, HELD_OUT):
        found = [t for t in texts if index.page(t)[0]]
        assert len(found) >= 0.7 * len(texts), set(texts) - set(found)
    report = "\n".join(REPORT).format("X AG", 3)
    assert not any(index.page(f"{report}\n{t}")[0] for t in VALIDATION + HELD_OUT)


def test_long_slots_and_windows():
    index = ExemplarIndex({}, 1000)
    assert has_slot("Betrag: {{ " + "x" * 300 + " }}") and has_slot("[[" + "y" * 90 + "]]")
    long = "Traceback (most recent call last): " + "KeyError in module " * 200
    assert index.page(long)[0] and not index.page("Das Gericht prüft die Bücher der Firma heute noch einmal genau. " * 500)[0]


TEXT = {
    "de": ["Das Gericht prüft nun, ob genügend Mittel für die Gläubiger vorhanden sind.", "Die Kundschaft wurde am Montag über den Entscheid informiert und bleibt ruhig."],
    "fr": ["Le tribunal examine désormais si les moyens suffisent pour les créanciers.", "La clientèle a été informée lundi de la décision et garde son calme."],
    "it": ["La pretura verifica ora se i mezzi bastano per i creditori della ditta.", "La clientela è stata informata lunedì della decisione e resta tranquilla."],
    "en": ["The court is now examining whether there are enough funds for the creditors.", "Clients were told about the decision on Monday and they stay calm for now."],
}


def word(k):
    """A name that stands in one row only, so that no line looks like furniture."""
    return "".join("bdfgklmnprst"[k // 12**i % 12] + "aeiou"[(k + i) % 5] for i in range(4)).capitalize()


def test_languages(spark):
    rows, k = [], 0
    for lang, (a, b) in TEXT.items():
        for n in range(30):
            rows.append((k, "s", "https://h.example/x", lang if n else "xx", "t", f"{a} {word(k)}.\n{b} {word(k)}."))
            k += 1
    other = {"de": "fr", "fr": "it", "it": "en", "en": "de"}
    want = {(i * 30, 0, lang) for i, lang in enumerate(TEXT)}
    for i, lang in enumerate(TEXT):
        foreign = TEXT[other[lang]][0]
        rows.append((500 + i, "s", None, {"de": " DE ", "fr": "fr_CH", "it": "ita", "en": None}[lang], "t", f"{TEXT[lang][0]} {word(500 + i)}.\n{foreign} {word(510 + i)}.\n{TEXT[lang][1]} {word(520 + i)}."))
        want.add((500 + i, 2, other[lang]))
    want.add((503, 0, "en"))
    rows.append((600, "s", None, "it", "t", f"{TEXT['fr'][0]} {word(600)}.\n{TEXT['fr'][1]} {word(601)}."))
    want.add((600, 0, "fr"))
    # As much of one language as of the other: the title tells which is the report's.
    rows.append((650, "s", None, "de", f"{TEXT['de'][1]}", f"{TEXT['de'][0]} {word(650)}.\n{TEXT['fr'][0]} {word(651)}.\n{TEXT['fr'][1]} {word(652)}."))
    want |= {(650, 2, "fr"), (650, 3, "fr")}
    rows += [(700, "s", None, None, None, None), (701, "s", None, None, None, ""), (702, None, None, None, None, "404 Not Found")]
    df = spark.createDataFrame(rows, SCHEMA)
    found = language.detect_languages(df)
    assert {tuple(r[:3]) for r in found.collect()} == want and all(0.25 <= r["confidence"] <= 1 for r in found.collect())


def test_language_model_on_held_out_rows(spark, folder):
    df = spark.read.parquet(f"{folder}/documents.parquet").selectExpr("doc_id AS id", "lang", "text").filter("lang IS NOT NULL AND length(text) > 200").collect()
    train, held = [r for r in df if r["id"] % 2], [r for r in df if not r["id"] % 2]
    model = language.fit([(r["lang"], r["text"]) for r in train])
    right = sum(language.LANGUAGES[model.line_scores([language._WORD.findall(r["text"].casefold())])[0].argmax()] == r["lang"] for r in held)
    assert right >= 0.97 * len(held)


def test_two_messages_on_one_line():
    index = ExemplarIndex({}, 1000)
    line = "404 - Seite nicht gefunden. Bitte aktivieren Sie JavaScript, um diese Seite anzuzeigen."
    assert index.page(line)[0] and index.page(line.replace(". ", ".\n"))[0]
    prose = "Das Gericht prüft nun, ob genügend Mittel für die Gläubiger vorhanden sind. Die Kundschaft wurde am Montag über den Entscheid informiert und bleibt ruhig."
    assert not index.page(prose)[0]
