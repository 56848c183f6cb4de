"""Template residue, filler, error pages and demands for scripts in place of report text.

Labelled exemplars of such text are kept in an inverted index from their rarest terms. Lines and
sentences are the passage windows; a window retrieves exemplars by its terms, and TF-IDF
containment (the share of the window's weight that the exemplar covers, or, for exemplars with
an open part, the share of the exemplar that the window covers in order) decides. A message in
other words is covered by several exemplars of one label and language together: their terms are
pooled, and a window that the pool covers, with several terms that only such messages have, has
its label. Document frequencies of the exemplars' terms are counted over all rows. Unfilled slots
are exemplars too, of signs instead of words: their opening signs are the index, what stands
between must have the form of a name or an expression.

A page is a case if a sentence or line is filler, a draft mark or holds an unfilled slot, or if
error and script messages make up at least half of its text. Pages of null or blank content
are no cases.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presswerk.functions.text import STOP_WORDS

# Labelled exemplars. An asterisk is an open part of any length; digits agree with any digits.
EXEMPLARS: dict[str, tuple[str, ...]] = {
    "error": (
        "404 Not Found", "Error 404 page not found", "404 – Seite nicht gefunden", "404 – page introuvable", "404 – pagina non trovata",
        "403 Forbidden", "401 Unauthorized", "500 Internal Server Error", "502 Bad Gateway", "503 Service Unavailable", "504 Gateway Timeout",
        "Internal server error. Our team has been told, try again later.", "Interner Serverfehler. Unser Team wurde benachrichtigt, versuchen Sie es später erneut.",
        "Erreur interne du serveur. Notre équipe est avertie, réessayez plus tard.", "Errore interno del server. Il team è stato avvisato, riprovate più tardi.",
        "The page you are looking for has gone or was moved.", "The page you requested could not be found.", "Sorry, this page does not exist.",
        "Die angeforderte Seite existiert nicht mehr oder wurde verschoben.", "Die gesuchte Seite konnte nicht gefunden werden.",
        "La page demandée n'existe plus ou a été déplacée.", "La page que vous cherchez est introuvable.",
        "La pagina richiesta non esiste più o è stata spostata.", "La pagina cercata non è stata trovata.",
        "Oops, something went wrong.", "Hoppla, da ist etwas schiefgelaufen.", "Oups, quelque chose s'est mal passé.", "Ops, qualcosa è andato storto.",
        "Access denied. You do not have permission for this resource.", "Zugriff verweigert. Ihnen fehlt die Berechtigung für diese Ressource.",
        "Accès refusé. Vous n'avez pas les droits pour cette ressource.", "Accesso negato. Mancano i diritti per questa risorsa.",
        "Your session has expired. Please sign in again.", "Ihre Sitzung ist abgelaufen. Bitte melden Sie sich neu an.",
        "Votre session a expiré. Veuillez vous reconnecter.", "La sessione è scaduta. Effettuate di nuovo l'accesso.",
        "Down for maintenance, we will be back shortly.", "Wartungsarbeiten: Wir sind gleich wieder für Sie da.",
        "Travaux de maintenance: nous revenons tout de suite.", "Lavori di manutenzione: torniamo subito.",
        "Service temporarily unavailable, please try again later.", "Dienst vorübergehend nicht verfügbar, bitte versuchen Sie es später erneut.",
        "Service momentanément indisponible, veuillez réessayer plus tard.", "Servizio temporaneamente non disponibile, riprovate più tardi.",
        "Diese Seite ist leider nicht verfügbar oder wurde gelöscht.", "Der angeforderte Inhalt ist nicht mehr vorhanden.", "Es ist ein unerwarteter Fehler aufgetreten, bitte versuchen Sie es noch einmal.",
        "Le document demandé n'est plus disponible ou a été supprimé.", "Une erreur inattendue est survenue, veuillez réessayer.", "Le contenu que vous cherchez n'existe pas.",
        "Il contenuto richiesto non è più disponibile o è stato rimosso.", "Si è verificato un errore imprevisto, si prega di riprovare.", "La pagina che cercate non esiste.",
        "We're sorry, the content you requested is no longer available or has been removed.", "An unexpected error has occurred, please try again.", "We could not find what you were looking for on our server.",
    ),
    "script": (
        "Please enable JavaScript to view this page.", "Please enable JavaScript and cookies to continue.", "You need to enable JavaScript to run this app.",
        "You need to turn on scripts and cookies in order to continue.", "This application needs scripts that your browser does not run.",
        "Bitte aktivieren Sie JavaScript, um diese Seite anzuzeigen.", "Diese Ansicht wird mit Skripten geladen; schalten Sie den Inhaltsblocker aus und laden Sie neu.",
        "Ihr Browser unterstützt die benötigten Skripte nicht. Diese Anwendung lässt sich ohne sie nicht starten.",
        "Veuillez activer JavaScript pour afficher cette page.", "Cette vue se charge par script; désactivez le bloqueur et rechargez.",
        "Votre navigateur n'exécute pas les scripts nécessaires; l'application ne peut démarrer.",
        "Attivate JavaScript per visualizzare questa pagina.", "Questa vista viene caricata via script; disattivate il blocco e ricaricate.",
        "Il browser non esegue gli script richiesti; l'applicazione non può partire.",
        "Just a moment, we are verifying that you are not a robot.", "Checking your browser before accessing the site.",
        "Einen Moment, wir prüfen Ihren Browser. Danach werden Sie weitergeleitet.", "Un instant, nous contrôlons votre navigateur avant de vous rediriger.",
        "Un attimo, stiamo verificando il vostro browser prima di proseguire.", "Bitte bestätigen Sie, dass Sie kein Roboter sind.",
        "Sie müssen JavaScript und Cookies aktivieren, um fortzufahren.", "Vous devez activer JavaScript et les cookies pour continuer.", "È necessario attivare JavaScript e i cookie per continuare.",
        "JavaScript ist in Ihrem Browser deaktiviert; schalten Sie es in den Einstellungen ein.", "Ohne JavaScript funktioniert diese Website nicht richtig.",
        "JavaScript est désactivé dans votre navigateur; activez-le dans les paramètres.", "Ce site nécessite JavaScript pour fonctionner correctement.",
        "JavaScript è disattivato nel browser; attivatelo nelle impostazioni.", "Questo sito richiede JavaScript per funzionare correttamente.",
        "JavaScript is disabled in your browser; turn it on in the settings.", "This site requires JavaScript to work properly and your browser does not support it.",
    ),
    # Machine messages with an open part.
    "message": (
        "Traceback (most recent call last): *", "Fatal error: Allowed memory size of 0 bytes exhausted *", "Fatal error: Uncaught *", "Warning: db_connect(): too many connections in * on line 0",
        "Warning: * on line 0", "HTTP Status 0 – * at *", "HTTP Error 0 *", "Error 0 / * / edge node blocked this request", "Too many requests (0). Retry after 0 seconds. *",
        "upstream request timeout, id=*", "upstream connect error or disconnect/reset before headers *", "Exception in thread * at *", "undefined undefined undefined *", "NullReferenceException at *",
    ),
    # Marks of text that is still to be written, with an open part.
    "draft": (
        "This is sample copy without content *; replace before release.", "Dies ist ein Beispieltext ohne Inhalt *; bitte vor der Freigabe ersetzen.",
        "Ceci est un texte d'exemple sans contenu *, à remplacer avant publication.", "Questo è un testo di esempio senza contenuto *, da sostituire prima della pubblicazione.",
        "Body copy about * goes here.", "Hier steht später der Fliesstext zum Thema *.", "Ici viendra plus tard le texte sur *.", "Qui andrà più tardi il testo su *.", "Qui seguirà il testo su *.",
        "Blindtext *, damit das Layout geprüft werden kann.", "Dummy text * to check the layout.", "Faux texte * pour contrôler la mise en page.", "Testo fittizio * per controllare l'impaginazione.", "Testo finto * per controllare l'impaginazione.", "Testo segnaposto * per controllare l'impaginazione.",
        "Noch kein Text erfasst – Entwurf *.", "No text entered yet – draft *.", "Aucun texte saisi – brouillon *.", "Nessun testo inserito – bozza *.",
    ),
    # Pseudo-Latin filler: a bag of words.
    "filler": (
        "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua ut enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum",
        "consec tetur varius urna lacus dictum donec cursus ligula massa arcu pretium porta torto mattis quam congue rutrum semper felis tortor nibh vitae augue lectus risus mauris pellentesque vestibulum curabitur aliquam vivamus suspendisse faucibus egestas tincidunt ultrices blandit viverra sagittis euismod phasellus quisque integer fusce praesent maecenas nullam etiam morbi proin aenean turpis sapien justo metus purus tellus neque ornare posuere interdum hendrerit",
    ),
}

# Labelled exemplars of slots that a template engine or an editor left unfilled: opening sign,
# closing sign, form of what stands between.
_NAME, _UPPER, _TAG = r"[\w.]+", r"[A-ZÄÖÜ][A-ZÄÖÜ0-9_.]*", r"[A-ZÄÖÜ][A-ZÄÖÜ0-9_.]{2,}"
SLOTS: tuple[tuple[str, str, str], ...] = (
    ("{{", "}}", r"[^{}\n]*"), ("{%", "%}", r"[^{}%\n]*"), ("<%", "%>", r"[^<>%\n]*"), ("${", "}", r"[^{}\n]*"), ("#{", "}", r"[^{}\n]*"), ("%(", ")s", _NAME), ("%(", ")d", _NAME), ("[[", "]]", r"[^\[\]\n]+"), ("@@", "@@", _NAME),
    ("__", "__", _UPPER), ("%", "%", _UPPER), ("{", "}", r"\d+|[a-z_]+(?:\.[a-z_]+)*"), ("<", ">", _TAG), ("[object ", "]", "Object"),
    ("[", "]", r"(?i:[\w.]+ (?:einfügen|ergänzen|einzusetzen|à compléter|à insérer|à remplir|da inserire|inserire|da completare|to complete|to insert|to be added)|(?:insert|your|einfügen|insérer|inserire) [^\[\]\n]+)"),
    ("XXX ", " XXX", _NAME), ("TK ", " TK", _NAME), ("TBD ", " TBD", _NAME), ("TODO ", " TODO", _NAME),
)
_OPENING = re.compile("|".join(re.escape(o) for o in sorted({o for o, _, _ in SLOTS}, key=len, reverse=True)))
_SLOTS_BY_SIGN = {o: [re.compile(rf"{re.escape(o)}\s*(?:{form})\s*{re.escape(c)}" if c[0] == " " else re.escape(o) + f"(?:{form})" + re.escape(c)) for x, c, form in SLOTS if x == o] for o, _, _ in SLOTS}
_TOKEN = re.compile(r"[^\W\d_]+|\d+")
_LETTERS = re.compile(r"[^\W\d_]+")
_DIGIT, _DIGITS = re.compile(r"\d"), re.compile(r"\d+")
_SENTENCE = re.compile(r"(?<=[.!?…])\s+")
_ADDRESS = re.compile(r"^\s*(?:https?://|www\.)\S+\s*$")
#: Letters of a word that a pool goes by.
STEM = 6
CLOSED, OPEN, FILLER = ("error", "script"), ("message", "draft"), ("filler",)


def words(text: str) -> list[str]:
    return _TOKEN.findall(text.casefold())


def folded(text: str) -> str:
    """Without case, and with every run of digits as one."""
    text = text.casefold()
    return _DIGITS.sub("0", text) if _DIGIT.search(text) else text


def tokens(text: str) -> list[str]:
    """The words with every run of digits as one term."""
    return _TOKEN.findall(folded(text))


def has_slot(text: str) -> bool:
    """Whether an exemplar of a slot stands in the text. A sign is looked up with the shorter ones that it begins with."""
    at = 0
    while m := _OPENING.search(text, at):
        at = m.start() + 1
        word_before = m[0][0].isalpha() and m.start() > 0 and (text[m.start() - 1].isalnum() or text[m.start() - 1] == "_")
        for n in range(len(m[0]), 0, -1):
            if not word_before and any(p.match(text, m.start()) for p in _SLOTS_BY_SIGN.get(m[0][:n], ())):
                return True
    return False


def vocabulary() -> list[str]:
    """Terms whose frequency in the corpus is counted: those of the exemplars, and common words."""
    return sorted({t for texts in EXEMPLARS.values() for x in texts for t in tokens(x)} | {t for t in STOP_WORDS if t.isalpha()})


class ExemplarIndex:
    """Exemplars by their rarest terms."""

    def __init__(self, frequency: dict[str, int], rows: int, closed: float = 0.8, opened: float = 0.9, filler: float = 0.75, pooled: float = 0.75) -> None:
        self.top = math.log(rows + 2)
        self.idf = {t: math.log((rows + 2) / (frequency.get(t, 0) + 1)) + 0.1 for t in vocabulary()}
        self.bars = {**dict.fromkeys(CLOSED, closed), **dict.fromkeys(OPEN, opened)}
        self.filler_bar, self.pooled_bar = filler, pooled
        #: Label, terms in order, terms with their weights, weight in all.
        self.exemplars: list[tuple[str, list[str], dict[str, tuple[int, float]], float]] = []
        self.postings: dict[str, list[int]] = {}
        for kind in (*CLOSED, *OPEN):
            for text in EXEMPLARS[kind]:
                t = tokens(text)
                have = {x: (n, self.idf[x]) for x, n in Counter(t).items()}
                rare = sorted(have.keys() - {"0"}, key=lambda x: (-self.idf[x], x))[:3]
                self.exemplars.append((kind, t, have, sum(n * w for n, w in have.values())))
                for term in rare:
                    self.postings.setdefault(term, []).append(len(self.exemplars) - 1)
        self.keys = set(self.postings)
        #: Terms of exemplars with an open part; and the weight of the heaviest window that a closed one can cover.
        self.open_keys = {t for t, found in self.postings.items() if any(self.exemplars[e][0] in OPEN for e in found)}
        self.heaviest = max(whole for kind, _, _, whole in self.exemplars if kind in CLOSED) / closed
        #: All terms of the closed exemplars, by their beginnings as words are inflected; and by label those that hardly any row of the corpus has.
        pools = {k: {t for x in EXEMPLARS[k] for t in tokens(x)} for k in CLOSED}
        self.pool = {t[:STEM] for pool in pools.values() for t in pool}
        rare = math.log((rows + 2) / (0.02 * rows + 1))
        self.marks = {k: {t[:STEM] for t in pool if len(t) > 4 and self.idf[t] >= rare} for k, pool in pools.items()}
        self.every_mark = set().union(*self.marks.values())
        self.latin = {t for x in EXEMPLARS["filler"] for t in tokens(x)}
        #: Latin words that no language of the corpus shares show that a passage may be filler.
        self.latin_keys = {t for t in self.latin if len(t) > 4}

    def weight(self, term: str) -> float:
        return self.idf.get(term, self.top)

    def kind(self, window: list[str]) -> str | None:
        """The label of the exemplar that covers the window, or None. A window is compared with every exemplar that shares one of its rarest terms and is heavy enough to cover it."""
        terms = self.keys.intersection(window)
        if not terms:
            return None
        get, top = self.idf.get, self.top
        total = sum([get(t, top) for t in window])
        if total > self.heaviest and self.open_keys.isdisjoint(terms):
            return None
        counts = Counter(window)
        hits = {e for t in terms for e in self.postings[t]}
        best, label = 0.0, None
        for e in hits:
            kind, terms, have, whole = self.exemplars[e]
            bar = self.bars[kind]
            # No more than its own weight can be shared; an open exemplar's is shared nearly whole.
            if (kind in CLOSED and whole < bar * total) or (kind not in CLOSED and bar * whole > total):
                continue
            shared = sum(w * min(k, counts[t]) for t, (k, w) in have.items() if t in counts)
            if kind in CLOSED:
                # Both ways: a window that the exemplar covers, and not a mere fragment of it.
                if shared < 0.35 * whole:
                    continue
                score = shared / total
            else:
                score = shared / whole
            if score >= bar and score > best and (kind in CLOSED or _in_order(terms, window)):
                best, label = score, kind
        return label

    def pooled(self, window: list[str]) -> str | None:
        """The label of most marks in the window, if it has two of them and the closed exemplars together cover it."""
        if len(window) < 4:
            return None
        stems = [t[:STEM] for t in window]
        if len(self.every_mark.intersection(stems)) < 2:
            return None
        # Words whose rows aren't counted are rare or not: they weigh half of what the rarest do.
        weights = [0.0 if t[0].isdigit() else self.idf.get(t, self.top / 2) for t in window]
        if sum(w for w, stem in zip(weights, stems, strict=True) if stem in self.pool) < self.pooled_bar * sum(weights):
            return None
        return max(CLOSED, key=lambda k: len(self.marks[k].intersection(stems)))

    def quoted(self, window: list[str], own: set[str]) -> str | None:
        """The label of an exemplar that stands whole in the window, next to the page's own words, beginnings of them and at most one other."""
        seen: set[int] = set()
        for term in self.keys.intersection(window):
            for e in self.postings[term]:
                kind, terms, *_ = self.exemplars[e]
                if e in seen or kind not in CLOSED:
                    continue
                seen.add(e)
                n = len(terms)
                for at in (k for k, t in enumerate(window) if t == terms[0]):
                    if window[at : at + n] == terms:
                        others = [t for t in window[:at] + window[at + n :] if t != "0" and t not in own and not any(o.startswith(t) for o in own)]
                        if len(others) <= 1:
                            return kind
        return None

    def sentences(self, line: str, keys: set[str]) -> list[tuple[str | None, int]]:
        """(label or None, tokens) of each sentence of a line of several; nothing if none has a label. keys: those of the line."""
        parts = _SENTENCE.split(line)
        if len(parts) < 2:
            return []
        # A sentence without a key has no label; only the others are looked at first.
        kinds: list[str | None] = []
        for s in parts:
            folded = s.casefold()
            kinds.append(self.kind(tokens(s)) if any(k in folded for k in keys) else None)
        if not any(kinds):
            return []
        return [(k, n) for k, n in zip(kinds, (len(tokens(s)) for s in parts), strict=True) if n]

    def is_filler(self, window: list[str]) -> bool:
        if len(window) < 3 or self.latin_keys.isdisjoint(window):
            return False
        covered = sum(self.weight(t) for t in window if t in self.latin)
        return covered >= self.filler_bar * sum(map(self.weight, window))

    def page(self, text: str, title: str | None = None, address: str | None = None, source: str | None = None) -> tuple[bool, dict[int, tuple[str, list[str], str]]]:
        """Whether the page is a case; and text, tokens and folded text of each line (from 1) that isn't empty or residue.

        Error pages name what was asked for: words of the page's own title, address and source
        are no evidence against an exemplar.
        """
        own: set[str] | None = None
        lines: dict[int, tuple[str, list[str], str]] = {}
        hit, residue, report, likely = False, 0, 0, 0
        keys, latin = self.keys, self.latin_keys
        marks = self.every_mark
        for number, line in enumerate(text.split("\n"), 1):
            plain = folded(line)
            window = _TOKEN.findall(plain)
            if not window:
                if line and not line.isspace():
                    lines[number] = (line, window, plain)
                continue
            kind, rest = None, len(window)
            if not keys.isdisjoint(window):
                kind = self.kind(window)
                if kind is None:
                    own = own or {*tokens(title or ""), *tokens(address or ""), *tokens(source or "")}
                    kind = self.quoted(window, own)
                if kind is None and (parts := self.sentences(line, keys.intersection(window))):
                    hit = hit or any(k == "draft" for k, _ in parts)
                    rest = sum(n for k, n in parts if k is None)
                    residue += len(window) - rest
                    if not rest:
                        continue
            if kind is not None:
                hit = hit or kind == "draft"
                residue += len(window)
                continue
            if not latin.isdisjoint(window) and any(self.is_filler(tokens(s)) for s in _SENTENCE.split(line)):
                hit = True
            if has_slot(line):
                hit = True
            lines[number] = (line, window, plain)
            if rest == len(window) and len(marks.intersection([t[:STEM] for t in window])) > 1 and any(self.pooled(tokens(x)) for x in _SENTENCE.split(line)):
                # Furniture speaks of scripts too: such a line counts for the page, but stays one of its lines.
                likely += rest
            elif rest >= 8 and not _ADDRESS.match(line):
                report += rest
        case = hit or (residue + likely > 0 and residue + likely >= report)
        return case, lines


def _in_order(terms: list[str], window: list[str]) -> bool:
    """Whether nine in ten of the terms stand in the window in their order."""
    at, found = 0, 0
    for t in terms:
        try:
            at = window.index(t, at) + 1
            found += 1
        except ValueError:
            pass
    return found >= 0.9 * len(terms)


def exemplar_index(articles: DataFrame) -> ExemplarIndex:
    """The index, with the document frequencies of its terms over all rows; at most one row per term comes to the driver."""
    terms = frozenset(vocabulary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for batch in batches:
            texts = batch.column(0).to_pylist()
            # Runs of digits are one term, which nearly every row has; it is counted as if all had it.
            counts.update({"0": len(texts)})
            for text in texts:
                counts.update(terms.intersection(_LETTERS.findall(text.casefold())))
        yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["t", "n"])

    texts = articles.select(F.col("content").cast("string").alias("content")).filter("content IS NOT NULL")
    found = {r["t"]: r["n"] for r in texts.mapInArrow(run, "t string, n bigint").groupBy("t").agg(F.sum("n").alias("n")).collect()}
    return ExemplarIndex(found, found.get("0", 0))


def residue_pages(articles: DataFrame) -> DataFrame:
    """p3: (id) of the rows whose content is residue, filler, an error page or a demand for scripts."""
    index = articles.sparkSession.sparkContext.broadcast(exemplar_index(articles))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page = index.value.page
        for batch in batches:
            found = [i for i, *t in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True) if page(*t)[0]]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], names=["id"])

    rows = articles.select(F.col("id").cast("bigint").alias("id"), *[F.col(c).cast("string").alias(c) for c in ("content", "title", "url", "source")]).filter("content IS NOT NULL AND id IS NOT NULL")
    return rows.mapInArrow(run, "id bigint").distinct()
