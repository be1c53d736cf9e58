"""Template residue and error-page text.

Labelled exemplars of residue (filler, error pages, notices that scripts are needed) lie in an inverted index from word to exemplars.
They are the common wordings of servers, browsers and page builders in several languages, and no text of the corpus.  A window of
``WINDOW`` words slides over every passage; its containment is the share of its TF-IDF weight whose words the exemplars hold.  A window is
residue where one exemplar is retrieved with ``RETRIEVED`` and all those of a label together contain ``CONTAINMENT`` of it.  Such windows
cover their words, and a text is excluded when they cover its main part: ``COVERAGE`` of its words, headline and page furniture aside.

Placeholders are looked up by their notation (delimiters and kinds of names) among labelled exemplars of placeholders and of what looks
alike.  A text with an unfilled one is excluded wherever it stands, unless the passage around it is contained in the exemplars of passages
that explain placeholders.

Document frequencies are counted over all texts into 2**18 hashed slots, so what is broadcast has a fixed size; rare words that share a
slot only weigh a little less.  Two scans, one small aggregation, no shuffle of texts; texts are read whole.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.shared import received, share

WINDOW = 8
CONTAINMENT = 0.5  # of a window, in all exemplars of a label
RETRIEVED = 0.35  # of a window, in one of them
FLOOR = 10.0  # weight added to a full window, so that one of common words alone is contained in nothing
COVERAGE = 0.5
RAREST = 1e-5  # share of the texts below which words weigh the same
SLOTS = 1 << 18
MENTION = 0.5
STEM = 5  # letters of a word that count

# fixed values: labelled exemplars of residue, the common wordings of web servers, browsers, frameworks and page builders
EXEMPLARS = {
    "filler": [
        "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua. Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat. Duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur. Excepteur sint occaecat cupidatat non proident, sunt in culpa qui officia deserunt mollit anim id est laborum.",
        "Sed ut perspiciatis unde omnis iste natus error sit voluptatem accusantium doloremque laudantium, totam rem aperiam, eaque ipsa quae ab illo inventore veritatis et quasi architecto beatae vitae dicta sunt explicabo. Nemo enim ipsam voluptatem quia voluptas sit aspernatur aut odit aut fugit.",
        "Your text here. Insert your content here. Type something. Add a title, a subtitle, a headline or a heading. Click to edit or double-click to change this text block.",
        "Placeholder text. Sample text. Dummy text for layout and design. Body text goes here; title goes here; description goes here; caption goes here. Replace it with your own text or copy.",
        "Write a short paragraph or a few sentences about your company, team, product or service in this box. Tell your visitors your story. Start typing to add content.",
        "Welcome. This is your first post. Edit or delete it, then start writing. This is an example of a sample page. Just another site. Hello world.",
        "This page is under construction. Coming soon. Stay tuned. New content will be published or added here later; please check back soon. This section is empty, a draft, a stub; full version and more details to follow.",
        "Title: TBD. Summary: to be completed. Author: n/a. Date: TBA. Overview: tbc. Background: to be added. Conclusion: to be announced. Outlook: pending. Notes: none. Risks: to be determined. Budget: to be confirmed. Status: not available.",
        "foo bar baz qux foobar test test testing one two three asdf qwerty hjkl xxx yyy zzz blah blah",
        "The quick brown fox jumps over the lazy dog.",
    ],
    "error": [
        "404 Not Found. The requested URL was not found on this server. Page not found. File not found.",
        "The page you requested could not be found. It may have been moved, renamed or deleted, it no longer exists, or the address was mistyped. The link you followed may be broken or out of date.",
        "Sorry, we can't find what you are looking for. Try searching with the search box, go back to the previous page, or return to the home page.",
        "The resource you are looking for has been removed, had its name changed, or is temporarily unavailable.",
        "This page isn't working. The site is currently unable to handle this request. HTTP error. This site can't be reached; it took too long to respond. The connection was reset, was refused or timed out. Check your network or proxy.",
        "500 Internal Server Error. The server encountered an unexpected internal error or misconfiguration or condition and was unable to complete your request. Please contact the administrator.",
        "503 Service Unavailable. The service is temporarily unavailable; the server is unable to handle the request because of maintenance or overload. Please try again later, or retry after some minutes.",
        "502 Bad Gateway. The proxy server received an invalid response from an upstream server. 504 Gateway Timeout. The gateway did not receive a timely response. nginx apache openresty varnish cache server guru meditation.",
        "403 Forbidden. Access denied. You don't have permission or authorization to access or view this page, directory or resource on this server. 401 Unauthorized: authentication or valid credentials are required. Reference number.",
        "429 Too Many Requests. You have sent too many requests in a given time; the rate limit or quota was reached or exceeded. Slow down, wait and try again in an hour.",
        "Oops! Whoops! Something went wrong on our side. An error occurred while processing. Our engineers have been notified or informed and are working to fix the problem. Incident number, error id, request id, trace id, event id.",
        "Application error: an exception has occurred while loading; see the console or logs for more information. Reload or refresh the page in a few seconds. If the problem persists or keeps happening, contact support by email.",
        "This content is no longer available. The article, story, post or document was deleted, withdrawn, unpublished or archived by its author or publisher, or has expired.",
        "Your session has timed out or expired due to inactivity. Please log in or sign in again to continue reading.",
        "This content is not available in your country, region or location. Only subscribers and registered members can read or view this. Create an account or subscribe to continue. Not supported in your market.",
        "The site is down for scheduled maintenance and will be back online shortly. We are performing an upgrade, in progress now. Thank you for your patience. We apologize for the inconvenience.",
        "You are being redirected. Redirecting to another page. If you are not redirected automatically or nothing happens within seconds, click here or follow the link.",
        "The data could not be loaded. Failed to load or fetch the feed. No response from the server. No data received. Unable to connect or retrieve results.",
        '{"error": {"code": 404, "status": "error", "message": "resource not found", "details": [], "timestamp": 0, "path": "/", "request_id": "0", "trace_id": "0"}} upstream connect error or disconnect before headers; upstream request timeout; connection timeout; reset reason: overflow; no healthy upstream; success: false',
        "Traceback (most recent call last): File app.py, line 1, in module: raise. ValueError, TypeError, KeyError, AttributeError, IndexError, RuntimeError, ImportError: object has no attribute, invalid literal, list index out of range, not defined.",
        "Exception in thread main: java.lang.NullPointerException, java.lang.IllegalStateException, java.io.IOException, java.net.ConnectException, java.net.UnknownHostException: connection refused, read timed out at com.example.Main.run(Main.java:1) at Loop.next, Reader, Handler, Socket, Thread, Client. Caused by: more.",
        "Fatal error: Uncaught exception, call to undefined function in index.php on line 1. Warning: undefined variable. Error establishing a database connection. SQL syntax error near. Segmentation fault, core dumped.",
        "html head title 404 Not Found 403 Forbidden 502 Bad Gateway 503 Service Temporarily Unavailable 504 Gateway Time-out title head body center h1 h1 center hr nginx center body html doctype public",
        "Seite nicht gefunden. Die angeforderte Seite konnte leider nicht gefunden werden. Sie existiert nicht mehr, wurde gelöscht, verschoben oder umbenannt, oder ist nicht mehr verfügbar. Prüfen Sie die Adresse oder gehen Sie zurück zur Startseite. Dieser Artikel oder Inhalt ist abgelaufen.",
        "Interner Serverfehler. Es ist ein Fehler aufgetreten. Der Dienst ist derzeit vorübergehend nicht erreichbar oder verfügbar. Bitte versuchen Sie es später noch einmal oder erneut. Fehlercode, Fehlernummer. Zugriff verweigert: Sie haben keine Berechtigung. Wartungsarbeiten. Ihre Sitzung ist abgelaufen, bitte melden Sie sich erneut an.",
        "Page introuvable. La page demandée n'existe pas ou plus, a été supprimée ou déplacée, ou n'est plus disponible. Le lien est rompu ou a expiré. Vérifiez l'adresse ou retournez à la page d'accueil.",
        "Erreur interne du serveur. Une erreur est survenue ou s'est produite. Le service est temporairement ou momentanément indisponible. Veuillez réessayer ultérieurement ou plus tard. Code d'erreur, référence. Accès refusé ou interdit: vous n'avez pas l'autorisation. Site en maintenance. Votre session a expiré, veuillez vous reconnecter.",
        "Página no encontrada. La página solicitada o que busca no existe, no está disponible, ha sido eliminada o movida. El enlace está roto, ha caducado o la dirección es incorrecta. Vuelva a la página de inicio.",
        "Error interno del servidor. Se ha producido un error. El servicio no está disponible temporalmente en este momento. Inténtelo de nuevo más tarde. Código de error. Acceso denegado: no tiene permiso. Sitio en mantenimiento. Su sesión ha caducado o expirado, inicie sesión de nuevo.",
        "Pagina non trovata. La pagina richiesta non esiste o è stata rimossa o spostata. Errore interno del server. Si è verificato un errore. Il servizio non è al momento disponibile. Riprova più tardi. Accesso negato.",
        "Página não encontrada. A página solicitada não existe ou foi removida. Erro interno do servidor. Ocorreu um erro. O serviço está temporariamente indisponível. Tente novamente mais tarde. Acesso negado.",
    ],
    "script": [
        "JavaScript is disabled or turned off in your browser. Please enable or turn on JavaScript to view, use or continue to this page, site or app. Reload once it is on.",
        "You need to enable JavaScript to run this app. This application requires JavaScript. For full functionality of this site it is necessary to enable JavaScript; some features will not work properly without it.",
        "JavaScript is not available or not supported. We have detected that scripts are blocked or switched off in this browser. Please allow, activate or switch on scripting or use a supported browser; your browser does not support it, so the content can't be shown or displayed.",
        "Enable JavaScript and cookies to continue. Checking if the site connection is secure. Checking your browser before accessing the site; this process is automatic and takes a few seconds. Ray id. Just a moment, please wait.",
        "Verify that you are a human and not a robot by completing the security check or captcha below. We detected unusual traffic or activity from your network.",
        "Your browser is out of date or not supported. Please upgrade your browser. noscript: this page, widget, player or chart requires script support.",
        "It looks like you are using an ad blocker. Please disable your blocker or add this site to the allow list and refresh or reload the page to continue reading. We use cookies; accept cookies.",
        "JavaScript ist deaktiviert. Bitte aktivieren Sie JavaScript und Cookies in Ihrem Browser, um diese Seite oder den Inhalt anzuzeigen, zu sehen oder zu nutzen. Für diese Anwendung wird JavaScript benötigt.",
        "JavaScript est désactivé. Veuillez activer JavaScript et les cookies dans votre navigateur pour afficher cette page, accéder au contenu ou continuer votre visite ou lecture. Ce site nécessite JavaScript.",
        "JavaScript está desactivado o deshabilitado. Active o habilite JavaScript y las cookies en su navegador para ver, mostrar o acceder a este contenido o página. Es necesario o se requiere JavaScript.",
        "JavaScript è disabilitato. Abilita JavaScript e i cookie nel browser per visualizzare questa pagina. O JavaScript está desativado. Ative o JavaScript no seu navegador para ver esta página.",
    ],
}
# fixed values: page furniture that may surround any text
FURNITURE = [
    "Home | News | Markets | Contact | Help | Imprint",
    "Menu Search Log in Sign in Register Subscribe",
    "Copyright (c) All rights reserved.",
    "About us | Contact | Privacy policy | Terms of use | Cookies | Sitemap",
    "Share Print Email Save Follow us Back to top",
]
# fixed values: passages that explain, quote or define placeholders
MENTIONS = [
    "The syntax uses braces to mark a variable; the template engine substitutes it and replaces it with its value when the page is rendered.",
    "In the manual, the token in brackets denotes a merge field, which stands for the name and is filled in by the renderer before sending.",
    "The guide writes it as an example of a format string or format slot, a shell variable or an environment variable; such notation or naming marks a parameter.",
    "The subject line and the body of the message are rendered from a template with fields for the date or the day, which the sender fills in before the alert is sent.",
    "where the expression is a set, an interval or an array that is indexed by a number; see the footnote",
]
# fixed values: labelled exemplars of unfilled placeholders, by notation, and of what only looks alike
PLACEHOLDERS = [
    "{{name}}", "{{ user.name }}", "{{first name}}", "{{{body}}}", "${name}", "${user.name}", "#{name}", "{$name}", "<%= name %>", "<% name %>", "<%=name%>", "[[name]]", "[[first name]]", "<<name>>", "<<First Name>>", "@@NAME@@", "@@name@@",
    "%(name)s", "%(count)d", "%(share)f", "%%NAME%%", "«Name»", "«FirstName»", "«first_name»", "[NAME]", "[COMPANY NAME]", "[FIRST_NAME]", "<NAME>", "<COMPANY NAME>", "<FIRST_NAME>", "&lt;name&gt;", "&lt;company name&gt;", "&LT;NAME&GT;",
    "__NAME__", "__name__", "{0}", "{12}", "[●]", "[•]", "[insert name]", "[INSERT NAME]", "[Insert the date here]", "[enter amount]", "[your name]", "[Company Name Here]", "[date tbd]", "____ .", "________ report", "XX", "XX.X", "XX.XX", "TODO: text",
]
NO_PLACEHOLDERS = ["[sic]", "[SIC]", "[3]", "[12]", "[n]", "[applause]", "{n}", "{1, 2}", "{a: b}", "[a, b]", "____________________", "<p>", "<br>", "<BR>", "<TABLE>", "<a href>", "&lt;p&gt;", "&lt;br&gt;", "&lt;table&gt;"]
# fixed values: HTML element names, which aren't placeholders
TAGS = set("html head title body center hr br p b i u em strong a div span noscript script style table tr td th tbody thead ul ol li pre code img h1 h2 h3 h4 h5 h6 meta link form input button section article nav footer header sub sup".split())
# every notation by its delimiters; which of them are placeholders is told by the exemplars
_SPAN = re.compile(
    r"\{\{\{?[^{}\n]{1,60}\}\}\}?|[$#]\{[^{}\n]{1,60}\}|\{[^{}\n]{1,60}\}|<%[^%\n]{1,60}%>|\[\[[^\[\]\n]{1,60}\]\]|\[[^\[\]\n]{1,80}\]|<<[^<>\n]{1,60}>>|<[^<>\n]{1,60}>|«[^«»\n]{1,60}»"
    r"|@@\w{1,60}@@|%%\w{1,60}%%|%\(\w{1,60}\)[a-z]|(?i:&lt;)[^&\n]{1,60}(?i:&gt;)|(?<!\w)__[A-Za-z]\w{0,60}?__(?!\w)|_{4,}|\bX{2,}(?:\.X+)?\b|\bTODO:"
)
_MAYBE = re.compile(r"[{\[<@«&_]|%\(|%%|XX|TODO:")  # what every span holds
_WORD = re.compile(r"[^\W_]+")
# names of sites, and signatures of servers (product/version), are furniture too
_SITE = re.compile(r"\b(?:[a-z0-9-]+\.)+(?:com|org|net|info|example|io|co)\b|\b[a-z][a-z_-]*/\d+(?:\.\d+)+(?:\s*\([a-z ]+\))?")
_DIGIT = re.compile(r"\d")
_RUN = re.compile(r"[^\W\d_][\w.-]*")


def token(word: str) -> str:
    """A word without its ending; all numbers and identifiers with digits are one word."""
    return "9" if _DIGIT.search(word) else word[:STEM]


def tokens(text: str) -> list[str]:
    """Words without letter case and endings."""
    return [token(w) for w in _WORD.findall(text.lower())]


class Slots(dict):
    """Word -> hashed slot of its token, for the words met so far."""

    def __missing__(self, word: str) -> int:
        got = self[word] = _slot(token(word))
        return got


def notation(span: str) -> tuple[str, str]:
    """How a span is written, its names and numbers reduced to their kind, and the names themselves."""
    if set(span) == {"_"}:
        return ("____" if len(span) < 12 else "line"), ""
    if span == "TODO:" or set(span) <= {"X", "."}:
        return ("XX" if span[0] == "X" and len(span.split(".")[0]) == 2 else span), ""
    kind = re.sub(r"\d+", "9", _RUN.sub(lambda m: "A" if m.group() == m.group().upper() and len(m.group()) > 1 else "a", span))
    kind = re.sub(r"\s+", " ", kind).replace("lt;", "").replace("gt;", "")
    kind = re.sub(r"(?:[aA][ _]?)*a(?:[ _]?[aA9])*", "a", re.sub(r"A(?:[ _]?A)+", "A", kind))
    return re.sub(r"(?<=\W) | (?=\W)", "", kind), " ".join(_RUN.findall(re.sub(r"(?i)&[lg]t;", " ", span.replace("_", " ")))).lower()


class Notations:
    """Notation -> labelled exemplars; a span is what the exemplars of its notation are, told apart by their words where they differ."""

    def __init__(self) -> None:
        self.held: dict[str, list[tuple[bool, set[str]]]] = {}
        for bad, spans in ((True, PLACEHOLDERS), (False, NO_PLACEHOLDERS)):
            for x in spans:
                m = _SPAN.search(x)
                kind, names = notation(m.group())
                self.held.setdefault(kind, []).append((bad, set(names.split())))

    def is_placeholder(self, span: str) -> bool:
        kind, names = notation(span)
        found = self.held.get(kind)
        if found is None:
            return False
        ws = set(names.split())
        if ws & TAGS and span[0] in "<&" and names.split()[0] in TAGS:
            return False
        labels = {bad for bad, _ in found}
        if len(labels) == 1:
            return labels.pop()
        if any(not bad and ws == held for bad, held in found):
            return False
        if kind in ("[A]", "<A>") or kind[0] == "&":  # capitals and escaped names are a field unless an exemplar says otherwise
            return True
        return any(bad and ws & held & _CALLS for bad, held in found)


# fixed values: words by which a phrase in brackets calls for a text
_CALLS = {"insert", "enter", "your", "here", "tbd"}


def _slot(word: str) -> int:
    return crc32(word.encode()) & (SLOTS - 1)


def document_frequencies(texts: DataFrame, text: str) -> tuple[np.ndarray, int]:
    """The number of texts that hold a word, in hashed slots, and the number of texts."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        slot_of, slots, n = Slots(), np.zeros(SLOTS + 1, np.int64), 0
        for b in batches:
            for t in b["t"]:
                slots[list({slot_of[w] for w in set(_WORD.findall(t.lower()))})] += 1
                n += 1
            if len(slot_of) > 500_000:
                slot_of.clear()
        slots[SLOTS] = n
        used = np.flatnonzero(slots)
        yield pd.DataFrame({"slot": used, "n": slots[used]})

    rows = texts.select(F.col(text).alias("t")).filter("t is not null").mapInPandas(count, "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n"))
    got = rows.toPandas()
    out = np.zeros(SLOTS + 1, np.int64)
    out[got["slot"].to_numpy(int)] = got["n"].to_numpy()
    return out[:SLOTS], int(out[SLOTS])


class Codes(dict):
    """Word -> code of its token, numbered as they are met."""

    def __init__(self, index: Index):
        self.index, self.of_token = index, {}

    def __missing__(self, word: str) -> int:
        t = token(word)
        code = self.of_token.get(t)
        if code is None:
            code = self.of_token[t] = len(self.of_token)
            self.index.learn(code, t)
        self[word] = code
        return code


class Index:
    """Word -> exemplars and their labels, with the weights of the words in the corpus."""

    def __init__(self, df: np.ndarray, n_texts: int, exemplars: dict[str, list[str]] | None = None):
        self.df, self.n = df, n_texts
        bank = exemplars if exemplars is not None else EXEMPLARS
        labelled = [(k, x) for k, xs in enumerate(bank.values()) for x in xs]
        self.width = len(labelled)
        # a word's columns: the exemplars, then the labels, that hold it; row 0 is held by none
        self.row: dict[str, int] = {}
        held = [np.zeros(len(labelled) + len(bank), bool)]
        for k, (label, x) in enumerate(labelled):
            for w in tokens(x):
                if w not in self.row:
                    self.row[w] = len(held)
                    held.append(np.zeros(len(labelled) + len(bank), bool))
                held[self.row[w]][[k, len(labelled) + label]] = True
        self.held = np.stack(held)
        self.mentions = set().union(*(tokens(x) for x in MENTIONS))
        self.notations = Notations()
        self.reset()

    def reset(self) -> None:
        self.codes = Codes(self)
        self.weights, self.rows = np.zeros(1 << 16), np.zeros(1 << 16, np.int32)
        self.furniture = [set(self.coded(x)) for x in FURNITURE]

    def learn(self, code: int, t: str) -> None:
        if code == len(self.weights):
            self.weights, self.rows = np.concatenate([self.weights, np.zeros(code)]), np.concatenate([self.rows, np.zeros(code, np.int32)])
        self.weights[code], self.rows[code] = self.weight(t), self.row.get(t, 0)

    def weight(self, t: str) -> float:
        share = (1.0 + self.df[_slot(t)]) / max(self.n, 1)
        return -math.log(min(1.0, max(share, RAREST)))

    def coded(self, text: str) -> list[int]:
        code = self.codes
        return [code[w] for w in _WORD.findall(text.lower())]

    def covered(self, ws: np.ndarray) -> np.ndarray:
        """Which words stand in a window contained in residue, or made of one repeated word."""
        n = len(ws)
        width = min(WINDOW, n)
        weights, held = self.weights[ws], self.held[self.rows[ws]]
        sums = np.vstack([np.zeros(held.shape[1]), np.cumsum(held * weights[:, None], axis=0)])
        total = np.concatenate([[0.0], np.cumsum(weights)])
        inside = (sums[width:] - sums[:-width]) / (total[width:] - total[:-width] + FLOOR * width / WINDOW)[:, None]
        hit = (inside[:, self.width :].max(axis=1) >= CONTAINMENT) & (inside[:, : self.width].max(axis=1) >= RETRIEVED)
        if n >= WINDOW:  # a window that one exemplar holds word by word, whatever its weight
            count = np.vstack([np.zeros(self.width), np.cumsum(held[:, : self.width], axis=0)])
            hit |= (count[width:] - count[:-width]).max(axis=1) == width
            hit |= _constant(ws, width)
        return np.convolve(hit.astype(int), np.ones(width, int))[:n] > 0

    def is_residue(self, text: str) -> tuple[bool, float]:
        if len(self.codes) > 500_000:
            self.reset()
        parts = [p for p in re.split(r"\n[ \t\r]*\n", _SITE.sub(" ", text.lower())) if p.strip()]
        words, first = [], 0
        for p in parts:
            lines = [self.coded(line) for line in p.split("\n")]
            first = first or len(words) == 0 and sum(map(len, lines))
            words.append([w for ws in lines if not self._furniture(ws) for w in ws])
        share = self._coverage([w for ws in words for w in ws])
        if len(parts) > 1 and words[0] and first <= 12 and not re.search(r"[.!?]\s*$", parts[0]):
            share = max(share, self._coverage([w for ws in words[1:] for w in ws]))  # the first block is a headline or residue itself
        return share >= COVERAGE, share

    def _coverage(self, words: list[int]) -> float:
        """The share of the words that residue covers; 0 where it is below ``COVERAGE`` without sliding a window."""
        if not words:
            return 0.0
        ws = np.array(words)
        if self._bound(ws) < COVERAGE:
            return 0.0
        return float(self.covered(ws).mean())

    def _bound(self, ws: np.ndarray) -> float:
        """At least the share that ``covered`` finds: windows judged by the words that any exemplar holds."""
        n = len(ws)
        width = min(WINDOW, n)
        weights, known = self.weights[ws], self.rows[ws] > 0
        gain = np.concatenate([[0.0], np.cumsum(weights * (known - CONTAINMENT))])
        hit = gain[width:] - gain[:-width] >= CONTAINMENT * FLOOR * width / WINDOW - 1e-6
        count = np.concatenate([[0], np.cumsum(known)])
        hit |= count[width:] - count[:-width] == width
        hit |= _constant(ws, width)
        return float((np.convolve(hit.astype(int), np.ones(width, int))[:n] > 0).mean()) if hit.any() else 0.0

    def _furniture(self, ws: list[int]) -> bool:
        return len(ws) <= 12 and any(held.issuperset(ws) for held in self.furniture)

    def unfilled(self, text: str) -> bool:
        """A placeholder that no explaining passage holds."""
        if not _MAYBE.search(text):
            return False
        for m in _SPAN.finditer(text):
            if not self.notations.is_placeholder(m.group()):
                continue
            if m.group()[0] == "_" and m.group()[-1] == "_" and set(m.group()) == {"_"}:
                line = text[text.rfind("\n", 0, m.start()) + 1 : m.start()] + text[m.end() : (text.find("\n", m.end()) + 1 or len(text) + 1) - 1]
                if not line.strip():
                    continue  # a rule across the page
            if text[max(0, m.start() - 1) : m.start()] == "`":
                continue
            start = max(text.rfind(". ", 0, m.start()), text.rfind("\n", 0, m.start())) + 1
            ends = [e for e in (text.find(". ", m.end()), text.find("\n", m.end())) if e >= 0]
            ws = tokens(text[start : m.start()] + " " + text[m.end() : min(ends) if ends else len(text)])
            total = sum(self.weight(w) for w in ws)
            if not total or sum(self.weight(w) for w in ws if w in self.mentions) < MENTION * total:
                return True
        return False


def _constant(ws: np.ndarray, width: int) -> np.ndarray:
    """Which windows are one word repeated."""
    changes = np.concatenate([[0], np.cumsum(np.diff(ws, prepend=ws[0]) != 0)])
    return changes[width:] == changes[1 : len(ws) - width + 2]


def residue(texts: DataFrame, *, key: str, text: str) -> DataFrame:
    """The texts to exclude: (key, reason, coverage); reason 'placeholder' or 'main_part', coverage that of the main part by residue.

    Nulls and empty texts give no row (they hold no residue); repeated rows come out each; very long texts are read whole.  Other columns
    are ignored.  An empty table gives no rows.
    """
    spark = texts.sparkSession
    index = share(spark, Index(*document_frequencies(texts, text)))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        judge_of: Index = received(index)
        for b in batches:
            rows = []
            for k, t in zip(b["key"], b["t"], strict=True):
                if not t or not t.strip():
                    continue
                if judge_of.unfilled(t):
                    rows.append((k, "placeholder", 0.0))
                    continue
                bad, share = judge_of.is_residue(t)
                if bad:
                    rows.append((k, "main_part", share))
            yield pd.DataFrame(rows, columns=["key", "reason", "coverage"])

    source = texts.select(F.col(key).alias("key"), F.col(text).alias("t")).filter("t is not null")
    out = source.mapInPandas(judge, f"key {texts.schema[key].dataType.simpleString()}, reason string, coverage double")
    return out.withColumnRenamed("key", key)
