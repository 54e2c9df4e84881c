"""Template residue and error-page text: unfilled placeholders found by delimiter-specific grammars, empty values left in
place of a field, filler, and messages (missing page, scripts needed, no access, expired session) instead of content.

Code and tutorials are discounted: a mark counts only if neither code characters, nor quoting, nor words about templates
stand around it in its sentence; a message counts only where hardly any other own text stands on the page.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .blocks import FEATURES, classified
from .lines import words_of
from .words import ALL

#: One grammar for each kind of delimiter (fixed values).
GRAMMARS = (
    r"\{\{\{?[#/^&>!~-]?\s*[^{}\n]{1,80}\}?\}\}",
    r"[$#@]\{[^{}\n]{1,80}\}",
    r"<%[=@#!-]?[^%\n]{1,80}%>",
    r"<\?(?:=|php)[^?\n]{1,80}\?>",
    r"\[\[\s*[^\[\]\n]{1,60}\]\]",
    r"\{%[^%\n]{1,80}%\}",
    r"%%\s*[A-Za-z_][\w.-]{0,40}\s*%%",
    r"%[A-Z][A-Z_]{2,40}%",
    r"@@[A-Za-z_][\w.-]{0,40}@@",
    r"(?<![\w])__[A-Za-z][A-Za-z0-9_.-]{0,40}?__(?![\w])",
    r"(?<![\w$#@{])\{\s*[A-Za-z_][\w.]{0,40}\s*\}(?!\})",
    r"\[(?i:insert|your|enter|placeholder|add)\b[^\[\]\n]{0,40}\]",
    r"\[object [A-Z]\w*\]",
)
MARK = re.compile("|".join(f"(?:{g})" for g in GRAMMARS))
QUICK = r"\{\{|[$#@]\{|<%|<\?|\[\[|\{%|%%|%[A-Z]|@@|__|\{[A-Za-z_ ]|\[[A-Za-z]"
#: Words about templates in the six languages: who writes about marks uses them (fixed values, word beginnings).
ABOUT = re.compile(
    r"(?i)\b(?:template|placeholder|syntax|variable|markup|editor|manual|marks?\b|write\b|type\b|import\b|such as|tag\b|snippet|code\b|"
    r"szablon|znacznik|zapis|składni|zmienn|edytor|napis|pisze się|w rodzaju|wpisz|vorlage|platzhalter|variabl|handbuch|schreib|zeichen|editor|steht\b|"
    r"modèle|gabarit|balise|marque|écrit|éditeur|saisis|tapez|plantilla|marcador|marca|escrib|sintaxis|editor|línea como|"
    r"sjabloon|sjablonen|plaatshouder|schrijf|tekens?\b|handleiding|typ\b|regel als)"
)
CODE = re.compile(r"```|`[^`]*`|</\w+>|^\s{4,}\S|;\s*$|=>|\bfunction\b|\bvar\b|\breturn\b")
NULLS = re.compile(r"(?<![\w])(?:undefined|null|NULL|NaN|None|nil|\[object \w+\])(?![\w])")
TITLE_NULL = re.compile(r"(?:^|[\s|:–—-])(?:undefined|null|NULL|NaN|\[object \w+\])\s*$|^(?:undefined|null|NaN|\[object \w+\])(?:[\s|:–—-]|$)")
PSEUDO = re.compile(r"(?i)\blorem\b|\bipsum\b|\bdolor(?:em)?\b|\basdf|\bqwerty\b")
#: Texts that stand where a text is still to be written, in the six languages (fixed values; for RE2).
STAND_IN = (
    r"(?i)\b(?:sample|dummy|placeholder|example) (?:text|content|heading|headline|title|paragraph|page)\b|\b(?:your|the) (?:text|content) (?:goes )?here\b|\btext goes here\b|\breplace this (?:text|paragraph|content)|\badd (?:your )?(?:text|content)\b|will appear (?:here|in this place)|\bcoming soon\b|\bunder construction\b|"
    r"przykładow\pL* (?:nagłówek|akapit|tekst|treść|tytuł)|(?:tu|tutaj) wpisz|wpisz swój tekst|zastąp ten|dodaj treść|pojawi się|strona w budowie|"
    r"beispiel ?(?:überschrift|absatz|text|inhalt|titel)|musterabsatz|mustertext|hier (?:kommt|steht) (?:ihr|der) text|ihr text|ersetzen sie diesen|inhalt im editor|(?:erscheint|folgt) (?:hier|an dieser stelle|in kürze)|in kürze|"
    r"(?:titre|paragraphe|texte|contenu) d.exemple|votre texte|remplacez ce|ajoutez (?:le|du|votre) (?:contenu|texte)|apparaîtra|bientôt|"
    r"(?:título|párrafo|texto|contenido) de (?:muestra|ejemplo)|su texto|sustituya este|reemplace este|añada (?:el )?contenido|aparecerá|próximamente|"
    r"voorbeeld ?(?:kop|alinea|tekst|titel)|uw tekst|vervang deze|voeg (?:hier )?(?:uw )?(?:inhoud|tekst)|verschijnt|binnenkort"
)
#: Messages in place of content, by kind, in the six languages (fixed values; for RE2).
MESSAGES = (
    # a page that is not there
    r"(?:page|address|resource|file|url|document|site)\b.{0,60}(?:not (?:be )?found|does(?: not|n't) exist|no longer|has (?:been )?moved|cannot be found)|\b(?:nothing|no page) .{0,24}(?:here|any ?more)\b|not found|"
    r"(?:stron|adres|zas[oó]b|plik).{0,60}(?:nie (?:znaleziono|istnieje|ma\b|została)|usunięt|przeniesion)|nie znaleziono|nic (?:już )?nie ma|już nic nie|"
    r"(?:seite|adresse|datei).{0,60}(?:nicht (?:gefunden|vorhanden)|existiert|gibt es .{0,40}nicht)|nicht gefunden|hier ist nichts|nichts mehr|"
    r"(?:page|adresse|fichier).{0,60}(?:introuvable|n.existe (?:pas|plus)|pas (?:été )?trouvée?)|introuvable|plus rien ici|il n.y a (?:plus )?rien|"
    r"(?:página|dirección|archivo).{0,60}(?:no (?:se )?(?:encontr|ha|existe|encuentra|pud)|no está)|ya no hay nada|no encontrad|no se (?:encontr|ha encontr|puede encontr)|"
    r"(?:pagina|adres|bestand).{0,60}(?:niet (?:gevonden|meer)|bestaat niet)|niet gevonden|staat niets|niets meer|"
    r"\b(?:error|fehler|erreur|błąd|fout)\s?:?\s?[345]\d\d\b",
    # scripts needed
    r"(?:javascript|java script|\bscripts?\b|skrypt|skript).{0,80}(?:enable|turn(?:ed)? on|need|requir|włącz|wymaga|potrzeb|aktivier|einschalten|benötig|brauch|activ|nécessite|besoin|exige|habilit|necesita|requiere|inschakel|schakel|nodig|vereist|aan\b)|"
    r"(?:enable|turn on|need|requir|włącz|wymaga|potrzebuje|aktivier|schalten|benötig|braucht|activ|nécessite|besoin|habilit|necesita|requiere|schakel|zet|nodig|vereist|disabled).{0,60}(?:javascript|java script|\bscripts?\b|skrypt|skript)",
    # access and checks
    r"access (?:denied|forbidden|to this)|forbidden|not (?:authori[sz]ed|permitted|allowed)|no permission|permission|odmowa|brak (?:dostępu|uprawnień)|dostęp (?:zabroniony|zablokowan)|zugriff|zugang|nicht berechtigt|accès (?:refusé|interdit)|acceso (?:denegado|prohibido)|toegang (?:geweigerd|verboden)|geen toegang|"
    r"checking your browser|verify(?:ing)? (?:the|your|that|you)|captcha|not a robot|unusual traffic|too many requests|rate limit|one moment|sprawdzamy|weryfik|chwil[aęi]|überprüf|einen moment|vérifi|un instant|un moment|comprob|verific|un momento|controler|even geduld|een ogenblik",
    # sessions
    r"session|sesj[aię]|sitzung|sesión|sessie|(?:log|sign)(?:ged)? (?:in|out|on)\b|zaloguj|wylogowan|anmelden|abgemeldet|connectez|déconnect|inicie|inloggen|uitgelogd|expired|wygasł|abgelaufen|expiré|caduc|verlopen",
    # failures
    r"(?:connect|connection|połączen|verbindung|connexion|conexión|conectar|verbinding|joindre).{0,50}(?:database|server|baz|serwer|datenbank|base de|serveur|servidor|databank|databas)|database|baz[ay] danych|datenbank|base de (?:données|datos)|databank|unavailable|niedostępn|nicht (?:verfügbar|erreichbar)|indisponible|no (?:está )?disponible|niet (?:beschikbaar|bereikbaar)|schiefgegangen|schiefgelaufen|misgegaan|mal passé|salió mal|try again|spróbuj|erneut versuchen|réessay|inténtelo|intente|probeer|overschreden|przekroczono|dépassé|überschritten|agotado|human\b|człowiek|mensch|humain|humano|mens\b|"
    r"internal server error|service (?:is )?(?:temporarily )?unavailable|bad gateway|gateway time-?out|exception\b|traceback|stack ?trace|fatal error|segmentation|null pointer|\bat [\w$.]+ ?\(|(?:on|in) line \d+|timed? out|database error|something went wrong|an error (?:has )?occurred|wystąpił błąd|coś poszło|ein fehler ist|une erreur|ha ocurrido un error|er is (?:een fout|iets)",
)
#: Other own words that a page may hold beside a message or filler and still be nothing but that.
OTHER_WORDS = 45
#: Up to so many words a line is a message as a whole; longer lines are taken sentence by sentence.
LINE_WORDS = 40
SENTENCE_WORDS = 16
_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"(?<=[.!?…])\s+")


def unfilled(line: str) -> bool:
    """Whether a line holds a mark that was left unfilled, rather than shown."""
    for sentence in _SENTENCE.split(line):
        marks = MARK.findall(sentence)
        if not marks:
            continue
        rest = MARK.sub(" ", sentence)
        if len(_WORD.findall(rest)) <= 2:
            if not CODE.search(rest):
                return True
            continue
        if ABOUT.search(rest) or CODE.search(rest):
            continue
        m = MARK.search(sentence)
        before, after = sentence[max(0, m.start() - 1) : m.start()], sentence[m.end() : m.end() + 1]
        if before and before in "`'\"“«„" and after and after in "`'\"”»“":
            continue
        return True
    return False


def empty_value(line: str) -> bool:
    """A line that is nothing but empty values, with a unit or a label of one word at most."""
    if not NULLS.search(line):
        return False
    return len(_WORD.findall(NULLS.sub(" ", line))) <= 1 and len(line) <= 120


def filler(line: str) -> bool:
    """Pseudo-text: its usual words, and hardly a function word of any language."""
    if not PSEUDO.search(line):
        return False
    words = _WORD.findall(line.lower())
    return len(words) < 8 or sum(w in ALL for w in words) < 0.15 * len(words)


_AT = {c: i for i, c in enumerate(FEATURES)}


def _said(lines: pa.Array, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lines in parts: index of the line, words of the part, and 3 for a stand-in, 4 for a message, else 0. A line of up to
    ``LINE_WORDS`` words is one part; of a longer one each sentence is, and only one of up to ``SENTENCE_WORDS`` words can be a message."""
    long = words > LINE_WORDS
    parts = pc.split_pattern(pc.if_else(pa.array(long), pc.replace_substring_regex(lines, r"([.!?…])\s+", "\\1\x01"), lines), "\x01")
    at, parts = pc.list_parent_indices(parts).to_numpy(zero_copy_only=False).astype(np.int64), parts.flatten()
    size = words_of(parts)
    able = np.flatnonzero(~long[at] | (size <= SENTENCE_WORDS))
    some = parts.take(pa.array(able))
    has = lambda pattern: pc.match_substring_regex(some, pattern).to_numpy(zero_copy_only=False)
    message = np.zeros(len(able), bool)
    for m in MESSAGES:  # one by one: their union would be slower
        message |= has(f"(?i){m}")
    kind = np.zeros(len(parts), np.int8)
    kind[able] = np.where(has(STAND_IN), 3, np.where(message, 4, 0))
    return at, size, kind


def judged(b, k, own, x, at) -> np.ndarray:
    """For each page of a classified batch: 0, or 1 mark, 2 empty value, 3 filler, 4 message.
    ``at`` has the non-blank lines to look at (all, or those of each page's head)."""
    L = k.lines
    titles = b.column("title").to_pylist()
    n = L.n_pages
    why = np.zeros(n, np.int8)
    lines, page, words = L.flat.take(pa.array(at)), L.page[at], k.words[at]
    own = own[at]
    seen = lambda texts, pattern: np.flatnonzero(pc.match_substring_regex(texts, pattern).to_numpy(zero_copy_only=False))
    # a line that the whole site repeats is the template's, whatever it says
    site_wide = (x[:, _AT["site_share"]] > 0.3) & (x[:, _AT["site_pages"]] >= 4)
    shared = x[:, _AT["site_pages"]] >= 2
    for i in seen(lines, QUICK):
        if not site_wide[i] and unfilled(lines[i].as_py()):
            why[page[i]] = 1
    for i in seen(lines, r"undefined|null|NULL|NaN|None|\bnil\b|\[object"):
        if why[page[i]] == 0 and empty_value(lines[i].as_py()):
            why[page[i]] = 2
    for i, t in enumerate(titles):
        if t and why[i] == 0:
            if MARK.search(t) and unfilled(t):
                why[i] = 1
            elif TITLE_NULL.search(t.strip()):
                why[i] = 2
    # filler: most of the own words
    fill = np.zeros(len(at), bool)
    for i in seen(pc.utf8_lower(lines), "lorem|ipsum|dolor|asdf|qwerty"):
        fill[i] = filler(lines[i].as_py())
    filled = np.bincount(page, weights=np.where(fill, words, 0), minlength=n)
    rest = np.bincount(page, weights=np.where(own & ~fill, words, 0), minlength=n)
    why[(why == 0) & (filled >= 3) & (filled >= rest)] = 3
    # messages and stand-ins: lines that say so, and hardly any other own text
    counts = own | ((words > 30) & ~shared)
    spot = np.flatnonzero((counts | ((words <= LINE_WORDS) & ~site_wide)) & (why[page] == 0))
    line, size, kind = _said(lines.take(pa.array(spot)), words[spot])
    line = spot[line]
    kind[site_wide[line]] = 0
    other = np.bincount(page[line], weights=np.where(counts[line] & (kind == 0), size, 0), minlength=n)
    said = np.zeros(n, np.int8)
    first = np.flatnonzero(kind)[::-1]
    said[page[line[first]]] = kind[first]
    hit = (said > 0) & (other <= OTHER_WORDS)
    why[hit] = said[hit]
    return why


def excluded(b, k, own, x, at) -> np.ndarray:
    """For each page of a classified batch, whether it is template residue or a keyword or link list: such pages have no
    content of their own to tell from the rest."""
    from .stuffing import FLAG_SHARE, FLAG_WORDS, non_prose

    total, part = non_prose(k, own, x, at)
    return (judged(b, k, own, x, at) > 0) | ((total >= FLAG_WORDS) & (part > FLAG_SHARE))


def residue_pages(pages: DataFrame, links: DataFrame, text: str = "body_sample") -> DataFrame:
    """``page_id, why`` of the pages to leave out: 'mark', 'empty value', 'filler' or 'message'.

    Pages whose ``text`` is null or empty are not judged; a null title is no case; repeated pages are judged each.
    """

    def emit(b, k, own, x, at):
        why = judged(b, k, own, x, at)
        hit = np.flatnonzero(why)
        kinds = pa.array(["", "mark", "empty value", "filler", "message"])
        yield pa.RecordBatch.from_arrays([pa.array(b.column("row_id").to_numpy(zero_copy_only=False)[hit]), kinds.take(pa.array(why[hit]))], names=["page_id", "why"])

    return classified(pages, links, text, emit, "page_id long, why string")
