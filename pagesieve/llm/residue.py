"""Template residue and error-page text.

Two kinds of records hold no content of their own and are found here:

* records in which a *slot* of a template kept its variable name, a program's empty
  value or a blank (``Dear {{name}},`` / ``Balance: undefined``), in title or text;
* records whose whole page is a template: filler, an error, refusal or provider
  message, a bare server listing or a notice that scripts are needed.

**Slots.** Sentences are aligned by the words next to a candidate (two to the left, two to the
right, names and numbers masked). Two things make such a context an induced slot: written-out placeholders
in a known syntax, not quoted as examples, in at least ``MIN_SUPPORT`` records; or varying
fillers, at least ``MIN_FILLERS`` different ones in ``MIN_RECORDS`` records, which a second scan finds in all records.
A bare program value (``null``, ``undefined``, ``NaN`` ...), a name in an unlisted syntax, a default (``Customer Name``), a line left
to fill in, or a blank that shows (before a comma or full stop, or doubled) counts where it stands in an induced slot;
a placeholder in a known syntax counts wherever it is not an example. A blank that left no trace is not seen.

**Whole pages.** Records with next to no sentences of their own are aligned by runs of ``RUN`` words (names and numbers
masked). A run that repeats in ``MIN_PAGES`` different texts of such records, and hardly ever in records with content, is part of
a whole-page template (an error, a notice, filler), in whatever language; menus, consent and legal lines repeat on pages
with content as well and so are none. Messages too rare to repeat are told by fixed lists (English, German, French, Spanish).

Neither contexts nor runs are collected: what the second scan looks for is sent out as bitmaps of fixed size, what it finds is joined exactly.

Defined results: null title and text count as ''; empty texts are never flagged; records repeated under an id count by
their latest ``captured_at``; texts of any length are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesieve.runtime import materialize, spread

#: Records in which a context must hold placeholders to count as a slot; or different fillers and records that hold them.
MIN_SUPPORT, MIN_FILLERS, MIN_RECORDS = 2, 3, 4
#: Words of a run, different texts of records without content in which it must repeat, and most of its records that may have content.
RUN, MIN_PAGES, WITH_CONTENT = 5, 5, 0.1
#: Most words of a filler, and bits of a bitmap.
FILLER_WORDS, BITMAP = 3, 1 << 20
#: A page with more words in sentences of its own than this has content beside a message.
OWN_WORDS = 60
#: Bytes of text looked at together.
SLICE_BYTES = 32 << 20

# The ways template languages write a variable.
SYNTAXES = (
    r"\{\{[^{}\n]{1,80}\}\}",
    r"\{%[^{}%\n]{1,80}%\}",
    r"\$\{[^{}\n]{1,80}\}",
    r"\$\[[^\[\]\n]{1,80}\]",
    r"\$\([A-Za-z_][\w.]{0,60}\)",
    r"#\{[^{}\n]{1,80}\}",
    r"#\[[A-Za-z_][\w.]{0,60}\]",
    r"<%[^<>%\n]{1,80}%>",
    r"<\?=[^<>\n]{1,80}\?>",
    r"<<[A-Za-z_][\w. ]{0,60}>>",
    r"\[\[[^\[\]\n]{1,80}\]\]",
    r"@@[A-Za-z_][\w.]{0,60}@@",
    r"##[A-Za-z_][\w.]{0,60}##",
    r"%%[A-Za-z_][\w.]{0,60}%%",
    r"%[A-Za-z_][A-Za-z_.]{2,60}%",
    r"%\([A-Za-z_]\w{0,60}\)[sd]",
    r"__[A-Za-z][A-Za-z_]{1,60}__",
    r"\*\|[^|*\n]{1,80}\|\*",
    r"~[A-Za-z_][\w.]{0,60}~",
    r"\|\|[A-Za-z_][\w.]{0,60}\|\|",
    r"\^[A-Za-z_][\w.]{0,60}\^",
    r"\{[A-Za-z_][\w.]{0,60}\}",
    r"\{[A-Z][a-z]+(?: [A-Z][a-z]+){1,3}\}",
    r"\[(?:[A-Z][a-z]+(?: [A-Z][a-z]+){0,3}|[a-z]+(?:[_.][a-z]+)+|[A-Z]+(?:_[A-Z]+)+)\]",
    r"\[object \w+\]",
)
# What programs print for a missing value.
BARE = r"(?:undefined|null|NULL|NaN|None|nil|N/A)(?: (?:undefined|null|NULL|NaN|None|nil))?"
PLACEHOLDER = "|".join(SYNTAXES)
CANDIDATE = re.compile(rf"({PLACEHOLDER})|(?<![\w./-])({BARE})(?![\w/-])")
# What may stand in a slot and counts only there: a name within signs of an unlisted syntax or with underlines, and the blank that a value left behind.
_SIGNS = r"{}\[\]<>|~^#@=*_§¤¬¦°$%&+\\¿¡"
ODD = rf"(?<!\w)[{_SIGNS}][{_SIGNS}:!?]{{0,2}}[A-Za-z_][\w.-]*(?: [\w.-]+){{0,3}}[{_SIGNS}:!?]{{0,2}}[{_SIGNS}](?!\w)|(?<![\w./@-])(?:\$?[A-Za-z]+(?:_[A-Za-z]+)+|\$[A-Za-z]\w*)(?![\w/@-])"
DEFAULT = r"(?<![\w-])(?:(?:Your|First|Last|Full|Customer|Client|User|Recipient|Company|Product|Order|Account|City|Street) )(?:Name|Number|City|Address|Date|Email|Amount|Link|Title|Text)(?![\w-])|(?<!\w)_{3,}(?!\w)|(?<!\w)\.{5,}(?!\w)"
BLANK = r"(?<=[^\W\d_])[ \xa0]+(?=[,.](?:\s|$))|(?<=:)[ \xa0]+(?=[,.](?:\s|$))|(?<=[^\W\d_])[ \xa0]{2,}(?=[^\W\d_])"
LOOSE = re.compile(rf"({ODD})|({DEFAULT})|{BLANK}")
# Words with which a text speaks about templates instead of being one.
ABOUT = re.compile(
    r"\b(?:markers?|placeholders?|templates?|variables?|syntax|code sample|sample code|example|mail ?merge|mailer|export|"
    r"marcador(?:es)?|plantillas?|ejemplo|muestra de código|exportación|"
    r"marqueurs?|modèles?|gabarits?|exemple|publipostage|"
    r"Platzhalter\w*|Vorlagen?|Beispiel\w*|Serienbrief\w*|Codebeispiel\w*|Markierung)\b",
    re.I,
)
QUOTES = "'\"`‘’‚‛“”„«»‹›"
ARTICLES = frozenset("a an the any no this that is are ein eine einen einer der die das kein keine un une le la les l' el los las un una ningún cet cette este esta".split())

# Messages and notices, by kind.
_SCRIPT = r"(?:java ?scripts?|(?:client-side |site |browser )?scripts?(?: support)?|(?:client-side )?scripting|Skripte?n?|Skripting)"
NOTICES = re.compile(
    "|".join(
        (
            rf"\b(?:enable|activate|allow|turn on|switch on|unblock|permit)\b[^.!?]{{0,30}}\b{_SCRIPT}\b",
            rf"\b{_SCRIPT}\b[^.!?]{{0,60}}\b(?:disabled|turned off|switched off|switched on|enabled|blocked|missing|deactivated|inactive|required|needed|must be allowed|not available|not supported)\b",
            rf"\b(?:requires?|needs?|without|relies on|works? only with)\b[^.!?]{{0,20}}\b{_SCRIPT}\b",
            rf"\b(?:aktivier\w*|erlaub\w*|schalt\w*|zulassen)\b[^.!?]{{0,40}}\b{_SCRIPT}\b",
            rf"\b(?:braucht|benötigt|ohne|erfordert|setzt)\b[^.!?]{{0,30}}\b{_SCRIPT}\b",
            rf"\b{_SCRIPT}\b[^.!?]{{0,40}}\b(?:deaktiviert|ausgeschaltet|gesperrt|blockiert|aktivieren|erlauben|zulassen|einschalten|erforderlich|nötig)\b",
            rf"\b(?:activ\w*|autoris\w*|permet\w*|débloqu\w*)\b[^.!?]{{0,40}}\b{_SCRIPT}\b",
            rf"\b(?:sans|nécessite|exige|requiert|a besoin de)\b[^.!?]{{0,20}}\b{_SCRIPT}\b",
            rf"\b{_SCRIPT}\b[^.!?]{{0,40}}\b(?:désactivé\w*|bloqué\w*|activé\w*|requis|nécessaires?)\b",
            rf"\b(?:activ\w*|permit\w*|habilit\w*|autoriz\w*|desbloque\w*)\b[^.!?]{{0,40}}\b{_SCRIPT}\b",
            rf"\b(?:sin|necesita|requiere|exige)\b[^.!?]{{0,20}}\b{_SCRIPT}\b",
            rf"\b{_SCRIPT}\b[^.!?]{{0,40}}\b(?:desactivado\w*|bloquead\w*|deshabilitad\w*|activados?)\b",
            r"\bcheck(?:ing|s)? your browser\b|\bscripts and cookies must be allowed\b",
            r"\b(?:wir )?prüfen (?:Ihren|den) Browser\b|\bvérifi\w+ (?:de )?votre navigateur\b|\bcomprob\w+ (?:de )?(?:su|tu) navegador\b",
        )
    ),
    re.I,
)
MESSAGES = re.compile(
    "|".join(
        (
            r"\b(?:4\d\d|5\d\d) (?:Not Found|Forbidden|Internal Server Error|Bad Gateway|Service Unavailable|Gateway Time-?out|Bad Request|Unauthorized|Gone|Too Many Requests)\b",
            r"\b(?:error|fehler|erreur)[ :]*(?:code )?[45]\d\d\b|\bhttp (?:error )?[45]\d\d\b",
            r"\b(?:page|file|url|path|resource|document|address|site)\b[^.!?]{0,60}\b(?:not (?:be )?found|does not exist|no longer exists|has moved|was deleted|cannot be reached|can't be reached|could not be)\b",
            r"\bcould not (?:find|load|open) (?:the|this|that) (?:requested )?(?:page|site|file|address)\b|\bnothing (?:was )?(?:here|found)\b",
            r"\b(?:you|your address|your ip|access|request)\b[^.!?]{0,40}\b(?:permission|not allowed|not authori[sz]ed|denied|(?:was|were|has been|have been) blocked|forbidden|refused|rejected)\b",
            r"\bpermission to (?:view|access|open|see)\b|\bblocked by the (?:protection|security)\b",
            r"\b(?:server|proxy|machine|gateway|host|service|database)\b[^.!?]{0,50}\b(?:overloaded|did not answer|no valid answer|unavailable|timed out|not responding|invalid (?:answer|response)|went wrong|unreachable|unable|not available|too busy)\b",
            r"\binternal (?:server )?error\b|\bfatal error\b|\bstack trace\b|\buncaught exception\b|\bdatabase error\b|\berror establishing\b|\bcall to a member\b",
            r"\brate limit\b|\btoo many requests\b|\bslow down\b",
            r"\b(?:hosting )?(?:account|site|domain|website)\b[^.!?]{0,40}\b(?:suspended|expired|parked|for sale|not (?:been )?renewed|disabled|reserved)\b|\bnot renewed (?:it|this)\b|\bcontact (?:the|your) (?:provider|host)\b",
            r"\b(?:working on|maintaining|updating) this site\b|\b(?:under|down for) (?:maintenance|construction)\b|\bcome back (?:in|later|soon)\b|\bcoming soon\b",
            r"\bcertificate\b[^.!?]{0,60}\b(?:not trusted|expired|invalid|revoked)\b|\b(?:reset|refused|closed) the connection\b|\bstopped loading\b|\btook too long to respond\b",
            r"\bIndex of /|\bParent Directory\b|\bName Last modified Size\b",
            r"\b(?:Seite|Datei|Adresse)\b[^.!?]{0,50}\b(?:nicht gefunden|gibt es (?:leider )?nicht|existiert nicht|nicht (?:mehr )?vorhanden|konnte nicht|nicht erreichbar|nicht verfügbar)\b",
            r"\b(?:keine Berechtigung|Zugriff verweigert|nicht berechtigt|Anfrage wurde (?:blockiert|abgelehnt|gesperrt))\b|\bVorgang \w+\b",
            r"\b(?:Dienst|Server|Datenbank)\b[^.!?]{0,40}\b(?:überlastet|nicht verfügbar|antwortet nicht|nicht erreichbar|Fehler|keine (?:gültige )?Antwort)\b|\binterner (?:Server)?fehler\b|\bInternen? Fehler\b",
            r"\b(?:Konto|Domain|Website|Adresse)\b[^.!?]{0,40}\b(?:gesperrt|abgelaufen|nicht verlängert|geparkt)\b|\bWartungsarbeiten\b|\bWir arbeiten an dieser (?:Seite|Website)\b|\bzu viele Anfragen\b",
            r"\b(?:page|fichier|adresse|document)\b[^.!?]{0,50}\b(?:introuvable|n'existe (?:pas|plus)|n'a pas (?:été|pu)|inaccessible|indisponible)\b",
            r"\bpas le droit de (?:voir|consulter)\b|\bAccès (?:refusé|interdit)\b|\bDossier \w+\b|\bpas autorisé\b|\btrop de requêtes\b",
            r"\b(?:serveur|service)\b[^.!?]{0,40}\b(?:surchargé|indisponible|ne répond pas|n'a pas répondu|en panne)\b|\berreur interne\b|\ben maintenance\b|\bcompte\b[^.!?]{0,30}\bsuspendu\b|\bdomaine\b[^.!?]{0,30}\bexpiré\b",
            r"\b(?:página|dirección|archivo|sitio)\b[^.!?]{0,50}\b(?:no (?:fue )?(?:encontrad[ao]|existe|disponible|está disponible)|no se (?:pudo|encontró|encuentra|ha encontrado))\b|\bno se pudo (?:cargar|encontrar|abrir)\b",
            r"\bno tiene permiso\b|\bAcceso denegado\b|\bCaso \w+\b|\bdemasiadas (?:peticiones|solicitudes)\b|\bno está autorizado\b",
            r"\b(?:servidor|servicio)\b[^.!?]{0,40}\b(?:sobrecargado|no disponible|detenido|no responde|no respondió|saturado)\b|\berror interno\b|\ben mantenimiento\b|\bcuenta\b[^.!?]{0,30}\bsuspendida\b|\bdominio\b[^.!?]{0,30}\b(?:caducado|expirado)\b",
        )
    ),
    re.I,
)
FILLER = re.compile(
    "|".join(
        (
            r"\b(?:your|the) (?:text|headline|tagline|title|content|copy|slogan|caption|name|subtitle|logo)\b[^.!?]{0,12}\b(?:goes|go|comes) here\b|\bclick (?:here )?to edit\b|\bedit (?:this|me|it in)\b",
            r"\b(?:sample|dummy|placeholder|filler|example|demo) (?:text|copy|content|paragraph|headline)\b",
            r"\b(?:headline|title|subline|line|text|button|image|caption|subtitle|paragraph)(?: \w+)? placeholder\b|\bButton label\b",
            r"\badd (?:a|your|some) (?:short |brief )?(?:description|summary|introduction|text|content|bio)\b|\btell (?:visitors|people|readers|customers) (?:who|what|why|how)\b|\bdescribe the item\b|\bitem title (?:one|two|three)\b|\bDescribe your\b",
            r"\bhier steht Ihr\b|\bIhr (?:Text|Titel)\b[^.!?]{0,12}\bhier\b|\bBlindtext\b|\bMustertext\b|\bPlatzhaltertext\b|\bBeispieltext\b|\bbitte ersetzen Sie\b|\bBeschreiben Sie (?:hier|Ihr)\b",
            r"\b(?:escriba|escribe|añada|añade|ponga|pon|inserte) (?:aquí )?(?:su|tu|un|una) (?:título|texto|descripción|lema)\b|\btexto de (?:ejemplo|muestra|relleno|prueba)\b|\bsolo de muestra\b|\b(?:su|tu) (?:texto|título) aquí\b",
            r"\bvotre (?:texte|titre|slogan)\b[^.!?]{0,12}\bici\b|\b(?:saisissez|écrivez|ajoutez|insérez) (?:ici )?(?:votre|un|une) (?:titre|texte|description|slogan)\b|\bfaux[- ]texte\b|\btexte (?:d'exemple|de remplissage|factice|provisoire)\b",
        )
    ),
    re.I,
)
# Beginnings of the words of the usual pseudo-Latin filler.
LATIN = re.compile(
    r"^(?:lorem|ipsum|dolor|amet|consect|adipis|elit|elem|eiusmod|tempor|incidid|labor[ei]|magn[ai]|aliqu|enim|minim|veniam|quis|nostr|exercit|ullamc|nisi|commod|conseq|duis|aute|irure|reprehen|"
    r"volup|velit|esse|cillum|fugi|pariat|except|sint|occaec|cupid|proiden|culpa|offic|deserun|mollit|anim|labor|praes|dapib|lacin|tincid|maur|part[ui]r|sedu?n?|rutr|phar|congu?|vesti|ornav?|biben|"
    r"pellent|vestib|curab|phasel|suspend|vivam|nulla|integ|donec|fusce|etiam|aenean|cras|proin|sit$|et$|ut$|in$|non$|ad$|ac$|nec$|sed$)",
    re.I,
)
LATIN_CORE = re.compile(r"\b(?:lorem|ipsum|dolor|amet|dapib\w*|tincid\w*|praes\w*|cupid[ai]t\w*|velit\w*)\b", re.I)
# Consent, legal and share lines that stand around any page.
AROUND = re.compile(
    r"\bcookies?\b|\bstores? small files\b|\bsmall files on your device\b|\bkeep usage data\b|\bkleine Dateien\b|\bpetits fichiers\b|\bpequeños archivos\b|\bNutzungsdaten\b|"
    r"\bprices include tax\b|\bsubject to availability\b|\bnothing on this site is advice\b|\bname?s? shown belong\b|\bmay change without notice\b|"
    r"\bsolange der Vorrat reicht\b|\bkeine Haftung\b|\bPreise (?:enthalten|können)\b|\bdans la limite des stocks\b|\bne répondons pas\b|\bhasta agotar existencias\b|\bno respondemos de\b|\bimpuestos\b|\bTTC\b|©",
    re.I,
)
#: Said about messages, scripts or filler in a text that has content of its own.
SPOKEN = re.compile(
    r"\b(?:the term|we counted|how often|a good|such as|message says|misleads|chapter|article|comments are shown|in the log|said|wrote|means that|"
    r"der Artikel|Kommentare|wie oft|zählte|Begriff|a compté|combien de fois|l'article|les commentaires|contó|cuántas veces|el artículo|los comentarios)\b",
    re.I,
)
ERROR_TITLE = re.compile(
    r"^\W*(?:(?:error|fehler|erreur)(?: \d+)?|(?:4|5)\d\d\b.*|not found|page not found|forbidden|access denied|nothing here|unavailable|service unavailable|bad gateway|too many requests|maintenance|account suspended|database error|privacy error|"
    r"problem loading page|just a (?:second|moment)|one moment|loading|app|index of /.*|gesperrt|zugriff verweigert|seite nicht gefunden|dienst nicht verfügbar|accès refusé|interdit|page introuvable|service (?:indisponible|arrêté)|"
    r"acceso denegado|página no (?:encontrada|disponible)|servicio (?:detenido|no disponible))\W*$",
    re.I,
)
SENTENCE = re.compile(r"(?<=[.!?…])\s+|\n+")
NAME = re.compile(r"\b[A-ZÄÖÜÉÀÁÍÓÚÑ][\w'’-]*|\d[\d.,]*")



def _gate(pattern: str) -> str:
    """A looser form of a pattern that RE2 runs in one pass over a column: whatever the pattern finds within a sentence, this finds."""
    return re.sub(r"\[\^\.!\?\]\{0,\d+\}", ".*", pattern.replace(r"\b", ""))


# Words of which every branch of MESSAGES holds one: a first gate that RE2 runs as a small automaton.
_MESSAGE_WORDS = (
    r"not found|forbidden|server error|gateway|unavailable|bad request|unauthorized|gone|too many|(?:error|fehler|erreur|error code|http)[ :]*(?:code )?[45]\d\d|be found|not exist|no longer|has moved|was deleted|be reached|could not|nothing |"
    r"permission|not allowed|not authori|denied|blocked|refused|rejected|overloaded|not answer|valid answer|timed out|not responding|invalid|went wrong|unreachable|unable|not available|too busy|"
    r"internal error|fatal error|stack trace|uncaught|database error|error establishing|call to a member|rate limit|slow down|suspended|expired|parked|for sale|renewed|disabled|reserved|contact the|contact your|"
    r"working on|maintaining|updating|maintenance|construction|come back|coming soon|not trusted|revoked|connection|stopped loading|to respond|index of /|parent directory|last modified|"
    r"nicht |berechtig|verweigert|wurde |vorgang|überlastet|fehler|antwort|gesperrt|abgelaufen|geparkt|wartungsarbeiten|wir arbeiten|anfragen|introuvable|n'existe|n'a pas|inaccessible|indisponible|pas le droit|accès|dossier|autorisé|requêtes|"
    r"surchargé|ne répond|en panne|erreur interne|suspendu|expiré|no encontrad|no fue|no existe|disponible|no se |permiso|denegado|caso |demasiadas|no está|sobrecargado|detenido|no respond|saturado|error interno|mantenimiento|caducado|expirado"
)
_GATES = (_MESSAGE_WORDS, _gate(NOTICES.pattern), _gate(FILLER.pattern), _gate(LATIN_CORE.pattern))
_PLACE_GATE = f"{PLACEHOLDER}|{BARE}"
_LOOSE_GATE = rf"[{_SIGNS}][:!?]{{0,2}}[A-Za-z_]|[A-Za-z]_[A-Za-z]|[\pL:][ \x{{a0}}]+[,.](?:\s|$)|\pL[ \x{{a0}}][ \x{{a0}}]+\pL|[a-z] (?:Name|Number|City|Address|Date|Email|Amount|Link|Title|Text)|_{{3,}}|\.{{5,}}"


def _mask(words: list[str]) -> str:
    return " ".join(NAME.sub("*", w) if w[:1].isupper() or w[:1].isdigit() else w for w in words).casefold()


def _sentence_around(text: str, start: int, end: int) -> tuple[str, str]:
    """What stands before and behind a place in its sentence, however long that is."""
    width = 256
    while True:
        before = SENTENCE.split(text[max(0, start - width) : start])
        if len(before) > 1 or width >= start:
            break
        width *= 4
    behind = SENTENCE.search(text, end)
    return before[-1], text[end : behind.start() if behind else len(text)]


def _context(text: str, start: int, end: int, title: bool) -> tuple[str, bool, str, str]:
    left, right = _sentence_around(text, start, end)
    quoted = left[-1:] in QUOTES and left[-1:] != "" and right[:1] in QUOTES and right[:1] != ""
    strip = "".join(QUOTES) + " "
    lw, rw = left.rstrip(strip).split()[-2:], right.lstrip(strip).split()[:2]
    if title and not lw:
        lw = ["^"]
    # what follows a slot at the end of a line is another block's text
    if right[:1] == " " and not (rw and rw[0][:1].islower()):
        rw = [] if lw else rw[:1]
    glue = right[:1] if right[:1] in ",;:.!?" else ""
    return f"{_mask(lw)}|{glue}{_mask([w for w in rw if w not in ',;:.!?'])}", quoted, left, right


def residue_hits(title: str, text: str) -> list[tuple[str, str, bool, bool]]:
    """Candidates of one record: (kind, context, example?, certain?). Kinds: var, bare, odd, blank."""
    hits: list[tuple[str, str, bool, bool]] = []
    for is_title, s in ((True, title), (False, text)):
        taken = [*CANDIDATE.finditer(s)]
        loose = [m for m in LOOSE.finditer(s) if not any(m.start() < t.end() and t.start() < m.end() for t in taken)]
        for m in loose:
            context, quoted, left, right = _context(s, m.start(), m.end(), is_title)
            about = quoted or bool(ABOUT.search(CANDIDATE.sub(" ", left + " | " + right)))
            hits.append(("odd" if m.group(1) else "default" if m.group(2) else "blank", context, about, False))
        for m in taken:
            context, quoted, left, right = _context(s, m.start(), m.end(), is_title)
            about = quoted or bool(ABOUT.search(CANDIDATE.sub(" ", left + " | " + right)))
            if m.group(1):
                hits.append(("var", context, about, not about))
            else:
                before = left.split()[-1:] or [""]
                about |= before[0].casefold() in ARTICLES
                alone = is_title and (not left.strip() or not right.strip() or right.lstrip()[:1] in "|-–·:")
                hits.append(("bare", context, about, not about and (alone or " " in m.group(0) or right[:1] in ",;")))
    return hits


def _filler_latin(sentence: str) -> bool:
    words = re.findall(r"[^\W\d_]+", sentence)
    if len(words) < 4 or not LATIN_CORE.search(sentence):
        return False
    # menus may stand before it in the same line: the end of the sentence decides, from where it is filler
    latin = np.array([bool(LATIN.match(w)) for w in words])[::-1]
    share = np.cumsum(latin) / np.arange(1, len(words) + 1)
    return bool((share[3:] >= 0.6).any()) if len(words) < 15 else bool((share[13:] >= 0.6).any())


def _is_message(sentence: str) -> bool:
    if SPOKEN.search(sentence):
        return False
    return bool(NOTICES.search(sentence) or MESSAGES.search(sentence) or FILLER.search(sentence)) or _filler_latin(sentence)


def _slices(b: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of bounded bytes; a single long text is a part of its own."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < b.num_rows:
        base = sizes[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(sizes, base + SLICE_BYTES, "right")))
        yield b.slice(start, end - start)
        start = end


def _sentences(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All sentences of a column in one array, and the row of each."""
    lists = pc.split_pattern(pc.replace_substring_regex(texts, pattern=r"([.!?…])\s+", replacement="\\1\n"), pattern="\n")
    return lists.flatten(), pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)


def _match(values: pa.Array, pattern: str, ignore_case: bool = True) -> np.ndarray:
    return pc.match_substring_regex(values, pattern=pattern, ignore_case=ignore_case).to_numpy(zero_copy_only=False)


def _own(flat: pa.Array, row: np.ndarray, n: int, besides: np.ndarray | None = None) -> np.ndarray:
    """Words that each row has in sentences of its own, menus, consent and legal lines (and ``besides``) aside."""
    words = pc.add(pc.count_substring(flat, pattern=" "), 1).to_numpy(zero_copy_only=False)
    counted = _match(flat, r"[.!?…]\s*$") & ~_match(flat, _gate(AROUND.pattern)) & (words >= 7)
    # menus stand before the first sentence of a page: a line counts as a sentence of usual length
    weight = np.where(counted, np.minimum(words, 20), 0)
    return np.bincount(row, weight if besides is None else weight * ~besides, n)


def whole_pages(titles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """True for rows whose page is a listed message, notice or filler and nothing else; and for rows without content beside what may be one."""
    n = len(texts)
    flat, row = _sentences(texts)
    gated = np.any([_match(flat, g) for g in _GATES], axis=0)
    # a row with too many words of its own even without its gated sentences cannot be a bare template
    open_rows = _own(flat, row, n, gated) <= OWN_WORDS
    message = np.zeros(len(flat), bool)
    for i in np.flatnonzero(gated & open_rows[row]):
        message[i] = _is_message(flat[i].as_py())
    messages = np.bincount(row, message, n)
    error_title = _match(titles, ERROR_TITLE.pattern)
    filled = _match(texts, r"\S")
    bare = filled & (_own(flat, row, n, message) <= OWN_WORDS)
    return bare & ((messages > 0) | error_title), bare


_B = np.uint64(0x9E3779B97F4A7C15)


def _masked(word: str) -> str:
    word = word.strip("".join(QUOTES) + ".,;:!?…()[]")
    return "" if not word else "*" if word[0].isupper() or any(c.isdigit() or c in "/@." for c in word) else word.casefold()


class _Aligned:
    """Words of a column of texts as hashes of their masked forms."""

    def __init__(self, texts: pa.Array):
        lists = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(texts))
        coded = lists.flatten().dictionary_encode()
        forms = [_masked(w) for w in coded.dictionary.to_pylist()]
        index = coded.indices.to_numpy(zero_copy_only=False)
        keep = np.array([f != "" for f in forms], bool)[index] if len(index) else np.zeros(0, bool)
        self.row = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)[keep]
        self.hash = np.array([xxhash.xxh64_intdigest(f) for f in forms], np.uint64)[index[keep]] if len(index) else np.zeros(0, np.uint64)
        self.mask = np.array([f == "*" for f in forms], bool)[index[keep]] if len(index) else keep

    def runs(self) -> tuple[np.ndarray, np.ndarray]:
        """Row and hash of all runs of ``RUN`` words of which one at most is masked."""
        n = len(self.hash) - RUN + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        masks = np.cumsum(np.r_[0, self.mask])
        at = np.flatnonzero((self.row[:n] == self.row[RUN - 1 :]) & (masks[RUN:] - masks[:n] <= 1))
        h = np.zeros(len(at), np.uint64)
        for k in range(RUN):
            h = (h ^ self.hash[at + k]) * _B
            h ^= h >> np.uint64(29)
        return self.row[at], h.view(np.int64)

    def gaps(self) -> tuple[np.ndarray, np.ndarray]:
        """Row and hash of three of the words on both sides of all places that a filler could take, in either way of ``_gap``."""
        rows, hashes = [], []
        w, row = self.hash, self.row
        for k in range(1, FILLER_WORDS + 1):
            n = max(len(w) - k - 2, 0)
            at = np.flatnonzero(row[:n] == row[k + 2 : n + k + 2])
            rows += [row[at], row[at]]
            hashes += [_three(w[at], w[at + k + 1], w[at + k + 2], 1), _three(w[at], w[at + 1], w[at + k + 2], 2)]
        return np.concatenate(rows), np.concatenate(hashes).view(np.int64)


def _three(a: np.ndarray, b: np.ndarray, c: np.ndarray, way: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((a * _B + b) * _B + c) * _B + np.uint64(way)


def _gap(context: str) -> int | None:
    """The hash of ``_Aligned.gaps`` for a context: the word before and the two behind, or the two before and the one behind. None for contexts of fewer words."""
    left, _, right = context.partition("|")
    lw, rw = [_masked(w) for w in left.split()], [_masked(w) for w in right.lstrip(",;:.!? ").split()]
    if not lw or not rw or "^" in lw or "" in lw or "" in rw or len(lw) + len(rw) < 3:
        return None
    words, way = ([lw[-1], *rw], 1) if len(rw) > 1 else ([*lw, rw[0]], 2)
    return int(_three(*(np.uint64(xxhash.xxh64_intdigest(w)) for w in words), way).view(np.int64))


_HIT = "id string, at string, kind string, context string, example boolean, certain boolean, hash bigint"


def _hits(b: pa.RecordBatch, at: list[int], hits: list[tuple]) -> pa.RecordBatch:
    rows = pa.array(at, pa.int64())
    types = (pa.string(), pa.string(), pa.bool_(), pa.bool_(), pa.int64())
    return pa.RecordBatch.from_arrays([b.column("id").take(rows), b.column("at").take(rows), *(pa.array([h[k] for h in hits], t) for k, t in enumerate(types))], names=["id", "at", "kind", "context", "example", "certain", "hash"])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates of all kinds, and the runs of records without content (kind run, the text's hash as context)."""
    for whole in batches:
        for b in _slices(whole, "text"):
            titles, texts = pc.fill_null(b.column("title"), ""), pc.fill_null(b.column("text"), "")
            at, hits = [], []
            told, bare = whole_pages(titles, texts)
            for i in np.flatnonzero(told):
                at.append(int(i)), hits.append(("page", "", False, True, None))
            gate = _match(titles, _PLACE_GATE, False) | _match(texts, _PLACE_GATE, False) | _match(titles, _LOOSE_GATE, False) | _match(texts, _LOOSE_GATE, False)
            for i in np.flatnonzero(gate):
                for hit in residue_hits(titles[i].as_py(), texts[i].as_py()):
                    loose = not hit[2] and not hit[3] and hit[0] != "var"
                    at.append(int(i)), hits.append((*hit, _gap(hit[1]) if loose else None))
            yield _hits(b, at, hits)
            some = np.flatnonzero(bare)
            rows, runs = _Aligned(texts.take(pa.array(some))).runs()
            pairs = np.unique(np.stack([some[rows], runs]), axis=1) if len(rows) else np.zeros((2, 0), np.int64)
            named = {i: xxhash.xxh64_hexdigest(texts[i].as_py()) for i in some.tolist()}
            yield _hits(b, pairs[0].tolist(), [("run", named[i], False, False, r) for i, r in zip(*pairs.tolist())])


def _fillers(text: str, gaps: set[int]) -> Iterator[tuple[str, int]]:
    """Context and hash of the filler at all places of a text whose neighbours are in ``gaps``."""
    words = [m for m in re.finditer(r"\S+", text) if _masked(m.group(0))]
    w = np.array([xxhash.xxh64_intdigest(_masked(m.group(0))) for m in words], np.uint64)
    for k in range(1, FILLER_WORDS + 1):
        n = max(len(w) - k - 2, 0)
        at = np.arange(n)
        for way, h, before in ((1, _three(w[at], w[at + k + 1], w[at + k + 2], 1), at), (2, _three(w[at], w[at + 1], w[at + k + 2], 2), at + 1)):
            for i in before[[int(x) % BITMAP in gaps for x in h.tolist()]].tolist() if n else ():
                start, end = words[i + 1].start(), words[i + k].start() + len(words[i + k].group(0).rstrip(",;:.!?"))
                filler = text[start:end]
                if not CANDIDATE.search(filler) and not SENTENCE.search(filler):
                    yield _context(text, start, end, False)[0], xxhash.xxh64_intdigest(filler) >> 1


def _second(gaps: np.ndarray, runs: np.ndarray):
    """The second scan: fillers in the candidates' contexts (kind fill), and runs of records with content (kind seen)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gap_bits, run_bits = np.unpackbits(gaps).astype(bool), np.unpackbits(runs).astype(bool)
        for whole in batches:
            for b in _slices(whole, "text"):
                texts = pc.fill_null(b.column("text"), "")
                aligned = _Aligned(texts)
                at, hits = [], []
                rows, h = aligned.gaps()
                on = gap_bits[(h.view(np.uint64) % np.uint64(BITMAP)).astype(np.int64)]
                rows, h = rows[on], (h[on].view(np.uint64) % np.uint64(BITMAP)).astype(np.int64)
                order = np.argsort(rows, kind="stable")
                rows, h = rows[order], h[order]
                for i, s, e in _stretches(rows):
                    for context, filler in set(_fillers(texts[i].as_py(), set(h[s:e].tolist()))):
                        at.append(i), hits.append(("fill", context, False, False, filler))
                yield _hits(b, at, hits)
                rows, h = aligned.runs()
                on = run_bits[(h.view(np.uint64) % np.uint64(BITMAP)).astype(np.int64)]
                flat, row = _sentences(texts)
                content = _own(flat, row, len(texts)) > OWN_WORDS
                on &= content[rows]
                seen, times = np.unique(np.unique(np.stack([rows[on], h[on]]), axis=1)[1], return_counts=True)
                yield _hits(b, [0] * len(seen), [("seen", str(n), False, False, g) for g, n in zip(seen.tolist(), times.tolist())])

    return scan


def _stretches(rows: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Number, begin and end of each stretch of equal numbers."""
    edges = np.flatnonzero(np.diff(rows)) + 1
    for s, e in zip(np.r_[0, edges], np.r_[edges, len(rows)]):
        if e > s:
            yield int(rows[s]), int(s), int(e)


def _bitmap(hashes: DataFrame) -> np.ndarray:
    """Bits of the numbers in column ``hash``: at most ``BITMAP`` places come to the driver."""
    places = hashes.where(F.col("hash").isNotNull()).select(F.expr(f"cast(hash & {BITMAP - 1} as int)").alias("p")).distinct().collect()
    bits = np.zeros(BITMAP, bool)
    bits[[r["p"] for r in places]] = True
    return np.packbits(bits)


def template_residue(df: DataFrame, id_col: str, title_col: str, text_col: str, order_cols: list[str]) -> DataFrame:
    """Ids of the records (in their latest state) that hold residue or nothing but a template, with the kinds found."""
    # times as text of one width, so that their order is the order of the strings
    at = F.concat_ws("/", *[F.coalesce(F.date_format(c, "yyyyMMddHHmmssSSSSSS"), F.lit("")) for c in order_cols])
    base = df.select(F.col(id_col).alias("id"), at.alias("at"), F.col(title_col).alias("title"), F.col(text_col).alias("text"))
    last = df.select(F.col(id_col).alias("id"), at.alias("at")).groupBy("id").agg(F.max("at").alias("at"))
    # candidates and runs are few against the texts; both scans are followed by joins on them
    hits = materialize(spread(base).mapInArrow(_scan, _HIT).join(last, ["id", "at"], "left_semi"), "residue")
    single = hits.where(F.col("kind") != "run")
    runs = hits.where(F.col("kind") == "run").groupBy("hash").agg(F.countDistinct("context").alias("texts")).where(F.col("texts") >= MIN_PAGES)
    runs = materialize(runs, "residue")
    second = materialize(spread(base).mapInArrow(_second(_bitmap(single), _bitmap(runs)), _HIT), "residue")
    # contexts, aligned over all records: placeholders that are no examples, or varying fillers, make a slot
    known = single.where((F.col("kind") == "var") & ~F.col("example")).groupBy("context").agg(F.countDistinct("id").alias("n")).where(F.col("n") >= MIN_SUPPORT).select("context")
    fills = second.where(F.col("kind") == "fill").join(single.where(F.col("hash").isNotNull()).select("context").distinct(), "context", "left_semi")
    varying = fills.groupBy("context").agg(F.countDistinct("hash").alias("fillers"), F.countDistinct("id").alias("n")).where((F.col("fillers") >= MIN_FILLERS) & (F.col("n") >= MIN_RECORDS)).select("context")
    slots = known.unionByName(varying).distinct().withColumn("slot", F.lit(True))
    flagged = single.join(slots, "context", "left").where(F.col("certain") | (F.col("slot") & ~F.col("example") & (F.col("kind") != "var"))).select("id", "kind")
    # runs of whole-page templates: those that records with content hardly ever hold
    seen = second.where(F.col("kind") == "seen").groupBy("hash").agg(F.sum(F.col("context").cast("long")).alias("content"))
    templates = runs.join(seen, "hash", "left").where(F.coalesce("content", F.lit(0)) <= WITH_CONTENT * (F.col("texts") + F.coalesce("content", F.lit(0)))).select("hash")
    pages = hits.where(F.col("kind") == "run").join(templates, "hash", "left_semi").select("id", F.lit("page").alias("kind"))
    return flagged.unionByName(pages).groupBy("id").agg(F.sort_array(F.collect_set("kind")).alias("kinds"))
