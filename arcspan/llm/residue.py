"""Texts that are, or hold, template residue, filler, error messages or notices that scripts are needed.

Texts are cut into sentences and lines; numbers, addresses and dates are masked, and *every* message is grouped by its
exact hash over all documents and sources. Words of the same office (things of a web page, script words, verbs of
enabling or replacing, in one language) are masked alike in a notice, so that its variants make one group. Then

* a message of which a notice's wording makes a part counts where its group recurs widely: in MIN_DOCS documents of
  MIN_SOURCES sources;
* a message that no rule knows counts where it recurs widely and nearly all of its documents hold a notice (a companion:
  "please try again later"), which finds new wordings;
* syntax that nothing but a template or a program writes (placeholders, filler Latin, status lines, tracebacks), and a
  message that is nothing but a notice, count wherever they stand.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_DOCS, MIN_SOURCES = 3, 2
#: a companion needs at least so many documents, this share of them with a notice, and so many words
COMPANION_DOCS, COMPANION_SHARE, COMPANION_WORDS = 8, 0.95, 3


# --- placeholders -----------------------------------------------------------------------------------------------------

FIELD = (
    r"(?:site[ _]?name|site|name|title|author|date|period|county|excavator|trench[ _]?number|summary|grid[ _]?reference|main[ _]?finds|project[ _]?code|length|abstract|description|caption|text|value|address|e-?mail|phone|url|image|year|number|place|country"
    r"|titre|auteur|commune|p[ée]riode|coordonn[ée]es|nom[ _]du[ _]site|nom|r[ée]sum[ée]|titel|koordinaten|datum|gemeinde|fundort|fundnummer|bearbeiter|zeitstellung|beschreibung"
    r"|t[íi]tulo|autor|fecha|municipio|per[ií]odo|coordenadas|nombre[ _]del[ _]sitio|nombre|resumen|titolo|autore|data|comune|coordinate|nome[ _]del[ _]sito|nome|riassunto)"
)
ENTER = r"(?:insert|enter|add|type|fill in|your|ins[ée]rer|saisir|votre|entrer|hier|ihre?n?|insertar|escriba aqu[íi]|escriba|introduzca|su|inserire|scrivere qui|scrivere|il tuo)"
SUPPLY = r"(?:to be (?:supplied|added|completed|filled in)|here|[àa] compl[ée]ter|ici|einf[üu]gen|erg[äa]nzen|eintragen|por completar|aqu[íi]|da completare|da inserire|qui)"
#: syntax that nothing but a template uses, around any name
CODE = re.compile(r"\{\{\s*[^\W\d][\w. ]*\}\}|<%=?\s*[^\W\d][\w. ]*%>|\$\{\s*[^\W\d][\w. ]*\}|%\([^\W\d][\w ]*\)s|\{%\s*\w+\s+[^\W\d][\w. ]*%\}|%%[^\W\d][\w ]*%%|@@[^\W\d][\w ]*@@|\[\[\s*[^\W\d][\w ]*\]\]|<<\s*[^\W\d][\w ]*>>")
#: syntax with other uses, around a field's name only
LIGHT = re.compile(rf"(?:\{{\s*{FIELD}\s*\}}|<\s*{FIELD}\s*>|«{FIELD}»|#{FIELD}#|\${FIELD}\$|__{FIELD}__)")
WORDED = re.compile(rf"[\[(]\s*(?:{ENTER}\s+{FIELD}(?:\s+{SUPPLY})?|{FIELD}\s+{SUPPLY})\s*[\])]")
#: words by which a sentence speaks of a placeholder instead of holding one
SPEAKS = re.compile(r"for example|such as|e\. ?g\.|braces|field names?|z\. ?b\.|zum beispiel|par exemple|por ejemplo|ad esempio")

# --- filler -----------------------------------------------------------------------------------------------------------

LATIN = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur".split()
)
#: words of filler Latin that other texts hardly have; a message needs two of them
TELLING = frozenset(w for w in LATIN if len(w) > 3) - {"nulla"}
MASH = frozenset("foo bar baz qux quux qwerty qwertz asdf asdfg jklö hjkl yxcv test blah bla dummy".split())
#: what stands between two words of mashed keys
BETWEEN = (" ", ", ", ",", "-", "/", ". ")
MASHED = re.compile("(?<![^\\W_])(?:{m})(?:(?:{b})(?:{m})){{2}}(?![^\\W_])".format(m="|".join(sorted(MASH, key=len, reverse=True)), b="|".join(re.escape(x) for x in sorted(BETWEEN, key=len, reverse=True))))
FILLER = re.compile(
    r"(?:placeholder|dummy|sample|filler) text\b|\btext goes here|body copy to follow|(?:description|text) to come\b|\b(?:replace|overwrite|swap|change) (?:this|it) (?:text|box|block|caption|paragraph|with\b|before\b)|^please (?:replace|swap) this"
    r"|^type your \w+ here|test (?:record|entry|page), please ignore|(?:blindtext|platzhaltertext|mustertext)\b|steht später der|testeintrag, bitte|(?:überschreiben|ersetzen|ändern) sie diesen? (?:platzhalter|absatz|textblock|block|text)\b"
    r"|faux texte|texte d'exemple|texte de remplissage|votre (?:résumé|texte) ici|fiche de test, ne pas|(?:remplacez|modifiez|écrasez) ce(?:tte)? (?:texte|bloc|paragraphe|légende|cadre)|ici viendra"
    r"|texto de (?:relleno|ejemplo|prueba)|aquí va (?:la|el) |registro de prueba, ignorar|(?:cambie|sustituya|reemplace) este (?:bloque|texto|párrafo|cuadro)|su resumen aquí"
    r"|testo (?:di prova|segnaposto|di esempio)|qui va inserit|(?:cambiare|sostituire|modificare) questo (?:blocco|testo|paragrafo|riquadro)|scheda di prova|inserire qui"
)

# --- notices about scripts, cookies and browsers ----------------------------------------------------------------------

OBJECT = r"(?:javascript|js|java ?script|scripts?|scripting|active content|cookies|skripte|aktive inhalte|contenu actif|contenido activo|contenuti attivi|gli script|los scripts|les scripts)"
ENABLE = (
    r"(?:enable|activate|allow|unblock|turn on|switch on|accept|aktivieren|erlauben|schalten sie|zulassen|activez|activer|autorisez|autoriser|débloquez|débloquer|acceptez|active|habilite|permita|desbloquee|acepte"
    r"|attivare|attivi|consentire|abilitare|sbloccare|accettare)"
)
#: where or for what something is to be enabled
PURPOSE = (
    r"(?:in your browser|in the browser|for this site|for this page|this page|this app|to (?:view|see|use|read|continue|run)|before you continue|and reload|\bfirst\b|and cookies|cookies and|content for"
    r"|im browser|für diese seite|laden sie neu|diese seite|um die karte|um den katalog|zum lesen|fortzufahren|zuerst|dans le navigateur|dans votre navigateur|pour ce site|rechargez|cette page|pour voir|pour lire|pour utiliser|avant de continuer|d'abord"
    r"|en el navegador|en su navegador|en este sitio|recargue|esta página|para ver|para leer|para usar|antes de seguir|primero|nel browser|per questo sito|ricaricare|questa pagina|per vedere|per leggere|per usare|prima di continuare|prima)"
)
ASKED = re.compile(rf"\b{ENABLE} (?:\w+ )?{OBJECT}\b")
PURPOSES = re.compile(rf"\b{PURPOSE}")
SCRIPT = re.compile(
    r"\b(?:javascript|js|scripting|scripts|cookies)(?: and (?:javascript|cookies|scripts))? (?:is|are|must be) (?:required|needed|disabled|turned off|switched off|enabled)|\bscripting turned off|(?:needs|requires) (?:javascript|scripts|cookies)\b"
    r"|does not work without (?:scripts|javascript)|\b(?:your )?browser is (?:not supported|too old|out of date|outdated)|checking your browser|allow scripts to continue|turn it on in your browser|switch them on to|need to enable (?:cookies|javascript)"
    r"|wird javascript benötigt|(?:javascript|skripte|cookies)(?: und (?:skripte|javascript|cookies))? (?:muss|müssen|wird|werden) (?:\w+ )?(?:zugelassen|aktiviert|benötigt)|browser lässt keine skripte|ihr browser (?:wird nicht unterstützt|ist veraltet)"
    r"|nécessite javascript|scripts sont désactivés|(?:votre )?navigateur (?:n'est pas (?:pris en charge|compatible)|est trop ancien|est obsolète)|necesita javascript|scripts desactivados|(?:su )?navegador (?:no es compatible|no está admitido|está obsoleto)"
    r"|è necessario javascript|(?:richiede|necessita di) javascript|script sono disattivati|(?:il )?browser (?:non è supportato|non supportato|è obsoleto)"
)

# --- error and access messages ----------------------------------------------------------------------------------------

_EN_WHAT = (
    r"(?:(?:this|the requested|the) (?:page|record|entry|item|file|report|resource|document|image|article)|the (?:image server|map tile|map service|search service|catalogue|page you are looking for|report you asked for|record you asked for|database|archive viewer))"
)
_EN_FAILS = (
    r"(?:is (?:not|temporarily not|currently not|no longer) available (?:at this address|right now|at the moment)|(?:cannot|can't|could not) be (?:shown|displayed|found|loaded|located|retrieved|opened)(?: (?:right now|at the moment|on this server|at this address))?(?=\W*$| \(code| on this| right| at)"
    r"|failed to load|did not respond|returned no answer|ran into a problem|no longer exists|has been moved|is closed to (?:guests|visitors|the public|anonymous users|non-?members)|is down for maintenance|is gone\b)"
)
_DE_WHAT = r"(?:(?:diese|die angeforderte) (?:seite|datei|ressource)|der (?:eintrag|datensatz|kartendienst|bildserver|suchdienst)|die (?:datenbank|karte)|das (?:dokument|bild))"
_DE_FAILS = r"(?:antwortet nicht|existiert nicht mehr|(?:ist )?(?:derzeit|unter dieser adresse|zurzeit|momentan) nicht (?:erreichbar|verfügbar)|ist nicht (?:erreichbar|verfügbar)|konnten? nicht (?:gefunden|geladen|angezeigt) werden)"
_FR_WHAT = r"(?:cette (?:page|fiche|carte|entrée)|la (?:page|ressource|fiche) demandée|la (?:carte|fiche|ressource)|le (?:fichier demandé|fichier|service|serveur d'images|document))"
_FR_FAILS = r"(?:ne répond pas|n'existe plus|est introuvable à cette adresse|n'a pas pu être (?:chargée?|affichée?|trouvée?)|n'est pas (?:accessible|disponible)|(?:est )?(?:momentanément|temporairement) (?:indisponible|inaccessible))"
_ES_WHAT = r"(?:esta página|la (?:página|ficha) solicitada|el archivo solicitado|la ficha|el mapa|el servicio|el recurso solicitado|este documento)"
_ES_FAILS = r"(?:no responde|ya no existe|no se (?:pudo|ha podido) (?:cargar|mostrar|encontrar)|no se encuentra en esta dirección|no está disponible ahora|no está disponible en este momento)"
_IT_WHAT = r"(?:questa pagina|la (?:pagina|risorsa|scheda) richiesta|il file richiesto|la mappa|la scheda|il servizio|questo documento)"
_IT_FAILS = r"(?:non risponde|non esiste più|non è stat[ao] (?:caricat|mostrat|trovat)[ao](?! nell)|non si trova a questo indirizzo|non è disponibile(?: ora| al momento))"
#: what only a program or a server writes; counts wherever it stands
SYNTAX = re.compile(
    r"\bhttp 9\b|\[err[_-]9\]|^(?:error|erreur|errore|fehler) 9\b ?[:\-–]|^9: |^9 (?:not found|forbidden|unauthorized)\b|(?:^|\W)9 (?:bad gateway|internal server error|service unavailable|gateway time-?out|not found\W*$)|(?:^|\W)9 forbidden|\berror 9 - page not found|sqlstate\["
    r"|fatal error: |^(?:warning|notice): \w+\(|failed to open stream|traceback \(most recent call last\)|\b(?:keyerror|typeerror|nullpointerexception|undefined (?:index|method|variable))\b|segmentation fault|stack trace:|^noscript\b"
    r"|\berror code:? 9|fehlercode 9|code d'erreur 9|código de error 9|codice di errore 9"
)
#: the wording of errors and refusals; counts where its group recurs widely
ERROR = re.compile(
    rf"\b{_EN_WHAT} (?:\w+ )?{_EN_FAILS}|\b{_DE_WHAT} (?:\w+ )?{_DE_FAILS}|\b{_FR_WHAT} {_FR_FAILS}|\b{_ES_WHAT} {_ES_FAILS}|\b{_IT_WHAT} {_IT_FAILS}"
    r"|\bpage not found\b|internal server error|request timed out|too many requests|your (?:ip )?address has been blocked|your session has expired|log in again to continue|access denied|you (?:do not|don't) have permission|are not authori[sz]ed"
    r"|unable to (?:retrieve|load|open) (?:the )?(?:document|page|record)|upstream (?:host|server)|something went wrong (?:while|with)|could not be located on this server|connection to the database failed"
    r"|zugriff verweigert|keine berechtigung für|ihre sitzung ist abgelaufen|interner serverfehler|seite nicht gefunden\b|hier ist etwas schiefgelaufen|keine verbindung zur datenbank"
    r"|accès refusé|vous n'êtes pas autorisé|votre session a expiré|erreur interne du serveur|page introuvable\b|service (?:momentanément )?indisponible|connexion à la base de données"
    r"|acceso denegado|no tiene permiso para|su sesión ha caducado|error interno del servidor|página no encontrada|no se pudo conectar con|algo salió mal"
    r"|accesso negato|non si dispone dei permessi|la sessione è scaduta|errore interno del server|pagina non trovata|impossibile connettersi|qualcosa è andato storto"
)
#: words of one office are masked alike in a notice, so that its variants have one hash
OFFICES = tuple(
    (re.compile(rf"\b{words}\b"), sign)
    for words, sign in (
        (rf"(?:(?:le|les|la|los|el|gli|i|l') ?)?{OBJECT}(?: and {OBJECT})?", "§script"), (_EN_FAILS, "§fails"), (_DE_FAILS, "§versagt"), (_FR_FAILS, "§échoue"), (_ES_FAILS, "§falla"), (_IT_FAILS, "§manca"), (_EN_WHAT, "§it"), (_DE_WHAT, "§es"), (_FR_WHAT, "§ce"), (_ES_WHAT, "§eso"), (_IT_WHAT, "§esso"),
        (r"(?:(?:is|are|must be) (?:required|needed|enabled|disabled|turned off|switched off)|needs|requires|does not work without|(?:wird|werden|muss|müssen) (?:\w+ )?(?:benötigt|aktiviert|zugelassen)|lässt keine|nécessite|sont désactivés|necesita|desactivados|è necessario|richiede|necessita di|sono disattivati)", "§needs"),
        (r"(?:access denied|you (?:do not|don't) have permission|are not authori[sz]ed|your session has expired|your (?:ip )?address has been blocked|too many requests|log in again to continue)", "§refused"), (r"(?:zugriff verweigert|keine berechtigung für|ihre sitzung ist abgelaufen)", "§verwehrt"),
        (r"(?:accès refusé|vous n'êtes pas autorisé|votre session a expiré)", "§refusé"), (r"(?:acceso denegado|no tiene permiso para|su sesión ha caducado)", "§denegado"), (r"(?:accesso negato|non si dispone dei permessi|la sessione è scaduta)", "§negato"),
        (r"(?:enable|activate|allow|unblock|turn on|switch on|accept)", "§on"), (r"(?:aktivieren|erlauben|schalten sie|zulassen)", "§an"), (r"(?:activez|activer|autorisez|autoriser|débloquez|débloquer|acceptez)", "§actif"),
        (r"(?:active|habilite|permita|desbloquee|acepte)", "§activo"), (r"(?:attivare|attivi|consentire|abilitare|sbloccare|accettare)", "§attivo"),
        (r"(?:replace|overwrite|swap|change|überschreiben|ersetzen|ändern|remplacez|modifiez|écrasez|cambie|sustituya|reemplace|cambiare|sostituire|modificare)", "§put"),
        (r"(?:text|box|block|caption|paragraph|platzhalter|absatz|textblock|texte|bloc|paragraphe|légende|cadre|bloque|texto|párrafo|cuadro|blocco|testo|paragrafo|riquadro)", "§text"),
    )
)
QUOTED = re.compile(r"(?<!\w)'[^'\n]{2,80}'(?!\w)|\"[^\"\n]{2,80}\"|“[^”\n]{2,80}”|„[^“\n]{2,80}“|‘[^’\n]{2,80}’|« [^»\n]{2,80} »")

REPEATED = re.compile(r"([^\W\d_])\1\1")
ADDRESS = re.compile(r"https?://\S+|www\.\S+|[\w.+-]+@[\w-]+\.[\w.]+")
#: numbers, dates, times and network addresses
FIGURE = re.compile(r"\d+(?:[.,:/-]\d+)*")
SPACE = re.compile(r"[^\S\n\r ]+ *| [^\S\n\r]+")
CUT = re.compile(r"(?<=[.!?…])\s+|\s*[\n\r]+\s*")
ODD = (("\u2019", "'"), ("\u02bc", "'"), ("\u200b", ""), ("\u200c", ""), ("\u200d", ""), ("\ufeff", ""), ("\u00ad", ""))


def masked(text: str) -> str:
    """Lower case, character entities and odd white space resolved, addresses, dates and numbers masked; line breaks stay."""
    t = html.unescape(text) if "&" in text else text
    if not t.isascii():
        for sign, plain in ODD:
            t = t.replace(sign, plain)
    t = SPACE.sub(" ", t).lower()
    if "://" in t or "www." in t or "@" in t:
        t = ADDRESS.sub("u", t)
    return FIGURE.sub("9", t)


def literals(*rules: re.Pattern) -> list[str]:
    """Strings of which every text that one of the rules matches must hold one, worked out from the rules' own syntax.

    Of the parts that a rule cannot do without, the one whose shortest string is the most telling is taken: a sign that
    ordinary prose hardly has counts as four letters.
    """
    import re._constants as op
    import re._parser as syntax

    def worth(options: list[str]) -> float:
        return min(len(o) + 3 * sum(not (ch.isalnum() or ch in " .,'-:") for ch in o) for o in options)

    def needed(tree) -> list[str] | None:
        found, run = [], ""
        for kind, value in [*tree, (None, None)]:
            if kind is op.LITERAL:
                run += chr(value)
                continue
            if run:
                found.append([run])
                run = ""
            if kind is op.SUBPATTERN:
                inner = needed(value[3])
            elif kind is op.IN and all(k is op.LITERAL for k, _ in value):
                inner = [chr(v) for _, v in value]
            elif kind is op.BRANCH:
                parts = [needed(t) for t in value[1]]
                inner = None if any(p is None for p in parts) else [x for p in parts for x in p]
            elif kind is op.MAX_REPEAT and value[0] > 0:
                inner = needed(value[2])
            else:
                inner = None
            if inner:
                found.append(inner)
        return max(found, key=worth) if found else None

    out: set[str] = set()
    for rule in rules:
        options = needed(syntax.parse(rule.pattern))
        if not options:
            raise ValueError(f"nothing that {rule.pattern[:40]} needs can be searched for")
        out |= set(options)
    return sorted(out)


def triggers():
    """The literals of all rules as one Aho-Corasick automaton: a text without any of them can match no rule."""
    import ahocorasick

    automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    for literal in [*literals(CODE, LIGHT, WORDED, SYNTAX, ERROR, FILLER, ASKED, SCRIPT), *TELLING, *(a + between + b for a in MASH for between in BETWEEN for b in MASH)]:
        automaton.add_word(literal)
    automaton.make_automaton()
    return automaton


def judge(message: str) -> tuple[str, str | None] | None:
    """The kind of a message and the notice in it by which it is grouped; None for ordinary content.

    The group is None where none is needed: for syntax, and for a message that is nothing but a notice.

    message: masked and in lower case.
    """
    bare = QUOTED.sub(" ", message)
    if not SPEAKS.search(bare) and (CODE.search(message) or LIGHT.search(message) or WORDED.search(message)):
        return "placeholder", None
    words = re.findall(r"[^\W\d_]+", bare)
    latin = sum(w in LATIN for w in words)
    if len(words) >= 3 and latin >= 0.8 * len(words) and len(TELLING.intersection(words)) >= 2:
        return "filler", None
    same = [w for w in words if len(w) >= 3 and len(set(w)) == 1]
    if len(words) >= 3 and (len(same) >= 3 and len(same) >= 0.7 * len(words) or MASHED.search(bare)):
        return "filler", None
    if SYNTAX.search(bare):
        return "error", None
    asked = ASKED.search(bare)
    for kind, hit in (("filler", FILLER.search(bare)), ("script", asked and PURPOSES.search(bare) and asked), ("script", SCRIPT.search(bare)), ("error", ERROR.search(bare))):
        if hit:
            whole = len(hit.group()) >= len(bare.strip(" .!…:¡")) - 1
            return kind, None if whole else framed(hit.group())
    return None


def framed(notice: str) -> str:
    """A notice with its words of one office masked alike."""
    for words, sign in OFFICES:
        notice = words.sub(sign, notice)
    if "§text" in notice and "§put" not in notice:
        return "§text"
    return notice.strip(" .!…:")


def parts_of(text: str, automaton) -> list[tuple[str, str | None, bool, str]]:
    """(group, kind, sure, message) of each distinct sentence or line of a text; kind is None for what no rule knows."""
    t = masked(text)
    parts = dict.fromkeys(p.strip() for p in CUT.split(t))
    parts.pop("", None)
    if next(automaton.iter(t), None) is None and not REPEATED.search(t):
        return [(p, None, False, p) for p in parts]
    out = []
    for p in parts:
        found = judge(p) if next(automaton.iter(p), None) is not None or REPEATED.search(p) else None
        if found is None:
            out.append((p, None, False, p))
        else:
            kind, notice = found
            out.append((p if notice is None else f"{kind}\t{notice}", kind, notice is None, p))
    return out


def candidates(documents: DataFrame, doc_id: str, text: str, source: str, with_text: bool = False) -> DataFrame:
    """doc, source, h (hash of the message or of the notice in it), kind, sure and words for each distinct message of each document.

    The messages' texts are kept only if they are to be shown, as hashes are enough to group them.
    """
    rows = documents.where(F.coalesce(F.trim(text) != "", F.lit(False))).select(F.col(doc_id).alias("doc"), F.col(source).cast("string").alias("source"), F.col(text).alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        automaton = triggers()
        for b in batches:
            found = [parts_of(t, automaton) for t in b["text"]]
            flat = [x for f in found for x in f]
            out = b[["doc", "source"]].loc[b.index.repeat([len(f) for f in found])].reset_index(drop=True)
            out["h"] = np.array([xxhash.xxh64_intdigest(x[0]) for x in flat], dtype=np.uint64).view(np.int64)
            out["kind"] = pd.Series([x[1] for x in flat], dtype="object")
            out["sure"] = np.array([x[2] for x in flat], dtype=bool)
            out["words"] = np.array([x[3].count(" ") + 1 for x in flat], dtype=np.int32)
            out["message"] = pd.Series([x[3] if with_text else None for x in flat], dtype="object")
            yield out

    kind = rows.schema["doc"].dataType.simpleString()
    return rows.mapInPandas(run, f"doc {kind}, source string, h bigint, kind string, sure boolean, words int, message string")


def messages(found: DataFrame, min_docs: int = MIN_DOCS, min_sources: int = MIN_SOURCES) -> DataFrame:
    """h, kind, docs, sources, words and message of the groups that are residue: sure ones, notices that recur widely, and companions."""
    by_source = found.groupBy("h", "source").agg(F.count("*").alias("docs"), F.min("kind").alias("kind"), F.bool_or("sure").alias("sure"), F.max("words").alias("words"), F.min("message").alias("message"))
    groups = by_source.groupBy("h").agg(F.sum("docs").alias("docs"), F.count("*").alias("sources"), F.min("kind").alias("kind"), F.bool_or("sure").alias("sure"), F.max("words").alias("words"), F.min("message").alias("message"))
    groups = groups.where("sure or docs >= %d and sources >= %d" % (min_docs, min_sources)).persist(StorageLevel.MEMORY_AND_DISK)
    known = groups.where("kind is not null")
    bad = found.where("kind is not null").join(known.select("h"), "h", "left_semi").select(F.col("doc").alias("bad")).distinct()
    wide = groups.where((F.col("kind").isNull()) & (F.col("docs") >= max(min_docs, COMPANION_DOCS)) & (F.col("words") >= COMPANION_WORDS))
    beside = found.where("kind is null").select("doc", "h").join(wide.select("h"), "h", "left_semi").join(bad, F.col("doc").eqNullSafe(F.col("bad")), "left_semi")
    beside = beside.groupBy(F.col("h").alias("hh")).agg(F.count("*").alias("with"))
    companions = wide.join(beside, F.col("h") == F.col("hh")).where(F.col("with") >= COMPANION_SHARE * F.col("docs")).withColumn("kind", F.lit("companion"))
    return known.unionByName(companions.select(*known.columns)).select("h", "kind", "docs", "sources", "message")


def residue(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", min_docs: int = MIN_DOCS, min_sources: int = MIN_SOURCES) -> DataFrame:
    """doc_id and kinds (array, sorted: companion, error, filler, placeholder, script) of the documents to leave out.

    Null and blank texts are no case; a null source is a source of its own; a null id is kept; rows that repeat an id
    come out once; texts are read whole; an empty table gives no rows; other columns are not read.
    """
    found = candidates(documents, doc_id, text, source).persist(StorageLevel.MEMORY_AND_DISK)
    found.count()  # else the branches of the plan, which start together, would each cut all texts
    bad = messages(found, min_docs, min_sources).select("h", "kind")
    return found.select("doc", "h").join(bad, "h").groupBy(F.col("doc").alias(doc_id)).agg(F.sort_array(F.collect_set("kind")).alias("kinds"))
