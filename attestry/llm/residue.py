"""Template residue and error-page text (problem 9).

Lines are normalised and counted per host; lines that recur on a large part of a host's documents are
its boilerplate and are subtracted.  What is left is searched for evidence, sentence by sentence: a
notice is a sentence that names what serves or runs a page, says that it fails or is needed, and says
next to nothing else; a filler names a text and says that it is yet to come.  The words are sorted into
classes, so no wording is listed.  Slots are found by the delimiters of template languages, filler
also as running text of no known language, as repetition and as keys struck in a row.  What a sentence
only quotes, shows or tells a story about does not count.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.functions.text import label
from attestry.scratch import Scratch

# What runs in a browser, English, German, French, Spanish.
SCRIPT = frozenset("javascript script scripts scripting noscript cookie cookies browser browsers skript skripte skripten navigateur navigateurs navegador navegadores".split())
# What serves pages and what is asked of it.
SERVED = frozenset(
    "page pages webpage site website server servers url link http https request requests requested gateway connection session network internet video service access permission permissions resource address administrator webmaster "
    "exception stack traceback property variable undefined null pointer index template upstream proxy host database timeout login captcha api "
    "seite seiten webseite serverfehler adresse anfrage anfragen verbindung sitzung netzwerk dienst zugriff berechtigung server angeforderte angefordert vorgang "
    "serveur requête requêtes demande demandée connexion réseau accès autorisation administrateur délai attente "
    "página páginas sitio servidor solicitud solicitudes solicitada conexión sesión red servicio acceso permiso administrador dirección espera".split())
# That it fails.
FAILS = frozenset(
    "error errors failed fails failure timed denied forbidden unavailable unreachable unauthorized unauthorised expired blocked interrupted invalid exceeded crashed trouble wrong cannot can't couldn't doesn't unable occurred unexpected too bad temporarily internal maintenance notified reset refused "
    "fehler serverfehler interner verweigert vorübergehend zeitüberschreitung schiefgelaufen aufgetreten abgelaufen gesperrt unterbrochen viele "
    "erreur introuvable refusé interne indisponible temporairement dépassé expiré bloqué interrompu interrompue échoué interdit trop produite survenue "
    "error denegado interno temporalmente agotado caducado bloqueado interrumpida fallado demasiadas ocurrido mal salido".split())
# What fails to happen where it is denied, and the denials.
LACKS = frozenset(
    "found exist exists respond responding responded load loading loaded displayed available defined working reached permission permissions access berechtigung zugriff gefunden verfügbar erreichbar existiert angezeigt geladen "
    "existe trouvée trouvé charger chargée disponible autorisation accès encontrada encontrado cargar permiso acceso".split())
NOT = frozenset("not no cannot can't couldn't doesn't didn't isn't nicht kein keine pas".split())
# That it is needed, switched off, or waited for.
NEEDED = frozenset(
    "enable enabled enabling disabled turn turned on off activate activated allow allowed require required requires need needs needed must accept accepted support supported unsupported reload checking verifying "
    "aktivieren aktiviert deaktiviert ausgeschaltet eingeschaltet einschalten benötigt benötigen erlauben zulassen unterstützt prüfen "
    "activer activez activé activés désactivé désactivés besoin requis requise nécessite nécessaire autoriser accepter "
    "active activar activado activados desactivado desactivados necesita necesario requiere habilite habilitar permitir aceptar".split())
# Speaking to the reader, and asking to try again.
SPOKEN = frozenset(
    "please sorry oops you your we we're we've our us try again later retry refresh contact return quote reload go back "
    "bitte sie ihr ihre ihrem ihren wir uns unser unsere versuchen erneut wenden laden leider "
    "veuillez vous votre vos nous notre réessayer désolé signalez rechargez "
    "favor usted su sus nosotros nuestro vuelva intentarlo intente nuevo lamentamos indique recargue".split())
# Words that neither make nor unmake a notice.
GLUE = frozenset(
    "the a an many moved out of to in at by for from with and or not no is are was be been has have had do does did this that these those it its as if when then before after will would should can could may now there here any some all only something "
    "few minutes moment seconds time view see use using used continue reading read open opening display show shown complete team near line ref code status number search box home more well been being having went properly "
    "der die das dem den des ein eine einer im in am an auf zu zum zur für mit und oder nicht kein keine ist sind wird werden wurde war hat haben haben kann können es etwas alle um aus bei von dass einigen minuten später weiterzulesen fortzufahren "
    "le la les l un une de du des d au aux à en dans pour par avec et ou ne n pas est sont a été ont avons peut pu momentanément il elle s c ce cette ces qui que quelques minutes plus tard lire suite fonctionner "
    "el los las uno una de del al en para por con y o no se ha han pudo puede busca es está están este esta que lo unos minutos dentro más tarde seguir leyendo mostrar mostrarse funcionar algo".split())
# Names of what is not written yet, and words that say so: strong ones, and ones that do so together.
WRITTEN = frozenset("text texts section chapter paragraph passage entry content copy description title summary card caption heading body item real final proper absatz inhalt eintrag beschreibung titel texte paragraphe contenu titre résumé texto párrafo contenido título resumen descripción".split())
TO_COME = frozenset("todo follow placeholder placeholders dummy sample filler layout replace insert supplied tbd tba platzhalter platzhaltertext blindtext mustertext beispieltext ersetzen einfügen remplissage provisoire remplacer insérer venir relleno pendiente provisional reemplazar insertar redactar".split())
SOON = frozenset("here later soon coming come follows appear appears goes yet add write hier später folgt steht ici bientôt venir aquí pronto próximamente".split())
#: A single word among those of a notice may be one of its site or subject.
STRANGE = 1
_TOKEN = re.compile(r"[^\W_]+(?:['’][^\W_]+)?")
_SENTENCE = re.compile(r"(?<=[.!?…])\s+|[\r\n]+")
_CLAUSE = re.compile(r"\s*[;:—–|()\[\]]\s*|\s-\s")
_INNER_QUOTE = re.compile(r"(?<=\w\s)(?:\"[^\"]+\"|“[^”]+”|„[^“”]+[“”]|«[^»]+»|'[^']+')")
_CODE = re.compile(r"[45]\d\d")
_ELISION = re.compile(r"\b(?:l|d|n|s|c|qu|j|m)['’](?=[^\W\d_]{3})", re.I)
#: Rows of a keyboard, for words that are only struck along one.
_ROWS = ("qwertyuiop", "asdfghjkl", "zxcvbnm", "qwertzuiop", "yxcvbnm", "azertyuiop", "qsdfghjklm")
_ALONG = re.compile("asd|sdf|dfg|fgh|ghj|hjk|jkl|qwe|zxc|xcv|yxc|lkj|dsa|ewq")
_AGAIN = re.compile(r"\b(\w{4,}|\w{2,} \w{2,}(?: \w{2,})?)(?:[ ,.;]+\1\b){2,}")
_XXX = re.compile(r"\bx{3,}(?:\s+x{3,}){2,}", re.I)
_UNSET = re.compile(r"(?<![:\"\w])\b(?:undefined|null|nan)\b(?![\"\w:])", re.I)
_WAITING = re.compile(r"(?:loading|lädt|chargement|cargando|redirecting|please wait)\s*(?:…|\.\.\.)", re.I)
_NAME = r"[A-Za-z][A-Za-z0-9_.]{0,40}"
# Delimiters of template languages and forms.
SLOT = re.compile(
    rf"\{{\{{\s*{_NAME}\s*(?:\|[^{{}}\n]{{1,60}})?\}}\}}|\$\{{\s*{_NAME}\s*\}}|\{{%-?\s*{_NAME}(?:\s[^%\n]{{1,60}})?\s*-?%\}}|<%=?\s*{_NAME}\s*%>|#\{{\s*{_NAME}\s*\}}|%%{_NAME}%%|@@{_NAME}@@|%\({_NAME}\)s|\${_NAME}\$|\b__[A-Z][A-Z0-9_]*__\b"
    rf"|\[(?i:insert|enter|your|add|hier|insérer|insertar)\s[^\]\n]{{1,40}}\]|<[A-Za-z][A-Za-z_ ]{{1,40}}\s(?:here|hier|ici|aquí)>|«[a-z][a-z_]{{1,40}}»|&lt;{_NAME}&gt;|\[\[[A-Za-z][A-Za-z0-9_. ]{{0,40}}\]\]|\*\|{_NAME}\|\*|\[[A-Z][A-Z0-9_]{{2,40}}\]|(?<![\w\"{{$#%:]){{(?:\d{{1,2}}|{_NAME})\}}(?!\}})|<{_NAME}>"
)
_SIGN = re.compile(r"[{$%<#@\[&«*]|__")
# Verbs of showing right before a slot, and nouns for slots anywhere in its sentence: it is talked about.
SHOWS = re.compile(r"\b(?:writes?|marked|noted|called|named|spelled|prints?|types?|typed|reads?|explains? that|means|schreibt|markiert|genannt|écrit|marquée?|nommée?|escribe|marcad[oa]|llamad[oa])\s*[\"'“„«]?\s*$", re.I)
TALKS = re.compile(r"\b(?:slots?|placeholders?|templates?|syntax|variables?|markers?|markup|platzhalter|vorlagen?|balises?|gabarits?|plantillas?|marcador(?:es)?)\b", re.I)
#: The best-known words of pseudo-Latin filler; the rest of it is made up.
LATIN = frozenset("lorem ipsum dolor amet consectetur adipiscing elit eiusmod tempor incididunt aliqua".split())
#: So many of them within so many characters, wherever in a text, are filler.
MANY, NEAR = 6, 400
# Frequent words of the four languages that Latin doesn't use; a sentence in one of them has some.
_KNOWN = frozenset(
    "the of to and was had is it that he she they his her with for on at by from as be not but an this which who when there were are has have would could been some for said so into than then what where why how did does or if all no one "
    "der die das und nicht mit von dem den ein eine einen einer war ist sie er zu auf im dass wer als wie noch auch nach bei aus für sich es so man hat hatte wird aber oder wenn was wo "
    "le les des un une était du que qui dans pas avec pour il elle au aux ne la une fois plus sur chez ce cette ou où quand comme mais "
    "el los las y con para por una no su lo ya que cuando más pero como del al muy se qué".split())
# Those of them that pseudo-Latin has too.
_SHARED = frozenset("do qui has his no ne an".split())
_CELL = re.compile(_SENTENCE.pattern + r"|[|\t]")
_QUOTED = re.compile(r"(?<=\w\s)(?:\"[^\"\r\n]+\"|“[^“”\r\n]+”|„[^„“”\r\n]+[“”]|«[^«»\r\n]+»|'[^'\r\n]+'(?!\w))")
#: Sentences of four and more words of letters only, in lower case but for the first letter.
_PLAIN = re.compile(r"(?:(?<=[.!?…]\s)|^)[^\W\d_A-ZÀ-Þ]?[^\W\d_]?[^\W\d_A-ZÀ-Þ]*(?: [^\W\d_A-ZÀ-Þ]+){3,}(?=[.!?…]|$)", re.M)


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for w in SOON:  # these count in pairs, so one of them stands behind a space
        a.add_word(" " + w, len(w))
    for w in SCRIPT | SERVED | TO_COME | {"error", "erreur", "fehler", "wrong", "schiefgelaufen", "again", "erneut", "réessayer", "notified", "produite", "intentarlo", "intente", "mal", "load", "loading", "lädt", "chargement", "cargando", "wait", "redirecting"}:
        a.add_word(w, len(w))
    a.make_automaton()
    return a


def classes(clause: str) -> dict[str, int]:
    """How many words of each class a clause has, and how many ``strange`` ones of none."""
    n = dict.fromkeys(("script", "served", "fails", "needed", "spoken", "written", "to_come", "soon", "code", "lacks", "strange"), 0)
    denied = False
    for w in _TOKEN.findall(_ELISION.sub("", clause.lower().replace("’", "'"))):
        known = w in GLUE or w in NOT
        denied |= w in NOT
        for name, kind in (("script", SCRIPT), ("served", SERVED), ("fails", FAILS), ("lacks", LACKS), ("needed", NEEDED), ("spoken", SPOKEN), ("written", WRITTEN), ("to_come", TO_COME), ("soon", SOON)):
            if w in kind:
                n[name] += 1
                known = True
        if w.isdigit():
            n["code"] += _CODE.fullmatch(w) is not None
        elif not known:
            n["strange"] += 1
    if denied:
        n["fails"] += n["lacks"]
    return n


def notice(clause: str) -> str | None:
    """error, script or filler, if the clause is a notice of that kind and hardly anything else."""
    n = classes(clause)
    served, fails, spoken, strange = n["served"], n["fails"], n["spoken"], n["strange"]
    if strange > STRANGE:
        return None
    if n["script"] and (n["needed"] or fails and not strange):
        return "script"
    if served and fails and (not strange or spoken or n["code"] or served > 1 or fails > 1):
        return "error"
    if n["to_come"] and (n["written"] or n["to_come"] > 1) or n["soon"] > 1 and not strange:
        return "filler"
    if strange:
        return None
    if fails and (n["code"] or fails > 1 or spoken > 1 or spoken and n["lacks"] or re.search("went wrong", clause, re.I)) or served and n["code"]:
        return "error"
    if spoken > 1 and not n["written"] and re.search(r"\b(?:again|erneut|réessayer|intent\w+)\b", clause, re.I):
        return "error"
    return None


def notices(sentence: str) -> str | None:
    """The kind of notice that a sentence is, or that it begins with: later clauses count while nothing else has been said."""
    s = _INNER_QUOTE.sub(" quoted phrase ", sentence)
    kind = notice(s)
    if kind:
        return kind
    parts = [p for p in _CLAUSE.split(s) if p]
    if len(parts) > 1:
        for p in parts:
            kind = notice(p)
            if kind:
                return kind
            if classes(p)["strange"]:
                return None
    return None


def struck(word: str) -> bool:
    """Whether a word is only keys struck along one row of a keyboard."""
    return any(word in row or word[::-1] in row for row in _ROWS)


def repeated(flat: str) -> bool:
    """Keys struck along a row three times, or a phrase of up to three words put three times in a row."""
    if _ALONG.search(flat):
        run = 0
        for w in _TOKEN.findall(flat):
            run = run + 1 if len(w) > 2 and struck(w) else 0
            if run >= 3:
                return True
    # Repetition shows in few different words; then it is looked for.
    for line in flat.splitlines():
        for part in line.split(". "):
            ws = part.split()
            if len(ws) >= 3 and 3 * len(set(ws)) <= 2 * len(ws) + 1 and _AGAIN.search(part):
                return True
    return False


def around(text: str, start: int, end: int) -> str:
    """The sentence in which text[start:end] stands."""
    a = max(text.rfind(c, 0, start) for c in "\n\r")
    for m in re.finditer(r"[.!?…]\s", text[a + 1 : start]):
        last = a + 1 + m.end()
        a = max(a, last - 1) if last <= start else a
    z = re.compile(r"[\r\n]|[.!?…](?:\s|$)").search(text, end)
    return text[a + 1 : z.start() if z else len(text)]


def shown(text: str, start: int, end: int) -> bool:
    """Whether the slot text[start:end] is only shown or talked about."""
    before, after = text[max(0, start - 40) : start], text[end : end + 2]
    # Quoted tightly within a sentence of its own; a whole field of an export ("text":"...") is no quotation.
    tight = before[-1:] in "\"“„«'" and before[-2:-1] == " " and after[:1] in "\"”“»'" if before and after else False
    return tight or bool(SHOWS.search(before)) or bool(TALKS.search(around(text, start, end)))


def latin_words(flat: str) -> Iterator[re.Match]:
    """The best-known words of pseudo-Latin in a lower-case text, but for quoted and mentioned ones.

    One or two of them with frequent words of the four languages around them in their sentence or cell are only mentioned.
    """
    flat = _QUOTED.sub(lambda m: " " * len(m.group()), flat)
    begin = 0
    for end in [*_CELL.finditer(flat), None]:
        runs, prose = [[]], False
        for m in _TOKEN.finditer(flat, begin, end.start() if end else len(flat)):
            if m.group() in LATIN:
                runs[-1].append(m)
            elif m.group() in _KNOWN and m.group() not in _SHARED:
                prose = True
                if runs[-1]:
                    runs.append([])
        for run in runs:
            if len(run) > 2 or not prose:
                yield from run
        begin = end.end() if end else begin


def latin_passage(flat: str) -> bool:
    """Whether the best-known words of pseudo-Latin stand close together anywhere in a lower-case text; dolor, also Spanish, only beside others."""
    if sum(map(flat.count, LATIN)) < MANY:
        return False
    last = deque(maxlen=MANY)
    for m in latin_words(flat):
        last.append(m)
        if len(last) == MANY and m.end() - last[0].start() <= NEAR and any(x.group() != "dolor" for x in last):
            return True
    return False


def latin_filler(text: str) -> bool:
    """Running text of no known language: a passage of well-known pseudo-Latin, or two sentences or a long one of plain lower-case words, none of them a frequent word of the four languages."""
    words = sentences = 0
    if latin_passage(text.lower()):
        return True
    for m in _PLAIN.finditer(text):
        ws = m.group().lower().split()
        if _KNOWN.isdisjoint(ws):
            words += len(ws)
            sentences += 1
            if words >= 8 and (sentences > 1 or not LATIN.isdisjoint(ws) or words >= 10):
                return True
    return False


def evidence(text: str | None) -> list[str]:
    """Kinds of evidence in a text: error, script, slot, filler; each once."""
    if not text:
        return []
    found: set[str] = set()
    flat = text.lower()
    if len(flat) != len(text):  # a few capitals change length; then positions are those of the lower-case text
        text = flat
    at = [end for end, n in _automaton().iter(flat) if not flat[end + 1 : end + 2].isalnum() and not flat[end - n : end - n + 1].isalnum()]
    if at:
        k, begin = 0, 0
        for m in [*_SENTENCE.finditer(text), None]:
            stop = m.start() if m else len(text)
            while k < len(at) and at[k] < begin:
                k += 1
            if k < len(at) and at[k] < stop:
                kind = notices(text[begin:stop])
                if kind:
                    found.add(kind)
            begin = m.end() if m else stop
        for line in text.splitlines():
            if len(_UNSET.findall(line)) > 1:
                found.add("filler")
            if _WAITING.fullmatch(line.strip()):
                found.add("script")
        for m in _WAITING.finditer(text):
            if m.start() == 0 or text[: m.start()].rstrip(" ")[-1:] in ".!?…\r\n":
                found.add("script")
    if "slot" not in found and _SIGN.search(text):
        for m in SLOT.finditer(text):
            if not _html(m.group()) and not shown(text, m.start(), m.end()):
                found.add("slot")
                break
    if "filler" not in found and ("xxx" in flat and _XXX.search(text) or latin_filler(text) or repeated(flat)):
        found.add("filler")
    return sorted(found)


# Element names that <name> may be in ordinary markup.
_TAGS = frozenset("a b i u p br hr em td tr th ul ol li div span img pre code h1 h2 h3 h4 h5 h6 body html head table strong small sup sub blockquote".split())


def _html(slot: str) -> bool:
    return slot[0] == "<" and slot.strip("<>").lower() in _TAGS


def normal_line(c: Column) -> Column:
    """A line as it is counted: lower case, digits as one mark, single white space."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"\d+", "0"), r"\s+", " "))


def whole(text: str) -> list[str]:
    """Evidence in a text whose lines all recur on its host.

    Sites put notices about scripts below what they serve, so these count only where they are half of the lines.
    """
    kinds = evidence(text)
    if "script" in kinds:
        lines = [x for x in re.split(r"\r\n|\r|\n", text) if x.strip()]
        if 2 * sum("script" in evidence(x) for x in lines) < len(lines):
            kinds.remove("script")
    return kinds


def residue(documents: DataFrame, id: str = "doc_id", text: str = "text", host: str = "source", share: float = 0.2, least: int = 50) -> DataFrame:
    """(doc_id, kinds): documents in which residue stands in place of content, with the sorted kinds.

    A line is boilerplate of its host if it occurs in at least ``least`` and more than ``share`` of the
    host's distinct texts, so that a text copied many times counts once.  A document that has no other
    lines than boilerplate, such as an error page with its number, is searched whole, see ``whole``.
    Documents of no host count as one host.  Null and blank texts have no evidence; repeated documents
    are judged each; texts are taken whole.  An empty table gives an empty result.
    """
    scratch = Scratch(documents.sparkSession, "residue")
    rows = documents.select(F.col(id).alias("doc_id"), F.coalesce(label(host), F.lit("")).alias("host"), F.col(text).alias("text"))
    lines = F.filter(F.transform(F.split(F.col("text"), r"\r\n|\r|\n"), normal_line), lambda x: x != "")
    each = rows.where("text is not null").select("host", F.xxhash64("text").alias("t"), F.array_distinct(F.transform(lines, lambda x: F.xxhash64(x))).alias("h")).distinct()
    each = scratch.write(each, "texts")
    counted = each.select("host", F.explode("h").alias("h")).groupBy("host", "h").agg(F.count(F.lit(1)).alias("n"))
    often = counted.where(F.col("n") >= least)
    size = each.groupBy("host").agg(F.count(F.lit(1)).alias("texts"))
    # Per host at most (mean lines per text / share) lines can recur that often.
    plates = often.join(size, "host").where(F.col("n") > share * F.col("texts")).groupBy("host").agg(F.collect_list("h").alias("plates"))
    plates = scratch.write(plates, "boilerplate")
    j = rows.join(plates, "host", "left")
    kept = F.array_join(F.filter(F.split("text", r"\r\n|\r|\n"), lambda x: ~F.array_contains("plates", F.xxhash64(normal_line(x)))), "\n")
    j = j.withColumn("kept", F.when(F.col("plates").isNotNull(), kept)).withColumn("bare", F.col("kept").isNotNull() & ~F.col("kept").rlike(r"\S"))
    left = j.select("doc_id", F.when(F.col("bare"), F.col("text")).otherwise(F.coalesce("kept", "text")).alias("text"), "bare").where("text is not null and text != ''")

    def search(batches):
        for b in batches:
            kinds = [whole(t) if bare else evidence(t) for t, bare in zip(b["text"].to_pylist(), b["bare"].to_pylist())]
            hit = [i for i, k in enumerate(kinds) if k]
            yield pa.RecordBatch.from_arrays([b["doc_id"].take(pa.array(hit, pa.int64())), pa.array([",".join(kinds[i]) for i in hit], pa.string())], ["doc_id", "kinds"])

    return left.mapInArrow(search, left.select("doc_id").schema.add("kinds", "string"))
