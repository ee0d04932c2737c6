"""Broken prompt and response pairs (problem 6): each unusable answer with the kind of its defect.

Copies are found by compressing the answer with the question as a zstandard dictionary; languages by
dictionaries of function words, to which the collection adds words that it uses in one language only;
refusals by dictionaries of who speaks, what is denied and what was asked.  Answers that break off are
found by a terminal-context model over all distinct pairs: how often, after the last masked words of an
answer, answers end there without a full stop, backing off from longer to shorter contexts; and by
last words that are only the beginning of a known word.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass, field
from hashlib import blake2b

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.functions.text import words
from attestry.scratch import Scratch

# Stand-ins for no answer, compared in lower case without the punctuation around them.
STAND_INS = {
    "n/a", "na", "n.a", "none", "null", "nil", "nan", "tbd", "tba", "todo", "blank", "empty", "undefined", "no answer", "no answer provided", "no answer given", "no response", "not answered",
    "not available", "answer missing", "missing", "left blank", "keine antwort", "keine angabe", "k.a", "ohne antwort", "leer", "fehlt", "sans réponse", "pas de réponse", "aucune réponse", "réponse manquante",
    "vide", "sin respuesta", "ninguna respuesta", "no hay respuesta", "respuesta pendiente", "vacío", "s/r",
}
# Function words of languages; a word may be in several.
LANGUAGES = {
    "en": "the and of to had it that he who with would not but his her she they at by from on under because before after still been whose which when what where why how is are was were this these there in for as be have has did does than then into no yes".split(),
    "de": "der die das und nicht mit von dem den des ein eine einen einem einer sie er war ist zu auf im in weil dass bei nach bevor als aber für aus zum zur wem wer wie warum wo obwohl nachdem hatte hat wurde sich es ich noch schon auch nur sind an um wenn kein keine ja nein".split(),
    "fr": "le la les et avec pour pas une un est dans du des de au aux ne qui que plus mais parce avant était avait chez sur sous quand elle il ils pourquoi comment où même si après en ce cette ces son sa ses se à par sont ont été oui non".split(),
    "es": "el la los las y con para por una un del al de su sus se más pero porque antes estaba ya muy cuando qué quién cómo dónde aunque después había era sobre en es no lo le que está son han ha sido sí ni o sin".split(),
    "it": "il lo la gli le e con per una un del della dei delle di da non più ma perché prima era aveva quando che chi come dove anche dopo nel nella sul sulla al alla è sono ha hanno si suo sua se questo questa già stato".split(),
    "pt": "o os as e com para por uma um do da dos das de ao à não mais mas porque antes era tinha quando que quem como onde depois no na nos nas em seu sua se é são já foi estava também ele ela muito sem".split(),
    "nl": "de het een en van met voor niet maar omdat was had is in op aan bij door naar om te die dat wie wat waar waarom hoe toen nog ook zijn haar hij zij ze er werd uit over onder geen ja nee als dan tot".split(),
    "pl": "i w na z się nie jest to że do był była było o po ale jak kto co gdzie dlaczego kiedy już przed dla od przez za ich jego jej oraz który która".split(),
    "sv": "och att det som en ett på är av för med till den inte om men han hon var från när eller vad vem där varför hur efter innan under hade har blev sig".split(),
}
# Who speaks, in four languages; forms of Spanish verbs that say so themselves are among them.
SPEAKER = frozenset("i i'm i'd i've me my we our us ich mir mich mein meine meinen wir uns je j m me mon ma mes nous yo me mi mis puedo podré debo prefiero lamento siento tengo estoy quisiera niego".split())
# That something is not, cannot or shall not be; and verbs that say so and decline at once.
DENIAL = frozenset("not cannot can't won't don't isn't couldn't wouldn't no unable outside beyond against without nicht kein keine keinen außerhalb gegen ne pas impossible hors contre no fuera imposible contra sin".split())
DECLINES = frozenset("decline refuse refusing declining pass ablehnen verweigern ablehne verweigere refuser décliner refuse décline negarme rechazar declinar rehusar niego rechazo abstenerme".split())
# What an answerer is asked to do, may do, or is bound by.
TASK = frozenset(
    "answer answering help helping comply provide assist assisting discuss discussing respond responding reply share say saying disclose comment commenting tell allowed permitted able possible comfortable scope guidelines policy policies rules permission access information question request asking "
    "beantworten antworten helfen auskunft anfrage frage kommentieren behilflich lage möglich erlaubt gestattet befugt richtlinien vorgaben "
    "répondre aider fournir commenter discuter demande question mesure possible autorisé autorisée règles consignes "
    "responder contestar ayudar ayudarle ayudarte proporcionar comentar hablar solicitud pregunta posible permitido autorizado autorizada condiciones normas directrices".split())
#: An assistant that names itself as one.
_ITSELF = re.compile(r"\b(?:as|als|en tant qu[e']|como) (?:an? |ein(?:e)? |un(?:e)? )?(?:\w+ ){0,2}?(?:ai|assistant|model|modell|ki|assistent|ia|assistante?|modèle|asistente|modelo)\b")
_LONGEST = max(map(len, STAND_INS))
_EDGE = re.compile(r"[\W_]+$")
_WORD = re.compile(r"[^\W\d_]+|\d+|[^\w\s]")
_LETTERS = re.compile(r"[^\W_]+")
_UNSEEN = regex.compile(r"[\p{Cf}\p{Cc}\p{Cs}\p{Co}\p{Cn}--[\t\n\r]]+", regex.V1)
_QUOTED = re.compile(r"\"[^\"]*\"|„[^“”]*[“”]|«[^»]*»|“[^”]*”|‘[^’]*’")
_LEAD = re.compile(r"^[^\"„«“]{0,40}(?:\"[^\"]{15,}\"|„[^“”]{15,}[“”]|«[^»]{15,}»|“[^”]{15,}”)\s*:\s*")
_STOPS = ".!?。！？"
_CLOSERS = "\"'”“»’)]} \t\n\r ​"
#: Contexts are the last so many masked words and marks of an answer, its beginning counted as one.
CONTEXT = 4
#: A shorter context, and before all contexts the chance of one half, weighs as much as so many answers.
WEIGHT = 5.0
_START = "^"
#: Letters beyond the Latin, IPA and combining blocks.
_OTHER_SCRIPT = re.compile("[\u0370-\u1dbf\u1f00-\u1fff\u2c80-\ua71f\ua800-\ufaff\U00010000-\U0003ffff]")


def visible(text: str) -> str:
    """Without invisible and control characters, white space evened."""
    return " ".join((text if text.isprintable() else _UNSEEN.sub("", text)).split())


def is_empty(text: str | None) -> bool:
    return not text or says_nothing(visible(text))


def says_nothing(seen: str) -> bool:
    """Whether a visible text has no letters or digits, or is a stand-in for no answer."""
    first = _LETTERS.search(seen)
    if not first:
        return True
    core = _EDGE.sub("", seen[first.start() :])
    return len(core) <= _LONGEST and core.lower() in STAND_INS


def masked(text: str, skeleton: set[str]) -> list[str]:
    """Frequent words and marks as they are, other words by their shape."""
    out = []
    for m in _WORD.finditer(text):
        w = m.group()
        low = w.lower()
        out.append(low if low in skeleton or not w[0].isalnum() else "9" if w[0].isdigit() else "X" if w[0].isupper() else "w")
    return out


@dataclass
class Model:
    """What the collection says: contexts with their uses and how many of these end an answer without a stop; frequent words with their uses before a stop or an end; languages of words."""

    skeleton: set[str] = field(default_factory=set)
    ends: dict[str, tuple[int, int]] = field(default_factory=dict)
    last: dict[str, tuple[int, int]] = field(default_factory=dict)
    vocabulary: list[str] = field(default_factory=list)
    languages: dict[str, str] = field(default_factory=dict)

    def __post_init__(self):
        self.known = set(self.vocabulary)

    def ending(self, text: str) -> float:
        """The chance that an answer whose last words are those of ``text`` ends there, without a stop; the judged answer itself left out."""
        m, p = [_START, *masked(text, self.skeleton)], 0.5
        if m[-1] in self.last:
            n, ended = self.last[m[-1]]
            if (ended - 1 + WEIGHT * p) / (n - 1 + WEIGHT) < LEAST:
                return 0.0
        for k in range(1, min(CONTEXT, len(m)) + 1):
            n, ended = self.ends.get(" ".join(m[-k:]), (0, 0))
            if n:
                p = (max(ended - 1, 0) + WEIGHT * p) / (n - 1 + WEIGHT)
        return p

    def cut(self, word: str, question: str) -> bool:
        """Whether a last word is no word of the collection or the question, but the beginning of one."""
        asked = set(_LETTERS.findall(question.lower()))
        if word in self.known or word in asked:
            return False
        i = bisect_right(self.vocabulary, word)
        return (i < len(self.vocabulary) and self.vocabulary[i].startswith(word)) or any(w.startswith(word) for w in asked)


def own_words(text: str) -> str:
    """The text without what it quotes."""
    return _QUOTED.sub(" ", text)


def answer_part(question: str, answer: str) -> str:
    """The answer behind a repetition of the question in quotation marks, if it begins with one."""
    m = _LEAD.match(answer)
    if not m or m.end() == len(answer):
        return answer
    q = set(_LETTERS.findall(question.lower()))
    lead = _LETTERS.findall(m.group().lower())
    return answer[m.end() :] if sum(w in q for w in lead) >= 0.6 * len(lead) else answer


_OF: dict[str, tuple[str, ...]] = {}
for _name, _list in LANGUAGES.items():
    for _w in _list:
        _OF[_w] = (*_OF.get(_w, ()), _name)


def language_scores(text: str) -> dict[str, int]:
    scores = dict.fromkeys(LANGUAGES, 0)
    for w in _LETTERS.findall(text.lower()):
        for name in _OF.get(w, ()):
            scores[name] += 1
    return scores


def asked_in(question: str) -> str | None:
    """The language of a question, if its function words tell it from the others."""
    q = language_scores(question)
    first, second = sorted(q, key=q.get, reverse=True)[:2]
    return first if q[first] >= 2 and q[first] > q[second] else None


def in_other_language(question: str, answer: str, learned: dict[str, str] | None = None) -> bool:
    """Whether the answer's own words are wholly in another language, or another script, than the question."""
    own = own_words(answer)
    foreign = [len(_OTHER_SCRIPT.findall(t)) / max(1, sum(map(str.isalpha, t))) if _OTHER_SCRIPT.search(t) else 0.0 for t in (question, own)]
    if (foreign[0] > 0.8 and foreign[1] < 0.2 or foreign[0] < 0.2 and foreign[1] > 0.8) and _LETTERS.search(question) and _LETTERS.search(own):
        return True
    asked = asked_in(question)
    if not asked:
        return False
    # For each language, the words that it has and the asked one lacks against those the other way round.
    # What the answer took from the question, such as names, tells nothing beyond the dictionaries.
    said, told = _LETTERS.findall(own.lower()), set(_LETTERS.findall(question.lower()))
    of = [_OF.get(w) or (learned and w not in told and w in learned and (learned[w],)) or () for w in said]
    rest = [names for names in of if names and asked not in names]
    if not rest:
        return False
    theirs = Counter(name for names in rest for name in names)
    other, n = theirs.most_common(1)[0]
    ours = sum(asked in names and other not in names for names in of)
    return ours * 3 <= n and (n >= 2 or len(said) <= 3)


_SENTENCE = re.compile(r"(?<=[.!?…])\s+")
_SPOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")


def refuses(answer: str) -> bool:
    """Whether a sentence of the answer's own words says in the first person, or as an assistant, that what was asked will not be done."""
    own = own_words(answer).lower().replace("’", "'")
    if SPEAKER.isdisjoint(_LETTERS.findall(own)) and not _ITSELF.search(own):
        return False
    for sentence in _SENTENCE.split(own):
        ws = _SPOKEN.findall(re.sub(r"\b(j|m|n|l|d|qu)'", r"\1 ", sentence))
        speaks = any(w in SPEAKER for w in ws)
        denies = any(w in DENIAL for w in ws)
        if _ITSELF.search(sentence) and (denies or any(w in DECLINES for w in ws)):
            return True
        if speaks and (any(w in DECLINES for w in ws) or denies and any(w in TASK for w in ws)):
            return True
    return False


def _packed(text: bytes, given: bytes | None) -> int:
    d = zstandard.ZstdCompressionDict(given, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if given else None
    return len(zstandard.ZstdCompressor(level=1, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False).compress(text))


def copies(question: str, answer: str) -> bool:
    """Whether the answer says nothing beyond the question: with the question as dictionary next to nothing of it is left."""
    q, a = _LETTERS.findall(question.lower()), _LETTERS.findall(answer.lower())
    if len(a) < 4 or 2 * len(a) < len(q) or not q:
        return False
    had, times = Counter(q), max(1, int(len(a) / len(q) + 0.15))  # the question may be repeated
    if sum(min(n, times * had[w]) for w, n in Counter(a).items()) < 0.85 * len(a):
        return False
    qt, at = " ".join(q).encode(), " ".join(a).encode()
    if len(at) < 24:
        return at in qt
    # Text that repeats itself is small either way; then next to nothing of its length must be left.
    return _packed(at, qt) <= max(0.55 * _packed(at, None), 0.05 * len(at))


#: So many uses by other languages must be expected of a word before their lack makes it one of its language.
EXPECTED = 15.0
#: Answers end without a stop behind a context at least so often where that is usual.
LEAST = 0.02


def breaks_off(answer: str, question: str, model: Model) -> bool:
    """Whether the answer stops inside a word, phrase or sentence.

    An answer with a full stop is complete, one that ends on another mark is not.  Without a mark it
    breaks off if its last word is only the beginning of a known one, or if answers hardly ever end
    like it.  Where the collection says nothing, it is complete.
    """
    t = answer.rstrip(_CLOSERS)
    if not t:
        return False
    if t.endswith(("…", "...")):
        return True
    if t[-1] in _STOPS:
        return False
    if not t[-1].isalnum():
        return True
    ws = _LETTERS.findall(t.lower())
    return model.cut(ws[-1], question) or model.ending(t) < LEAST


def defect(question: str | None, answer: str | None, model: Model) -> str | None:
    a = visible(answer or "")
    if says_nothing(a):
        return "empty"
    q = visible(question or "")
    part = answer_part(q, a)
    if refuses(part):
        return "refusal"
    if copies(q, a):
        return "copies_question"
    if in_other_language(q, part, model.languages):
        return "other_language"
    return "truncated" if breaks_off(part, q, model) else None


def defects(pairs: DataFrame, id: str = "id", question: str = "question", answer: str = "answer", frequent: float = 0.02, counted: float = 0.0003, at_least: int = 3) -> DataFrame:
    """(pair_id, defect), one row per pair with an unusable answer.

    The first of these that holds: ``empty``, ``refusal``, ``copies_question``, ``other_language``,
    ``truncated``.  A pair with a null or blank question can be empty, a refusal or truncated.  The
    model counts over all distinct pairs (case and closing marks aside), so that copies of a pair don't
    make its ending look usual, and leaves the judged pair out; the same short answer to different
    questions counts each time, as that tells "Three times" from a broken answer.  Words in at least
    ``frequent`` of the answers stand for themselves in contexts.  Contexts and words that at least
    ``counted`` of the answers have, and ``at_least`` so many, reach the driver, which bounds all tables
    by the mean length of an answer.  Repeated pairs are judged each; texts are taken whole.
    """
    spark, scratch = pairs.sparkSession, Scratch(pairs.sparkSession, "pairs")
    held = scratch.write(pairs.select(F.col(id).alias("pair_id"), F.col(question).alias("q"), F.col(answer).alias("a")), "pairs")

    def parts(batches):
        for b in batches:
            seen: dict[bytes, tuple[str, str | None]] = {}
            for q, a in zip(b["q"].to_pylist(), b["a"].to_pylist()):
                said = visible(a or "")
                if says_nothing(said):
                    continue
                asked = visible(q or "")
                part = answer_part(asked, said)
                key = blake2b(f"{asked.lower()}\0{part.rstrip(_CLOSERS).lower()}".encode(), digest_size=16).digest()
                if key not in seen or part < seen[key][0]:
                    seen[key] = part, asked_in(asked)
            if seen:
                yield pa.RecordBatch.from_pydict({"key": list(seen), "part": [p for p, _ in seen.values()], "lang": pa.array([x for _, x in seen.values()], pa.string())})

    answers = held.select("q", "a").mapInArrow(parts, "key binary, part string, lang string").groupBy("key").agg(F.min("part").alias("part"), F.min("lang").alias("lang"))
    answers = scratch.write(answers.select("part", "lang"), "answers")
    total = answers.count()
    model = _fitted(answers, total, frequent * total, max(float(at_least), counted * total)) if total else Model()

    def judge(batches):
        for b in batches:
            kinds = [defect(q, a, model) for q, a in zip(b["q"].to_pylist(), b["a"].to_pylist())]
            hit = [i for i, k in enumerate(kinds) if k]
            yield pa.RecordBatch.from_arrays([b["pair_id"].take(pa.array(hit, pa.int64())), pa.array([kinds[i] for i in hit], pa.string())], ["pair_id", "defect"])

    return held.mapInArrow(judge, held.select("pair_id").schema.add("defect", "string"))


def _fitted(answers: DataFrame, total: int, frequent: float, counted: float) -> Model:
    """The model of ``answers`` (part, lang); what fewer than ``counted`` of them have stays out."""
    each = answers.select("lang", F.explode(F.array_distinct(words("part"))).alias("w")).groupBy("w", "lang").count()
    per = each.groupBy("w").agg(F.sum("count").alias("n"), F.max_by("lang", F.when(F.col("lang").isNotNull(), F.col("count"))).alias("lang"), F.max(F.when(F.col("lang").isNotNull(), F.col("count"))).alias("most"))
    rows = per.where(F.col("n") >= counted).collect()
    skeleton = {r.w for r in rows if r.n >= max(3.0, frequent)}
    # A word is one of a language if hardly any other has it though at least EXPECTED uses there were to be expected.
    share = {r.lang: r.n / total for r in answers.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    learned = {r.w: r.lang for r in rows if r.lang and r.w not in _OF and r.most >= 0.95 * r.n and r.n * (1 - share[r.lang]) >= EXPECTED}

    def contexts(batches):
        for b in batches:
            seen: dict[str, list[int]] = {}
            for part in b["part"].to_pylist():
                m = [_START, *masked(part, skeleton)]
                stop = len(m) - 1
                for i in range(1, stop + 1):
                    ctx = m[i]
                    for k in range(1, min(CONTEXT, i + 1) + 1):
                        if k > 1:
                            ctx = f"{m[i - k + 1]} {ctx}"
                        c = seen.setdefault(ctx, [0, 0, 0])
                        c[0] += 1
                        if i == stop:
                            c[1] += 1
                        if k == 1 and (i == stop or m[i + 1] in _STOPS):
                            c[2] += 1
            if seen:
                yield pa.RecordBatch.from_pydict({"ctx": list(seen), "n": [c[0] for c in seen.values()], "ended": [c[1] for c in seen.values()], "stopped": [c[2] for c in seen.values()]})

    sums = answers.select("part").mapInArrow(contexts, "ctx string, n long, ended long, stopped long").groupBy("ctx").agg(*[F.sum(c).alias(c) for c in ("n", "ended", "stopped")])
    found = sums.where(F.col("n") >= counted).collect()
    return Model(skeleton, {r.ctx: (r.n, r.ended) for r in found}, {r.ctx: (r.n, r.stopped) for r in found if r.ctx in skeleton}, sorted(r.w for r in rows), learned)
