from __future__ import annotations

import random

from attestry.llm import pairs
from tests.conftest import rows

Q = "Why did Anna carry the copper kettle that Bo had left beside the old bridge before the rain came?"


def test_empty_kinds():
    for a in (None, "", " ", "​", "—", "...", '""', "?", "N/A", "[blank]", "<empty>", "(no answer)", "No answer provided.", "TBD", "null", " \t\n"):
        assert pairs.is_empty(a)
    for a in ("Yes.", "12", "Nobody.", "In Rome", "None of them came.", "é"):
        assert not pairs.is_empty(a)


def test_refusals_and_quotes():
    yes = ["I'm sorry, but I cannot comply with this request.", "I must decline: answering would go against my guidelines.", "With respect, this is something I have to refuse.", "Thank you for asking, but it is not possible for me to respond.", "As a reading assistant, I don’t have access to the text.",
           "Ich muss die Antwort ablehnen.", "Es tut mir leid, aber diese Frage kann ich nicht beantworten.", "Je ne suis pas en mesure de traiter cette demande.", "Il m'est impossible de vous aider.", "Lo siento, pero no puedo responder a esta pregunta.", "Debo rechazar esta solicitud."]
    no = ['"I am sorry," wrote Bo, "I was unable to find the kettle in time."', "Anna refused to answer and left for Rome.", "Unfortunately for Bo, the printer had already left.", "Bo was not allowed to discuss the kettle.", 'The beekeeper said, "I cannot help you with that," and closed the gate.']
    assert all(pairs.defect(Q, a, pairs.Model()) == "refusal" for a in yes)
    assert all(pairs.defect(Q, a, pairs.Model()) is None for a in no)


# Written without looking at any answer of the test data.
UNSEEN_REFUSALS = ["I'd rather not say.", "Sorry, that is outside what I can help with.", "Lo siento, prefiero no responder.", "I won't be answering that.", "We are not permitted to disclose this information.", "Dazu möchte ich mich nicht äußern, das ist nicht meine Frage.", "Je préfère ne pas répondre.",
                   "As an AI language model, I cannot form opinions.", "I have to pass on this question.", "No puedo ayudarte con eso.", "Ich darf dazu keine Auskunft geben.", "Sorry, I can't discuss that topic.", "My guidelines do not allow me to answer."]
UNSEEN_ANSWERS = ["Anna said that she could not help him.", "He did not answer and left the house.", "Nobody could tell.", "She refused to comment on it.", "It was against the rules of the inn.", "They were not allowed to enter.", '"I cannot help you," said Bo, and left.', "My guess is that Bo left it there because it was heavy.",
                  "The miller carried the old lamp to Rome", "Anna", "Because of the rain", "In Rome", "El Greco painted it.", "She went to La Paz with Das Boot on tape.", "Three times", "Bo and the baker"]
UNSEEN_LANGUAGES = ["Perché la pioggia era già arrivata e non voleva più aspettare.", "Porque a chuva já tinha chegado e ele não queria esperar.", "Потому что дождь уже начался.", "因为雨已经来了。", "Omdat het regende en zij niet wilde wachten.", "Ponieważ padał deszcz i nie chciała czekać, bo było późno.",
                    "Weil der Regen kam.", "Parce que la pluie était arrivée.", "Porque la lluvia ya había llegado."]


def test_unseen_answers():
    assert all(pairs.defect(Q, a, pairs.Model()) == "refusal" for a in UNSEEN_REFUSALS)
    assert all(pairs.defect(Q, a, pairs.Model()) == "other_language" for a in UNSEEN_LANGUAGES)
    assert all(pairs.defect(Q, a, pairs.Model()) is None for a in UNSEEN_ANSWERS)


def test_copies():
    for a in (Q, Q.upper(), Q.rstrip("?"), "Question: " + Q, f'"{Q}"', "You asked: " + Q, Q.replace("copper ", ""), Q.replace("?", " …?"), Q + " " + Q, f"{Q}\n{Q}\n{Q}"):
        assert pairs.defect(Q, a, pairs.Model()) == "copies_question", a
    for a in ("The copper kettle.", "Anna and Bo", f'As for the question, "{Q}": They agreed to share the boat, although Anna still feared the miller.', "Beside the old bridge."):
        assert pairs.defect(Q, a, pairs.Model()) != "copies_question", a


def test_languages():
    de = "Warum trug Anna den Kessel, bevor der Regen kam und die Wirtin ging?"
    assert pairs.in_other_language(Q, "Anna nahm sie mit und gab der Wirtin die warme Kerze.")
    assert pairs.in_other_language(Q, "Porque Anna perdió la botella y la tejedora no quería esperar más.")
    assert pairs.in_other_language(de, "Because Anna had opened the gate and the baker would not wait.")
    assert not pairs.in_other_language(Q, 'A sign in Rome read "La table reste ici, et les lettres sont sous le pont", which the innkeeper explained to the others.')
    assert not pairs.in_other_language(Q, "In Rome") and not pairs.in_other_language("", "Die Kerze und der Kessel.") and not pairs.in_other_language(de, "Niemand.")


def test_broken_off_by_the_model(spark):
    rng = random.Random(4)
    name = lambda: rng.choice(["Anna", "Bo", "Carl", "Dora", "Emil", "Fay", "Gus", "Hal"]) + rng.choice(["", "son", "dottir"])
    thing = lambda: rng.choice(["kett", "gat", "lett", "lamp", "boat", "bridg", "rop", "sadd"]) + rng.choice(["le", "er", "on", "an", "il", "um", "et", "ock"])
    full = [f"They agreed to share the {thing()}, although {name()} still feared the miller." for _ in range(150)] + [f"{name()} took it home and gave the {thing()} to the baker." for _ in range(150)]
    short = [f"The {thing()}" for _ in range(30)] + [f"{name()} and the baker" for _ in range(30)] + ["Three times"] * 20 + ["Twice."] * 20 + [f"In {name()}holm{rng.choice(['', '.'])}" for _ in range(30)]
    cut = ["They agreed to share the", "They agreed to share the kettle, although Anna sti", "Anna took it home and gave the lamp to", "Bo took it home and…", "They agreed to share the gate,", "Carl took it home and gave the ket", "They agreed to share the lamp, although Bo still feared the miller. It rained, and the"]
    recs = [(f"p{i}", Q, a) for i, a in enumerate(full + short + cut)] + [("n1", None, "They agreed to share the"), ("n2", None, None), ("n3", Q, Q), (None, Q, "")]
    d = spark.createDataFrame(recs + [recs[-2]], "id string, question string, answer string").selectExpr("*", "1 as q", "2 as a", "'x' as defect")
    got = rows(pairs.defects(d))
    n = len(full) + len(short)
    want = [(f"p{n + i}", "truncated") for i in range(len(cut))] + [("n1", "truncated"), ("n2", "empty"), ("n3", "copies_question"), ("n3", "copies_question"), (None, "empty")]
    assert got == sorted(want, key=repr)


def test_empty_and_long(spark):
    schema = "id string, question string, answer string"
    assert pairs.defects(spark.createDataFrame([], schema)).count() == 0
    long = "The weaver said that the boat was old. " * 20_000
    got = rows(pairs.defects(spark.createDataFrame([("a", Q, long), ("b", Q, long + "And then the"), ("c", long, long)], schema)))
    assert got == [("b", "truncated"), ("c", "copies_question")]


def test_copies_of_a_broken_answer_do_not_vouch_for_it(spark):
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abdefgiklmnoprstu") for _ in range(n))
    full = [f"They agreed to share the {word(6)}, although {word(5).title()} still feared the miller." for _ in range(200)]
    recs = [(f"f{i}", Q, a) for i, a in enumerate(full)]
    recs += [(f"c{i}", [Q, Q.upper(), " " + Q][i % 3], ["They agreed to share the", "They agreed to share the ", "THEY AGREED to share the"][i % 3]) for i in range(100)]
    d = spark.createDataFrame(recs, "id string, question string, answer string")
    assert rows(pairs.defects(d)) == sorted((f"c{i}", "truncated") for i in range(100))


def test_last_words_decide_not_first_ones(spark):
    """The same beginning is broken off or complete by what it ends on, however long the answer."""
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("abdefgiklmnoprstu") for _ in range(n))
    full = [f"When the {word(5)} of {word(6).title()} came home that evening, the {word(6)} was old, so {word(5).title()} took it {word(4)} and gave the {word(6)} to {word(5).title()}." for _ in range(150)]
    full += [f"{word(5).title()} said that {word(6)} and {word(4)} came to the {word(6)} with a {word(5)}, and {word(5).title()} went first{rng.choice(['', '.'])}" for _ in range(60)]
    recs = [(f"f{i}", f"{Q} {i}", a) for i, a in enumerate(full)]
    recs += [("short", Q, "Anna went first"), ("cut", Q, full[0][: full[0].index(" to ") + 3]), ("word", Q, "Anna gave it to the man by the brid"), ("mark", Q, "Anna gave it to the man,")]
    assert rows(pairs.defects(spark.createDataFrame(recs, "id string, question string, answer string"))) == [("cut", "truncated"), ("mark", "truncated"), ("word", "truncated")]


def test_languages_learned_from_the_collection(spark):
    """A word used under questions of one language only tells that language, a name used under all doesn't."""
    de, rest = "Warum trug Anna den Kessel zur Brücke, bevor der Regen kam und sie ging, Nummer {}?", ["Lamo", "Kilo"]
    recs = [(f"d{i}", de.format(i), f"Schnurstracks {rest[i % 2]}.") for i in range(40)] + [(f"e{i}", f"{Q} {i}", f"Straightaway {rest[i % 2]}.") for i in range(60)]
    recs += [("x", Q, "Schnurstracks."), ("y", de, "Straightaway."), ("n", Q, "Lamo."), ("m", de, "Kilo.")]
    assert rows(pairs.defects(spark.createDataFrame(recs, "id string, question string, answer string"))) == [("x", "other_language"), ("y", "other_language")]
