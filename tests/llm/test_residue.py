from __future__ import annotations

import pytest

from attestry.llm import residue
from tests.conftest import rows

CASES = {
    "HTTP 502: Page introuvable — Signalez la demande 843 à la bibliothèque.": "error", "Oops! Something went wrong\nOur team has been notified.": "error", "Error 403 — You do not have permission to view this work.": "error", "Error 500": "error",
    "Please enable JavaScript to continue reading.\n\nLoading…": "script", "Für diese Seite werden Skripte benötigt.": "script", "Los scripts están desactivados en su navegador.": "script", "Loading…": "script",
    "Dear {name},\nthe kettle came.": "slot", "At noon the {{ title }} was carried past.": "slot", "the ${editor} lamp": "slot", "a %%PLACE%% b": "slot", "said {% page %} no": "slot", "x <%= volume %> y": "slot", "#{page} x": "slot", "@@name@@ x": "slot", "by __SOURCE_NAME__ x": "slot",
    "the $title$ x": "slot", "[READER] came": "slot", "[Insert page here] x": "slot", "{0} came": "slot", "%(date)s x": "slot", "<quote goes here> x": "slot", "&lt;author&gt; letter": "slot", "der «place» hat": "slot",
    "Lorem ipsum dolor permen nubila amet. Fabera dubit fabera non posque querit.": "filler", "Title\nxxxxx xxxx xxxxxxx xxx xxxxxx": "filler", "Placeholder paragraph. Replace this with the real summary.": "filler", "by undefined, undefined pages, added null": "filler", "Hier steht später der Text.": "filler", "asdf asdf asdf jkl jkl": "filler",
}
FINE = [
    "In the catalogue the printer writes {{title}} where the name of a work goes; the finished card never shows it.", "The note explains that ${author} and %%DATE%% are slots of the old card form, filled in by the baker before printing.",
    'A reviewer asked what "Page not found" meant on the screen; Ann explained that the address had changed.', "An error of 503 coins was found in the ledger of Rome and put right by the baker.", "There were 404 quiet steps and 500 lamps on the way to Rome.",
    "The lesson describes why a browser with JavaScript turned off shows only a notice, and how Ann wrote the page to work without it.", "Typesetters call such a text lorem ipsum, said the baker, and Ann filled the column with real verses afterwards.",
    "In brackets Ann noted [sic] and [two leaves missing], as the miller had done.", "The form had a line marked <name>; Ann signed there in ink.", '{"id":"p7","line":404,"text":"When the baker returned, the lamp was gone."}', "(holds ann kettle) ; It rained.", "oar .... 500 s. Ann", "<p>a <b>bold</b> step</p>", "«La table reste ici», dit-elle.", "", "  \n ",
]


@pytest.mark.parametrize("text,kind", list(CASES.items()))
def test_evidence(text, kind):
    assert kind in residue.evidence(text)
    assert kind in residue.evidence(FINE[0] + "\n\n" + text + "\n\n" + FINE[2])


@pytest.mark.parametrize("text", FINE)
def test_mentions_are_no_evidence(text):
    assert residue.evidence(text) == []
    assert residue.evidence("The baker laughed, for the lamp had never been " + text + " old at all.") == []


# Written without looking at any document of the test data.
UNSEEN = [
    "We're having trouble loading this page.", "Please turn JavaScript on and reload the page.", "Your connection was interrupted", "Hello [[FIRST NAME]], welcome", "{{ user.name | default('x') }}", "TBD: add description", "Coming soon",
    "This site can't be reached.", "504 Gateway Timeout", "Sorry, the page you requested could not be found.", "Your session has expired. Please log in again.", "Access to this resource is forbidden.", "Server error", "Der Server ist vorübergehend nicht erreichbar.",
    "Le service est temporairement indisponible.", "La página que busca no existe.", "You must enable cookies to continue.", "An error occurred while loading the page.", "Diese Seite benötigt JavaScript.", "Hello {{first_name}},", "[Your name here]", "Write a description here",
    "Lorem ipsum dolor sit amet, consectetur adipiscing elit.", "jkl jkl jkl asdf", "Error establishing a database connection", "Request timed out.", "Too many requests", "Please try again later.", "blah blah blah", "Summary to follow.", "Cloud host unreachable: connection refused",
    "Error: null pointer exception", "This video is unavailable.", "NaN, undefined, null", "Nous n'avons pas pu charger cette page.", "No se pudo cargar la página.", "Es ist ein Fehler aufgetreten.", "Une erreur est survenue.", "Ha ocurrido un error.",
]
UNSEEN_FINE = [
    "He wrote: access denied by the guard at the old gate.", "The ledger said service unavailable on Sundays, and the baker laughed.", "The API returns 404 not found when the key is missing from the table.", "The service of the church was long.", "She turned the page and found the letter.",
    "The server brought the soup and the bread.", "Please return the book to the library.", "The address was wrong, so the letter came back to Rome.", "Nobody answered the door.", "I need a new script for the play.", "The browser of old books smiled at him.", "Her permission was never asked.",
    "You may count the letters, said the host.", "Error bars show the spread over five runs.", "He made a great many errors in the ledger.", "The text of the song follows on the next leaf.", "In Jinja, {{ name }} is a variable that the template fills.", "Type ${HOME} to print the folder's name; it is a variable.",
    "The lost key was found.", "The connection between the two towns was broken in the war.", "Go back home, she said, and try again with the other key.", "No, no, no, said the miller.", "The old, old, old man slept.", "Das war der Fehler des Müllers, und er wusste es.", "Content people sleep well.", "The summary is here.",
]


@pytest.mark.parametrize("text", UNSEEN)
def test_unseen_residue(text):
    assert residue.evidence(text)
    assert residue.evidence("The miller carried the old lamp to Rome.\n" + text + "\nThe rain stopped at noon.")


@pytest.mark.parametrize("text", UNSEEN_FINE)
def test_unseen_stories(text):
    assert residue.evidence(text) == []


def test_boilerplate_is_subtracted_per_host(spark):
    foot = "Please enable JavaScript to use the search box."
    docs = [(i, "a", f"Story {i} of the baker and the lamp.\nIt went on for {i} days.\n{foot}") for i in range(80)] + [(100, "b", f"Another story.\n{foot}"), (101, "A ", "Page not found"), (102, None, "Dear {name},"), (103, "a", None), (104, "a", ""), (105, None, None)]
    docs += [(200 + i, "notices", foot) for i in range(60)] + [(100, "b", f"Another story.\n{foot}")]
    d = spark.createDataFrame(docs, "doc_id long, source string, text string").selectExpr("*", "'x' as host", "1 as n", "'k' as kinds")
    got = rows(residue.residue(d))
    assert got == sorted([(100, "script"), (100, "script"), (101, "error"), (102, "slot")] + [(200 + i, "script") for i in range(60)], key=repr)


def test_empty_long_and_case_lengths(spark):
    schema = "doc_id long, source string, text string"
    assert residue.residue(spark.createDataFrame([], schema)).count() == 0
    long = "It rained, and the baker moved the lamp under the roof again. " * 30_000
    assert rows(residue.residue(spark.createDataFrame([(1, "a", long), (2, "a", long + "{{name}}"), (3, "a", "İİİ.\nPage not found")], schema)), "doc_id") == [(2,), (3,)]


def test_copied_error_pages_are_no_boilerplate(spark):
    stories = [(i, "a", f"Story of {chr(97 + i % 26)}{chr(97 + i // 26)}.\nThe lamp of {chr(97 + i // 26)}{chr(97 + i % 26)} went out.") for i in range(120)]
    for page in ("HTTP 502: Bad gateway\nPlease quote the request.", "HTTP 502: Bad gateway\nPlease quote request {}."):
        d = spark.createDataFrame(stories + [(1000 + i, "a", page.format(i)) for i in range(60)], "doc_id long, source string, text string")
        assert rows(residue.residue(d), "doc_id") == [(1000 + i,) for i in range(60)]


def test_documents_of_boilerplate_alone_are_searched_whole(spark):
    head, foot = "The baker's shelf", "Please enable JavaScript to use the search box."
    docs = [(i, "a", f"{head}\nStory of {chr(97 + i % 26)}{chr(97 + i // 26)}.\n{foot}") for i in range(100)] + [(1000 + i, "a", f"{head}\n\n{foot}") for i in range(40)]
    d = spark.createDataFrame(docs, "doc_id long, source string, text string")
    assert rows(residue.residue(d)) == [(1000 + i, "script") for i in range(40)]


STORY = "It rained, and the baker moved the lamp under the roof again. "
LOREM = "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor."


@pytest.mark.parametrize("before", [0, 1, 5, 6, 7, 30, 3000])
def test_filler_counts_anywhere_in_a_text(before):
    assert residue.evidence(STORY * before + LOREM) == ["filler"]
    assert residue.evidence(STORY * before + "\n\n" + LOREM + "\n\n" + STORY * 30) == ["filler"]
    assert residue.evidence(STORY * before + "Lorem ipsum dolor sit amet, consectetur. Elit, sed do eiusmod.") == ["filler"]
    assert residue.evidence(STORY * before + "\nOf the lamp | Lorem ipsum | Of the kettle | Lorem ipsum | Of the oar | Lorem ipsum") == ["filler"]
    assert residue.evidence(STORY * before) == []


@pytest.mark.parametrize("before", [0, 30])
@pytest.mark.parametrize("text", [
    'The printer set "Lorem ipsum dolor sit amet, consectetur adipiscing elit. Sed do eiusmod tempor." in lead, and the baker laughed.',
    "Typesetters call it lorem ipsum, said the baker. The words of lorem ipsum are old. He had learned lorem ipsum from the miller.",
    "El dolor no cesa, dijo la maestra. Un dolor como ese ya no se olvida. Dolor, dolor y más dolor. Dolor de cabeza, dolor de pie.",
])
def test_mentions_of_filler_are_none_anywhere(before, text):
    assert residue.evidence(STORY * before + text) == []


def test_filler_counts_when_words_are_near_only():
    apart = [STORY * 7 + "\nNosce te ipsum!\n"] * 12
    assert residue.evidence("".join(apart)) == []


def test_late_filler_is_found_in_tables(spark):
    docs = [(1, "a", STORY * 30 + LOREM), (2, "a", STORY * 31), (3, None, LOREM)]
    d = spark.createDataFrame(docs, "doc_id long, source string, text string")
    assert rows(residue.residue(d)) == [(1, "filler"), (3, "filler")]
