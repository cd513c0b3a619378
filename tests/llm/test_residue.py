import pytest

from arcspan.llm.residue import REPEATED, candidates, framed, judge, masked, messages, residue, triggers

BAD = [
    "The ${trench_number} was sealed by sand.", "County = <%= site_name %>", "Titel: {{ koordinaten }}", "Date - [[date]]", "Summary: &lt;summary&gt;", "Author: [add author]", "it is (your county here) wide", "x %(date)s y", "a %%SITE_NAME%% b", "@@MainFinds@@", "#COUNTY#", "$COUNTY$", "__period__", "«project code»", "{title}",
    "Lorem ipsum dolor sit amet.", "Nostrud enim labore dolor quis.", "xxxxx xxxx xxxxxxx", "test test test", "foo bar baz foo bar", "Text goes here.", "Hier steht später der Beschreibungstext.", "Overwrite this block before the page goes live.",
    "Please enable JavaScript to view this page.", "JavaScript is required.", "Pour lire la fiche, débloquez les scripts pour ce site.", "Per vedere la mappa, consentire JavaScript nel browser.", "Um die Karte zu sehen: erlauben Sie Skripte und laden Sie neu.", "Your browser is not supported.", "Before you continue, allow active content first.",
    "Error 404 - page not found", "HTTP 404 - The record is not available at this address.", "[ERR_91] La ficha no se pudo cargar.", "500: Diese Seite antwortet nicht.", "ACCESS DENIED.", "This page ran into a problem.", "La scheda non risponde.", "Cette page n'a pas pu être chargée.", "Traceback (most recent call last): File 'x'", "502 Bad Gateway", "Your session has expired.",
]
GOOD = [
    "The placeholder theory of these cairns holds that they mark plots.", "A script is required before this tablet can be read at all.", "Visitors saw the words 'page not found' for weeks in 2011.", "Trench 404 was not found again when the grid was relaid.", "Context [404] and context [500] were both recorded as internal errors of the wall builders.",
    "Cookies of unleavened dough were the only food remains.", "Please enable the reader to compare the two plans.", "Each field name stands between double braces, for example {{trench}}, and is replaced.", "The inscription reads {d}is ma[---] vot(um) [s]olv<i>t.", "Sets {1, 2, 3} and {2, 4} overlap.", "Sample <12> and sample <lost> were merged.",
    "The web map was rewritten in JavaScript in 2016 and draws 567 points.", "The site is temporarily unavailable to visitors while the roof is renewed.", "Access was forbidden, and the survey had to stop.", "La page 404 du registre est introuvable depuis 1977.", "Die Seite des Fundbuchs fehlt, sie wurde nicht gefunden.", "La scheda 404 non è stata trovata nell'archivio.", "Squares marked XXX on the plan were not dug.", "Two dummy variables were added to the model.", "Nulla collega Toa a Wimick.", "",
]


@pytest.mark.parametrize("text", BAD)
def test_bad(text):
    m = masked(text).strip()
    assert judge(m) is not None
    assert REPEATED.search(m) or next(triggers().iter(m), None) is not None


@pytest.mark.parametrize("text", GOOD)
def test_good(text):
    assert judge(masked(text).strip()) is None


@pytest.mark.parametrize("text", ["Ici viendra le résumé.", "[ insert title ]", "test, test, test", "bla, bla, bla", "Before you continue, enable JS.", "Error 403 Forbidden"])
def test_every_match_holds_a_literal(text):
    m = masked(text).strip()
    assert judge(m) is not None and next(triggers().iter(m), None) is not None


def test_groups_of_like_notices():
    assert framed("enable javascript") == framed("unblock cookies") == framed("turn on active content")
    assert framed("la ficha no responde") == framed("el mapa no responde") != framed("la mappa non risponde")
    assert judge("access denied.") == ("error", None)
    kind, group = judge("the old keeper wrote access denied on the door of the barn")
    assert kind == "error" and group is not None


def test_documents(spark):
    ordinary = "The layer is 3 m thick."
    rows = [(1, f"{ordinary}\nError 404: page not found", "a", 0), (2, ordinary, "a", 0), (3, None, "a", 0), (4, "   ", None, 0), (None, "Access denied.", None, 0), (1, "Access denied.", "b", 0), (5, ordinary * 3000 + " Access denied.", "b", 0), (6, "!", "a", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, h int")
    assert {r[0] for r in residue(df).select("doc_id").collect()} == {1, None, 5}
    assert residue(df).count() == 3
    assert residue(df.limit(0)).count() == 0


def groups(spark):
    notice = "Site record {} to see the map, turn on scripts and reload."
    lone = "Catalogue: to use this viewer, activate cookies first, says the note."
    rows = [(k, notice.format(k), "ab"[k % 2]) for k in range(3)] + [(10, "He said the database did not respond to his letter of May.", "a")]
    rows += [(100 + k, f"Access denied.\nThe keeper has been told of it.\nPart {k}.", "ab"[k % 2]) for k in range(24)] + [(40, "The keeper has been told of it.", "a")]
    rows += [(50 + k, "Drawn at a scale of 1:20.", "ab"[k % 2]) for k in range(20)]
    return spark.createDataFrame(rows + [(70, lone, "a")], "doc_id long, text string, source string")


def test_what_recurs_decides(spark):
    """Without groups the notices inside longer messages and the companion would not be found; lone wordings are not."""
    df = groups(spark)
    found = {r[0] for r in residue(df).select("doc_id").collect()}
    sure = {100 + k for k in range(24)}
    assert found == sure | {0, 1, 2, 40, 70}
    assert {r[0] for r in residue(df, min_docs=10**9).select("doc_id").collect()} == sure
    without_rule = {r[0] for r in residue(df, min_docs=1, min_sources=1).select("doc_id").collect()}
    assert without_rule == found | {10}
    kinds = {r["message"]: (r["kind"], r["docs"], r["sources"]) for r in messages(candidates(df, "doc_id", "text", "source", True)).collect()}
    assert kinds["the keeper has been told of it."] == ("companion", 25, 2)
    assert not any("scale" in m for m in kinds)
