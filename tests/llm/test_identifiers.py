import pytest

from slateledger.llm import pii


@pytest.mark.parametrize(
    "text,kind,whole,fragment",
    [
        ("to jоhn@example.com now", "email", "jоhn@example.com", "hn@example.com"),
        ("to john@example.cоm now", "email", "john@example.cоm", "john@example.c"),
        ("to john@mail.example [dot] com now", "email", "john@mail.example [dot] com", "john@mail.example"),
        ("call +44 20 7946 09 five eight one now", "phone", "+44 20 7946 09 five eight one", "+44 20 7946 09"),
    ],
)
def test_whole_identifier_about_a_base_fragment(text, kind, whole, fragment):
    base, added = pii.find(text)
    assert [(k, text[a:b]) for k, a, b in base] == [(kind, fragment)]
    assert [(k, text[a:b]) for k, a, b in added] == [(kind, whole)]


def test_added_spans_within_base_spans_are_left_out():
    base, added = pii.find("a@b.co and é​ +1 (017) 555-7713 and 1.2.3.4 and j​ohn (at) x.org")
    assert [k for k, *_ in base] == ["email", "ip", "phone"] and len(added) == 1


#: Disguised forms with the spans that they must give, worked out by hand.
FORMS = {
    "ip 192 dot 168 dot 1 dot 10 ok": [("ip", 3, 27)], "to j o h n @ e x a m p l e . c o m": [("email", 3, 34)], "write john at example dot com": [("email", 6, 29)],
    "john.doe at example.com": [("email", 0, 23)], "anna (at) example [dot] com": [("email", 0, 27)], "anna @ example point fr": [("email", 0, 23)],
    "+44 20 seven nine four six 0958": [("phone", 0, 31)], "４１１１１１１１１１１１１１１１": [("card", 0, 16)], "10[.]0[.]0[.]7": [("ip", 0, 14)], "a​b@c.de": [("email", 0, 8)],
    "ruf plus vier neun eins zwei drei vier fünf sechs": [("phone", 4, 49)],
}

#: Prose that has the same words and holds nothing.
PROSE = [
    "look at example dot org page", "reach us at punto dot com", "meet me at home dot now", "we arrived at noon. Come on.", "version 2 at 3 dot 5", "call me at home dot com", "sold at 3.50 com", "the point at issue dot dot dot",
    "she works at example.com today", "open at 9.30 in town", "one two buckle my shoe", "at point two dot three", "die Seite at punkt eins", "le point un", "page 3 at example.com", "a b c @ home", "visit our shop at acme dot net", "no one at all",
    "seven of nine at deck one", "10 dot 20", "siehe Punkt 1 dot 2 dot 3", "x @ y", "I am at work. Call.", "plus one or two",
]


def test_forms_by_hand():
    for text, want in FORMS.items():
        base, added = pii.find(text)
        assert [s for s in added if s in want] == want and not [s for s in added if s not in want], (text, base, added)


def test_prose_holds_nothing():
    assert not [t for t in PROSE if any(pii.find(t))]


def test_precision_on_given_documents(spark, sf):
    """Without any planted, added spans must be rare: the tables' texts hold base identifiers only."""
    added = [(t, s) for (t,) in spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet").select("text").collect() for s in pii.find(t)[1]]
    assert len(added) <= 2, [t[a:b] for t, (_, a, b) in added[:5]]
