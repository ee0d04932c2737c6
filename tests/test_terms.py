from __future__ import annotations

import pytest
from hypothesis import given
from hypothesis import strategies as st

from attestry import terms
from attestry.terms import Term, TermError, bind, read, show


def test_round_trip_and_kinds():
    for t in ("(linked_to a ?x)", '(says b "q \\" ( ;")', "(find (?x ?y) (and (p ?x 1.5) (q ?y service:name)))", "(p (f a b) -2)", "(p)", "atom", "12"):
        assert read(show(read(t))) == read(t)
    assert read("1e5").kind == "atom"
    assert read("4") != read('"4"') != read("a4")
    assert show(read("(p  a ; to the end\n b)")) == "(p a b)"


@pytest.mark.parametrize("text", ["", "()", "(p", "p q", ")", "(p (find (?x) (q ?x)))", "(find (x) (q x))", "(find (?x) (p ?x) (q ?x))", '(p "open)', "(( p) a)"])
def test_what_is_no_term(text):
    with pytest.raises(TermError):
        read(text)


def test_bind_repeats_and_nests():
    assert bind(read("(p ?x ?x)"), read("(p a a)")) == {"x": read("a")}
    assert bind(read("(p ?x ?x)"), read("(p a b)")) is None
    assert bind(read("(p (f ?x) ?y)"), read("(p (f a) (g b))")) == {"x": read("a"), "y": read("(g b)")}
    assert bind(read("(p 4)"), read('(p "4")')) is None


_atoms = st.sampled_from(["a", "b", "x:y", "é"]).map(lambda v: Term("atom", v))
_terms = st.recursive(st.one_of(_atoms, st.integers(-9, 9).map(lambda n: Term("number", float(n))), st.text(max_size=5).map(lambda s: Term("string", s)), st.sampled_from("xyz").map(lambda v: Term("variable", v))),
                      lambda inner: st.lists(inner, max_size=3).map(lambda a: Term("call", "p", tuple(a))), max_leaves=8)


@given(_terms)
def test_print_reads_back(t):
    assert read(show(t)) == t


def test_tags_keep_kinds_apart():
    assert len({terms.tagged(read(t)) for t in ("4", '"4"', "a4", "(f 4)")}) == 4
    for t in ("4", '"4 ("', "a4", "(f 4)"):
        assert terms.untagged(terms.tagged(read(t))) == read(t)
