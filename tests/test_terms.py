"""Parser and term algebra."""

import pytest

from designmat.errors import FormulaSyntaxError, UnboundTermError, near_names
from designmat.plans.parser import formula
from designmat.plans.terms import (
    Call, Const, Formula, Interaction, Intercept, Sum, Var, call, degree, drop_term, formula_of, has_intercept, has_response, interact,
    lag, leaves, omits_intercept, plus, star, term, term_names,
)

a, b, c, d = map(Var, "abcd")
AB = Interaction((a, b))


def rhs(text):
    return formula(f"y ~ {text}").rhs


@pytest.mark.parametrize("text,want", [
    ("a", a), ("a + b", Sum((a, b))), ("a + b + a", Sum((a, b))), ("a & b", AB), ("a*b", Sum((a, b, AB))), ("b*a", Sum((b, a, Interaction((b, a))))),
    ("a & b + a", Sum((a, AB))), ("a + b & c", Sum((a, Interaction((b, c))))), ("(a + b) & c", Sum((Interaction((a, c)), Interaction((b, c))))),
    ("(a + b) & (c + d)", Sum(tuple(Interaction(x) for x in ((a, c), (a, d), (b, c), (b, d))))), ("a & b * c", Sum((c, AB, Interaction((a, b, c))))),
    ("a & 1", a), ("1 & a", a), ("0 + a", Sum((Const(0), a))), ("-1 + a", Sum((Const(-1), a))), ("a + 1", Sum((Const(1), a))), ("a & a", a),
    ("+a", a), ("&(a)", a), ("a*b*c", Sum((a, b, c, AB, Interaction((a, c)), Interaction((b, c)), Interaction((a, b, c))))), ("`odd name` + a", Sum((Var("odd name"), a))),
])
def test_parse(text, want):
    assert rhs(text) == want


@pytest.mark.parametrize("text,name", [
    ("log(x1)", "log(x1)"), ("1 | x", "1 | x"), ("1 + x|g", "(1 + x) | g"), ("(1 + x) | g", "(1 + x) | g"), ("x - 1", "x - 1"), ("a + b - 1", "(a + b) - 1"), ("log(a+b*c)", "log(a + b * c)"),
    ("f((a+b)*c, 2)", "f((a + b) * c, 2)"), ("a^2", "a ^ 2"), ("a/(b/c)", "a / (b / c)"), ("a/b/c", "(a / b) / c"), ("protect(-a)", "protect(-a)"),
])
@pytest.mark.filterwarnings("ignore")
def test_calls_keep_their_text(text, name):
    t = rhs(text)
    assert isinstance(t, Call) and t.names() == [name]


def test_minus_warns():
    with pytest.warns(UserWarning, match="minus"):
        rhs("a - 1")


@pytest.mark.parametrize("text", ["a + b", "y ~ a ~ b", "~ a", "y ~", "y ~ $a", "y ~ a[1]", "y ~ (a", "y ~ a b", "y => a", "y ~ f(a", "log(y ~ a)", ""])
def test_syntax_errors(text):
    with pytest.raises(FormulaSyntaxError):
        formula(text)


def test_algebra():
    assert plus(a, plus(b, a)) == Sum((a, b)) == a + b and sum([a, b]) == a + b
    assert (a & b) & c == a & (b & c) == Interaction((a, b, c)) and interact(a, Const(1)) == a
    assert (b & a) != (a & b) and Sum((a & b, b & a)) == plus(a & b, b & a)
    with pytest.raises(ValueError):
        interact(a, Const(2))
    assert star(a, b) == a * b == a + b + (a & b)
    assert formula_of("y", (a & b) + a) == formula("y ~ a + a&b") == Var("y").tilde((a & b) + a)
    assert degree(rhs("1 + x | g")) == float("inf") and term(3) == Const(3)
    with pytest.raises(TypeError):
        term(None)


def test_questions():
    f = formula("y ~ 1 + a*b")
    assert f.vars() == ["y", "a", "b"] and leaves(f) == [Var("y"), Const(1), a, b]
    assert has_intercept(f) and not omits_intercept(f) and has_response(f)
    assert omits_intercept(formula("0 ~ 0 + a")) and omits_intercept(formula("y ~ -1 + a")) and not has_response(formula("0 ~ a"))
    assert drop_term(f, a).rhs == Sum((Const(1), b, a & b)) and drop_term(a & b, a) == b and drop_term(a, a) == Const(1) and drop_term(f, d) == f
    assert term_names(f) == ("y", ["(Intercept)", "a", "b", "a & b"]) and term_names(Intercept(False)) == []
    assert call("log", "y") == rhs("log(y)") and str(lag(a, 2)) == "lag(a, 2)" and str(f) == "y ~ 1 + a + b + a & b"
    with pytest.raises(UnboundTermError):
        a.width()
    assert isinstance(formula("nothing ~ a"), Formula) and formula("nothing ~ a").lhs is None


def test_near_names():
    assert near_names("aa", ["yyy", "aaa", "bbb"]) == ["aaa"] and near_names("aab", ["yyy", "aaa", "bbb"]) == ["aaa", "bbb"]
