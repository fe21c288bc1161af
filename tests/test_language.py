"""Lexer, parser and durations."""

import pytest
from hypothesis import given
from hypothesis import strategies as st

from flowspark.errors import ParseError
from flowspark.lang import ast as A
from flowspark.lang.durations import format_duration, is_duration, parse_duration
from flowspark.lang.parser import parse_expression, parse_pipeline, parse_program


def test_precedence():
    e = parse_expression("a || b && c == 1 + 2 * -3 ? x : y")
    assert isinstance(e, A.Choice) and e.test.op == "||" and e.test.right.op == "&&"
    assert e.test.right.right == A.Binary("==", A.Name("c"), A.Binary("+", A.Lit(1), A.Binary("*", A.Lit(2), A.Lit(-3))))
    assert parse_expression("a - b + c") == A.Binary("+", A.Binary("-", A.Name("a"), A.Name("b")), A.Name("c"))


def test_paths_calls_and_literals():
    assert parse_expression("a.b[0].c") == A.Field(A.Index(A.Field(A.Name("a"), "b"), A.Lit(0)), "c")
    assert parse_expression("f(1, g())") == A.Call("f", (A.Lit(1), A.Call("g", ())))
    assert parse_expression("iff(a, 1, 2)") == parse_expression("a ? 1 : 2")
    assert parse_expression("5m") == A.Lit(300) and parse_expression("250ms") == A.Lit(0.25)
    assert parse_expression(r"'it\'s' + \"\n\"".replace('\\"', '"')) == A.Binary("+", A.Lit("it's"), A.Lit("\n"))
    assert parse_expression("trueish") == A.Name("trueish") and parse_expression("TRUE") == A.Lit(True)
    assert parse_expression("[1, {a: 2, ...b, -c}]").items[1].items == (A.Prop("a", A.Lit(2)), A.Spread(A.Name("b")), A.Exclude("c"))
    assert parse_expression("x is not null and y not in (1, 2)") == A.Binary("&&", A.IsNull(A.Name("x"), True), A.InList(A.Name("y"), (A.Lit(1), A.Lit(2)), True))


def test_words_are_names_where_no_keyword_can_stand():
    p = parse_pipeline("list | select { by: group, over, step: emit.on }")
    assert p.source == "list" and [i.key for i in p.ops[0].items] == ["by", "over", "step"]
    assert parse_program("flush | where x")[0].kind == "query"


def test_statements():
    kinds = [(s.kind, s.mode) for s in parse_program("""
        // streams
        create stream a; create or replace stream a; create if not exists stream a;
        CREATE FLOW f TTL(2m) AS a | where x > 1 | insert_into(b); create or replace lookup l = [1, {x: null}];
        insert into a {x: 1}; flush a; list flows; info a; info; subscribe a; unsubscribe 3; delete flow f; delete stream a; delete lookup l;
        a | where x
    """)]  # fmt: skip
    assert kinds == [
        ("create_stream", ""), ("create_stream", "replace"), ("create_stream", "if_not_exists"), ("create_flow", ""), ("create_lookup", "replace"), ("insert", ""), ("flush", ""),
        ("list", ""), ("info", ""), ("info", ""), ("subscribe", ""), ("unsubscribe", ""), ("delete_flow", ""), ("delete_stream", ""), ("delete_lookup", ""), ("query", ""),
    ]


def test_summarize_clauses_in_any_order():
    a = parse_pipeline("s | summarize { n: count() } by k over w = tumbling_window(2)").ops[0]
    assert a == parse_pipeline("s | summarize { n: count() } over w = tumbling_window(2) by k").ops[0]
    assert parse_pipeline("s | summarize { n: count() } over session_window(1h, t)").ops[0].window.name == "window"
    assert parse_pipeline("s | summarize { n: count() } emit every 10 using t").ops[0].emit == A.EmitSpec("every", A.Lit(10), A.Name("t"))
    with pytest.raises(ParseError):
        parse_pipeline("s | summarize { n: count() } over w = tumbling_window(2) emit every 2")


def test_scan_steps():
    op = parse_pipeline("s | scan(step a: x > 1 => a.n = 1, y = 2; step b: true => emit({ n: b.n }), b.n = 3;)").ops[0]
    assert [s.name for s in op.steps] == ["a", "b"] and op.steps[0].assigns[1] == A.Assign(None, "y", A.Lit(2)) and op.steps[1].emit
    assert parse_pipeline("s | scan by u.id, k (step a: true => emit({x: 1}), step b: true => b.n = 1)").ops[0].by == (A.Field(A.Name("u"), "id"), A.Name("k"))


@pytest.mark.parametrize("bad", ["s | where", "s | select { a: }", "s | nothing x", "create stream", "s | where a @ b", "insert into a x +", "s | select { 1 }", 's | where "open', "create flow f as"])
def test_errors_have_places(bad):
    with pytest.raises(ParseError) as e:
        parse_program(bad)
    assert 0 <= e.value.at <= len(bad)


@given(st.text(max_size=60))
def test_any_text_parses_or_fails_cleanly(text):
    try:
        parse_program(text)
    except ParseError:
        pass


def test_durations():
    assert parse_duration("1w3d") == 10 * 86400 and parse_duration("1h30m") == 5400 and parse_duration("5ms") == 0.005 and parse_duration('"2m"') == 120
    assert not is_duration("1h1h") and not is_duration("x") and not is_duration("5")
    assert format_duration(90061.5) == "1d1h1m1s500ms" and format_duration(0) == "0s"


@given(st.integers(0, 10**9))
def test_durations_round_trip(n):
    assert parse_duration(format_duration(n)) == n
