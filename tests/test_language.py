from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from engram.operators import history
from engram.operators.traverse import walk
from engram.plans.compile import run
from engram.plans.language import Query, QueryError, parse
from engram.plans.store_view import StoreView


def test_parse():
    q = parse('FIND(?c.name, ?c.attributes["a b"]) WHERE { ?c CONCEPT {type: :t, name: ["x", "y"]} NOT { ?p PROPOSITION (?c, "a"|"b"{1,3}, ?o) } FILTER(!(?c.version > -1 && IN(?c.name, ["q"]))) } AS OF SEQ 4 ORDER BY ?c.name DESC LIMIT 5 CURSOR 2', {"t": "Person"})
    assert q.as_of == ("SEQ", 4) and q.limit == 5 and q.cursor == 2 and q.where[0].matcher[0] == ("type", "Person") and q.order[0][1]
    assert q.where[1].clauses[0].predicate.high == 3


@settings(max_examples=200, deadline=None)
@given(st.one_of(st.text(max_size=80), st.lists(st.sampled_from(["FIND", "(", ")", "{", "}", "WHERE", "?x", "CONCEPT", '"s"', "NOT", "FILTER", "==", "1", ",", ":p", "BELIEF", "{1,2}"]), max_size=25).map(" ".join)))
def test_any_text_parses_or_is_refused(text):
    try:
        assert isinstance(parse(text), Query)
    except QueryError:
        pass


@pytest.mark.parametrize(
    "text,code",
    [
        ("FIND(?b) WHERE { ?b BELIEF (?nothing) }", "ProjectionTargetUnbound"),
        ('FIND(?s) WHERE { ?s BELIEF SLOT (?x, "p") }', "ProjectionTargetUnbounded"),
        ('FIND(?b) WHERE { ?p PROPOSITION (?s, "p", ?o) ?b BELIEF (?p) } WITH EPISTEMIC {policy: "strict"}', "ProjectionPolicyUnavailable"),
        ("FIND(COUNT(?c), ?c.name) WHERE { ?c CONCEPT {} }", "Unsupported"),
        ("FIND(?c) WHERE { ?c CONCEPT {} } ORDER BY COUNT(?c)", "Unsupported"),
        ('FIND(?c) WHERE { ?c CONCEPT {} FILTER(REGEX(?c.name, "(?=a)")) }', "Unsupported"),
        ("FIND(?c) WHERE { ?c CONCEPT {} NOT { ?d CONCEPT {} FILTER(?c.name == ?d.name) } }", "VariableUnbound"),
        ('FIND(?s) WHERE { PROPOSITION (?s, "p"{0,2}, ?o) }', "ProjectionTargetUnbound"),
        ('FIND(?c) WHERE { ?c CONCEPT {} } AS OF TX "none"', "TransactionUnknown"),
        ("FIND(?c) WHERE { ?c CONCEPT {name: :missing} }", "ParameterMissing"),
    ],
)
def test_refusals(spark, sf, text, code):
    with pytest.raises(QueryError) as e:
        run(StoreView(spark, sf), text)
    assert e.value.code == code


def test_null_agrees_with_anything(spark, sf):
    view = StoreView(spark, sf)
    rows = run(view, 'FIND(?c.id, ?o, ?t.id) WHERE { ?c CONCEPT {type: "Agent"} OPTIONAL { ?p PROPOSITION (?c, "no_such", ?o) } ?q PROPOSITION (?t, ?k, ?o) ?t CONCEPT {} }').collect()
    every = run(view, "FIND(?q.id) WHERE { ?q PROPOSITION (?t, ?k, ?o) ?t CONCEPT {} }").count()
    assert len(rows) == every and all(r.o is None for r in rows)


def test_walks(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "lit"), (None, "a"), ("a", "b"), ("z", "z")]
    df = spark.createDataFrame(edges, "src string, dst string")
    start = spark.createDataFrame([("a",)], "start string")
    got = lambda low, high: {(r.end, r.depth) for r in walk(df, start, low, high).collect()}
    assert got(1, 2) == {("b", 1), ("c", 2)}
    assert got(0, None) == {("a", 0), ("b", 1), ("c", 2), ("d", 3), ("lit", 4)}
    assert got(2, 3) == {("c", 2), ("d", 3)}
    assert walk(df.limit(0), None, 1, None).collect() == []


def test_history_errors(spark):
    journal = spark.createDataFrame([("s", "t1", 1)], "space string, tx_id string, seq long")
    assert history.snapshot(journal, "s", 1) == "s:1" and history.seq_of_tx(journal, "t1") == ("s", 1)
    with pytest.raises(history.HistoryError):
        history.snapshot(journal, "s", 9)
