"""Axioms of tables told apart by columns, on tables with repeats, nulls and words that become one."""

import duckdb
import pytest

from ontolake.model import AXIOM_KINDS
from ontolake.plans import catalog
from ontolake.plans.projection import Branch, Store, chosen, _e, _f, _id, _word
from ontolake.plans.unique import apart, can_hold, decided, pattern

from test_catalog import SF, TABLES, rows

NAMES = ("axioms_direct", "closure_union_distinct", "merge_logical_only", "axioms_without_annotations", "duplicate_axioms", "axiom_difference", "locality_vectors", "structural_traversal")
ODD = {
    "nation": "SELECT * FROM t UNION ALL SELECT * FROM t WHERE n_nationkey < 3 UNION ALL SELECT 77, 'X', NULL UNION ALL SELECT NULL, 'Y', 1",
    "customer": "SELECT * FROM t UNION ALL SELECT * FROM t WHERE c_custkey < 9 UNION ALL SELECT NULL, 'n', 3, 1.0, 'A B' UNION ALL SELECT 5, 'n', NULL, NULL, 'A_B' UNION ALL SELECT 5, 'n', 4, 2.001, 'A B' UNION ALL SELECT 5, 'n', 4, 2.0, 'a>) NamedIndividual(<urn:ex:Customer>) @schema'",
    "part": "SELECT * FROM t UNION ALL SELECT 3, 'p', 'A#B', 'A_:x@schema', 1, 1.0 UNION ALL SELECT 3, 'p', 'A-B', 'A_:x@copy', 1, 1.001 UNION ALL SELECT 3, 'p', NULL, NULL, 1, 1.0",
    "lineitem": "SELECT * FROM t UNION ALL SELECT * FROM t WHERE l_orderkey < 50 UNION ALL SELECT * REPLACE (NULL AS l_partkey) FROM t WHERE l_orderkey < 9 UNION ALL SELECT * REPLACE (NULL AS l_orderkey) FROM t WHERE l_orderkey < 9",
    "orders": "SELECT * FROM t UNION ALL SELECT * FROM t WHERE o_orderkey < 50 UNION ALL SELECT * REPLACE (NULL AS o_custkey) FROM t WHERE o_orderkey < 9 UNION ALL SELECT * REPLACE (NULL AS o_orderkey) FROM t WHERE o_orderkey < 9",
    "documents": "SELECT * FROM t UNION ALL SELECT * FROM t WHERE doc_id < 9 UNION ALL SELECT * REPLACE ('a\"@en <urn:ex:Party> \\' AS text) FROM t WHERE doc_id < 3",
}


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    folder, con = tmp_path_factory.mktemp("odd"), duckdb.connect()
    for t in TABLES:
        con.execute(f"COPY (WITH t AS (SELECT * FROM '{SF}/{t}.parquet') {ODD.get(t, 'SELECT * FROM t')}) TO '{folder}/{t}.parquet'")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return str(folder), con


@pytest.mark.parametrize("name", NAMES)
def test_odd_tables(spark, odd, name):
    folder, con = odd
    assert rows(catalog.QUERIES[name](spark, folder).toPandas()) == rows(con.execute(catalog.ORACLES[name]).df())


def test_no_key_is_exchanged(spark):
    s = Store(spark, SF)
    for across in (False, True):
        found, rest = s.unique_parts(AXIOM_KINDS, across=across)
        assert [x.branch for x in found] == chosen(AXIOM_KINDS, None)
    sales = [t for x in found if x.branch.ont == "sales" and x.branch.keyword == "ObjectPropertyAssertion" for _, t in x.rows.dtypes]
    assert set(sales) == {"bigint"}
    plan = catalog.QUERIES["closure_union_distinct"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [l_orderkey" in plan or "Aggregate [b0" in plan


def test_what_fixed_texts_tell():
    whole = lambda e: e != "word"
    branch = lambda ind, cls: pattern(Branch("x", "ClassAssertion", "t", (_f("classExpression", "Class", cls), _f("individual", "NamedIndividual", ind))), whole)
    a, b = branch(_id("a", "i"), _id("n", "j")), branch(_id("b", "i"), _id("n", "j"))
    free, other = branch(_id("a", "i"), _word("n", "word")), branch(_id("a", "i"), _word("m", "word"))
    assert apart(a, b) and not apart(a, a) and not apart(a, free) and apart(free, other)
    assert decided(a) and decided(free) and not decided(branch(_word("a", "word"), _word("n", "word")))
    assert not decided(branch("'urn:ex:' || CAST(i AS VARCHAR(20)) || CAST(j AS VARCHAR(20))", _id("n", "j")))
    assert not can_hold(a, "<urn:ex:Customer>") and can_hold(free, "<urn:ex:Customer>") and can_hold(a, "<urn:ex:n/12>)") and not can_hold(a, "<urn:ex:n/x>")
    assert _e("Class", "'x'")[1] == "OWLClass"


def test_display_order_exchanges_axioms_once(spark, odd, monkeypatch):
    from ontolake.operators import changes

    folder, con = odd
    axioms = lambda: Store(spark, folder).axioms(AXIOM_KINDS, ["geo", "trade", "text", "schema"])
    want = [r for r in rows(con.execute(catalog.ORACLES["display_order"]).df()) if r[1] in ("", "geo", "trade", "text", "schema")]
    assert any(r[0] == "" for r in want)  # a null key, which comes last
    for size in (changes.RANGE_BYTES, 1000):  # as many ranges as the session's partitions, and more
        monkeypatch.setattr(changes, "RANGE_BYTES", size)
        have = changes.display_order(axioms())
        assert rows(have.toPandas()) == want
        plan = have._jdf.queryExecution().executedPlan().toString()
        # What is exchanged after the store are counts.
        assert not [x for x in plan.splitlines() if "Exchange hashpartitioning(part" in x]
