import pytest
from pyspark.sql import functions as F

from hornbeam.operators.candidates import classify, open_paths, ordered_subsets
from hornbeam.operators.clusters import all_clusters
from hornbeam.operators.facts import property_sizes


def _local(ps):
    return sorted(p.split("#")[1][:-1] for p in ps)


def test_clusters_exact(kg):
    facts, schema = kg
    c = all_clusters(schema, property_sizes(facts).select("property"))
    got = sorted((r.kind, tuple(_local(r.properties))) for r in c.collect())
    did = tuple(sorted(f"did_{t}" for t in ("view", "click", "purchase", "signup", "error")))
    assert got == sorted([
        ("domain_range", did), ("domain", did), ("range", did),
        ("domain_range", ("customerIn", "homeOf", "richCustomerIn")),
        ("domain", ("buysFrom", "customerIn", "hasStatus", "inSegment", "openPriority",
                    "richCustomerIn", "usesPriority")),
        ("range", ("customerIn", "orderFrom", "richCustomerIn", "supplierIn"))])


def test_minhash_equals_exact_without_collisions(kg):
    facts, schema = kg
    wf = property_sizes(facts).select("property")
    ex = {(r.kind, tuple(r.properties)) for r in all_clusters(schema, wf).collect()}
    mh = {(r.kind, tuple(r.properties))
          for r in all_clusters(schema, wf, "minhash", num_features=1 << 18).collect()}
    assert ex == mh


@pytest.mark.parametrize("n", [2, 5, 20])
def test_signatures_equal_the_librarys_pairs(kg, n):
    facts, schema = kg
    wf = property_sizes(facts).select("property")
    flat = lambda m: {(r.kind, tuple(r.properties)) for r in all_clusters(schema, wf, m, num_features=n).collect()}
    pairs = flat("minhash")
    assert flat("signature") == pairs
    exact = {(r.kind, tuple(r.properties)) for r in all_clusters(schema, wf).collect()}
    assert (pairs == exact) == (n == 20)    # fewer slots merge classes


def test_signatures_need_no_pair_table(kg):
    facts, schema = kg
    plan = all_clusters(schema, schema.select("property"), "signature")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftSemi" in plan and "Join Inner" not in plan
    with pytest.raises(ValueError):
        all_clusters(schema, facts.select("property"), "signature", threshold=0.6)


def test_candidates_counts(kg):
    facts, schema = kg
    c = all_clusters(schema, property_sizes(facts).select("property"))
    assert ordered_subsets(c, 3).count() == 300     # distinct across the three kinds
    assert ordered_subsets(c.where("kind = 'domain_range'"), 2).count() == 26


def test_classify_fixture_cases(spark, kg):
    _, schema = kg
    iri = lambda n: f"<http://ex.org/kg#{n}>"
    cases = {
        ("did_view", "did_click", "did_purchase"): ("S1", "M2"),
        ("usesPriority", "openPriority", "inSegment"): ("S2", "M3a"),
        ("usesPriority", "inSegment", "openPriority"): ("S3", "M3c"),
        ("customerIn", "inSegment", "usesPriority"): ("S4_star", "M1"),
        ("customerIn", "supplierIn", "orderFrom"): ("S4_star", "M1"),
        ("customerIn", "buysFrom", "supplierIn"): ("S4_triangle", "M1"),
        ("inSegment", "usesPriority", "openPriority"): ("S5a", "M3b"),
        ("supplierIn", "customerIn", "richCustomerIn"): ("S5b", "M3b"),
        ("customerIn", "inSegment", "supplierIn"): ("S6", "M3d"),
        ("inSegment", "supplierIn", "customerIn"): ("S7", "M3d"),
        ("inSegment", "supplierIn", "did_view"): ("S8", "M3d"),
    }
    rows = [tuple(iri(x) for x in k) for k in cases]
    cand = spark.createDataFrame(rows, "head string, body1 string, body2 string")
    got = {(r.head, r.body1, r.body2): (r.pattern_join, r.pattern_binding)
           for r in classify(cand, schema).collect()}
    for k, v in cases.items():
        assert got[tuple(iri(x) for x in k)] == v, k


def test_open_paths_are_disconnected(kg):
    _, schema = kg
    pats = {r.pattern_join for r in classify(open_paths(schema), schema).collect()}
    assert pats <= {"S6", "S7"} and pats
