import random

import pytest
from pyspark.sql import functions as F

from hornbeam.operators import facts as fx
from hornbeam.operators.schema import property_schema, schema_report
from hornbeam.plans import queries
from hornbeam.plans.mine import mine, score
from hornbeam.sources import axioms as ax
from hornbeam.sources import store
from hornbeam.sources.kg_tables import knowledge_graph

# FIXTURES.md section 2
AXIOM_TEXT = """ObjectPropertyDomain(<http://ex.org/kg#worksAt> <http://ex.org/kg#Person>)
ObjectPropertyRange(<http://ex.org/kg#worksAt> <http://ex.org/kg#Company>)
ObjectPropertyDomain(<http://ex.org/kg#knows> <http://ex.org/kg#Person>)
ObjectPropertyRange(<http://ex.org/kg#knows> <http://ex.org/kg#Person>)
ObjectPropertyDomain(<http://ex.org/kg#owns> <http://ex.org/kg#Person>)
ObjectPropertyRange(<http://ex.org/kg#owns> ObjectUnionOf(<http://ex.org/kg#Car> <http://ex.org/kg#House>))
ObjectPropertyAssertion(<http://ex.org/kg#worksAt> <http://ex.org/kg#ann> <http://ex.org/kg#acme>)
ObjectPropertyAssertion(<http://ex.org/kg#worksAt> <http://ex.org/kg#ann> <http://ex.org/kg#acme>)
Declaration(Class(<http://ex.org/kg#Person>))
"""


@pytest.fixture(scope="module")
def axiom_file(tmp_path_factory):
    p = tmp_path_factory.mktemp("ax") / "tiny.owl"
    p.write_text(AXIOM_TEXT)
    return str(p)


def test_fixture_ontology(spark, axiom_file):
    axioms = ax.read_axioms(spark, axiom_file, "functional")
    kinds = {r.axiom_type: r.n for r in axioms.groupBy("axiom_type").agg(F.count("*").alias("n")).collect()}
    assert kinds == {"ObjectPropertyDomain": 3, "ObjectPropertyRange": 3,
                     "ObjectPropertyAssertion": 2, "Declaration": 1}
    sch = property_schema(ax.domains(axioms), ax.ranges(axioms)).collect()
    assert [(r.name, r.dom, r.ran) for r in sch] == [
        ("worksAt", "<http://ex.org/kg#Person>", "<http://ex.org/kg#Company>")]
    rep = {r.name: r.reason for r in schema_report(ax.domains(axioms), ax.ranges(axioms)).collect()}
    assert rep == {"worksAt": None, "knows": "class_count", "owns": "union"}
    facts = ax.assertions(axioms)
    assert fx.property_sizes(facts).collect()[0].n == 2          # bag size
    assert fx.triple_sets(facts).count() == 1                      # set
    assert ax.dataset_name(axiom_file) == "tiny"


@pytest.mark.parametrize("syntax", ["manch", "owl_xml", "turtle"])
def test_unsupported_syntax(spark, axiom_file, syntax):
    with pytest.raises(ValueError):
        ax.read_axioms(spark, axiom_file, syntax)


def test_render_parse_roundtrip(spark, kg):
    facts, _ = kg
    from hornbeam.sources.kg_tables import declarations_from_tables
    lines = ax.render_axioms(facts, declarations_from_tables(spark))
    back = ax.assertions(ax.parse_axioms(lines))
    assert back.count() == facts.count()
    local = back.select("property", F.regexp_extract("subject", "#([^>]*)", 1).alias("subject"),
                        F.regexp_extract("object", "#([^>]*)", 1).alias("object"))
    assert local.exceptAll(facts).count() == 0


def test_store_roundtrip_and_pruning(spark, kg):
    facts, _ = kg
    path = store.store_path(spark, "test-facts", unique=True)
    back = store.materialize(facts, path, mode="ignore")
    assert back.count() == facts.count()
    one = store.read_facts(spark, path, ["<http://ex.org/kg#customerIn>"])
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan
    assert one.count() == facts.where(F.col("property") == "<http://ex.org/kg#customerIn>").count()
    # ignore mode keeps the existing store
    again = store.materialize(facts.limit(1), path, mode="ignore")
    assert again.count() == facts.count()


LINES = ["Prefix(:=<http://e#>)", "Prefix(ex:=<http://x/>)", "ObjectPropertyAssertion(<a#p> <a#s> <a#o>)", "ObjectPropertyAssertion(<a#p> _:g1 <a#o>)",
         "ObjectPropertyAssertion(:p :a ex:b)", 'ObjectPropertyAssertion(Annotation(rdfs:comment "x") :p :a :b)', "ObjectPropertyAssertion(zz:p :a :b)",
         "ObjectPropertyDomain(:p ObjectIntersectionOf(:A :B))", "ObjectPropertyDomain(:p :A)", "ObjectPropertyRange(:p ObjectUnionOf(:A :B))",
         "Declaration(Class(:A))", "junk", "", "ObjectPropertyAssertion(:p :a)", "ObjectPropertyDomain(:p _:x)"]


def test_no_line_becomes_an_empty_fact(spark):
    axioms = ax.parse_axioms(spark.createDataFrame([(x,) for x in LINES], "value string"))
    assert axioms.count() == len(LINES) - 1  # without the blank line
    assert {tuple(r) for r in ax.assertions(axioms).collect()} == {
        ("<a#p>", "<a#s>", "<a#o>"), ("<a#p>", "_:g1", "<a#o>"), ("<http://e#p>", "<http://e#a>", "<http://x/b>")}
    assert {tuple(r) for r in ax.declarations(axioms).collect()} == {
        (ax.DOMAIN, "<http://e#p>", "<http://e#A>"), (ax.RANGE, "<http://e#p>", "ObjectUnionOf(:A :B)")}
    n = {r.axiom_type: r["count"] for r in axioms.groupBy("axiom_type").count().collect()}
    assert (n["MalformedObjectPropertyAssertion"], n["MalformedObjectPropertyDomain"], n["Other"], n["Declaration"]) == (3, 2, 1, 1)
    assert {(r.axiom_type, r.n) for r in ax.malformed(axioms).collect()} == {("MalformedObjectPropertyAssertion", 3), ("MalformedObjectPropertyDomain", 2)}


def test_an_unfinished_store_is_written_again(spark, kg, tmp_path):
    import os
    facts, _ = kg
    path = str(tmp_path / "store")
    n = store.materialize(facts, path).count()
    assert store.is_complete(spark, path) and store.materialize(facts.limit(0), path).count() == n
    os.remove(f"{path}/_SUCCESS")
    assert store.materialize(facts.limit(5), path).count() == 5


def test_a_store_of_other_content_is_refused(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = [("p", "a", "b"), ("p", "a", "b"), ("q", "c", None), ("r", "", "d"), (None, "a", "b")]
    make = lambda x: spark.createDataFrame(x, "property string, subject string, object string")
    n = store.materialize(make(rows), path, mode="reuse").count()
    assert n == 5 and store.materialize(make(rows[::-1]), path, mode="reuse").count() == 5   # order does not matter
    sizes = store.stored_sizes(spark, path)
    assert {r.property: r.n for r in sizes.collect()} == {"p": 2, "q": 1, "r": 1, None: 1}
    for other in (rows[1:], [*rows, ("s", "x", "y")], rows[:2], [*rows[:2], ("q", "c", ""), *rows[3:]], [*rows[:2], ("q", None, "c"), *rows[3:]]):
        with pytest.raises(store.StoreMismatch):
            store.materialize(make(other), path, mode="reuse")
    empty = str(tmp_path / "empty")
    assert store.materialize(make([]), empty, mode="reuse").count() == 0 and store.differences(make([]), empty).isEmpty()
    with pytest.raises(store.StoreMismatch):
        store.materialize(make(rows), empty, mode="reuse")


def test_stored_graph_prunes_before_it_caches(spark, kg):
    from hornbeam.operators.facts import property_sizes
    from hornbeam.plans.queries import stored_graph
    facts, schema = kg
    path = store.store_path(spark, "test-graph", unique=True)
    some = schema.where("name IN ('customerIn', 'homeOf')")
    kept, sizes = stored_graph(spark, facts, some, path)
    assert kept.select("property").distinct().count() == 2
    plan = kept._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters:")[1].splitlines()[0]
    assert "InMemoryRelation" in plan and "customerIn" in filters and "homeOf" in filters
    assert sorted(sizes.collect()) == sorted(property_sizes(facts).select("property", "n").collect())
    kept.unpersist()


def test_candidates_exchange_between_atoms(spark):
    from hornbeam.operators.candidates import ordered_subsets
    c = spark.createDataFrame([("domain", "k", [f"p{i}" for i in range(9)])], "kind string, cluster_id string, properties array<string>")
    out = ordered_subsets(c, 3)
    assert out.count() == 9 * 8 * 7
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 2  # ranges of rules, which adaptive execution does not merge


def test_prefixes_hold_for_their_own_file(spark, tmp_path):
    """Two files that declare ``:`` differently, with statements over several lines."""
    (tmp_path / "a.owl").write_text("Prefix(:=<http://a#>)\nOntology(<http://a>\nObjectPropertyAssertion(:p :s\n   :o)\n"
                                    "ObjectPropertyAssertion(\n\n:p\n<http://x/f(1> :o2\n)\nObjectPropertyRange(:p\nObjectUnionOf(:A :B)\n)\n)\n")
    (tmp_path / "b.owl").write_text("Prefix(:=<http://b#>)\nObjectPropertyAssertion(:p :s :o)\nObjectPropertyAssertion(:p :s\n"
                                    "ObjectPropertyAssertion(:q :s :o)\n:o)\nObjectPropertyAssertion(:p ex:s :o)\nObjectPropertyAssertion(:p :s :o")
    axioms = ax.read_axioms(spark, str(tmp_path), "functional")
    assert {tuple(r) for r in ax.assertions(axioms).collect()} == {
        ("<http://a#p>", "<http://a#s>", "<http://a#o>"), ("<http://a#p>", "<http://x/f(1>", "<http://a#o2>"),
        ("<http://b#p>", "<http://b#s>", "<http://b#o>"), ("<http://b#q>", "<http://b#s>", "<http://b#o>")}
    assert [tuple(r) for r in ax.declarations(axioms).collect()] == [(ax.RANGE, "<http://a#p>", "ObjectUnionOf(:A :B)")]
    assert [(r.file.split("/")[-1], r.axiom_type, r.n) for r in ax.malformed(axioms).collect()] == [("b.owl", "MalformedObjectPropertyAssertion", 3)]


def test_statements_across_splits(spark, tmp_path):
    """Splits of a few bytes cut statements at any line; none is lost or made up."""
    text = "Prefix(:=<http://a#>)\n" + "".join(
        f"ObjectPropertyAssertion(:p\n :s{i}\n :o{i} )\n" if i % 3 else f"ObjectPropertyAssertion(:p :s{i} :o{i})\n" for i in range(60))
    (tmp_path / "a.owl").write_text(text)
    prev = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("100b", "177b", "1000b"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            axioms = ax.read_axioms(spark, str(tmp_path), "functional")
            got = {(r.subject, r.object) for r in ax.assertions(axioms).collect()}
            assert got == {(f"<http://a#s{i}>", f"<http://a#o{i}>") for i in range(60)} and ax.malformed(axioms).count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", prev)


@pytest.mark.parametrize("batch", [1, 3, 10_000])
def test_broken_statements_are_joined_where_they_are_read(spark, tmp_path, batch):
    """Runs of lines meet in their task, whatever the batches and splits; no line is exchanged, only joined runs are."""
    rnd = random.Random(batch)
    for name in "ab":
        lines = [f"Prefix(:=<http://{name}#>)"]
        for i in range(80):
            gaps = ["\n" * rnd.randint(0, 2) + " " for _ in range(4)]
            lines.append(f"ObjectPropertyAssertion({gaps[0]}:p{gaps[1]}:s{i}{gaps[2]}:o{i}{gaps[3]})")
        (tmp_path / f"{name}.owl").write_text("\n".join(lines) + "\n")
    conf = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(batch), "spark.sql.files.maxPartitionBytes": "700b"}
    prev = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        axioms = ax.read_axioms(spark, str(tmp_path), "functional")
        got = [tuple(r) for r in ax.assertions(axioms).collect()]
    finally:
        for k, v in prev.items():
            spark.conf.set(k, v)
    assert sorted(got) == sorted((f"<http://{f}#p>", f"<http://{f}#s{i}>", f"<http://{f}#o{i}>") for f in "ab" for i in range(80))
    plan = ax.statements(spark.read.text(str(tmp_path)))._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and plan.count("Exchange") == 1 and plan.index("Exchange") < plan.index("MapInArrow")


def test_stray_lines_stay_their_own(spark):
    """Lines without file and split: a run that starts with no keyword is a statement of its own, and is malformed or other."""
    rows = [":a :b)", "ObjectPropertyAssertion(:p", ":a :b)", "Prefix(:=<http://a#>)", ":c :d)", "ObjectPropertyAssertion(:p :a", None, ":b)"]
    axioms = ax.parse_axioms(spark.createDataFrame([(x,) for x in rows], "value string").coalesce(1))
    assert sorted((r.axiom_type, r.property, r.arg1) for r in axioms.where("axiom_type <> 'Prefix'").collect() if r.property) == [
        ("ObjectPropertyAssertion", "<http://a#p>", "<http://a#a>")]
    assert sorted(r.axiom_type for r in axioms.collect()) == sorted(
        ["Other", "Prefix", "Other", "ObjectPropertyAssertion", "MalformedObjectPropertyAssertion", "Other"])


def counted(df):
    """``df`` and the number of its rows computed so far, whatever asks for them."""
    seen = df.sparkSession.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b
    return df.mapInArrow(run, df.schema), seen


@pytest.mark.parametrize("query", [queries.q_axioms_roundtrip, queries.q_domain_range_axioms, queries.q_property_schema, queries.q_schema_drops])
def test_text_is_computed_twice_at_most(spark, monkeypatch, query):
    """Once for its prefixes, once for its statements: broken lines are looked for in the first pass."""
    rows = [f"ObjectPropertyAssertion(:p :a{i} :b{i % 7})" for i in range(200)]
    rows += ["Prefix(:=<http://x#>)", "ObjectPropertyDomain(:p :A)", "ObjectPropertyRange(:p :B)", "Annotation(:x)"]
    text, seen = counted(spark.createDataFrame([(x,) for x in rows], "value string"))
    monkeypatch.setattr(queries, "_axiom_text", lambda *_: text)
    got = query(spark, "").collect()
    if query is queries.q_axioms_roundtrip:
        assert sorted(map(tuple, got)) == sorted(("<http://x#p>", f"<http://x#a{i}>", f"<http://x#b{i % 7}>") for i in range(200))
    elif query is queries.q_domain_range_axioms:
        assert sorted(map(tuple, got)) == [("<http://x#p>", k, f"<http://x#{c}>", 200) for k, c in (("ObjectPropertyDomain", "A"), ("ObjectPropertyRange", "B"))]
    else:
        assert len(got) == 1 and 200 in tuple(got[0])
    assert seen.value <= 2 * len(rows)


def test_text_in_several_files(spark, monkeypatch, tmp_path):
    """Beyond the bound of a file the text goes on in others that repeat its header."""
    facts = spark.createDataFrame([(f"<http://ex.org/kg#p{i % 3}>", f"s{i}", f"o{i % 11}") for i in range(120)], "property string, subject string, object string")
    monkeypatch.setattr(queries, "knowledge_graph", lambda *_: (facts, None))
    got = []
    for bound in (1_000_000, 25):
        monkeypatch.setattr(queries, "FILE_FACTS", bound)
        monkeypatch.setattr(queries.store, "store_path", lambda *_, at=str(tmp_path / str(bound)), **__: at)
        got.append(sorted(map(tuple, queries.q_axioms_two_files(spark, "").collect())))
    assert got[0] == got[1] and sum(n for name, n in got[0] if name.startswith("<")) == 120
    assert {len(list((tmp_path / "1000000" / x).glob("part-*"))) for x in "ab"} == {1}
    assert all(len(list((tmp_path / "25" / x).glob("part-*"))) > 1 for x in "ab")


def test_axiom_text_is_compressed_in_small_files(spark, monkeypatch, tmp_path):
    """Text to rules: the written text takes a part of its bytes on disk, no file is long, and no fact is kept for the schema."""
    nation = [(f"<http://ex.org/kg#{p}>", f"c{i}", f"n{i % 3}") for p in ("customerIn", "richCustomerIn") for i in range(60)]
    rows = nation + [("<http://ex.org/kg#homeOf>", f"n{i % 3}", f"c{i}") for i in range(40)] + nation[:7]
    facts = spark.createDataFrame(rows, "property string, subject string, object string").coalesce(1)
    monkeypatch.setattr(queries, "knowledge_graph", lambda *_: (facts, None))
    monkeypatch.setattr(queries, "FILE_LINES", 50)
    monkeypatch.setattr(queries.store, "store_path", lambda *_, **__: str(tmp_path / "text"))
    monkeypatch.setattr(ax, "heads", None)
    got = sorted(map(str, queries.q_mine_from_axioms(spark, "").collect()))
    files = [[r[0] for r in spark.read.text(str(p)).collect()] for p in (tmp_path / "text").glob("part-*.txt.snappy")]
    assert len(list((tmp_path / "text").glob("part-*"))) == len(files) and max(map(len, files)) <= 50
    assert sum(x.startswith(ax.ASSERTION) for f in files for x in f) == len(rows)
    _, schema = knowledge_graph(spark, "/root/testdata/sf0.001")
    full = facts.select("property", *[F.concat(F.lit("<http://ex.org/kg#"), c, F.lit(">")).alias(c) for c in ("subject", "object")])
    assert got and got == sorted(map(str, mine(full, schema, 3, "join").collect()))


@pytest.mark.parametrize("measure", ["join", "binding"])
def test_score_computes_facts_twice(spark, measure):
    """Once to name them, once for the measure and the sizes."""
    facts, schema = knowledge_graph(spark, "/root/testdata/sf0.001")
    small = facts.where(F.col("property").contains("ustomerIn") | F.col("property").contains("supplierIn")).limit(300)
    rows = [tuple(r) for r in small.collect()]
    given, seen = counted(spark.createDataFrame(rows, small.schema))
    names = schema.where(F.col("property").contains("ustomerIn")).select("property").orderBy("property").limit(2).toArrow()["property"].to_pylist()
    asked = spark.createDataFrame([(names[0], names[1], None)], "head string, body1 string, body2 string")
    assert score(given, schema, asked, measure).count() == 1
    assert seen.value <= 2 * len(rows)
