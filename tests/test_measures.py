import itertools
import random

import pytest
from pyspark.sql import functions as F

from brute import binding_measure, join_measure, r4
from hornbeam.functions import ids, sizing
from hornbeam.functions.scores import ratio4
from hornbeam.operators import candidates, dealing, measure_binding, measure_join
from hornbeam.operators import facts as fx
from hornbeam.operators.candidates import classify, connected_triples, ordered_subsets
from hornbeam.operators.measure_binding import score_binding
from hornbeam.operators.measure_join import score_join
from hornbeam.plans.mine import candidate_rules, count_once, mine, score, score_made

IRI = "<http://ex.org/kg#{}>"


def random_graph(seed, n_props=6, n_classes=4, n_vals=4, n_facts=14):
    rnd = random.Random(seed)
    classes = [IRI.format(f"K{i}") for i in range(n_classes)]
    schema, facts = {}, []
    for i in range(n_props):
        d, r = rnd.sample(classes, 2)
        p = IRI.format(f"p{i}")
        schema[p] = [d, r]
        for _ in range(rnd.randint(1, n_facts)):
            s = f"{d[-3:-1]}v{rnd.randrange(n_vals)}"
            o = f"{r[-3:-1]}v{rnd.randrange(n_vals)}"
            facts.append((p, s, o))
            if rnd.random() < 0.2:
                facts.append((p, s, o))          # bag duplicates
    return schema, facts


def python_tables(schema, facts):
    tables, bags = {p: [] for p in schema}, {p: 0 for p in schema}
    seen = set()
    for p, s, o in facts:
        bags[p] += 1
        if (p, s, o) not in seen:
            seen.add((p, s, o))
            tables[p].append({schema[p][0]: s, schema[p][1]: o})
    return tables, bags


def frames(spark, schema, facts):
    sch = spark.createDataFrame([(p, p.split("#")[1][:-1], d, r) for p, (d, r) in schema.items()],
                                "property string, name string, dom string, ran string")
    f = spark.createDataFrame(facts, "property string, subject string, object string")
    return f, sch


# pairs of properties with the same classes (either way round), a triangle, a star, and three that share nothing
SHAPES = {"p0": "AB", "p1": "AB", "p2": "BA", "p3": "AC", "p4": "BC", "p5": "DE", "p6": "FG", "p7": "AH"}


def shaped_graph(seed, n_vals=3, n_facts=9):
    rnd = random.Random(seed)
    schema, facts = {}, []
    for name, (d, r) in SHAPES.items():
        p = IRI.format(name)
        schema[p] = [IRI.format(d), IRI.format(r)]
        for _ in range(rnd.randint(3, n_facts)):
            fact = (p, f"{d}v{rnd.randrange(n_vals)}", f"{r}v{rnd.randrange(n_vals)}")
            facts += [fact] * rnd.choice([1, 1, 2])
    return schema, facts


@pytest.mark.parametrize("seed", [1, "shapes", "unbroadcast"])
def test_measures_match_brute_force_on_all_triples(spark, seed, monkeypatch):
    schema, facts = random_graph(seed) if seed == 1 else shaped_graph(5)
    if seed == "unbroadcast":  # the plans beyond the byte bound, wedges dealt into parts of two facts
        for m in (measure_join, measure_binding, sizing):
            monkeypatch.setattr(m, "MAX_BROADCAST_BYTES", -1)
        monkeypatch.setattr(sizing, "PARTS", 3)
        monkeypatch.setattr(measure_join, "WEDGE_PART", 2)
        monkeypatch.setattr(dealing, "HEAVY_FACTS", 2)
        monkeypatch.setattr(measure_join, "TURN", 0.3)  # some pivot values are joined along the closing edge
    f, sch = frames(spark, schema, facts)
    tables, bags = python_tables(schema, facts)
    props = list(schema)
    triples = list(itertools.permutations(props, 3))
    pairs = [(a, b, None) for a, b in itertools.permutations(props, 2)]
    cand = spark.createDataFrame(triples + pairs, "head string, body1 string, body2 string")
    cl = classify(cand, sch)
    if seed == 1:  # on ids, as the library's callers do; else on the names as they are
        js, bs = (score(f, sch, cand, m).collect() for m in ("join", "binding"))
    else:
        js, bs = score_join(f, sch, cl).collect(), score_binding(f, sch, cl).collect()
    js, bs = ({(r.head, r.body1, r.body2): r for r in x} for x in (js, bs))
    seen_patterns = set()
    for rule in triples + [p[:2] for p in pairs]:
        key = tuple(rule) + ((None,) if len(rule) == 2 else ())
        s, d = join_measure(tables, bags, schema, rule)
        got = js[key]
        seen_patterns.add(got.pattern)
        assert (got.support, got.body_size) == (s, d), (rule, got.pattern)
        assert got.conf == r4(s, d) and got.head_coverage == r4(s, bags[rule[0]])
        s, d = binding_measure(tables, bags, schema, rule)
        got = bs[key]
        assert (got.support, got.body_size) == (s, d), (rule, got.pattern)
        assert got.conf == r4(s, d)
    if seed != 1:
        assert seen_patterns == {"P2", "P2_none", "S1", "S2", "S3", "S4_star", "S4_triangle", "S5a", "S5b", "S6", "S7", "S8"}
        assert {r.pattern for r in bs.values()} == {"M1", "M2", "M3a", "M3b", "M3c", "M3d", "M4", "M4_none"}


def test_supports_beyond_64_bits(spark):
    n = 3_000_000
    rows = [("K", "hub", {"a": n, "b": n, "c": n}), ("K", "v", {"a": 2, "b": 1})]
    ctx = object.__new__(measure_join.JoinContext)
    ctx.dmap, ctx.small = spark.createDataFrame(rows, "cls string, key string, m map<string,long>"), True
    req = spark.createDataFrame([("a", "b", "c", "K"), ("a", "b", None, "K")], "a string, b string, c string, K string")
    value = ctx.deg_products(req).groupBy("c").agg(F.sum("value").alias("value"))
    assert {r.c: r.value for r in value.collect()} == {"c": n ** 3, None: n ** 2 + 2}
    v = value.withColumn("s", ratio4(F.col("value"), F.lit(n ** 2 + 2)))
    assert {r.c: r.s for r in v.collect()} == {"c": r4(n ** 3, n ** 2 + 2), None: 1.0}


def triangle_graph(spark, n, n_closing, step):
    a, b, c = (IRI.format(x) for x in "abc")
    schema = spark.createDataFrame([(a, "a", "X", "Y"), (b, "b", "X", "Z"), (c, "c", "Y", "Z")], "property string, name string, dom string, ran string")
    r = spark.range(n).select(F.col("id").cast("string").alias("i"))
    facts = (r.select(F.lit(a), F.lit("x0"), F.concat(F.lit("y"), "i")).union(r.select(F.lit(b), F.lit("x0"), F.concat(F.lit("z"), "i")))
             .union(spark.range(n_closing).select(F.lit(c), F.concat(F.lit("y"), F.col("id").cast("string")),
                                                  F.concat(F.lit("z"), ((F.col("id") * step) % n_closing).cast("string")))))
    return facts.toDF("property", "subject", "object"), schema, spark.createDataFrame(list(itertools.permutations([a, b, c])), "head string, body1 string, body2 string")


@pytest.mark.parametrize("turn", [0.0, 1e30])
def test_one_heavy_pivot_value(spark, monkeypatch, turn):
    """All wedges at one value, closed in the grid or joined along the closing edge."""
    monkeypatch.setattr(measure_join, "WEDGE_PART", 16)
    monkeypatch.setattr(measure_join, "TURN", turn)
    monkeypatch.setattr(dealing, "HEAVY_FACTS", 10)
    facts, sch, cand = triangle_graph(spark, 200, 300, 7)
    want = sum(1 for i in range(300) if i < 200 and (i * 7) % 300 < 200)
    got = score_join(facts, sch, classify(cand, sch)).collect()
    assert [(r.pattern, r.support) for r in got] == [("S4_triangle", want)] * 6


def test_200000_facts_at_one_pivot_value(spark):
    """Joined along the closing edge: 4e10 wedges are never made."""
    facts, sch, cand = triangle_graph(spark, 200_000, 200_000, 3)
    got = score(facts, sch, cand.limit(1), "join").collect()
    assert [(r.pattern, r.support) for r in got] == [("S4_triangle", 200_000)]


def counting(monkeypatch):
    """Numbers of requests that the joins of facts evaluate, by kind."""
    seen = {}
    for kind in ("triangles", "pair_deg", "pair_count", "head_path"):
        def evaluate(self, req, kind=kind, own=getattr(measure_join.JoinContext, kind)):
            seen[kind] = req.distinct().count()
            return own(self, req)
        monkeypatch.setattr(measure_join.JoinContext, kind, evaluate)
    return seen


@pytest.mark.parametrize("least", [(0.1, 0.01), (0.4, 0.3), (0.0, 0.2)])
def test_pruning_keeps_every_rule_that_passes(spark, monkeypatch, least):
    schema, facts = shaped_graph(11, n_vals=6)
    f, sch = frames(spark, schema, facts)
    rules = [*itertools.permutations(schema, 3), *[(a, b, None) for a, b in itertools.permutations(schema, 2)]]
    cl = classify(spark.createDataFrame(rules, "head string, body1 string, body2 string"), sch)
    seen = counting(monkeypatch)
    passing = lambda df: sorted(map(str, df.where((F.col("conf") >= least[0]) & (F.col("head_coverage") >= least[1])).collect()))
    want, before = passing(score_join(f, sch, cl)), dict(seen)
    seen.clear()
    got = score_join(f, sch, cl, thresholds=least)
    assert passing(got) == want and want
    assert sum(seen.values()) < sum(before.values()) if least[0] else seen["head_path"] == before["head_path"]


def test_triangles_that_cannot_pass_are_not_joined(spark, monkeypatch):
    """200 x 200 wedges at one value and 100 closing facts: two rules fail by confidence, the others by head coverage."""
    facts, sch, cand = triangle_graph(spark, 200, 100, 7)
    cl = classify(cand, sch)
    seen = counting(monkeypatch)
    assert score_join(facts, sch, cl, thresholds=(0.1, 0.01)).count() == 4 and seen == {"triangles": 1}
    seen.clear()
    assert score_join(facts, sch, cl, thresholds=(0.1, 0.6)).count() == 0 and seen == {}


def test_grid_cells_are_even(spark):
    """200,000 facts of both edges at one value: what a cell reads stays near the median."""
    n = 200_000
    at = spark.range(n).select(F.lit(0).alias("tid"), F.lit("x0").alias("pk"), F.col("id").alias("u"), F.col("id").alias("w"),
                               F.lit(n).alias("na"), F.lit(n).alias("nb"))
    a, b = measure_join.JoinContext.grid(at, at)
    cells = [r[0] for r in a.select("i", "j").unionByName(b.select("i", "j")).groupBy("i", "j").count().select("count").collect()]
    parts = -(-n // measure_join.WEDGE_PART)
    assert len(cells) == parts ** 2 and max(cells) <= 4 * sorted(cells)[len(cells) // 2] and max(cells) < 3 * measure_join.WEDGE_PART


def test_heavy_value_of_a_path_is_dealt(spark, monkeypatch):
    """Half of the head's facts at one value are spread over parts, and the sum stays right."""
    monkeypatch.setattr(dealing, "HEAVY_FACTS", 100)
    h, p, q = (IRI.format(x) for x in "hpq")
    schema = {h: ["X", "Y"], p: ["X", "A"], q: ["Y", "B"]}
    facts = [(h, "x0" if i % 2 else f"x{i}", f"y{i}") for i in range(3000)] + [(p, "x0", f"a{i}") for i in range(40)] + [(p, "x2", "a")]
    facts += [(q, f"y{i}", f"b{i % 3}") for i in range(0, 3000, 3)] + [(q, "y1", "b9"), (q, "y2", "b9")]
    f, sch = frames(spark, schema, facts)
    cand = spark.createDataFrame([(h, p, q)], "head string, body1 string, body2 string")
    deg_q = {f"y{i}": 1 for i in range(0, 3000, 3)} | {"y1": 1, "y2": 1}
    want = sum((40 if i % 2 or i == 0 else 1 if i == 2 else 0) * deg_q.get(f"y{i}", 0) for i in range(3000))
    r = score_join(f, sch, classify(cand, sch)).collect()[0]
    assert (r.pattern, r.support) == ("S6", want)
    ctx = measure_join.JoinContext(f, sch)
    rows = ctx.side.where((F.col("property") == h) & (F.col("cls") == "X") & (F.col("key") == "x0"))
    parts = [x["count"] for x in ctx.heavy().deal(rows, ["cls", "key"], ["other"]).groupBy("_part").count().collect()]
    assert sum(parts) == 1501 and len(parts) >= 15 and max(parts) <= 200
    copies = ctx.heavy().deal(ctx.dmap.where("key = 'x0'"), ["cls", "key"], None).count()
    assert copies >= len(parts)
    ctx.release()


@pytest.mark.parametrize("n_props", [63, 64])
def test_many_properties_are_counted_with_and_without_bits(spark, n_props):
    schema = {IRI.format(f"p{i:02}"): [IRI.format("A"), IRI.format("B")][::-1 if i % 2 else 1] for i in range(n_props)}
    facts = [(p, *(("a1", "b1") if i % 2 == 0 else ("b1", "a1"))) for i, p in enumerate(schema)] + [(IRI.format("p00"), "a2", "b1")] * 2
    f, sch = frames(spark, schema, facts)
    c = count_once(f, sch)
    assert ("mask" in c.counts.columns) == (n_props <= 63)
    assert {r.property: r.n for r in c.named.collect()} == {p: 3 if i == 0 else 1 for i, p in enumerate(schema)}
    c.kept.unpersist()
    first, last = IRI.format("p00"), IRI.format(f"p{n_props - 1}")
    got = score(f, sch, spark.createDataFrame([(last, first, None)], "head string, body1 string, body2 string")).collect()
    assert [(r.support, r.body_size, r.head_size) for r in got] == [(1, 3, 1)]


def test_a_path_reads_its_head_once_for_all_requests(spark, monkeypatch):
    """Five rules over one head, from either side: its facts meet the degrees of the class with more keys once, and travel on as sums."""
    h, p1, p2, q1, q2 = (IRI.format(x) for x in ("h", "p1", "p2", "q1", "q2"))
    schema = {h: ["X", "Y"], p1: ["X", "A"], p2: ["B", "X"], q1: ["Y", "C"], q2: ["D", "Y"]}
    facts = [(h, f"x{i}", f"y{i % 5}") for i in range(300)] + [(p1, f"x{i % 90}", f"a{i % 7}") for i in range(200)]
    facts += [(p2, f"b{i % 3}", f"x{i}") for i in range(100)] + [(q1, f"y{i % 4}", f"c{i}") for i in range(30)] + [(q2, f"d{i}", "y1") for i in range(9)]
    f, sch = frames(spark, schema, facts)
    rules = [(h, p1, q1), (h, p1, q2), (h, p2, q1), (h, p2, q2), (h, q2, p1)]
    rows, own = [], measure_join.JoinContext.with_degrees

    def met(self, df, *names):
        rows.append(df.count())
        return own(self, df, *names)
    monkeypatch.setattr(measure_join.JoinContext, "with_degrees", met)
    got = {(r.head, r.body1, r.body2): (r.pattern, r.support) for r in score_join(
        f, sch, classify(spark.createDataFrame(rules, "head string, body1 string, body2 string"), sch)).collect()}
    tables, _ = python_tables(schema, facts)
    assert got == {r: ("S6", join_measure(tables, _, schema, r)[0]) for r in rules} and all(n for _, n in got.values())
    assert rows == [300]


def test_sets_and_sizes_come_from_one_exchange(spark):
    """A fact that several properties hold is one row with their bits, bag sizes stand beside it, and the sets are not exchanged again."""
    schema, facts = shaped_graph(5, n_vals=4, n_facts=20)
    facts += [(IRI.format("p0"), None, "Bv1")] * 2 + [(IRI.format("p1"), "Av1", None)] + facts[:30] * 3
    f, sch = frames(spark, schema, facts)
    c = count_once(f, sch)
    sizes = {p: sum(x[0] == p for x in facts) for p in schema}
    assert {r.property: r.n for r in c.named.collect()} == sizes
    names = {r[0]: r[1] for r in c.ids.encode(sch.select("property", F.col("property").alias("name")), ["property"]).collect()}
    want = sorted((tuple(r.props), r.n) for r in fx.fact_sets(fx.typed_facts(f, sch)).groupBy("props").agg(F.count(F.lit(1)).alias("n")).collect())
    some = sorted(names)[:3]
    for props in (None, some):
        ctx = measure_join.JoinContext(c.counts, c.ids.schema(sch), None if props is None else spark.createDataFrame([(x,) for x in props], "property long"),
                                       c.sizes, c.counts)
        rows = [tuple(sorted(names[x] for x in r.props)) for r in ctx.fsets.collect()]
        kept = set(schema) if props is None else {names[x] for x in props}
        left = [tuple(x for x in s if x in kept) for s, n in want for _ in range(n)]
        assert sorted(rows) == sorted(x for x in left if x)
        assert "Exchange" not in ctx.fsets._jdf.queryExecution().executedPlan().toString().split("InMemoryRelation")[0]
        ctx.release()
    c.kept.unpersist()


@pytest.mark.parametrize("closing, light", [(1 << 19, 2.0), (0, 2.0), (0, 0.0)])
def test_triangles_share_their_larger_edge(spark, monkeypatch, closing, light):
    """Three triangles over one large edge with few wedges: its facts are dealt once, whatever the number of triangles."""
    monkeypatch.setattr(measure_join, "CLOSING", closing)
    monkeypatch.setattr(measure_join, "LIGHT", light)
    monkeypatch.setattr(dealing, "HEAVY_FACTS", 20)  # some pivot values are dealt into parts
    rnd = random.Random(7)
    lives = [IRI.format(f"lives{i}") for i in range(3)]
    buys, based = IRI.format("buys"), IRI.format("based")
    schema = {x: ["C", "N"] if i < 2 else ["N", "C"] for i, x in enumerate(lives)} | {buys: ["C", "S"], based: ["S", "N"]}
    at = [(f"c{i}", f"n{rnd.randrange(2)}") for i in range(60)]
    facts = [(lives[0], *x) for x in at] + [(lives[1], *x) for x in at[:40]] + [(lives[2], n, c) for c, n in at[20:]] + [(lives[0], *at[0])] * 2
    facts += [(buys, f"c{min(rnd.randrange(70), rnd.randrange(70))}", f"s{rnd.randrange(40)}") for _ in range(900)] + [(buys, "c0", f"s{i}") for i in range(40)]
    facts += [(based, f"s{i}", f"n{rnd.randrange(2)}") for i in range(40)] + [(based, "s1", "n7"), (based, "s8", "n7")]
    f, sch = frames(spark, schema, facts)
    tables, _ = python_tables(schema, facts)
    rules = [r for x in lives for r in itertools.permutations([x, buys, based])]
    dealt, own = [], dealing.Heavy.deal

    def deal(self, rows, at, by):
        dealt.append(rows.count() if by else 0)
        return own(self, rows, at, by)
    monkeypatch.setattr(dealing.Heavy, "deal", deal)
    got = {(r.head, r.body1, r.body2): (r.pattern, r.support) for r in score(f, sch, spark.createDataFrame(rules, "head string, body1 string, body2 string")).collect()}
    assert got == {r: ("S4_triangle", join_measure(tables, _, schema, r)[0]) for r in rules} and all(n for _, n in got.values())
    if light:
        assert sum(dealt) == len(tables[buys])


@pytest.mark.parametrize("measure", ["join", "binding"])
def test_mining_leaves_nothing_cached(spark, kg, measure):
    facts, schema = kg
    spark.catalog.clearCache()
    assert mine(facts, schema, 3, measure).count() > 0
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == 0


def test_untyped_atoms_drop_a_rule_in_any_position(spark):
    schema, facts = random_graph(1)
    _, sch = frames(spark, schema, facts)
    p, q = list(schema)[:2]
    rows = [("x", p, q), (p, "x", q), (p, q, "x"), (p, q, list(schema)[2])]
    cand = spark.createDataFrame(rows, "head string, body1 string, body2 string")
    assert classify(cand, sch).count() == 1


def test_single_valued_view_is_for_the_binding_measure(kg):
    facts, schema = kg
    with pytest.raises(ValueError, match="binding"):
        mine(facts, schema, 3, "join", one_object_per_subject=True)


def test_worked_numbers_sf0001(kg):
    facts, schema = kg
    did = F.col("head").contains("did_") & F.col("body1").contains("did_")
    s1 = score(facts, schema, candidate_rules(facts, schema, 3), "join").where(
        did & F.col("body2").contains("did_")).collect()
    assert len(s1) == 60
    assert (min(r.conf for r in s1), max(r.conf for r in s1)) == (0.3795, 0.4835)
    assert (min(r.head_coverage for r in s1), max(r.head_coverage for r in s1)) == (1.7624, 2.3911)
    m2 = score(facts, schema, candidate_rules(facts, schema, 3), "binding").where(
        did & F.col("body2").contains("did_")).collect()
    assert {r.conf for r in m2} == {0.625}
    assert (min(r.head_coverage for r in m2), max(r.head_coverage for r in m2)) == (0.0714, 0.0798)
    two = score(facts, schema, candidate_rules(facts, schema, 2), "join").where(did).collect()
    assert len(two) == 20
    assert (min(r.conf for r in two), max(r.conf for r in two)) == (0.2921, 0.3614)


def test_triangle_support(spark, kg):
    facts, schema = kg
    iri = lambda n: IRI.format(n)
    cand = spark.createDataFrame([(iri("customerIn"), iri("buysFrom"), iri("supplierIn"))],
                                 "head string, body1 string, body2 string")
    r = score_join(facts, schema, classify(cand, schema)).collect()[0]
    assert (r.pattern, r.support) == ("S4_triangle", 59)


def test_star_body_swap_symmetry(spark, kg):
    facts, schema = kg
    iri = lambda n: IRI.format(n)
    rows = [(iri("customerIn"), iri("supplierIn"), iri("orderFrom")),
            (iri("customerIn"), iri("orderFrom"), iri("supplierIn"))]
    cand = spark.createDataFrame(rows, "head string, body1 string, body2 string")
    cl = classify(cand, schema)
    j = score_join(facts, schema, cl).collect()
    b = score_binding(facts, schema, cl).collect()
    assert j[0].support == j[1].support and j[0].conf == j[1].conf
    assert b[0].support == b[1].support and b[0].conf == b[1].conf


def test_empty_input_gives_typed_empty_frame(spark, kg):
    _, schema = kg
    empty = spark.createDataFrame([], "property string, subject string, object string")
    for measure in ("join", "binding"):
        out = mine(empty, schema, 3, measure)
        assert out.count() == 0
        assert out.columns == ["head", "body1", "body2", "conf", "fitness", "rule"]


def test_same_result_at_one_and_many_partitions(spark, kg):
    facts, schema = kg
    a = {tuple(r) for r in mine(facts.coalesce(1), schema, 3, "join").collect()}
    prev = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        b = {tuple(r) for r in mine(facts.repartition(7), schema, 3, "join").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", prev)
    assert a == b and len(a) > 0


def test_hot_key_and_hot_other_of_the_binding_measure(spark, monkeypatch):
    """Half of all facts at one key, and at one other value; counts by Python sets."""
    monkeypatch.setattr(dealing, "HEAVY_FACTS", 50)
    p, q = IRI.format("p"), IRI.format("q")
    schema = {p: ["X", "Y"], q: ["X", "Y"]}
    facts = [(p, "x0", f"y{i}") for i in range(400)] + [(p, f"x{i}", "y0") for i in range(400)]
    facts += [(q, "x0", f"y{i}") for i in range(100, 300)] + [(q, f"x{i}", "y0") for i in range(100)] + [(q, "x999", "y5")]
    f, sch = frames(spark, schema, facts)
    r = score(f, sch, spark.createDataFrame([(p, q, None)], "head string, body1 string, body2 string"), "binding").collect()[0]
    col = {z: {s for a, s, _ in facts if a == z} for z in (p, q)}
    v = col[p] & col[q]
    other = {z: {o for a, s, o in facts if a == z and s in v} for z in (p, q)}
    assert (r.pattern, r.support, r.body_size) == ("M4", len(other[p] & other[q]), sum(a == q for a, *_ in facts))


def exchanged(df):
    """Types of the columns of every exchange in the plan of ``df``."""
    text = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    names = {c.strip().split("#")[0] for block in text.split("\n\n") if " Exchange" in block.split("\n")[0]
             for line in block.split("\n") if line.startswith("Input") for c in line.split("[", 2)[-1].rstrip("]").split(",")}
    return names


@pytest.mark.parametrize("k", [2, 3])
def test_subsets_by_unranking(spark, k, monkeypatch):
    monkeypatch.setattr(candidates, "RANGE", 7)
    groups = [["a", "b", "c", "d", "e"], ["d", "e", "f"], ["x"], ["y", "z"]]
    c = spark.createDataFrame([("kind", str(i), g) for i, g in enumerate(groups)], "kind string, cluster_id string, properties array<string>")
    want = {(*s, *[None] * (3 - k)) for g in groups for s in itertools.permutations(g, k)}
    got = [tuple(r) for r in ordered_subsets(c, k).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert ordered_subsets(c.where("false"), k).count() == 0


def test_large_cluster_shuffles_numbers_only(spark):
    names = [f"<http://ex.org/kg#p{i}>" for i in range(2000)]
    c = spark.createDataFrame([("kind", "0", names)], "kind string, cluster_id string, properties array<string>")
    pairs = ordered_subsets(c, 2)
    assert pairs.count() == 2000 * 1999
    assert exchanged(pairs) <= {"cid", "n", "lo", "hi", "head_id", "body1_id"} and exchanged(pairs)


def test_ids_part_names_that_share_a_hash(spark, monkeypatch):
    """With a hash of nine bits many names clash; the ids still part them, and scores stay those of the names."""
    real = ids._hash
    monkeypatch.setattr(ids, "_hash", lambda name, seed: F.pmod(real(name, seed), F.lit(1 << 9)) if seed >= 0 else real(name, seed))
    schema, facts = shaped_graph(5, n_vals=12, n_facts=40)
    f, sch = frames(spark, schema, facts + [(IRI.format("p0"), None, "Bv1"), (IRI.format("p0"), "Av1", None)])
    names = ids.NameIds(f, sch)
    values = spark.createDataFrame([(x,) for x in sorted({v for t in facts for v in t} | {c for d in schema.values() for c in d})], "v string")
    got = [r[0] for r in names.encode(values, ["v"]).collect()]
    assert names.levels and len(set(got)) == len(got)
    assert names.facts(f).where("subject IS NULL OR object IS NULL").count() == 2


def test_fact_exchanges_carry_numbers(spark, kg):
    facts, schema = kg
    names = ids.NameIds(facts, schema)
    counts = fx.typed_counts(names.facts(facts), names.schema(schema))
    assert {t for _, t in counts.dtypes} == {"bigint"} and {t for _, t in fx.fact_sets_from_counts(counts).dtypes} == {"bigint", "array<bigint>"}


@pytest.mark.parametrize("measure, one_object", [("join", False), ("binding", False), ("binding", True)])
def test_facts_are_read_once_and_ids_part_names_there_too(spark, monkeypatch, measure, one_object):
    """One pass over the facts serves ids, sizes, candidates and the measure; it is repeated only while names share an id."""
    schema, facts = shaped_graph(5, n_vals=12, n_facts=40)
    f, sch = frames(spark, schema, facts)
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch
    f = f.mapInArrow(seen, f.schema)
    run = lambda: sorted(map(str, score_made(f, sch, lambda sizes: classify(connected_triples(sch.join(sizes, "property", "leftsemi")), sch),
                                             measure, one_object).collect()))
    want = run()
    assert want and read.value == len(facts)
    real, levels = ids._hash, []
    monkeypatch.setattr(ids, "_hash", lambda name, seed: levels.append(seed) or F.pmod(real(name, seed), F.lit(1 << 9)))
    assert run() == want and max(levels) >= 1


def test_key_sets_are_built_of_the_classes_that_requests_look_at(spark):
    """One rule over the first class of its atoms: nothing is grouped by, or carried for, the values of the other classes."""
    a, b, c = (IRI.format(x) for x in "ABC")
    facts = [("p", "a1", "b1"), ("p", "a2", "b1"), ("q", "a1", "c1"), ("q", "a2", "c2")]
    f = spark.createDataFrame(facts, "property string, subject string, object string")
    sch = spark.createDataFrame([("p", a, b), ("q", a, c)], "property string, dom string, ran string")
    ctx = measure_binding.BindingContext(f, sch, asked=spark.createDataFrame([("p", a), ("q", a)], "p string, c string"))
    assert {(r.key, r.c) for r in ctx.held.collect()} == {("a1", a), ("a2", a)}
    entries = ctx.sets.select(F.lit(5).cast("bigint").alias("e"), F.lit("q").alias("p"), F.lit(a).alias("c"), "s1", "s2")
    got = ctx.other_sets(entries).collect()
    assert [(r.n, r.e) for r in got] == [(2, 5)] and {(r.other, r.e) for r in ctx.entries.collect()} == {("c1", 5), ("c2", 5)}
    ctx.release()


def test_second_hashes_of_a_fact_share_one_column(spark):
    """The exchange of the counts carries one check for both names, turned with them, and the check still finds names that clash."""
    f = spark.createDataFrame([(1, 10, 20, 5 << 32 | 6), (2, 20, 10, 7 << 32 | 8)], "property long, subject long, object long, check long")
    sch = spark.createDataFrame([(1, 100, 200), (2, 200, 100)], "property long, dom long, ran long")
    counts = fx.typed_counts(f, sch, True)
    assert len(counts.columns) == 7
    assert sorted((r.property, r.v_lo, r.v_hi, r.check) for r in counts.collect()) == [(1, 10, 20, 5 << 32 | 6), (2, 10, 20, 8 << 32 | 7)]
    names = spark.createDataFrame([(-1, -2), (-1, 2 ** 31 - 1), (-2 ** 31, -1)], "a int, b int").withColumn("check", ids._both(F.col("a"), F.col("b")))
    assert all(r.x == r.a and r.y == r.b for r in names.select("a", "b", *[x.alias(n) for x, n in zip(ids._halves("check"), "xy")]).collect())


@pytest.mark.parametrize("n_props", [1, 63, 64])
def test_sets_of_few_properties_travel_as_one_number(spark, n_props):
    schema = {IRI.format(f"p{i:02}"): [IRI.format("A"), IRI.format("B")][::-1 if i % 2 else 1] for i in range(n_props)}
    facts = [(p, *(("a1", "b1") if i % 2 == 0 else ("b1", "a1"))) for i, p in enumerate(schema)] + [(IRI.format("p00"), "a2", "b1")] * 2
    f, sch = frames(spark, schema, facts)
    ctx = measure_join.JoinContext(f, sch, sch.select("property"))
    got = {(r.v_lo, r.v_hi): r.props for r in ctx.fsets.collect()}
    assert got == {("a1", "b1"): sorted(schema), ("a2", "b1"): [IRI.format("p00")]}
    assert ("bit_or" in ctx.fsets._jdf.queryExecution().optimizedPlan().toString()) == (n_props <= 63)
    ctx.release()
