"""Native operators against brute force, with nulls, ties, repeats, empty tables and clashing columns."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from hornbeam.llm.common import components
from hornbeam.llm.exact_dedup import exact_duplicates
from hornbeam.llm.mixing import mix, water_fill
from hornbeam.llm.quality import kth_largest
from hornbeam.llm.urls import UNIT, judge, propagate

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, kept string, size string"


def frame(spark, rows, schema=DOCS, parts=3):
    return spark.createDataFrame(rows, schema).repartition(parts)


def docs_of(n=60, seed=1):
    r = random.Random(seed)
    texts = ["", None, "a", "b", "ab", "same text here", "same text herE", "é", "x " * 5000, "x " * 4999 + "y "]
    texts += [" ".join(r.choice("one two three four five".split()) for _ in range(r.randint(1, 30))) for _ in range(8)]
    return [(i, r.choice(texts), "en", r.choice(["s0", "s0", "s0", "s1", "S2", "é", None]), "clash", "clash") for i in range(n)]


def test_exact_duplicates(spark):
    rows = docs_of()
    got = {r.id: r for r in exact_duplicates(frame(spark, rows), digest_all=True, prefix_chars=2, bits=128).collect()}
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(t or "", []).append(i)
    assert len(got) == len(rows)
    for i, t, *_ in rows:
        g = groups[t or ""]
        assert (got[i].keep_id, got[i].group_size, got[i].kept) == (max(g), len(g), i == max(g))
        assert got[i].sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_exact_duplicates_edges(spark):
    assert exact_duplicates(frame(spark, [])).count() == 0
    twice = [(1, "t", "", "", "", ""), (1, "t", "", "", "", ""), (None, "t", "", "", "", ""), (None, None, "", "", "", "")]
    got = sorted(((r.id, r.keep_id, r.group_size, r.kept) for r in exact_duplicates(frame(spark, twice)).collect()), key=str)
    assert got == [(1, 1, 3, True), (1, 1, 3, True), (None, 1, 3, False), (None, None, 1, True)]


def fill(sizes, weights, total, cap):
    target, clamped = {}, set()
    while True:
        rest = total - sum(cap * sizes[s] for s in clamped)
        w = sum(weights[s] for s in sizes if s not in clamped)
        over = {s for s in sizes if s not in clamped and weights[s] * rest / w > cap * sizes[s]}
        if not over:
            return {s: cap * sizes[s] if s in clamped else weights[s] * rest / w for s in sizes}
        clamped |= over
        if len(clamped) == len(sizes):
            return {s: cap * sizes[s] for s in sizes}


def test_mix(spark):
    rows = docs_of(200, 3)
    got = mix(frame(spark, rows), [3, 1, 2], 1.5, 2.0).collect()
    size = {i: len(WORD.findall(t or "")) for i, t, *_ in rows}
    names = sorted({s for *_, s, _, _ in rows if s is not None}, key=lambda s: s.encode()) + [None]
    sizes = {s: sum(size[i] for i, _, _, q, _, _ in rows if q == s) for s in names}
    target = fill(sizes, {s: [3, 1, 2][k % 3] for k, s in enumerate(names)}, 1.5 * sum(sizes.values()), 2.0)
    taken = {}
    assert len(got) == len(rows)
    for r in got:
        assert r.size == size[r.id] and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(target[r.source]) and 0 <= r.taken <= 2 * r.size
        assert r.repeats * r.size <= 2 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s in names:
        assert abs(taken[s] - target[s]) <= 1
    again = {(r.id, r.taken) for r in mix(frame(spark, rows, parts=7), [3, 1, 2], 1.5, 2.0).collect()}
    assert again == {(r.id, r.taken) for r in got}


def test_mix_edges(spark):
    assert mix(frame(spark, []), [1]).count() == 0
    got = mix(frame(spark, [(1, None, "", "a", "", ""), (2, "", "", "a", "", "")]), [1]).collect()
    assert sorted((r.id, r.size, r.taken, r.target) for r in got) == [(1, 0, 0, 0.0), (2, 0, 0, 0.0)]
    twice = [(1, "one two", "", None, "", ""), (1, "one two", "", None, "", "")]
    assert sum(r.taken for r in mix(frame(spark, twice), [1]).collect()) == 6


def test_water_fill_clamps_all(spark):
    s = spark.createDataFrame([("a", 10, 1.0), ("b", 1, 5.0)], "source string, size long, weight double")
    assert {r.source: r.target for r in water_fill(s, F.lit(100.0), 2.0).collect()} == {"a": 20.0, "b": 2.0}


def ranks(edges, seeds, rounds, kind):
    out, total = {}, sum(seeds.values())
    ways = {}
    for (a, b), n in edges.items():
        a, b = (a, b) if kind == "trust" else (b, a)
        ways.setdefault(a, {})[b] = n
    seed = {h: n * UNIT // total for h, n in seeds.items()}
    out = dict(seed)
    for _ in range(rounds):
        new = {h: x * 150 // 1000 for h, x in seed.items()}
        for a, x in out.items():
            for b, n in ways.get(a, {}).items():
                new[b] = new.get(b, 0) + x * n * 850 // (sum(ways[a].values()) * 1000)
        out = {h: x for h, x in new.items() if x}
    return out


def test_propagate(spark):
    r = random.Random(4)
    edges = {(f"h{r.randint(0, 9)}", f"h{r.randint(0, 12)}"): r.randint(1, 4) for _ in range(30)}
    edges = {k: v for k, v in edges.items() if k[0] != k[1]}
    seeds = {"trust": {"h1": 2, "h2": 1}, "distrust": {"h3": 1, "h12": 4}}
    e = spark.createDataFrame([(a, b, n) for (a, b), n in edges.items()], "src string, dst string, n long")
    s = spark.createDataFrame([(k, h, n) for k, x in seeds.items() for h, n in x.items()], "kind string, host string, n long")
    got = {}
    for row in propagate(e, s, rounds=5).collect():
        got.setdefault(row.kind, {})[row.host] = row.score
    assert got == {k: ranks(edges, x, 5, k) for k, x in seeds.items()}


def test_judge(spark):
    rules = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/")]
    rows = [(1, "http://A.com/x?q", "<a href='http://far.org/'>"), (2, "https://m.example.com/en/1#t", None), (3, "x://www.example.com/en/", ""),
            (4, "http://b.net/es/1", "see far.org and bad.org"), (5, "http://b.net/en/1", ""), (6, "http://far.org/a", "www.B.net"),
            (7, "http://bad.org", "mirror of b.net, b.net"), (8, None, "x.com"), (9, "no host", ""), (10, "http://c.com", ""),
            (11, "http://xcom/", ""), (1, "http://A.com/x?q", "")]
    got = judge(spark.createDataFrame(rows, "page_id long, url string, html string"), rules).collect()
    assert len(got) == len(rows)
    g = {r.id: r for r in got}
    assert (g[1].host, g[1].path, g[1].rule, g[1].verdict) == ("a.com", "/x", "com/", "allow")
    assert (g[2].rule, g[2].verdict) == ("example.com/en/", "block") and (g[3].rule, g[3].verdict) == ("www.example.com/en/", "allow")
    assert (g[4].rule, g[4].verdict) == ("net/es/", "block")
    assert (g[5].rule, g[5].verdict) == (None, "block")          # its host has blocked urls
    assert (g[7].rule, g[7].verdict) == (None, "block")          # links to a blocked host
    assert (g[6].rule, g[6].verdict, g[6].trust > 0) == (None, "allow", True)  # a trusted host links to it
    assert (g[8].host, g[8].path, g[8].verdict) == ("", "", "allow") == (g[9].host, g[9].path, g[9].verdict)
    assert (g[10].path, g[10].rule) == ("", None) and g[11].rule is None
    assert judge(spark.createDataFrame([], "page_id long, url string, html string"), rules).count() == 0


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randint(0, 60), r.randint(0, 60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(40)] + [(200, 200 + i) for i in range(50)]
    par = {}

    def find(a):
        while par.setdefault(a, a) != a:
            a = par[a]
        return a
    for a, b in edges:
        x, y = find(a), find(b)
        par[max(x, y)] = min(x, y)
    got = {row.node: row.component for row in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {a: find(a) for a in par if find(a) != a or any(find(b) == a and b != a for b in par)}


@pytest.mark.parametrize("k", [1, 7, 500, 2000])
def test_kth_largest(spark, k):
    r = random.Random(k)
    x = [r.randint(-10**12, 10**12) for _ in range(990)] + [5] * 10
    d = spark.createDataFrame([(v,) for v in x], "v long")
    assert kth_largest(d, "v", k) == sorted(x, reverse=True)[min(k, 1000) - 1]
    assert kth_largest(d.where("false"), "v", k) is None
