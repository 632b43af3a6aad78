"""Independent SQL statements of the named queries, for DuckDB.

They read the same parquet tables (pre-registered views) and compute rule
supports the literal way: joined rows of distinct facts for the join measure
(COUNT(*) of the join, which equals a DISTINCT count over all joined columns),
``INTERSECT`` of value sets for the binding measure, and the exact integer form
of HALF_UP rounding. Nothing here is executed by the library itself.
"""

from __future__ import annotations

from ..sources.kg_tables import EVENT_TYPES, PROPERTIES, declaration_rows
from .queries import APART, PRUNED

NS = "http://ex.org/kg#"


def _iri(n: str) -> str:
    return f"<{NS}{n}>"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_EVENTS = ", ".join(_q(e) for e in EVENT_TYPES)

FACTS = f"""facts AS (
  SELECT property, subject, object FROM (
    SELECT '<{NS}did_' || event_type || '>' AS property, 'u' || CAST(user_id AS VARCHAR) AS subject,
           'h' || CAST(hour(ts) AS VARCHAR) AS object
      FROM events WHERE event_type IN ({_EVENTS})
    UNION ALL SELECT '{_iri("customerIn")}', 'c' || CAST(c_custkey AS VARCHAR), 'n' || CAST(c_nationkey AS VARCHAR) FROM customer
    UNION ALL SELECT '{_iri("richCustomerIn")}', 'c' || CAST(c_custkey AS VARCHAR), 'n' || CAST(c_nationkey AS VARCHAR) FROM customer WHERE c_acctbal > 0
    UNION ALL SELECT '{_iri("homeOf")}', 'n' || CAST(c_nationkey AS VARCHAR), 'c' || CAST(c_custkey AS VARCHAR) FROM customer WHERE c_acctbal > 3000
    UNION ALL SELECT '{_iri("inSegment")}', 'c' || CAST(c_custkey AS VARCHAR), c_mktsegment FROM customer
    UNION ALL SELECT '{_iri("supplierIn")}', 's' || CAST(s_suppkey AS VARCHAR), 'n' || CAST(s_nationkey AS VARCHAR) FROM supplier
    UNION ALL SELECT '{_iri("orderFrom")}', 'o' || CAST(o.o_orderkey AS VARCHAR), 'n' || CAST(c.c_nationkey AS VARCHAR)
      FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
    UNION ALL SELECT '{_iri("buysFrom")}', 'c' || CAST(o.o_custkey AS VARCHAR), 's' || CAST(l.l_suppkey AS VARCHAR)
      FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
    UNION ALL SELECT '{_iri("usesPriority")}', 'c' || CAST(o_custkey AS VARCHAR), replace(o_orderpriority, ' ', '_') FROM orders
    UNION ALL SELECT '{_iri("openPriority")}', 'c' || CAST(o_custkey AS VARCHAR), replace(o_orderpriority, ' ', '_') FROM orders WHERE o_orderstatus = 'O'
    UNION ALL SELECT '{_iri("hasStatus")}', 'c' || CAST(o_custkey AS VARCHAR), o_orderstatus FROM orders
  ) WHERE subject IS NOT NULL AND object IS NOT NULL AND property IS NOT NULL)"""

SCHEMA = "schema(property, name, dom, ran) AS (VALUES " + ", ".join(
    f"({_q(_iri(n))}, {_q(n)}, {_q(_iri(d))}, {_q(_iri(r))})" for n, d, r in PROPERTIES) + ")"

DECLS = "decls(axiom_type, property, cls) AS (VALUES " + ", ".join(
    f"({_q(k)}, {_q(p)}, {_q(c)})" for k, p, c in declaration_rows()) + ")"

# The slot of each class name under the ML library's HashingTF with so many features.
BUCKETS = {
    20: {"User": 1, "Hour": 12, "Customer": 10, "Nation": 5, "Supplier": 3, "Order": 15, "Segment": 1, "Priority": 18, "Status": 6},
    5: {"User": 1, "Hour": 2, "Customer": 0, "Nation": 0, "Supplier": 3, "Order": 0, "Segment": 1, "Priority": 3, "Status": 1},
}

SIZES = "sizes AS (SELECT property, count(*) AS n FROM facts GROUP BY property)"
TYPED = ("tf AS (SELECT DISTINCT f.property, s.dom, s.ran, f.subject, f.object "
         "FROM facts f JOIN schema s ON f.property = s.property)")
SIDE = ("side AS (SELECT property, dom AS cls, subject AS key, object AS other FROM tf "
        "UNION ALL SELECT property, ran AS cls, object AS key, subject AS other FROM tf)")
TYPED_WF = ("tschema AS (SELECT * FROM schema WHERE property IN (SELECT property FROM sizes))")

CLUSTERS = """ckeys AS (
  SELECT 'domain_range' AS kind, property, least(dom, ran) || '|' || greatest(dom, ran) AS cluster_id FROM tschema
  UNION ALL SELECT 'domain', property, dom FROM tschema
  UNION ALL SELECT 'range', property, ran FROM tschema),
clusters AS (SELECT kind, cluster_id, string_agg(property, ',' ORDER BY property) AS members,
                    count(*) AS n_members FROM ckeys GROUP BY kind, cluster_id HAVING count(*) >= 3),
cmembers AS (SELECT k.kind, k.cluster_id, k.property FROM ckeys k
             JOIN clusters c ON c.kind = k.kind AND c.cluster_id = k.cluster_id)"""

CAND3 = """cand3 AS (SELECT DISTINCT a.property AS head, b.property AS body1, c.property AS body2
  FROM cmembers a JOIN cmembers b ON a.kind = b.kind AND a.cluster_id = b.cluster_id AND a.property <> b.property
  JOIN cmembers c ON c.kind = a.kind AND c.cluster_id = a.cluster_id AND c.property <> a.property AND c.property <> b.property)"""

CAND2 = """cand2 AS (SELECT DISTINCT a.property AS head, b.property AS body1, CAST(NULL AS VARCHAR) AS body2
  FROM cmembers a JOIN cmembers b ON a.kind = b.kind AND a.cluster_id = b.cluster_id AND a.property <> b.property
  WHERE a.kind = 'domain_range')"""

CONN3 = """atoms AS (SELECT property, dom AS cls FROM tschema UNION ALL SELECT property, ran FROM tschema),
edges AS (SELECT DISTINCT a.property AS p, b.property AS q FROM atoms a JOIN atoms b ON a.cls = b.cls AND a.property <> b.property),
conn3 AS (SELECT e1.p AS head, e1.q AS body1, e2.q AS body2 FROM edges e1 JOIN edges e2 ON e1.p = e2.p AND e1.q <> e2.q
          JOIN edges e3 ON e3.p = e1.q AND e3.q = e2.q)"""


def classify(src: str, name: str = "cl") -> str:
    """CTE ``name`` with class columns and both patterns of the candidates in ``src``."""
    return f"""{name}_a AS (
  SELECT c.head, c.body1, c.body2, s0.dom AS d0d, s0.ran AS d0r, s1.dom AS d1d, s1.ran AS d1r,
         s2.dom AS d2d, s2.ran AS d2r
  FROM {src} c JOIN schema s0 ON s0.property = c.head JOIN schema s1 ON s1.property = c.body1
  LEFT JOIN schema s2 ON s2.property = c.body2),
{name}_b AS (
  SELECT *,
    CAST(d0d IN (d1d, d1r) AS INT) + CAST(d0r IN (d1d, d1r) AS INT) AS n12,
    CASE WHEN body2 IS NULL THEN NULL ELSE CAST(d0d IN (d2d, d2r) AS INT) + CAST(d0r IN (d2d, d2r) AS INT) END AS n13,
    CASE WHEN body2 IS NULL THEN NULL ELSE CAST(d1d IN (d2d, d2r) AS INT) + CAST(d1r IN (d2d, d2r) AS INT) END AS n23,
    CASE WHEN d0d IN (d1d, d1r) THEN d0d WHEN d0r IN (d1d, d1r) THEN d0r END AS c12f,
    CASE WHEN d0d IN (d2d, d2r) THEN d0d WHEN d0r IN (d2d, d2r) THEN d0r END AS c13f,
    CASE WHEN d1d IN (d2d, d2r) THEN d1d WHEN d1r IN (d2d, d2r) THEN d1r END AS c23f,
    CASE WHEN d0d IN (d1d, d1r) AND d0d IN (d2d, d2r) THEN d0d
         WHEN d0r IN (d1d, d1r) AND d0r IN (d2d, d2r) THEN d0r END AS c123f
  FROM {name}_a),
{name} AS (
  SELECT *,
    CASE WHEN body2 IS NULL THEN (CASE WHEN n12 = 2 THEN 'P2' ELSE 'P2_none' END)
         WHEN n12 = 2 AND n13 = 2 THEN 'S1'
         WHEN n23 = 0 THEN (CASE WHEN n12 = 0 AND n13 = 0 THEN 'S8' ELSE 'S6' END)
         WHEN n12 = 0 OR n13 = 0 THEN 'S7'
         WHEN n12 = 2 THEN 'S2'
         WHEN n13 = 2 THEN 'S3'
         WHEN n23 = 1 THEN (CASE WHEN c12f = c13f THEN 'S4_star' ELSE 'S4_triangle' END)
         ELSE (CASE WHEN d1d = c12f THEN 'S5a' ELSE 'S5b' END) END AS pj,
    CASE WHEN body2 IS NULL THEN (CASE WHEN n12 > 0 THEN 'M4' ELSE 'M4_none' END)
         WHEN n12 = 1 AND n13 = 1 AND n23 = 1 THEN 'M1'
         WHEN n12 = 2 AND n13 = 2 AND n23 = 2 THEN 'M2'
         WHEN c123f IS NULL THEN 'M3d'
         WHEN n12 = 2 THEN 'M3a'
         WHEN n23 = 2 THEN 'M3b'
         ELSE 'M3c' END AS pb
  FROM {name}_b)"""


def _ratio(p: str, q: str) -> str:
    return (f"(CASE WHEN COALESCE({q}, 0) = 0 THEN 0.0 ELSE CAST(((20000 * CAST({p} AS HUGEINT) + {q}) "
            f"// (2 * CAST({q} AS HUGEINT))) AS DOUBLE) / 10000.0 END)")


def _val(side: str, c: str, cls: str) -> str:
    """Value of a side row (read at its first class ``cls``) at class ``c``."""
    return f"(CASE WHEN {c} = {cls} THEN {side}.key ELSE {side}.other END)"


def join_scores(rules: str, name: str = "js") -> str:
    """CTEs scoring the classified ``rules`` with the join measure (literal joins)."""
    return f"""{name}_sup AS (
  SELECT head, body1, body2, count(*) AS v FROM (
    SELECT r.head, r.body1, r.body2 FROM {rules} r
      JOIN side s0 ON s0.property = r.head AND s0.cls = r.d0d
      JOIN side s1 ON s1.property = r.body1 AND s1.cls = r.d0d AND s1.key = s0.key AND s1.other = s0.other
      WHERE r.pj = 'P2'
    UNION ALL SELECT r.head, r.body1, r.body2 FROM {rules} r
      JOIN side s0 ON s0.property = r.head AND s0.cls = r.d0d
      JOIN side s1 ON s1.property = r.body1 AND s1.cls = r.d0d AND s1.key = s0.key AND s1.other = s0.other
      JOIN side s2 ON s2.property = r.body2 AND s2.cls = r.d0r AND s2.key = s0.other
      WHERE r.pj = 'S1'
    UNION ALL SELECT r.head, r.body1, r.body2 FROM {rules} r
      JOIN side s0 ON s0.property = r.head AND s0.cls = r.d0d
      JOIN side s1 ON s1.property = r.body1 AND s1.cls = r.d0d AND s1.key = s0.key AND s1.other = s0.other
      JOIN side s2 ON s2.property = r.body2 AND s2.cls = r.c13f AND s2.key = {_val('s0', 'r.c13f', 'r.d0d')}
      WHERE r.pj = 'S2'
    UNION ALL SELECT r.head, r.body1, r.body2 FROM {rules} r
      JOIN side s0 ON s0.property = r.head AND s0.cls = r.d0d
      JOIN side s2 ON s2.property = r.body2 AND s2.cls = r.d0d AND s2.key = s0.key AND s2.other = s0.other
      JOIN side s1 ON s1.property = r.body1 AND s1.cls = r.c12f AND s1.key = {_val('s0', 'r.c12f', 'r.d0d')}
      WHERE r.pj = 'S3'
    UNION ALL SELECT r.head, r.body1, r.body2 FROM {rules} r
      JOIN side s0 ON s0.property = r.head AND s0.cls = r.c12f
      JOIN side s1 ON s1.property = r.body1 AND s1.cls = r.c12f AND s1.key = s0.key
      JOIN side s2 ON s2.property = r.body2 AND s2.cls = r.c12f AND s2.key = s0.key
      WHERE r.pj IN ('S4_star', 'S5a')
    UNION ALL SELECT r.head, r.body1, r.body2 FROM {rules} r
      JOIN side s1 ON s1.property = r.body1 AND s1.cls = r.d1d
      JOIN side s2 ON s2.property = r.body2 AND s2.cls = r.d1d AND s2.key = s1.key AND s2.other = s1.other
      JOIN side s0 ON s0.property = r.head AND s0.cls = r.c12f AND s0.key = {_val('s1', 'r.c12f', 'r.d1d')}
      WHERE r.pj = 'S5b'
    UNION ALL SELECT r.head, r.body1, r.body2 FROM {rules} r
      JOIN side s0 ON s0.property = r.head AND s0.cls = r.c12f
      JOIN side s1 ON s1.property = r.body1 AND s1.cls = r.c12f AND s1.key = s0.key
      JOIN side s2 ON s2.property = r.body2 AND s2.cls = r.c13f AND s2.key = s0.other AND s2.other = s1.other
      WHERE r.pj = 'S4_triangle'
    UNION ALL SELECT r.head, r.body1, r.body2 FROM {rules} r
      JOIN side s0 ON s0.property = r.head AND s0.cls = r.c12f
      JOIN side s1 ON s1.property = r.body1 AND s1.cls = r.c12f AND s1.key = s0.key
      JOIN side s2 ON s2.property = r.body2 AND s2.cls = r.c13f AND s2.key = s0.other
      WHERE r.pj = 'S6' AND r.n12 = 1 AND r.n13 = 1
    UNION ALL SELECT r.head, r.body1, r.body2 FROM {rules} r
      JOIN side s0 ON s0.property = r.head AND s0.cls = r.d0d
      JOIN side s1 ON s1.property = r.body1 AND s1.cls = r.d0d AND s1.key = s0.key AND s1.other = s0.other
      JOIN side s2 ON s2.property = r.body2 AND s2.cls = r.d2d
      WHERE r.pj = 'S6' AND r.n12 = 2 AND r.n13 = 0
    UNION ALL SELECT r.head, r.body1, r.body2 FROM {rules} r
      JOIN side s0 ON s0.property = r.head AND s0.cls = r.d0d
      JOIN side s2 ON s2.property = r.body2 AND s2.cls = r.d0d AND s2.key = s0.key AND s2.other = s0.other
      JOIN side s1 ON s1.property = r.body1 AND s1.cls = r.d1d
      WHERE r.pj = 'S6' AND r.n13 = 2 AND r.n12 = 0
    UNION ALL SELECT r.head, r.body1, r.body2 FROM {rules} r
      JOIN side s0 ON s0.property = r.head AND s0.cls = r.c12f
      JOIN side s1 ON s1.property = r.body1 AND s1.cls = r.c12f AND s1.key = s0.key
      JOIN side s2 ON s2.property = r.body2 AND s2.cls = r.d2d
      WHERE r.pj = 'S6' AND r.n12 = 1 AND r.n13 = 0
    UNION ALL SELECT r.head, r.body1, r.body2 FROM {rules} r
      JOIN side s0 ON s0.property = r.head AND s0.cls = r.c13f
      JOIN side s2 ON s2.property = r.body2 AND s2.cls = r.c13f AND s2.key = s0.key
      JOIN side s1 ON s1.property = r.body1 AND s1.cls = r.d1d
      WHERE r.pj = 'S6' AND r.n13 = 1 AND r.n12 = 0
  ) GROUP BY head, body1, body2),
{name}_den AS (
  SELECT r.head, r.body1, r.body2, count(*) AS v FROM {rules} r
    JOIN side s1 ON s1.property = r.body1 AND s1.cls = (CASE WHEN r.pj = 'S1' THEN r.d0r ELSE r.c23f END)
    JOIN side s2 ON s2.property = r.body2 AND s2.cls = s1.cls AND s2.key = s1.key
    WHERE r.body2 IS NOT NULL AND r.pj NOT IN ('S6', 'S8')
    GROUP BY r.head, r.body1, r.body2),
{name} AS (
  SELECT r.head, r.body1, r.body2, r.pj AS pattern,
    CAST(COALESCE(sp.v, 0) AS BIGINT) AS support,
    CAST(CASE WHEN r.body2 IS NULL THEN COALESCE(b1.n, 0) ELSE COALESCE(dn.v, 0) END AS BIGINT) AS body_size,
    CAST(COALESCE(h.n, 0) AS BIGINT) AS head_size
  FROM {rules} r
  LEFT JOIN {name}_sup sp ON sp.head = r.head AND sp.body1 = r.body1 AND sp.body2 IS NOT DISTINCT FROM r.body2
  LEFT JOIN {name}_den dn ON dn.head = r.head AND dn.body1 = r.body1 AND dn.body2 IS NOT DISTINCT FROM r.body2
  LEFT JOIN sizes h ON h.property = r.head
  LEFT JOIN sizes b1 ON b1.property = r.body1)"""


def binding_scores(rules: str, name: str = "bs", one_object: bool = False) -> str:
    """CTEs scoring the classified ``rules`` with the binding measure (set intersections)."""
    btf = ("SELECT property, dom, ran, subject, max(object) AS object FROM tf "
           "GROUP BY property, dom, ran, subject") if one_object else "SELECT * FROM tf"
    return f"""{name}_tf AS ({btf}),
{name}_side AS (SELECT property, dom AS cls, subject AS key, object AS other FROM {name}_tf
          UNION ALL SELECT property, ran AS cls, object AS key, subject AS other FROM {name}_tf),
{name}_col AS (SELECT DISTINCT property, cls, key FROM {name}_side),
{name}_r AS (
  SELECT *,
    CASE WHEN pb = 'M2' THEN d0r WHEN pb IN ('M3a', 'M3b', 'M3c') THEN c123f WHEN pb = 'M4' THEN c12f END AS kall,
    CASE WHEN pb = 'M3c' THEN body2 ELSE body1 END AS oa
  FROM {rules}),
{name}_k AS (
  SELECT *, CASE WHEN pb = 'M1' THEN c12f ELSE kall END AS k0,
            CASE WHEN pb = 'M1' THEN c23f ELSE kall END AS k1,
            CASE WHEN pb = 'M1' THEN c13f ELSE kall END AS k2
  FROM {name}_r WHERE pb IN ('M1', 'M2', 'M3a', 'M3b', 'M3c', 'M4')),
{name}_v AS (
  SELECT r.head, r.body1, r.body2, c0.key FROM {name}_k r
    JOIN {name}_col c0 ON c0.property = r.head AND c0.cls = r.k0
    JOIN {name}_col c1 ON c1.property = r.body1 AND c1.cls = r.k1 AND c1.key = c0.key
    WHERE r.body2 IS NULL
  UNION ALL
  SELECT r.head, r.body1, r.body2, c0.key FROM {name}_k r
    JOIN {name}_col c0 ON c0.property = r.head AND c0.cls = r.k0
    JOIN {name}_col c1 ON c1.property = r.body1 AND c1.cls = r.k1 AND c1.key = c0.key
    JOIN {name}_col c2 ON c2.property = r.body2 AND c2.cls = r.k2 AND c2.key = c0.key
    WHERE r.body2 IS NOT NULL),
{name}_vn AS (SELECT head, body1, body2, count(*) AS v FROM {name}_v GROUP BY head, body1, body2),
{name}_oo AS (
  SELECT head, body1, body2, count(*) AS v FROM (
    SELECT v.head, v.body1, v.body2, s.other FROM {name}_v v
      JOIN {name}_k r ON r.head = v.head AND r.body1 = v.body1 AND r.body2 IS NOT DISTINCT FROM v.body2
      JOIN {name}_side s ON s.property = r.head AND s.cls = r.kall AND s.key = v.key
      WHERE r.pb IN ('M2', 'M3a', 'M3c', 'M4')
    INTERSECT
    SELECT v.head, v.body1, v.body2, s.other FROM {name}_v v
      JOIN {name}_k r ON r.head = v.head AND r.body1 = v.body1 AND r.body2 IS NOT DISTINCT FROM v.body2
      JOIN {name}_side s ON s.property = r.oa AND s.cls = r.kall AND s.key = v.key
      WHERE r.pb IN ('M2', 'M3a', 'M3c', 'M4')
  ) GROUP BY head, body1, body2),
{name}_den AS (
  SELECT r.head, r.body1, r.body2, count(*) AS v FROM {name}_k r
    JOIN {name}_col c1 ON c1.property = r.body1 AND c1.cls = r.k1
    JOIN {name}_col c2 ON c2.property = r.body2 AND c2.cls = r.k2 AND c2.key = c1.key
    WHERE r.body2 IS NOT NULL GROUP BY r.head, r.body1, r.body2),
{name} AS (
  SELECT r.head, r.body1, r.body2, r.pb AS pattern,
    CAST(CASE WHEN r.pb IN ('M1', 'M3b') THEN COALESCE(vn.v, 0)
              WHEN r.pb IN ('M2', 'M3a', 'M3c', 'M4') THEN COALESCE(oo.v, 0) ELSE 0 END AS BIGINT) AS support,
    CAST(CASE WHEN r.body2 IS NULL THEN COALESCE(b1.n, 0)
              WHEN COALESCE(dn.v, 0) = 0 THEN 1 ELSE dn.v END AS BIGINT) AS body_size,
    CAST(COALESCE(h.n, 0) AS BIGINT) AS head_size
  FROM {name}_r r
  LEFT JOIN {name}_vn vn ON vn.head = r.head AND vn.body1 = r.body1 AND vn.body2 IS NOT DISTINCT FROM r.body2
  LEFT JOIN {name}_oo oo ON oo.head = r.head AND oo.body1 = r.body1 AND oo.body2 IS NOT DISTINCT FROM r.body2
  LEFT JOIN {name}_den dn ON dn.head = r.head AND dn.body1 = r.body1 AND dn.body2 IS NOT DISTINCT FROM r.body2
  LEFT JOIN sizes h ON h.property = r.head
  LEFT JOIN sizes b1 ON b1.property = r.body1)"""


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


BASE = (FACTS, SCHEMA, SIZES, TYPED, SIDE, TYPED_WF)


def _score_select(src: str) -> str:
    return (f"SELECT head, body1, body2, CAST(support AS VARCHAR) AS support, CAST(body_size AS VARCHAR) AS body_size, head_size, "
            f"{_ratio('support', 'body_size')} AS conf, {_ratio('support', 'head_size')} AS head_coverage "
            f"FROM {src}")


ATOM_TXT = ("atxt AS (SELECT property, name || '(' || regexp_extract(dom, '#([^#>]*)', 1) || ',' || "
            "regexp_extract(ran, '#([^#>]*)', 1) || ')' AS txt FROM schema)")


def _rules_tail(scored: str) -> str:
    """CTEs thresholds -> canonical bodies -> dedupe -> text, ending in CTE ``rules``."""
    return f"""kept AS (
  SELECT s.*, {_ratio('support', 'body_size')} AS conf, {_ratio('support', 'head_size')} AS fitness FROM {scored} s),
kept2 AS (SELECT * FROM kept WHERE conf >= 0.1 AND fitness >= 0.01),
txt AS (
  SELECT k.head, k.body1, k.body2, k.conf, k.fitness, th.txt AS ht, t1.txt AS t1, t2.txt AS t2 FROM kept2 k
  LEFT JOIN atxt th ON th.property = k.head LEFT JOIN atxt t1 ON t1.property = k.body1
  LEFT JOIN atxt t2 ON t2.property = k.body2),
canon AS (
  SELECT head, conf, fitness, ht,
    CASE WHEN body2 IS NOT NULL AND (t1 < t2 OR (t1 = t2 AND body1 < body2)) THEN body2 ELSE body1 END AS body1,
    CASE WHEN body2 IS NOT NULL AND (t1 < t2 OR (t1 = t2 AND body1 < body2)) THEN body1 ELSE body2 END AS body2,
    CASE WHEN body2 IS NOT NULL AND (t1 < t2 OR (t1 = t2 AND body1 < body2)) THEN t2 ELSE t1 END AS t1,
    CASE WHEN body2 IS NOT NULL AND (t1 < t2 OR (t1 = t2 AND body1 < body2)) THEN t1 ELSE t2 END AS t2
  FROM txt),
rules AS (
  SELECT DISTINCT head, body1, body2, conf, fitness,
    ht || ' <= ' || t1 || (CASE WHEN body2 IS NULL THEN '' ELSE ' ^ ' || t2 END) || ' ' ||
    CAST(conf AS VARCHAR) || ' ' || CAST(fitness AS VARCHAR) AS rule
  FROM canon)"""


def oracles() -> dict[str, str]:
    q: dict[str, str] = {}
    base = _with(*BASE)
    def named(c: str) -> str:
        return (f"CASE WHEN length({c}) % 3 = 2 AND regexp_full_match({c}, '[A-Za-z0-9_.-]+') THEN '_:' || {c} "
                f"ELSE '<{NS}' || {c} || '>' END")

    iri_s, iri_o = named("subject"), named("object")
    facts_of = "CAST(COALESCE(z.n, 0) AS BIGINT) AS n_facts"
    q["axioms_roundtrip"] = _with(FACTS) + (
        f"SELECT property, {iri_s} AS subject, {iri_o} AS object FROM facts")
    q["domain_range_axioms"] = _with(FACTS, SIZES, DECLS) + (
        f"SELECT d.axiom_type, d.property, d.cls, {facts_of} FROM decls d LEFT JOIN sizes z ON z.property = d.property")
    q["property_schema"] = _with(FACTS, SCHEMA, SIZES) + (
        "SELECT s.property, s.name, s.dom, s.ran, z.n FROM schema s JOIN sizes z ON z.property = s.property")
    q["schema_drops_union_and_same_class"] = _with(FACTS, SIZES, DECLS) + """,
cs AS (SELECT property, axiom_type, cls FROM decls),
agg AS (SELECT property,
          count(DISTINCT cls) AS n_classes,
          bool_or(cls LIKE '%ObjectUnionOf%') AS has_union,
          bool_or(axiom_type = 'ObjectPropertyDomain') AS has_dom,
          bool_or(axiom_type = 'ObjectPropertyRange') AS has_ran
        FROM cs GROUP BY property)
SELECT a.property, regexp_extract(a.property, '#([^#>]*)', 1) AS name, CAST(n_classes AS BIGINT) AS n_classes,
  (n_classes = 2 AND NOT has_union) AS kept,
  CASE WHEN n_classes <> 2 THEN 'class_count' WHEN has_union THEN 'union' END AS reason,
  CAST(COALESCE(z.n, 0) AS BIGINT) AS n_facts
FROM agg a LEFT JOIN sizes z ON z.property = a.property WHERE has_dom AND has_ran"""
    q["vertical_partition"] = _with(FACTS) + (
        "SELECT property, subject, object, count(*) AS n FROM facts GROUP BY property, subject, object")
    q["axioms_two_files"] = _with(FACTS) + (
        "SELECT '<http://' || CASE WHEN length(subject || object) % 2 = 1 THEN 'b' ELSE 'a' END || '#' || "
        "regexp_extract(property, '#([^>]*)>', 1) || '>' AS property, count(*) AS n FROM facts GROUP BY 1 "
        "UNION ALL VALUES ('MalformedObjectPropertyAssertion', 2), ('MalformedObjectPropertyDomain', 1)")
    q["property_sizes"] = _with(FACTS) + "SELECT property, count(*) AS n FROM facts GROUP BY property"
    q["triple_sets"] = _with(FACTS) + "SELECT DISTINCT property, subject, object FROM facts"
    q["degrees"] = base + "SELECT property, cls, key, count(*) AS n FROM side GROUP BY property, cls, key"
    cl_base = _with(*BASE, CLUSTERS)
    for kind in ("domain", "range", "domain_range"):
        q[f"clusters_{kind}"] = cl_base + (
            f"SELECT kind, cluster_id, members, n_members FROM clusters WHERE kind = '{kind}'")
    q["clusters_all"] = cl_base + "SELECT kind, cluster_id, members, n_members FROM clusters"
    q["clusters_minhash"] = cl_base + "SELECT kind, members, n_members FROM clusters"
    for n, buckets in BUCKETS.items():
        slots = "slot(cls, b) AS (VALUES " + ", ".join(f"({_q(_iri(c))}, {b})" for c, b in buckets.items()) + ")"
        q[f"clusters_minhash_{n}"] = _with(*BASE, slots) + """,
skeys AS (SELECT t.property, d.b AS db, r.b AS rb FROM tschema t JOIN slot d ON d.cls = t.dom JOIN slot r ON r.cls = t.ran),
sets AS (SELECT 'domain_range' AS kind, property, least(db, rb) AS lo, greatest(db, rb) AS hi FROM skeys
  UNION ALL SELECT 'domain', property, db, db FROM skeys UNION ALL SELECT 'range', property, rb, rb FROM skeys)
SELECT kind, string_agg(property, ',' ORDER BY property) AS members, count(*) AS n_members
FROM sets GROUP BY kind, lo, hi HAVING count(*) >= 3"""
    q["similar_pairs"] = _with(*BASE, CLUSTERS.split(",\nclusters AS")[0]) + (
        "SELECT a.kind, a.property AS id1, b.property AS id2 FROM ckeys a JOIN ckeys b "
        "ON a.kind = b.kind AND a.cluster_id = b.cluster_id AND a.property <> b.property")
    q["candidates_2"] = _with(*BASE, CLUSTERS, CAND2) + "SELECT head, body1, body2 FROM cand2"
    q["candidates_3"] = _with(*BASE, CLUSTERS, CAND3) + "SELECT head, body1, body2 FROM cand3"
    q["class_overlap"] = _with(*BASE, CLUSTERS, CAND3) + """,
pairs AS (SELECT head AS p, body1 AS q FROM cand3 UNION SELECT head, body2 FROM cand3 UNION SELECT body1, body2 FROM cand3),
ov AS (SELECT pr.p, pr.q, sp.dom AS pd, sp.ran AS pr_, sq.dom AS qd, sq.ran AS qr FROM pairs pr
       JOIN schema sp ON sp.property = pr.p JOIN schema sq ON sq.property = pr.q)
SELECT p, q,
  concat_ws(',', CASE WHEN pd IN (qd, qr) THEN regexp_extract(pd, '#([^#>]*)', 1) END,
                 CASE WHEN pr_ IN (qd, qr) THEN regexp_extract(pr_, '#([^#>]*)', 1) END) AS classes,
  CAST(CAST(pd IN (qd, qr) AS INT) + CAST(pr_ IN (qd, qr) AS INT) AS BIGINT) AS n_classes
FROM ov"""
    q["candidates_classified"] = _with(*BASE, CLUSTERS, CAND3, CONN3) + ",\nallc AS (SELECT * FROM conn3 UNION SELECT * FROM cand3),\n" + classify("allc") + (
        "\nSELECT head, body1, body2, pj AS pattern_join, pb AS pattern_binding FROM cl")

    score_cols = ("SELECT head, body1, body2, CAST(support AS VARCHAR) AS support, CAST(body_size AS VARCHAR) AS body_size, head_size, "
                  f"{_ratio('support', 'body_size')} AS conf, {_ratio('support', 'head_size')} AS head_coverage")

    def join_pattern(where: str) -> str:
        return (_with(*BASE, CONN3) + ",\n" + classify("conn3") + f",\nsel AS (SELECT * FROM cl WHERE {where}),\n"
                + join_scores("sel") + f"\n{score_cols} FROM js")

    q["join_s1"] = join_pattern("pj = 'S1'")
    q["join_s2"] = join_pattern("pj = 'S2'")
    q["join_s3"] = join_pattern("pj = 'S3'")
    q["join_star_domain"] = join_pattern("pj IN ('S4_star', 'S5a') AND c12f = d0d")
    q["join_star_range"] = join_pattern("pj IN ('S4_star', 'S5a') AND c12f = d0r")
    q["join_triangle"] = join_pattern("pj = 'S4_triangle'")
    q["join_s5a"] = join_pattern("pj = 'S5a'")
    q["join_s5b"] = join_pattern("pj = 'S5b'")
    q["join_two_atoms"] = (_with(*BASE, CLUSTERS, CAND2) + ",\n" + classify("cand2") + ",\n"
                           + join_scores("cl") + f"\n{score_cols} FROM js")
    q["disconnected_rules"] = (_with(*BASE, CONN3) + """,
path AS (SELECT e1.p AS a, e1.q AS b, e2.q AS c FROM edges e1 JOIN edges e2 ON e2.p = e1.q AND e2.q <> e1.p
         WHERE NOT EXISTS (SELECT 1 FROM edges e3 WHERE e3.p = e1.p AND e3.q = e2.q)),
opn AS (SELECT b AS head, a AS body1, c AS body2 FROM path UNION SELECT a, b, c FROM path
        UNION SELECT a, c, b FROM path),
""" + classify("opn") + ",\n" + join_scores("cl") + (
        "\nSELECT head, body1, body2, pattern, CAST(support AS VARCHAR) AS support, CAST(body_size AS VARCHAR) AS body_size, "
        f"{_ratio('support', 'body_size')} AS conf, {_ratio('support', 'head_size')} AS head_coverage FROM js"))
    q["body_size"] = (_with(*BASE, CLUSTERS, CAND3) + ",\n" + classify("cand3") + ",\n"
                      + join_scores("cl") + "\nSELECT head, body1, body2, CAST(body_size AS VARCHAR) AS body_size FROM js")

    def binding_pattern(where: str, src: str = "conn3", extra=(CONN3,), one_object=False) -> str:
        return (_with(*BASE, *extra) + ",\n" + classify(src) + f",\nsel AS (SELECT * FROM cl WHERE {where}),\n"
                + binding_scores("sel", one_object=one_object) + f"\n{score_cols} FROM bs")

    for pat in ("M1", "M2", "M3a", "M3b", "M3c"):
        q[f"binding_{pat.lower()}"] = binding_pattern(f"pb = '{pat}'")
    q["binding_two_atoms"] = binding_pattern("TRUE", "cand2", (CLUSTERS, CAND2))
    q["binding_one_object"] = binding_pattern("TRUE", "cand3", (CLUSTERS, CAND3), one_object=True)

    join3 = _with(*BASE, CLUSTERS, CAND3, ATOM_TXT) + ",\n" + classify("cand3") + ",\n" + join_scores("cl")
    q["thresholds"] = join3 + (
        f"\nSELECT * FROM (SELECT head, body1, body2, {_ratio('support', 'body_size')} AS conf, "
        f"{_ratio('support', 'head_size')} AS head_coverage FROM js) WHERE conf >= 0.1 AND head_coverage >= 0.01")
    q["dedupe_rules"] = join3 + ",\n" + _rules_tail("js") + (
        "\nSELECT head, body1, body2, conf, fitness FROM rules")
    q["render_rules"] = join3 + ",\n" + _rules_tail("js") + (
        "\nSELECT head, body1, body2, rule FROM rules")

    def mine_sql(atoms: int, measure: str) -> str:
        cand = "cand3" if atoms == 3 else "cand2"
        cte = CAND3 if atoms == 3 else CAND2
        scorer = join_scores("cl") if measure == "join" else binding_scores("cl")
        out = "js" if measure == "join" else "bs"
        return (_with(*BASE, CLUSTERS, cte, ATOM_TXT) + ",\n" + classify(cand) + ",\n" + scorer + ",\n"
                + _rules_tail(out) + "\nSELECT head, body1, body2, conf, fitness, rule FROM rules")

    q["mine_join_2"] = mine_sql(2, "join")
    q["mine_join_3"] = mine_sql(3, "join")
    q["mine_binding_2"] = mine_sql(2, "binding")
    q["mine_binding_3"] = mine_sql(3, "binding")
    q["mine_from_axioms"] = q["mine_from_store"] = q["mine_join_3"]
    names = ", ".join(_q(_iri(n)) for n in PRUNED)
    q["store_pruned_read"] = _with(FACTS) + f"SELECT property, subject, object FROM facts WHERE property IN ({names})"
    q["store_manifest"] = _with(FACTS) + (
        "SELECT property, n, CASE WHEN d < n THEN d END AS n_distinct FROM (SELECT property, count(*) AS n, "
        "count(DISTINCT (subject, object)) AS d FROM facts GROUP BY property)")
    q["views_join"] = _with(FACTS) + f"""SELECT c.nation, c.n AS customers, s.n AS suppliers
FROM (SELECT object AS nation, count(DISTINCT subject) AS n FROM facts WHERE property = '{_iri("customerIn")}' GROUP BY object) c
JOIN (SELECT object AS nation, count(DISTINCT subject) AS n FROM facts WHERE property = '{_iri("supplierIn")}' GROUP BY object) s
  ON c.nation = s.nation"""
    q["partitioned_sizes"] = _with(FACTS, SIZES) + (
        "SELECT property, n, dealt FROM sizes, (VALUES ('hash'), ('round'), ('range')) AS t(dealt)")
    apart = "apart(head, body1, body2) AS (VALUES " + ", ".join(
        "(" + ", ".join(_q(_iri(n)) for n in r) + ")" for r in APART) + ")"
    for measure, scores, out in (("join", join_scores, "js"), ("binding", binding_scores, "bs")):
        q[f"{measure}_apart"] = (_with(*BASE, apart) + ",\n" + classify("apart") + ",\n" + scores("cl") + (
            "\nSELECT head, body1, body2, pattern, CAST(support AS VARCHAR) AS support, CAST(body_size AS VARCHAR) AS body_size, head_size, "
            f"{_ratio('support', 'body_size')} AS conf, {_ratio('support', 'head_size')} AS head_coverage FROM {out}"))
    q["store_roundtrip"] = _with(FACTS) + "SELECT property, subject, object FROM facts"
    return q
