"""Brute-force versions of both measures over Python sets (test oracle).

Rows are dicts ``{class: value}``; a property's table is its set of distinct
facts. Written from the measure definitions, independently of the library.
"""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal
from itertools import product


def r4(p: int, q: int, zero: float = 0.0) -> float:
    if q == 0:
        return zero
    return float(Decimal(repr(p / q)).quantize(Decimal("0.0001"), rounding=ROUND_HALF_UP))


def overlap(a, b):
    return [c for c in a if c in b]


def join_measure(tables, bags, schema, rule):
    """(support, body_size) of a rule with the join measure."""
    if len(rule) == 2:
        h, b = rule
        d0, d1 = schema[h], schema[b]
        c12 = overlap(d0, d1)
        if len(c12) != 2:
            return 0, bags[b]
        s = sum(1 for x, y in product(tables[h], tables[b]) if all(x[c] == y[c] for c in c12))
        return s, bags[b]
    h, b1, b2 = rule
    d = [schema[h], schema[b1], schema[b2]]
    c12, c13, c23 = overlap(d[0], d[1]), overlap(d[0], d[2]), overlap(d[1], d[2])
    conds = []
    zero = False
    if len(c12) == 2 and len(c13) == 2:
        j = c12[0]
        rest = [c for c in c12 if c != j][0]
        c23 = [c for c in c23 if c != j]
        conds = [(0, 1, rest), (1, 2, c23[0]), (0, 2, rest), (0, 1, j)]
    else:
        conds += [(0, 1, c) for c in c12]
        conds += [(0, 2, c) for c in c13]
        if c23:
            if c12 and c13:
                conds.append((1, 2, c23[0]))
            else:
                zero = True
        if not conds:
            zero = True
    rows = [tables[h], tables[b1], tables[b2]]
    supp = 0 if zero else sum(
        1 for t in product(*rows) if all(t[i][c] == t[k][c] for i, k, c in conds))
    den = 0
    if c23:
        c = c23[0]
        den = sum(1 for x, y in product(rows[1], rows[2]) if x[c] == y[c])
    return supp, den


def col(table, c):
    return {r[c] for r in table}


def other(table, c, vals, schema_p):
    o = [x for x in schema_p if x != c][0]
    return {r[o] for r in table if r[c] in vals}


def binding_measure(tables, bags, schema, rule):
    """(support, body_size) of a rule with the binding measure (0 denominator -> 1)."""
    if len(rule) == 2:
        h, b = rule
        c12 = overlap(schema[h], schema[b])
        if not c12:
            return 0, bags[b]
        k = c12[0]
        v = col(tables[h], k) & col(tables[b], k)
        return len(other(tables[h], k, v, schema[h]) & other(tables[b], k, v, schema[b])), bags[b]
    h, b1, b2 = rule
    d = [schema[h], schema[b1], schema[b2]]
    c12, c13, c23 = overlap(d[0], d[1]), overlap(d[0], d[2]), overlap(d[1], d[2])
    t = [tables[h], tables[b1], tables[b2]]
    if len(c12) == len(c13) == len(c23) == 1:
        supp = len(col(t[0], c12[0]) & col(t[1], c23[0]) & col(t[2], c13[0]))
        den = len(col(t[1], c23[0]) & col(t[2], c13[0]))
    elif len(c12) == len(c13) == len(c23) == 2:
        x = d[0][1]
        v = col(t[0], x) & col(t[1], x) & col(t[2], x)
        supp = len(other(t[0], x, v, d[0]) & other(t[1], x, v, d[1]))
        den = len(col(t[1], x) & col(t[2], x))
    else:
        common = [c for c in c12 if c in c23 and c in c13]
        if not common:
            return 0, 1
        k = common[0]
        v = col(t[0], k) & col(t[1], k) & col(t[2], k)
        if len(c12) == 2:
            supp = len(other(t[0], k, v, d[0]) & other(t[1], k, v, d[1]))
        elif len(c23) == 2:
            supp = len(v)
        else:
            supp = len(other(t[0], k, v, d[0]) & other(t[2], k, v, d[2]))
        den = len(col(t[1], k) & col(t[2], k))
    return supp, den if den else 1
