"""Prefix trie, lexical scan and decontamination against brute force, with nulls, ties, repeats, empty tables and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from hornbeam.llm import decontaminate, lexical_scan
from hornbeam.llm.prefix_trie import Slots, ends_digest, prefix_trie
from hornbeam.llm.queries import rebuilt_conversations

DOCS = "doc_id long, text string, n_words string, item string, row string"


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def frame(spark, rows, schema, parts=3):
    return spark.createDataFrame(rows, schema).repartition(parts)


# -- prefix trie

def test_slots_are_minimal_and_verified():
    r = np.random.default_rng(1)
    for n in (0, 1, 7, 5000):
        a, b = (r.integers(0, 1 << 63, n, np.uint64) for _ in range(2))
        b[: n // 2] = 5  # keys that differ in one word only
        s = Slots(a, b)
        assert sorted(s.look_up(a, b).tolist()) == list(range(n))
        assert (s.look_up(a, b + np.uint64(1)) == -1).all()
    with pytest.raises(ValueError, match="repeat"):
        Slots(np.array([3, 3], np.uint64), np.array([4, 4], np.uint64))


def brute_trie(turns):
    """Nodes of rebuilt conversations: prefix -> (conv, depth, parent conv, members, children, leaves, saved, ends)."""
    def key(role, text):
        parts = "".join(f"{len((x or '').encode())}:{x or ''}" for x in (role, text))
        return hashlib.sha256(parts.encode()).digest()[:16]

    own = defaultdict(list)
    for c, t, role, text in turns:
        if c is not None:
            own[c].append((t is not None, t or 0, key(role, text), len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(math.fmod(c, 20))
        built[c] = own.get(base, [])[:h] + own[c][h:]
    members, words = defaultdict(list), {}
    for c, steps in built.items():
        for d in range(len(steps) + 1):
            p = tuple(x[0] for x in steps[:d])
            members[p].append(c)
            words[p] = steps[d - 1][1] if d else 0
    kids = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p in members:
        for d in range(len(p) + 1):
            leaves[p[:d]] += kids[p] == 0
            saved[p[:d]] += (len(members[p]) - 1) * words[p]
    return Counter((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p],
                    hashlib.sha256(",".join(str(c) for c in sorted(m) if len(built[c]) == len(p)).encode()).hexdigest()) for p, m in members.items())


def random_turns(seed):
    r = random.Random(seed)
    out = []
    for c in [*range(-25, 90), 10**12, 10**12 + 7]:
        for t in range(r.choice([1, 2, 2, 3, 5, 9])):
            out.append((c, r.choice([t, t, t, None]), r.choice(["user", "user", None, ""]), r.choice(["hi", "hi", "hi there", None, "", "é ü", "a  b\tc"]), "x", "y"))
    out += [(400, t, "user", "same " * (t % 7), "x", "y") for t in range(300)]  # a long one, and copies of it
    out += [(c, t, "user", "same " * (t % 7), "x", "y") for c in (401, 402) for t in range(300)]
    out += [out[0], out[0], (None, 1, "user", "nobody", "x", "y"), (77, 0, "user", "w " * 100_000, "x", "y")]
    return out


@pytest.mark.parametrize("limits", [{}, {"max_top": 1 << 19, "min_hot": 3, "shard_nodes": 20}, {"max_top": 40, "min_hot": 1}])
def test_prefix_trie(spark, limits):
    turns = random_turns(3)
    table = frame(spark, turns, "conv_id long, turn long, role string, text string, conv string, depth string")
    nodes, ends = prefix_trie(rebuilt_conversations(table), **limits)
    got = nodes.join(ends_digest(ends, block_bits=2), ["n1", "n2"], "left").select(
        "conv", "depth", "parent_conv", "n_convs", "n_children", "n_leaves", "saved", F.coalesce("sha", F.sha2(F.lit(""), 256))).collect()
    assert Counter(tuple(x) for x in got) == brute_trie([x[:4] for x in turns])


def test_prefix_trie_edges(spark):
    empty = frame(spark, [], "conv_id long, turn long, role string, text string")
    nodes, ends = prefix_trie(rebuilt_conversations(empty))
    assert nodes.count() == 0 and ends.count() == 0
    # h of 3 is 2 and there is no conversation 0: turnless, so only the root is left
    assert zlib.crc32(b"3") % 4 in (1, 2, 3)
    nodes, _ = prefix_trie(rebuilt_conversations(frame(spark, [(3, 0, "user", "x")], "conv_id long, turn long, role string, text string")))
    assert [(r.depth, r.n_convs, r.n_children, r.n_leaves, r.saved) for r in nodes.collect()] == [(0, 1, 0, 1, 0)]


# -- lexical scan

def brute_search(docs, items, k):
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    held = [(i, Counter(term.findall(fold(t)))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    texts, total = len(held), sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    want = defaultdict(Counter)
    for i, t in items:
        want[i].update(term.findall(fold(t)))
    for i, terms in want.items():
        rows = []
        for doc, c, n in held:
            m = 25 + 75 * n * texts // total
            score = sum(r * math.floor(1000 * math.log((2 * texts + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                        for t, r in terms.items() if t in c)
            if score > 0:
                rows.append((-score, doc is None, doc))
        out += [(i, rank, doc, -s) for rank, (s, _, doc) in enumerate(sorted(rows)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("max_term_bytes", [None, 60])
def test_search(spark, max_term_bytes, monkeypatch):
    monkeypatch.setattr(lexical_scan, "PIECE", 64)  # pieces end within texts
    r = random.Random(5)
    words = ["one", "two", "THREE", "four4", "é", "Éa", "ünd", "x" * 70, "the", "the", "the", "日本"]
    def text(n):
        return "".join(r.choice(words) + r.choice([" ", ", ", "\n", "-", "\x00", "_", "@"]) for _ in range(n))
    docs = [(i, text(r.randint(0, 40))) for i in range(120)] + [(200, None), (201, ""), (202, "-- !"), (7, "one two"), (7, "one two"), (None, "one two"),
                                                                (300, "y" * 500 + " one " + "z" * 500), (301, "long one " * 30_000)]
    items = [(k, text(r.randint(1, 9))) for k in range(9)] + [(50, None), (51, ""), (52, "nowhere"), (53, "é é one"), (1, "one more"), (None, "two four4"), (54, "x" * 70)]
    got = lexical_scan.search(frame(spark, [(*d, "c", "c", "c") for d in docs], DOCS), frame(spark, items, "item_id long, text string"), 10,
                              max_term_bytes=max_term_bytes).collect()
    assert sorted((tuple(x) for x in got), key=str) == brute_search(docs, items, 10)


def test_search_edges(spark):
    docs, items = frame(spark, [(1, "a b")], "doc_id long, text string"), frame(spark, [("q", "b")], "item_id string, text string")
    assert [tuple(x) for x in lexical_scan.search(docs, items).collect()][0][:3] == ("q", 1, 1)
    for d, i in ((docs.where("false"), items), (docs, items.where("false")), (docs.withColumn("text", F.lit("!")), items)):
        assert lexical_scan.search(d, i).columns == ["item", "rank", "doc", "score"] and lexical_scan.search(d, i).count() == 0


# -- decontamination

def brute_leaks(docs, items, window):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    wins = defaultdict(set)
    for i, t in items:
        w = word.findall(fold(t))
        for s in range(max(len(w) - window, 0) + 1 if w else 0):
            wins[tuple(w[s:s + window])].add(i)
    out = []
    for doc, t in docs:
        w = word.findall(fold(t))
        hit, found = set(), set()
        for k in {len(x) for x in wins}:
            for s in range(len(w) - k + 1):
                if tuple(w[s:s + k]) in wins:
                    hit |= set(range(s, s + k))
                    found |= wins[tuple(w[s:s + k])]
        spans = []
        for x in sorted(hit):
            if spans and spans[-1][1] == x:
                spans[-1][1] = x + 1
            else:
                spans.append([x, x + 1])
        out.append((doc, len(w), spans, sorted(str(x) for x in found if x is not None)))
    return sorted(out, key=str)


def joined(spans):
    """Ranges that touch count as one (the operator parts windows that lie side by side)."""
    out = []
    for s in spans:
        if out and out[-1][1] == s["first"]:
            out[-1][1] = s["end"]
        else:
            out.append([s["first"], s["end"]])
    return out


@pytest.mark.parametrize("spread", [False, True])
@pytest.mark.parametrize("shingle", [2, 5])
def test_contamination(spark, shingle, spread, monkeypatch):
    if spread:
        monkeypatch.setattr(decontaminate, "fits", lambda df: False)
        monkeypatch.setattr(decontaminate, "MAX_BITS", 64)  # nearly every place passes the bitmap
        monkeypatch.setattr(decontaminate, "MIN_BITS", 64)
    r = random.Random(7)
    vocabulary = ["a", "B", "the", "of", "é", "wörd", "日本"]
    def text(n):
        return "".join(r.choice(vocabulary) + r.choice([" ", " ", ", ", "\n-", "2", "_ "]) for _ in range(n))
    items = [(k, text(r.choice([3, 6, 7, 9, 12, 20]))) for k in range(14)] + [(50, None), (51, "!"), (2, "the of the of a"), (None, "zebra crossing ahead")]
    docs = [(i, text(r.randint(0, 60))) for i in range(60)]
    docs += [(100 + k, text(9) + " " + (items[k][1] or "").upper().replace("É", "é").replace("Ö", "ö") + text(4)) for k in range(14)]
    docs += [(200, None), (201, ""), (202, "- 1 2"), (203, items[5][1] * 3), (203, items[5][1] * 3), (None, items[0][1]),
             (204, "a zebra crossing ahead"), (205, "filler words " * 40_000 + items[9][1])]
    got = decontaminate.contamination(frame(spark, [(*d, "c", "c", "c") for d in docs], DOCS), frame(spark, items, "item_id long, text string"), 6, shingle)
    got = sorted(((x.id, x.n_words, joined(x.spans), x["items"]) for x in got.collect()), key=str)
    assert got == brute_leaks(docs, items, 6)
    assert sum(bool(x[3]) for x in got) > 14


def test_contamination_edges(spark):
    docs, items = frame(spark, [(1, "a b", "", "", "")], DOCS), frame(spark, [(1, "a")], "item_id long, text string")
    assert decontaminate.contamination(docs.where("false"), items).count() == 0
    assert [tuple(x) for x in decontaminate.contamination(docs, items.where("false")).collect()] == [(1, 2, [], [])]
    assert [tuple(x) for x in decontaminate.contamination(docs, frame(spark, [(1, "zz")], "item_id long, text string")).collect()] == [(1, 2, [], [])]
