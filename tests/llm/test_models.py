"""The trained models against plain loops: importance weights, keys and k; gradients by finite differences; pooled scores."""

import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from hornbeam.llm import toxicity
from hornbeam.llm.quality import SLOTS, resample
from hornbeam.llm.textvec import mix64, word_hashes


def grams(text):
    """Slots of words and of pairs of adjacent words, a word said twice in slot 0."""
    words = [int(word_hashes(pa.array([w]))[0][0]) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    pair = lambda a, b: 0 if a == b else int(mix64(np.array([(a * 0x9E3779B97F4A7C15 + b) % 2**64], np.uint64))[0])
    return [x % SLOTS for x in words + [pair(a, b) for a, b in zip(words, words[1:], strict=False)]], len(words)


def log_model(texts):
    counts = [1] * SLOTS
    for t in texts:
        for x in grams(t)[0]:
            counts[x] += 1
    return [math.log(c / sum(counts)) for c in counts]


@pytest.mark.parametrize("keep", [0.3, 0.999])
def test_resample_by_hand(spark, keep):
    r = random.Random(8)
    words = ["the", "The", "of", "buy", "now", "é", "w" * 80, "the the"]
    rows = [(i, " ".join(r.choice(words) for _ in range(r.randint(0, 30)))) for i in range(60)]
    rows += [(5, rows[5][1]), (100, None), (101, ""), (102, " \t\n"), (103, "long text " * 20_000), (None, "the of")]  # repeated, null, long
    good = [i for i in range(60) if i % 4 == 0]
    d = spark.createDataFrame([(*x, 1.0, True) for x in rows], "doc_id long, text string, key double, kept boolean").repartition(3)
    got = resample(d, spark.createDataFrame([(i,) for i in [*good, good[0], 9999]], "id long"), keep=keep).collect()
    assert len(got) == len(rows)
    held = {x: grams(x) for _, x in rows}
    target, raw = log_model(t for i, t in rows if i in good), log_model(t for _, t in rows)
    want = []
    for i, t in rows:
        weight = sum(target[x] - raw[x] for x in held[t][0])
        h = int(hashlib.md5(f"12|{'' if i is None else i}".encode()).hexdigest()[:15], 16)
        want.append((str(i), weight, held[t][1], weight - math.log(-math.log((h + 0.5) / 2**60))))
    got = sorted(got, key=lambda x: (str(x.id), x.log_weight))
    want.sort(key=lambda x: (x[0], x[1]))
    for g, w in zip(got, want, strict=True):
        assert str(g.id) == w[0] and g.n_words == w[2]
        assert g.log_weight == pytest.approx(w[1], abs=1e-6, rel=1e-9) and g.key == pytest.approx(w[3], abs=1e-5, rel=1e-9)
    least = sorted((x.key for x in got), reverse=True)[math.ceil(keep * len(rows)) - 1]
    assert [x.kept for x in got] == [x.key >= least for x in got]  # rows that tie at the k-th key all stay


def texts(lengths, seed=2):
    r = np.random.default_rng(seed)
    return [r.integers(0, toxicity.SLOTS, (n, toxicity.FEATURES)).astype(np.int32) for n in lengths]


def slow_score(net, words):
    padded = [*words.tolist(), *[[toxicity.SLOTS] * toxicity.FEATURES] * toxicity.PAD]
    vectors = [sum(net.p["E"][x] for x in row) for row in padded]
    z = float(net.p["c"][0])
    for q, w in enumerate(toxicity.WIDTHS):
        for f in range(toxicity.FILTERS):
            places = [sum(float(vectors[i + j] @ net.p[f"W{w}"][j][:, f]) for j in range(w)) for i in range(len(words))]
            best = max(places, default=0.0) + float(net.p[f"b{w}"][f])
            z += max(best, 0.0) * float(net.p["o"][q * toxicity.FILTERS + f])
    return 1 / (1 + math.exp(-z))


def double_net():
    net = toxicity.Net(3)
    r = np.random.default_rng(4)
    net.p = {k: x.astype(np.float64) for k, x in net.p.items()}
    for w in toxicity.WIDTHS:
        net.p[f"b{w}"] += r.normal(0, 0.3, toxicity.FILTERS)
    return net


def test_scores_by_hand():
    net, some = double_net(), texts([0, 1, 2, 3, 17])
    first = np.concatenate([[0], np.cumsum([len(x) for x in some])])
    got = net.score(net.pooled(np.concatenate(some), first))
    assert got == pytest.approx([slow_score(net, x) for x in some], abs=1e-6)


def test_gradients_by_finite_differences():
    net, some, labels = double_net(), texts([0, 1, 2, 9, 30]), np.array([1.0, 0, 1, 0, 1])
    loss = lambda: -np.mean([math.log(p if y else 1 - p) for p, y in ((slow_score(net, x), y) for x, y in zip(some, labels, strict=True))])
    g = net.gradients(some, labels)
    r = np.random.default_rng(6)
    for name, x in net.p.items():
        flat, slope = x.reshape(-1), g[name].reshape(-1)
        live = np.flatnonzero(slope)
        live = live[live < toxicity.SLOTS * toxicity.DIM] if name == "E" else live  # padding is held at zero
        assert len(live)
        for at in {*r.choice(live, 4).tolist(), int(r.integers(0, len(flat) - toxicity.DIM if name == "E" else len(flat)))}:
            old, step = flat[at], 1e-6
            flat[at] = old + step
            up = loss()
            flat[at] = old - step
            down = loss()
            flat[at] = old
            assert (up - down) / (2 * step) == pytest.approx(slope[at], abs=1e-5, rel=1e-3), (name, at)


def texts_of(n, odd, seed, rare=()):
    """Rows ``id, text, lang, toxic``: every ``odd``-th text holds a word of ``rare``, else one of three mean words."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        t = [f"w{r.randrange(300)}" for _ in range(r.randint(5, 40))]
        if i % odd == 0:
            t[r.randrange(len(t))] = r.choice(rare or ["idiot", "scum", "trash"])
        rows.append((i, " ".join(t), r.choice(["en", "de"]), int(i % odd == 0)))
    return rows


def test_all_labelled_rows_reach_the_weights(spark, monkeypatch):
    """The net starts on 200 rows; words that only later rows hold must move all the same, and thresholds come from a whole fold."""
    monkeypatch.setattr(toxicity, "START_ROWS", 200)
    monkeypatch.setattr(toxicity, "SHARD_ROWS", 1500)
    seen, fitted = [], toxicity.average_round
    chosen, choose = [], toxicity.choose_thresholds

    def count(net, rows, *rest):
        seen.extend(r["t"] for r in rows.select("t").collect())
        return fitted(net, rows, *rest)

    def keep(scored, p1):
        chosen.append(scored.count())
        return choose(scored, p1)

    monkeypatch.setattr(toxicity, "average_round", count)
    monkeypatch.setattr(toxicity, "choose_thresholds", keep)
    rows = texts_of(4000, 4, 3, [f"mean{i}" for i in range(60)])
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int").repartition(4)
    labels = d.where("doc_id < 3600").select(d["doc_id"].alias("id"), d["toxic"].alias("label"))
    net, thresholds = toxicity.train(d.where("doc_id < 3600"), labels)
    assert len(seen) + chosen[0] == 3600 and 260 < chosen[0] < 460 and set(thresholds) == {"en", "de"}
    got = {r.id: r.score for r in toxicity.score(d.where("doc_id >= 3600"), net, thresholds).collect()}
    assert sum((got[i] >= 0.5) == (i % 4 == 0) for i in range(3600, 4000)) >= 380
    again, same = toxicity.train(d.where("doc_id < 3600"), labels)
    assert same == thresholds and np.array_equal(again.p["E"], net.p["E"])


def test_thresholds_against_a_plain_loop(spark):
    r = random.Random(8)
    rows = [(y, lang, min(max(r.gauss(0.3 + 0.3 * y, 0.2), 0.0), 1.0)) for lang in ("en", "de") for _ in range(150) for y in [int(r.random() < 0.3)]]
    rows += [(0, "xx", 0.2), (1, None, 0.4), (0, None, 0.3)]
    got = toxicity.choose_thresholds(spark.createDataFrame(rows, "label int, lang string, score double"), 0.1)
    assert set(got) == {"en", "de"}
    for lang, x in got.items():
        mine = [(y, s) for y, z, s in rows if z == lang]
        p, n = sum(y for y, _ in mine), sum(1 - y for y, _ in mine)
        w1, w0 = 0.1 * len(mine) / p, 0.9 * len(mine) / n

        def f1(limit):
            tp, fp = w1 * sum(y for y, s in mine if s >= limit), w0 * sum(1 - y for y, s in mine if s >= limit)
            return 2 * tp / (tp + fp + w1 * p)

        assert f1(x) >= max(f1(s) for _, s in mine) - 1e-9


def test_weighted_gradients_and_pieces(monkeypatch):
    net = toxicity.Net(2)
    words, labels = texts([0, 3, 50, 9], 4), np.array([0.0, 1.0, 0.0, 1.0])
    whole = net.gradients(words, labels)
    twice = net.gradients([*words, words[1]], np.append(labels, 1.0))
    weighted = net.gradients(words, labels, np.array([1.0, 2.0, 1.0, 1.0]))
    assert all(np.allclose(twice[k] * 5, weighted[k] * 4, atol=1e-5) for k in whole)
    monkeypatch.setattr(toxicity, "PIECE", 7)
    assert all(np.allclose(net.gradients(words, labels)[k], whole[k], atol=1e-6) for k in whole)
