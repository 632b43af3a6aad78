"""Toxicity by a convolutional text classifier: hashed word embeddings, filters of several widths, max pooling.

Every labelled row is used: nine of ten for the weights, the tenth for the thresholds. The net starts in numpy on the driver
from a few rows of each class; then Spark tasks go over all rows of the weights in rounds. In a round each task
trains its own copy of the net on its rows and the changes are averaged, weighed by rows. Both classes weigh alike, and the
output is set back to the true share of toxic rows among the labelled. Scoring runs in Spark tasks over
whole texts: word sequences are walked in pieces that overlap by the widest filter, so memory does not follow the
length of a text. On the rows held back from the weights a decision threshold is chosen for each language; languages are never
an input of a score.
"""

from __future__ import annotations

import copy
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, ship, stored, unit_hash
from .textvec import word_hashes

SLOTS, DIM, WIDTHS, FILTERS = 1 << 16, 16, (1, 2, 3), 12
PREFIXES = (4, 6)       # bytes: a word's embedding is the sum of the word's and of these prefixes'
FEATURES = 1 + len(PREFIXES)
START_ROWS = 3000       # labelled rows at most on which the net starts, half of each class
FOLDS = 10              # one of these folds of the labelled rows chooses the thresholds, the others fit the weights
ROUNDS = 3              # averages of the tasks' nets in one pass over the rows of the weights
VISITS = 40_000         # of fewer rows of the weights each is visited more than once, up to four times
SHARD_ROWS = 1 << 14    # labelled rows of one task, over all rounds
SHUFFLED = 1 << 18      # words of the texts that a task holds to draw them in a random order
BLOCK = 1 << 12         # slots of embeddings that are averaged together
PIECE = 40_000
PAD = max(WIDTHS) - 1


class Net:
    """``embedding``, one filter bank per width, and a logistic output over the pooled filters."""

    def __init__(self, seed: int = 5):
        r = np.random.default_rng(seed)
        self.p = {"E": r.normal(0, 0.1, (SLOTS + 1, DIM)).astype(np.float32), "o": r.normal(0, 0.1, FILTERS * len(WIDTHS)).astype(np.float32),
                  "c": np.zeros(1, np.float32)}
        for w in WIDTHS:
            self.p[f"W{w}"] = r.normal(0, 1 / math.sqrt(w * DIM), (w, DIM, FILTERS)).astype(np.float32)
            self.p[f"b{w}"] = np.zeros(FILTERS, np.float32)
        self.p["E"][SLOTS] = 0  # padding

    def filters(self, words: np.ndarray) -> np.ndarray:
        """All filters at every position of ``words`` but the last ``PAD`` (before the rectifier)."""
        x, n = sum(self.p["E"][words[:, k]] for k in range(FEATURES)), len(words) - PAD
        return np.concatenate([sum(x[j:j + n] @ self.p[f"W{w}"][j] for j in range(w)) + self.p[f"b{w}"] for w in WIDTHS], 1)

    def score(self, pooled: np.ndarray) -> np.ndarray:
        z = np.maximum(pooled, 0) @ self.p["o"] + self.p["c"][0]
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -60, 60)))

    def pooled(self, words: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Maximum of every filter over each text ``words[first[i]:first[i + 1]]``, padded by ``PAD`` on its right."""
        n = len(first) - 1
        out = np.full((n, FILTERS * len(WIDTHS)), -np.inf, np.float32)
        at = np.full((len(words) + PAD * n, FEATURES), SLOTS, np.int32)
        shift = np.repeat(np.arange(n) * PAD, np.diff(first))
        at[np.arange(len(words)) + shift] = words
        own = np.zeros(len(at), bool)
        own[np.arange(len(words)) + shift] = True
        begins = first[:-1] + np.arange(n) * PAD  # of each text in ``at``; its padding ends the text before the next
        for k in range(0, max(len(at) - PAD, 0), PIECE):
            got = self.filters(at[k:k + PIECE + PAD])
            got[~own[k:k + len(got)]] = -np.inf  # a filter that starts in the padding would see the next text
            i = np.searchsorted(begins, k, "right") - 1
            j = np.searchsorted(begins, k + len(got), "left")
            starts = np.maximum(begins[i:j] - k, 0)
            out[i:j] = np.maximum(out[i:j], np.maximum.reduceat(got, starts, axis=0))
        empty = np.diff(first) == 0
        if empty.any():
            out[empty] = np.concatenate([self.p[f"b{w}"] for w in WIDTHS])
        return out

    def best(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of one padded text: where each filter is largest first, and its value there."""
        out, place = np.full(FILTERS * len(WIDTHS), -np.inf, np.float32), np.zeros(FILTERS * len(WIDTHS), np.int64)
        for k in range(0, len(words) - PAD, PIECE):
            got = self.filters(words[k:k + PIECE + PAD])
            at = got.argmax(0)
            top = got[at, np.arange(got.shape[1])]
            place, out = np.where(top > out, at + k, place), np.maximum(top, out)
        return place, out if len(words) > PAD else np.concatenate([self.p[f"b{w}"] for w in WIDTHS])

    def gradients(self, texts: list[np.ndarray], labels: np.ndarray, weights: np.ndarray | None = None) -> dict[str, np.ndarray]:
        """Of the mean (weighted) logistic loss. A pooled filter passes its gradient to the one place where it was largest."""
        padded = [np.concatenate([x, np.full((PAD, FEATURES), SLOTS, np.int32)]) for x in texts]
        best, at = [], []
        for words in padded:
            place, top = self.best(words)
            at.append(place)
            best.append(top)
        best, hidden = np.array(best), np.maximum(best, 0)
        error = ((self.score(best) - labels) * (1 if weights is None else weights)).astype(np.float32) / len(texts)
        g = {k: np.zeros_like(x) for k, x in self.p.items()}
        g["o"], g["c"][0] = hidden.T @ error, error.sum()
        back = np.outer(error, self.p["o"]) * (best > 0)
        for i, words in enumerate(padded):
            for q, w in enumerate(WIDTHS):
                d, place = back[i, q * FILTERS:(q + 1) * FILTERS], at[i][q * FILTERS:(q + 1) * FILTERS]
                g[f"b{w}"] += d
                if len(words) <= PAD:
                    continue
                for j in range(w):
                    seen = words[place + j]
                    g[f"W{w}"][j] += (self.p["E"][seen].sum(1) * d[:, None]).T
                    np.add.at(g["E"], seen.T, self.p[f"W{w}"][j].T * d[:, None])
        return g

    def fit(self, texts: list[np.ndarray], labels: np.ndarray, weights: np.ndarray | None = None, epochs: int = 8, batch: int = 32,
            rate: float = 0.01, seed: int = 6, moments: dict | None = None) -> None:
        """Logistic loss, Adam. ``moments`` carries Adam's state from one call to the next."""
        r, s = np.random.default_rng(seed), {} if moments is None else moments
        if not s:
            s.update(t=0, m={k: np.zeros_like(x) for k, x in self.p.items()}, v={k: np.zeros_like(x) for k, x in self.p.items()})
        m, v = s["m"], s["v"]
        for _ in range(epochs):
            for part in np.array_split(r.permutation(len(texts)), max(1, len(texts) // batch)):
                g = self.gradients([texts[i] for i in part], labels[part], None if weights is None else weights[part])
                s["t"] += 1
                for k in self.p:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                    self.p[k] = (self.p[k] - rate * (m[k] / (1 - 0.9 ** s["t"])) / (np.sqrt(v[k] / (1 - 0.999 ** s["t"])) + 1e-8)).astype(np.float32)
                self.p["E"][SLOTS] = 0

    def rest(self) -> np.ndarray:
        """All parameters but the embeddings, one after the other."""
        return np.concatenate([self.p[k].ravel() for k in sorted(self.p) if k != "E"])

    def add(self, block: int, change: np.ndarray) -> None:
        """Add to the embeddings of a block of slots, or (block -1) to all other parameters."""
        if block >= 0:
            self.p["E"][block * BLOCK:(block + 1) * BLOCK] += change.reshape(-1, DIM)
            return
        at = 0
        for k in sorted(self.p):
            if k != "E":
                self.p[k] = (self.p[k] + change[at:at + self.p[k].size].reshape(self.p[k].shape)).astype(np.float32)
                at += self.p[k].size


def _words(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for at in range(0, len(column), 200):
        h, first = word_hashes(column.slice(at, 200), prefixes=PREFIXES)
        yield (h % np.uint64(SLOTS)).astype(np.int32), first


def _sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = [w[a:b].astype("<u2").tobytes() for w, first in _words(batch.column(1)) for a, b in zip(first, first[1:])]  # noqa: B905
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.binary()), *batch.columns[2:]], ["id", "words", *batch.schema.names[2:]])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The mean change of each block over the tasks' changes ``block, shard, n, slots, change`` (sorted by the first two).

    Tasks weigh by their rows; the mean of a slot's embedding is over the tasks that met the slot.
    """
    block, total, weight = None, None, None

    def mean() -> pa.RecordBatch:
        change = (total / np.maximum(weight, 1)[:, None]).astype("<f4")
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([change.tobytes()], pa.binary())], ["block", "change"])

    for batch in batches:
        for b, n, slots, change in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3, 4)), strict=True):
            if b != block:
                if block is not None:
                    yield mean()
                block = b
                shape = (BLOCK, DIM) if b >= 0 else (1, len(change) // 4)
                total, weight = np.zeros(shape), np.zeros(shape[0])
            at = np.frombuffer(slots, "<u2")
            total[at] += n * np.frombuffer(change, "<f4").reshape(len(at), -1).astype(np.float64)
            weight[at] += n
    if block is not None:
        yield mean()


def average_round(net: Net, rows: DataFrame, weights: tuple[float, float], shards: int, seed: int, epochs: int = 1) -> None:
    """One round: at most ``shards`` tasks train copies of ``net`` on their part of ``rows (t, label)``; ``net`` takes the mean change.

    ``weights`` are those of label 0 and 1. The driver receives one net, whatever the number of tasks.
    """
    sent = rows.sparkSession.sparkContext.broadcast(net)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, shard = sent.value, TaskContext.get().partitionId()
        own, moments, n, texts, labels, held = copy.deepcopy(base), {}, 0, [], [], 0

        def fit() -> None:
            y = np.array(labels, np.float64)
            own.fit(texts, y, np.where(y == 1, weights[1], weights[0]), epochs=epochs, batch=64, rate=0.002, seed=seed + n, moments=moments)

        for batch in batches:
            label = iter(batch.column(1).to_pylist())
            for words, first in _words(batch.column(0)):
                for a, b in zip(first, first[1:]):  # noqa: B905
                    texts.append(words[a:b])
                    labels.append(next(label))
                    held, n = held + int(b - a) + 1, n + 1
                    if held > SHUFFLED:
                        fit()
                        texts, labels, held = [], [], 0
        if texts:
            fit()
        if not n:
            return
        out = [(-1, np.zeros(1, "<u2"), own.rest() - base.rest())]
        change = own.p["E"] - base.p["E"]
        for block in range(SLOTS // BLOCK):
            part = change[block * BLOCK:(block + 1) * BLOCK]
            met = np.flatnonzero(part.any(1)).astype("<u2")
            if len(met):
                out.append((block, met, part[met]))
        for block, at, x in out:
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([shard], pa.int32()), pa.array([n], pa.int64()),
                                              pa.array([at.tobytes()], pa.binary()), pa.array([x.astype("<f4").tobytes()], pa.binary())],
                                             ["block", "shard", "n", "slots", "change"])

    changes = rows.select("t", "label").coalesce(max(1, shards)).mapInArrow(learn, "block int, shard int, n long, slots binary, change binary")
    merged = changes.repartition("block").sortWithinPartitions("block", "shard").mapInArrow(_merge, "block int, change binary")
    for r in merged.collect():  # one row a block: the size of the net
        net.add(r["block"], np.frombuffer(r["change"], "<f4"))
    sent.unpersist()


def _first(named: DataFrame, rows: int) -> DataFrame:
    """The first rows of each class by their hash, ``rows`` in all."""
    return named.where("label = 1").orderBy("h", "id").limit(rows // 2).unionByName(
        named.where("label = 0").orderBy("h", "id").limit(rows // 2))


def choose_thresholds(scored: DataFrame, p1: float) -> dict[str, float]:
    """For each language of ``scored (label, lang, score)`` with both classes, the threshold of the best F1.

    Scores are counted by 10,000ths; classes weigh as at a share ``p1`` of label 1.
    """
    ticks = (scored.where("lang IS NOT NULL").groupBy("lang", F.round(F.col("score") * 10_000).cast("int").alias("tick"))
             .agg(F.sum(F.col("label").cast("double")).alias("pos"), F.sum((1 - F.col("label")).cast("double")).alias("neg")))
    whole, above = Window.partitionBy("lang"), Window.partitionBy("lang").orderBy(F.desc("tick"))
    t = ticks.select("lang", "tick", F.sum("pos").over(whole).alias("p"), F.sum("neg").over(whole).alias("n"), F.sum("pos").over(above).alias("tp"),
                     F.sum("neg").over(above).alias("fp"), F.lead("tick").over(above).alias("below")).where("p > 0 AND n > 0")
    w1, w0 = F.lit(p1) / (F.col("p") / (F.col("p") + F.col("n"))), F.lit(1 - p1) / (F.col("n") / (F.col("p") + F.col("n")))
    t = t.withColumn("f1", 2 * w1 * F.col("tp") / (w1 * F.col("tp") + w0 * F.col("fp") + w1 * F.col("p")))
    t = t.withColumn("top", F.max("f1").over(whole)).where("f1 >= top - 1e-12")
    best = t.groupBy("lang").agg(F.min(F.struct("tick", F.coalesce("below", "tick").alias("below"))).alias("x"))
    return {r["lang"]: (r["tick"] + r["below"]) / 20_000 for r in best.select("lang", "x.tick", "x.below").collect()}


def train(docs: DataFrame, labels: DataFrame, seed: int = 3, *, id_col: str = "doc_id", text_col: str = "text",
          lang_col: str | None = "lang", train_rows: int | None = None, calibration_rows: int | None = None) -> tuple[Net, dict[str, float]]:
    """The net and a threshold for each language, from all labelled rows.

    ``labels`` are ``id, label`` (0 or 1; others and nulls are ignored). A seeded hash deals them into those of the weights and those of the
    thresholds. Only a caller who sets ``train_rows`` or ``calibration_rows`` gets no more than so many rows of these, half of each class,
    the first by the hash. Without labels of both classes the net is untrained and every score is the share of label 1 (one half without labels).
    """
    ship(docs.sparkSession)
    lang = F.col(lang_col) if lang_col else F.lit(None).cast("string")
    d = docs.select(docs[id_col].alias("id"), docs[text_col].alias("t"), lang.alias("lang"))
    given = cut(labels.where("label IN (0, 1) AND id IS NOT NULL").groupBy("id").agg(F.max("label").cast("int").alias("label"))
                .withColumn("h", unit_hash(seed, F.col("id"))))
    share = {r["label"]: r["count"] for r in given.groupBy("label").count().collect()}
    net, p1 = Net(seed), share.get(1, 0) / max(sum(share.values()), 1)
    known = given.join(d.select("id"), "id", "left_semi").select("id", "label", "h", (F.col("h") % FOLDS > 0).alias("weighs"))
    if train_rows is not None or calibration_rows is not None:
        fit, held = known.where("weighs"), known.where("NOT weighs")
        known = (fit if train_rows is None else _first(fit, train_rows)).unionByName(
            held if calibration_rows is None else _first(held, calibration_rows))
    known = stored(known, "labelled")
    counts = {(r["weighs"], r["label"]): r["count"] for r in known.groupBy("weighs", "label").count().collect()}
    if not (counts.get((True, 0)) and counts.get((True, 1))):  # too few rows to hold some back
        known = known.withColumn("weighs", F.lit(True))
        counts = {(True, y): counts.get((True, y), 0) + counts.get((False, y), 0) for y in (0, 1)}
    n0, n1 = counts.get((True, 0), 0), counts.get((True, 1), 0)
    if not (n0 and n1):
        net.p["o"][:] = 0
        net.p["c"][0] = math.log(min(max(p1, 1e-6), 1 - 1e-6) / (1 - min(max(p1, 1e-6), 1 - 1e-6))) if share else 0.0
        return net, {}
    weights = (n0 + n1) / (2 * n0), (n0 + n1) / (2 * n1)
    some = cut(_first(known.where("weighs"), START_ROWS))  # START_ROWS ids at most, one text of each
    start = d.join(F.broadcast(some), "id").groupBy("id", "label", "h").agg(F.min("t").alias("t"))
    seq = start.select("id", "t", "label", "h").mapInArrow(_sequences, f"id {dict(d.dtypes)['id']}, words binary, label int, h long")
    rows = seq.toPandas().sort_values(["h", "id"])
    texts = [np.frombuffer(w, "<u2").astype(np.int32).reshape(-1, FEATURES) for w in rows["words"]]
    y = rows["label"].to_numpy(np.float64)
    net.fit(texts, y, np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())), seed=seed)
    if max(n0, n1) > START_ROWS // 2:  # else it has seen all of them; labels are never sent whole to all tasks, each text is exchanged once
        dealt = unit_hash(seed, F.col("id"))
        for k in range(ROUNDS):
            part = F.floor(dealt / FOLDS) % ROUNDS == k  # also of the documents, before the join
            mine = d.where(part).join(known.where("weighs").select("id", "label").hint("merge"), "id")
            average_round(net, mine, weights, (n0 + n1) // SHARD_ROWS + 1, seed + 1 + k, min(max(VISITS // (n0 + n1), 1), 4))
    net.p["c"][0] += math.log(p1 / (1 - p1))  # back from classes of equal weight
    if not (counts.get((False, 0)) and counts.get((False, 1))):
        return net, {}
    held = d.where(unit_hash(seed, F.col("id")) % FOLDS == 0).join(known.where("NOT weighs").select("id", "label").hint("merge"), "id")
    return net, choose_thresholds(_scored(held.select("label", "lang", "t"), net, "label int, lang string, score double"), p1)


def _scored(d: DataFrame, net: Net, schema: str) -> DataFrame:
    """``d`` of three columns with the last, the text, replaced by its score."""
    sent = d.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = sent.value
        for batch in batches:
            got = [n.score(n.pooled(w, first)) for w, first in _words(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.concatenate(got) if got else [], pa.float64())],
                                             [batch.schema.names[0], batch.schema.names[1], "score"])

    return d.mapInArrow(run, schema)


def score(docs: DataFrame, net: Net, thresholds: dict[str, float], *, id_col: str = "doc_id", text_col: str = "text",
          lang_col: str | None = "lang") -> DataFrame:
    """One row per input row: ``id, score, threshold, toxic``.

    ``threshold`` is that of the row's language (0.5 for others and null), ``toxic`` whether the score reaches it. Null and empty
    texts get the score of no words. Repeated rows score alike; other columns are ignored; an empty table gives
    an empty result.
    """
    ship(docs.sparkSession)
    lang = docs[lang_col] if lang_col else F.lit(None).cast("string")
    d = docs.select(docs[id_col].alias("id"), lang.alias("lang"), docs[text_col].alias("t"))
    s = _scored(d, net, f"id {dict(d.dtypes)['id']}, lang string, score double")
    limit = F.lit(0.5)
    for name, x in sorted(thresholds.items()):
        limit = F.when(F.col("lang") == name, F.lit(x)).otherwise(limit)
    return s.select("id", "score", limit.alias("threshold"), (F.col("score") >= limit).alias("toxic"))
