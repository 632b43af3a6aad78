"""Ranked lexical search by scanning the texts with an Aho-Corasick automaton.

No index of the documents is made. The terms of all items form one automaton; each is guarded by a separator on both
sides, and a text is scanned with every other character than those of terms turned into separators, so a match is a whole
term. Two scans: the first counts how many texts hold each term, all terms and texts; the second turns the
matches of each text into scores, an automaton output (a term) adding to every item that has it, and keeps the best
``k`` texts of each item per task. Only these are ranked at the end.

Texts are handled as UTF-8 bytes with one table look-up a byte. The item terms of one automaton are at most
``MAX_TERM_BYTES``, measured before; more items are handled in as many blocks, each with scans of its own.
"""

from __future__ import annotations

import math
import uuid
from bisect import insort
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, ship, worker_cache

MAX_TERM_BYTES = 32 << 20
PIECE = 1 << 20  # bytes of a text scanned at once; a longer term than that is no item term
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: byte -> byte: A-Z lower-cased, bytes that are in no term to a blank
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: Column) -> Column:
    """The terms of a text with repeats; none for null."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(TERM), F.lit(0))


class Items:
    """Terms of a block of items: guarded texts, and for each term the items that hold it, with repeats."""

    def __init__(self, rows: pa.Table):
        self.token = uuid.uuid4().hex
        self.names = rows["item"].combine_chunks().dictionary_encode()
        term = rows["term"].combine_chunks().dictionary_encode()
        order = np.argsort(term.indices.to_numpy(), kind="stable")
        self.terms = term.dictionary.to_pylist()
        self.item = self.names.indices.fill_null(len(self.names.dictionary)).to_numpy(zero_copy_only=False)[order].astype(np.int64)
        self.repeats = rows["n"].to_numpy()[order].astype(np.int64)
        self.start = np.searchsorted(term.indices.to_numpy()[order], np.arange(len(self.terms) + 1))
        self.names = [*self.names.dictionary.to_pylist(), None]

    def automaton(self) -> ahocorasick.Automaton:
        out = ahocorasick.Automaton()
        for k, term in enumerate(self.terms):
            if len(term.encode()) + 2 <= PIECE:
                out.add_word(" " + term.encode().decode("latin-1") + " ", k)
        out.make_automaton()
        return out


def _automaton(items) -> ahocorasick.Automaton:
    cache = worker_cache("lexical_scan")
    if cache.get("of") != items.value.token:
        cache.clear()
        cache.update(of=items.value.token, automaton=items.value.automaton())
    return cache["automaton"]


def matches(automaton: ahocorasick.Automaton, folded: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Item terms in a folded text that begins and ends with a blank, and how often each occurs."""
    if not len(automaton):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    found: list[int] = []
    at = 0
    while at < len(folded) - 1:
        end = len(folded) - 1 if len(folded) - at <= PIECE else folded.rfind(b" ", at + 1, at + PIECE)
        if end < 0:  # a term longer than a piece: no item has it
            at = folded.find(b" ", at + PIECE)
            continue
        found += [k for _, k in automaton.iter(folded[at:end + 1].decode("latin-1"))]
        at = end
    return np.unique(np.array(found, np.int64), return_counts=True)


def n_terms(folded: bytes) -> int:
    """Maximal runs of other bytes than blanks, in a text that begins with a blank."""
    blank = np.frombuffer(folded, np.uint8) == 32
    return int(np.count_nonzero(blank[:-1] & ~blank[1:]))


def _folded(batch: pa.RecordBatch) -> Iterator[tuple[int, bytes]]:
    """Row number and folded text between blanks, of the rows with at least one byte."""
    text = batch.column(1).cast(pa.binary())
    for i in range(len(text)):
        t = text[i].as_py()
        if t:
            yield i, b" " + t.translate(FOLD) + b" "


def _survey(items):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(items)
        held = np.zeros(len(items.value.terms), np.int64)
        texts = total = 0
        for batch in batches:
            for _, folded in _folded(batch):
                n = n_terms(folded)
                texts, total = texts + (n > 0), total + n
                held[matches(automaton, folded)[0]] += 1
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-1, -2], some])), pa.array(np.concatenate([[texts, total], held[some]]))],
                                         ["term", "n"])
    return run


def _best(items, weights, texts: int, total: int, k: int, kinds: list[pa.DataType]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, it, w = _automaton(items), items.value, weights.value
        best: list[list[tuple]] = [[] for _ in it.names]
        least = np.zeros(len(it.names), np.int64)  # a score below it cannot enter
        for batch in batches:
            for i, folded in _folded(batch):
                term, tf = matches(automaton, folded)
                if not len(term):
                    continue
                m = 100 - 75 + (75 * n_terms(folded) * texts) // total
                worth = w[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))
                size = it.start[term + 1] - it.start[term]
                at = np.repeat(it.start[term] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
                score = np.zeros(len(it.names), np.int64)
                np.add.at(score, it.item[at], it.repeats[at] * np.repeat(worth, size))
                enters = np.flatnonzero((score > 0) & (score >= least))
                doc = batch.column(0)[i].as_py() if len(enters) else None
                for x in enters.tolist():
                    insort(best[x], (-int(score[x]), doc is None, doc))
                    del best[x][k:]
                    if len(best[x]) == k:
                        least[x] = -best[x][-1][0]
        rows = [(it.names[x], d, -s) for x, top in enumerate(best) for s, _, d in top]
        item, doc, score = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(item, kinds[0]), pa.array(doc, kinds[1]), pa.array(score, pa.int64())],
                                         ["item", "doc", "score"])
    return run


def search(docs: DataFrame, items: DataFrame, k: int = 10, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
           item_text_col: str = "text", max_term_bytes: int | None = None) -> DataFrame:
    """The ``k`` best texts of each item: ``item, rank, doc, score``, rank 1 the best.

    A term is a maximal run of ASCII letters, digits and characters beyond ASCII, A-Z lower-cased. Over ``N`` texts with a term,
    ``L`` terms in all, ``n`` in the text and ``df`` texts that hold the term, a term said ``tf`` times is worth
    ``w * (10**9 * tf div (1000 * tf + 8 * m))`` with ``w = floor(1000 * ln((2N + 2) / (2df + 1)))`` and ``m = 25 + (75 * n * N) div L``; an
    item's score sums it over its terms with repeats. Scores of 0 are not ranked. Equal scores go by ascending document id, null last.
    Null and empty texts hold no terms and are not counted. Rows that repeat a document id are texts of their own; rows
    that repeat an item id (or have none) are one item. Other columns are ignored. Empty tables give an empty result.
    The terms of one item must fit the driver.
    """
    spark = docs.sparkSession
    ship(spark)
    limit = MAX_TERM_BYTES if max_term_bytes is None else max_term_bytes
    own = cut(items.select(F.col(item_col).alias("item"), F.explode(terms_of(F.col(item_text_col))).alias("term"))
              .groupBy("item", "term").agg(F.count(F.lit(1)).alias("n")))
    size = own.agg(F.sum(F.octet_length("term") + 24)).first()[0] or 0
    blocks = max(1, -(-size // limit))
    d = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("t"))
    kinds = {"item": dict(own.dtypes)["item"], "doc": dict(d.dtypes)["doc"]}
    made = None
    for block in range(blocks):
        rows = own.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).toArrow()  # at most about ``limit`` bytes
        if not rows.num_rows:
            continue
        block_items = Items(rows)
        shared = spark.sparkContext.broadcast(block_items)
        counts = d.mapInArrow(_survey(shared), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
        n = dict(zip(counts["term"].to_pylist(), counts["n"].to_pylist(), strict=True))
        texts, total = n.get(-1, 0), n.get(-2, 0)
        if not total:
            break
        weights = spark.sparkContext.broadcast(np.array(
            [math.floor(1000 * math.log((2 * texts + 2) / (2 * n.get(x, 0) + 1))) for x in range(len(block_items.terms))], np.int64))
        some = d.mapInArrow(_best(shared, weights, texts, total, k, [rows.schema.field("item").type, d.limit(0).toArrow().schema.field("doc").type]),
                            f"item {kinds['item']}, doc {kinds['doc']}, score long")
        made = some if made is None else made.unionByName(some)
    if made is None:
        return spark.createDataFrame([], f"item {kinds['item']}, rank int, doc {kinds['doc']}, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc"))
    return made.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item", "rank", "doc", "score")
