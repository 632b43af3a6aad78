"""Token counts of a byte-level BPE by the whole-token shortcut.

Before any text is read, every vocabulary string is put through the merges: those that end as one token
are proven, and each pre-token equal to a proven string counts one without merging. Only other
pre-tokens are merged, once per task (kept in a bounded table).
"""

from __future__ import annotations

import heapq
import json
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import ship, worker_cache

# fixed value: the pre-token pattern of the tokenizer file's ByteLevel step
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MEMO = 600_000  # entries of each table that a task keeps
SHORT = 200  # bytes up to which a pre-token is merged in a plain list


def byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in a byte-level vocabulary: printable Latin-1 bytes stand for
    themselves, the others follow from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Merger:
    """Applies the merges of a tokenizer file to one pre-token: lowest rank first, leftmost first."""

    def __init__(self, vocab: dict[str, int], merges: list[list[str]]):
        letters = byte_letters()
        self.first = [vocab[letters[b]] for b in range(256)]
        self.ranks = {(vocab[a], vocab[b]): rank for rank, (a, b) in enumerate(merges)}
        self.made = [vocab[a + b] for a, b in merges]
        self.bytes_of = {letter: b for b, letter in letters.items()}

    def ids(self, raw: bytes) -> list[int]:
        ids = [self.first[b] for b in raw]
        return self._long(ids) if len(ids) > SHORT else self._short(ids)

    def _short(self, ids: list[int]) -> list[int]:
        rank, made, none = self.ranks.get, self.made, len(self.made)
        pairs = [rank(p, none) for p in zip(ids, ids[1:])]  # noqa: B905
        while pairs and (best := min(pairs)) < none:
            i = pairs.index(best)
            ids[i:i + 2] = [made[best]]
            del pairs[i]
            if i:
                pairs[i - 1] = rank((ids[i - 1], ids[i]), none)
            if i < len(pairs):
                pairs[i] = rank((ids[i], ids[i + 1]), none)
        return ids

    def _long(self, ids: list[int]) -> list[int]:
        """The same with a queue, for pre-tokens of any length."""
        n, ranks, made = len(ids), self.ranks, self.made
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        queue = [(r, i) for i in range(n - 1) if (r := ranks.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(queue)
        while queue:
            r, i = heapq.heappop(queue)
            j = right[i] if ids[i] is not None else n
            if j >= n or ranks.get((ids[i], ids[j])) != r:
                continue  # one of the two has merged elsewhere meanwhile
            ids[i], ids[j] = made[r], None
            right[i] = right[j]
            if right[i] < n:
                left[right[i]] = i
                if (r := ranks.get((ids[i], ids[right[i]]))) is not None:
                    heapq.heappush(queue, (r, i))
            if (k := left[i]) >= 0 and (r := ranks.get((ids[k], ids[i]))) is not None:
                heapq.heappush(queue, (r, k))
        return [x for x in ids if x is not None]


class TokenizerFile:
    """What the shortcut needs of a byte-level BPE ``tokenizer.json``: data only, sent to the tasks."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        step = spec["pre_tokenizer"] or {}
        if step.get("type") != "ByteLevel" or not step.get("use_regex") or step.get("add_prefix_space") or spec["normalizer"]:
            raise ValueError("not a byte-level BPE tokenizer with the usual pre-tokens")
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("added tokens with flags are not supported")
        self.specials = sorted((t["content"] for t in spec["added_tokens"]), key=lambda x: (-len(x), x))
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.merger = Merger(spec["model"]["vocab"], merges)
        self.proven = prove(self.merger, spec["model"]["vocab"])


def prove(merger: Merger, vocab: dict[str, int]) -> list[str]:
    """The vocabulary strings that the merges alone turn into one token. Strings that are no whole UTF-8 text
    cannot be pre-tokens and are left out."""
    out = []
    for token, token_id in vocab.items():
        try:
            raw = bytes(merger.bytes_of[c] for c in token)
            text = raw.decode()
        except (KeyError, UnicodeDecodeError):
            continue
        if merger.ids(raw) == [token_id]:
            out.append(text)
    return out


@lru_cache(maxsize=1)
def unsettled() -> frozenset[str]:
    """Characters that newer Unicode tables call letters or numbers and older ones leave unassigned."""
    text = "".join(chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000)
    return frozenset(c for c in regex.findall(r"[\p{L}\p{N}]", text) if unicodedata.category(c) == "Cn")


class Bounded(dict):
    """``make(key)`` kept for each key, up to ``MEMO`` keys beyond those it starts with."""

    def __init__(self, make, start=()):
        super().__init__(start)
        self.make, self.start, self.most = make, start, len(start) + MEMO

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
            self.update(self.start)
        self[key] = value = self.make(key)
        return value


class Counter:
    """Counts the tokens of texts in one worker.

    A text may be cut before any blank that a non-space follows: no pre-token reaches across. So the
    words between blanks are looked up first; a word not seen yet is cut into pre-tokens, and
    a pre-token that is neither proven nor seen is merged.
    """

    def __init__(self, spec: TokenizerFile):
        merger = spec.merger
        self.tokens = Bounded(lambda x: len(merger.ids(x.encode())), dict.fromkeys(spec.proven, 1))
        self.words = Bounded(self.word)
        self.find = regex.compile(PATTERN).findall
        self.split = regex.compile("|".join(map(regex.escape, spec.specials))).split if spec.specials else lambda x: [x]
        self.odd = unsettled()
        self.beyond = regex.compile(f"[{min(self.odd, default=chr(sys.maxunicode))}-{chr(sys.maxunicode)}]").findall

    def pre_tokens(self, text: str) -> list[str]:
        if self.odd.isdisjoint(self.beyond(text)):
            return self.find(text)
        from tokenizers import pre_tokenizers  # decides by its own Unicode tables
        step = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
        return [text[a:b] for _, (a, b) in step.pre_tokenize_str(text)]

    def whole(self, text: str) -> int:
        parts = self.split(text)
        get = self.tokens.__getitem__
        return len(parts) - 1 + sum(sum(map(get, self.pre_tokens(x))) for x in parts)

    def word(self, word: str) -> int | None:
        """Tokens of a blank and this word; None if a space follows the blank, where no cut is allowed."""
        return None if not word or word[0].isspace() else self.whole(" " + word)

    def count(self, text: str) -> int:
        first, *words = text.split(" ")
        counts = list(map(self.words.__getitem__, words))
        return self.whole(text) if None in counts else self.whole(first) + sum(counts)


def counter(name: str, spec) -> Counter:
    """One counter in each Python worker: what a task has merged serves the worker's next tasks too."""
    kept = worker_cache("tokens")
    if name not in kept:
        kept.clear()
        kept[name] = Counter(spec.value)
    return kept[name]


def count_tokens(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id, n_bytes, n_tokens``, as the tokenizer file's library counts.

    Added tokens inside a text count one each (the library's default); none are put around it. A null
    text is empty: no bytes, no tokens. Repeated rows are counted one by one; other columns are
    ignored; an empty table gives an empty result. ``tokenizer`` is read on the driver; tasks get
    its tables, whose size the vocabulary bounds, as a broadcast.
    """
    spark = docs.sparkSession
    ship(spark)
    spec = spark.sparkContext.broadcast(TokenizerFile(tokenizer))
    name = f"{spark.sparkContext.applicationId}:{tokenizer}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(name, spec).count
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x.encode()) for x in texts], pa.int64()),
                 pa.array(map(count, texts), pa.int64())], ["id", "n_bytes", "n_tokens"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("t")).mapInArrow(
        run, f"id {kind}, n_bytes long, n_tokens long")
