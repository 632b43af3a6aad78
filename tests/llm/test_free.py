"""Operators with Python tasks against the libraries, brute force or held-out rows."""

import hashlib
import math
import random
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from hornbeam.llm import bpe, embed_dedup, ngram_join, textvec, tokens, toxicity, warc
from hornbeam.llm.common import shared_path
from hornbeam.llm.quality import resample
from hornbeam.llm.queries import op2_warc

public_tokenizers = pytest.importorskip("public_tokenizers")
BYTE, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def odd_texts(n, seed=1):
    r = random.Random(seed)
    letters = [chr(c) for c in range(0x3000) if unicodedata.category(chr(c)) != "Cs"]
    parts = letters[:128] + [" ", " ", "  ", "\n", " the", "'s", "'LL", "<|endoftext|>", "<|startoftext|>", "thing", "z" * 260, "ΑΣ", "\xa0", "\u1c89", "e\u0301"]
    return [None, "", " ", "\n \n", "a"] + ["".join(r.choice(parts if k % 3 else letters) for _ in range(r.randint(0, 80))) for k in range(n)]


def test_word_hashes():
    texts = [*odd_texts(200), "A b  C", "x" * (1 << 21), "é " * 700_000]
    h, first = textvec.word_hashes(pa.array(texts))
    names = {}
    for i, t in enumerate(texts):
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        assert len(words) == first[i + 1] - first[i]
        for w, x in zip(words[:1000], h[first[i]:first[i + 1]].tolist(), strict=False):
            assert names.setdefault(w, x) == x
    assert len(set(names.values())) == len(names)
    sliced, f = textvec.word_hashes(pa.array(texts).slice(5, 10))
    assert (sliced == h[first[5]:first[15]]).all() and (f == first[5:16] - first[5]).all()


def test_token_counts(spark):
    t, texts = Tokenizer.from_file(BYTE), odd_texts(400)
    rows = [(i, x, "clash") for i, x in enumerate(texts)] + [(0, texts[0], "clash"), (None, "a b", None)]
    got = tokens.count_tokens(spark.createDataFrame(rows, "doc_id long, text string, n_tokens string").repartition(3), BYTE).collect()
    want = {i: (len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for i, x, _ in rows}
    assert len(got) == len(rows) and all((r.n_bytes, r.n_tokens) == want[r.id] for r in got)
    assert tokens.count_tokens(spark.createDataFrame([], "doc_id long, text string"), BYTE).count() == 0


def test_whole_tokens_are_proven():
    spec = tokens.TokenizerFile(BYTE)
    t = Tokenizer.from_file(BYTE)
    some = random.Random(1).sample(spec.proven, 300)
    assert all(len(spec.merger.ids(x.encode())) == 1 for x in some)
    assert all(len(t.model.tokenize("".join(tokens.byte_letters()[b] for b in x.encode()))) == 1 for x in some)
    long = b"ab" * 300 + "ü".encode() * 50
    assert spec.merger._short([spec.merger.first[b] for b in long]) == spec.merger._long([spec.merger.first[b] for b in long])


def test_bpe(spark):
    r = random.Random(5)
    passage = "".join(r.choice("abcdefghij klmno, pqr. ") for _ in range(9000))
    texts = odd_texts(150) + [passage[:6000], "new " + passage, passage + "x", passage[100:8000], passage * 3, "q" * 9000 + passage, "ü" * 5000 + " " + passage]
    rows = [(i, x, "clash") for i, x in enumerate(texts)] + [(3, texts[3], ""), (None, passage, "")]
    got = bpe.encode(spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(4), WORDS).collect()
    t = Tokenizer.from_file(WORDS)
    want = {i: t.encode(x or "", add_special_tokens=False).ids for i, x, _ in rows}
    assert len(got) == len(rows)
    for g in got:
        assert g.ids == want[g.id] and g.decoded == t.decode(want[g.id], skip_special_tokens=False), g.id
    assert bpe.encode(spark.createDataFrame([], "doc_id long, text string"), WORDS).count() == 0


def test_chunks_follow_content():
    r = np.random.default_rng(1)
    a, b = (r.integers(97, 123, n, np.uint8) for n in (20000, 700))
    parts, keys = bpe.chunks_of(a)
    more, shifted = bpe.chunks_of(np.concatenate([b, a]))
    assert b"".join(parts) == a.tobytes() and b"".join(more) == b.tobytes() + a.tobytes()
    assert len(set(keys) & set(shifted)) >= len(keys) - 2 > 5
    umlauts = np.frombuffer("äöü€".encode() * 4000, np.uint8)
    assert [x.decode() for x in bpe.chunks_of(umlauts)[0]]


def test_warc(spark):
    big = "0123456789abcdef\r\n" * 2000
    rows = [(1, "http://a/", big, "c"), (2, "http://b/", big, "c"), (3, None, "tiny", "c"), (4, "u", "tiny", "c"), (5, "u\n v", None, "c"),
            (6, "u", "", "c"), (7, "u", "\r\n\r\n", "c"), (8, "u", "x" * 99, "c"), (9, "u", "x" * 99, "c"), (10, "ü", "ü€" * 60, "c"),
            (11, "u", "ü€" * 60, "c"), (12, "u", "WARC/1.1\r\nContent-Length: 9\r\n\r\n" * 9, "c"), (13, "u", "\r" * 500, "c"), (14, "u", "\n" * 301, "c")]
    path = shared_path(spark, "test")
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload string").repartition(3)
    warc.write_archives(pages, path, id_col="page_id", url_col="url", payload_col="html", chunk_bytes=100)
    chunks = warc.read_archives(spark, path)
    got = {int(r.record_id): r for r in warc.records_of(chunks).collect()}
    assert len(got) == len(rows)
    first = {}
    for i, _, t, _ in rows:
        p = (t or "").encode()
        refers = first.setdefault(p, i) if len(p) >= 100 else i
        r = got[i]
        assert (r.payload_bytes, r.payload_digest) == (len(p), hashlib.sha256(p).hexdigest())
        assert (r.record_type, r.refers_to) == (("response", None) if refers == i else ("revisit", str(refers)))
        assert r.intact is (True if refers == i else None)
    for i, _, t, _ in rows:
        own = sorted((c for c in chunks.where(F.col("record_id") == str(i)).collect()), key=lambda c: c.chunk_no) if i in (1, 10, 13, 14) else []
        data = b""
        for k, c in enumerate(own):
            assert (c.chunk_no, c.start) == (k, len(data)) and len(c.chunk) <= 100
            data += bytes(c.chunk)
            assert c.digest_so_far == hashlib.sha256(data).hexdigest()
        assert not own or data == (t or "").encode()
    empty = shared_path(spark, "test")
    warc.write_archives(spark.createDataFrame([], "id long, payload binary"), empty)
    assert warc.read_archives(spark, empty).count() == 0


def test_warc_repeated_and_null_ids(spark, tmp_path):
    a, b, tiny = "a" * 200, "b" * 300, "c"
    rows = [(2, a), (5, a), (5, a), (5, b), (7, b), (7, tiny), (7, tiny), (2, a), (None, a), (None, b), (None, "d" * 150), (None, "d" * 150), (None, None)]
    first = {a: 2, b: 5}
    pages = spark.createDataFrame([(i, f"http://h/{n}", t) for n, (i, t) in enumerate(rows)], "page_id long, url string, html string")
    pages.repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    want = []
    for i, t in rows:
        refers = first.get(t) if i is not None and first.get(t) != i else None
        p = (t or "").encode()
        want.append((i, len(p), hashlib.sha256(p).hexdigest(), "response" if refers is None else "revisit", refers))
    assert sorted(map(tuple, op2_warc(spark, str(tmp_path)).collect()), key=str) == sorted(want, key=str)
    path = shared_path(spark, "test")
    warc.write_archives(pages, path, id_col="page_id", url_col="url", payload_col="html", chunk_bytes=100)
    bodies = {bytes(x.digest, "ascii") for x in warc.read_archives(spark, path).where("is_last AND intact").select(F.col("payload_digest").alias("digest")).collect()}
    assert bodies == {hashlib.sha256((t or "").encode()).hexdigest().encode() for _, t in rows}  # every content is in the archive


def test_torn_archives_are_errors():
    one = b"".join(warc.record_segments("1", None, None, memoryview(b"payload"), 4))
    lines = one.replace(b"payl", b"pay").split(b"\r\n")
    with pytest.raises(ValueError):
        r = warc._Reader(True)
        for x in lines:
            r.line(x)


def jaccard(texts, size, percent):
    sets, par = {}, {i: i for i in texts}

    def find(a):
        while par[a] != a:
            a = par[a]
        return a
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w)} if 0 < len(w) < size else {tuple(w[k:k + size]) for k in range(len(w) - size + 1)} if w else set()
    for a in texts:
        for b in texts:
            n = len(sets[a] & sets[b])
            if a < b and n and 100 * n >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                par[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in texts}


@pytest.mark.parametrize("size,percent", [(3, 90), (5, 80)])
def test_jaccard_components(spark, size, percent, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    r = random.Random(size)
    words = [f"w{i}" for i in range(400)]
    bases = [[r.choice(words) for _ in range(r.choice([60, 100, 160]))] for _ in range(6)]
    line = [r.choice(words) for _ in range(30)]
    texts = [None, "", " \n", "one", "One", "one two", "one two three"]
    for _ in range(130):
        b = list(r.choice(bases))
        for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
            b[r.randrange(len(b))] = r.choice(words)
        texts.append(r.choice([" ", "\n"]).join(b))
    texts += [" ".join(line + [r.choice(words) for _ in range(40)]) for _ in range(40)]
    rows = [(i * 3 + 1, t, "clash") for i, t in enumerate(texts)]
    d = spark.createDataFrame([*rows, rows[9], rows[1]], "doc_id long, text string, component string").repartition(4)
    got = ngram_join.jaccard_components(d, size, percent).collect()
    want = jaccard({i: t for i, t, _ in rows}, size, percent)
    assert len(got) == len(rows) + 2 and all((g.n, g.component) == want[g.id] for g in got)


def test_jaccard_empty(spark):
    assert ngram_join.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    lone = ngram_join.jaccard_components(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).collect()
    assert sorted((r.id, r.n, r.component) for r in lone) == [(1, 0, 1), (2, 0, 2)]


def test_near_duplicates(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "BLOCK", 16)
    r = np.random.default_rng(3)
    x = r.normal(size=(500, 24))
    for base in range(0, 40, 4):
        for k in range(base * 8, base * 8 + 30):
            x[k] = x[base * 8] + r.normal(size=24) * r.choice([0.02, 0.1, 0.16])
    x[410:440] = x[400]
    x[440] = x[400] * 3
    rows = [(int(i) * 2, v.tolist(), "c") for i, v in enumerate(x)]
    rows += [(5001, None, "c"), (5003, [0.0] * 24, "c"), (5005, [math.nan] * 24, "c"), (5007, [None] + [1.0] * 23, "c"), (5009, [], "c"),
             (5011, [math.inf] * 24, "c"), (0, x[0].tolist(), "c")]
    got = embed_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, kept string").repartition(4)).collect()
    assert len(got) == len(rows)
    all_ids, u = np.array([i for i, *_ in rows[:500]] + [0]), np.vstack([x, x[:1]])
    u = u / np.linalg.norm(u, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    label = all_ids.copy()
    while True:
        new = np.minimum(label, np.where(near, label[None], label.max()).min(1))
        if (new == label).all():
            break
        label = new
    want = {int(i): (int(n), int(c)) for i, n, c in zip(all_ids, near.sum(1), label, strict=True)}
    for g in got:
        assert (g.n_links, g.component) == want.get(g.id, (0, g.id)) and g.kept == (g.id == g.component)
    assert embed_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_dense_groups_linked_across(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(900, 64))
    base, other = r.normal(size=64), r.normal(size=64)
    other -= base * (base @ other) / (base @ base)
    other *= np.linalg.norm(base) / np.linalg.norm(other)
    x[:150] = base + r.normal(size=(150, 64)) * 0.03
    x[150:300] = 0.97 * base + math.sqrt(1 - 0.97 ** 2) * other + r.normal(size=(150, 64)) * 0.03
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    assert near[:150, 150:300].all()
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    got = {g.id: g for g in embed_dedup.near_duplicates(d, min_recall=0.0).collect()}  # the first search, whatever its audit says
    assert all(got[i].n_links == n and got[i].component == (0 if i < 300 else i) for i, n in enumerate(near.sum(1)))


def test_recall_is_a_mean_over_nodes_with_links(spark, monkeypatch):
    r = np.random.default_rng(6)
    rows = [(i, x.tobytes()) for i, x in enumerate(np.repeat(r.normal(size=(21, 32)), [200] + [4] * 20, 0) + r.normal(size=(280, 32)) * 1e-3)]
    nodes = spark.createDataFrame(rows, "node long, v binary")
    found = [(i, 0) for i in range(200)] + [(i, i - i % 2) for i in range(200, 280)]  # each four split in two
    got = embed_dedup.recall(nodes, spark.createDataFrame(found, "node long, component long"), 0.95)
    assert got == pytest.approx((200 + 80 / 3) / 280)  # by links it would be above 0.99
    monkeypatch.setattr(embed_dedup, "AUDIT", 5)
    monkeypatch.setattr(embed_dedup, "SENT", 100)
    few = [(i, x.tobytes()) for i, x in enumerate(r.normal(size=(400, 32)))]
    few[399] = (399, few[398][1])
    none = spark.createDataFrame([], "node long, component long")
    assert embed_dedup.recall(spark.createDataFrame(few, "node long, v binary"), none, 0.95) == 0.0
    assert embed_dedup.recall(spark.createDataFrame(few[:399], "node long, v binary"), none, 0.95) == 1.0


def test_low_recall_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "recall", lambda *a: 0.5)
    d = spark.createDataFrame([(i, [1.0, i / 100]) for i in range(5)], "vec_id long, embedding array<double>")
    with pytest.raises(RuntimeError, match="0.5"):
        embed_dedup.near_duplicates(d, attempts=1)


def test_resample(spark):
    r = random.Random(1)
    good, bad = ["the", "of", "and", "house", "tree"], ["%%%", "###", "buy", "now", "!!!"]
    rows = [(i, " ".join(r.choice(bad if i % 5 == 0 else good) for _ in range(40)), "c") for i in range(400)] + [(1000, None, "c"), (1001, "", "c")]
    d = spark.createDataFrame(rows, "doc_id long, text string, key string").repartition(3)
    ids = spark.createDataFrame([(i,) for i in range(400) if i % 5 and i % 3], "id long")
    got = {g.id: g for g in resample(d, ids).collect()}
    assert len(got) == 402 and got[1000].log_weight == got[1001].log_weight == 0
    assert sum(got[i].kept for i in range(400) if i % 5) >= 318 and not any(got[i].kept for i in range(0, 400, 5))
    some = resample(d, ids, keep=0.25).collect()
    keys = sorted((g.key for g in some), reverse=True)
    assert sorted(g.key for g in some if g.kept) == sorted(keys[:101])
    assert all(g.kept for g in resample(d, ids.where("false")).collect())
    assert resample(d.where("false"), ids).count() == 0


def test_resample_with_wrong_labels(spark):
    r = random.Random(4)
    good, bad = ["the", "of", "and", "house", "tree"], ["%%%", "###", "buy", "now", "!!!"]
    rows = [(i, " ".join(r.choice(bad if i % 5 == 0 else good) for _ in range(r.choice([40, 400])))) for i in range(1000)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = {i: int(i % 5 > 0 or i in (35, 70)) for i in range(1000) if i % 7 == 0}  # two bad rows labelled good
    ids = [spark.createDataFrame([(i,) for i, q in labels.items() if q == quality], "id long") for quality in (1, 0)]
    kept = {g.id for g in resample(d, ids[0], bad_ids=ids[1]).collect() if g.kept}
    assert 780 <= len(kept) <= 820 and sum(i % 5 > 0 for i in kept) >= 780


def test_toxicity(spark):
    r = random.Random(2)
    words, mean = [f"w{i}" for i in range(300)], ["idiot", "scum", "trash"]
    rows = []
    for i in range(900):
        t = [r.choice(words) for _ in range(r.randint(5, 60))]
        if i % 4 == 0:
            t[r.randrange(len(t))] = r.choice(mean)
        rows.append((i, " ".join(t), r.choice(["en", "de"]), int(i % 4 == 0)))
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int").repartition(4)
    labels = spark.createDataFrame([(i, y) for i, _, _, y in rows if i < 700] + [(None, 1), (1, None), (2, 7)], "id long, label int")
    net, thresholds = toxicity.train(d.where("doc_id < 700"), labels, train_rows=300, calibration_rows=200)
    more = spark.createDataFrame([(2000, None, None, 0), (2001, "", "xx", 0), (2002, "w1 " * 90_000 + "idiot", "en", 1)], d.schema)
    got = {g.id: g for g in toxicity.score(d.unionByName(more), net, thresholds).collect()}
    held = [i for i in range(700, 900)]
    assert sum((got[i].score >= 0.5) == (i % 4 == 0) for i in held) >= 190
    assert set(thresholds) <= {"en", "de"} and got[2001].threshold == 0.5
    assert got[2000].score == got[2001].score and 0 <= got[2000].score < 0.5 < got[2002].score
    assert toxicity.score(d.where("false"), net, thresholds).count() == 0
    plain, none = toxicity.train(d, labels.where("label = 0"))
    assert none == {} and toxicity.score(d.limit(3), plain, none).where("score >= 0.5").count() == 0


def test_long_texts_score_as_in_one_piece(monkeypatch):
    net = toxicity.Net(1)
    r = np.random.default_rng(1)
    first = np.array([0, 3, 3, 500, 501, 900])
    words = r.integers(0, toxicity.SLOTS, (900, toxicity.FEATURES)).astype(np.int32)
    whole = net.pooled(words, first)
    monkeypatch.setattr(toxicity, "PIECE", 7)
    assert np.allclose(net.pooled(words, first), whole, atol=1e-5)


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") & 1] for i in range(n))


def test_long_words_that_share_a_polynomial_hash(spark):
    """A Thue-Morse word and its swap have one sum modulo 2**64 whatever the base; they are different words."""
    one = thue_morse(1024)
    two = one.translate(str.maketrans("ab", "ba"))
    h, _ = textvec.word_hashes(pa.array([one, two, one.upper()]))
    assert h[0] != h[1] and h[0] == h[2]
    got = ngram_join.jaccard_components(spark.createDataFrame([(1, one), (2, two), (3, one.upper())], "doc_id long, text string"), 3, 90)
    assert {r.id: r.component for r in got.collect()} == {1: 1, 2: 2, 3: 1}


def test_vectors_of_any_norm_and_width(spark):
    r = np.random.default_rng(3)
    base = r.normal(size=5000)
    other = np.concatenate([base[:4096], r.normal(size=904) * 9])  # differs behind the 4,096th component only
    rows = [(0, base), (1, base * 1e200), (2, base * 1e-170), (3, base * 5e-310 / np.abs(base).max()), (4, other), (5, other * 1e300 / 99), (6, base * 0)]
    got = embed_dedup.near_duplicates(spark.createDataFrame([(i, v.tolist()) for i, v in rows], "vec_id long, embedding array<double>")).collect()
    assert {g.id: (g.component, g.n_links) for g in got} == {**{i: (0, 3) for i in range(4)}, 4: (4, 1), 5: (4, 1), 6: (6, 0)}


def test_group_of_near_copies_around_the_threshold(spark):
    """Copies with two edits each: some pairs link, most just do not, all share nearly all shingles."""
    r = random.Random(2)
    words = [f"w{i}" for i in range(120)]
    for n in (150,):
        rows = []
        for i in range(n):
            t = words.copy()
            for _ in range(2):
                t[r.randrange(120)] = f"x{r.random()}"
            rows.append((i, " ".join(t)))
        got = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect()
        sets = {i: {tuple(t.split()[k:k + 3]) for k in range(118)} for i, t in rows}
        label = {i: i for i in sets}
        for i in sets:
            for j in range(i):
                if 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j]):
                    x, y = sorted((label[i], label[j]))
                    label = {k: x if v == y else v for k, v in label.items()}
        assert {g.id: g.component for g in got} == label


def test_bpe_worker_memory_is_bounded(monkeypatch):
    """Runs are kept up to MEMO, those in use stay; batches are worked through in pieces."""
    import pyarrow as pa
    with open(WORDS, encoding="utf-8") as f:
        spec = f.read()
    monkeypatch.setattr(bpe, "MEMO", 40)
    e, words = bpe.Encoder(spec), [f"word{i}" for i in range(300)]
    asked, learn = [], e.one
    e.one = lambda x: asked.append(x) or learn(x)
    for w in words:
        text = f"the {w} {w}s".encode()
        assert e.encode([text])[0] == learn(text).tobytes()
        assert len(e.runs) + len(e.older) <= 40
    assert sum(b"the" in x.split(e.mark) for x in asked) == 1  # a run in use is not encoded again
    monkeypatch.setattr(bpe, "PIECE", 10)
    column = pa.array(["", "abcd", None, "x" * 35, "ab", "cdefgh", "i", "jk", ""])
    for kind in (pa.string(), pa.binary()):
        batch = pa.RecordBatch.from_arrays([pa.array(range(9)), column.cast(kind)], ["id", "t"])
        pieces = list(bpe._pieces([batch, batch.slice(9), batch.slice(4)], 1))
        assert [x for p in pieces for x in p.column(0).to_pylist()] == [*range(9), *range(4, 9)]
        assert max(sum(len(x or "") for x in p.column(1).to_pylist()) for p in pieces if len(p) > 1) <= 10


def test_bpe_chunks_that_stand_alone_are_encoded_in_one_pass_only(spark):
    passage = " ".join(f"passage{i * i} word" for i in range(400))
    docs = spark.createDataFrame([(i, f"own{i} text {i} {passage} more{i}. " + " ".join(f"x{i}y{j}" for j in range(300))) for i in range(3)],
                                 "doc_id long, text string")
    got = bpe.encode(docs, WORDS)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow places(") == 1 and plan.count("MapInArrow wanted(") == 1  # the shared ones are only named
    lib = Tokenizer.from_file(WORDS)
    assert {r.id: r.ids for r in got.collect()} == {r.doc_id: lib.encode(r.text, add_special_tokens=False).ids for r in docs.collect()}


def test_bpe_chunks_of_a_batch_are_those_of_each_text_and_tables_stay_small():
    """The texts of a batch are hashed in one go; windows over two texts ask for nothing, and no table grows with a text."""
    import pyarrow as pa
    from hornbeam.llm import textvec
    r = np.random.default_rng(5)
    texts = [*odd_texts(60), None, "", "".join(map(chr, r.integers(97, 123, 300_000))), *("".join(map(chr, r.integers(97, 123, n))) for n in (279, 280, 3000, 70_000)), "ü€" * 9000]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["id", "t"])
    textvec._powers.cache_clear()
    sizes, real = [], bpe._powers
    bpe._powers = lambda n: sizes.append(n) or real(n)
    try:
        for part in (batch, batch.slice(61)):
            got = list(bpe._chunked(part, 1))
            own = [bpe.chunks_of(np.frombuffer((x or "").encode(), np.uint8)) for x in part.column(1).to_pylist()]
            assert [(parts, keys) for _, parts, keys in got] == own
            assert sum(len(parts) > 1 for parts, _ in own) >= 3
    finally:
        bpe._powers = real
    assert set(sizes) == {1 << 17}
