"""Registered queries of this subpackage: one per operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .embed_dedup import near_duplicates
from .exact_dedup import exact_duplicates
from .bpe import encode
from .common import cut, shared_path
from .decontaminate import contamination
from .lexical_scan import search
from .mixing import mix
from .ngram_join import jaccard_components
from .prefix_trie import ends_digest, prefix_trie, step_digest, word_count
from .quality import resample
from .tokens import count_tokens
from .toxicity import score, train
from .urls import judge
from .warc import read_archives, records_of, write_archives

# fixed values: the rules of the url query (verdict, host, path)
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
             ("block", "net", "/es/"), ("block", "net", "/fr/")]
MAX_TOKENS = 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def good_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("id"))


def bad_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").where("quality = 0").select(F.col("doc_id").alias("id"))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resample all documents towards those labelled good."""
    return resample(table(spark, sf_dir, "documents"), good_ids(spark, sf_dir), bad_ids=bad_ids(spark, sf_dir)).select(
        F.col("id").alias("doc_id"), "log_weight", "n_words", "key", "kept")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all pages as WARC archives in the shared folder, read them back, one row per page."""
    path = shared_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path, id_col="page_id", url_col="url", payload_col="html")
    r = records_of(read_archives(spark, path, with_payload=False))
    return r.select(F.col("record_id").cast("bigint").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                    F.col("refers_to").cast("bigint").alias("refers_to"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge the url of every page by the rules, else by link-graph propagation."""
    return judge(table(spark, sf_dir, "pages"), URL_RULES).select(
        F.col("id").alias("page_id"), "host", "path", "rule", "verdict", "trust", "distrust")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix all documents: weights 3, 1, 2 in turn, 150 % of all words, at most two epochs."""
    return mix(table(spark, sf_dir, "documents"), [3, 1, 2], 1.5, 2.0).select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents under the byte-level vocabulary."""
    import public_tokenizers
    counts = count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counts.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens",
                         (F.col("n_tokens") > MAX_TOKENS).alias("over_limit"))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents under 3-word shingles and Jaccard 0.9."""
    return jaccard_components(table(spark, sf_dir, "documents"), 3, 90).select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def op7_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links at cosine 0.95 among all embeddings."""
    return near_duplicates(table(spark, sf_dir, "embeddings")).select(
        F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score all documents; rows with crc32(doc_id) mod 5 = 0 are held out of the training."""
    docs, fifth = table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    labels = table(spark, sf_dir, "labels").where(fifth != 0).select(F.col("doc_id").alias("id"), F.col("toxic").alias("label"))
    net, thresholds = train(docs.where(fifth != 0), labels)
    return score(docs, net, thresholds).select(
        F.col("id").alias("doc_id"), (F.crc32(F.col("id").cast("string").cast("binary")) % 5 == 0).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"), "threshold", "toxic")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact duplicates among all documents, with the SHA-256 of every text."""
    return exact_duplicates(table(spark, sf_dir, "documents"), digest_all=True).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("sha256").alias("text_sha256"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode all documents under the word vocabulary."""
    import public_tokenizers
    e = encode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return e.select(F.col("id").alias("doc_id"), F.size("ids").cast("bigint").alias("n_tokens"),
                    F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def rebuilt_conversations(conversations: DataFrame) -> DataFrame:
    """Steps of every conv_id c: the first h turns of conversation c - c % 20, then its own turns after its first h.

    ``h`` is crc32(c) % 4. Turns are ordered by turn, null first; rows of one turn by their digest, so reruns agree. Rows
    without a conv_id are left out.
    """
    t = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv"), "turn", step_digest(F.col("role"), F.col("text")).alias("step"),
        word_count(F.col("text")).alias("words"))
    order = Window.partitionBy("conv").orderBy(F.asc_nulls_first("turn"), "step")
    t = cut(t.select("conv", "step", "words", (F.row_number().over(order) - 1).cast("bigint").alias("pos")))
    shared = F.crc32(F.col("conv").cast("string").cast("binary")) % 4
    convs = t.where("pos = 0").select("conv")
    heads = t.where("pos < 3").select(F.col("conv").alias("base"), "pos", "step", "words")
    given = (convs.withColumn("h", shared).where("h > 0").withColumn("base", F.col("conv") - F.col("conv") % 20)
             .join(heads, "base").where("pos < h"))
    roots = convs.select("conv", F.lit(-1).cast("bigint").alias("pos"), F.lit(None).cast("binary").alias("step"), F.lit(0).cast("bigint").alias("words"))
    return roots.unionByName(given.select("conv", "pos", "step", "words")).unionByName(
        t.where(F.col("pos") >= shared).select("conv", "pos", "step", "words"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefix trie of all rebuilt conversations, one row per node."""
    nodes, ends = prefix_trie(rebuilt_conversations(table(spark, sf_dir, "conversations")))
    return nodes.join(ends_digest(ends), ["n1", "n2"], "left").select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
        F.col("saved").alias("saved_tokens"), F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def op12_lexical_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of each benchmark item."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10).select(
        F.col("item").alias("item_id"), "rank", F.col("doc").cast("bigint").alias("doc_id"), "score")


def op13_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents inside 10-word windows of the benchmark."""
    c = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10)
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["first"])
    return c.select(F.col("id").alias("doc_id"), F.col("n_words").cast("bigint").alias("n_words"), hit.alias("n_hit"),
                    F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                    (F.size("spans") > 0).alias("contaminated"))


LLM_QUERIES = {
    "op1_quality": op1_quality,
    "op2_warc": op2_warc,
    "op3_url_filters": op3_url_filters,
    "op4_mixing": op4_mixing,
    "op5_token_counts": op5_token_counts,
    "op6_ngram_jaccard": op6_ngram_jaccard,
    "op7_nn_descent": op7_nn_descent,
    "op8_toxicity": op8_toxicity,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_bpe": op10_bpe,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_lexical_scan": op12_lexical_scan,
    "op13_decontaminate": op13_decontaminate,
}

OP4_SQL = r"""
WITH d AS (SELECT doc_id, source,
                  coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
                  ('0x' || substr(md5('7|' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size,
             [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w
      FROM d GROUP BY source),
o AS (SELECT *, 2.0::DOUBLE * source_size AS clamp,
             (SELECT sum(source_size) * 1.5::DOUBLE FROM s) AS whole,
             sum(2.0::DOUBLE * source_size) OVER (ORDER BY source_size / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS used,
             sum(w) OVER (ORDER BY source_size / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS wleft FROM s),
c AS (SELECT *, w * (whole - coalesce(used, 0)) / wleft > clamp AS clamped FROM o),
f AS (SELECT coalesce(sum(clamp) FILTER (clamped), 0) AS used, sum(w) FILTER (NOT clamped) AS w FROM c),
t AS (SELECT c.source, source_size, CASE WHEN clamped THEN clamp ELSE c.w * (whole - f.used) / f.w END AS target FROM c, f),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
q AS (SELECT *, round(target - whole * source_size)::BIGINT AS more FROM p),
x AS (SELECT d.doc_id, d.size, d.h, q.*,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS upto
      FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size, source_size, target,
       (whole * size + greatest(0, least(size, more - upto)))::BIGINT AS taken FROM x
"""

OP2_SQL = """
WITH d AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
x AS (SELECT page_id, strlen(payload) AS payload_bytes, sha256(payload) AS payload_digest,
             min(page_id) OVER (PARTITION BY payload) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND first <> page_id THEN first END AS refers_to FROM x
"""

OP9_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""

# equal sets of shingles are one node, links are followed to the end
OP6_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(
             translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
g AS (SELECT r, doc_id, list_sort(list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))
                                                     WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS grams FROM d),
s AS (SELECT min(doc_id) AS id, grams, len(grams) AS n FROM g WHERE len(grams) > 0 GROUP BY grams),
e AS MATERIALIZED (SELECT row_number() OVER () AS node, id, n, grams FROM s),
x AS MATERIALIZED (SELECT node, n, hash(unnest(grams)) AS gram FROM e),
l AS MATERIALIZED (SELECT a, b FROM (SELECT p.node AS a, q.node AS b, any_value(p.n) AS na, any_value(q.n) AS nb, count(*) AS inter
                                     FROM x p JOIN x q ON p.gram = q.gram AND p.node <> q.node AND 100 * least(p.n, q.n) >= 90 * greatest(p.n, q.n) GROUP BY ALL)
                   WHERE 100 * inter >= 90 * (na + nb - inter)),
c(a, b) AS (SELECT a, b FROM l UNION SELECT c.a, l.b FROM c JOIN l ON c.b = l.a),
m AS (SELECT e.grams, least(e.id, coalesce(min(o.id), e.id)) AS component_id FROM e LEFT JOIN c ON c.a = e.node LEFT JOIN e AS o ON o.node = c.b GROUP BY e.grams, e.id)
SELECT doc_id, len(g.grams)::BIGINT AS n_shingles, coalesce(component_id, doc_id) AS component_id FROM g LEFT JOIN m ON m.grams = g.grams
"""

OP7_SQL = """
WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
u AS MATERIALIZED (SELECT vec_id, v FROM v WHERE v IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                   AND len(list_filter(v, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (SELECT p.vec_id AS a, q.vec_id AS b FROM u p JOIN u q ON p.vec_id <> q.vec_id AND list_cosine_similarity(p.v, q.v) >= 0.95),
c(a, b) AS (SELECT a, b FROM l UNION SELECT c.a, l.b FROM c JOIN l ON c.b = l.a),
k AS (SELECT a, count(*) AS n FROM l GROUP BY a),
m AS (SELECT a, min(b) AS least FROM c GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(m.least, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(m.least, vec_id)) AS kept
FROM v LEFT JOIN k ON k.a = vec_id LEFT JOIN m ON m.a = vec_id
"""

# the table of CRC-32 is computed; a conversation's node is the text of its turn digests so far
OP11_SQL = r"""
WITH tab AS (SELECT list(t ORDER BY i) AS crc FROM (
       SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: xor(c >> 1, 3988292384 * (c & 1))) AS t FROM range(256) r(i))),
t AS (SELECT conv_id AS c, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || strlen(coalesce(text, '')) || ':' || coalesce(text, ''))[1:32] AS step,
             coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS words, turn
      FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT c, step, words, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, step) - 1 AS pos FROM t),
h AS (SELECT c, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
                        lambda s, b: xor(crc[(xor(s, b) & 255) + 1], s >> 8)), 4294967295) % 4 AS h
      FROM (SELECT DISTINCT c FROM t), tab),
r AS (SELECT h.c, -1 AS pos, '' AS step, 0 AS words FROM h
      UNION ALL SELECT h.c, o.pos, o.step, o.words FROM h JOIN o ON o.c = h.c - h.c % 20 AND o.pos < h.h
      UNION ALL SELECT h.c, o.pos, o.step, o.words FROM h JOIN o ON o.c = h.c AND o.pos >= h.h),
p AS (SELECT c, words, row_number() OVER w - 1 AS depth, md5(string_agg(step, '') OVER w) AS node,
             row_number() OVER (PARTITION BY c ORDER BY pos DESC) = 1 AS ends
      FROM r WINDOW w AS (PARTITION BY c ORDER BY pos ROWS UNBOUNDED PRECEDING)),
q AS (SELECT *, lag(node) OVER (PARTITION BY c ORDER BY depth) AS parent FROM p),
n AS (SELECT node, min(c) AS conv_id, min(depth) AS depth, min(parent) AS parent, count(*) AS n_convs, min(words) AS words,
             sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256 FROM q GROUP BY node),
k AS (SELECT parent AS node, count(*) AS n_children FROM n WHERE parent IS NOT NULL GROUP BY parent),
u AS (SELECT p.node, count(*) FILTER (k.node IS NULL) AS n_leaves, sum((n.n_convs - 1) * n.words)::BIGINT AS saved_tokens
      FROM n LEFT JOIN k USING (node) JOIN p ON p.c = n.conv_id AND p.depth <= n.depth GROUP BY p.node)
SELECT n.conv_id, n.depth, m.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, n.ends_sha256
FROM n LEFT JOIN k USING (node) JOIN u USING (node) LEFT JOIN n AS m ON m.node = n.parent
"""

OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, unnest(regexp_extract_all(
             translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
i AS (SELECT item_id, term, count(*) AS reps FROM (SELECT item_id, unnest(regexp_extract_all(
             translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
      GROUP BY ALL),
s AS (SELECT r, count(*) AS n FROM d GROUP BY r),
a AS (SELECT count(*) AS texts, sum(n)::BIGINT AS total FROM s),
f AS (SELECT r, doc_id, term, count(*) AS tf FROM d GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * texts + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM f, a GROUP BY term, texts),
x AS (SELECT f.r, doc_id, item_id, sum(reps * w.w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * texts) // total))))::BIGINT AS score
      FROM f JOIN i USING (term) JOIN w USING (term) JOIN s USING (r), a GROUP BY ALL),
y AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank FROM x WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM y WHERE rank <= 10
"""

OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(
             translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS words FROM documents),
b AS (SELECT item_id, regexp_extract_all(
             translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
v AS (SELECT item_id, words, unnest(range(1, greatest(len(words) - 10, 0) + 2)) AS s FROM b WHERE len(words) > 0),
w AS (SELECT DISTINCT item_id, least(len(words), 10) AS k, array_to_string(words[s:s + 9], ' ') AS win FROM v),
g AS (SELECT r, k, words, unnest(range(1, len(words) - k + 2)) AS s FROM d, (SELECT DISTINCT k FROM w)),
o AS (SELECT r, s, g.k, item_id FROM (SELECT r, s, k, array_to_string(words[s:s + k - 1], ' ') AS win FROM g) g JOIN w ON w.k = g.k AND w.win = g.win),
h AS (SELECT r, count(DISTINCT spot) AS n_hit FROM (SELECT r, unnest(range(s, s + k)) AS spot FROM o) GROUP BY r),
i AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM o) GROUP BY r)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN i USING (r)
"""

LLM_ORACLES = {
    "op2_warc": OP2_SQL,
    "op4_mixing": OP4_SQL,
    "op6_ngram_jaccard": OP6_SQL,
    "op7_nn_descent": OP7_SQL,
    "op9_exact_dedup": OP9_SQL,
    "op11_prefix_trie": OP11_SQL,
    "op12_lexical_scan": OP12_SQL,
    "op13_decontaminate": OP13_SQL,
}
