"""Benchmark decontamination as a prefix-filtered set join, in built-in functions only.

A window is ``window`` consecutive words of an item (an item of fewer words is one window). A text holds a window when the
window's words stand in it one after the other. Both sides are sets of word shingles, and a text that holds a window holds
all its shingles:

* **Order by rarity.** The shingles of the items are counted over all texts. A window with a shingle that no text holds occurs nowhere.
* **Prefix.** For full containment the necessary prefix of a window is its rarest shingle alone, so a window is
  looked up by that one.
* **Position and length.** The place of the shingle in the window fixes where the window would begin, and it must lie inside the text.
* **Verify.** The words of the text there are compared with the window's words.

Texts are read once: the places whose shingle is in a bitmap of the items' shingles are written down, with the words of the
texts that have any; other texts are neither exploded nor shuffled. The bitmap has at most ``MAX_BITS`` bits, sized by the counted
shingles, and lets some others through; the join is exact. The table of windows is joined by broadcast when its measured bytes allow
it, else over (shingle, part), which also spreads a passage that a third of the texts hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.sizing import fits, spread_join
from .common import cut, numpy_bitmap, stored

NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_BITS, MAX_BITS = 1 << 12, 1 << 22
SPANS = "array<struct<first:int,end:int>>"


def words_of(text: Column) -> Column:
    """The words of a text, A-Z lower-cased; none for null."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), NO_WORD), "")


def _gram(hashes: str, at: Column, k: int) -> Column:
    """Hash of the ``k`` words from place ``at`` (from 0), of the array of word hashes."""
    return F.xxhash64(F.lit(k), *[F.get(F.col(hashes), at + j) for j in range(k)])


def _places(k: int) -> Column:
    """The places from which ``k`` words follow, of a text of ``n_words``."""
    return F.when(F.col("n_words") >= k, F.sequence(F.lit(0), F.col("n_words") - k)).otherwise(F.array().cast("array<int>"))


def _in_bitmap(keys: DataFrame, n: int) -> tuple[Column, int]:
    """The keys ``gram`` as a literal array of 64-bit words (about 32 bits a key, at most ``MAX_BITS``), and its bits."""
    bits = min(max(MIN_BITS, 1 << (32 * max(n, 1) - 1).bit_length()), MAX_BITS)
    words = numpy_bitmap(keys, "gram", bits).view("<i8")
    return F.split(F.lit(",".join(map(str, words.tolist()))), ",").cast("array<bigint>"), bits


def _marked(bitmap: Column, bits: int, key: Column) -> Column:
    at = key.bitwiseAND(F.lit(bits - 1).cast("bigint"))
    return F.getbit(F.get(bitmap, F.shiftright(at, 6).cast("int")), at.bitwiseAND(F.lit(63).cast("bigint")).cast("int")) == 1


def item_windows(items: DataFrame, item_col: str, text_col: str, window: int, shingle: int) -> DataFrame:
    """Distinct ``(item, win, k)`` with the window's words and the number of words of its shingles."""
    w = items.select(F.col(item_col).alias("item"), words_of(F.col(text_col)).alias("words")).where(F.size("words") > 0)
    w = w.select("item", "words", F.explode(F.sequence(F.lit(0), F.greatest(F.size("words") - window, F.lit(0)))).alias("s"))
    w = w.select("item", F.slice("words", F.col("s") + 1, F.lit(window)).alias("win")).distinct()
    return w.withColumn("k", F.least(F.size("win"), F.lit(shingle)))


def _shingles(windows: DataFrame, sizes: list[int]) -> DataFrame:
    """One row per shingle of each window: its hash and its place in the window."""
    w = windows.withColumn("hashes", F.transform("win", lambda x: F.xxhash64(x))).withColumn("n_words", F.size("win"))

    def of(k: int) -> Column:
        return F.transform(_places(k), lambda i: F.struct(_gram("hashes", i, k).alias("gram"), i.alias("at")))

    each = F.lit(None)
    for k in sizes:
        each = F.when(F.col("k") == k, of(k)).otherwise(each)
    return w.select("item", "win", "k", F.inline(each))


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, shingle: int = 5, *, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per input row: ``id, n_words, spans, items``.

    ``spans`` are the places of the words inside any occurrence of a window, as joined ranges ``(first, end)`` from 0,
    end exclusive, in order; ``items`` the item ids with an occurring window, as text, sorted as strings. Both are empty arrays
    when nothing occurs. Words are maximal runs of ASCII letters, digits and characters beyond ASCII, A-Z lower-cased. Null
    texts have no words; items without words have no window; an item with a null id counts as no item but its
    words are hit. Rows that repeat an id, or an item, are handled row by row (items with one id are one item). Other columns
    are ignored. An empty table of documents gives an empty result, an empty table of items leaves all clean.
    """
    windows = cut(item_windows(items, item_col, item_text_col, window, shingle))
    sizes = sorted(r["k"] for r in windows.select("k").distinct().collect())  # at most ``shingle`` numbers
    shingles = cut(_shingles(windows, sizes)) if sizes else None
    d = docs.select(F.col(id_col).alias("id"), words_of(F.col(text_col)).alias("words"))
    if not sizes:
        return d.select("id", F.size("words").alias("n_words"), F.expr(f"cast(array() as {SPANS})").alias("spans"),
                        F.expr("cast(array() as array<string>)").alias("items"))
    d = d.select("id", "words", F.transform("words", lambda x: F.xxhash64(x)).alias("hashes"), F.size("words").alias("n_words"))
    known = shingles.select("gram").distinct()
    bitmap, bits = _in_bitmap(known, known.count())

    def at(k: int) -> Column:
        return F.filter(_places(k), lambda i: _marked(bitmap, bits, _gram("hashes", i, k)))

    def hits(k: int) -> Column:
        return F.transform(f"at{k}", lambda i: F.struct(i.alias("place"), _gram("hashes", i, k).alias("gram")))

    met = (d.select("*", *[at(k).alias(f"at{k}") for k in sizes])
           .select("id", "n_words", "words", F.concat(*[hits(k) for k in sizes]).alias("hits"))
           .select("id", "n_words", F.when(F.size("hits") > 0, F.array_join("words", " ")).alias("words"), "hits"))
    met = stored(met.withColumn("row", F.monotonically_increasing_id()), "contamination")
    counts = met.select(F.explode("hits.gram").alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("held"))
    # the prefix of a window: its rarest shingle; windows with a shingle that no text holds are gone
    rare = cut(shingles.join(counts, "gram", "left").groupBy("item", "win", "k")
               .agg(F.min(F.struct(F.coalesce("held", F.lit(0)).alias("held"), "gram", "at")).alias("rarest"))
               .where("rarest.held > 0").select("item", "win", F.col("rarest.gram").alias("gram"), F.col("rarest.at").alias("at")))
    prefixes = rare.select("gram").distinct()
    bitmap, bits = _in_bitmap(prefixes, prefixes.count())

    def near(hit: Column) -> Column:
        """A hit with the words around it and the place of the first of them."""
        start = F.greatest(hit["place"] - (window - 1), F.lit(0))
        return F.struct(hit["place"].alias("place"), hit["gram"].alias("gram"), start.alias("from"),
                        F.slice("words", start + 1, F.lit(2 * window)).alias("near"))

    places = (met.where(F.size("hits") > 0)
              .select("row", "n_words", F.split("words", " ").alias("words"), F.filter("hits", lambda h: _marked(bitmap, bits, h["gram"])).alias("hits"))
              .select("row", "n_words", F.inline(F.transform("hits", near))))
    look = rare.select(F.col("gram").alias("_gram"), "item", "win", "at")
    cand = spread_join(places, look, [("gram", "_gram")], ["row", "place"], fits(look))
    first = F.col("place") - F.col("at")
    cand = cand.where((first >= 0) & (first + F.size("win") <= F.col("n_words")))
    found = (cand.where(F.slice("near", first - F.col("from") + 1, F.size("win")) == F.col("win"))
             .select("row", "item", first.alias("first"), (first + F.size("win")).alias("end")))
    found = cut(found.distinct())

    # joined ranges: a range that begins after all ends before it opens a new one
    order = Window.partitionBy("row").orderBy("first", "end")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    spans = (found.select("row", "first", "end").distinct()
             .withColumn("opens", F.coalesce(F.col("first") > F.max("end").over(before), F.lit(True)).cast("int"))
             .withColumn("nr", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
             .groupBy("row", "nr").agg(F.min("first").alias("first"), F.max("end").alias("end"))
             .groupBy("row").agg(F.array_sort(F.collect_list(F.struct("first", "end"))).alias("spans")))
    named = (found.where("item IS NOT NULL").select("row", F.col("item").cast("string").alias("item")).distinct()
             .groupBy("row").agg(F.array_sort(F.collect_list("item")).alias("items")))
    out = met.select("row", "id", "n_words").join(spans, "row", "left").join(named, "row", "left")
    return out.select("id", "n_words", F.coalesce("spans", F.expr(f"cast(array() as {SPANS})")).alias("spans"),
                      F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"))
