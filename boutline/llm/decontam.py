"""Benchmark decontamination: SimHash of item-sized windows, a multi-index over fingerprint blocks, exact verification.

Only built-in expressions are used. A document is split into words once; a window of an item's size can only be similar enough when
it holds that many of the item's shingles, so a fixed-size bit table of benchmark shingles keeps whole documents out before anything
is shuffled (false positives only cost time; the exact join that follows removes them). Every window with that many of the item's
shingles, in whatever order, gets a 64-bit SimHash and keeps the items it was cut for (one that is similar enough shares that many shingles, so it
is among them). A window meets these items in ``radius + 1`` fingerprint blocks: two fingerprints within ``radius`` bits agree in at least one
block, so none is missed, and the work grows with the windows, not with windows times items. A pair is taken in its first common block only. The
exact multiset similarity of the shingles (sum of smaller counts over sum of larger counts) decides.

Defined cases: null or empty texts and items match nothing; an item without an id is an item. Texts and items of fewer words than a shingle are one shingle of all their
words, so such an item only meets texts that consist of it. A text shorter than an item is one window. Rows that repeat a ``doc_id``
are judged one by one and told apart by ``row_hash``, the 64-bit hash of the text; the best match of a (doc_id, row_hash, item_id) is reported once, so
rows that repeat id and text are one. Other columns are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import text_or_empty

BITS = 1 << 20  # size of the shingle bit table, whatever the size of the benchmark or the corpus


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles(text: Column, width: int) -> Column:
    """Hashes of the word shingles in order; ``array`` is bound once so that the split is not repeated per element."""

    def hashed(w: Column) -> Column:
        many = F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - width, F.lit(0))), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(width)]))
        return F.when(F.size(w) >= width, many).when(F.size(w) > 0, F.array(F.xxhash64(F.concat_ws(" ", w), F.lit(width)))).otherwise(F.array().cast("array<bigint>"))

    return F.get(F.transform(F.array(words(text)), hashed), 0)


def simhash(array: Column) -> Column:
    """64-bit SimHash; a shingle counts as often as it occurs."""
    bits = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda b: F.aggregate(array, F.lit(0), lambda acc, h: acc + F.lit(1) - F.lit(2) * F.getbit(h, b).cast("int")))
    return F.aggregate(bits, F.lit(0).cast("bigint"), lambda acc, v: F.shiftleft(acc, 1).bitwiseOR(F.when(v < 0, F.lit(1)).otherwise(F.lit(0)).cast("bigint")))


def block(fingerprint: Column, b: int, blocks: int) -> Column:
    lo, hi = 64 * b // blocks, 64 * (b + 1) // blocks
    return F.shiftrightunsigned(fingerprint, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1))


def items_of(benchmark: DataFrame, width: int, similarity: float) -> DataFrame:
    """One row per usable item: shingles, their number and how many of them a similar window must share."""
    rows = benchmark.select(F.col("item_id"), shingles(text_or_empty(), width).alias("shingles")).filter(F.size("shingles") > 0)
    m = F.size("shingles")
    # inter / (2 m - inter) >= s for windows of m shingles; shorter texts need no more
    return rows.select("item_id", "shingles", m.alias("m"), F.ceil(F.lit(similarity) * m - F.lit(1e-9)).cast("int").alias("need"))


def _bit_table(items: DataFrame) -> list[int]:
    """Dense bit table of two hash positions per shingle, at most BITS / 64 rows on their way to the driver."""
    h = F.explode("shingles").alias("h")
    spots = items.select(h).select(F.explode(F.array(F.col("h").bitwiseAND(F.lit(BITS - 1)), F.shiftrightunsigned("h", 20).bitwiseAND(F.lit(BITS - 1)))).alias("at"))
    found = spots.groupBy(F.shiftright("at", 6).alias("slot")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("mask")).collect()
    table = [0] * (BITS // 64)
    for slot, mask in found:
        table[slot] = mask
    return table


def contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 5, similarity: float = 0.8, radius: int = 16) -> DataFrame:
    """(doc_id, row_hash, item_id, similarity, start_word, n_words) of every document with a window of an item's size whose fingerprint is within
    ``radius`` bits of the item's and whose shingles are at least ``similarity`` alike."""
    items = materialize(items_of(benchmark, width, similarity))
    (least,) = items.agg(F.min("need")).first()
    bits = F.split(F.lit(",".join(map(str, _bit_table(items)))), ",").cast("array<bigint>")

    def known(h: Column) -> Column:
        one = F.getbit(F.get(bits, F.shiftright(h.bitwiseAND(F.lit(BITS - 1)), 6).cast("int")), h.bitwiseAND(F.lit(63)).cast("int"))
        g = F.shiftrightunsigned(h, 20)
        two = F.getbit(F.get(bits, F.shiftright(g.bitwiseAND(F.lit(BITS - 1)), 6).cast("int")), g.bitwiseAND(F.lit(63)).cast("int"))
        return (one == 1) & (two == 1)

    marked = F.transform(
        F.array(shingles(text_or_empty(), width)),
        lambda sh: F.struct(sh.alias("sh"), F.filter(F.sequence(F.lit(0), F.size(sh) - 1), lambda i: known(F.get(sh, i))).alias("hits")),
    )
    # a generator evaluates its input once; documents with too few known shingles end here
    enough = F.filter(F.when(F.length(F.coalesce("text", F.lit(""))) > 0, marked), lambda s: F.size(s["hits"]) >= F.lit(least or 1))
    near = materialize(docs.select(F.col("doc_id"), F.xxhash64(text_or_empty()).alias("row_hash"), F.inline(enough)))

    # items of equal shingles share a key; a key of two different ones would only mean windows more to verify
    item_shingles = items.select(F.xxhash64("shingles").alias("ikey"), "m", "need", "shingles").dropDuplicates(["ikey"]).select("ikey", "m", "need", F.explode(F.array_distinct("shingles")).alias("h"))
    hits = near.select("doc_id", "row_hash", F.size("sh").alias("n"), F.explode("hits").alias("pos"), F.col("sh").alias("sh")).select("doc_id", "row_hash", "n", "pos", F.get("sh", F.col("pos")).alias("h"))
    shared = hits.join(item_shingles, "h")
    lined = shared.groupBy("doc_id", "row_hash", "ikey", "n", "m", "need").agg(F.array_sort(F.collect_set("pos")).alias("at")).filter(F.size("at") >= F.col("need"))

    def window_starts(j: Column) -> Column:
        """Starts behind known position j - 1 and not behind j whose window also holds the need-th known position from j on."""
        lo = F.greatest(F.coalesce(F.get("at", j - 1) + 1, F.lit(0)), F.get("at", j + F.col("need") - 1) - F.col("m") + 1, F.lit(0))
        hi = F.least(F.get("at", j), F.greatest(F.col("n") - F.col("m"), F.lit(0)))
        return F.when(lo <= hi, F.sequence(lo, F.greatest(lo, hi))).otherwise(F.array().cast("array<int>"))

    every = F.flatten(F.transform(F.sequence(F.lit(0), F.size("at") - F.col("need")), window_starts))
    starts = lined.select("doc_id", "row_hash", "m", "ikey", F.explode(every).alias("start"))
    starts = starts.groupBy("doc_id", "row_hash", "m", "start").agg(F.collect_set("ikey").alias("cut_for"))
    starts = starts.groupBy("doc_id", "row_hash").agg(F.collect_list(F.struct("m", "start", "cut_for")).alias("windows"))
    a, b = near.alias("a"), starts.alias("b")
    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.row_hash") == F.col("b.row_hash"))
    cut = a.join(b, same).select(F.col("a.doc_id"), F.col("a.row_hash"), F.col("a.sh"), F.explode("b.windows").alias("w"))
    cut = cut.select("doc_id", "row_hash", F.col("w.m").alias("m"), F.col("w.start").alias("start"), F.col("w.cut_for").alias("cut_for"), F.slice("sh", F.col("w.start") + 1, F.col("w.m")).alias("window"))

    blocks = radius + 1
    windows = materialize(cut.select("*", simhash(F.col("window")).alias("print")))
    keyed = windows.select("*", F.explode("cut_for").alias("for_item"))
    keyed = keyed.select("*", F.posexplode(F.array(*[block(F.col("print"), i, blocks) for i in range(blocks)])).alias("b", "v")).drop("cut_for")
    prints = items.select("item_id", F.xxhash64("shingles").alias("ikey"), "shingles", simhash(F.col("shingles")).alias("iprint"))
    index = materialize(prints).select("*", F.posexplode(F.array(*[block(F.col("iprint"), i, blocks) for i in range(blocks)])).alias("ib", "iv"))
    first = F.coalesce(*[F.when(block(F.col("print"), i, blocks) == block(F.col("iprint"), i, blocks), F.lit(i)) for i in range(blocks)])
    pairs = keyed.join(index, (F.col("for_item") == F.col("ikey")) & (F.col("b") == F.col("ib")) & (F.col("v") == F.col("iv")))
    pairs = pairs.filter((first == F.col("b")) & (F.bit_count(F.col("print").bitwiseXOR(F.col("iprint"))) <= radius))
    alike = multiset_similarity(F.col("window"), F.col("shingles"))
    scored = pairs.select("doc_id", "row_hash", "item_id", "start", (F.size("window") + (width - 1)).alias("n_words"), alike.alias("similarity")).filter(F.col("similarity") >= F.lit(similarity))
    best = F.max(F.struct("similarity", (-F.col("start")).alias("before"), "n_words"))
    return scored.groupBy("doc_id", "row_hash", "item_id").agg(best.alias("best")).select(
        "doc_id", "row_hash", "item_id", F.col("best.similarity").alias("similarity"), (-F.col("best.before")).cast("long").alias("start_word"), F.col("best.n_words").cast("long").alias("n_words")
    )


def multiset_similarity(a: Column, b: Column) -> Column:
    """Sum of the smaller counts over the sum of the larger counts, over the distinct elements of both."""

    def count(array: Column, x: Column) -> Column:
        return F.size(F.filter(array, lambda y: y == x))

    inter = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda acc, x: acc + F.least(count(a, x), count(b, x)))
    return inter / (F.size(a) + F.size(b) - inter)
