"""N-gram Jaccard join: prefix filters under several global token orders, exact verification, components.

1. Documents with the same shingle set are one class (128-bit key); only classes are compared.
2. A fixed-size table of token counts over all documents gives the first order, rare tokens first. Two classes that are similar enough share
   one of each other's first tokens in *every* order, so classes meet in buckets of first tokens of that order.
3. Every class is first compared with one member of its buckets only (the one most buckets propose). A bucket proposes its most
   central member, the one whose first tokens are the most common; in a group of near copies that is the text the others were
   made from, so this already joins them, without pairs among them.
4. Buckets that still hold several components are compared across components (members of the largest component in a bucket only with
   the others). A pair meets only where the token stands early enough in both sets for their two sizes (``last_place``): whoever has more
   tokens of its own before the first common one cannot reach the threshold. Texts that miss it narrowly have their own, rare tokens first
   and so hardly meet anybody. Pairs must share first tokens under the other orders too; what is left is verified exactly.

No link is lost: a link's first common token lies early enough in both sets, so the link is in that bucket, and is there either inside one
component already or compared in step 4. Buckets are
range-partitioned by (token, class), so a token of a third of all documents spreads over many tasks and is streamed, never gathered.

Defined cases: null, empty or blank texts have the empty set and are linked with nothing; fewer words than a shingle are one shingle of
them all. Rows that repeat a ``doc_id`` are judged one by one. A null ``doc_id`` takes part, and shows as null only if nobody else is
in the component. Other columns are never read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import text_or_empty
from .graph import components, merged
from .shingles import mix, shingle_set

COUNTERS = 1 << 20  # token counters, whatever the size of the corpus
CHUNK = 1 << 14
ORDERS = 2  # further orders, by differently seeded hashes


def needed(n, percent: int):
    """Least common tokens of two sets of which the larger has n."""
    return (percent * n + 99) // 100


def least_common(x, y, percent: int):
    """Least intersection of two similar sets of sizes x and y, as columns."""
    return F.floor((F.lit(percent) * (x + y) + F.lit(99 + percent)) / F.lit(100 + percent))


def last_place(n, x, y, percent: int):
    """Last place (from 0) that the first common token of two similar sets of sizes x and y can have in the one of size n: all before it are not shared."""
    return n - least_common(x, y, percent)


def least_shared(x, y, percent: int):
    """Least number of common first tokens of two similar sets of sizes x and y, as columns. The set whose first tokens end earlier in the order
    shares none of its other first tokens, so the intersection is at most the common first tokens and that set's rest."""
    both = least_common(x, y, percent)
    rest = F.floor((F.lit(percent) * F.greatest(x, y) + F.lit(99)) / F.lit(100)) - 1
    return F.greatest(both - rest, F.lit(1))


def _key(tokens: np.ndarray) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(tokens.tobytes())
    return (h >> 64) - (1 << 63), (h & ((1 << 64) - 1)) - (1 << 63)


def _digests(width: int):
    def run(batches):
        counts = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            k1, k2, sizes = [], [], []
            for text in batch.column(1).to_pylist():
                s = shingle_set(text, width)
                np.add.at(counts, (s & np.uint64(COUNTERS - 1)).astype(np.int64), 1)
                a, b = _key(s)
                k1.append(a)
                k2.append(b)
                sizes.append(len(s))
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())],
                names=["doc_id", "row_hash", "n", "k1", "k2", "chunk", "counts"],
            )
        if counts.any():
            chunks = [i for i in range(COUNTERS // CHUNK) if counts[i * CHUNK : (i + 1) * CHUNK].any()]
            packed = [zlib.compress(counts[i * CHUNK : (i + 1) * CHUNK].tobytes(), 1) for i in chunks]
            none = pa.nulls(len(chunks), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, none, none, none, pa.array(chunks, pa.int32()), pa.array(packed, pa.binary())], names=["doc_id", "row_hash", "n", "k1", "k2", "chunk", "counts"])

    return run


def _add_counts(group: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(zlib.decompress(b), np.int64) for b in group["counts"])
    return pd.DataFrame({"chunk": [group["chunk"].iloc[0]], "counts": [zlib.compress(total.tobytes(), 1)]})


def _token_counts(rows: DataFrame) -> np.ndarray:
    """Sum of all tasks' counters, in two levels; a fixed number of bytes reaches the driver."""
    parts = rows.filter(F.col("chunk").isNotNull()).select("chunk", "counts", F.pmod(F.xxhash64("counts"), F.lit(32)).alias("slot"))
    first = parts.groupBy("chunk", "slot").applyInPandas(_add_counts, "chunk int, counts binary")
    out = np.zeros(COUNTERS, np.int64)
    for chunk, counts in first.groupBy("chunk").applyInPandas(_add_counts, "chunk int, counts binary").collect():
        out[chunk * CHUNK : (chunk + 1) * CHUNK] = np.frombuffer(zlib.decompress(counts), np.int64)
    return out


def first_tokens(tokens: np.ndarray, percent: int, counts: np.ndarray | None = None, seed: int = 0) -> np.ndarray:
    """The tokens that a similar set must share one of, in the order by counts or by a seeded hash."""
    p = len(tokens) - int(needed(len(tokens), percent)) + 1
    if counts is not None:
        order = np.lexsort((tokens, counts[(tokens & np.uint64(COUNTERS - 1)).astype(np.int64)]))
    else:
        order = np.argsort(mix(tokens ^ np.uint64(0x5851F42D4C957F2D * (seed + 1) % (1 << 64))))
    return tokens[order[:p]]


def _prefixes(width: int, percent: int, counts):
    def run(batches):
        weights = counts.value
        for batch in batches:
            k1, k2, sizes, central, firsts = [], [], [], [], []
            for text in batch.column(0).to_pylist():
                s = shingle_set(text, width)
                if len(s):
                    a, b = _key(s)
                    f = first_tokens(s, percent, weights)
                    k1.append(a)
                    k2.append(b)
                    sizes.append(len(s))
                    central.append(int(1000 * np.log(weights[(f & np.uint64(COUNTERS - 1)).astype(np.int64)]).mean()))
                    firsts.append(f.view(np.int64))
            offsets = np.concatenate([[0], np.cumsum([len(f) for f in firsts])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(firsts) if firsts else np.empty(0, np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(sizes, pa.int64()), pa.array(central, pa.int64()), lists], names=["k1", "k2", "n", "central", "firsts"])

    return run


_MEMBERS = pa.schema([(c, pa.int64()) for c in ("token", "central", "k1", "n", "top_central", "top", "top_n")] + [("edge", pa.bool_())])


def _members(batches):
    """Stream rows sorted by (token, central descending, k1): members of buckets with at least two, with the first member as the bucket's
    top. The first and last bucket of a task may go on elsewhere; their rows are always reported, and marked."""
    first = prior = None
    waiting: tuple | None = None  # the last row so far, not reported yet
    top = np.zeros(3, np.int64)  # central, k1 and n of the open bucket's first row

    def out(rows: np.ndarray, tops: np.ndarray, edge: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (*rows, *tops, edge)], schema=_MEMBERS)

    ended: list[pa.RecordBatch] = []  # rows of the open bucket in the latest batch
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.stack([batch.column(i).to_numpy() for i in range(4)])
        t = rows[0]
        same = t[1:] == t[:-1]
        goes_on = prior is not None and t[0] == prior
        if first is None:
            first = t[0]
        if waiting is not None and goes_on:
            ended.append(out(*waiting))
        starts = np.flatnonzero(np.concatenate([[not goes_on], ~same]))
        run = np.cumsum(np.concatenate([[0 if goes_on else 1], (~same).astype(np.int64)]))  # 0: the bucket open before
        tops = np.concatenate([top[:, None], rows[1:][:, starts]], 1)[:, run]
        keep = np.concatenate([[goes_on], same]) | np.append(same, False) | (t == first)
        open_ = t == t[-1]
        if not goes_on or not open_[0]:
            for b in ended:  # that bucket ended inside this task
                yield b if first == b.column(0)[0].as_py() else b.set_column(7, "edge", pa.array(np.zeros(b.num_rows, np.bool_)))
            ended = []
        else:
            for b in ended:
                yield b
            ended = []
        now = keep & ~open_
        if now.any():
            yield out(rows[:, now], tops[:, now], t[now] == first)
        now = keep & open_
        if now.any():
            ended = [out(rows[:, now], tops[:, now], np.ones(int(now.sum()), np.bool_))]
        last = np.array([len(t) - 1])
        waiting = None if keep[-1] else (rows[:, last], tops[:, last], np.ones(1, np.bool_))
        prior, top = t[-1], tops[:, -1]
    yield from ended
    if waiting is not None:
        yield out(*waiting)


def _texts(width: int):
    def run(batches):
        for batch in batches:
            texts = batch.column(0).to_pylist()
            keys = [_key(shingle_set(t, width)) for t in texts]
            packed = [zlib.compress(t.encode(), 1) for t in texts]  # these are shuffled a few times
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in keys], pa.int64()), pa.array([b for _, b in keys], pa.int64()), pa.array(packed, pa.binary())], names=["k1", "k2", "text"])

    return run


def _verify(width: int, percent: int):
    def run(batches):
        for batch in batches:
            good, latest = [], (b"", None)
            for x, y in zip(batch.column("x_text").to_pylist(), batch.column("y_text").to_pylist()):
                a = shingle_set(zlib.decompress(x).decode(), width)
                if latest[0] != y:
                    latest = (y, shingle_set(zlib.decompress(y).decode(), width))
                b = latest[1]
                ok = min(len(a), len(b)) * 100 >= percent * max(len(a), len(b))
                for seed in range(ORDERS):
                    ok = ok and len(np.intersect1d(first_tokens(a, percent, seed=seed), first_tokens(b, percent, seed=seed), assume_unique=True)) > 0
                if ok:
                    inter = len(np.intersect1d(a, b, assume_unique=True))
                    ok = 100 * inter >= percent * (len(a) + len(b) - inter)
                good.append(ok)
            yield batch.select(["x1", "x2", "y1", "y2"]).filter(pa.array(good, pa.bool_()))

    return run


def similar_components(docs: DataFrame, width: int = 4, percent: int = 85, by_row: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document; sets link when ``100 * intersection >= percent * union``.

    ``by_row`` adds what tells rows and components apart when ids are missing or repeated: ``row_hash``, the text's 64-bit hash, and
    ``component``, the key of the component's smallest class (null for an empty set, which is linked with nothing)."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), F.xxhash64(text_or_empty()).alias("row_hash"))
    digests = materialize(rows.mapInArrow(_digests(width), "doc_id long, row_hash long, n long, k1 long, k2 long, chunk int, counts binary"))
    counts = spark.sparkContext.broadcast(_token_counts(digests))  # COUNTERS numbers
    members = digests.filter(F.col("chunk").isNull()).select("doc_id", "row_hash", "n", "k1", "k2")

    prefixes = rows.select("text").mapInArrow(_prefixes(width, percent, counts), "k1 long, k2 long, n long, central long, firsts array<long>")
    classes = prefixes.groupBy("k1", "k2").agg(F.first("n").alias("n"), F.first("central").alias("central"), F.first("firsts").alias("firsts"))
    order = [F.col("token"), F.col("central").desc(), F.col("k1")]
    # a set's size and the token's place in its order travel as one number
    spread = classes.select(F.posexplode("firsts").alias("place", "token"), "central", "k1", "n")
    placed = spread.select("token", "central", "k1", (F.shiftleft("n", 32) + F.col("place")).alias("n")).repartitionByRange(*order).sortWithinPartitions(*order)
    found = placed.mapInArrow(_members, "token long, central long, k1 long, n long, top_central long, top long, top_n long, edge boolean")
    buckets = materialize(found.select("token", "k1", F.shiftright("n", 32).alias("n"), F.expr("n & 4294967295").alias("place"), "top_central", "top", F.shiftright("top_n", 32).alias("top_n"), "edge"))

    # a bucket cut by task borders takes the first of its tops; at most two such buckets a task
    cut = buckets.filter("edge").groupBy("token").agg(F.max(F.struct("top_central", "top", "top_n")).alias("t"))
    tops = F.broadcast(cut.select("token", F.col("t.top").alias("all_top"), F.col("t.top_n").alias("all_top_n")))
    proposed = buckets.join(tops, "token", "left").select("k1", "n", F.coalesce("all_top", "top").alias("top"), F.coalesce("all_top_n", "top_n").alias("top_n"))
    votes = proposed.groupBy("k1", "n", "top", "top_n").agg(F.count(F.lit(1)).alias("votes"))
    # tokens of a class that anybody else may hold among the first ones
    held = materialize(votes.groupBy("k1").agg(F.sum("votes").alias("held"), F.max(F.when((F.col("k1") != F.col("top")) & (F.col("votes") >= least_shared(F.col("n"), F.col("top_n"), percent)), F.struct("votes", "top"))).alias("b")))
    first = held.filter(F.col("b").isNotNull()).select(F.col("k1").alias("x"), F.col("b.top").alias("y"))

    ids = members.filter("n > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("doc_id"))
    # alike classes of equal size must share some first tokens; those of other sizes at least one
    wanted = merged(ids, held.select("k1"), "k1", "left_semi")
    texts = rows.join(wanted.select("doc_id").distinct(), rows.doc_id.eqNullSafe(wanted.doc_id), "left_semi").select("text").mapInArrow(_texts(width), "k1 long, k2 long, text binary")
    texts = materialize(merged(texts, wanted, ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"]))

    def verified(pairs: DataFrame) -> DataFrame:
        left = texts.select(F.col("k1").alias("x1"), F.col("k2").alias("x2"), F.col("text").alias("x_text"))
        right = texts.select(F.col("k1").alias("y1"), F.col("k2").alias("y2"), F.col("text").alias("y_text"))
        both = pairs.join(left, pairs.x == left.x1).join(right, pairs.y == right.y1).select("x1", "x2", "y1", "y2", "x_text", "y_text")
        found = both.mapInArrow(_verify(width, percent), "x1 long, x2 long, y1 long, y2 long")
        return found.select(F.struct(F.col("x1").alias("k1"), F.col("x2").alias("k2")).alias("u"), F.struct(F.col("y1").alias("k1"), F.col("y2").alias("k2")).alias("v"))

    links = materialize(verified(first))
    # labels of one component each: where two steps towards the tops lead
    step = links.select(F.col("u.k1").alias("k1"), F.col("v.k1").alias("up")).groupBy("k1").agg(F.min("up").alias("up"))
    second_step = step.select(F.col("k1").alias("up"), F.col("up").alias("upper"))
    labels = merged(held.select("k1", "held"), step, "k1", "left").join(second_step, "up", "left").select("k1", "held", F.coalesce("upper", "up", "k1").alias("label"))
    mixed = merged(buckets.select("token", "k1", "n", "place"), labels, "k1")
    per_label = mixed.groupBy("token", "label").agg(F.count("k1").alias("c"))
    major = per_label.groupBy("token").agg(F.max(F.struct("c", "label")).alias("b"), F.count("label").alias("labels")).filter("labels > 1")
    open_ = materialize(mixed.join(major.select("token", F.col("b.label").alias("major")), "token"))
    few = open_.filter("label <> major").select("token", *[F.col(c).alias(f"x_{c}") for c in ("k1", "n", "held", "label", "place")])
    every = open_.select("token", *[F.col(c).alias(f"y_{c}") for c in ("k1", "n", "held", "label", "place")], (F.col("label") == F.col("major")).alias("y_major"))
    fits = F.least("x_n", "y_n") * 100 >= F.lit(percent) * F.greatest("x_n", "y_n")
    early = (F.col("x_place") <= last_place(F.col("x_n"), F.col("x_n"), F.col("y_n"), percent)) & (F.col("y_place") <= last_place(F.col("y_n"), F.col("x_n"), F.col("y_n"), percent))
    enough = F.least("x_held", "y_held") >= least_shared(F.col("x_n"), F.col("y_n"), percent)
    once = F.col("y_major") | (F.col("x_k1") < F.col("y_k1"))
    crossing = few.join(every, "token").filter((F.col("x_label") != F.col("y_label")) & once & fits & early & enough)
    # x and y change places from bucket to bucket, as the majors do
    second = crossing.select(F.least("x_k1", "y_k1").alias("x"), F.greatest("x_k1", "y_k1").alias("y")).distinct()
    all_links = links.unionAll(verified(second))
    final = components(all_links)
    named = final.select(F.col("node.k1").alias("k1"), F.col("node.k2").alias("k2"), F.col("root.k1").alias("r1"), F.col("root.k2").alias("r2"))
    classes_ = members.filter("n > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    joined = merged(classes_, named, ["k1", "k2"], "left")
    smallest = joined.filter(F.col("r1").isNotNull()).groupBy("r1", "r2").agg(F.min("least").alias("component"))
    of_class = merged(joined.filter((F.col("copies") > 1) | F.col("r1").isNotNull()), smallest, ["r1", "r2"], "left").select("k1", "k2", "r1", "r2", F.coalesce("component", "least").alias("component"))
    out = merged(members, of_class, ["k1", "k2"], "left")
    root = F.when(F.col("n") > 0, F.struct(F.coalesce("r1", "k1").alias("k1"), F.coalesce("r2", "k2").alias("k2")))
    more = ["row_hash", root.alias("component")] if by_row else []
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"), *more)
