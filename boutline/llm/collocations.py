"""Phrase collocations: n-grams counted by direct-address tiling over frequency-ranked ids, longer phrases from frequent shorter ones.

Three passes over the text, each a map with a local count and an aggregation:

1. Words per language. The ``HEAD`` most frequent ones get the ranks 0, 1, ... as ids; a bit table tells words that occur often enough.
2. Pairs. A task numbers its other words behind the head, so a pair of ids is a cell of a square that is cut into tiles of ``SIDE`` x ``SIDE``.
   Full tiles (those of small ids: frequent words meet frequent words) are counted with a dense ``numpy.bincount``; the pairs of thin
   tiles are sorted and counted as coordinates.
3. Triples, by the same counter: frequent pairs are ranked again and a triple is the cell of its first pair's id and its last word's.

Nothing a task keeps grows with the corpus: the head and the bit tables have a fixed size, and a task's own numbers are given out anew when
there are ``OWN`` of them. A bit table lets through whatever it cannot exclude, so it only saves work; what a count is compared with is
always the whole sum. Words travel as 64-bit hashes of language and word; that no two words share one is checked on the vocabulary, and
the hash's seed moved on until it holds, so counts are exact.

Defined cases: a null or empty text has no words; a null language is ``und``; repeated rows count again; an empty table gives an empty
result. Other columns are never read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialize
from .common import slices

HEAD = 1 << 16  # ids with a rank of their own, over all languages
SIDE_BITS = 10
SIDE = 1 << SIDE_BITS
FULL = 1 << (2 * SIDE_BITS - 3)  # pairs of one buffer that make a tile dense
TILES = 8  # dense tiles a task keeps between buffers
BUFFER = 1 << 20  # words counted at once
OWN = 1 << 18  # words a task numbers itself before it starts anew
WORD_BITS, PAIR_BITS = 23, 26  # sizes of the bit tables
NONE = -1  # id of a border and of words that cannot be part of a phrase

_TABLE = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t", b"\n\n\n\n\n\n\n\n\n\n ")


def tokens(text: str) -> list[bytes]:
    """Words with A-Z lower-cased and a newline for every border between pieces."""
    return [w for w in text.encode().lower().translate(_TABLE).replace(b"\n", b" \n ").split(b" ") if w]


def word_key(lang: str, word: bytes, seed: int) -> int:
    return xxhash.xxh3_64_intdigest(word, xxhash.xxh3_64_intdigest(lang.encode(), seed)) - (1 << 63)


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit mix of two keys, for bit tables and lookups that are verified."""
    with np.errstate(over="ignore"):
        x = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ (b.astype(np.uint64) + np.uint64(0x7F4A7C15)) * np.uint64(0xC2B2AE3D27D4EB4F)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


def _has(table: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Bits of a table at the given places."""
    return (table[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1


# --- pass 1 -----------------------------------------------------------------------------------------------------------------------


def _count_words(flush: int):
    def run(batches):
        found: dict[tuple[str, bytes], int] = {}

        def rows():
            names = list(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array([n[0] for n in names], pa.string()), pa.array([n[1].decode() for n in names], pa.string()), pa.array(list(found.values()), pa.int64())], names=["lang", "word", "n"]
            )
            found.clear()

        for whole in batches:
            for batch in slices(whole, 1):
                by_lang: dict[str, dict[bytes, int]] = {}
                for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    counts = by_lang.setdefault(lang, {})
                    for word in tokens(text):
                        counts[word] = counts.get(word, 0) + 1
                for lang, counts in by_lang.items():
                    counts.pop(b"\n", None)
                    for word, n in counts.items():
                        found[lang, word] = found.get((lang, word), 0) + n
                if len(found) >= flush:
                    yield from rows()
        if found:
            yield from rows()

    return run


def _with_keys(seed: int):
    def run(batches):
        for batch in batches:
            keys = [word_key(lang, word.encode(), seed) for lang, word in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.int64())], names=["lang", "word", "n", "key"])

    return run


def vocabulary(docs: DataFrame) -> tuple[DataFrame, int]:
    """All words (lang, word, n, key) and the seed under which no two of them share a key."""
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    counted = rows.mapInArrow(_count_words(OWN), "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    words, seed = materialize(counted.mapInArrow(_with_keys(0), "lang string, word string, n long, key long")), 0
    while words.groupBy("key").count().filter("count > 1").limit(1).count():
        seed += 1
        words = materialize(words.drop("key").mapInArrow(_with_keys(seed), "lang string, word string, n long, key long"))
    return words, seed


def _bit_table(places: DataFrame, bits: int) -> np.ndarray:
    """Bits set at column ``place`` (0 to 2^bits - 1). At most 2^bits / 32,768 rows of 4 KB reach the driver, however many places there are."""
    rows = places.groupBy(F.expr("bitmap_bucket_number(place + 1)").alias("b")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(place + 1))").alias("m")).collect()
    table = np.zeros(1 << (bits - 3), np.uint8)
    for b, m in rows:
        table[(b - 1) * 4096 : b * 4096] = np.frombuffer(m, np.uint8)
    return table


# --- passes 2 and 3 -----------------------------------------------------------------------------------------------------------------


class Tiles:
    """Counts cells (left, right) of frequency-ranked ids: ``add`` takes a buffer of them and returns finished thin ones, ``rest`` the dense tiles."""

    def __init__(self):
        self.dense: dict[int, np.ndarray] = {}

    def add(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        inside = ((left & (SIDE - 1)) << SIDE_BITS) | (right & (SIDE - 1))
        small = (left < HEAD) & (right < HEAD)  # other ids change their meaning between buffers
        square = HEAD >> SIDE_BITS
        address = np.where(small, (left >> SIDE_BITS) * square + (right >> SIDE_BITS), square * square)
        load = np.bincount(address, minlength=square * square + 1)[:-1]
        thin = np.ones(len(left), np.bool_)
        for t in np.argsort(-load, kind="stable")[: 2 * TILES]:
            if t not in self.dense:
                if load[t] < FULL or len(self.dense) >= TILES:
                    continue
                self.dense[t] = np.zeros(SIDE * SIDE, np.int64)
            mine = address == t
            self.dense[t] += np.bincount(inside[mine], minlength=SIDE * SIDE)
            thin &= ~mine
        cells, n = np.unique((left[thin] << 32) | right[thin], return_counts=True)
        return cells >> 32, cells & 0xFFFFFFFF, n

    def rest(self):
        square = HEAD >> SIDE_BITS
        for t, counts in self.dense.items():
            at = np.flatnonzero(counts)
            yield (int(t) // square << SIDE_BITS) + (at >> SIDE_BITS), (int(t) % square << SIDE_BITS) + (at & (SIDE - 1)), counts[at]
        self.dense = {}


class _Ids(dict):
    """Ids of one language's words: ranks for the head, numbers of the task's own for others, NONE for those that are too rare."""

    def __init__(self, lang: str, coder: _Coder):
        super().__init__({b"\n": NONE})
        self.lang, self.coder = lang, coder

    def __missing__(self, word: bytes) -> int:
        self[word] = found = self.coder.number(word_key(self.lang, word, self.coder.seed))
        return found


class _Coder:
    """Texts to ids, buffer by buffer. ``keys[id]`` is the word's key."""

    def __init__(self, head: np.ndarray, bits: np.ndarray, seed: int):
        self.seed, self.bits, self.size = seed, bits, len(head)
        self.head = {int(k): i for i, k in enumerate(head)}
        self.base = head
        self.reset()

    def reset(self) -> None:
        self.langs: dict[str, _Ids] = {}
        self.own: list[int] = []
        self.seen = 0

    def number(self, key: int) -> int:
        self.seen += 1
        rank = self.head.get(key)
        if rank is not None:
            return rank
        place = (key + (1 << 63)) & ((1 << WORD_BITS) - 1)
        if not self.bits[place >> 3] >> (place & 7) & 1:
            return NONE
        self.own.append(key)
        return HEAD + len(self.own) - 1

    def keys(self) -> np.ndarray:
        out = np.zeros(HEAD + len(self.own), np.int64)
        out[: self.size] = self.base
        out[HEAD:] = self.own
        return out

    def buffers(self, batches):
        """(ids, keys) of consecutive texts with borders between them."""
        held, words = [], 0
        for whole in batches:
            for batch in slices(whole, 1):
                for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    if (ids := self.langs.get(lang)) is None:
                        ids = self.langs[lang] = _Ids(lang, self)
                    found = tokens(text)
                    held += [np.fromiter(map(ids.__getitem__, found), np.int64, len(found)), np.array([NONE])]
                    words += len(found) + 1
                    if words >= BUFFER or self.seen >= OWN:
                        yield np.concatenate(held), self.keys()
                        held, words = [], 0
                        if self.seen >= OWN:
                            self.reset()
        if held:
            yield np.concatenate(held), self.keys()


def _batch(columns: list[np.ndarray], names: list[str]):
    for at in range(0, len(columns[0]), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(c[at : at + (1 << 16)].astype(np.int64)) for c in columns], names=names)


def _count_pairs(shared):
    def run(batches):
        head, bits, seed = shared.value
        coder, tiles = _Coder(head, bits, seed), Tiles()
        for ids, keys in coder.buffers(batches):
            left, right = ids[:-1], ids[1:]
            both = (left >= 0) & (right >= 0)
            a, b, n = tiles.add(left[both], right[both])
            yield from _batch([keys[a], keys[b], n], ["k1", "k2", "n"])
        keys = coder.keys()
        for a, b, n in tiles.rest():
            yield from _batch([keys[a], keys[b], n], ["k1", "k2", "n"])

    return run


def _count_triples(shared):
    def run(batches):
        head, bits, seed, first, second, pair_bits = shared.value
        coder, tiles = _Coder(head, bits, seed), Tiles()
        mixed = _mixed(first, second)
        by_mix = np.argsort(mixed, kind="stable")
        sorted_mix = mixed[by_mix]
        mask = np.uint64((1 << PAIR_BITS) - 1)
        for ids, keys in coder.buffers(batches):
            both = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0))
            often = np.zeros(len(ids), np.bool_)
            often[both] = _has(pair_bits, _mixed(keys[ids[both]], keys[ids[both + 1]]) & mask)
            at = np.flatnonzero(often[:-1] & often[1:])
            pairs, which = np.unique((ids[at] << 32) | ids[at + 1], return_inverse=True)
            k1, k2 = keys[pairs >> 32], keys[pairs & 0xFFFFFFFF]
            # the rank of a head pair; others are numbered behind the head
            number = HEAD + np.arange(len(pairs))
            if len(first):
                here = _mixed(k1, k2)
                place = by_mix[np.minimum(np.searchsorted(sorted_mix, here), len(first) - 1)]
                same = (first[place] == k1) & (second[place] == k2)
                number = np.where(same, place, number)
            a, c, n = tiles.add(number[which], ids[at + 2])
            one, two = np.empty(len(a), np.int64), np.empty(len(a), np.int64)
            ranked = a < HEAD
            one[ranked], two[ranked] = first[a[ranked]], second[a[ranked]]
            one[~ranked], two[~ranked] = k1[a[~ranked] - HEAD], k2[a[~ranked] - HEAD]
            yield from _batch([one, two, keys[c], n], ["k1", "k2", "k3", "n"])
        keys = coder.keys()
        for a, c, n in tiles.rest():
            yield from _batch([first[a], second[a], keys[c], n], ["k1", "k2", "k3", "n"])

    return run


def _top(rows: DataFrame, by: str, *columns: str) -> list[np.ndarray]:
    """The HEAD most frequent rows, most frequent first: at most HEAD short rows on the driver."""
    found = rows.orderBy(F.col(by).desc(), *columns).limit(HEAD).select(*columns).collect()
    return [np.array([r[i] for r in found], np.int64) for i in range(len(columns))]


def _joined_word(rows: DataFrame, key: str, words: DataFrame, head: DataFrame, names: dict[str, str]) -> DataFrame:
    """``rows`` with columns of the word under ``key``. The head (fixed size) is broadcast, so that the many rows of a frequent word never meet in
    one task; they pass the join with the others spread out by their own hash."""
    few = head.select(F.col("key").alias("_h"), *[F.col(c).alias("_h_" + n) for c, n in names.items()])
    many = words.select(F.col("key").alias("_w"), *[F.col(c).alias("_w_" + n) for c, n in names.items()])
    near = rows.join(F.broadcast(few), F.col(key) == F.col("_h"), "left")
    apart = F.when(F.col("_h").isNull(), F.col(key)).otherwise(F.xxhash64(*[c for c in rows.columns if c.startswith("k")]))
    far = near.withColumn("_key", apart).join(many, (F.col("_key") == F.col("_w")) & F.col("_h").isNull(), "left")
    return far.select(*rows.columns, *[F.coalesce("_h_" + n, "_w_" + n).alias(n) for n in names.values()])


def _score(a: str, left: str, right: str) -> Column:
    """floor(1000000 * a * a / (left * right)) in whole decimals; counts up to 10^14 fit."""
    big = [F.col(c).cast("decimal(15,0)") for c in (a, left, right)]
    return F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * big[0] * big[0], big[1] * big[2]).cast("long")


def candidates(docs: DataFrame, least: int = 10) -> tuple[DataFrame, DataFrame]:
    """All phrases of two or three words with at least ``least`` occurrences (lang, k1, k2, k3, phrase, a, l, r, score, words), and the
    vocabulary. Not yet freed of phrases inside others."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    words, seed = vocabulary(docs)
    often = words.filter(F.col("n") >= least)
    (head,) = _top(often, "n", "key")
    low = F.col("key").bitwiseAND(F.lit((1 << WORD_BITS) - 1))
    bits = _bit_table(often.select(low.alias("place")), WORD_BITS)
    shared = spark.sparkContext.broadcast((head, bits, seed))
    pairs = rows.mapInArrow(_count_pairs(shared), "k1 long, k2 long, n long").groupBy("k1", "k2").agg(F.sum("n").alias("a")).filter(F.col("a") >= least)
    pairs = materialize(pairs)
    first, second = _top(pairs, "a", "k1", "k2")
    places = pairs.select("k1", "k2").mapInArrow(_pair_places, "place long")
    shared3 = spark.sparkContext.broadcast((head, bits, seed, first, second, _bit_table(places, PAIR_BITS)))
    triples = rows.mapInArrow(_count_triples(shared3), "k1 long, k2 long, k3 long, n long").groupBy("k1", "k2", "k3").agg(F.sum("n").alias("a")).filter(F.col("a") >= least)
    triples = materialize(triples)
    top_words = often.orderBy(F.col("n").desc(), "key").limit(HEAD)
    named = _joined_word(pairs, "k1", often, top_words, {"lang": "lang", "word": "w1", "n": "n1"})
    named = materialize(_joined_word(named, "k2", often, top_words, {"word": "w2", "n": "n2"}))
    two = named.select("lang", "k1", "k2", F.lit(None).cast("long").alias("k3"), F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", F.col("n1").alias("l"), F.col("n2").alias("r"), F.lit(2).alias("words"))
    heads = named.select("k1", "k2", "lang", "w1", "w2", "n1", F.col("a").alias("a12"))
    tails = named.select(F.col("k1").alias("k2"), F.col("k2").alias("k3"), F.col("w2").alias("w3"), F.col("n2").alias("n3"), F.col("a").alias("a23"))
    whole = triples.join(heads, ["k1", "k2"]).join(tails, ["k2", "k3"]).withColumns({"s1": _score("a", "n1", "a23"), "s2": _score("a", "a12", "n3")})
    early = F.col("s1") <= F.col("s2")
    three = whole.select(
        "lang", "k1", "k2", "k3", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a",
        F.when(early, F.col("n1")).otherwise(F.col("a12")).alias("l"), F.when(early, F.col("a23")).otherwise(F.col("n3")).alias("r"), F.lit(3).alias("words"),
    )
    both = two.unionByName(three)
    return materialize(both.withColumn("score", _score("a", "l", "r"))), words


def _pair_places(batches):
    mask = np.uint64((1 << PAIR_BITS) - 1)
    for batch in batches:
        k1, k2 = (batch.column(i).to_numpy() for i in range(2))
        yield pa.RecordBatch.from_arrays([pa.array((_mixed(k1, k2) & mask).astype(np.int64))], names=["place"])


def collocations(docs: DataFrame, least: int = 10, top: int = 2000, inside_percent: int = 50) -> DataFrame:
    """Each language's ``top`` phrases: lang, rank, phrase, a, l, r, n, score.

    ``a`` is the phrase's count, ``l`` and ``r`` those of its two parts at the weakest cut, ``n`` the language's words and ``score`` = floor(10^6 a^2 / (l r)).
    A phrase is left out if a longer one that holds it occurs at least ``inside_percent`` percent as often.
    """
    found, words = candidates(docs, least)
    three = found.filter("words = 3")
    held = three.select(F.explode(F.array(F.struct("k1", "k2"), F.struct(F.col("k2").alias("k1"), F.col("k3").alias("k2")))).alias("p"), "a")
    most = held.groupBy("p.k1", "p.k2").agg(F.max("a").alias("longer"))
    two = found.filter("words = 2").join(most, ["k1", "k2"], "left").filter(F.coalesce(F.col("longer") * 100 < F.col("a") * inside_percent, F.lit(True)))
    columns = ["lang", "phrase", "a", "l", "r", "score"]
    order = [F.col("score").desc(), F.col("a").desc(), "phrase"]
    ranked = two.select(*columns).unionByName(three.select(*columns)).withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    sizes = words.groupBy("lang").agg(F.sum("n").alias("n"))
    return ranked.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
