"""The rating scan over candidate vectors: one row per contest, a vector of ratings per player, bounded blocks of connected players.

A history is cut into consecutive blocks. Inside a block, players who never meet, not even over others, do not touch each other's ratings: a
union-find over the block's pairs groups them, and groups are packed into ``BINS`` bins of about equal weight that are played in parallel. A
bin streams its contests in (day, seq) order and holds one vector per player, one rating for each candidate; nothing is repeated per candidate
before or in the shuffle, and the rows per candidate are only unfolded afterwards, where a query needs them. Between blocks the players'
vectors are written to the shared folder, so a lost executor costs one block and the lineage does not grow. A vector is written with the number
of the block its player is next seen in, and only if there is one; that block reads it, and nothing is copied from block to block.

What a query does not ask for is not written: ``emit`` names the outputs wanted and, for each, a flag of the contests it is wanted for.

A block holds at most ``BLOCK_ROWS`` contests and ``BLOCK_VALUES`` contests x candidates, which bounds the vectors a task can hold (two
players a contest). A history of one block is played without writing anything. So is a longer one whose groups of connected players, over the
whole history, are each within that bound (``whole_bins``): what a task holds are players, not contests, and no vector has to be handed on.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, ByteType, DoubleType, StructField, StructType

from ..functions import scalar as S
from ..session import StepTable, materialize

BLOCK_ROWS = 2_000_000
BLOCK_VALUES = 20_000_000
BINS = 64  # parts of a block, as far as its players are not connected
WHOLE_BINS = 256  # least number of parts of a history that is played without blocks
FEW = 12  # candidates below which plain numbers are quicker than numpy rows

_VECTORS = ("pre", "opp_pre", "post", "opp_post")
_ADJUSTED = ("adj_pre", "adj_opp_pre")
_FACTORS = ("_fa", "_fb", "_ba", "_bb")


def _roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest number connected to each of ``n`` numbers by the pairs (a, b)."""
    root = np.arange(n)
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return root
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up


def _bin_rows(bins: int, keys: list[str]):
    def run(pairs: pd.DataFrame) -> pd.DataFrame:
        a, b, n = (pairs[c].to_numpy() for c in ("_pa", "_pb", "n"))
        numbers, who = pd.factorize(np.concatenate([a, b]), sort=True)
        a, b = numbers[: len(a)], numbers[len(a) :]
        root = _roots(a, b, len(who))
        weight = np.bincount(root[a], weights=n, minlength=len(root))
        order = np.argsort(-weight, kind="stable")
        bin_of = np.zeros(len(root), np.int64)
        bin_of[order] = (np.cumsum(weight[order]) - weight[order]) * bins // max(weight.sum(), 1)
        out = pd.DataFrame({"_who": who, "_bin": bin_of[root].astype(np.int32)})
        for i, k in enumerate(keys):
            out.insert(i, k, pairs[k].iloc[0] if len(pairs) else None)
        return out

    return run


def connected_bins(part: DataFrame, keys: list[str], bins: int = BINS) -> DataFrame:
    """(keys, who, _bin): connected players of a block share a bin."""
    who = part.select(*keys, F.explode(F.array("player", "opponent")).alias("who")).distinct()
    return who.withColumn("_who", F.xxhash64("who")).join(_hashed_bins(part, keys, bins), [*keys, "_who"]).drop("_who")


def _hashed_bins(part: DataFrame, keys: list[str], bins: int = BINS) -> DataFrame:
    """(keys, _who, _bin) for the hashes of connected players. One task per key sees the block's distinct pairs, as 64-bit hashes of
    the names: two names of one hash only share a bin. Contests and vectors look their bins up separately and the task may run once for
    each, so the bins follow from the set of pairs alone; the order in which a shuffle delivers the pairs differs from run to run."""
    pairs = part.select(*keys, F.xxhash64("player").alias("_pa"), F.xxhash64("opponent").alias("_pb")).groupBy(*keys, "_pa", "_pb").agg(F.count(F.lit(1)).alias("n"))
    fields = [pairs.schema[k] for k in keys]
    schema = StructType(fields).add("_who", "long").add("_bin", "integer")
    return pairs.groupBy(*keys).applyInPandas(_bin_rows(bins, keys), schema)


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links (player, smallest connected player) that a task's pairs of hashes amount to, a bounded number of pairs at a time."""
    names, kept, size = ("_who", "_up"), [], 0

    def settled() -> tuple[np.ndarray, np.ndarray]:
        a, b = (np.concatenate([k[i] for k in kept]) for i in (0, 1))
        who, numbers = np.unique(np.concatenate([a, b]), return_inverse=True)
        root = _roots(numbers[: len(a)], numbers[len(a) :], len(who))
        moved = root != np.arange(len(who))
        return who[moved], who[root[moved]]

    for batch in batches:
        kept.append(tuple(batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)))
        size += batch.num_rows
        if size > BLOCK_ROWS:
            done = settled()
            kept, size = [done], len(done[0])
            if 2 * size > BLOCK_ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in done], names=names)
                kept, size = [], 0
    if kept:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in settled()], names=names)


def _all_roots(links: pd.DataFrame) -> pd.DataFrame:
    done = list(_forest(iter([pa.RecordBatch.from_pandas(links[["_who", "_up"]], preserve_index=False)])))
    return done[0].to_pandas() if done else links[["_who", "_up"]]


def connected_players(contests: DataFrame, rows: int | None = None) -> DataFrame:
    """(_who, _part, n) for the hash of every player: the smallest hash it is connected to over the whole history, and its contests.

    Pairs are first linked inside ranges of ``seq``, where a task keeps one link per player. While more than ``rows`` links (``BLOCK_ROWS``) remain,
    each player hangs on its smallest neighbour and links between what they hang on are left, a constant share fewer players each time, by joins
    alone; one task settles the rest."""
    rows = BLOCK_ROWS if rows is None else rows
    who = contests.select(F.explode(F.array(F.xxhash64("player"), F.xxhash64("opponent"))).alias("_who")).groupBy("_who").agg(F.count(F.lit(1)).alias("n"))
    pairs = contests.select("seq", F.xxhash64("player").alias("_pa"), F.xxhash64("opponent").alias("_pb")).filter("_pa <> _pb")
    links = materialize(pairs.repartitionByRange("seq").select("_pa", "_pb").mapInArrow(_forest, "_who long, _up long"))
    named = who.withColumn("_part", F.col("_who"))

    def hung(df: DataFrame, names: str, to: DataFrame) -> DataFrame:
        up = to.select(F.col("_who").alias(names), F.col("_up").alias("_to"))
        return df.join(up, names, "left").withColumn(names, F.coalesce("_to", names)).drop("_to")

    while links.count() > rows:
        both = links.unionByName(links.select(F.col("_up").alias("_who"), F.col("_who").alias("_up")))
        least = materialize(both.groupBy("_who").agg(F.min("_up").alias("_up")).filter("_up < _who"))
        named = hung(named, "_part", least)
        # a player's own neighbour may hang elsewhere, so both ends of a link move
        links = materialize(hung(hung(links.withColumnRenamed("_who", "_a"), "_a", least), "_up", least).withColumnRenamed("_a", "_who").filter("_who <> _up").distinct())
    last = links.groupBy().applyInPandas(_all_roots, "_who long, _up long")
    return hung(named, "_part", last).select("_who", "_part", "n")


def whole_bins(contests: DataFrame, players: int) -> DataFrame | None:
    """(_who, _bin) such that connected players of the whole history share a bin and a bin holds at most about ``players``; None if a group of
    connected players has more. Groups that matter for the balance, a few hundred, are dealt by the driver, the others by hash."""
    named = materialize(connected_players(contests))
    parts = materialize(named.groupBy("_part").agg(F.count(F.lit(1)).alias("players"), F.sum("n").alias("n")))
    most, everyone, total = parts.agg(F.max("players"), F.sum("players"), F.sum("n")).first()
    if most > players:
        return None
    bins = max(WHOLE_BINS, -(-2 * everyone // players))
    large = parts.filter(F.greatest(F.col("n") / total, F.col("players") / everyone) * 4 * bins >= 1).collect()
    held, where = [(0, 0, i) for i in range(bins)], []
    for r in sorted(large, key=lambda r: (-r["n"], r["_part"])):
        n, many, i = heapq.heappop(held)
        where.append((r["_part"], i))
        heapq.heappush(held, (n + r["n"], many + r["players"], i))
    table = contests.sparkSession.createDataFrame(where, "_part long, _bin int")
    dealt = named.join(F.broadcast(table), "_part", "left")
    return dealt.select("_who", F.coalesce("_bin", F.pmod(F.hash("_part"), F.lit(bins))).alias("_bin"))


class _Ratings:
    """Ratings of the players a bin has met, by candidate."""

    def __init__(self, base: float, k: np.ndarray, scales: np.ndarray):
        self.base, self.k, self.scales, self.n = base, k, scales, len(scales)
        self.few = self.n < FEW
        self.k_rows = k.tolist()
        self.clear()

    def clear(self) -> None:
        self.place: dict = {}
        self.next: dict = {}  # block in which a player is seen again
        self.rows = [[] for _ in range(self.n)] if self.few else np.empty((1024, self.n))

    def at(self, who, vector=None) -> int:
        found = self.place.get(who)
        if found is None:
            found = self.place[who] = len(self.place)
            if self.few:
                for i, values in enumerate(self.rows):
                    values.append(self.base if vector is None else vector[i])
            else:
                if found == len(self.rows):
                    self.rows = np.concatenate([self.rows, np.empty_like(self.rows)])
                self.rows[found] = self.base if vector is None else vector
        return found

    def vectors(self, found: list[int]) -> np.ndarray:
        return np.array([[values[i] for values in self.rows] for i in found]) if self.few else self.rows[found]

    def play(self, a: list[int], b: list[int], method: list[int], score: list[float], factors: list[np.ndarray]) -> list[np.ndarray]:
        """Ratings before and after contests in order; ``factors`` are idle factors and bonuses of both sides, or empty."""
        out = [np.empty((len(a), self.n)) for _ in _VECTORS]
        (self._play_few if self.few else self._play_rows)(a, b, method, score, factors, out)
        return out

    def _play_few(self, a, b, method, score, factors, out) -> None:
        for c in range(self.n):
            ratings, scale, k = self.rows[c], float(self.scales[c]), [row[c] for row in self.k_rows]
            fa, fb, ba, bb = [f[:, c].tolist() for f in factors] if factors else [[1.0] * len(a)] * 4
            done = [[], [], [], []]
            for x, y, m, s, f, g, p, q in zip(a, b, method, score, fa, fb, ba, bb):
                ra, rb, gain = ratings[x], ratings[y], k[m]
                xa, xb = ra * f, rb * g
                na = (ra + gain * (s - 1.0 / (1.0 + 10.0 ** ((xb - xa) / scale)))) * p
                nb = (rb + gain * ((1.0 - s) - 1.0 / (1.0 + 10.0 ** ((xa - xb) / scale)))) * q
                ratings[x], ratings[y] = na, nb
                done[0].append(ra)
                done[1].append(rb)
                done[2].append(na)
                done[3].append(nb)
            for target, values in zip(out, done):
                target[:, c] = values

    def _play_rows(self, a, b, method, score, factors, out) -> None:
        rows, k, scales = self.rows, self.k, self.scales
        pre, opp_pre, post, opp_post = out
        for i, (x, y, m, s) in enumerate(zip(a, b, method, score)):
            ra, rb, gain = rows[x], rows[y], k[m]
            pre[i], opp_pre[i] = ra, rb
            if factors:
                lead = (rb * factors[1][i] - ra * factors[0][i]) / scales
            else:
                lead = (rb - ra) / scales
            na = ra + gain * (s - 1.0 / (1.0 + 10.0**lead))
            nb = rb + gain * ((1.0 - s) - 1.0 / (1.0 + 10.0**-lead))
            if factors:
                na, nb = na * factors[2][i], nb * factors[3][i]
            rows[x], rows[y] = na, nb
            post[i], opp_post[i] = na, nb


def _stream(keys: list[str], kept: list[str], emit: dict, k: np.ndarray, scales: np.ndarray, factored: bool, stateful: bool, base: float = S.BASE_RATING):
    """Plays sorted rows: of every bin first its players (kind 0: vector, empty if unknown, and next block if any), then its contests (kind 1). With
    ``stateful`` a bin ends with the vectors of players that are seen again."""

    def lists(values: np.ndarray, wanted: np.ndarray | None = None) -> pa.Array:
        n, width = values.shape
        if wanted is None or wanted.all():
            return pa.ListArray.from_arrays(pa.array(np.arange(0, n * width + 1, width, dtype=np.int32)), pa.array(values.ravel()))
        ends = np.concatenate([[0], np.cumsum(wanted) * width]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(values[wanted].ravel()), mask=pa.array(~wanted))

    def matrix(column: pa.Array, n: int) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, n)

    def plain(column: pa.Array) -> list:
        return column.to_numpy(zero_copy_only=False).tolist()

    def runs(batch: pa.RecordBatch) -> list[int]:
        """Where a row's group or kind differs from the row before."""
        new = np.zeros(batch.num_rows, bool)
        new[0] = True
        for c in (*keys, "_bin", "_kind"):
            codes = batch.column(c).dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
            new[1:] |= codes[1:] != codes[:-1]
        return np.flatnonzero(new).tolist()

    def output(name: str, values: dict) -> np.ndarray:
        return np.sign(values["pre"] - values["opp_pre"]).astype(np.int8) if name == "order" else values[name]

    def ends(ratings: _Ratings, group: list, types: dict) -> Iterator[pa.RecordBatch]:
        again = sorted(ratings.next.items(), key=lambda x: x[1])
        for at in range(0, len(again), 4096):
            part = again[at : at + 4096]
            n = len(part)
            own = {**{c: pa.array([v] * n, types[c]) for c, v in zip(keys, group)}, "player": pa.array([w for w, _ in part], types["player"])}
            rows = [own[c] if c in own else pa.nulls(n, types[c]) for c in kept]
            rows += [pa.nulls(n, pa.list_(pa.int8() if c == "order" else pa.float64())) for c in emit]
            rows += [lists(ratings.vectors([ratings.place[w] for w, _ in part])), pa.array([b for _, b in part], pa.int32())]
            yield pa.RecordBatch.from_arrays(rows, names=[*kept, *emit, "_end", "_next"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratings, now, types = _Ratings(base, k, scales), None, {}
        for whole in batches:
            types = {f.name: f.type for f in whole.schema}
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                starts = runs(batch)
                for start, stop in zip(starts, [*starts[1:], batch.num_rows]):
                    part = batch.slice(start, stop - start)
                    *group, kind = (part.column(c)[0].as_py() for c in (*keys, "_bin", "_kind"))
                    if group != now:
                        if stateful and now is not None:
                            yield from ends(ratings, now, types)
                        ratings.clear()
                        now = group
                    first = plain(part.column("player"))
                    if kind == 0:
                        known = part.column("_r")
                        vectors = matrix(known, ratings.n)
                        vectors = iter(vectors.tolist() if ratings.few else vectors)
                        for who, size, again in zip(first, plain(known.value_lengths()), plain(part.column("_next").fill_null(-1))):
                            ratings.at(who, next(vectors) if size else None)
                            if again >= 0:
                                ratings.next[who] = again
                        continue
                    a = [ratings.at(w) for w in first]
                    b = [ratings.at(w) for w in plain(part.column("opponent"))]
                    factors = [matrix(part.column(f), ratings.n) for f in _FACTORS] if factored else []
                    done = ratings.play(a, b, plain(part.column("_m")), plain(part.column("_s")), factors)
                    if factored:
                        done += [done[0] * factors[0], done[1] * factors[1]]
                    values = dict(zip((*_VECTORS, *_ADJUSTED), done))
                    flags = {c: part.column(f).to_numpy(zero_copy_only=False).astype(bool) for c, f in emit.items() if f}
                    shown = np.logical_or.reduce(list(flags.values())) if len(flags) == len(emit) else np.ones(len(a), bool)
                    if not shown.any():
                        continue
                    if not shown.all():
                        part = part.filter(pa.array(shown))
                    rows = [*[part.column(c) for c in kept], *[lists(output(c, values)[shown], flags[c][shown] if c in flags else None) for c in emit]]
                    if stateful:
                        rows += [pa.nulls(part.num_rows, pa.list_(pa.float64())), pa.nulls(part.num_rows, pa.int32())]
                    yield pa.RecordBatch.from_arrays(rows, names=[*kept, *emit, *(("_end", "_next") if stateful else ())])
        if stateful and now is not None:
            yield from ends(ratings, now, types)

    return run


class VectorScan:
    """A prepared scan: ``rows`` has one row per contest with ``_s`` (score), ``_m`` (row of the K table) and, if ``factored``, the arrays of idle
    factors and bonuses; ``k`` is the K of every method and candidate, ``scales`` one scale per candidate. ``emit`` maps each output (``pre``,
    ``opp_pre``, ``post``, ``opp_post``, ``adj_pre``, ``adj_opp_pre`` or ``order``, the sign of pre - opp_pre) to a column of ``rows`` that flags the
    contests it is wanted for, or None for all; a contest without any is not returned."""

    def __init__(self, rows: DataFrame, keys: list[str], k: np.ndarray, scales: np.ndarray, factored: bool, emit: dict | None = None):
        self.rows, self.keys, self.k, self.scales, self.factored = rows, keys, k, scales, factored
        self.emit = emit or {n: None for n in (*_VECTORS, *(_ADJUSTED if factored else ()))}
        self.kept = [c for c in rows.columns if c not in ("_s", "_m", *_FACTORS)]
        self.schema = rows.select(*self.kept).schema
        for n in self.emit:
            self.schema = StructType([*self.schema.fields]).add(n, ArrayType(ByteType() if n == "order" else DoubleType()))
        self.schema = StructType([StructField(f.name, f.dataType, True) for f in self.schema])
        self.stateful_schema = StructType([*self.schema.fields]).add("_end", ArrayType(DoubleType())).add("_next", "integer")

    def dealt(self, part: DataFrame, state: DataFrame | None = None, again: DataFrame | None = None, thin: DataFrame | None = None, bins: DataFrame | None = None) -> DataFrame:
        """A block's players and contests as its tasks read them, bin by bin in order; the arguments are those of ``play``."""
        bins = _hashed_bins(part if thin is None else thin, self.keys) if bins is None else bins
        on = [part[k].eqNullSafe(bins[k]) for k in self.keys] + [F.xxhash64(part["player"]) == bins["_who"]]
        # absent arrays are empty, not null: Spark's Arrow writer measures a batch after every row, and for nulls it then fills in their offsets
        # again from the batch's start
        no_vector = F.array().cast("array<double>")
        nothing = {"_kind": F.lit(1), "_r": no_vector, "_next": F.lit(None).cast("int")}
        placed = part.join(bins, on).select(*[part[c] for c in part.columns], bins["_bin"], *[v.alias(n) for n, v in nothing.items()])
        if again is not None:
            by_who = [again[k].eqNullSafe(bins[k]) for k in self.keys] + [F.xxhash64(again["who"]) == bins["_who"]]
            known = again.join(bins, by_who).select(*[again[c] for c in again.columns], bins["_bin"])
            if state is None:
                known = known.withColumn("vector", no_vector)
            else:
                known = known.join(state, [*self.keys, "who"], "left").withColumn("vector", F.coalesce("vector", no_vector))
            here = {**{k: F.col(k) for k in self.keys}, "player": F.col("who"), "_bin": F.col("_bin"), "_kind": F.lit(0), "_r": F.col("vector"), "_next": F.col("_next")}
            empty = [(F.array() if isinstance(f.dataType, ArrayType) else F.lit(None)).cast(f.dataType).alias(f.name) for f in placed.schema if f.name not in here]
            placed = placed.unionByName(known.select(*[v.alias(n) for n, v in here.items()], *empty))
        by = [*self.keys, "_bin"]
        # a fixed number of tasks: the work is in the recurrence, so tasks must not be merged because their rows are few bytes
        tasks = int(part.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        # and bins are of about equal weight, so they are dealt in turn
        first = F.pmod(F.hash(*self.keys), F.lit(tasks)) if self.keys else F.lit(0)
        return placed.repartitionById(tasks, (first + F.col("_bin")) % tasks).sortWithinPartitions(*by, "_kind", "day", "seq")

    def play(self, part: DataFrame, state: DataFrame | None = None, again: DataFrame | None = None, thin: DataFrame | None = None, bins: DataFrame | None = None) -> DataFrame:
        """Play one block from ``state`` (keys, who, vector). ``again`` (keys, who, _next) has the block's players and the block they are next
        seen in; with it, the vectors of those that are seen again are rows of their own, marked by ``_next``. ``thin`` are the same contests
        where their pairs are cheaper to read; ``bins`` (_who, _bin) replaces the block's own."""
        stream = _stream(self.keys, self.kept, self.emit, self.k, self.scales, self.factored, again is not None)
        return self.dealt(part, state, again, thin, bins).mapInArrow(stream, self.schema if again is None else self.stateful_schema)

    def whole(self, blocks: DataFrame, count: int) -> DataFrame:
        """All blocks (numbered by ``_block``) in order; each is written and read back."""
        steps = StepTable(self.rows.sparkSession)
        who = F.explode(F.array("player", "opponent")).alias("who")
        seen = blocks.select(*self.keys, "_block", who).distinct()
        seen = materialize(seen.withColumn("_next", F.lead("_block").over(W.partitionBy(*self.keys, "who").orderBy("_block"))).repartition("_block").sortWithinPartitions("_block"))
        for i in range(count):
            here = F.col("_block") == i
            state = steps.whole(self.stateful_schema).filter(F.col("_next") == i).select(*self.keys, F.col("player").alias("who"), F.col("_end").alias("vector")) if i else None
            steps.add(self.play(blocks.filter(here).drop("_block"), state, seen.filter(here).drop("_block")))
        return steps.whole(self.stateful_schema).filter(F.col("_next").isNull()).drop("_end", "_next")


def unfold(vectors: DataFrame, keys: list[str] = (), carry: list[str] = ()) -> DataFrame:
    """One row per contest and candidate, with whichever of the ratings ``vectors`` has."""
    names = [n for n in (*_VECTORS, *_ADJUSTED) if n in vectors.columns]
    rows = vectors.select(*keys, "seq", "day", "player", "opponent", *carry, F.posexplode(F.arrays_zip(*names)).alias("candidate_id", "_v"))
    out = [F.col(f"_v.{n}").alias(n) for n in names]
    if "adj_pre" not in names and {"pre", "post"} <= set(names):
        out += [F.col("_v.pre").alias("adj_pre"), F.col("_v.opp_pre").alias("adj_opp_pre")]
    return rows.select(*keys, "candidate_id", "seq", "day", "player", "opponent", *carry, *out)
