"""Packing documents into as few sequences as possible by bin completion.

A piece's place depends on its length alone, so the search runs on the number of pieces of each length (at most ``capacity`` numbers,
whatever the corpus) and works with *patterns*: fillings of a sequence and how often each is used. Best fit by decreasing length gives the
incumbent. If that does not meet the lower bound, bin completion looks for better: around the largest length left it enumerates
fillings that no other filling dominates, takes each as often as the counts allow, and gives up a branch as soon as the waste so far
rules out beating the incumbent. ``nodes`` bounds the search; when it is spent the incumbent stands, so all pieces are always packed.

Documents are tokenized where they lie; every piece gets a rank among the pieces of its length from a running number inside its task
and the totals of the tasks before. The rank picks the pattern's copy and slot. Texts are never shuffled.

Defined cases: a null or empty text is one piece of the end id alone. Rows that repeat a ``doc_id`` are packed one by one. An
empty table gives no rows. Other columns are never read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import materialize
from .common import slices
from .tokens import encoder

Pattern = tuple[tuple[int, int], ...]  # (length, how many of it), largest first


def _join(pattern: Pattern, length: int, m: int) -> Pattern:
    return (*pattern[:-1], (length, pattern[-1][1] + m)) if pattern and pattern[-1][0] == length else (*pattern, (length, m))


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Best fit by decreasing length, all pieces of a length at once."""
    room: list[int] = []  # distinct rooms of open sequences, ascending
    by_room: dict[int, list[list]] = {}

    def put(left: int, pattern: Pattern, copies: int):
        if left not in by_room:
            by_room[left] = []
            insort(room, left)
        by_room[left].append([pattern, copies])

    for length in sorted(counts, reverse=True):
        todo = counts[length]
        while todo:
            at = bisect_left(room, length)
            if at < len(room):
                left = room[at]
                pattern, copies = by_room[left].pop()
                if not by_room[left]:
                    del by_room[left]
                    room.pop(at)
            else:
                left, pattern, copies = capacity, (), todo
            each = left // length
            full = min(copies, todo // each)
            rest = copies - full
            if full:
                put(left - each * length, _join(pattern, length, each), full)
                todo -= full * each
            if todo and rest and todo < each:
                put(left - todo * length, _join(pattern, length, todo), 1)
                todo, rest = 0, rest - 1
            if rest and pattern:
                put(left, pattern, rest)
    return [(p, n) for groups in by_room.values() for p, n in groups]


def fillings(counts: dict[int, int], lengths: list[int], space: int, most: int, limit: int = 300, keep: int = 4) -> list[tuple[int, Pattern]]:
    """Undominated fillings of ``space`` with waste of at most ``most``, least waste and largest pieces first: (waste, pattern).

    The last one or two pieces of a full sequence are looked up rather than searched for; ``limit`` bounds the steps otherwise.
    """
    found: list[tuple[int, Pattern]] = []
    budget = limit
    n = len(lengths)

    def ends(at: int, left: int, chosen: Pattern) -> bool:
        """Record fillings that one or two more pieces complete."""
        if counts.get(left, 0) and left <= lengths[at]:
            found.append((0, (*chosen, (left, 1))))
            return True
        for i in range(bisect_left(lengths, -left, at, key=lambda x: -x), n):
            x = lengths[i]
            y = left - x
            if y > x:
                return False
            if counts[x] and (counts[x] > 1 if y == x else counts.get(y, 0)):
                found.append((0, (*chosen, (x, 2)) if y == x else (*chosen, (x, 1), (y, 1))))
                return True
        return False

    def search(at: int, left: int, chosen: Pattern):
        nonlocal budget
        budget -= 1
        if left == 0:
            found.append((0, chosen))
            return
        fits = bisect_left(lengths, -left, at, key=lambda x: -x)
        while fits < n and not counts[lengths[fits]]:
            fits += 1
        if fits == n:
            if left <= most and not _dominated(counts, lengths, left, chosen):
                found.append((left, chosen))
            return
        if ends(fits, left, chosen) and len(found) >= keep:
            return
        for i in range(fits, n):
            x = lengths[i]
            if counts[x]:
                for m in range(min(counts[x], left // x), 0, -1):
                    if budget <= 0 or len(found) >= keep:
                        return
                    search(i + 1, left - m * x, (*chosen, (x, m)))

    search(0, space, ())
    if not any(w == 0 for w, _ in found):
        found += balanced(counts, lengths, space)
    if not found:
        # the steps did not suffice: the greedy filling stands in
        left, chosen = space, []
        for x in lengths:
            m = min(counts[x], left // x)
            if m:
                chosen.append((x, m))
                left -= m * x
        if left <= most:
            found.append((left, tuple(chosen)))
    found.sort(key=lambda f: (f[0], [-x for x, _ in f[1]]))
    return found[:keep]


def balanced(counts: dict[int, int], lengths: list[int], space: int) -> list[tuple[int, Pattern]]:
    """A full filling from many pieces of like length: as many as their mean allows, each near what is left per piece, the last two looked up."""
    live = [x for x in reversed(lengths) if counts[x] and x <= space]  # ascending
    if not live:
        return []
    for k in range(-(-space // live[-1]), -(-space // live[-1]) + 3):
        left, taken = space, {}
        for r in range(k, 2, -1):
            at = bisect_left(live, left / r)
            near = [x for x in live[max(at - 8, 0) : at + 8] if counts[x] > taken.get(x, 0) and x < left]
            if not near:
                break
            x = min(near, key=lambda v: abs(v - left / r))
            taken[x] = taken.get(x, 0) + 1
            left -= x
        else:
            for x in live:
                y = left - x
                if y < x:
                    break
                if counts[x] > taken.get(x, 0) + (x == y) and counts.get(y, 0) > taken.get(y, 0):
                    taken[x] = taken.get(x, 0) + 1
                    taken[y] = taken.get(y, 0) + 1
                    return [(0, tuple(sorted(taken.items(), reverse=True)))]
    return []


def _dominated(counts: dict[int, int], lengths: list[int], left: int, chosen: Pattern) -> bool:
    """Whether an unused piece could stand in for a chosen one or for a pair of them and fill more."""
    used = dict(chosen)
    items = [x for x, m in chosen for _ in range(min(m, 2))]
    sums = set(items) | {a + b for i, a in enumerate(items) for b in items[i + 1 :]}
    for s in sums:
        # lengths in (s, s + left], largest first
        at = bisect_left(lengths, -(s + left), key=lambda x: -x)
        while at < len(lengths) and lengths[at] > s:
            if counts[lengths[at]] > used.get(lengths[at], 0):
                return True
            at += 1
    return False


@dataclass
class _Search:
    capacity: int
    best: list[tuple[Pattern, int]]
    best_bins: int
    lower: int
    nodes: int

    def run(self, counts: dict[int, int]) -> list[tuple[Pattern, int]]:
        self._descend(dict(counts), sorted(counts, reverse=True))
        return self.best

    def _descend(self, counts: dict[int, int], every: list[int]) -> None:
        """Depth first; the latest choices are revised first. One table of counts serves all nodes: a choice is subtracted when its turn
        comes, and what was chosen below another branch is added back before that, so a waiting node is its pattern and a few numbers."""
        total = sum(k * v for k, v in counts.items())
        stack: list[tuple[int, Pattern, int, int, int]] = [(0, (), 0, 0, 0)]
        chosen: list[tuple[Pattern, int]] = []
        while stack and self.nodes > 0 and self.best_bins > self.lower:
            depth, pattern, times, bins, waste = stack.pop()
            while len(chosen) > depth:
                for k, m in chosen[-1][0]:
                    counts[k] += m * chosen[-1][1]
                chosen.pop()
            if times:
                chosen.append((pattern, times))
                for k, m in pattern:
                    counts[k] -= m * times
            lengths = [x for x in every if counts[x]]
            if not lengths:
                if bins < self.best_bins:
                    self.best, self.best_bins = list(reversed(chosen)), bins
                continue
            self.nodes -= 1
            allowed = (self.best_bins - 1) * self.capacity - total - waste
            if allowed < 0:
                continue
            x = lengths[0]
            counts[x] -= 1
            options = fillings(counts, lengths, self.capacity - x, min(allowed, self.capacity))
            counts[x] += 1
            for lost, filling in reversed(options):
                found = dict(filling)
                found[x] = found.get(x, 0) + 1
                many = min(counts[k] // m for k, m in found.items())
                if lost:
                    many = min(many, max(allowed // lost, 1))
                stack.append((len(chosen), tuple(sorted(found.items(), reverse=True)), many, bins + many, waste + lost * many))


def solve(counts: dict[int, int], capacity: int, nodes: int = 10_000) -> list[tuple[Pattern, int]]:
    """Patterns and their numbers of copies that hold exactly the given pieces."""
    whole = counts.get(capacity, 0)
    open_ = {k: v for k, v in counts.items() if v and k < capacity}
    best = best_fit(open_, capacity)
    bins = sum(n for _, n in best)
    total = sum(k * v for k, v in open_.items())
    over_half = sum(v for k, v in open_.items() if 2 * k > capacity)
    lower = max(-(-total // capacity), over_half)
    if bins > lower:
        best = _Search(capacity, best, bins, lower, nodes).run(open_)
    return best + ([(((capacity, 1),), whole)] if whole else [])


def slots(patterns: list[tuple[Pattern, int]]) -> dict[str, np.ndarray]:
    """Rank intervals per length: pieces of ``length`` with rank in [lo, next lo) go, ``m`` to a copy, to sequences from ``base`` at ``offset``."""
    rows, used, base = [], {}, 0
    for pattern, copies in patterns:
        at = 0
        for length, m in pattern:
            lo = used.get(length, 0)
            rows.append((length, lo, m, base, at))
            used[length] = lo + copies * m
            at += length * m
        base += copies
    rows.sort()
    cols = np.array(rows, np.int64).reshape(-1, 5).T
    return dict(zip(("length", "lo", "m", "base", "offset"), cols))


def _pieces(path: str, end_id: int, capacity: int):
    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        ranks = np.zeros(capacity + 1, np.int64)
        tool = encoder(path)
        for batch in (x for whole in batches for x in slices(whole, 1)):  # encoding takes over 20 bytes a byte of text
            ids, counts = tool.encode(batch.column(1))
            out = {k: [] for k in ("row", "piece", "start", "length", "crc", "rank")}
            ends = np.cumsum(counts)
            for row, (b, n) in enumerate(zip((ends - counts).tolist(), counts.tolist())):
                doc = np.append(ids[b : b + n], np.uint32(end_id)).astype("<u4")
                for piece, start in enumerate(range(0, n + 1, capacity)):
                    part_ids = doc[start : start + capacity]
                    out["row"].append(row)
                    out["piece"].append(piece)
                    out["start"].append(start)
                    out["length"].append(len(part_ids))
                    out["crc"].append(zlib.crc32(part_ids.tobytes()))
                    out["rank"].append(int(ranks[len(part_ids)]))
                    ranks[len(part_ids)] += 1
            taken = [c.take(pa.array(out["row"], pa.int32())) for i, c in enumerate(batch.columns) if i != 1]
            rest = [pa.array(out["piece"], pa.int32()), *[pa.array(out[k], pa.int64()) for k in ("start", "length", "crc", "rank")], pa.array([part] * len(out["row"]), pa.int32())]
            yield pa.RecordBatch.from_arrays([*taken, *rest], names=["doc_id", "piece", "start", "length", "ids_crc32", "_rank", "_part"])

    return run


def pack(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1, nodes: int = 10_000) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, _rank long, _part int"
    pieces = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_pieces(path, end_id, capacity), schema))
    totals = materialize(pieces.groupBy("_part", "length").agg(F.count(F.lit(1)).alias("n")))
    counts = {r[0]: r[1] for r in totals.groupBy("length").agg(F.sum("n")).collect()}  # at most ``capacity`` rows
    table = docs.sparkSession.sparkContext.broadcast(slots(solve(counts, capacity, nodes)))
    before = F.coalesce(F.sum("n").over(W.partitionBy("length").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = totals.select("_part", "length", before.alias("_before"))
    ranked = pieces.join(offsets, ["_part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_before") + F.col("_rank")).alias("_rank"))

    def place(batches):
        t = table.value
        keys = t["length"] << 44 | t["lo"]
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            slot = np.searchsorted(keys, length << 44 | rank, side="right") - 1
            within = rank - t["lo"][slot]
            sequence = t["base"][slot] + within // t["m"][slot]
            offset = t["offset"][slot] + within % t["m"][slot] * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
