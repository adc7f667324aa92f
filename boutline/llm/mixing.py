"""Mixing sources to target weights: Sainte-Laguë apportionment of equal-token blocks, then seeded block selection.

A source's documents lie on a line in the order of a seeded hash. The line is cut into shards (ranges of the hash that hold about
``shard_tokens`` words) and a shard into blocks of ``block_tokens`` words. The blocks of the whole mix go to the sources by the highest
quotients target / (2k - 1), and a source's blocks to its shards in the same way, at most twice a block. A shard with q blocks out of n
is taken q div n times whole; the other q mod n blocks are the ones from a seeded start on, around the end of the shard. As documents
lie in hashed order, that is a random draw that cuts at most two documents a shard.

No quotient but those that can win is ever made: seats that are certain and seats that are out of reach follow from the divisor's bounds, so
the ranked table has a few rows per source (or per shard of one source, of which there are at most ``CELLS``). Only numbers travel: a
document is its id, size and hash. Rows alike in all of these are one row with a count, cut to parts of at most ``COPIES`` copies, each
part with a hash of its own, so a row that repeats without end spreads over all shards.

Built-in expressions only. Defined cases: a null text has no words; a null source is a source of its own, the last one; a null ``doc_id``
is a value like others; repeated rows are documents of their own; sources without words have target 0; an empty table gives an empty
result. Other columns are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialize
from .common import text_or_empty

WORD = r"[^\x20\x09-\x0D]+"
CELLS = 4096  # ranges of the hash; a shard is a run of them
COPIES = 4096  # copies of one row that are laid out by one task
HASH_BITS = 60


def hashed(*parts: Column) -> Column:
    """60 bits of the MD5 of the parts, joined by colons; the same number in any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, HASH_BITS // 4), 16, 10).cast("long")


def numbered(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """Rows numbered from 1 in a total order, range by range: the ranges' sizes give every range its first number."""
    placed = materialize(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sizes = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_rows"))  # one row per shuffle partition
    before = F.coalesce(F.sum("_rows").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    firsts = sizes.select("_range", before.alias("_before"))
    local = F.row_number().over(W.partitionBy("_range").orderBy(*order))
    return placed.join(F.broadcast(firsts), "_range").withColumn(name, F.col("_before") + local).drop("_range", "_before")


def targets(sources: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, limit: float = 2.0) -> DataFrame:
    """``sources`` (source, source_size) with ``weight`` and ``target``.

    Weights repeat over the sources in code point order. ``share`` times all words are dealt by weight; a source stops at ``limit`` times its
    size and what it leaves is dealt again among the others. One row of sums comes back to the driver each time.
    """
    ranked = numbered(sources, "_at", F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    weighed = materialize(ranked.withColumn("weight", F.get(cycle, ((F.col("_at") - 1) % len(weights)).cast("int"))).drop("_at"))
    most = limit * F.col("source_size").cast("double")
    whole = share * float(weighed.agg(F.sum("source_size")).first()[0] or 0)
    level, full = 0.0, None
    while True:
        above = most < F.col("weight") * level
        held, spread, count = weighed.agg(F.sum(F.when(above, most)), F.sum(F.when(~above, F.col("weight"))), F.count_if(above)).first()
        if count == full or not spread:
            break
        left, full = whole - (held or 0.0), count
        level = left / spread
    if not spread:
        return weighed.withColumn("target", most)
    return weighed.withColumn("target", F.when(above, most).otherwise(F.col("weight") * left / spread))


def sainte_lague(parties: DataFrame, keys: list[str], party: str, seats: str = "seats", claim: str = "claim", most: str = "most") -> DataFrame:
    """``parties`` with ``quota``: in every group of ``keys`` the group's ``seats`` go to the highest quotients claim / (2k - 1), k from 1 to the
    party's ``most``; ties to the smaller ``party``. ``seats`` is the same on all rows of a group and no more than the sum of ``most``.

    With divisor D = all claims / seats, parties hold floor(claim / d + 1/2) seats at any divisor d; at D * seats / (seats - n) that is never too
    many for n parties, and at D * seats / (seats + n) hardly ever too few, in which case the reach is doubled.
    """
    over = W.partitionBy(*keys)
    live = parties.filter((F.col(claim) > 0) & (F.col(most) > 0))
    sums = materialize(live.select("*", F.sum(claim).over(over).alias("_all"), F.count(F.lit(1)).over(over).alias("_n"))) if keys else None
    if sums is None:
        total, n = live.agg(F.sum(claim), F.count(F.lit(1))).first()
        sums = live.select("*", F.lit(float(total or 0)).alias("_all"), F.lit(n).alias("_n"))

    def held(extra: Column) -> Column:
        return F.least(F.col(most), F.greatest(F.lit(0), F.floor(F.col(claim) * (F.col(seats) + extra) / F.col("_all") + 0.5)))

    reach = 1
    while True:
        bounded = sums.select("*", held(-F.col("_n")).alias("_low"), held(F.col("_n") * reach).alias("_high"))
        short = bounded.groupBy(*keys).agg((F.sum("_high") < F.max(seats)).alias("short")).filter("short").limit(1).count()
        if not short:
            break
        reach *= 2
    if keys:
        sure = F.sum("_low").over(over)
        open_ = bounded.select("*", sure.alias("_sure"))
    else:
        open_ = bounded.withColumn("_sure", F.lit(bounded.agg(F.coalesce(F.sum("_low"), F.lit(0))).first()[0]))
    tried = open_.filter(F.col("_high") > F.col("_low")).select(*keys, party, seats, "_sure", claim, F.explode(F.sequence(F.col("_low") + 1, F.col("_high"))).alias("_k"))
    quotients = tried.withColumn("_quotient", F.col(claim) / (2 * F.col("_k") - 1))
    order = [F.col("_quotient").desc(), F.col(party), F.col("_k")]
    ranked = quotients.withColumn("_at", F.row_number().over(over.orderBy(*order))) if keys else numbered(quotients, "_at", *order)
    won = ranked.filter(F.col("_at") <= F.col(seats) - F.col("_sure")).groupBy(*keys, party).agg(F.count(F.lit(1)).alias("_won"))
    low = open_.select(*keys, party, "_low").join(won, [*keys, party], "left").select(*keys, party, (F.col("_low") + F.coalesce("_won", F.lit(0))).alias("quota"))
    return parties.join(low, [*keys, party], "left").withColumn("quota", F.coalesce("quota", F.lit(0)).cast("long"))


def _pieces(docs: DataFrame, seed: int) -> DataFrame:
    """Rows (doc_id, source, key, size, h, part, copies); ``key`` is the source as a value that is never null."""
    text = text_or_empty()
    name = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    doc = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    rows = docs.select("doc_id", "source", name.alias("key"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), hashed(F.lit(seed), doc, text).alias("h"))
    alike = rows.groupBy("doc_id", "source", "key", "size", "h").agg(F.count(F.lit(1)).alias("n"))
    cut = alike.select("*", F.explode(F.sequence(F.lit(0), F.expr(f"(n - 1) div {COPIES}"))).alias("part"))
    own = F.when(F.col("part") == 0, F.col("h")).otherwise(F.pmod(F.xxhash64("h", "part"), F.lit(1 << HASH_BITS)))
    copies = F.least(F.lit(COPIES), F.col("n") - F.col("part") * COPIES)
    return cut.select("doc_id", "source", "key", "size", own.alias("h"), "part", copies.alias("copies")).withColumn("cell", F.shiftright("h", HASH_BITS - 12))


def quotas(cells: DataFrame, weights: tuple[float, ...], share: float, block_tokens: int, shard_tokens: int, seed: int) -> DataFrame:
    """One row per (source, cell): its shard, its place in it, and the shard's size, blocks, quota and start."""
    sizes = targets(cells.groupBy("source", "key").agg(F.sum("words").alias("source_size")), weights, share)
    shards = F.least(F.lit(CELLS), F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_tokens)))
    placed = cells.join(sizes.drop("source"), "key").withColumn("shard", F.floor(F.col("cell") * shards / CELLS).cast("int"))
    inside = W.partitionBy("key", "shard").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    placed = materialize(placed.withColumn("cell_start", F.coalesce(F.sum("words").over(inside), F.lit(0))))
    lines = placed.groupBy("key", "shard").agg(F.sum("words").alias("line"), F.first("target").alias("target")).withColumn("blocks", F.ceil(F.col("line") / block_tokens))
    lines = materialize(lines)
    claims = lines.groupBy("key").agg(F.first("target").alias("claim"), F.sum(2 * F.col("blocks")).alias("most"))
    wanted = claims.agg(F.sum("claim")).first()[0] or 0.0
    seats = int(wanted / block_tokens + 0.5)
    given = materialize(sainte_lague(claims.withColumn("seats", F.lit(seats).cast("long")), [], "key")).select("key", F.col("quota").alias("seats"))
    shares = lines.join(given, "key").select("key", "shard", "line", "blocks", "seats", F.col("line").cast("double").alias("claim"), (2 * F.col("blocks")).alias("most"))
    won = sainte_lague(shares, ["key"], "shard")
    start = F.pmod(hashed(F.lit(seed), F.lit("start"), F.col("key"), F.col("shard").cast("string")), F.greatest(F.col("blocks"), F.lit(1)))
    return placed.join(won.select("key", "shard", "line", "blocks", "quota", start.alias("first_block")), ["key", "shard"])


def mix(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, block_tokens: int = 16, shard_tokens: int = 4_000_000, seed: int = 17) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, weight, target, shard, passes, spans, taken.

    ``passes`` is how often the whole document is taken and ``spans`` the word ranges [from, to) taken once more; ``taken`` counts all
    these words. Reruns with the same seed agree.
    """
    pieces = materialize(_pieces(docs, seed))
    cells = materialize(pieces.groupBy("source", "key", "cell").agg(F.sum(F.col("copies") * F.col("size")).alias("words")))
    plan = quotas(cells, weights, share, block_tokens, shard_tokens, seed).drop("source", "words")
    inside = W.partitionBy("key", "cell").orderBy("h", "part", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    ordered = pieces.withColumn("_before", F.coalesce(F.sum(F.col("copies") * F.col("size")).over(inside), F.lit(0)))
    laid = ordered.join(plan, ["key", "cell"]).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("_copy"))
    size, line, blocks = F.col("size"), F.col("line"), F.col("blocks")
    passes = F.when(blocks > 0, F.floor(F.col("quota") / blocks)).otherwise(0)
    laid = laid.withColumns({"_from": F.col("cell_start") + F.col("_before") + F.col("_copy") * size, "passes": passes})
    rest = F.col("quota") - F.col("passes") * blocks
    head = F.least(line, F.col("first_block") * block_tokens)
    stop = F.col("first_block") + rest
    ranges = [(F.lit(0), F.when(stop > blocks, (stop - blocks) * block_tokens).otherwise(0)), (head, F.least(line, stop * block_tokens))]
    spans = F.array(*[
        F.struct(F.greatest(F.lit(0), lo - F.col("_from")).cast("long").alias("from"), F.least(size, hi - F.col("_from")).cast("long").alias("to")) for lo, hi in ranges
    ])
    kept = laid.withColumn("spans", F.filter(spans, lambda s: s["from"] < s["to"]))
    taken = F.col("passes") * size + F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["to"] - s["from"])
    return kept.select("doc_id", "source", "size", "source_size", "weight", "target", "shard", "passes", "spans", taken.cast("long").alias("taken"))
