"""Mixing sources to target weights.

Method: Sainte-Lague apportionment. Every source's documents are put in a seeded order and cut, over
their running sum of tokens, into blocks of equal tokens; a stretch of neighbouring blocks is a
shard. Blocks of the mix go to sources by the highest quotients weight / (2 k + 1) until all are
given or every source is at its cap; a source's blocks go to its shards the same way, by their
sizes; in each shard the blocks to be used once more than the others are a run that begins at a
seeded place. What whole documents leave over or short of the quota is made good in a few shards.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.operators.ordered import running
from tidelog.operators.skew import lookup_join
from tidelog.session import cut

BLOCK = 4096
#: Blocks of a shard, the unit of quotas within a source. Shards are as many as a source's tokens ask for.
BLOCKS_PER_SHARD = 1024


def sainte_lague(weights: list[float], caps: list[int], seats: int) -> list[int]:
    """Seats by the highest quotients w / (2 k + 1), none above its cap; ties go to the earlier one.

    Equal to handing out seats one by one, but starts from what a common divisor gives, so the steps
    grow with the number of weights and not of seats. Weights of zero get nothing. If the caps do not
    suffice, fewer seats are given.
    """
    live = [i for i, w in enumerate(weights) if w > 0 and caps[i] > 0]
    seats = min(seats, sum(caps[i] for i in live))
    got = [0] * len(weights)
    if seats <= 0:
        return got
    given = lambda d: [min(caps[i], math.ceil(weights[i] / (2 * d) - 0.5)) if i in chosen else 0 for i in range(len(weights))]
    chosen = set(live)
    lo, hi = 0.0, max(weights[i] for i in live) + 1  # at hi nothing is given; at lo everything up to the caps
    for _ in range(200):
        d = (lo + hi) / 2
        if d <= 0 or sum(max(0, x) for x in given(d)) > seats:
            lo = d
        else:
            hi = d
    got = [max(0, x) for x in given(hi)]
    heap = [(-weights[i] / (2 * got[i] + 1), i) for i in live if got[i] < caps[i]]
    heapq.heapify(heap)
    for _ in range(seats - sum(got)):
        _, i = heapq.heappop(heap)
        got[i] += 1
        if got[i] < caps[i]:
            heapq.heappush(heap, (-weights[i] / (2 * got[i] + 1), i))
    return got


def shard_quotas(blocks: int, per_shard: int, seats: int) -> tuple[int, int, int]:
    """Sainte-Lague among a source's shards, all of per_shard blocks but for a smaller last one.

    (quota of each full shard, how many of the first ones get one more, quota of the last): the same as
    handing out the seats one by one by the highest quotients, ties to the earlier shard, in a few steps
    however many shards there are.
    """
    full, rest = divmod(blocks, per_shard)
    if not rest:
        return (*divmod(seats, full), 0) if full else (0, 0, 0)
    if not full:
        return 0, 0, seats
    # the last shard's seat number x has the quotient rest / (2 x - 1); before it come all seats of a full shard whose quotient is no smaller
    before = lambda x: full * (((2 * x - 1) * per_shard // rest - 1) // 2 + 1)
    lo, hi = 0, min(seats, math.ceil(seats * rest / blocks) + 2)
    while lo < hi:
        x = (lo + hi + 1) // 2
        if before(x) + x <= seats:
            lo = x
        else:
            hi = x - 1
    return (*divmod(seats - lo, full), lo)


@dataclass
class Mix:
    """report: one row per source; part: the documents that take part; quotas: one row per source."""

    report: DataFrame
    part: DataFrame
    quotas: DataFrame
    seed: int
    block: int

    def placed(self) -> DataFrame:
        """The documents with the tokens before them in their source's order, their block and shard."""
        ordered = running(self.part, ["source", "deal", "doc_id"], "tokens", ["source"]).withColumnRenamed("before", "start")
        # one row per target source, of which the driver has the list
        d = ordered.join(F.broadcast(self.quotas), "source")
        # a document of no tokens at the very end lies in the last block
        d = d.withColumn("block", F.least(F.expr(f"(start + tokens div 2) div {self.block}"), F.col("blocks") - 1))
        return d.withColumn("shard", F.expr("block div per_shard"))

    def _chosen(self) -> DataFrame:
        """The documents with times, how often the blocks that they lie in are used, and their source's quota in tokens."""
        d = self.placed()
        last = F.expr("blocks div per_shard")
        size = F.when(F.col("shard") < last, F.col("per_shard")).otherwise(F.expr("blocks % per_shard"))
        quota = F.when(F.col("shard") < last, F.col("each") + (F.col("shard") < F.col("more")).cast("bigint")).otherwise(F.col("last"))
        d = d.withColumn("size", size).withColumn("quota", quota)
        # a run of quota mod size blocks that begins at a seeded place of the shard and goes round
        begin = F.pmod(F.xxhash64(F.lit(self.seed), "source", "shard"), F.col("size"))
        place = F.pmod(F.col("block") - F.col("shard") * F.col("per_shard") - begin, F.col("size"))
        times = F.expr("quota div size") + (place < F.expr("quota % size")).cast("bigint")
        # the tokens that a source has left beyond its last whole round of repeats all count at its cap
        return d.withColumn("times", F.when(F.col("at_cap"), F.col("repeats")).otherwise(F.least(times, F.col("repeats"))))

    def selection(self) -> DataFrame:
        """(doc_id, source, tokens, times): the documents of the mix and how often each is used, at least once.

        A block counts with the documents whose middle it holds, so a run of blocks differs from its quota by
        half a document at either end. The differences of a source's shards are summed up and made good, to
        within half a document, in as many of its first shards as have room for them; documents of no tokens
        follow their block. Windows are within such a shard: at most its tokens in rows.
        """
        chosen = cut(self._chosen(), "chosen")
        got = chosen.groupBy("source").agg((F.max("quota_tokens") - F.sum(F.col("tokens") * F.col("times"))).alias("lacking"), F.max("at_cap").alias("at_cap"), F.max("blocks").alias("blocks"), F.max("per_shard").alias("per_shard"))
        # a quarter of a shard at most is asked of one
        shards = F.ceil(F.abs("lacking") / (F.col("per_shard") * self.block / 4))
        amends = got.where(~F.col("at_cap") & (F.col("lacking") != 0)).select("source", "lacking", F.least(shards, F.ceil(F.col("blocks") / F.col("per_shard"))).alias("over"))
        c = lookup_join(chosen, amends, ["source"], "left", spread=F.col("doc_id"))
        part = F.col("lacking") / F.col("over")
        able = F.when(F.col("lacking") > 0, F.col("times") < F.col("repeats")).otherwise(F.col("times") > 0)
        within = F.coalesce((F.col("shard") < F.col("over")) & able & (F.col("tokens") > 0), F.lit(False))
        # what can be added or taken away, in the seeded order, until it is enough
        w = Window.partitionBy("source", "shard").orderBy("start", "deal", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
        amended = c.where(within).withColumn("sum", F.sum("tokens").over(w)).withColumn("times", F.col("times") + F.when(F.col("sum") - F.col("tokens") / 2 <= F.abs(part), F.signum("lacking")).otherwise(0).cast("bigint"))
        every = c.where(~within).select("doc_id", "source", "tokens", "times").unionByName(amended.select("doc_id", "source", "tokens", "times"))
        return every.where(F.col("times") > 0).select("doc_id", "source", "tokens", F.col("times").cast("bigint").alias("times"))


def mix(sizes: DataFrame, targets: DataFrame, total: int | None = None, block: int = BLOCK, seed: int = 7, blocks_per_shard: int = BLOCKS_PER_SHARD) -> Mix:
    """Mix of documents sized by sizes (doc_id, source, tokens) to targets (source, weight, max_repeats).

    The targets are one row a source, a small table that is collected; of repeated rows of a source
    the greatest weight counts, null sources are ignored. Sources that are not in the targets take
    no part. `total` is the size of the mix in tokens, by default that of all documents taking part.
    What a source lacks goes to the others, as far as their repeats allow. No documents at all: every
    source with a weight falls short of nothing and nothing is chosen.

    A source falls short if max_repeats times its tokens is less than weight times that size, so one
    without documents does. That is read from the apportionment: the quota it would get without caps
    is above its cap by more blocks than rounding can make. Only where the two lie closer together,
    within half the number of sources and two blocks, are the tokens themselves compared.
    """
    spark = sizes.sparkSession
    wanted = targets.where(F.col("source").isNotNull()).groupBy("source").agg(F.max("weight").alias("weight"), F.max("max_repeats").alias("max_repeats"))
    rows = sorted(wanted.collect(), key=lambda r: r["source"])
    names = [r["source"] for r in rows]
    part = cut(sizes.where(F.col("source").isin(names)).select("doc_id", "source", "tokens", F.xxhash64(F.lit(seed), "doc_id").alias("deal")), "sizes")
    own = {r["source"]: int(r["t"] or 0) for r in part.groupBy("source").agg(F.sum("tokens").alias("t")).collect()}
    tokens = [own.get(n, 0) for n in names]
    goal = sum(tokens) if total is None else total
    weights = [float(r["weight"] or 0) for r in rows]
    repeats = [int(r["max_repeats"] or 0) for r in rows]
    caps = [k * t // block for k, t in zip(repeats, tokens)]
    # without caps, by the weights as they are given
    free = sainte_lague(weights, [1 << 62] * len(names), round(goal * sum(weights) / block))
    slack = len(names) / 2 + 2
    exact = [k * t < w * goal for k, t, w in zip(repeats, tokens, weights)]
    # what a source at its cap has is used to the last token, and what that leaves is apportioned anew among the others
    at_cap = [False] * len(names)
    while True:
        rest = max(0, goal - sum(k * t for k, t, c in zip(repeats, tokens, at_cap) if c))
        quota = sainte_lague([0.0 if c else w for w, c in zip(weights, at_cap)], caps, round(rest / block))
        more = [c or (w > 0 and q == cap and (u > cap or x)) for c, w, q, cap, u, x in zip(at_cap, weights, quota, caps, free, exact)]
        if more == at_cap:
            break
        at_cap = more
    quota = [cap if c else q for q, cap, c in zip(quota, caps, at_cap)]
    quotas, report = [], []
    for n, w, k, t, cap, u, q, x, full in zip(names, weights, repeats, tokens, caps, free, quota, exact, at_cap):
        short = bool(x if abs(u - cap) <= slack else u > cap)
        report.append((n, w, k, t, w * goal, cap, u, q, short))
        blocks = -(-t // block)
        if blocks and k and (q or full):
            quotas.append((n, k, blocks, blocks_per_shard, *shard_quotas(blocks, blocks_per_shard, min(q, k * blocks)), bool(full), k * t if full else min(q * block, k * t)))
    return Mix(
        spark.createDataFrame(report, "source string, weight double, max_repeats int, tokens bigint, target_tokens double, cap_blocks bigint, uncapped_blocks bigint, quota_blocks bigint, short boolean"),
        part,
        spark.createDataFrame(quotas, "source string, repeats bigint, blocks bigint, per_shard bigint, each bigint, more bigint, last bigint, at_cap boolean, quota_tokens bigint"),
        seed,
        block,
    )


def shares(m: Mix) -> DataFrame:
    """The report with the tokens that each source has in the mix and the share reached."""
    got = m.selection().groupBy("source").agg(F.sum(F.col("tokens") * F.col("times")).alias("mix_tokens"), F.count(F.lit(1)).alias("documents"), F.max("times").alias("most_often"))
    r = m.report.join(got, "source", "left").fillna(0, ["mix_tokens", "documents", "most_often"])
    return r.withColumn("share", F.col("mix_tokens") / F.greatest(F.sum("mix_tokens").over(Window.partitionBy()), F.lit(1)))
