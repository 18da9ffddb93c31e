"""Problem 8: put the documents of several sources together to target shares of the total size in tokens.

Method: Sainte-Lague apportionment. The total is divided into equal-token blocks; each block goes to the source with
the highest quotient share / (2 k + 1), k being what it has, as long as its stock times max_repeats holds out. A
source's blocks are apportioned to its shards the same way, by their tokens, which gives integer quotas per shard;
within a shard seeded order selects the blocks: every block as often as the quota covers the shard in full, and the
first ones once more for the rest. Only token sums per (source, shard) go to the driver, one per ``SHARD_TOKENS`` tokens
of the collection and at least one per source.

By default the total is the one at which the shares come nearest to their targets (``best_total``).
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.encoding import TOKENIZER_DIR, token_counts
from folioscope.runtime import cut, require

#: Tokens aimed at in one shard; most rows of the plan that are broadcast (under 100 bytes each).
SHARD_TOKENS, PLAN_ROWS = 50_000_000, 200_000
#: The targets are a small table by their nature; more sources than this are refused.
MAX_SOURCES = 10_000


def sainte_lague(weights: dict, stock: dict, seats: int) -> dict:
    """Seats per key by highest quotients weight / (2 k + 1), at most stock[key]; ties go to the smaller key.

    The bulk is given at once: with divisor d a key of weight w has floor(w / d + 1/2) seats, so a divisor a little too
    large is found by bisection and the heap only deals out the remainder.
    """
    won = {k: 0 for k in weights}
    live = {k: w for k, w in weights.items() if w > 0 and stock.get(k, 0) > 0}
    if not live or seats <= 0:
        return won
    seats = min(seats, sum(stock[k] for k in live))
    at = lambda d: {k: min(stock[k], int(w / d + 0.5)) for k, w in live.items()}
    lo, hi = 0.0, 2.1 * max(live.values())
    lo = min(live.values()) / (2.0 * seats + 2)
    for _ in range(200):
        mid = (lo * hi) ** 0.5
        if sum(at(mid).values()) > seats:
            lo = mid
        else:
            hi = mid
    won |= at(hi)
    heap = [(-w / (2 * won[k] + 1), k) for k, w in live.items() if won[k] < stock[k]]
    heapq.heapify(heap)
    for _ in range(seats - sum(won.values())):
        _, k = heapq.heappop(heap)
        won[k] += 1
        if won[k] < stock[k]:
            heapq.heappush(heap, (-live[k] / (2 * won[k] + 1), k))
    return won


def best_total(share: dict, room: dict, mean: dict) -> int:
    """The total at which the shares come nearest to their targets.

    ``room`` is what a source can give (stock times max_repeats), ``mean`` its mean document, half of which its share is off by
    in the mean. Looked at are the totals at which a source is just used up; of equally near ones the largest is taken.
    """
    live = {s: w for s, w in share.items() if room.get(s, 0) > 0 and w > 0}
    all_of = sum(live.values())
    live = {s: w / all_of for s, w in live.items()}
    far = lambda t: sum(max(0.0, w - room[s] / t) + mean[s] / (2 * t) for s, w in live.items())
    totals = sorted({min(sum(room[s] for s in live), int(room[s] / w)) for s, w in live.items()} - {0})
    return min(totals, key=lambda t: (round(far(t), 9), -t)) if totals else 0


def mix(docs: DataFrame, targets: DataFrame, total_tokens: int | None = None, block_tokens: int | None = None, seed: int = 7, folder: str = TOKENIZER_DIR) -> tuple[DataFrame, DataFrame]:
    """(selection, report).

    selection (doc_id, source, n_tokens, copies): documents used at least once. report: one row per source of the
    targets with target_share, stock and taken tokens, quota in blocks, actual_share and the most copies of a document.
    total_tokens: the size aimed at, by default the one whose shares come nearest to the targets: larger totals exhaust a
    source, smaller ones are coarser. block_tokens: by default a 2,000th of the total, at least 64 tokens. Sources without documents get nothing and their share
    goes to the others; null, empty and tokenless texts are never used; documents of null or unlisted sources are left out.
    """
    goal = require(targets, "source", "target_share", "max_repeats").where("source is not null and target_share > 0").groupBy("source").agg(F.sum("target_share").alias("target_share"), F.min(F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0))).alias("max_repeats"))
    rows = goal.limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources in the targets")
    share, repeats = {r["source"]: r["target_share"] for r in rows}, {r["source"]: r["max_repeats"] for r in rows}

    listed = require(docs, "doc_id", "source", "text").join(F.broadcast(goal.select("source")), "source", "left_semi")  # at most MAX_SOURCES rows
    sizes = token_counts(listed.select(F.struct("doc_id", "source").alias("id"), "text"), "id", "text", folder=folder).where("n_tokens > 0")
    sized = cut(sizes.select("id.doc_id", "id.source", "n_tokens"))
    sums = sized.groupBy("source").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n")).collect()  # at most one row per target
    stock = {r["source"]: r["t"] for r in sums}
    total = total_tokens if total_tokens is not None else best_total(share, {s: repeats[s] * t for s, t in stock.items()}, {r["source"]: r["t"] / r["n"] for r in sums})
    block = block_tokens or max(64, total // 2000)

    shards = {s: -(-t // SHARD_TOKENS) for s, t in stock.items()}
    n_shards = F.create_map(*[F.lit(x) for s, n in shards.items() for x in (s, n)]) if shards else F.create_map().cast("map<string,int>")
    sized = sized.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(seed)), n_shards[F.col("source")]).cast("int"))
    order = Window.partitionBy("source", "shard").orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id")
    before = F.sum("n_tokens").over(order) - F.col("n_tokens")
    blocked = cut(sized.withColumn("block", F.floor((before + F.col("n_tokens") / 2) / block).cast("bigint")))
    blocks = blocked.groupBy("source", "shard").agg(F.sum("n_tokens").alias("t")).collect()  # one row per shard
    own_of: dict = {}
    for r in blocks:
        own_of.setdefault(r["source"], {})[r["shard"]] = float(r["t"])

    by_source = {s: int(repeats[s] * t // block) for s, t in stock.items()}
    quota = sainte_lague(share, by_source, total // block)
    per_shard: list[tuple] = []
    for s in stock:
        own = own_of[s]
        room = {k: int(repeats[s] * t // block) + 1 for k, t in own.items()}
        for k, q in sainte_lague(own, room, quota.get(s, 0)).items():
            per_shard.append((s, k, int(q * block), int(own[k]), int(repeats[s])))
    spark = docs.sparkSession
    plan = spark.createDataFrame(per_shard, "source string, shard int, want bigint, stock bigint, repeats int")

    # Full passes over a shard, then its blocks in order until the quota is met.
    per_block = blocked.groupBy("source", "shard", "block").agg(F.sum("n_tokens").alias("t"))
    turn = Window.partitionBy("source", "shard").orderBy("block")
    chosen = (
        per_block.withColumn("upto", F.sum("t").over(turn) - F.col("t") / 2)
        .join(F.broadcast(plan) if len(per_shard) <= PLAN_ROWS else plan, ["source", "shard"])
        .withColumn("passes", F.least(F.floor(F.col("want") / F.col("stock")), F.col("repeats")))
        .withColumn("more", ((F.col("want") - F.col("passes") * F.col("stock")) >= F.col("upto")) & (F.col("passes") < F.col("repeats")))
        .withColumn("copies", (F.col("passes") + F.col("more").cast("int")).cast("int"))
        .select("source", "shard", "block", "copies")
    )
    selection = cut(blocked.join(chosen, ["source", "shard", "block"]).where("copies > 0").select("doc_id", "source", "n_tokens", "copies"))
    taken = selection.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("taken_tokens"), F.max("copies").alias("max_copies"), F.count("*").alias("n_docs"))
    stocks = spark.createDataFrame([(s, int(stock.get(s, 0)), int(quota.get(s, 0)), int(block)) for s in share], "source string, stock_tokens bigint, quota_blocks bigint, block_tokens bigint")
    every = taken.agg(F.sum("taken_tokens")).first()[0] or 1
    report = (
        goal.join(stocks, "source")
        .join(taken, "source", "left")
        .select("source", "target_share", "max_repeats", "stock_tokens", "block_tokens", "quota_blocks", F.coalesce("taken_tokens", F.lit(0)).alias("taken_tokens"),
                F.coalesce(F.col("taken_tokens") / F.lit(every), F.lit(0.0)).alias("actual_share"), F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("max_copies", F.lit(0)).alias("max_copies"))
    )
    return selection, report
