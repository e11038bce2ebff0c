"""Mixing sources to target weights by temperature.

Token shares of the sources are raised to an exponent and normalised. The exponent is bisected: it is the largest in
[0, 1] (so the mix stays as near to the natural one as it can) whose weights reach the target entropy, and it is not taken
so low that any source would be repeated more often than allowed. The weights are then realised with a token budget:
each source is dealt into BLOCKS blocks by a hash of the document, an epoch is a permutation of the blocks, whole
epochs are taken while the source's budget lasts, and of the last epoch the first blocks of the permutation, the last of
them up to the budget. By default the budget is the smallest that uses every document once at least.

Everything is expressions and aggregates. What meets in one task is BLOCKS rows of block sums a source, or the documents
of the one block of a source where its budget ends: never a source. Bisection runs as aggregates over the sources that
evaluate LEVELS levels of the bisection tree at once and return a row for each exponent.

Defined cases: null source is a source of its own; null text has no tokens; sources without tokens get weight 0 and are
taken once. Repeated rows are dealt alike and all stay. Empty tables give empty results.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecscore.llm.common import words, written

#: Blocks of a source: BLOCKS, or as many that none of them is likely to hold more than about PER_BLOCK documents.
BLOCKS, PER_BLOCK, SEED = 256, 20_000, 17
#: Share of the largest entropy (all sources alike) to reach, and how often a source may be repeated to reach it.
ENTROPY_SHARE, MAX_REPEATS = 0.98, 1.5
LEVELS, PASSES = 5, 4


def find_exponent(sources: DataFrame, entropy_share: float, max_repeats: float) -> tuple[float, float]:
    """sources: share > 0 of each source. The exponent, and the sum of the shares raised to it."""
    low, high = 0.0, 1.0
    s = F.col("share")
    ends = sources.agg(F.count(F.lit(1)).alias("n"), F.min(s).alias("least"), F.max(s).alias("most")).first()
    if ends["n"] == 0:
        return 1.0, 1.0

    def measure(exponents: list[float]) -> dict[float, tuple[float, float]]:
        each = sources.select(s, F.explode(F.array(*map(F.lit, exponents))).alias("a")).groupBy("a")
        sums = each.agg(F.sum(F.pow(s, F.col("a"))).alias("z"), F.sum(F.pow(s, F.col("a")) * F.log(s)).alias("l"))
        return {r["a"]: (math.log(r["z"]) - r["a"] * r["l"] / r["z"], r["z"]) for r in sums.collect()}

    # repeats of the rarest source over those of the commonest: (most / least) ** (1 - exponent)
    spread = math.log(ends["most"] / ends["least"])
    floor = max(0.0, 1.0 - math.log(max_repeats) / spread) if spread > 0 else 0.0
    target = entropy_share * math.log(ends["n"])
    if measure([1.0])[1.0][0] >= target:
        low = 1.0
    for _ in range(PASSES if low < 1.0 else 0):
        inner = [low + (high - low) * k / 2**LEVELS for k in range(1, 2**LEVELS)]
        found = measure(inner)
        enough = [a for a in inner if found[a][0] >= target]
        low = max([low, *enough])
        high = min([high, *(a for a in inner if a > low)])
    exponent = max(low, floor)
    return exponent, measure([exponent])[exponent][1]


def block_count(rows: int) -> int:
    return max(BLOCKS, 1 << max(0, -(-rows // PER_BLOCK) - 1).bit_length())


def keyed(docs: DataFrame, id_col: str, source_col: str, tokens: Column, blocks: int = BLOCKS) -> DataFrame:
    """docs with source (null-safe key), block, u in [0, 1) that orders a block, and tokens."""
    key = F.when(F.col(source_col).isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), F.col(source_col)))
    h = F.xxhash64(F.lit(SEED), F.col(id_col))
    u = F.pmod(F.xxhash64(F.lit(SEED + 1), F.col(id_col)), F.lit(1 << 40)) / float(1 << 40)
    return docs.withColumns({"__key": key, "__block": F.pmod(h, F.lit(blocks)).cast("int"), "__u": u, "__tokens": tokens})


def plan(docs: DataFrame, entropy_share: float = ENTROPY_SHARE, max_repeats: float = MAX_REPEATS, budget: float | None = None) -> DataFrame:
    """docs: as keyed(). A row for each block that is taken in an epoch: __key, __block, epoch, weight, quota, start and tokens of the block in the source's order, and room, where only part of it fits."""
    blocks = written(docs.groupBy("__key", "__block").agg(F.sum("__tokens").alias("block_tokens")), "blocks")
    sources = blocks.groupBy("__key").agg(F.sum("block_tokens").alias("source_tokens"))
    total = sources.agg(F.sum("source_tokens").alias("t")).first()["t"] or 0
    shares = sources.select("__key", "source_tokens", (F.col("source_tokens") / F.lit(float(max(total, 1)))).alias("share"))
    live = written(shares, "shares")
    exponent, z = find_exponent(live.filter("share > 0"), entropy_share, max_repeats)
    # the default budget uses each source once at least, so the first epoch takes all blocks, also those of empty texts after the last token
    first = F.lit(budget is None) & (F.col("epoch") == 0)
    if budget is None:
        most = live.filter("share > 0").agg(F.max("share").alias("m")).first()["m"]
        budget = total * z * most ** (1.0 - exponent) if most else 0.0
    weight = F.when(F.col("share") > 0, F.pow("share", F.lit(exponent)) / F.lit(z)).otherwise(0.0)
    quota = F.round(weight * F.lit(float(budget))).cast("long")
    live = live.select("__key", "source_tokens", weight.alias("weight"), quota.alias("quota"))
    epochs = F.when(F.col("source_tokens") > 0, F.ceil(F.col("quota") / F.greatest("source_tokens", F.lit(1)))).otherwise(1)
    live = live.withColumn("epoch", F.explode(F.when(epochs > 0, F.sequence(F.lit(0), (epochs - 1).cast("int")))))
    order = Window.partitionBy("__key", "epoch").orderBy(F.xxhash64(F.lit(SEED), "epoch", "__key", "__block"), "__block")
    taken = blocks.join(live, "__key").withColumn("start", F.coalesce(F.sum("block_tokens").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    taken = taken.withColumn("start", F.col("start") + F.col("epoch") * F.col("source_tokens"))
    room = F.col("quota") - F.col("start")
    taken = taken.filter((room > 0) | (F.col("source_tokens") == 0) | first).withColumn("room", F.when((F.col("block_tokens") > room) & ~first, room))
    return written(taken.select("__key", "__block", "epoch", "weight", "quota", "start", "block_tokens", "room"), "plan")


def realise(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """docs: as keyed(), once for each epoch that takes it, with weight, epoch and mix_position in [0, 1]: sorted by it, all sources run at their weights from first to last."""
    out = docs.join(plan, ["__key", "__block"])
    whole, cut = out.filter("room is null"), out.filter("room is not null")
    order = Window.partitionBy("__key", "__block", "epoch").orderBy("__u", "__tokens")
    cut = cut.withColumn("__before", F.coalesce(F.sum("__tokens").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).filter("__before < room").drop("__before")
    position = (F.col("start") + F.col("__u") * F.col("block_tokens")) / F.greatest("quota", F.lit(1))
    return whole.unionByName(cut).withColumn("mix_position", F.least(position, F.lit(1.0)))


def token_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", entropy_share: float = ENTROPY_SHARE, max_repeats: float = MAX_REPEATS, budget: float | None = None) -> DataFrame:
    """A row for each time a document is taken: doc_id, source, tokens, weight, epoch, block, mix_position. The texts are read once."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), token_count(F.col(text_col)).alias("tokens"))
    slim = written(keyed(slim, "doc_id", "source", F.col("tokens"), block_count(docs.count())), "slim")
    out = realise(slim, plan(slim, entropy_share, max_repeats, budget))
    return out.select("doc_id", "source", "tokens", "weight", F.col("epoch").cast("int").alias("epoch"), F.col("__block").alias("block"), "mix_position")


def mix_stage(docs: DataFrame, entropy_share: float = ENTROPY_SHARE, max_repeats: float = MAX_REPEATS) -> DataFrame:
    """The documents as often as the mix takes them, each at least once."""
    rows = docs.select(F.struct(*docs.columns).alias("__row"), F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("text").alias("__text"))
    rows = keyed(rows, "__id", "__source", token_count(F.col("__text")), block_count(docs.count()))
    return realise(rows, plan(rows, entropy_share, max_repeats)).select("__row.*")
