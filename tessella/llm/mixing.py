"""Operator 10, mixing sources to target weights: temperature by bisection, then budgeted block permutations. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tessella.llm._common import durable, free_name, n_words_of, sized, whole_text

#: No source is repeated more often than so many times.
MOST_REPEATS = 1.25
SEED = 7
#: Parts that the bisection cuts its interval into in one job, and the jobs: 16 ** 9 is finer than a double needs here.
SECTIONS = 16
ROUNDS = 9
#: Blocks that all sources together have about at most, and the fewest tokens of a block.
MOST_BLOCKS = 100_000
LEAST_BLOCK = 50_000


def source_tokens(sized: DataFrame) -> DataFrame:
    """(src, n_docs, tokens) from rows (src, n): one row for each source."""
    return sized.groupBy("src").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n").alias("tokens"))


def exponent(sources: DataFrame, most_repeats: float | None = MOST_REPEATS, entropy: float | None = None) -> float:
    """The exponent in [0, 1] of the token shares, by bisection over the source table.

    With most_repeats: the least exponent (the flattest weights) at which no source is seen more often than that, where the
    budget lets the least repeated source be seen once. With entropy: the greatest at which the weights have at least that
    entropy (in nats), or 0 if even equal weights have less. Each job evaluates the inner points of the interval at once."""
    if (most_repeats is None) == (entropy is None):
        raise ValueError("give most_repeats or entropy")
    shares = sources.where("tokens > 0").withColumn("x", F.log(F.col("tokens").cast("double")))
    top = shares.agg(F.max("x").alias("top")).first()["top"]
    if top is None:
        return 1.0
    lo, hi = 0.0, 1.0
    shares = shares.select((F.col("x") - F.lit(top)).alias("x"))
    for _ in range(ROUNDS):
        inner = [lo + (hi - lo) * k / SECTIONS for k in range(SECTIONS + 1)]
        at = shares.select("x", F.explode(F.array(*map(F.lit, inner))).alias("a"))
        if most_repeats is not None:
            # epochs of a source, with the budget at which the largest has one: share ** (a - 1)
            got = {r["a"]: r["v"] for r in at.groupBy("a").agg(F.max(F.exp((F.col("a") - 1) * F.col("x"))).alias("v")).collect()}
            good = [k for k, a in enumerate(inner) if got[a] <= most_repeats]
            if not good:
                return hi
            k = good[0]  # more exponent, fewer repeats
            if k == 0:
                return inner[0]
            lo, hi = inner[k - 1], inner[k]
        else:
            z, zx = F.sum(F.exp(F.col("a") * F.col("x"))), F.sum(F.exp(F.col("a") * F.col("x")) * F.col("a") * F.col("x"))
            got = {r["a"]: r["v"] for r in at.groupBy("a").agg((F.log(z) - zx / z).alias("v")).collect()}
            good = [k for k, a in enumerate(inner) if got[a] >= entropy]
            if not good:
                return lo
            k = good[-1]  # more exponent, less entropy
            if k == SECTIONS:
                return inner[-1]
            lo, hi = inner[k], inner[k + 1]
    return hi if most_repeats is not None else lo


def target_weights(sources: DataFrame, alpha: float, budget: float | None = None) -> DataFrame:
    """(src, n_docs, tokens, weight, epochs): weights proportional to tokens ** alpha, and how often each source is seen.

    Without a budget it is the least at which every source is seen at least once, so that mixing repeats documents and drops none."""
    powered = sources.withColumn("p", F.when(F.col("tokens") > 0, F.pow(F.col("tokens").cast("double"), F.lit(float(alpha)))).otherwise(0.0))
    sums = powered.agg(F.sum("p").alias("z"), F.max(F.when(F.col("tokens") > 0, F.col("tokens") / F.col("p"))).alias("once"))
    out = powered.crossJoin(F.broadcast(sums))  # one row, by the global aggregate
    weight = F.when(F.col("z") > 0, F.col("p") / F.col("z")).otherwise(0.0)
    seen = F.col("p") * F.col("once") if budget is None else weight * F.lit(float(budget))
    epochs = F.when(F.col("tokens") > 0, seen / F.col("tokens")).otherwise(1.0)
    # A whisker under a whole number of passes is meant as that number.
    epochs = F.when(F.abs(epochs - F.round(epochs)) < 1e-9, F.round(epochs)).otherwise(epochs)
    return out.select("src", "n_docs", "tokens", weight.alias("weight"), epochs.alias("epochs"))


def _draw(*parts: Column) -> Column:
    """A fixed random text for the parts; its order is the drawn order."""
    return F.md5(F.concat_ws(":", F.lit(str(SEED)), *[p.cast("string") for p in parts]))


def mixed(
    docs: DataFrame, most_repeats: float | None = MOST_REPEATS, entropy: float | None = None, budget: float | None = None,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", tokens_col: str | None = None,
) -> DataFrame:
    """The input rows with their columns, as often as the target weights want them, beside the struct mix (mix_ where there is a mix already):
    source weight and epochs, pass (from 0), block, place of the block in the pass's permutation, and the row's tokens (those of
    tokens_col, or the words of its text).

    A source is dealt by hash to blocks of bounded size. A pass takes the blocks in an order drawn for it, until its tokens are
    used up; of the block where that happens it takes ids in drawn order, all rows of an id or none. So only sums by block are ever
    ordered within a source, and ids, without their rows, only within one block of a pass. A null source is a source of its own;
    rows without tokens go where their block goes; an empty table gives no rows."""
    src, n = F.col(source_col).cast("string"), F.coalesce(F.col(tokens_col).cast("long"), F.lit(0)) if tokens_col else n_words_of(whole_text(text_col))
    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), src.alias("src"), n.alias("n"), F.col(id_col).alias("id"))
    narrow = durable(named.select("src", "n", "id"))
    total = durable(source_tokens(narrow))
    alpha = exponent(total, most_repeats, entropy)
    weights = durable(target_weights(total, alpha, budget))
    tokens = weights.agg(F.sum("tokens")).first()[0] or 0
    block_tokens = max(LEAST_BLOCK, tokens // MOST_BLOCKS)
    # Sources: the blocks of each. Joined by size, so a source table that is small goes to the rows.
    plan = weights.withColumn("n_blocks", F.greatest(F.lit(1), F.ceil(F.col("tokens") / block_tokens))).select(F.col("src").alias("s"), "n_blocks", "tokens", "weight", "epochs")
    plan = durable(plan)

    def deal(rows: DataFrame) -> DataFrame:
        return rows.join(sized(plan, 50_000), F.col("src").eqNullSafe(F.col("s"))).withColumn("block", F.pmod(F.conv(F.substring(_draw(F.col("id")), 1, 8), 16, 10).cast("long"), F.col("n_blocks")))

    by_block = durable(deal(narrow).groupBy("s", "block").agg(F.sum("n").alias("size"), F.first("tokens").alias("tokens"), F.first("epochs").alias("epochs")))
    # A pass's quota, and what of it each block gets.
    passes = by_block.select("*", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil("epochs"), F.lit(1)).cast("int") - 1)).alias("pass"))
    quota = F.when(F.col("epochs") >= F.col("pass") + 1, F.col("tokens").cast("double")).otherwise((F.col("epochs") - F.col("pass")) * F.col("tokens"))
    order = Window.partitionBy("s", "pass").orderBy(_draw(F.col("pass"), F.col("block")), "block")
    placed = passes.select("*", quota.alias("quota"), F.row_number().over(order).alias("place"), (F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).alias("before"))
    whole = (F.col("pass") + 1 <= F.col("epochs")) | (F.col("before") + F.col("size") <= F.col("quota"))
    placed = placed.where(whole | (F.col("before") < F.col("quota"))).select("s", "block", "pass", "place", whole.alias("whole"), (F.col("quota") - F.col("before")).alias("room"))
    per_block = durable(placed.groupBy("s", "block").agg(F.sort_array(F.collect_list(F.struct("pass", "place", "whole", "room"))).alias("turns")))  # as many as the passes
    turns = per_block.select(F.col("s").alias("s2"), F.col("block").alias("b2"), "turns")
    rows = deal(named).join(sized(turns, 2 * MOST_BLOCKS), F.col("s").eqNullSafe(F.col("s2")) & (F.col("block") == F.col("b2")))
    info = F.struct("weight", "epochs", F.col("turn.pass").alias("pass"), "block", F.col("turn.place").alias("place"), F.col("n").alias("tokens")).alias("mix")
    full = rows.select("row", "weight", "epochs", "block", "n", F.explode(F.filter("turns", lambda t: t["whole"])).alias("turn")).select("row", info)
    # The one block of a pass that is cut: of its ids in drawn order those that there is room for; the rows come to these after that.
    cut = durable(turns.select("s2", "b2", F.explode(F.filter("turns", lambda t: ~t["whole"])).alias("turn")))
    mine = F.col("s").eqNullSafe(F.col("s2")) & (F.col("block") == F.col("b2"))
    inside = deal(narrow).join(sized(cut, 50_000), mine).groupBy("s", "block", "id", "turn").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("s", "turn.pass", "block").orderBy(_draw(F.col("turn.pass"), F.col("id")), "id")
    inside = inside.withColumn("used", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
    taken = durable(inside.where(F.col("used") + F.col("n") <= F.col("turn.room")).select(F.col("s").alias("s3"), F.col("block").alias("b3"), F.col("id").alias("id3"), "turn"))
    own = deal(named).join(sized(cut.select("s2", "b2").distinct(), 50_000), mine, "left_semi")
    part = own.join(sized(taken), F.col("s").eqNullSafe(F.col("s3")) & (F.col("block") == F.col("b3")) & F.col("id").eqNullSafe(F.col("id3"))).select("row", info)
    out = full.unionByName(part)
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns], F.col("mix").alias(free_name("mix", docs.columns)))

