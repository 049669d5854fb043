"""Temperature mixing of sources.

A source's weight is its token share to the power of an exponent, normalised. The exponent is
bisected: to the largest (least flattening) that reaches a target entropy, or to the smallest
(most flattening) that repeats no source more often than a limit. Weights turn into budgets,
and budgets into block permutations: each source's documents lie in hash blocks, every pass takes
the blocks in an order of its own, whole passes take all of them, and the last pass stops at
the block nearest to the budget.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Blocks of a source: at most so many, of at least so many tokens.
MAX_BLOCKS, MIN_BLOCK_TOKENS = 4096, 65_536
#: Rows of blocks that are broadcast: some 50 MB.
BROADCAST_ROWS = 1 << 19


def weights_at(tokens: dict[str, int], exponent: float) -> dict[str, float]:
    """Normalised weights share ** exponent; a source without tokens has weight 0."""
    total = sum(tokens.values())
    raw = {k: (n / total) ** exponent if n else 0.0 for k, n in tokens.items()}
    norm = sum(raw.values())
    return {k: w / norm if norm else 0.0 for k, w in raw.items()}


def entropy(weights: dict[str, float]) -> float:
    """Shannon entropy in nats."""
    return -sum(w * math.log(w) for w in weights.values() if w)


def passes_at(tokens: dict[str, int], exponent: float) -> dict[str, float]:
    """Passes over each source when the budget lets every source be seen once at least."""
    weights = weights_at(tokens, exponent)
    budget = max((n / weights[k] for k, n in tokens.items() if n), default=0.0)
    return {k: budget * weights[k] / n if n else 0.0 for k, n in tokens.items()}


def bisect(holds: Callable[[float], bool], steps: int = 60) -> float:
    """The least exponent in [0, 1] from which on ``holds`` is true (1 if it never is)."""
    if holds(0.0):
        return 0.0
    low, high = 0.0, 1.0
    for _ in range(steps):
        middle = (low + high) / 2
        low, high = (low, middle) if holds(middle) else (middle, high)
    return high


def exponent_for(tokens: dict[str, int], target_entropy: float | None = None, max_passes: float | None = None) -> float:
    """The exponent that meets the target entropy (in nats) or the limit on passes over a source.

    An entropy above that of equal weights gives 0, one below that of the shares gives 1.
    """
    if max_passes is not None:
        return bisect(lambda a: max(passes_at(tokens, a).values(), default=0.0) <= max_passes)
    if target_entropy is None:
        raise ValueError("give a target entropy or a limit on passes")
    if entropy(weights_at(tokens, 1.0)) >= target_entropy:
        return 1.0
    return bisect(lambda a: entropy(weights_at(tokens, a)) <= target_entropy)


def count_tokens(text: str = "text") -> Column:
    """White-space words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def mix(docs: DataFrame, source: str = "source", target_entropy: float | None = None, max_passes: float | None = 2.0, budget: int | None = None, seed: int = 1) -> DataFrame:
    """``docs`` in the mixture: each row as often as its source's budget says.

    The budget in tokens is by default the least that shows every source once at least, so that
    no document is lost; a smaller one leaves out blocks. Adds mix_pass (int, from 0), mix_block
    (int), mix_tokens (long, white-space words) and mix_order (double in [0, 1): reading rows in
    its order interleaves the sources by their weights); such columns of the input are replaced.
    A null source is a source of its own. Rows are spread over blocks by doc_id (equal ids: the
    same block; null ids: block of the null). Rows of sources without any token come once. The
    realised tokens differ from a source's budget by half a block at most. Texts of any length
    count whole; an empty table stays empty. Sources go through the driver: a number each.
    """
    own = {"mix_pass", "mix_block", "mix_tokens", "mix_order"}
    docs = docs.select(*[docs[f"`{f.name}`"] for f in docs.schema if f.name not in own])
    spark = docs.sparkSession
    name, tokens_col, block_col = "__mix_source", "mix_tokens", "mix_block"
    keyed = docs.withColumn(name, F.coalesce(F.concat(F.lit("="), F.col(f"`{source}`").cast("string")), F.lit("null"))).withColumn(tokens_col, count_tokens())
    slim = keyed.select(name, "doc_id", tokens_col)
    # One row for each source: a short list, which the bisection needs whole.
    totals = {r[0]: int(r[1]) for r in slim.groupBy(name).agg(F.sum(tokens_col)).collect()}
    exponent = exponent_for(totals, target_entropy, None if target_entropy is not None else max_passes)
    weights, seen = weights_at(totals, exponent), passes_at(totals, exponent)
    plan = []
    for k, n in totals.items():
        passes = seen[k] if budget is None else (budget * weights[k] / n if n else 0.0)
        passes = round(passes, 9) if n else 1.0
        plan.append((k, min(MAX_BLOCKS, max(1, -(-n // MIN_BLOCK_TOKENS))), int(passes), (passes - int(passes)) * n, passes))
    schema = T.StructType([T.StructField(name, T.StringType()), T.StructField("blocks", T.IntegerType()), T.StructField("whole", T.IntegerType()), T.StructField("rest", T.DoubleType()), T.StructField("passes", T.DoubleType())])
    # Blocks are known by number: what is broadcast has so many rows at most, or the join is left to Spark.
    small = (lambda df: F.broadcast(df)) if sum(p[1] for p in plan) <= BROADCAST_ROWS else (lambda df: df)
    sources = small(spark.createDataFrame(plan, schema))  # as many rows as sources
    block = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col("blocks")).cast("int")
    sums = slim.join(sources, name).withColumn(block_col, block).groupBy(name, block_col).agg(F.sum(tokens_col).alias("n"), F.first("whole").alias("whole"), F.first("rest").alias("rest"))
    # At most MAX_BLOCKS rows a source. The last, partial pass has an order of its own, as each pass has.
    turn = Window.partitionBy(name).orderBy(F.xxhash64(name, block_col, "whole", F.lit(seed)), block_col)
    upto = F.sum("n").over(turn.rowsBetween(Window.unboundedPreceding, 0))
    chosen = sums.withColumn("copies", F.col("whole") + F.when((F.col("rest") > 0) & (upto - F.col("n") / 2 <= F.col("rest")), 1).otherwise(0))
    # At most MAX_BLOCKS rows a source: broadcast where they are few, so that no text is shuffled for it.
    rows = keyed.join(sources, name).withColumn(block_col, block).join(small(chosen.select(name, block_col, "copies")), [name, block_col])
    rows = rows.where("copies > 0").withColumn("mix_pass", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    place = F.pmod(F.xxhash64(name, block_col, "mix_pass", F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    inside = F.pmod(F.xxhash64("doc_id", "mix_pass", F.lit(seed + 1)), F.lit(1 << 20)) / F.lit(float(1 << 60))
    order = (F.col("mix_pass") + place + inside) / F.greatest(F.ceil("passes").cast("double"), F.lit(1.0))
    return rows.select(*[F.col(f"`{f.name}`") for f in docs.schema], F.col("mix_pass").cast("int").alias("mix_pass"), block_col, tokens_col, order.alias("mix_order"))
