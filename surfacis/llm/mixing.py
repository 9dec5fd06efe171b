"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, in_ranges, running_sum, stage

#: Weights of sources in code point order, repeating; words of the mix against all words; times that a word is taken at most.
WEIGHTS, SHARE, EPOCHS = (5.0, 2.0, 1.0), 1.5, 2


def word_count(text: Column) -> Column:
    """Number of words between ASCII white space; 0 for null."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\f\r"))
    gaps = F.length(F.regexp_replace(inner, f"[^{SPACE}]*([{SPACE}])[{SPACE}]*|[^{SPACE}]+", "$1"))
    return F.when(inner == "", F.lit(0)).otherwise(gaps + 1).cast("long")


def targets(sizes: dict, weights: dict, budget: float, epochs: int = EPOCHS) -> dict:
    """Share budget by weight; a source stops at epochs times its size, and what is over goes to the others by weight until none is above."""
    out, free, left = {}, set(sizes), budget
    while free:
        unit = left / sum(weights[s] for s in free)
        full = {s for s in free if unit * weights[s] > epochs * sizes[s]}
        if not full:
            return out | {s: unit * weights[s] for s in free}
        out |= {s: float(epochs * sizes[s]) for s in full}
        left -= sum(out[s] for s in full)
        free -= full
    return out


def whole(goal: dict) -> dict:
    """Targets in whole words that add up to the rounded budget: rounded down, and a word more where most was lost."""
    out = {s: int(g) for s, g in goal.items()}
    short = round(sum(goal.values())) - sum(out.values())
    for s in sorted(goal, key=lambda s: (out[s] - goal[s], s is None, s or ""))[:short]:
        out[s] += 1
    return out


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, seed: int = 17, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", size: Column | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """What a mix takes of each row: id_col, source, size, source_size, target, taken and first_at, with the columns of carry.

    Every source queues all its rows in a shuffled order (a hash of seed, id and text), epochs times over. A row
    finishes at the source's words so far divided by its target in whole words, so all sources reach their target at 1; a row
    in service then is split there, and what is left of it queues on. A global range sort by finish time gives every piece its place in the mix
    (first_at: words before the row's first piece), and the truncation at the total budget takes all beyond it away.
    Words of a null text: 0; such rows stay with taken 0. Null is a source of its own and comes last; rows that
    repeat share their place and are taken alike. Sources are counted on the cluster; one row for each source comes to the
    driver to share the budget, nothing else. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), (word_count(F.col(text_col)) if size is None else size).alias("size"), F.xxhash64(text_col).alias("h"), *[F.col(c).alias(f"__{c}") for c in carry])
    rows = rows.withColumn("at", F.xxhash64(F.lit(seed), "id", "h"))
    order = [F.col("source").asc_nulls_last(), F.col("at"), F.col("id"), F.col("h"), F.col("row")]
    rows = stage(rows.withColumn("row", F.monotonically_increasing_id()), "mix-rows")
    sizes = {r["source"]: r["n"] for r in rows.groupBy("source").agg(F.sum("size").alias("n")).collect()}
    named = sorted(sizes, key=lambda s: (s is None, s or ""))
    goal = targets(sizes, {s: weights[i % len(weights)] for i, s in enumerate(named)}, share * sum(sizes.values()), epochs)
    words = whole(goal)
    goals = spark.createDataFrame([(s, sizes[s], float(goal[s]), words[s]) for s in named], "s string, source_size long, target double, horizon long")
    ranged = in_ranges(rows, order, "mix-order")
    placed = running_sum(ranged, order, "size", "before", by="source").join(F.broadcast(goals) if len(named) <= 100_000 else goals, F.col("source").eqNullSafe(F.col("s"))).drop("s", "__pid")

    passes = placed.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    start = F.col("before") + F.col("source_size") * F.col("epoch")
    passes = passes.select("row", "epoch", "size", "horizon", start.alias("start"), F.least(F.col("size"), F.greatest(F.col("horizon") - start, F.lit(0))).alias("due"))
    parts = F.array(F.struct((F.col("start") + F.col("due")).alias("end"), F.col("due").alias("words")), F.struct((F.col("start") + F.col("size")).alias("end"), (F.col("size") - F.col("due")).alias("words")))
    pieces = passes.select("row", "epoch", "horizon", F.inline(parts)).where("words > 0")
    finish = F.when(F.col("horizon") > 0, F.col("end") / F.nullif(F.col("horizon"), F.lit(0))).otherwise(F.lit(float("inf")))
    pieces = pieces.select("row", "epoch", "words", finish.alias("finish"))
    by = [F.col("finish"), F.col("row"), F.col("epoch")]
    queue = running_sum(in_ranges(pieces, by, "mix-queue"), by, "words", "mix_at")
    budget = sum(words.values())
    cut = queue.withColumn("words", F.least(F.col("words"), F.greatest(F.lit(budget) - F.col("mix_at"), F.lit(0)))).where("words > 0")
    taken = cut.groupBy("row").agg(F.sum("words").alias("taken"), F.min("mix_at").alias("first_at"))
    out = placed.join(taken, "row", "left")
    return out.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_at", "h", *[F.col(f"__{c}").alias(c) for c in carry])
