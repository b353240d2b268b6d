"""Mixing sources to target weights by temperature.

Shares of tokens are raised to an exponent and normalised: 1 keeps the shares, 0 makes all sources equal.
The exponent is found by bisection, so that the weights reach an entropy or that no source is repeated more
often than a limit. Weights become budgets of whole tokens, and budgets are met by block permutations: a
source's documents are dealt into blocks, every epoch goes through the blocks in an order of its own, and
the last epoch stops at the document that reaches the budget. Everything is DataFrame operations.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.llm.session import materialise, quoted
from tallyfold.llm.sharding import PRIME

#: Blocks of one source.
BLOCKS = 256

#: Slices by order of a block where a budget ends; rows are ordered in one of them only.
SLICES = 4096

#: The plan has one row for each source and block; one of at most so many is broadcast.
BROADCAST_BLOCKS = 100_000

#: Halvings of the exponent's interval, several of which are evaluated in one pass over the sources.
HALVINGS, HALVINGS_A_PASS = 40, 4

#: A token here is a run of anything but ASCII white space.
TOKEN = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Target:
    """What the exponent is to meet, one of the two.

    entropy: of the weights, as a share of the logarithm of the number of sources, 0 to 1.
    repeats: how often at most any source is gone through while the one with the least is gone through once.
    """

    entropy: float | None = None
    repeats: float | None = None

    def __post_init__(self):
        if (self.entropy is None) == (self.repeats is None):
            raise ValueError("either an entropy or a limit of repeats")


def n_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0)).cast("long")


def _met(sources: DataFrame, target: Target, exponents: list[float]) -> list[bool]:
    """For each exponent whether its weights are flat enough for the target; one pass over the sources."""
    sums = [F.count("*").alias("n")]
    log_share = F.log("share")
    for i, e in enumerate(exponents):
        power = F.exp(log_share * F.lit(e))
        often = power / F.col("share")
        sums += [F.sum(power).alias(f"power{i}"), F.sum(power * log_share * F.lit(e)).alias(f"logs{i}")]
        sums += [F.max(often).alias(f"most{i}"), F.min(often).alias(f"least{i}")]
    row = sources.where("tokens > 0").agg(*sums).first()
    if not row["n"]:
        return [True] * len(exponents)
    if target.repeats is not None:
        return [row[f"most{i}"] / row[f"least{i}"] <= target.repeats for i in range(len(exponents))]
    found = [math.log(row[f"power{i}"]) - row[f"logs{i}"] / row[f"power{i}"] for i in range(len(exponents))]
    return [h >= target.entropy * math.log(row["n"]) for h in found]


def bisect_exponent(sources: DataFrame, target: Target) -> float:
    """The exponent in 0 .. 1 that meets the target, for sources (share, tokens).

    Entropy falls and repeats fall as the exponent grows. For an entropy it is the largest exponent that
    still has it (1 if the shares themselves do), for repeats the least that keeps the limit (0 if equal
    weights do). A pass evaluates all middles that the next few halvings can need.
    """
    down = target.entropy is not None
    low, high = 0.0, 1.0
    first = _met(sources, target, [low, high])
    if down and first[1]:
        return 1.0
    if not down and first[0]:
        return 0.0
    done = 0
    while done < HALVINGS:
        n = 1 << HALVINGS_A_PASS
        grid = [low + (high - low) * i / n for i in range(n + 1)]
        met = [None, *_met(sources, target, grid[1:-1]), None]
        a, b = 0, n
        while b - a > 1:
            middle = (a + b) // 2
            if met[middle] == down:
                a = middle
            else:
                b = middle
        low, high, done = grid[a], grid[b], done + HALVINGS_A_PASS
    return low if down else high


def weigh(sources: DataFrame, target: Target, budget: int | None = None) -> DataFrame:
    """sources (source, tokens) with share, weight, exponent and budget (whole tokens).

    Without a total budget it is the least one that goes through every source once at least. Sources of no
    tokens have weight and budget 0.
    """
    total = sources.agg(F.sum("tokens")).first()[0] or 1
    shared = materialise(sources.withColumn("share", F.col("tokens") / F.lit(total)), "sources")
    exponent = bisect_exponent(shared, target)
    power = F.when(F.col("tokens") > 0, F.exp(F.log("share") * F.lit(exponent))).otherwise(F.lit(0.0))
    once = F.when(F.col("tokens") > 0, F.col("tokens") / power)
    sums = shared.agg(F.sum(power).alias("power"), F.max(once).alias("once")).first()
    whole = sums["power"] or 1.0
    least = (sums["once"] or 0.0) * whole
    everything = float(budget) if budget is not None else least
    weight = power / F.lit(whole)
    # Raised in the last places, so that a source that is to be gone through once is.
    amount = F.floor(weight * F.lit(everything) * F.lit(1 + 1e-12) + F.lit(1e-6)).cast("long")
    return shared.withColumns({"weight": weight, "budget": amount, "exponent": F.lit(exponent)})


def mixed_sql(key: str, salt: str) -> str:
    """A pseudo-random number below PRIME for an integer key, in SQL."""
    once = f"((((cast({key} as bigint) % {PRIME} + {PRIME}) % {PRIME}) * 1103515245 + {salt}) % {PRIME})"
    return f"(({once} * 48271 + 12345) % {PRIME} * ({once} % 46337 + 1) % {PRIME})"


def _plan(blocks: DataFrame, weighed: DataFrame, seed: int) -> DataFrame:
    """For each source and block: epochs, whether one more takes the whole block, and else how many tokens."""
    order = Window.partitionBy("_tf_s").orderBy(F.expr(mixed_sql("_tf_b", f"({seed} + _tf_epochs)")), "_tf_b")
    draws = weighed.select(
        F.col("source").alias("_tf_s"), "weight",
        F.expr("if(tokens > 0, budget div tokens, 1)").alias("_tf_epochs"),
        F.expr("if(tokens > 0, budget % tokens, 0)").alias("_tf_rest"),
    )
    return (
        blocks.join(draws, "_tf_s")
        .withColumn("_tf_before", F.sum("_tf_tokens").over(order) - F.col("_tf_tokens"))
        .withColumn("_tf_left", F.greatest(F.col("_tf_rest") - F.col("_tf_before"), F.lit(0)))
        .withColumn("_tf_whole", (F.col("_tf_left") > 0) & (F.col("_tf_left") >= F.col("_tf_tokens")))
        .select("_tf_s", "_tf_b", "weight", "_tf_epochs", "_tf_left", "_tf_whole")
    )


def mix(
    rows: DataFrame, target: Target, budget: int | None = None, seed: int = 1, counted: bool = False, prefix: str = ""
) -> DataFrame:
    """rows (doc_id, text, source, ...) with copies, how often each is drawn, and its source's weight.

    A source is drawn budget div tokens times as a whole; the rest is the start of one more epoch: blocks in
    a seeded order, and within the block where the rest ends, rows in such an order until the one that
    reaches it. Rows of no tokens are drawn with every whole epoch, sources of no tokens once. A null source
    is a source of its own; null and empty texts have no tokens; a row without an id is dealt by a hash of its text.
    Sums are made per source and block before they are put together. Documents aren't shuffled (but for rows that
    agree in id and tokens where a budget ends): of the blocks where budgets end, ids and tokens are, to find the
    last row that is taken.
    counted: rows have n_tokens and _tf_key (see _dealt_by()), which are taken instead of text. prefix is put before the two names; columns
    that are named so are replaced.
    """
    copies, weight = f"{prefix}copies", f"{prefix}weight"
    of = F.col("n_tokens") if counted else n_tokens(F.col("text"))
    key = F.col("_tf_key") if counted else _dealt_by()
    kept = rows.drop(copies, weight).withColumns(
        {"_tf_s": F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")), "_tf_key": key}
    )
    kept = kept.withColumn("_tf_b", F.expr(f"{mixed_sql('_tf_key', str(seed))} % {BLOCKS}").cast("int"))
    tokens = kept.select("_tf_s", "_tf_b", "_tf_key", "doc_id", of.alias("n_tokens"))
    if not counted:  # words of texts are counted once
        tokens = materialise(tokens, "tokens")
    sums = tokens.groupBy("_tf_s", "_tf_b").agg(F.sum("n_tokens").alias("_tf_tokens"))
    blocks = materialise(sums, "blocks")
    size = blocks.count()
    totals = blocks.groupBy(F.col("_tf_s").alias("source")).agg(F.sum("_tf_tokens").alias("tokens"))
    plan = materialise(_plan(blocks, weigh(totals, target, budget), seed), "plan", size)
    plan = plan.withColumnRenamed("weight", weight)
    keys, ends = ["_tf_s", "_tf_b"], (F.col("_tf_left") > 0) & ~F.col("_tf_whole")
    order = F.expr(mixed_sql("_tf_key", f"({seed} + _tf_epochs)"))
    first = (order.alias("order"), F.coalesce("doc_id", F.lit(0)).cast("long").alias("id"))
    place, counted_place = F.struct(*first, of.alias("n")), F.struct(*first, F.col("n_tokens").alias("n"))
    ending = plan.where(ends).select(*keys, "_tf_epochs", "_tf_left")
    narrow = tokens.join(_sent(ending, size), keys).select(*keys, counted_place.alias("at"), F.col("_tf_left").alias("left"))
    borders = materialise(_borders(narrow, keys), "borders", size)
    plan = plan.join(_sent(borders, size), keys, "left")
    mixed = kept.join(_sent(plan, size), keys)
    more = F.when(~ends, F.col("_tf_whole")).otherwise(place <= F.col("_tf_border"))
    if borders.where("_tf_taken < _tf_tied").isEmpty():
        found = mixed.withColumn(copies, F.col("_tf_epochs") + more.cast("long"))
    else:  # rows that agree in all that orders them; so many of them are taken
        odd = F.coalesce(ends & (place == F.col("_tf_border")) & (F.col("_tf_taken") < F.col("_tf_tied")), F.lit(False))
        alike = Window.partitionBy(*keys).orderBy("_tf_key")
        tied = mixed.where(odd).withColumn(copies, F.col("_tf_epochs") + (F.row_number().over(alike) <= F.col("_tf_taken")).cast("long"))
        found = mixed.where(~odd).withColumn(copies, F.col("_tf_epochs") + more.cast("long")).unionByName(tied)
    ours = ["_tf_s", "_tf_b", "_tf_key", "_tf_epochs", "_tf_left", "_tf_whole", "_tf_border", "_tf_taken", "_tf_tied"]
    return found.drop(*ours)


def _dealt_by() -> Column:
    """The number by which a document is dealt: its id, or for a null one a hash of its text."""
    return F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text"))


def _sent(table: DataFrame, size: int) -> DataFrame:
    return F.broadcast(table) if size <= BROADCAST_BLOCKS else table


def _borders(narrow: DataFrame, keys: list[str]) -> DataFrame:
    """For each block where a budget ends (rows keys, at, left) the last row that is taken (_tf_border).

    _tf_tied rows agree with it, of which _tf_taken are taken. Tokens are summed by slices of the order first, and
    rows are put in order only in the slice in which the budget ends: at most one of SLICES.
    """
    rows = narrow.withColumn("slice", F.expr(f"at.order * {SLICES} div {PRIME}"))
    sums = rows.groupBy(*keys, "slice", "left").agg(F.sum("at.n").alias("tokens"))
    so_far = Window.partitionBy(*keys).orderBy("slice").rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.withColumn("upto", F.sum("tokens").over(so_far)).withColumn("before", F.col("upto") - F.col("tokens"))
    last = sums.where((F.col("before") < F.col("left")) & (F.col("left") <= F.col("upto"))).select(*keys, "slice", "before")
    inside = rows.join(last, [*keys, "slice"]).groupBy(*keys, "left", "before", "at").agg(F.count("*").alias("tied"))
    alike = F.col("at.n") * F.col("tied")
    upto = F.sum(alike).over(Window.partitionBy(*keys).orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    inside = inside.withColumn("from", F.col("before") + upto - alike).where(F.col("from") < F.col("left"))
    inside = inside.groupBy(*keys).agg(F.max(F.struct("at", "tied", "from", "left")).alias("m"))
    need = F.when(F.col("m.at.n") > 0, F.ceil((F.col("m.left") - F.col("m.from")) / F.col("m.at.n"))).otherwise(F.col("m.tied"))
    return inside.select(
        *keys, F.col("m.at").alias("_tf_border"), F.least(need, F.col("m.tied")).cast("long").alias("_tf_taken"),
        F.col("m.tied").alias("_tf_tied"),
    )


def mix_documents(docs: DataFrame, target: Target, budget: int | None = None, seed: int = 1) -> DataFrame:
    """doc_id, source, n_tokens, copies and weight of every row of docs (doc_id, text, source).

    As mix(); repeated rows are drawn alike, or one after the other within the block where a budget ends.
    An empty table gives an empty result; extra columns are ignored.
    """
    of = n_tokens(F.col("text")).alias("n_tokens")
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", of, _dealt_by().alias("_tf_key"))
    found = mix(materialise(narrow, "tokens"), target, budget, seed, counted=True)
    return found.select("doc_id", "source", "n_tokens", "copies", F.round("weight", 9).alias("weight"))


def draw(docs: DataFrame, target: Target, budget: int | None = None, seed: int = 1) -> DataFrame:
    """Rows of docs (doc_id, text, source, ...), each as often as it is drawn, with docs' own columns."""
    mixed = mix(docs, target, budget, seed, prefix="_tf_")
    again = F.expr("explode(if(_tf_copies > 0, sequence(1L, _tf_copies), array()))")
    return mixed.withColumn("_tf_copy", again).select(*quoted(docs))
