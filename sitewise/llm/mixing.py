"""Mixing sources to target weights by Poisson replication.

Every document gets a uniform number from a hash of its id and the seed, and its number of copies is the
Poisson quantile of that number at its source's rate, at most ``max_repeats``. More rate never means
fewer copies, so the rate of a source is set by bisection on the tokens its documents would give: each
pass counts, for a grid of rates between the bounds of each source, the tokens they would give, over the
documents whose number of copies still depends on where between the bounds the rate lies. Passes go on
until the bounds differ by no more than the longest document of the source. A source whose documents do
not reach the target at ``max_repeats`` gives all it has.

The targets stay a table, however many sources it names: thresholds of the quantile are made once per
source and rate, and reach the documents by a join (a broadcast while they are small in bytes). Copies are
exploded and ordered globally by a hash of document and copy, range-partitioned, so no task sees a whole
source.

Defined results: sources without a target (null included) give nothing; targets without documents, or
with a share of null, NaN or below 0, get nothing and are reported; null and empty documents have no
tokens, and their copies follow the same rule; repeated ids get equal numbers and so equal copies, and a
source may then end further than one document from its target (outcome ``nearest``); max_repeats below 1
or null means no use; a source named twice keeps its largest share; an empty corpus gives a report with zeros.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewise.session import broadcast_if_small, cut_lineage

SEED = 20
GRID = 32
BROADCAST_VALUES = 4_000_000  # thresholds (8 bytes each) that may be broadcast at once


def uniform(key: Column, seed: int) -> Column:
    """A number in (0, 1) from a hash of the key."""
    return (F.pmod(F.shiftrightunsigned(F.xxhash64(key, F.lit(seed)), 11), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)


def thresholds(rate: str, most: str) -> str:
    """SQL: P(X <= k) of a Poisson number for k from 0 to most - 1, summed in logarithms so that no rate underflows."""
    start = f"struct(cast(array() as array<double>) as a, -{rate} as t, 0d as s)"
    step = f"(x, k) -> struct(concat(x.a, array(x.s + exp(x.t))) as a, x.t + ln({rate} / (k + 1)) as t, x.s + exp(x.t) as s)"
    return f"case when {rate} > 0 then aggregate(sequence(0, {most} - 1), {start}, {step}, x -> x.a) else array_repeat(1d, {most}) end"


def copies(u: str, at: str) -> str:
    """SQL: the Poisson quantile of u by its thresholds: how many of them lie below u."""
    return f"size(filter({at}, x -> x < {u}))"


def read_targets(targets: DataFrame) -> DataFrame:
    """source, share (0 if it is no number above 0) and most of every named source."""
    share = "case when target_share > 0 and target_share < double('infinity') then target_share else 0d end"
    return targets.where("source is not null").selectExpr("source", f"struct({share} as share, greatest(coalesce(max_repeats, 0), 0) as most) as t").groupBy("source").agg(F.max("t").alias("t")).select("source", "t.*")


def _near(state: DataFrame, per_row: int) -> DataFrame:
    """``state`` to be joined to documents: broadcast if its thresholds are few."""
    most = state.agg(F.max("most")).first()[0] or 1
    return broadcast_if_small(state, max(BROADCAST_VALUES // (per_row * most), 1))


def solve(sized: DataFrame, targets: DataFrame) -> tuple[DataFrame, int]:
    """The targets with the rate of each (null: gives nothing; infinite: all it has) and the tokens of all documents.

    ``sized`` has source, u, n_tokens.
    """
    per = cut_lineage(sized.groupBy("source").agg(F.count("*").alias("n_documents"), F.sum("n_tokens").alias("source_tokens"), F.max("n_tokens").alias("longest")))
    total = per.agg(F.sum("source_tokens")).first()[0] or 0
    known = targets.join(per, "source", "left").na.fill(0, ["n_documents", "source_tokens", "longest"]).withColumn("goal", F.expr(f"share * {float(total)!r}d"))
    usable = "goal > 0 and source_tokens > 0 and most > 0"
    kind = f"case when not ({usable}) then 'none' when goal >= source_tokens * most then 'all' else 'open' end"
    # at the upper bound no uniform number is left below the last threshold
    state = cut_lineage(known.selectExpr("*", f"{kind} as kind", "0d as low", "most + 10 * sqrt(most) + 50 as high", "0L as under", "source_tokens * most as over"))
    while True:
        active = state.where("kind = 'open' and over - under > longest and high - low > high * 1e-13")
        if active.isEmpty():
            break
        state = cut_lineage(_pass(sized, state, active))
    rate = "case kind when 'all' then double('infinity') when 'open' then case when goal - under <= over - goal then low else high end end"
    return state.selectExpr("source", "share", "most", "n_documents", "source_tokens", "longest", "goal", f"{rate} as rate"), total


def _pass(sized: DataFrame, state: DataFrame, active: DataFrame) -> DataFrame:
    """Narrower bounds of every source in ``active``."""
    rates = f"transform(sequence(1, {GRID}), i -> low + (high - low) * i / {GRID + 1})"
    grid = active.select("source", "low", "high", "most", F.expr(f"{rates} as rates"))
    grid = grid.selectExpr("source", "most", f"{thresholds('low', 'most')} as at_low", f"{thresholds('high', 'most')} as at_high", f"transform(rates, rate -> struct(rate, {thresholds('rate', 'most')} as at)) as grid")
    x = sized.where("n_tokens > 0").select("source", "u", "n_tokens").join(_near(grid, GRID + 2), "source")
    x = x.selectExpr("source", "u", "n_tokens", "grid", f"{copies('u', 'at_low')} as least", f"{copies('u', 'at_high')} as top").where("top > least")
    x = x.selectExpr("source", "u", "n_tokens", "least", "inline(grid)")
    more = x.groupBy("source", "rate").agg(F.expr(f"sum(({copies('u', 'at')} - least) * n_tokens) as more"))
    seen = active.select("source", "goal", "under", F.expr(f"explode({rates}) as rate")).join(more, ["source", "rate"], "left").selectExpr("source", "goal", "rate", "under + coalesce(more, 0) as given")
    new = seen.groupBy("source").agg(*[F.expr(f"{f}(case when given {op} goal then {c} end) as {a}") for f, op, c, a in (("max", "<", "rate", "l"), ("max", "<", "given", "g"), ("min", ">=", "rate", "h"), ("min", ">=", "given", "o"))])
    kept = [c for c in state.columns if c not in ("low", "high", "under", "over")]
    return state.join(new, "source", "left").selectExpr(*kept, "coalesce(l, low) as low", "coalesce(h, high) as high", "coalesce(g, under) as under", "coalesce(o, over) as over")


def with_copies(sized: DataFrame, solved: DataFrame) -> DataFrame:
    """All documents with n_copies."""
    used = solved.where("rate > 0").selectExpr("source", "most", "rate", f"case when rate < double('infinity') then {thresholds('rate', 'most')} end as at")
    x = sized.join(_near(used.withColumnsRenamed({"rate": "_rate", "at": "_at", "most": "_most"}).withColumn("most", F.col("_most")), 1).drop("most"), "source", "left")
    return x.withColumn("n_copies", F.expr(f"case when _rate is null then 0 when _at is null then _most else {copies('u', '_at')} end")).drop("_rate", "_at", "_most")


def shuffled(mixed: DataFrame, key: str, seed: int) -> DataFrame:
    """One row per copy in global random order: position key, the document's key, copy_no, and the rest."""
    rows = mixed.where("n_copies > 0").withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("n_copies"))))
    return rows.withColumn("order_key", F.xxhash64(key, "copy_no", F.lit(seed + 1))).orderBy("order_key", key, "copy_no")


def report(mixed: DataFrame, solved: DataFrame, total: int) -> DataFrame:
    """Per target source: what it was to give and what it gives; ``met`` by the tokens really given."""
    given = mixed.where("n_copies > 0").groupBy("source").agg(F.count("*").alias("n_used"), F.sum("n_copies").alias("n_copies"), F.max("n_copies").alias("most_copies"), F.sum(F.col("n_copies") * F.col("n_tokens")).alias("mixed_tokens"))
    both = solved.join(given, "source", "left").na.fill(0, ["n_used", "n_copies", "most_copies", "mixed_tokens"])
    outcome = "case when source_tokens = 0 then 'no documents' when goal <= 0 or most = 0 then 'no target' when goal > source_tokens * most then 'too few documents' when abs(mixed_tokens - goal) <= longest then 'met' else 'nearest' end"
    share = f"round(coalesce(try_divide(mixed_tokens, {float(total)!r}d), 0d), 6)"
    return both.selectExpr("source", "share as target_share", "most as max_repeats", "n_documents", "source_tokens", "goal as target_tokens", f"{outcome} as outcome", "n_used", "n_copies", "most_copies", "mixed_tokens", f"{share} as actual_share")
