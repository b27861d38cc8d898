"""Filling missing values from comparable records, with masks of what was filled.

Numbers follow a mixed model: overall mean + group effect + time effect + member effect + rest, the
effects shrunk by n / (n + rest variance / effect variance) with variances from the method of moments.
Categories follow a multinomial model with group and time effects, p(c | g, t) ~ share(c) * u(c, g) * v(c, t),
fitted by proportional scaling: each round moves the expected counts of every group, then of every period,
to the observed ones, each shrunk towards no effect. How much is shrunk is estimated from the data too,
by the overdispersion of the counts of groups, periods and members against what is expected of them
(moments of a Dirichlet-multinomial). A member's own records update the prediction as counts on top of
that prior. The most likely category is filled in, the smaller code on ties.

Passes: one aggregation by group and period (a small table from which all group and time effects come),
one by member (combined before the shuffle, so a member with a third of all rows is one row per task),
and one join of the records that have gaps with their member's sums; complete records are not moved.

Defined results: null and NaN, and any value outside the domain, is a gap; null group, time or member is
a level of its own without effect of its own for the member (null members share nothing); a field without
a single valid value stays null and its mask is still set; empty input gives empty output; repeated
records count as often as they occur; columns named like a mask are replaced; names beginning with two
underscores are kept for this operator. A category in a text column is compared as text (trimmed, exact
words); in a number column by value, where words of its domain play no part.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewise.session import broadcast_if_small, cut_lineage

ROUNDS = 3  # of scaling; with two factors the fit moves by less than a thousandth after the second
LEAST_WEIGHT = 0.001
MASK = "__filled"


def _number(c: str) -> Column:
    v = F.col(f"`{c}`").try_cast("double")
    return F.when(~F.isnan(v), v)


class Domains:
    """The domains of the fields to fill, from the fixed field_domains table."""

    def __init__(self, domains: DataFrame, dataset: str, fields: list[str]):
        rows = {r.column_name: r for r in domains.where((F.col("dataset") == dataset) & F.col("column_name").isin(fields)).collect()}
        self.codes: dict[str, list] = {}
        self.ranges: dict[str, tuple[float, float]] = {}
        self._words: dict[str, list[str]] = {}
        for f in fields:
            r = rows[f]
            if r.kind == "category":
                self._words[f] = sorted(set(r.allowed_values.split("|")))
                self.codes[f] = sorted(float(x) for x in self._words[f] if x.replace(".", "", 1).lstrip("+-").isdigit())
            else:
                self.ranges[f] = tuple(x if x is not None and not math.isnan(x) else y for x, y in ((r.min_value, -math.inf), (r.max_value, math.inf)))

    def typed(self, df: DataFrame) -> Domains:
        """These domains for the columns of ``df``: categories in text columns go by their words."""
        out = object.__new__(Domains)
        kinds = dict(df.dtypes)
        out.ranges, out._words = self.ranges, self._words
        out.codes = {f: self._words[f] if kinds[f] == "string" else codes for f, codes in self.codes.items()}
        return out

    def valid(self, f: str) -> Column:
        """The field's value if it is in its domain, else null."""
        if f in self.codes:
            v = F.trim(F.col(f"`{f}`")) if any(isinstance(c, str) for c in self.codes[f]) else _number(f)
            return F.when(v.isin(*self.codes[f]), v)
        v = _number(f)
        return F.when(v.between(*self.ranges[f]), v)

    @property
    def fields(self) -> list[str]:
        return [*self.codes, *self.ranges]


def _literal(c) -> str:
    return "'" + c.replace("\\", "\\\\").replace("'", "\\'") + "'" if isinstance(c, str) else f"{c!r}d"


def _counts(d: Domains) -> list[str]:
    return [f"count_if(`__v_{f}` = {_literal(c)}) as `__{f}_{i}`" for f, codes in d.codes.items() for i, c in enumerate(codes)]


def _moments(f: str, value: str) -> list[str]:
    return [f"count({value}) as `__{f}_n`", f"sum({value}) as `__{f}_s`", f"sum({value} * {value}) as `__{f}_ss`"]


def _weight(x: float | None, slack: float | None, degrees: float) -> float | None:
    """Prior records that a level's counts are worth, from their overdispersion; None: the levels do not differ.

    x: sum of squared deviations over expected counts; slack: its value without overdispersion per degree
    of freedom; degrees: records beyond the first of each level.
    """
    if not slack or degrees <= 0 or x is None:
        return None
    rho = (x - slack) / degrees
    return None if rho <= 0 else max((1 - rho) / rho, LEAST_WEIGHT)


def _total(f: str, levels: int, tag: str = "") -> str:
    return "(" + " + ".join(f"`__{f}_{tag}{i}`" for i in range(levels)) + ")"


def _level_weights(cells: DataFrame, by: str, shares: dict[str, list[float]], means: dict[str, tuple[float, float]]) -> dict[str, float | None]:
    """For the levels of one factor: the weight of each category's prior, and of each number rest variance / effect variance.

    None: the levels do not differ beyond chance. One job for all fields.
    """
    names = [f"__{f}_{i}" for f, s in shares.items() for i in range(len(s))] + [f"__{f}_{x}" for f in means for x in ("n", "s")]
    per = cells.groupBy(by).agg(*[F.expr(f"cast(sum(`{c}`) as double) as `{c}`") for c in names])
    aggs = []
    for k, (f, s) in enumerate(shares.items()):
        n = _total(f, len(s))
        off = " + ".join(f"power(`__{f}_{i}` - {n} * {p!r}d, 2) / ({n} * {p!r}d)" for i, p in enumerate(s) if p > 0)
        aggs += [f"sum(case when {n} > 0 then {off} end) as x{k}", f"count_if({n} > 0) as k{k}", f"sum({n}) as n{k}", f"sum({n} * {n}) as q{k}"]
    for k, (f, (mean, _)) in enumerate(means.items()):
        n = f"`__{f}_n`"
        aggs += [f"avg(case when {n} > 0 then power(`__{f}_s` / {n} - {mean!r}d, 2) end) as b{k}", f"avg(case when {n} > 0 then 1 / {n} end) as i{k}"]
    r = per.selectExpr(*aggs).first()
    out: dict[str, float | None] = {}
    for k, (f, s) in enumerate(shares.items()):
        n, levels = r[f"n{k}"], sum(p > 0 for p in s)
        out[f] = _weight(r[f"x{k}"] / (levels - 1), r[f"k{k}"] - 1, n - r[f"k{k}"] - r[f"q{k}"] / n + 1) if n and levels > 1 else None
    for k, (f, (_, rest)) in enumerate(means.items()):
        spread = (r[f"b{k}"] or 0.0) - rest * (r[f"i{k}"] or 0.0)  # variance of the level means beyond what the rest explains
        out[f] = rest / spread if spread > 0 else None
    return out


def _baselines(cells: DataFrame, d: Domains) -> DataFrame:
    """Per group and period: __base_<number>, and __prior_<category> (array of shares); g and t null-free.

    Windows, not joins: the plan stays one line, and a window holds the periods of a group or the groups
    of a period, narrow rows of sums.
    """
    within = [f"sum(case when `__{f}_n` > 0 then `__{f}_ss` - `__{f}_s` * `__{f}_s` / `__{f}_n` end) as `__{f}_within`" for f in d.ranges]
    used = [f"count_if(`__{f}_n` > 0) as `__{f}_cells`" for f in d.ranges]
    sums = cells.selectExpr(*[f"sum(`{c}`) as `{c}`" for c in cells.columns if c not in ("g", "t")], *within, *used).first().asDict()
    means, shares = {}, {}
    for f in d.ranges:
        n = sums[f"__{f}_n"] or 0
        if n:
            means[f] = (sums[f"__{f}_s"] / n, max(sums[f"__{f}_within"], 0.0) / max(n - sums[f"__{f}_cells"], 1))
    for f, codes in d.codes.items():
        n = sum(sums[f"__{f}_{i}"] or 0 for i in range(len(codes)))
        if n:
            shares[f] = [(sums[f"__{f}_{i}"] or 0) / n for i in range(len(codes))]
    weights = {by: _level_weights(cells, by, shares, means) for by in ("g", "t")} if shares or means else {}

    spots = [(f, i, p) for f, s in shares.items() for i, p in enumerate(s)]
    start = [f"cast({_total(f, len(s))} as double) as `__{f}_n`" for f, s in shares.items()] + [f"{p!r}d as `__{f}_p{i}`" for f, i, p in spots]
    start += [f"sum(`__{f}_{i}`) over (partition by {by}) as `__{f}_{by}{i}`" for by in weights for f, i, _ in spots]
    start += [x for f, (mean, _) in means.items() for x in (f"`__{f}_n`", f"`__{f}_s` - `__{f}_n` * {mean!r}d as `__{f}_d`", f"0d as `__{f}_ug`", f"0d as `__{f}_ut`")]
    start += [f"sum(`__{f}_n`) over (partition by {by}) as `__{f}_n{by}`" for by in weights for f in means]
    x = cells.selectExpr("g", "t", *start)
    still = [c for c in x.columns if not any(c == f"__{f}_p{i}" for f, i, _ in spots) and not any(c in (f"__{f}_ug", f"__{f}_ut") for f in means)]
    kept = [f"`{c}`" for c in still]
    for _ in range(ROUNDS):
        for by, w in weights.items():
            other = "t" if by == "g" else "g"
            seen = [f"sum(`__{f}_n` * `__{f}_p{i}`) over (partition by {by}) as `__{f}_e{i}`" for f, i, _ in spots if w[f] is not None]
            seen += [f"sum(`__{f}_d` - `__{f}_n` * `__{f}_u{other}`) over (partition by {by}) as `__{f}_o`" for f in means if w[f] is not None]
            x = x.selectExpr("*", *seen)
            scaled = [f"`__{f}_p{i}` * (`__{f}_{by}{i}` + {w[f]!r}d * {p!r}d) / (`__{f}_e{i}` + {w[f]!r}d * {p!r}d) as `__{f}_p{i}`" if w[f] is not None and p > 0 else f"`__{f}_p{i}`" for f, i, p in spots]
            effects = [y for f in means for y in (f"`__{f}_u{other}`", f"`__{f}_o` / (`__{f}_n{by}` + {w[f]!r}d) as `__{f}_u{by}`" if w[f] is not None else f"`__{f}_u{by}`")]
            x = x.selectExpr(*kept, *scaled, *effects)
            x = x.selectExpr(*kept, *[f"`__{f}_p{i}` / {_total(f, len(shares[f]), 'p')} as `__{f}_p{i}`" for f, i, _ in spots], *[f"`__{f}_u{y}`" for f in means for y in "gt"])
    base = [f"{means[f][0]!r}d + `__{f}_ug` + `__{f}_ut` as `__base_{f}`" if f in means else f"cast(null as double) as `__base_{f}`" for f in d.ranges]
    prior = ["array(" + ", ".join(f"`__{f}_p{i}`" for i in range(len(codes))) + f") as `__prior_{f}`" if f in shares else f"cast(null as array<double>) as `__prior_{f}`" for f, codes in d.codes.items()]
    return x.selectExpr("g as __g", "t as __t", *base, *prior)


def _member_weights(members: DataFrame, d: Domains) -> dict[str, float | None]:
    """The weight of the group and time prediction against a member's own records, per field; None: members do not differ."""
    aggs = []
    for k, (f, codes) in enumerate(d.codes.items()):
        n = _total(f, len(codes))
        off = " + ".join(f"coalesce(try_divide(power(`__{f}_{i}` - `__{f}_e{i}`, 2), `__{f}_e{i}`), 0d)" for i in range(len(codes)))
        aggs += [f"sum({off}) as x{k}", f"count_if({n} > 0) as k{k}", f"cast(sum({n}) as double) as n{k}", *[f"max(`__{f}_{i}` > 0) as h{k}_{i}" for i in range(len(codes))]]
    for k, f in enumerate(d.ranges):
        n, s, ss = f"`__{f}_n`", f"`__{f}_s`", f"`__{f}_ss`"
        aggs += [f"sum({n}) as rn{k}", f"count_if({n} > 0) as rm{k}", f"sum({s}) as rs{k}", f"sum(case when {n} > 0 then {ss} - {s} * {s} / {n} end) as rw{k}", f"sum(case when {n} > 0 then {s} * {s} / {n} end) as rb{k}", f"sum({n} * {n}) as rq{k}"]
    r = members.selectExpr(*aggs).first()
    out: dict[str, float | None] = {}
    for k, (f, codes) in enumerate(d.codes.items()):
        levels = sum(bool(r[f"h{k}_{i}"]) for i in range(len(codes)))
        out[f] = _weight(r[f"x{k}"] / (levels - 1), r[f"k{k}"], r[f"n{k}"] - r[f"k{k}"]) if levels > 1 else None
    for k, f in enumerate(d.ranges):
        n, m = r[f"rn{k}"] or 0, r[f"rm{k}"] or 0
        out[f] = None
        if m > 1 and n > m:
            within = max(r[f"rw{k}"], 0.0) / (n - m)
            between = (r[f"rb{k}"] - r[f"rs{k}"] * r[f"rs{k}"] / n) / (m - 1)
            size = (n - r[f"rq{k}"] / n) / (m - 1)
            spread = (between - within) / size if size > 0 else 0.0
            out[f] = within / spread if spread > 0 else None
    return out


def fill_missing(df: DataFrame, d: Domains, record: str, group: str, member: str, time: str, only_gaps: bool = False) -> DataFrame:
    """All columns of ``df`` with the fields of ``d`` filled, and a mask <field>__filled for each.

    ``time`` is a date or timestamp column, used by month. ``only_gaps`` leaves complete records out.
    """
    d = d.typed(df)
    keyed = df.withColumns({"__g": F.expr(f"coalesce(cast(`{group}` as string), '')"), "__t": F.expr(f"coalesce(date_format(`{time}`, 'yyyy-MM'), '')"), "__m": F.col(f"`{member}`"), **{f"__v_{f}": d.valid(f) for f in d.fields}})
    any_gap = " or ".join(f"`__v_{f}` is null" for f in d.fields)
    cells = keyed.groupBy(F.col("__g").alias("g"), F.col("__t").alias("t")).agg(*[F.expr(x) for x in (*_counts(d), *[m for f in d.ranges for m in _moments(f, f"`__v_{f}`")])])
    cells = cut_lineage(cells.na.fill(0))
    base = broadcast_if_small(cut_lineage(_baselines(cells, d)))

    # members: counts of categories with what was expected of them, and number, sum and square sum of residuals
    known = keyed.where("__m is not null").join(base, ["__g", "__t"])
    expected = [f"sum(case when `__v_{f}` is not null then get(`__prior_{f}`, {i}) end) as `__{f}_e{i}`" for f, codes in d.codes.items() for i in range(len(codes))]
    members = known.groupBy("__m").agg(*[F.expr(x) for x in (*_counts(d), *expected, *[m for f in d.ranges for m in _moments(f, f"(`__v_{f}` - `__base_{f}`)")])])
    members = members.persist()
    weight = _member_weights(members, d)
    holes = keyed.where(any_gap).join(base, ["__g", "__t"], "left").join(members, "__m", "left")
    filled = {}
    for f, (low, high) in d.ranges.items():
        own = "0d" if weight[f] is None else f"coalesce(`__{f}_s` / (`__{f}_n` + {weight[f]!r}d), 0d)"
        lo, hi = (f"double('{x!r}')" for x in (low, high))
        filled[f] = f"case when `__base_{f}` is not null then least(greatest(`__base_{f}` + {own}, {lo}), {hi}) end"
    for f, codes in d.codes.items():
        own = (lambda i, f=f: f"coalesce(`__{f}_{i}`, 0) / {weight[f]!r}d + ") if weight[f] is not None else (lambda i: "")
        scored = ", ".join(f"struct(round({own(i)}get(`__prior_{f}`, {i}), 9) as w, {-i} as c)" for i in range(len(codes)))
        best = f"array_max(array({scored}))"  # the likeliest, the first of equal ones
        filled[f] = f"case when `__prior_{f}` is not null then get(array({', '.join(map(_literal, codes))}), -{best}.c) end"
    masks = {f + MASK for f in d.fields}
    plain = [c for c in df.columns if c not in masks]
    done = holes.selectExpr(*[f"coalesce(`__v_{c}`, {filled[c]}) as `{c}`" if c in filled else f"`{c}`" for c in plain], *[f"`__v_{f}` is null as `{f}{MASK}`" for f in d.fields])
    if only_gaps:
        return done
    whole = keyed.where(f"not ({any_gap})").selectExpr(*[f"`__v_{c}` as `{c}`" if c in filled else f"`{c}`" for c in plain], *[f"false as `{f}{MASK}`" for f in d.fields])
    return done.unionByName(whole)


def filled_fields(filled: DataFrame, record: str, fields: list[str]) -> DataFrame:
    """One row per gap, by the masks: record, field_name, value as text (null if nothing could be filled in)."""
    cells = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).cast("string").alias("value"), F.col(f + MASK).alias("hit")) for f in fields])
    return filled.select(record, F.explode(cells).alias("x")).where("x.hit").select(record, "x.field_name", "x.value")
