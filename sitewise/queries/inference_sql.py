"""SQL for the tests that are chosen by the data, with p-values by numerical integration of the densities.

Densities are integrated by Simpson's rule over 2,000 steps, which is right to about ten digits; queries
round to six. Normality of groups of at most 50 values (Shapiro-Wilk) has no SQL: there such a group does
not count as normal, which matters only where all other groups of the pair look normal.
"""

from __future__ import annotations

from sitewise.operators.descriptive import pair_cells

STEPS = 2000


def simpson(density: str, upper: str) -> str:
    """The integral of a density in x from 0 to ``upper``."""
    weight = f"CASE WHEN i = 0 OR i = {STEPS} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    return f"(({upper}) / {3 * STEPS} * list_sum([{weight} * ({density.replace('x', f'(({upper}) * i / {STEPS}.0)')}) FOR i IN range(0, {STEPS + 1})]))"


def normal_upper(z: str) -> str:
    return f"greatest(0.5 - {simpson('0.3989422804014327 * power(2.718281828459045, -(x) * (x) / 2)', f'least({z}, 30)')}, 0)"


def t_two_sided(t: str, df: str) -> str:
    front = f"power(2.718281828459045, lgamma((({df}) + 1) / 2.0) - lgamma(({df}) / 2.0)) / sqrt(({df}) * 3.141592653589793)"
    return f"greatest(1 - 2 * {front} * {simpson(f'power(1 + (x) * (x) / ({df}), -(({df}) + 1) / 2.0)', f'least(abs({t}), 60)')}, 0)"


def chi2_upper(c: str, k: str) -> str:
    front = f"2 / (power(2.0, ({k}) / 2.0) * gamma(({k}) / 2.0))"
    return f"greatest(1 - {front} * {simpson(f'power(x, ({k}) - 1) * power(2.718281828459045, -(x) * (x) / 2)', f'least(sqrt({c}), 60)')}, 0)"


def f_upper(f: str, a: str, b: str) -> str:
    front = f"2 * power(2.718281828459045, lgamma((({a}) + ({b})) / 2.0) - lgamma(({a}) / 2.0) - lgamma(({b}) / 2.0)) * power(({a}) * 1.0 / ({b}), ({a}) / 2.0)"
    return f"greatest(1 - {front} * {simpson(f'power(x, ({a}) - 1) * power(1 + ({a}) * (x) * (x) / ({b}), -(({a}) + ({b})) / 2.0)', f'least(sqrt({f}), 60)')}, 0)"


# m: var1, var2, grp, value
GROUPS = """rk AS (SELECT *, rank() OVER (PARTITION BY var1, var2 ORDER BY value) + (count(*) OVER (PARTITION BY var1, var2, value) - 1) / 2.0 AS r FROM m),
md AS (SELECT var1, var2, grp, count(*) AS n, avg(value) AS mean, median(value) AS med, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM m GROUP BY ALL),
gm AS (SELECT var1, var2, grp, any_value(n) AS n, any_value(mean) AS mean, sum((value - mean) ** 2) AS m2, sum((value - mean) ** 3) AS m3, sum((value - mean) ** 4) AS m4, sum(r) AS rs, sum(abs(value - med)) AS dev, sum((value - med) ** 2) AS dev2,
 count(*) FILTER (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS far FROM rk JOIN md USING (var1, var2, grp) GROUP BY var1, var2, grp),
sh AS (SELECT *, CASE WHEN n > 1 THEN m2 / (n - 1) END AS v, CASE WHEN n < 3 THEN NULL WHEN m2 <= 0 THEN 0 ELSE m3 / n / power(m2 / n, 1.5) * sqrt(n * (n - 1.0)) / (n - 2) END AS skew, CASE WHEN n < 4 THEN NULL WHEN m2 <= 0 THEN 0 ELSE (n - 1.0) / ((n - 2.0) * (n - 3)) * ((n + 1) * (m4 / n / power(m2 / n, 2) - 3) + 6) END AS kurt FROM gm),
rl AS (SELECT var1, var2, count(*) AS k, CAST(sum(n) AS DOUBLE) AS nn, coalesce(bool_or(n >= 3 AND (coalesce(abs(skew) > 2, FALSE) OR coalesce(abs(kurt) > 4, FALSE) OR far > 0)), FALSE) AND NOT (bool_and(n > 50 AND coalesce(abs(skew) < 1 AND abs(kurt) < 2, FALSE)) AND min(n) >= 30) AS by_ranks,
 sum(dev) / sum(n) AS dm FROM sh GROUP BY ALL),
bf AS (SELECT sh.var1, sh.var2, any_value(k) AS k, any_value(nn) AS nn, sum(n * (dev / n - dm) ** 2) / (any_value(k) - 1) / (sum(dev2 - dev ** 2 / n) / (any_value(nn) - any_value(k))) AS f FROM sh JOIN rl USING (var1, var2) GROUP BY sh.var1, sh.var2),
ti AS (SELECT var1, var2, sum(t ** 3 - t) AS ties FROM (SELECT var1, var2, value, CAST(count(*) AS DOUBLE) AS t FROM m GROUP BY ALL) GROUP BY ALL)"""

_Z = "(greatest(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / sqrt(n1 * n2 / 12 * ((n1 + n2 + 1) - ties / ((n1 + n2) * (n1 + n2 - 1))))"


def two_groups(forced: str | None = None) -> str:
    """CTEs from m to tt: the test of every pair with two groups."""
    method = f"'{forced}'" if forced else "CASE WHEN by_ranks THEN 'mannwhitney' WHEN bf_p > 0.05 THEN 'student_ttest' ELSE 'welch_ttest' END"
    return f"""{GROUPS},
od AS (SELECT *, row_number() OVER (PARTITION BY var1, var2 ORDER BY grp) AS o FROM sh),
pr AS (SELECT a.var1, a.var2, CAST(a.n AS DOUBLE) AS n1, CAST(b.n AS DOUBLE) AS n2, a.mean AS m1, b.mean AS m2, a.v AS v1, b.v AS v2, a.rs - a.n * (a.n + 1) / 2.0 AS u, sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2)) AS sp FROM od a JOIN od b ON a.var1 = b.var1 AND a.var2 = b.var2 AND a.o = 1 AND b.o = 2),
bp AS (SELECT var1, var2, {f_upper("f", "k - 1", "nn - k")} AS bf_p FROM bf),
ch AS (SELECT pr.*, ties, by_ranks, {method} AS test FROM pr JOIN rl USING (var1, var2) JOIN bp USING (var1, var2) JOIN ti USING (var1, var2) WHERE k = 2),
st AS (SELECT *, CASE test WHEN 'mannwhitney' THEN u WHEN 'student_ttest' THEN (m1 - m2) / (sp * sqrt(1 / n1 + 1 / n2)) ELSE (m1 - m2) / sqrt(v1 / n1 + v2 / n2) END AS statistic,
 CASE test WHEN 'student_ttest' THEN n1 + n2 - 2 ELSE (v1 / n1 + v2 / n2) ** 2 / ((v1 / n1) ** 2 / (n1 - 1) + (v2 / n2) ** 2 / (n2 - 1)) END AS df FROM ch),
tt AS (SELECT var1, var2, test, by_ranks, statistic, CASE WHEN test = 'mannwhitney' THEN least(1, 2 * {normal_upper(_Z)}) ELSE {t_two_sided("statistic", "df")} END AS p_value,
 CASE WHEN test = 'mannwhitney' THEN 1 - 2 * u / (n1 * n2) ELSE (m1 - m2) / sp * (1 - 3.0 / (4 * (n1 + n2) - 9)) END AS effect_size, CASE WHEN test = 'mannwhitney' THEN 'rank_biserial' ELSE 'hedges_g' END AS effect_size_metric FROM st)"""


def one_way() -> str:
    """CTEs from m to ow: Kruskal-Wallis or Welch's test of every pair."""
    return f"""{GROUPS},
ww AS (SELECT var1, var2, sum(n / v) AS sw, sum(n / v * mean) / sum(n / v) AS mw, bool_and(coalesce(v > 0, FALSE)) AS ok FROM sh GROUP BY ALL),
hh AS (SELECT sh.var1, sh.var2, any_value(k) AS k, (12 / (any_value(nn) * (any_value(nn) + 1)) * sum(rs ** 2 / n) - 3 * (any_value(nn) + 1)) / (1 - any_value(ties) / (any_value(nn) ** 3 - any_value(nn))) AS h, any_value(by_ranks) AS by_ranks,
 sum(n / v * (mean - mw) ** 2) AS a, sum((1 - n / v / sw) ** 2 / (n - 1)) AS l, any_value(ok) AS ok FROM sh JOIN rl USING (var1, var2) JOIN ww USING (var1, var2) JOIN ti USING (var1, var2) GROUP BY sh.var1, sh.var2),
hf AS (SELECT *, CASE WHEN ok THEN a / (k - 1) / (1 + 2 * (k - 2) * l / (k * k - 1)) END AS f, CASE WHEN ok THEN (k * k - 1) / (3 * l) END AS d2 FROM hh WHERE k >= 2),
ow AS (SELECT var1, var2, CASE WHEN by_ranks THEN 'kruskal' ELSE 'welch' END AS test, CASE WHEN by_ranks THEN h ELSE f END AS statistic, CASE WHEN by_ranks THEN {chi2_upper("h", "k - 1")} ELSE {f_upper("f", "k - 1", "d2")} END AS p_value FROM hf)"""


def associations(cells: str) -> str:
    """CTEs from x (var1, var2, a, b) to ta."""
    return f"""{cells}, ra AS (SELECT var1, var2, a, count(*) AS ra FROM x GROUP BY ALL), cb AS (SELECT var1, var2, b, count(*) AS cb FROM x GROUP BY ALL), oo AS (SELECT var1, var2, a, b, count(*) AS o FROM x GROUP BY ALL),
dm2 AS (SELECT var1, var2, r, n, c FROM (SELECT var1, var2, count(*) AS r, sum(ra) AS n FROM ra GROUP BY ALL) JOIN (SELECT var1, var2, count(*) AS c FROM cb GROUP BY ALL) USING (var1, var2)),
fx AS (SELECT ra.var1, ra.var2, r, c, n, CAST(ra AS DOUBLE) * cb / n AS e, coalesce(o, 0) AS o FROM ra JOIN cb USING (var1, var2) JOIN dm2 USING (var1, var2) LEFT JOIN oo ON oo.var1 = ra.var1 AND oo.var2 = ra.var2 AND oo.a = ra.a AND oo.b = cb.b),
fy AS (SELECT *, abs(o - e) - CASE WHEN r = 2 AND c = 2 THEN least(0.5, abs(o - e)) ELSE 0 END AS g FROM fx),
fz AS (SELECT var1, var2, any_value(r) AS r, any_value(c) AS c, sum(g ** 2 / e) AS chi2, (any_value(r) - 1) * (any_value(c) - 1) AS dof, sqrt(sum((o - e) ** 2 / e) / (any_value(n) * (least(any_value(r), any_value(c)) - 1))) AS cramers_v FROM fy GROUP BY var1, var2),
ta AS (SELECT var1, var2, r, c, 'Chi-Square Test' AS test, chi2 AS statistic, {chi2_upper("chi2", "dof")} AS p_value, cramers_v AS effect_size, 'cramers_v' AS effect_size_metric FROM fz)"""


def correlations(columns: list[str], source: str) -> str:
    """CTE tc: the correlation every pair of columns of ``source`` calls for."""
    one = []
    for a, b in pair_cells(columns):
        far = lambda c: f"bool_or({c} < q{c}1 - 1.5 * (q{c}3 - q{c}1) OR {c} > q{c}3 + 1.5 * (q{c}3 - q{c}1))"
        skew = lambda c: f"coalesce((sum(({c} - m{c}) ** 3) / count(*)) / nullif(power(sum(({c} - m{c}) ** 2) / count(*), 1.5), 0), 0)"
        one.append(f"""SELECT '{a}' AS var1, '{b}' AS var2, count(*) AS n, corr(x, y) AS pearson, corr(rx, ry) AS spearman, count(*) >= 30 AND abs({skew("x")}) < 2 AND abs({skew("y")}) < 2 AND NOT ({far("x")} OR {far("y")}) AS plain FROM
(SELECT x, y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry, avg(x) OVER () AS mx, avg(y) OVER () AS my, quantile_cont(x, 0.25) OVER () AS qx1, quantile_cont(x, 0.75) OVER () AS qx3, quantile_cont(y, 0.25) OVER () AS qy1, quantile_cont(y, 0.75) OVER () AS qy3
 FROM (SELECT {a} AS x, {b} AS y FROM {source} WHERE {a} IS NOT NULL AND {b} IS NOT NULL))""")
    return "tc0 AS (" + " UNION ALL ".join(one) + f"""),
tc1 AS (SELECT var1, var2, n, CASE WHEN plain THEN 'pearson' ELSE 'spearman' END AS test, CASE WHEN plain THEN pearson ELSE spearman END AS c FROM tc0 WHERE n >= 3),
tc AS (SELECT var1, var2, test, c AS statistic, {t_two_sided("c * sqrt((n - 2) / (1 - c * c))", "n - 2")} AS p_value, abs(c) AS effect_size, 'correlation' AS effect_size_metric FROM tc1)"""
