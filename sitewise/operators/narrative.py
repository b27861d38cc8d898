"""Sentences and warnings about result tables, as rows (level, text) or plain strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitewise.operators import descriptive as ds

SMALL_GROUP = 5


def group_sizes(shares: DataFrame) -> DataFrame:
    """Estimated size of every category group: share / 100 * number of values. Needs count and share columns."""
    return shares.withColumn("size", F.col("share") / 100 * F.col("count"))


def small_groups(sizes: DataFrame, threshold: int = SMALL_GROUP) -> DataFrame:
    return sizes.where(F.col("size") < threshold)


def small_group_warnings(sizes: DataFrame, threshold: int = SMALL_GROUP) -> DataFrame:
    """One warning per site and column, about its first flagged category (by label)."""
    first = F.row_number().over(Window.partitionBy(*ds.KEY).orderBy("value")) == 1
    text = F.format_string('"%s" holds a category ("%s") of about %.0f individuals, below the reporting threshold of ' + str(threshold) + ".", "column_name", "value", "size")
    return small_groups(sizes, threshold).withColumn("first", first).where("first").select(*ds.KEY, F.lit("warning").alias("level"), text.alias("text"))


def smallest_group(sizes: DataFrame) -> DataFrame:
    """The smallest group of each site; by column and label on ties."""
    g = sizes.groupBy("node_id").agg(F.min(F.struct("size", "column_name", "value")).alias("s"), F.count_if(F.col("size") < SMALL_GROUP).alias("n_flagged"))
    return g.select("node_id", F.col("s.size").alias("size"), F.col("s.column_name").alias("column_name"), F.col("s.value").alias("value"), "n_flagged")


def single_category_notice(categorical: DataFrame) -> DataFrame:
    """Sites whose columns show one category only, with the names."""
    g = categorical.where("number_of_categories <= 1").groupBy("node_id").agg(F.array_join(F.array_sort(F.collect_list("column_name")), ", ").alias("names"))
    return g.select("node_id", F.concat(F.lit("Only one category observed, no distribution shown: "), "names", F.lit(".")).alias("text"))


def names_notice(names: list[str], what: str) -> str | None:
    """A notice naming columns, none without names. ``what``: quasi_numeric, out_of_range_age or excluded."""
    if not names:
        return None
    listed = ", ".join(names)
    return {
        "quasi_numeric": f"Mostly numbers, but not entirely, so treated as categories: {listed}.",
        "out_of_range_age": f"{listed} age value(s) lie outside 0-100 years and are not in the age distribution.",
        "excluded": f"Entirely missing and left out of the projection: {listed}.",
    }[what]


def numeric_summary(compared: DataFrame) -> DataFrame:
    """Per site: how many numeric columns lie above and below the whole."""
    g = compared.groupBy("node_id").agg(F.count("*").alias("n"), F.count_if(F.col("vs_global") == "above_average").alias("a"), F.count_if(F.col("vs_global") == "below_average").alias("b"))
    return g.select("node_id", F.format_string("%d numeric variable(s), %d above and %d below the federated average (>10%% relative difference).", "n", "a", "b").alias("text"))


def categorical_summary(compared: DataFrame) -> DataFrame:
    g = compared.groupBy("node_id").agg(F.count("*").alias("n"), F.count_if(F.col("vs_global") == "above_average").alias("a"), F.count_if(F.col("vs_global") == "below_average").alias("b"))
    return g.select("node_id", F.format_string("%d categorical variable(s), %d with a more and %d with a less dominant top category than the federation.", "n", "a", "b").alias("text"))


def temporal_summary(profile: DataFrame) -> DataFrame:
    g = profile.groupBy("node_id").agg(F.count("*").alias("n"))
    return g.select("node_id", F.format_string("%d temporal variable(s).", "n").alias("text"))


def association_summary(significant: DataFrame, pair_type: str | None = None) -> str:
    """The number of significant pairs and the strongest one."""
    d = significant.where("significant")
    d = d if pair_type is None else d.where(F.col("pair_type") == pair_type)
    top = d.orderBy(F.abs("effect_size").desc(), "var1", "var2").first()
    if top is None:
        return "No significant associations."
    return f"{d.count()} significant association(s) (FDR-adjusted p < 0.05). Strongest: {top.var1} vs {top.var2} ({top.test}, {top.effect_size_metric} = {top.effect_size:.2f})."


def privacy_notice(local: bool, n_nodes: int | None, identifiers: list[str], smallest: tuple[float, str, str] | None = None, n_flagged: int = 0, n_columns: int = 0) -> list[str]:
    """The lines of the privacy block."""
    if local:
        lines = ["Made from this site's own data; no rows left the site."]
    else:
        lines = [f"Aggregates over {n_nodes or 'all'} sites only; no row of any patient is shared or shown.", "Means, deviations and counts are merged from summaries, trends fitted on counts by period."]
    lines.append(f"Identifier-like columns ({', '.join(identifiers)}) are left out." if identifiers else "Identifier columns are left out.")
    if local and smallest:
        lines.append(f'Smallest group shown: {smallest[0]:.0f} (category "{smallest[2]}" of "{smallest[1]}").')
    if local and n_flagged:
        lines.append(f"{n_flagged} of {n_columns} categorical breakdowns hold a group below k={SMALL_GROUP}.")
    if local and few_sites_caveat(n_nodes):
        lines.append(few_sites_caveat(n_nodes))
    return lines


def few_sites_caveat(n_nodes: int | None, threshold: int = 5) -> str | None:
    if n_nodes is None or n_nodes >= threshold:
        return None
    return f"With only {n_nodes} site(s), labels against the federation may reveal something about single other sites."


def overview_strings(contribution: DataFrame, overview: DataFrame) -> DataFrame:
    """Display strings of a site's overview."""
    pct: Column = lambda c, d: F.format_number(F.round(c, d), d)
    both = overview.join(contribution, "node_id")
    return both.select(
        "node_id", F.concat(F.col("n_rows").cast("string"), F.lit(" ("), pct(F.col("patient_contribution"), 3), F.lit("% of all patients)")).alias("patients"),
        F.concat(F.format_number("n_cells", 0), F.lit(" ("), pct(F.col("total_value_contribution") * 100, 2), F.lit("% of all values)")).alias("total_values"),
        F.concat(F.format_number("n_missing", 0), F.lit(" ("), pct(F.col("local_missing_rate") * 100, 2), F.lit("%)")).alias("missing_values"), F.col("missing_label").alias("missingness"),
    )
