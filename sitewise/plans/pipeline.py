"""The whole analysis: every site profiled, the summaries merged, results written.

``SiteAnalyzer`` is the part that runs where a site's rows are; only its summaries go on.
``FederationAggregator`` merges them. Both can be subclassed: override ``analyze`` or ``aggregate``.
A section that fails is reported and skipped, the others go on.
"""

from __future__ import annotations

import argparse
import json
import logging
import os
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewise.operators import column_typing as ct
from sitewise.operators import descriptive as ds
from sitewise.operators import federation as fed
from sitewise.operators import inference as inf
from sitewise.operators import reduction as rd
from sitewise.sources import datasets, genomic, imaging, sinks

log = logging.getLogger(__name__)

LOCAL_SECTIONS = {"overview": "overview/overview.csv", "numeric": "numeric/numeric_summary.csv", "categorical": "categorical/categorical_summary.csv", "temporal": "temporal/temporal_summary.csv", "significant_associations": "inferential/significant_associations.csv", "numeric_comparison": "comparison/numeric_comparison.csv"}
GLOBAL_SECTIONS = {"overview": "overview.csv", "numeric": "numeric.csv", "categorical": "categorical.csv", "temporal": "temporal.csv", "sex_distribution": "sex.csv", "age_distribution": "age.csv", "coverage": "coverage.csv"}
AGE = "age"


class SiteAnalyzer:
    """Summaries of one site's table."""

    def __init__(self, alpha: float = 0.05, max_group_levels: int = 6, screen: bool = True, reduce_dimensions: bool = True):
        self.alpha, self.max_group_levels, self.screen, self.reduce_dimensions = alpha, max_group_levels, screen, reduce_dimensions

    def analyze(self, node_id: str, table: DataFrame) -> dict[str, DataFrame]:
        spark = table.sparkSession
        df = ct.promote_dates(table).persist()
        kinds = ct.column_kinds(df)
        ids = ct.identifiers(kinds)
        node = F.lit(node_id)
        out: dict[str, DataFrame] = {"kinds": ct.kinds_table(spark, kinds)}
        columns = [k.column for k in kinds if k.kind != "unsupported"]
        repeated = ds.duplicate_rows(df, columns).first().n_duplicates
        out["overview"] = fed.site_overview(df.withColumn("__node", node), "__node", columns, ids).withColumn("n_duplicates", F.lit(repeated))
        self._numeric(out, df, node, kinds)
        self._categorical(out, df, node, kinds)
        self._temporal(out, df, node, kinds)
        for name, make in (("missing", lambda: ds.missing_by_column(df, columns)), ("screening", lambda: self._screening(df, kinds)), ("comparisons", lambda: self._outcome(df, kinds)), ("pca", lambda: self._pca(spark, df, kinds)), ("mca", lambda: self._mca(spark, df, kinds))):
            try:
                made = make()
                if made is not None:
                    out[name] = made
            except Exception as e:  # one section must not take the others with it
                log.warning("%s of %s failed: %s", name, node_id, e)
        return out

    def _numeric(self, out, df, node, kinds):
        names = ct.of_kind(kinds, "numeric")
        if names:
            cells = ds.melt(df, node, names)
            out["numeric"] = ds.numeric_profile(cells)
            out["numeric_partials"] = fed.numeric_partials(cells)
            out["histograms"] = ds.auto_histogram(cells, out["numeric"])
        if AGE in names:
            out["age"] = fed.site_histograms(df.withColumn("__node", node), "__node", AGE)
            out["age_out_of_range"] = ds.out_of_range(df, AGE)

    def _categorical(self, out, df, node, kinds):
        names = ct.of_kind(kinds, "categorical")
        if names:
            cells = ds.melt(df, node, names, "string")
            out["categorical"] = ds.categorical_profile(cells)
            out["category_counts"] = ds.category_counts(cells)
            out["quasi_numeric"] = ct.quasi_numeric(df, [k.column for k in kinds if k.column in names and k.data_type == "string"])
        sex = ds.sex_column(df.columns)
        if sex:
            out["sex"] = df.groupBy(ds.sex_label(F.col(sex)).alias("sex")).agg(F.count("*").alias("cnt"))

    def _temporal(self, out, df, node, kinds):
        names = ct.of_kind(kinds, "temporal")
        if names:
            cells = ds.melt(df, node, names, "timestamp")
            out["temporal"] = ds.temporal_profile(cells)
            out["periods"] = ds.period_counts(cells)

    def _levels(self, df, kinds) -> dict[str, int]:
        names = ct.of_kind(kinds, "categorical")
        return {r.column_name: r.n_levels for r in ct.level_counts(df, names).collect()} if names else {}

    def _screening(self, df, kinds):
        return inf.screen(df, ct.of_kind(kinds, "numeric"), self._levels(df, kinds), self.alpha, max_levels=self.max_group_levels) if self.screen else None

    def _outcome(self, df, kinds):
        outcome = inf.outcome_column(df, ct.of_kind(kinds, "categorical"))
        numbers = ct.of_kind(kinds, "numeric")
        return inf.outcome_comparison(df, numbers, outcome) if outcome and numbers else None

    def _pca(self, spark, df, kinds):
        return rd.reduction_table(spark, rd.pca(df, ct.of_kind(kinds, "numeric"))) if self.reduce_dimensions and ct.reduction_gate(kinds)["pca"] else None

    def _mca(self, spark, df, kinds):
        few = [c for c, k in self._levels(df, kinds).items() if k <= 30]
        return rd.reduction_table(spark, rd.mca(rd.as_categories(df, few), few)) if self.reduce_dimensions and ct.reduction_gate(kinds)["mca"] else None


class FederationAggregator:
    """Merges of the sites' summaries; no rows are needed."""

    def aggregate(self, results: dict[str, dict[str, DataFrame]]) -> dict[str, DataFrame]:
        def every(name: str) -> DataFrame | None:
            parts = [r[name] for r in results.values() if name in r]
            return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts) if parts else None

        out: dict[str, DataFrame] = {}
        overview = every("overview")
        out["overview"] = fed.overview_totals(overview)
        out["contributions"] = fed.contributions(overview)
        parts = [r["kinds"].where("kind <> 'empty'").select(F.lit(n).alias("node_id"), "column_name") for n, r in results.items()]
        catalogue = reduce(DataFrame.unionByName, parts)
        out["coverage"] = fed.column_coverage(catalogue, len(results))
        out["local_coverage"] = fed.local_coverage(catalogue, out["coverage"])
        partials, counts, periods, sex, age = (every(n) for n in ("numeric_partials", "category_counts", "periods", "sex", "age"))
        if partials is not None:
            out["numeric"] = fed.pooled_numeric(partials)
            out["alignment"] = fed.mean_alignment(partials, out["numeric"])
            out["numeric_comparison"] = fed.compare_to_whole(partials.select("node_id", "column_name", "mean"), out["numeric"], "column_name", "mean")
        if counts is not None:
            out["category_counts"] = fed.merged_categories(counts)
            out["categorical"] = fed.merged_modes(out["category_counts"])
            out["categorical_comparison"] = fed.compare_categories(counts.select("node_id", "column_name", "value", "cnt"), out["category_counts"])
        if periods is not None:
            out["periods"] = fed.merged_periods(periods)
            out["temporal"] = fed.most_active(out["periods"])
            out["trends"] = fed.trends(out["periods"])
        if sex is not None:
            out["sex"] = sex.groupBy("sex").agg(F.sum("cnt").alias("cnt"))
        if age is not None:
            out["age"] = fed.merged_histogram(age)
        return out

    def has_converged(self, result=None, last=None) -> bool:
        return fed.has_converged(result, last)


def run(spark: SparkSession, root: str, out: str | None = None, analyzer: SiteAnalyzer | None = None, aggregator: FederationAggregator | None = None) -> tuple[dict, dict]:
    """Analyse every site below ``root`` and merge; with ``out`` the results are written as CSV and JSON."""
    files = datasets.file_listing(spark, root)
    chosen = datasets.chosen_files(files).orderBy("node_id").collect()  # one row per site
    if not chosen:
        raise ValueError(f"no CSV file below {root}")
    analyzer, aggregator = analyzer or SiteAnalyzer(), aggregator or FederationAggregator()
    local = {r.node_id: analyzer.analyze(r.node_id, datasets.read_site(spark, r.path)) for r in chosen}
    whole = aggregator.aggregate(local)
    if out:
        write(local, whole, out)
    return local, whole


def write(local: dict, whole: dict, out: str) -> None:
    """Result tables and JSON summaries."""
    places = {"overview": "overview/overview.csv", "missing": "overview/missing_values.csv", "numeric": "numeric/numeric_summary.csv", "age": "numeric/age_histogram.csv", "age_out_of_range": "numeric/age_out_of_range.csv", "categorical": "categorical/categorical_summary.csv", "quasi_numeric": "categorical/quasi_numeric_columns.csv", "temporal": "temporal/temporal_summary.csv", "screening": "inferential/association_screening.csv", "pca": "pca/explained_variance.csv", "mca": "mca/explained_inertia.csv"}
    for node, tables in local.items():
        base = os.path.join(out, "local", node)
        for name, rel in places.items():
            if name in tables:
                t = tables[name]
                if "column_name" in t.columns and "local_coverage" in whole:
                    label = whole["local_coverage"].where(F.col("node_id") == node).select("column_name", F.col("label").alias("availability"))
                    t = t.join(label, "column_name", "left").withColumn("availability", F.coalesce("availability", F.lit("unknown")))
                sinks.write_whole(t, os.path.join(base, rel))
        if "screening" in tables:
            sinks.write_whole(tables["screening"].where("significant"), os.path.join(base, "inferential/significant_associations.csv"))
        if "comparisons" in tables:
            outcome = tables["comparisons"].first()
            sinks.write_whole(tables["comparisons"], os.path.join(base, f"inferential/comparisons_by_{outcome.var2 if outcome else 'outcome'}.csv"))
        for name, rel in (("numeric_comparison", "comparison/numeric_comparison.csv"), ("categorical_comparison", "comparison/categorical_comparison.csv"), ("contributions", "comparison/contribution.csv")):
            if name in whole:
                sinks.write_whole(whole[name].where(F.col("node_id") == node), os.path.join(base, rel))
        sinks.json_summary(base, LOCAL_SECTIONS)
    for name, t in whole.items():
        sinks.write_whole(t, os.path.join(out, "federated", f"{name}.csv"))
    sinks.json_summary(os.path.join(out, "federated"), GLOBAL_SECTIONS)


def run_genomic(spark: SparkSession, folder: str, out: str) -> dict[str, dict]:
    """Every genomic text file of a folder analysed; a table per statistic and a summary.json."""
    files = datasets.file_listing(spark, folder)
    tables: dict[str, DataFrame] = {"samples": genomic.samples(files), "formats": genomic.format_overview(files), "sizes": genomic.size_statistics(files)}
    for r in files.where(datasets.file_type(F.col("file_name")).isin("fastq", "vcf", "fasta", "alignment")).orderBy("file_name").collect():  # one row per file
        kind = next(k for k, ends in datasets.FILE_TYPES if r.file_name.lower().endswith(ends))
        try:
            tables |= {f"{r.file_name}.{n}": t for n, t in genomic.analyze(spark, r.path, kind).items()}
        except ValueError as e:
            log.warning("%s: %s", r.file_name, e)
    return _write_tables(tables, out)


def run_imaging(spark: SparkSession, folder: str, out: str) -> dict[str, dict]:
    """The images below a folder: sizes, resolution, modalities and body parts, and a table of folders."""
    h = imaging.headers(spark, folder).persist()
    return _write_tables({"folders": imaging.folder_table(h), "sizes": imaging.size_statistics(h), "resolution": imaging.resolution(h), "modalities": imaging.modalities(h), "regions": imaging.regions(h)}, out)


def _write_tables(tables: dict[str, DataFrame], out: str) -> dict[str, dict]:
    for name, t in tables.items():
        sinks.write_whole(t, os.path.join(out, f"{name}.csv"))
    with open(sinks.json_summary(out, {n: f"{n}.csv" for n in tables}), encoding="utf-8") as f:
        return json.load(f)


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description="Profile the sites below a directory and merge their summaries.")
    p.add_argument("root")
    p.add_argument("out")
    p.add_argument("--archive", help="also pack the results into this base64 file")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("sitewise").getOrCreate()
    run(spark, a.root, a.out)
    if a.archive:
        with open(a.archive, "w", encoding="ascii") as f:
            f.write(sinks.pack_directory(a.out))


if __name__ == "__main__":
    main()
