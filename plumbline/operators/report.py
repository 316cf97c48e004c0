"""Reports as rows of lines, and the artifacts of a sweep."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.text import fixed
from plumbline.operators import metrics
from plumbline.sources import files


def _number(c: str, digits: int = 4, signed: bool = False) -> Column:
    return fixed(F.col(c), digits, signed)


def strata_lines(strata: DataFrame, ks: Sequence[int] = metrics.KS) -> DataFrame:
    """metrics.by_stratum() -> place, line: `all` first, then the strata, a line for each measure; last the diagnostics."""
    order = F.array_position(F.array(*[F.lit(s) for s in ("all", *metrics.STRATA)]), F.col("stratum"))
    measure = lambda label, name: F.concat_ws("  ", *[F.concat(F.lit(f"{label}@{k}="), _number(f"{name}_at_{k}")) for k in ks])
    head = F.format_string("%s n=%d MRR=%s", "stratum", "n", _number("mrr"))
    lines = F.array(head, measure("R", "recall"), measure("Suff", "sufficiency"), measure("nDCG", "ndcg"))
    x = strata.select(order.alias("o"), F.posexplode(lines).alias("i", "line")).select((F.col("o") * 10 + F.col("i")).cast("int").alias("place"), "line")
    last = strata.where("stratum = 'all'").select(F.lit(99).alias("place"), F.format_string("MRR_mean_groups=%s MRR_first_group=%s", _number("mrr_mean_groups"), _number("mrr_first")).alias("line"))
    return x.unionByName(last)


def log_row(strata: DataFrame, variant: str, notes: str = "") -> DataFrame:
    """line: one row of a Markdown table of runs."""
    return strata.where("stratum = 'all'").select(F.format_string("| %s | %s | %s | %s | %s |", F.lit(variant), *[_number(c, 3) for c in ("mrr", "recall_at_5", "ndcg_at_10")], F.lit(notes)).alias("line"))


def comparison_lines(comparison: DataFrame) -> DataFrame:
    """metrics.compare() -> stratum, metric, line."""
    return comparison.select("stratum", "metric", F.format_string("%s %s %s %s [%s, %s] %s", "metric", _number("base_mean"), _number("candidate_mean"), *[_number(c, signed=True) for c in ("delta", "lo", "hi")], "flag").alias("line"))


def write_sweep(spark: SparkSession, per_config: DataFrame, meta: dict, path: str) -> None:
    """sweep.json of a fusion sweep: meta and a result a configuration, of which a sweep has few."""
    rows = [r.asDict(recursive=True) for r in per_config.orderBy("config").collect()]
    files.write_json(spark, {"note": "a diagnostic, not a tuning result"} | meta | {"results": rows}, f"{path}/sweep.json")
