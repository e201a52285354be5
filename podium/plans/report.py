"""Summaries, reports and leaderboards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from podium.config import CUTOFFS, LEADERBOARD_METRICS, RBP_PERSISTENCE
from podium.operators.metrics import rbp_name

# Report section of each metric.
SECTIONS = {
    "NDCG": "ndcg", "MAP": "mAP", "Recall": "recall", "P": "precision", "MRR": "mrr", "Hole": "hole", "Accuracy": "acc",
}


def summary_names(last_k: int, wide: bool = False, ps: tuple[float, ...] = RBP_PERSISTENCE) -> dict[str, str]:
    """Summary column to metric name. ``wide`` adds recall and precision at 10."""
    extra = {"Recall@10": "Recall@10", "P@10": "P@10"} if wide else {}
    means = {f"m{name}": f"m{name}" for name in ["ERR", *map(rbp_name, ps)]}
    return {f"mAP@{last_k}": f"MAP@{last_k}", f"mrr@{last_k}": f"MRR@{last_k}", "NDCG@10": "NDCG@10", **extra, **means}


def summary(
    metrics: DataFrame,
    top_k: int = 1000,
    ks: tuple[int, ...] = CUTOFFS,
    wide: bool = False,
    by: tuple[str, ...] = (),
    value: str = "reported",
) -> DataFrame:
    """One row (per ``by`` group) of headline metrics; null where a cutoff was not computed."""
    names = summary_names(max(k for k in ks if k <= top_k), wide)
    picked = [F.max(F.when(F.col("name") == name, F.col(value))).alias(column) for column, name in names.items()]
    return metrics.groupBy(*by).agg(*picked) if by else metrics.agg(*picked)


def select_metrics(metrics: DataFrame, wanted: tuple[str, ...]) -> DataFrame:
    return metrics.where(F.col("name").isin(*wanted))


def merge_metrics(metrics: DataFrame, summaries: DataFrame) -> DataFrame:
    """``(experiment, name, value)``: metrics, and summary values under names they do not have."""
    columns = ["experiment", "name", "value"]
    missing = summaries.join(metrics, ["experiment", "name"], "left_anti")
    return metrics.select(*columns).unionByName(missing.select(*columns))


def leaderboard(merged: DataFrame, wanted: tuple[str, ...] = LEADERBOARD_METRICS) -> DataFrame:
    """Experiments by metrics. A wanted metric that an experiment lacks is an error."""
    picked = [F.max(F.when(F.col("name") == name, F.col("value"))).alias(name) for name in wanted]
    every = merged.groupBy("experiment").agg(*picked)

    def required(name):
        message = F.concat(F.lit(f"no {name} for experiment "), F.col("experiment"))
        return F.coalesce(F.col(f"`{name}`"), F.raise_error(message).cast("double")).alias(name)

    return every.select("experiment", *[required(name) for name in wanted])


def relative_gain(board: DataFrame, base: str) -> DataFrame:
    """Gain of every experiment over the one named ``base``, metric by metric."""
    names = [c for c in board.columns if c != "experiment"]
    reference = board.where(F.col("experiment") == base).select(F.struct(*names).alias("base")).scalar()
    with_base = board.withColumn("base", reference)
    gains = [F.try_divide(F.col(n) - F.col("base")[n], F.col("base")[n]).alias(n) for n in names]
    return with_base.select("experiment", *gains)


def write_report(metrics: DataFrame, path: str, fmt: str = "json", mode: str = "errorifexists"):
    """All metrics, one row each."""
    metrics.coalesce(1).write.mode(mode).format(fmt).save(path)


def write_summary_csv(summary_row: DataFrame, path: str, mode: str = "errorifexists"):
    summary_row.coalesce(1).write.mode(mode).option("header", True).csv(path)


def report_json(metrics: DataFrame, top_k: int = 1000, ks: tuple[int, ...] = CUTOFFS, wide: bool = False) -> DataFrame:
    """One row with the nested report: a section per cutoff metric, and the summary."""
    section = F.coalesce(*[F.when(F.col("metric") == m, F.lit(s)) for m, s in SECTIONS.items()])
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "reported"))))
    sections = metrics.where("k IS NOT NULL").groupBy(section.alias("section")).agg(entries.alias("entries"))
    row = summary(metrics, top_k, ks, wide)
    head = row.select(
        F.lit("summary").alias("section"),
        F.map_from_entries(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("reported")) for c in row.columns])).alias(
            "entries"
        ),
    )
    both = sections.unionByName(head)
    return both.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("section", "entries")))).alias("value"))


def write_report_json(metrics: DataFrame, path: str, **options):
    """The nested report as one JSON file."""
    report_json(metrics, **options).write.text(path)


def read_experiments(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """Metrics and summaries ``(experiment, name, value)`` of nested reports.

    Each path is an experiment folder with an ``output.json``; the folder names the experiment.
    """
    files = [f"{path.rstrip('/')}/output.json" for path in paths]
    text = spark.read.text(files, wholetext=True)
    name = F.element_at(F.split("_metadata.file_path", "/output.json"), 1)
    parsed = F.from_json("value", "map<string,map<string,string>>", {"mode": "FAILFAST"})
    sections = text.select(F.element_at(F.split(name, "/"), -1).alias("experiment"), F.explode(parsed).alias("section", "entries"))
    entries = sections.select("experiment", "section", F.explode("entries").alias("name", "text"))
    # Summary values of cutoff metrics are lists of one number.
    rows = entries.withColumn("value", F.regexp_replace("text", r"[\[\]\s]", "").cast("double"))
    columns = ["experiment", "name", "value"]
    return rows.where("section != 'summary'").select(*columns), rows.where("section = 'summary'").select(*columns)
