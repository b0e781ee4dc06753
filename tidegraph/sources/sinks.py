"""Writers: prepared tables with a manifest, features and scores, JSON artifacts, Markdown reports."""

from __future__ import annotations

import hashlib
import json
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.operators.quality import entity_profile, quality_profile, split_profile
from tidegraph.session import path_exists


def content_checksum(df: DataFrame) -> str:
    """A checksum of the rows as a multiset, independent of their order and of part files."""
    names = sorted(df.columns)
    h = F.xxhash64(*(F.coalesce(F.to_json(F.struct(F.col(c))), F.lit("")) for c in names))
    r = df.agg(F.count(F.lit(1)).alias("n"), F.sum(h.cast("decimal(38,0)")).alias("s"), F.bit_xor(h).alias("x")).first()
    return f"{r['n']}-{r['s'] or 0}-{r['x'] or 0}"


def manifest(df: DataFrame) -> DataFrame:
    """One row: rows, positives, rate, time range, rows per split."""
    splits = df.groupBy("split").agg(F.count(F.lit(1)).alias("n"))
    base = df.agg(
        F.count(F.lit(1)).alias("row_count"), F.coalesce(F.sum(F.col("is_fraud").cast("bigint")), F.lit(0)).alias("fraud_count"), F.round(F.avg("is_fraud"), 8).alias("fraud_rate"),
        F.min("transaction_time").alias("min_transaction_time"), F.max("transaction_time").alias("max_transaction_time"),
    )
    listed = splits.agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "split", F.col("n").cast("string")))), ";").alias("split_counts"))
    return base.withColumn("__one", F.lit(1)).join(F.broadcast(listed.withColumn("__one", F.lit(1))), "__one").drop("__one")


def write_prepared(df: DataFrame, folder: str, *, csv: bool = False) -> dict[str, Any]:
    """Writes the table (parquet, or CSV) and returns its manifest with the content checksum."""
    target = f"{folder}/transactions"
    (df.write.mode("overwrite").option("header", True).csv(target) if csv else df.write.mode("overwrite").parquet(target))
    spark = df.sparkSession
    back = spark.read.schema(df.schema).option("header", True).csv(target) if csv else spark.read.parquet(target)
    return {**manifest(back).first().asDict(), "content_checksum": content_checksum(back)}


def write_table(df: DataFrame, path: str, *, csv: bool = False) -> None:
    (df.write.mode("overwrite").option("header", True).csv(path) if csv else df.write.mode("overwrite").parquet(path))


def write_text(text: str, path: str | Path) -> None:
    """A small file on whatever file system the path names."""
    spark = SparkSession.active()
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(str(path))
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def read_text(path: str | Path) -> str:
    spark = SparkSession.active()
    source = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(str(path))
    stream = source.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(source)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_json(value: Any, path: str | Path) -> None:
    """A small document; tables go through ``write_table``."""
    write_text(json.dumps(value, indent=2, sort_keys=True, default=str), path)


def read_json(path: str | Path) -> Any:
    return json.loads(read_text(path))


def markdown_table(df: DataFrame, limit: int = 1_000) -> str:
    """A small result as a Markdown table; larger results are refused."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows for a report")
    show = lambda v: "" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(show, r)) + " |" for r in rows])


def quality_report(df: DataFrame) -> str:
    """The quality profile, splits and entities of a prepared table as Markdown."""
    parts = [("Profile", quality_profile(df)), ("Splits", split_profile(df).orderBy("min_transaction_time")), ("Entities", entity_profile(df).orderBy("entity_column"))]
    return "\n\n".join(f"## {title}\n\n{markdown_table(part)}" for title, part in parts) + "\n"


def evaluation_report(metrics: dict[str, Any]) -> str:
    """The models' figures, slices and worst cases of an evaluation (``workflow.evaluate``) as Markdown."""
    show = lambda v: "" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v)
    line = lambda cells: "| " + " | ".join(map(show, cells)) + " |"
    out = ["## Models", "", line(["model", "validation PR-AUC", "test PR-AUC", "alerts at matched recall", "alert reduction"]), "|" + "---|" * 5]
    out += [line([n, m["validation_pr_auc"], m["test"]["pr_auc"], m["matched_recall"]["alert_count"], m["alert_reduction"]]) for n, m in metrics["models"].items()]
    out += ["", f"Chosen on validation: {metrics['selected']}"]
    for title in ("slices", "worst_cases"):
        rows = metrics[title]
        if rows:
            out += ["", f"## {title.replace('_', ' ').capitalize()}", "", line(rows[0]), "|" + "---|" * len(rows[0])] + [line(r.values()) for r in rows]
    return "\n".join(out) + "\n"


def alert_report(summary: dict[str, Any], alerts: DataFrame, limit: int = 20) -> str:
    """The alert artifact's gates, reason counts and first alerts as Markdown, with its note."""
    top = alerts.filter(F.col("rank") <= limit).orderBy("rank").select("rank", "transaction_id", "risk_score", "recommended_action", F.array_join("reasons.code", ", ").alias("reasons"))
    gates = "\n".join(f"- {name}: {'pass' if ok else 'FAIL'}" for name, ok in sorted(summary["gates"].items()))
    codes = "\n".join(f"- {code}: {n}" for code, n in sorted(summary["reason_code_counts"].items()))
    return f"## Gates ({summary['status']})\n\n{gates}\n\n## Reasons\n\n{codes}\n\n## First alerts\n\n{markdown_table(top, limit)}\n\n{summary['disclaimer']}\n"


def evidence_snapshot(folder: str, files: tuple[str, ...] = ("manifest.json", "feature_audit.json", "metrics.json", "alerts.json")) -> dict[str, Any]:
    """Status and SHA-256 of a run's documents: what is there, what is missing, and whether every audit passed."""
    spark, found = SparkSession.active(), {}
    for f in files:
        if path_exists(spark, f"{folder}/{f}"):
            text = read_text(f"{folder}/{f}")
            found[f] = {"sha256": hashlib.sha256(text.encode("utf-8")).hexdigest(), "status": json.loads(text).get("status")}
    missing = [f for f in files if f not in found]
    passed = not missing and all(x["status"] in (None, "PASS") for x in found.values())
    return {"status": "PASS" if passed else "FAIL", "missing": missing, "documents": found}
