"""Command line: ``python -m tidegraph prepare|features|evaluate|explain --output FOLDER``."""

from __future__ import annotations

import argparse
import json

from tidegraph.operators.models import BoostedModel
from tidegraph.plans import workflow
from tidegraph.plans.pipeline import Settings
from tidegraph.session import clear_scratch, local_session
from tidegraph.sources.synthetic import load_source


# The settings of a run that its command line offers; names and defaults are those of Settings.
OFFERED = ("seed", "train_fraction", "validation_fraction", "purge_seconds", "refresh_batches")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidegraph")
    p.add_argument("stage", choices=("prepare", "features", "evaluate", "explain"))
    p.add_argument("--output", required=True, help="folder of the run's tables and reports")
    p.add_argument("--mode", choices=("auto", "external", "synthetic"), default="auto")
    p.add_argument("--raw-dir", default="data/raw")
    p.add_argument("--max-rows", type=int)
    p.add_argument("--synthetic-rows", type=int, default=500)
    p.add_argument("--trees", type=int, default=BoostedModel.max_trees)
    p.add_argument("--model", choices=("graph_boosted", "graph_logistic"), default="graph_boosted")
    for name in OFFERED:
        default = getattr(Settings, name)
        p.add_argument("--" + name.replace("_", "-"), type=type(default), default=default)
    return p


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    settings = Settings(**{name: getattr(a, name) for name in OFFERED})
    spark = local_session()
    if a.stage == "prepare":
        source = load_source(spark, a.mode, a.raw_dir, n_rows=a.synthetic_rows, seed=a.seed, max_rows=a.max_rows)
        result = workflow.prepare(source, a.output, settings)
    elif a.stage == "features":
        result = workflow.features(spark, a.output, settings)
    elif a.stage == "evaluate":
        result = workflow.evaluate(spark, a.output, settings, trees=a.trees)
    else:
        result = workflow.explain(spark, a.output, settings, model=a.model, trees=a.trees)
    clear_scratch(spark)
    print(json.dumps(result, default=str)[:2_000])


if __name__ == "__main__":
    main()
