"""Command line: run the end-to-end pipeline.

    python -m sessionlens --raw-dir DIR --out DIR [--journeys] [--stability]
    python -m sessionlens --tables SF_DIR --out DIR      # the shared parquet tables

CSV inputs are events1.csv, items.csv and users.csv in --raw-dir.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from sessionlens.operators.paths import STEP_MODES, JourneyConfig
from sessionlens.plans.pipeline import PipelineConfig, run_on_driver_tables, run_pipeline
from sessionlens.session import ship_package
from sessionlens.sources.csv_loader import load_all
from sessionlens.sources.driver_tables import PART_CATEGORY_MAP


def main(argv=None) -> None:
    ap = argparse.ArgumentParser(prog="sessionlens")
    src = ap.add_mutually_exclusive_group(required=True)
    src.add_argument("--raw-dir", help="folder with events1.csv, items.csv, users.csv")
    src.add_argument("--tables", help="folder with the shared parquet tables")
    ap.add_argument("--out", required=True, help="artifact folder (shared storage on a cluster)")
    ap.add_argument("--k-min", type=int, default=3)
    ap.add_argument("--k-max", type=int, default=7)
    ap.add_argument("--n-init", type=int, default=20)
    ap.add_argument("--journeys", action="store_true")
    ap.add_argument("--stability", action="store_true")
    ap.add_argument("--period", default="M", choices=["M", "W", "D"])
    ap.add_argument("--date-format", help="Spark pattern of the date columns (default: the spelling of the first date)")
    ap.add_argument("--multiline", action="store_true", help="CSV cells may hold line breaks")
    ap.add_argument("--min-sessions", type=int, default=1)
    ap.add_argument("--outlier-threshold", type=float, default=0.0)
    ap.add_argument("--step-mode", default="event_type", choices=STEP_MODES)
    ap.add_argument("--max-steps", type=int, default=30)
    ap.add_argument("--bootstrap-runs", type=int, default=20)
    ap.add_argument("--bootstrap-frac", type=float, default=0.8)
    ap.add_argument("--sample-rows", type=int, default=50, help="rows of the sample tables")
    ap.add_argument("--resume", action="store_true", help="go on with a run of the same input and settings that broke off")
    a = ap.parse_args(argv)
    spark = SparkSession.builder.appName("sessionlens").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    ship_package(spark)
    cfg = PipelineConfig(k_range=range(a.k_min, a.k_max + 1), n_init=a.n_init, with_journeys=a.journeys,
                         with_stability=a.stability, period=a.period, min_sessions=a.min_sessions,
                         outlier_threshold=a.outlier_threshold, bootstrap_runs=a.bootstrap_runs,
                         bootstrap_frac=a.bootstrap_frac, sample_rows=a.sample_rows,
                         journey=JourneyConfig(step_mode=a.step_mode, max_steps=a.max_steps))
    if a.tables:
        cfg.category_map = PART_CATEGORY_MAP
        art = run_on_driver_tables(spark, a.tables, a.out, cfg, a.resume)
    else:
        art = run_pipeline(spark, load_all(spark, a.raw_dir, date_format=a.date_format, multiline=a.multiline), a.out, cfg, a.resume)
    print(f"chosen_k={art.segmentation.chosen_k} artifacts={art.out_dir}")


if __name__ == "__main__":
    main()
