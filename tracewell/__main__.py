"""Command line: ``python -m tracewell swim-fit|oxygen|clusters|run --catalog list.csv --out table``.

``run`` takes recordings through the stages of ``tracewell.plans.stages``, with ``--stages map,activity``,
``--set swim_fits.least=0.3`` (JSON, any number of times) and ``--parallel``.
"""

from __future__ import annotations

import argparse
import json

from tracewell.plans import recording_jobs, stages
from tracewell.session import get_session, ship_package


def _setting(text: str) -> tuple[str, str, object]:
    """(stage, setting, value) of ``stage.setting=value``; what is no JSON is taken as text."""
    name, _, value = text.partition("=")
    stage, _, setting = name.partition(".")
    if not (stage and setting and value):
        raise argparse.ArgumentTypeError(f"{text!r} is not stage.setting=value")
    try:
        return stage, setting, json.loads(value)
    except ValueError:
        return stage, setting, value


def main(arguments: list[str] | None = None) -> list:
    parser = argparse.ArgumentParser(prog="tracewell", description=__doc__)
    parser.add_argument("job", choices=["swim-fit", "oxygen", "clusters", "run"])
    parser.add_argument("--catalog", required=True, help="CSV of recordings")
    parser.add_argument("--out", required=True, help="Parquet table, by recording; for run the folder of all stages")
    parser.add_argument("--start-index", type=int, default=0)
    parser.add_argument("--max-index", type=int)
    parser.add_argument("--all", action="store_true", help="every recording, whatever the range")
    parser.add_argument("--force", action="store_true", help="also those that are finished")
    parser.add_argument("--oxygen-file", help="CSV of sec, value (jobs oxygen and run)")
    parser.add_argument("--stages", help="comma-separated; with what they need (job run; all without it)")
    parser.add_argument("--set", type=_setting, action="append", default=[], metavar="STAGE.SETTING=VALUE", help="a setting of a stage (job run)")
    parser.add_argument("--parallel", type=int, default=4, help="recordings at a time (job run)")
    parser.add_argument("--cores", help="local cores, where no master is configured")
    got = parser.parse_args(arguments)
    if got.job == "oxygen" and not got.oxygen_file:
        parser.error("oxygen needs --oxygen-file")
    spark = get_session("tracewell", cores=got.cores)
    ship_package(spark)
    first, last = (None, None) if got.all else (got.start_index, got.max_index)
    common = {"first": first, "last": last, "force": got.force}
    if got.job == "run":
        settings: dict[str, dict] = {s: {"curve": got.oxygen_file} for s in ("oxygen", "subcluster_oxygen") if got.oxygen_file}
        for stage, setting, value in got.set:
            settings.setdefault(stage, {})[setting] = value
        return stages.run_catalog(spark, got.catalog, got.out, got.stages.split(",") if got.stages else None, settings, parallel=got.parallel, **common)
    if got.job == "swim-fit":
        return recording_jobs.swim_fit_job(spark, got.catalog, got.out, **common)
    if got.job == "oxygen":
        return recording_jobs.oxygen_job(spark, got.catalog, got.out, got.oxygen_file, **common)
    return recording_jobs.cluster_job(spark, got.catalog, got.out, **common)


if __name__ == "__main__":
    print("recordings:", *main(), sep="\n")
