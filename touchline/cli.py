"""Command line: ``python -m touchline.cli <command> ...``

Commands mirror the batch jobs: ``etl`` (raw JSON -> processed tables),
``export`` (processed -> star schema), ``validate`` (model checks, exit code
1 on failure), ``sample`` (curated sample + manifest), ``report`` (quality
report markdown). On a cluster, submit with ``spark-submit -m touchline.cli``;
the session comes from the submitter's configuration.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession


def _session(args) -> SparkSession:
    if args.master:
        from touchline.session import build_session
        return build_session(args.master, args.shuffle_partitions)
    spark = SparkSession.builder.getOrCreate()
    from touchline.session import checkpoint_dir
    checkpoint_dir(spark)
    return spark


def _procs(raw: str | None) -> set[str] | None:
    from touchline.sources.json_files import PROCESSORS
    if not raw:
        return None
    vals = {x.strip() for x in raw.split(",") if x.strip()}
    bad = sorted(vals - set(PROCESSORS))
    if bad:
        raise SystemExit(f"no such processor: {bad}; there are {list(PROCESSORS)}")
    return vals


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="touchline")
    p.add_argument("--master", default=None, help="local master for runs outside spark-submit, e.g. local[8]")
    p.add_argument("--shuffle-partitions", type=int, default=200)
    sub = p.add_subparsers(dest="cmd", required=True)
    e = sub.add_parser("etl")
    e.add_argument("--input-dir", required=True)
    e.add_argument("--output-dir", required=True)
    e.add_argument("--no-append", action="store_true", help="full rebuild (forces a non-incremental run)")
    e.add_argument("--force", action="store_true", help="reprocess unchanged files")
    e.add_argument("--include", default=None)
    e.add_argument("--exclude", default=None)
    e.add_argument("--max-files", type=int, default=None)
    e.add_argument("--strict-json", action="store_true")
    e.add_argument("--sha1", action="store_true", help="compare files by their content instead of size and time")
    x = sub.add_parser("export")
    x.add_argument("--input-dir", required=True)
    x.add_argument("--output-dir", required=True)
    x.add_argument("--format", choices=("parquet", "csv"), default="parquet")
    v = sub.add_parser("validate")
    v.add_argument("--model-dir", help="an exported model")
    v.add_argument("--processed-dir", help="processed tables; the model is built from them")
    for scope in ("match", "team", "player"):
        v.add_argument(f"--{scope}", type=int, default=None, help=f"only this {scope}'s goals for the goal check")
    s = sub.add_parser("sample")
    s.add_argument("--model-dir", help="an exported model")
    s.add_argument("--processed-dir", help="processed tables; the model is built from them")
    s.add_argument("--output-dir", required=True)
    s.add_argument("--competition", required=True)
    s.add_argument("--season", required=True)
    s.add_argument("--n-matches", type=int, default=10)
    r = sub.add_parser("report")
    r.add_argument("--output-dir", required=True)
    args = p.parse_args(argv)
    if args.cmd in ("validate", "sample") and bool(args.model_dir) == bool(args.processed_dir):
        p.error("give --model-dir or --processed-dir")
    spark = _session(args)

    def tables():
        from touchline.plans.star_schema import build_model, load_model
        return load_model(spark, args.model_dir) if args.model_dir else build_model(spark, args.processed_dir)

    if args.cmd == "etl":
        from touchline.plans.etl import run_etl
        res = run_etl(spark, args.input_dir, args.output_dir, incremental=not args.no_append, force=args.force,
                      include=_procs(args.include), exclude=_procs(args.exclude), max_files=args.max_files,
                      strict_json=args.strict_json, by_content=args.sha1)
        print(json.dumps({"run_id": res.run_id, "processed_files": res.processed_files}))
    elif args.cmd == "export":
        from touchline.plans.star_schema import ModelRejected, export_star_schema
        try:
            print(json.dumps(export_star_schema(spark, args.input_dir, args.output_dir, args.format)))
        except ModelRejected as rejected:
            for check in rejected.failed:
                print(f"[FAIL] {check}")
            return 1
    elif args.cmd == "validate":
        from touchline.operators.quality import validate_model
        rows = validate_model(spark, tables(), args.match, args.team, args.player).collect()  # one row per check
        for row in rows:
            print(f"[{row.status}] {row.check}: {row.value}")
        return 0 if all(row.status == "PASS" for row in rows) else 1
    elif args.cmd == "sample":
        from touchline.operators.sample import build_sample
        sampled, manifest = build_sample(spark, tables(), args.competition, args.season, args.n_matches)
        for name, df in sampled.items():
            df.write.mode("overwrite").parquet(f"{args.output_dir.rstrip('/')}/{name}")
        manifest.coalesce(1).write.mode("overwrite").json(f"{args.output_dir.rstrip('/')}/sample_manifest")
    elif args.cmd == "report":
        from touchline.plans.etl import quality_report_markdown
        print(quality_report_markdown(spark, args.output_dir))
    return 0


if __name__ == "__main__":
    sys.exit(main())
