"""Command line: build canonical tables or leakage-safe splits."""

from __future__ import annotations

import argparse
import hashlib
import sys
from collections.abc import Sequence
from pathlib import Path

from switchyard import __version__


def build_parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="switchyard", description="Analytics for model-routing data on Spark.")
    parser.add_argument("--version", action="version", version=f"switchyard {__version__}")
    commands = parser.add_subparsers(dest="command")
    canonical = commands.add_parser("canonical", help="pinned source to canonical tables")
    canonical.add_argument("--data-root", type=Path, required=True)
    canonical.add_argument("--manifest", type=Path, required=True)
    canonical.add_argument("--output", type=Path, required=True)
    canonical.add_argument("--debug-limit", type=int, default=100)
    splits = commands.add_parser("splits", help="queries and models to leakage-safe splits")
    splits.add_argument("--queries", required=True)
    splits.add_argument("--models", required=True)
    splits.add_argument("--settings", type=Path, required=True)
    splits.add_argument("--dataset-id", required=True)
    splits.add_argument("--revision", required=True)
    splits.add_argument("--storage-root", type=Path)
    splits.add_argument("--allow-unsupported-temporal", action="store_true")
    return parser


def build_splits(queries, models, config, deduplication, allow_unsupported_temporal: bool):
    """All strategies; only a temporal one whose input lacks dates may be reported as unsupported."""
    from switchyard.errors import SplitError
    from switchyard.operators.splits import STRATEGIES, build_split

    built, unsupported = {}, {}
    for strategy in STRATEGIES:
        try:
            built[strategy] = build_split(strategy, queries, models, deduplication, config)
        except SplitError as error:
            if strategy != "temporal" or not allow_unsupported_temporal or "requires" not in str(error):
                raise
            unsupported[strategy] = str(error)
    return built, unsupported


def main(argv: Sequence[str] | None = None) -> int:
    parser = build_parser()
    args = parser.parse_args(argv)
    if args.command is None:
        parser.print_help()
        return 0
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("switchyard").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if args.command == "canonical":
        from switchyard.operators.canonical import build_canonical
        from switchyard.sources.pinned import PinnedSource
        from switchyard.sources.sinks import write_canonical_dataset

        source = PinnedSource.from_manifest(spark, args.data_root, args.manifest)
        digest = hashlib.sha256(args.manifest.read_bytes()).hexdigest()
        path = write_canonical_dataset(build_canonical(source), args.output, source_dataset=source.manifest.dataset_id, source_revision=source.manifest.revision, source_manifest_sha256=digest, debug_limit=args.debug_limit)
    else:
        from switchyard.operators.deduplication import deduplicate_queries
        from switchyard.operators.schemas import SCHEMA_VERSION
        from switchyard.sources.loaders import load_models, load_queries
        from switchyard.sources.sinks import write_split_bundle
        from switchyard.sources.storage import StoragePolicy, load_split_settings

        settings = load_split_settings(args.settings)
        root = StoragePolicy(Path.cwd(), settings.root_environment_variable).root(args.storage_root)
        queries, models = load_queries(spark, args.queries), load_models(spark, args.models)
        found = deduplicate_queries(queries, settings.deduplication)
        built, unsupported = build_splits(queries, models, settings.build_config(args.dataset_id, args.revision, SCHEMA_VERSION), found, args.allow_unsupported_temporal)
        path = write_split_bundle(root, queries, models, found, built, unsupported)
    print(path)
    return 0


if __name__ == "__main__":
    sys.exit(main())
