"""Command line: python -m tidewell [--init | --fsck | --format | --repack | --serve PORT] --storage-path FOLDER."""

from __future__ import annotations

import argparse
import json


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tidewell")
    what = p.add_mutually_exclusive_group(required=True)
    what.add_argument("--init", action="store_true", help="make a store and stop")
    what.add_argument("--fsck", action="store_true", help="check all layers and stop")
    what.add_argument("--format", action="store_true", help="show the format and stop")
    what.add_argument("--repack", action="store_true", help="rewrite into one clustered layer and stop")
    what.add_argument("--serve", type=int, metavar="PORT", help="answer JSON requests over HTTP")
    p.add_argument("--storage-path", help="folder of the store")
    p.add_argument("--memory-only", action="store_true")
    p.add_argument("--strategy", help="as in the settings")
    p.add_argument("--use-shards", action="store_true")
    p.add_argument("--force-unlock", action="store_true")
    a = p.parse_args(argv)
    if not a.memory_only and not a.storage_path:
        p.error("--storage-path or --memory-only is needed")

    from pyspark.sql import SparkSession

    from tidewell.plans.storage import FORMAT, ShardedStore, Store, memory_only_storage

    spark = SparkSession.builder.appName("tidewell").getOrCreate()
    if a.format:
        print(json.dumps({"format": FORMAT}))
        return 0
    store = memory_only_storage(spark) if a.memory_only else ShardedStore(spark, a.storage_path) if a.use_shards else Store(spark, a.storage_path, a.force_unlock)
    try:
        if a.strategy:
            settings = store.settings
            settings.change(f"strategy={a.strategy}")
            if store.folder:
                settings.save(store.folder)
        if a.fsck:
            bad = store.fsck()
            print(json.dumps({"removed": bad}))
            return int(bool(bad))
        if a.repack:
            store.repack()
        if a.serve is not None:
            from tidewell.plans.json_api import JsonApi, serve

            serve(JsonApi(store), a.serve).serve_forever()
        print(json.dumps(store.description()))
        return 0
    finally:
        store.stop()


if __name__ == "__main__":
    raise SystemExit(main())
