"""Command line: list, explain or run registered queries.

    python -m parkops list
    python -m parkops explain <query> [--sf-dir DIR]
    python -m parkops run <query> --out PATH [--sf-dir DIR] [--mode errorifexists|overwrite]
                                [--store ROOT --buckets N]
    python -m parkops store --root ROOT [--sf-dir DIR] [--buckets N]

``run`` writes the whole result as parquet (nothing passes through the driver).
``store`` writes the garage tables bucketed on their join keys; ``run --store``
then reads them instead of deriving the views.
"""

from __future__ import annotations

import argparse
import sys


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="parkops")
    sub = ap.add_subparsers(dest="cmd", required=True)
    sub.add_parser("list")
    ex = sub.add_parser("explain")
    ex.add_argument("query")
    ex.add_argument("--sf-dir", default="/root/testdata/sf0.01")
    run = sub.add_parser("run")
    run.add_argument("query")
    run.add_argument("--out", required=True)
    run.add_argument("--sf-dir", default="/root/testdata/sf0.01")
    run.add_argument("--mode", default="errorifexists", choices=["errorifexists", "overwrite"])
    run.add_argument("--store", default=None)
    run.add_argument("--input-gb", type=float, default=None, help="size partitions for this input")
    run.add_argument("--buckets", type=int, default=64)
    st = sub.add_parser("store")
    st.add_argument("--root", required=True)
    st.add_argument("--sf-dir", default="/root/testdata/sf0.01")
    st.add_argument("--buckets", type=int, default=64)
    args = ap.parse_args(argv)

    from parkops.plans.registry import QUERIES, RAW
    if args.cmd == "list":
        print("\n".join(sorted(QUERIES)))
        return 0
    if args.cmd == "store":
        from parkops.session import build_session
        from parkops.sources import store
        from parkops.sources.views import Garage
        spark = build_session()
        store.save_garage(Garage(spark, args.sf_dir), args.root, args.buckets)
        print(f"stored {len(store.BUCKET_KEYS)} tables under {args.root}")
        spark.stop()
        return 0
    if args.query not in QUERIES:
        print(f"unknown query {args.query!r}; see `python -m parkops list`", file=sys.stderr)
        return 2
    from parkops.session import apply_conf, build_session, scale_conf
    spark = build_session()
    if getattr(args, "input_gb", None):
        apply_conf(spark, scale_conf(int(args.input_gb * 1e9), max_partitions=100_000))
    if getattr(args, "store", None):
        from parkops.sources import store
        store.attach(spark, args.store, list(store.BUCKET_KEYS), args.buckets)
        df = RAW[args.query](store.stored_garage(spark, "parkops", args.sf_dir))
    else:
        df = QUERIES[args.query](spark, args.sf_dir)
    if args.cmd == "explain":
        df.explain("formatted")
    else:
        df.write.mode(args.mode).parquet(args.out)
        print(f"wrote {args.query} to {args.out}")
    spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
