"""``python -m tidemark.cli analyse --sf-dir DIR --operation FIELD_DELETE --field 0``: one sorted JSON line, exit 2 with an error as JSON."""

from __future__ import annotations

import argparse
import json
import sys


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tidemark")
    sub = parser.add_subparsers(dest="command", required=True)
    a = sub.add_parser("analyse", help="a structural change of one field")
    a.add_argument("--sf-dir", required=True)
    a.add_argument("--operation", choices=["FIELD_RENAME", "FIELD_DELETE", "FIELD_TYPE_CHANGE"], required=True)
    a.add_argument("--field", type=int, required=True)
    m = sub.add_parser("diff-sql", help="deltas of two versions of a SQL model")
    m.add_argument("before")
    m.add_argument("after")
    args = parser.parse_args(argv)
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("tidemark").getOrCreate()
    try:
        if args.command == "diff-sql":
            from .operators.sqlmodel import model_deltas, parse_model

            with open(args.before) as f, open(args.after) as g:
                found: object = model_deltas(parse_model(spark, f.read()), parse_model(spark, g.read()))
        else:
            from .plans.structural import analyse
            from .sources import registry as reg

            fields = reg.fields(spark, args.sf_dir)
            source = fields.where(fields["node"] == args.field).select("node")
            if source.isEmpty():
                raise ValueError(f"no field {args.field}")
            found = analyse(reg.lineage_edges(spark, args.sf_dir), fields, reg.relationships(spark, args.sf_dir), source, args.operation)["decision"].first().asDict()
        print(json.dumps(found, sort_keys=True, default=str))
        return 0
    except Exception as e:
        print(json.dumps({"error": type(e).__name__, "message": str(e)[:500]}, sort_keys=True), file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
