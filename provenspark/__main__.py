"""python -m provenspark doctor ROOT [--json]: the read-only checks of a store; exit code 1 on a failure.
python -m provenspark check PACK: whether a handover pack holds what its manifest says, and what it would become."""

from __future__ import annotations

import json
import sys


def main(args: list[str]) -> int:
    if len(args) < 2 or args[0] not in ("doctor", "check"):
        print(__doc__)
        return 2
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.config("spark.ui.enabled", "false").getOrCreate()
    if args[0] == "check":
        from provenspark.sources import handover

        try:
            print(handover.review(handover.read(spark, args[1])))
        except handover.HandoverError as e:
            print(f"refused: {e}")
            return 1
        return 0
    from provenspark.operators.ledger import doctor
    from provenspark.sources.store import Store

    rows = [r.asDict() for r in doctor(Store(spark, args[1], readonly=True)).orderBy("check").collect()]  # one row a check
    print(json.dumps(rows, indent=2) if "--json" in args else "\n".join(f"{r['status']:5} {r['check']}: {r['detail']}" + (f" - {r['remedy']}" if r["remedy"] else "") for r in rows))
    return int(any(r["status"] == "fail" for r in rows))


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
