"""Derive a larger input from the driver's tables for scaling runs.

``events`` is replicated ``k`` times with shifted user and event ids (each
replica is a separate population with the same behaviour), written as many
Parquet files so scans run in parallel; the other tables are linked.

With ``--hot F`` a random share ``F`` of all events (seeded) is moved to one
subscriber id, the skew case the operators must survive (one key holding a
third of all rows: ``--hot 0.33``).

usage: python scripts/make_scaled.py SRC_SF_DIR K OUT_DIR [FILES] [--hot F]
then:  BENCH_SF_DIR=OUT_DIR python bench.py
       python scripts/skew_check.py OUT_DIR
"""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from cellscope.session import local_session  # noqa: E402

HOT_USER_ID = -1


def main():
    args = sys.argv[1:]
    hot = 0.0
    if "--hot" in args:
        i = args.index("--hot")
        hot = float(args[i + 1])
        del args[i:i + 2]
    src, k, out = args[0], int(args[1]), args[2]
    files = int(args[3]) if len(args) > 3 else 32
    spark = local_session(8)
    ev = spark.read.parquet(f"{src}/events.parquet")
    span = ev.agg(F.max("user_id") + 1, F.max("event_id") + 1).first()
    users, events = int(span[0]), int(span[1])
    rep = F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("_r")
    user = F.col("user_id") + F.col("_r") * users
    if hot > 0:
        user = F.when(F.rand(7) < hot, F.lit(HOT_USER_ID)).otherwise(user)
    big = (ev.select("*", rep)
           .select((F.col("event_id") + F.col("_r") * events).alias("event_id"), "ts",
                   user.alias("user_id"), "event_type", "value", "props"))
    os.makedirs(out, exist_ok=False)
    big.repartitionByRange(files, "ts").write.parquet(f"{out}/events.parquet")
    for name in os.listdir(src):
        if name.endswith(".parquet") and name != "events.parquet":
            os.symlink(f"{src}/{name}", f"{out}/{name}")
    spark.stop()


if __name__ == "__main__":
    main()
