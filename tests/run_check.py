"""Command line: python tests/run_check.py SF_DIR [name-prefix ...]"""

import pathlib
import sys
import time

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent))

import __spark_entry__ as entry  # noqa: E402
from compare import duck, mismatch  # noqa: E402

from firmlens.session import local_session  # noqa: E402


def main(sf_dir: str, prefixes: list[str]) -> int:
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        t0 = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in oracles:
                diff = mismatch(df, con, oracles[name])
            else:
                n = df.count()
                diff = None if n else "no rows"
        except Exception as e:  # report and go on with the next query
            diff = f"{type(e).__name__}: {str(e)[:700]}"
        tag = "ok  " if diff is None else "FAIL"
        bad += diff is not None
        print(f"{tag} {name} {time.time() - t0:.1f}s {'' if name in oracles else '(rows only) '}{diff or ''}", flush=True)
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
