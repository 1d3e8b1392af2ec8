"""Run registered queries against their SQL: python tests/check_all.py [sf_dir] [name-prefix ...]"""

import sys
import time
from pathlib import Path

sys.path[:0] = [str(Path(__file__).resolve().parent), str(Path(__file__).resolve().parents[1])]

from compare import difference, duck  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from tidemark.session import build_session  # noqa: E402


def main(sf_dir: str, prefixes: list[str]) -> int:
    spark = build_session("check", "local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    oracles, bad = entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if prefixes and not name.startswith(tuple(prefixes)):
            continue
        started = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in oracles:
                problem = difference(df, con, oracles[name])
                mark = "ok  " if problem is None else "BAD "
            else:
                problem, mark = f"{df.count()} rows", "rows"
        except Exception as exc:  # report and go on with the next query
            mark, problem = "ERR ", f"{type(exc).__name__}: {str(exc)[:600]}"
        bad += mark in ("BAD ", "ERR ")
        print(f"{mark} {name} {time.time() - started:.1f}s {problem or ''}", flush=True)
    print("problems:", bad)
    return bad


if __name__ == "__main__":
    args = sys.argv[1:]
    sys.exit(main(args[0] if args else "/root/testdata/sf0.01", args[1:]) > 0)
