"""``python tests/check_oracle.py FOLDER [name ...]``: run queries against their SQL and report."""

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from oracle import compare, connect  # noqa: E402

from stratastats.session import local_session  # noqa: E402
from stratastats.workload import ORACLE, QUERIES  # noqa: E402


def main() -> int:
    folder, wanted = sys.argv[1], sys.argv[2:] or list(QUERIES)
    spark, con = local_session("check"), connect(folder)
    failures = 0
    for name in wanted:
        begin = time.time()
        try:
            if name in ORACLE:
                n, bad = compare(spark, con, folder, QUERIES[name], ORACLE[name])
            else:
                n, bad = QUERIES[name](spark, folder).count(), []
        except Exception as e:  # report and go on with the next query
            n, bad = -1, [str(e)[:1500]]
        failures += bool(bad)
        print(f"{'FAIL' if bad else 'ok  '} {name} rows={n} {time.time() - begin:.2f}s", flush=True)
        for b in bad:
            print("     ", b)
    print(f"{len(wanted)} queries, {failures} failed")
    return 1 if failures else 0


if __name__ == "__main__":
    sys.exit(main())
