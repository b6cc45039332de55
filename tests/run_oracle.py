"""Command line form of the comparison: ``python tests/run_oracle.py [sf_dir] [names...]``."""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from feedmill.plans import catalog  # noqa: E402
from feedmill.session import local_session  # noqa: E402
from tests.oracle import compare, connect  # noqa: E402

sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
names = sys.argv[2:]
spark = local_session(8)
spark.sparkContext.setLogLevel("ERROR")
con = connect(sf_dir)
bad = 0
for name, q in catalog.load().items():
    if names and name not in names:
        continue
    start = time.time()
    try:
        frame = q.run(spark, sf_dir)
        problems = compare(frame, con, q.sql) if q.sql else ([] if frame.count() else ["empty"])
    except Exception as e:  # noqa: BLE001
        problems = [f"{type(e).__name__}: {str(e)[:700]}"]
    bad += bool(problems)
    print(f"{'BAD' if problems else 'ok '} {name:30s} {time.time() - start:5.1f}s {'' if q.sql else '(rows only)'}", *problems, flush=True)
print(f"{len(catalog.QUERIES)} queries, {bad} bad")
