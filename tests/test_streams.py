"""Judging as a stream: keys share states, and each key's rows are those it would get alone."""

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from brocade.streaming import judging

GOOD = json.dumps({a: 3 for a in ("edit", "preservation", "quality")} | {f"{a}_evidence": "seen" for a in ("edit", "preservation", "quality")})
START, WAIT = dt.datetime(2026, 1, 1), 60


def alone(batches):
    """Outcomes of one key after another; times in minutes, a batch's watermark follows the batch before."""
    told, known, mark = [], {}, -(10**9)
    for batch in batches:
        came = {}
        for at, line, key, good in batch:
            if at > mark:
                came.setdefault(key, []).append((at, line, good))
        for key, rows in came.items():
            tries, done, _ = known.get(key, (0, False, 0))
            for _, _, good in sorted(rows):
                if not done:
                    tries, done = tries + 1, good or tries == 1
                    told.append((key, "final" if done else "retry", ("ok" if good else "judge_parse_error") if done else None, tries))
            known[key] = (tries, done, max([mark, *[r[0] for r in rows]]) + WAIT)
        for key in [k for k, v in known.items() if v[2] < mark]:
            tries, done, _ = known.pop(key)
            if not done:
                told.append((key, "final", "judge_runtime_error", tries))
        mark = max([mark, *[r[0] - WAIT for r in batch]])
    return sorted(told, key=str), len(known)


@pytest.mark.filterwarnings("ignore")
def test_keys_share_states(spark, tmp_path):
    rng = np.random.default_rng(3)
    batches = []
    for n in range(3):
        keys = [f"k{k}" for k in rng.integers(0, 120, 90)] + [None, 'a "b"']
        at = rng.integers(100 * n, 100 * n + 90, len(keys))  # some are too late for the watermark
        batches.append([(int(a), n * 1000 + i, k, bool(rng.random() < 0.4)) for i, (k, a) in enumerate(zip(keys, at, strict=True))])
    one = str(tmp_path)
    for batch in batches:
        rows = [(k, START + dt.timedelta(minutes=at), line, GOOD if good else ("{" if line % 2 else None), "stop") for at, line, k, good in batch]
        spark.createDataFrame(rows, judging.REPLY).coalesce(1).write.mode("append").parquet(f"{one}/in")
        judging.run_available(spark, f"{one}/in", f"{one}/out", f"{one}/check", buckets=4)
    got = sorted([(r["key"], r["event"], r["status"], r["attempts"]) for r in spark.read.schema(judging.OUTCOME).parquet(f"{one}/out").collect()], key=str)
    want, known = alone([b for batch in batches for b in (batch, [])])  # after each run's files comes a batch without any
    assert got == want and {"retry", "ok", "judge_parse_error", "judge_runtime_error"} <= {x for r in got for x in r}
    assert spark.read.format("statestore").load(f"{one}/check").count() <= 4 < known  # not a state for each key
