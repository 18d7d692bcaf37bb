"""Replies of judges as they come in: one retry for a malformed reply, one final record for each key, whatever restarts in between."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import records

REPLY = "key string, at timestamp, line long, text string, finish_reason string"
OUTCOME = "key string, event string, status string, edit int, preservation int, quality int, attempts int, error string"
#: JSON of a list of key, attempts, whether it is done, and until when it is remembered.
STATE = "keys string"
#: Replies after which a key is given up; how long a key may wait for a reply, and is remembered after its record.
TRIES, WAIT = 2, "1 hour"
#: Keys share a state by their hash: each state costs a call of Python and a row of the state store, a key only its replies.
BUCKETS = 4096


def replies(spark: SparkSession, path: str, late: str = WAIT) -> DataFrame:
    """Replies of Parquet files in a folder as a stream, one or more a key."""
    return spark.readStream.schema(REPLY).parquet(path).withWatermark("at", late)


def outcomes(stream: DataFrame, tries: int = TRIES, wait: str = WAIT, buckets: int = BUCKETS) -> DataFrame:
    """What follows from each key's replies, in the order of their times: a `final` row exactly once, a `retry` row for a malformed reply before.

    A well-formed reply makes the status ok; the last of `tries` malformed ones judge_parse_error; no reply within
    `wait` of the last one judge_runtime_error. What comes after the final row is passed over until `wait` has gone by.
    A checkpoint holds for one number of buckets; those of keys each with a state of its own can't be read.
    """
    names = [c.split()[0] for c in OUTCOME.split(", ")]
    pause = int(pd.Timedelta(wait).total_seconds() * 1000)

    def row(key: str, event: str, status: str | None, attempts: int, error: str | None, scores: dict | None = None) -> tuple:
        return (key, event, status, *[(scores or {}).get(a) for a in ("edit", "preservation", "quality")], attempts, error)

    def text(v: object) -> str | None:
        return v if isinstance(v, str) else None

    def step(_: tuple, groups: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = {key: rest for key, *rest in json.loads(state.get[0])} if state.exists else {}
        now = state.getCurrentWatermarkMs()
        came: dict[str | None, list[tuple]] = {}
        for g in groups if not state.hasTimedOut else ():
            there = g["at"].notna()
            ms = g["at"].where(there, pd.Timestamp(0)).astype("datetime64[us]").astype("int64")
            for key, none, at, line, said, reason in zip(g["key"].tolist(), (~there).tolist(), ms.tolist(), g["line"].tolist(), g["text"].tolist(), g["finish_reason"].tolist(), strict=True):
                came.setdefault(text(key), []).append((none, at, line, text(said), text(reason)))
        out = []
        for key, rows in came.items():
            attempts, done, _ = known.get(key, (0, False, 0))
            for _, _, _, said, reason in sorted(rows, key=lambda r: r[:3]):
                if done:
                    break
                scores, error = (None, "truncated model response") if reason == "length" else records.parse_reply(said)
                attempts += 1
                done = scores is not None or attempts >= tries
                if done:
                    out.append(row(key, "final", "ok" if scores is not None else "judge_parse_error", attempts, error, scores))
                else:
                    out.append(row(key, "retry", None, attempts, error))
            last = max((at // 1000 for none, at, *_ in rows if not none), default=0)
            known[key] = (attempts, done, max(last, now) + pause)
        for key in [k for k, (*_, until) in known.items() if until < now]:  # those are not among the keys that came
            attempts, done, _ = known.pop(key)
            if not done:
                out.append(row(key, "final", "judge_runtime_error", attempts, "no reply"))
        if known:
            state.update((json.dumps([[k, *rest] for k, rest in known.items()], ensure_ascii=False),))
            state.setTimeoutTimestamp(min(until for *_, until in known.values()))
        else:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=names, dtype=object)

    dealt = stream.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))
    return dealt.groupBy("bucket").applyInPandasWithState(step, OUTCOME, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def run_available(spark: SparkSession, source: str, path: str, checkpoint: str, **limits: int) -> None:
    """Handle all replies that are there, then stop; the next call goes on where this one ended, or where it was cut off."""
    stream = outcomes(replies(spark, source, limits.pop("late", WAIT)), **limits)
    stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path).awaitTermination()


def finals(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(OUTCOME).parquet(path).filter(F.col("event") == "final")
