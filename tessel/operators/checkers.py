"""Checkers of transaction and register histories, and latency summaries."""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def expected_versions(reads: DataFrame, versions: DataFrame, key: str, read_ts: str, commit_ts: str) -> DataFrame:
    """reads with expected_version: the newest commit of the key at or before read_ts, null if none.

    Reads and versions of a key are put on one time line, and the last commit seen so far is
    carried along: one shuffle on the key and no range join, whose pairs would grow with the square
    of a key's history.
    """
    cols = [c for c in reads.columns if c != key]
    line = reads.select(F.col(key), F.col(read_ts).alias("_ts"), F.lit(1).alias("_kind"), F.lit(None).cast(versions.schema[commit_ts].dataType).alias("_commit"), F.struct(*cols).alias("_row"))
    line = line.unionByName(versions.select(F.col(key), F.col(commit_ts).alias("_ts"), F.lit(0).alias("_kind"), F.col(commit_ts).alias("_commit")), allowMissingColumns=True)
    by = Window.partitionBy(key).orderBy("_ts", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    seen = line.withColumn("expected_version", F.max("_commit").over(by)).filter("_kind = 1")
    return seen.select(key, *(F.col("_row")[c].alias(c) for c in cols), "expected_version")


def snapshot_read_errors(reads: DataFrame, versions: DataFrame) -> DataFrame:
    """Reads (txn, key, read_ts, version, own_write) whose version is not what a snapshot shows.
    versions: key, commit_ts. A read of the transaction's own write is not checked here."""
    checked = expected_versions(reads, versions, "key", "read_ts", "commit_ts")
    return checked.filter(~F.coalesce("own_write", F.lit(False)) & ~F.col("version").eqNullSafe(F.col("expected_version")))


def lost_updates(writes: DataFrame, key: str = "key", read_ts: str = "read_ts", commit_ts: str = "commit_ts") -> DataFrame:
    """Committed writes that break first-committer-wins: another write of the key was committed
    after this transaction's snapshot and before its commit. previous_commit is the latest such."""
    by = Window.partitionBy(key).orderBy(commit_ts).rangeBetween(Window.unboundedPreceding, -1)
    before = writes.withColumn("previous_commit", F.max(commit_ts).over(by))
    return before.filter(F.col("previous_commit") > F.col(read_ts))


def nearest_rank(df: DataFrame, value: str, quantiles: Sequence[float], groups: Sequence[str] = ()) -> DataFrame:
    """Nearest-rank percentiles: the ceil(q * n)-th of the sorted values, with count, min, max and
    mean, one row a group, and one row without groups. Nulls are left out. Equal values are counted first, so that only distinct
    values are ranked."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count("*").alias("_n"))
    by = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    up = counts.withColumn("_upto", F.sum("_n").over(by.orderBy(value))).withColumn("_all", F.sum("_n").over(by))
    cuts = [
        F.min(F.when(F.col("_upto") >= F.greatest(F.lit(1), F.ceil(F.col("_all") * F.lit(q))), F.col(value))).alias(f"p{q * 100:g}".replace(".", "_"))
        for q in quantiles
    ]
    mean = (F.sum(F.col(value) * F.col("_n")) / F.sum("_n")).alias("mean")
    return up.groupBy(*groups).agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("count"), F.min(value).alias("min"), F.max(value).alias("max"), mean, *cuts)


#: Operations of one history that the search covers.
MAX_OPERATIONS = 63


def linearizable(operations: Sequence[dict]) -> bool:
    """Whether a register history has an order that agrees with real time and with every output.

    op is get (output: value read), put (input: value) or cas (input: [expected, new]; output:
    whether it took place), with start <= end, on one key each; registers start as None.
    """
    if len(operations) > MAX_OPERATIONS:
        raise ValueError(f"a history has at most {MAX_OPERATIONS} operations")
    return all(_one_register([o for o in operations if o["key"] == k]) for k in {o["key"] for o in operations})


def _one_register(ops: list[dict]) -> bool:
    ops = sorted(ops, key=lambda o: (o["start"], o["end"]))
    everything = (1 << len(ops)) - 1
    failed: set[tuple[int, object]] = set()
    stack: list[tuple[int, object]] = [(0, None)]
    while stack:
        done, value = stack.pop()
        if done == everything:
            return True
        if (done, _frozen(value)) in failed:
            continue
        failed.add((done, _frozen(value)))
        open_ = [i for i in range(len(ops)) if not done >> i & 1]
        first_end = min(ops[i]["end"] for i in open_)
        for i in open_:
            if ops[i]["start"] > first_end:
                break  # another operation was over before this one began
            ok, after = _apply(ops[i], value)
            if ok:
                stack.append((done | 1 << i, after))
    return False


def _frozen(v: object) -> object:
    return tuple(v) if isinstance(v, list) else v


def _apply(op: dict, value: object) -> tuple[bool, object]:
    if op["op"] == "get":
        return op["output"] == value, value
    if op["op"] == "put":
        return True, op["input"]
    expected, new = op["input"]
    took = value == expected
    return bool(op["output"]) == took, new if took else value


def linearizable_histories(histories: DataFrame) -> DataFrame:
    """history, operations, linearizable of many histories (history, op, key, input, expected,
    output, start, end), all values text, each checked in one task; of one with too many operations
    the verdict is null."""

    def check(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.astype(object).where(pdf.notna(), None)
        ops = []
        for r in pdf.to_dict("records"):
            o = {"op": r["op"], "key": r["key"], "start": int(r["start"]), "end": int(r["end"]), "output": r["output"], "input": r["input"]}
            if r["op"] == "cas":
                o |= {"input": [r["expected"], r["input"]], "output": str(r["output"]).lower() == "true"}
            ops.append(o)
        ok = linearizable(ops) if len(ops) <= MAX_OPERATIONS else None
        return pd.DataFrame({"history": [pdf["history"].iloc[0]], "operations": [len(ops)], "linearizable": [ok]})

    kind = histories.schema["history"].dataType.simpleString()
    return histories.groupBy("history").applyInPandas(check, f"history {kind}, operations long, linearizable boolean")


def percentile(values: Sequence[float], q: float) -> float:
    """The nearest-rank percentile of a few values."""
    if not values:
        raise ValueError("no values")
    return sorted(values)[max(1, ceil(q * len(values))) - 1]
