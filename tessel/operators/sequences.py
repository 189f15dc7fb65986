"""Admission of numbered client requests: each client counts 1, 2, 3, ...; a repeat is answered from the record."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FIRST_NOT_ONE, NEW, DUPLICATE, HASH_MISMATCH, GAP, TOO_OLD = "first_not_one", "new", "duplicate", "hash_mismatch", "gap", "too_old"


def verdict(last: int | None, last_hash: str | None, sequence: int, request_hash: str) -> str:
    """What a request is to a client whose last admitted request is given."""
    if last is None:
        return NEW if sequence == 1 else FIRST_NOT_ONE
    if sequence == last + 1:
        return NEW
    if sequence == last:
        return DUPLICATE if request_hash == last_hash else HASH_MISMATCH
    return GAP if sequence > last else TOO_OLD


def classify(log: DataFrame, client: str, sequence: str, request_hash: str, arrival: Sequence[str]) -> DataFrame:
    """log with the verdict of each request in order of arrival, and the client's last admitted
    sequence before it.

    A verdict depends on all of the client's requests before it, so a client's rows are folded in
    order in one row; clients are dealt by hash.
    """
    by = Window.partitionBy(client).orderBy(*arrival)
    # state after each request: sequence of the last admitted one, folded in order of arrival
    rows = log.withColumn("_at", F.row_number().over(by))
    folded = rows.groupBy(client).agg(F.array_sort(F.collect_list(F.struct("_at", F.col(sequence).cast("long").alias("s"), F.col(request_hash).alias("h")))).alias("r"))
    state = F.struct(F.lit(0).cast("long").alias("last"), F.lit(None).cast("string").alias("hash"), F.array().cast("array<struct<at:int,last:long,verdict:string>>").alias("out"))

    def step(x, r):
        said = (
            F.when((x["last"] == 0) & (r["s"] != 1), FIRST_NOT_ONE).when(r["s"] == x["last"] + 1, NEW)
            .when(r["s"] == x["last"], F.when(r["h"].eqNullSafe(x["hash"]), DUPLICATE).otherwise(HASH_MISMATCH))
            .when(r["s"] > x["last"], GAP).otherwise(TOO_OLD)
        )
        new = said == NEW
        return F.struct(
            F.when(new, r["s"]).otherwise(x["last"]).alias("last"), F.when(new, r["h"].cast("string")).otherwise(x["hash"]).alias("hash"),
            F.concat(x["out"], F.array(F.struct(r["_at"].alias("at"), x["last"].alias("last"), said.alias("verdict")))).alias("out"),
        )

    said = folded.select(client, F.explode(F.aggregate("r", state, step, lambda x: x["out"])).alias("v"))
    said = said.select(client, F.col("v.at").alias("_at"), F.nullif(F.col("v.last"), F.lit(0)).alias("last_admitted"), F.col("v.verdict").alias("verdict"))
    return rows.join(said, [client, "_at"]).drop("_at")
