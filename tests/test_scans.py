"""Look-backs and quantiles must not depend on how a key is sliced."""

import random

import numpy as np
from pyspark.sql import functions as F

from paceline.functions.quantiles import group_quantiles
from paceline.functions.scans import preceding_max, previous_row, running_total


def rows(seed=1, n=400):
    r = random.Random(seed)
    # one key holds most rows
    return [("hot" if r.random() < 0.7 else f"k{r.randrange(5)}", i, r.randrange(50)) for i in range(n)]


def by_key(data):
    out = {}
    for k, i, v in data:
        out.setdefault(k, []).append((i, v))
    return out


def test_previous_row(spark):
    data = rows()
    df = spark.createDataFrame(data, "k string, i long, v long").withColumn("s", F.floor(F.col("i") / 7))
    got = {(r.k, r.i): r.prev_v for r in previous_row(df, ["k"], "s", [F.col("i")], ["v"]).collect()}
    for k, xs in by_key(data).items():
        for (i, _), prev in zip(xs, [None] + [v for _, v in xs[:-1]]):
            assert got[(k, i)] == prev


def test_running_total_and_preceding_max(spark):
    data = rows(2)
    df = spark.createDataFrame(data, "k string, i long, v long").withColumn("s", F.floor(F.col("i") / 11))
    tot = {(r.k, r.i): r.t for r in running_total(df, ["k"], "s", [F.col("i")], "v", "t").collect()}
    mx = {(r.k, r.i): r.m for r in preceding_max(df, ["k"], "s", [F.col("i")], "v", "m").collect()}
    for k, xs in by_key(data).items():
        total, top = 0, None
        for i, v in xs:
            assert mx[(k, i)] == top
            total, top = total + v, v if top is None else max(top, v)
            assert tot[(k, i)] == total


def test_group_quantiles(spark):
    data = [(k, float(v) / 3 - 5) for k, _, v in rows(3)]
    df = spark.createDataFrame(data, "k string, v double")
    got = {r.k: r for r in group_quantiles(df, ["k"], "v", {"med": 0.5, "p95": 0.95}, 2.0).collect()}
    for k in {k for k, _ in data}:
        xs = [v for q, v in data if q == k]
        assert got[k].n == len(xs)
        assert abs(got[k].med - np.quantile(xs, 0.5)) < 1e-9 and abs(got[k].p95 - np.quantile(xs, 0.95)) < 1e-9
