"""Review of one attempt against a baseline: facts, catalogue, contract check, request ledger.

Results are codes, not sentences: wording belongs to whoever shows them.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X

FACTS = ["timing_state", "total_s", "movement_s", "reviewed_hold10", "bottom_s", "top_s", "speed_coverage", "floor_total_s", "floor_bottom_s", "floor_top_s"]


def fact_pairs(pairs: DataFrame) -> DataFrame:
    """JN29: facts of an attempt (struct ``c``) next to its baseline's (struct ``b``); they travel in the pair."""
    return pairs.select(F.col("c.attempt_id").alias("attempt_id"), F.col("b.attempt_id").alias("baseline_id"), F.col("c.facts").alias("c"), F.col("b.facts").alias("b")).where("c is not null")


def facts_violation(v: str = "c") -> Column:
    """AG40: first broken rule of a facts record, NULL when it keeps the contract."""
    g = lambda k: F.col(f"{v}.{k}")
    opt = lambda k, lo, hi: g(k).isNull() | X.truthy(g(k).between(lo, hi))
    bounds = X.all_of(opt("total_s", 0.001, 600), opt("movement_s", 0, 30), opt("bottom_s", 0.001, 600), opt("top_s", 0.001, 600), opt("speed_coverage", 0, 1))
    ok = g("timing_state") == "accepted"
    floors = X.truthy(g("floor_total_s").between(0.1, 600)) & F.when(g("reviewed_hold10"), X.truthy(g("floor_bottom_s").between(0.1, 600) & g("floor_top_s").between(0.1, 600))).otherwise(g("floor_bottom_s").isNull() & g("floor_top_s").isNull())
    empty = X.all_of(*[g(k).isNull() for k in ("total_s", "movement_s", "bottom_s", "top_s", "speed_coverage")]) & ~g("reviewed_hold10")
    return X.when_chain([
        (~g("timing_state").isin("missing-start", "missing-finish", "review", "accepted"), "state"), (~bounds, "bounds"), (~floors, "floors"), (~ok & ~empty, "values-without-timing"),
        (ok & g("total_s").isNull(), "no-total"), (ok & X.truthy(g("movement_s") > g("total_s")), "movement-after-finish"), (ok & ~g("reviewed_hold10") & (g("bottom_s").isNotNull() | g("top_s").isNotNull()), "phases-not-reviewed"),
        (ok & g("reviewed_hold10") & ~X.truthy(F.abs(g("bottom_s") + g("top_s") - g("total_s")) < 0.005), "phase-sum")])


def upgrade_facts(df: DataFrame) -> DataFrame:
    """AG40: a version 1 record has one shared floor; it becomes the floor of every interval it covers."""
    one = F.col("shared_floor_s")
    phase = F.when(F.col("reviewed_hold10"), one)
    return df.withColumns({"floor_total_s": F.coalesce("floor_total_s", one), "floor_bottom_s": F.coalesce("floor_bottom_s", phase), "floor_top_s": F.coalesce("floor_top_s", phase)})


def catalogue(fp: DataFrame, goal: str = "goal") -> DataFrame:
    """AG38 and TOP9: headline, compared intervals, observations, tasks, limits and the default plan."""
    c, b = (lambda k: F.col(f"c.{k}")), (lambda k: F.col(f"b.{k}"))
    ok = c("timing_state") == "accepted"
    base = ok & X.truthy(b("timing_state") == "accepted")
    phases = base & c("reviewed_hold10") & X.truthy(b("reviewed_hold10"))

    def row(on, k):
        d = X.round_ms(c(f"{k}_s") - b(f"{k}_s"))
        fl = F.greatest(c(f"floor_{k}_s"), b(f"floor_{k}_s"), F.lit(0.1))
        return F.when(on, F.struct(d.alias("delta_s"), fl.alias("threshold_s"), F.when(F.abs(d) <= fl + 1e-9, "similar").when(d < 0, "shorter").otherwise("longer").alias("outcome")))
    df = fp.withColumns({"total_row": row(base, "total"), "bottom_row": row(phases, "bottom"), "top_row": row(phases, "top")})
    changed = lambda k: X.truthy(F.col(f"{k}_row.outcome") != "similar")
    opposed = changed("bottom") & changed("top") & X.truthy(F.col("bottom_row.outcome") != F.col("top_row.outcome"))
    cov = c("speed_coverage")
    ids = lambda *xs: F.array_compact(F.array(*[F.when(cond, F.lit(i)) for cond, i in xs]))
    df = df.withColumn("observations", ids((ok, "total"), (ok & c("movement_s").isNotNull(), "movement"), (ok & c("reviewed_hold10"), "halves"), (ok & cov.isNotNull(), "tracking"), (base & changed("total"), "total-change"),
                                           (base & ~changed("total"), "no-change"), (changed("bottom"), "bottom-change"), (changed("top"), "top-change"), (opposed, "phase-balance")))
    df = df.withColumn("tasks", ids((~ok, "review-timing"), (ok & c("movement_s").isNull(), "review-movement"), (ok & ~c("reviewed_hold10"), "review-hold10"), (ok & (cov.isNull() | (cov < 0.8)), "improve-recording"),
                                    (base & ~phases & ~X.truthy(b("reviewed_hold10")), "review-baseline-hold10")))
    df = df.withColumn("limits", ids((F.lit(True), "measurement-limits"), (~ok, "timing-review"), (ok & ~c("reviewed_hold10"), "hold10-review"), (ok & cov.isNull(), "tracking-unavailable"), (ok & X.truthy(cov < 0.95), "tracking-gaps"),
                                     (phases, "phase-overlap"), (base & ~phases, "comparison-contact-review"), (base, "comparison-policy"), (ok & ~base, "baseline-missing")))
    d = lambda k: F.when(changed(k), F.abs(F.col(f"{k}_row.delta_s")))
    lead_bottom = changed("bottom") & (~changed("top") | X.truthy(d("bottom") >= d("top")))
    order = F.when(lead_bottom, F.array(F.lit("bottom"), F.lit("top"))).otherwise(F.array(F.lit("top"), F.lit("bottom")))
    phase_ids = F.transform(order, lambda p: F.concat(p, F.lit("-change")))
    lit = lambda *xs: F.array(*[F.lit(x) for x in xs])
    change = lit("total-change", "no-change")
    tail = F.when(F.col(goal) == "halves", lit("halves", "total", "movement")).otherwise(lit("total", "movement", "halves"))
    want = F.when(F.col(goal) == "start", F.concat(change, lit("movement"), phase_ids)).otherwise(F.concat(change, lit("phase-balance"), phase_ids, tail, lit("tracking")))
    # wanted ids first, the rest behind them, three at most
    plan = F.slice(F.array_distinct(F.filter(F.concat(want, F.col("observations")), lambda i: F.array_contains("observations", i))), 1, 3)
    focus = X.when_chain([(~ok, "review-timing"), ((F.col(goal) == "start") & c("movement_s").isNull(), "review-movement"), (F.col(goal) == "start", "review-start"), (F.col(goal) == "consistency", "record-comparable"),
                          (lead_bottom, "review-bottom"), (changed("top"), "review-top"), (~c("reviewed_hold10"), "review-hold10")], F.lit("record-comparable"))
    headline = F.when(~ok, "needs-review").when(base, F.col("total_row.outcome")).otherwise("single-run")
    return df.select("attempt_id", "baseline_id", headline.alias("headline"), F.col("total_row.delta_s").alias("total_delta_s"), F.col("total_row.threshold_s").alias("total_threshold_s"),
                     F.col("bottom_row.outcome").alias("bottom_outcome"), F.col("top_row.outcome").alias("top_outcome"), "observations", "tasks", "limits", plan.alias("default_observations"), focus.alias("focus"))


def section_review(rows: DataFrame) -> DataFrame:
    """JN27: sections that changed between two attempts, from one partition only (phases, else wall thirds).

    ``rows`` comes from ``compare_pairs``; a section counts when both sides and both totals are reliable.
    """
    have = F.col("delta_s").isNotNull()
    phase, third = F.col("metric_id").isin("bottom-phase", "top-phase"), F.col("metric_id").endswith("-third")
    item = F.struct((-F.col("delta_s")).alias("o"), "metric_id", "delta_s", "outcome", "baseline_s", "candidate_s")
    # a pair without its total is left out, so rows without a difference, and of other metrics, decide nothing
    g = rows.where(have & ((F.col("metric_id") == "total") | phase | third)).groupBy("baseline_id", "candidate_id").agg(
        F.bool_or((F.col("metric_id") == "total") & have).alias("_total"), F.count_if(phase & have).alias("_phases"), F.max("comparison_allowed").alias("_ok"),
        F.sort_array(F.collect_list(F.when(have & (phase | third), item))).alias("items"))
    one = F.when(F.col("_phases") == 2, F.filter("items", lambda i: i["metric_id"].endswith("-phase"))).otherwise(F.filter("items", lambda i: i["metric_id"].endswith("-third")))
    return g.where("_total and _ok").select("baseline_id", "candidate_id", F.explode(F.filter(one, lambda i: i["outcome"].isin("gained", "lost"))).alias("i")).select("baseline_id", "candidate_id", "i.metric_id", "i.delta_s", "i.baseline_s", "i.candidate_s")


LEDGER = "owner string, day string, request_id string, fingerprint string, ord bigint, state string"


def _reserve(batches: Iterator[pd.DataFrame], limit: int) -> Iterator[pd.DataFrame]:
    """One pass in (owner, order) order; the memory held is what one owner was granted."""
    owner, asked, known, spent = None, set(), set(), defaultdict(int)
    for b in batches:
        states = []
        for o, day, req, fp in zip(b.owner, b.day, b.request_id, b.fingerprint):
            if o != owner:
                owner, asked, known, spent = o, set(), set(), defaultdict(int)
            if req in asked or fp in known:
                states.append("existing")
            elif spent[day] >= limit:
                states.append("limited")
            else:
                asked.add(req)
                known.add(fp)
                spent[day] += 1
                states.append("created")
        yield b.assign(state=states)[["owner", "day", "request_id", "fingerprint", "ord", "state"]]


def reserve_requests(requests: DataFrame, limit: int) -> DataFrame:
    """AG41: created, existing or limited, per request in order.  ``requests``: owner, day, request_id, fingerprint, ord.

    A grant depends on every earlier grant of its owner, so owners are walked in order.  Repeats of one
    request on one day are folded to their first row before that walk, and answered by a join after it.
    """
    keys = ["owner", "day", "request_id", "fingerprint"]
    first = requests.groupBy(*keys).agg(F.min("ord").alias("ord"))
    walked = first.repartition("owner").sortWithinPartitions("owner", "ord").mapInPandas(lambda it: _reserve(it, limit), LEDGER)
    j = requests.join(walked.select(*keys, F.col("ord").alias("_o"), "state"), keys)
    return j.select(*keys, "ord", F.when((F.col("state") == "created") & (F.col("ord") != F.col("_o")), "existing").otherwise(F.col("state")).alias("state"))
