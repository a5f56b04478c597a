"""Answer logs: last line wins, case verdicts, cells, exact intervals, pending work, costs, budgets.

runs: seq, case_id, model, arm, rep, correct (nullable boolean), cost, error (nullable)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import citations as C
from ..functions import text as T

KEY = ["case_id", "model", "arm", "rep"]


def latest(runs: DataFrame) -> DataFrame:
    """Of each key the line with the greatest seq."""
    rest = [c for c in runs.columns if c not in KEY]
    return runs.groupBy(*KEY).agg(F.max_by(F.struct(*rest), "seq").alias("r")).select(*KEY, "r.*")


def case_verdicts(last: DataFrame) -> DataFrame:
    """model, arm, case_id, runs, wrong_runs, scored, wrong (more than half of all runs), any_wrong, excluded, strict_wrong
    (unparseable counted as wrong)."""
    out = last.groupBy("model", "arm", "case_id").agg(F.count("*").alias("runs"), F.count_if(F.col("correct") == False).alias("wrong_runs"), F.count("correct").alias("scored"))  # noqa: E712
    return out.select("*", (F.col("wrong_runs") * 2 > F.col("runs")).alias("wrong"), (F.col("wrong_runs") > 0).alias("any_wrong"), (F.col("scored") == 0).alias("excluded"), ((F.col("wrong_runs") + F.col("runs") - F.col("scored")) * 2 > F.col("runs")).alias("strict_wrong"))


def cells(runs: DataFrame) -> DataFrame:
    """model, arm (null: over all of these), cases, excluded, wrong, any_wrong, runs, unparseable, errors, cost (of all lines)."""
    last = latest(runs)
    by_case = case_verdicts(last).join(last.groupBy("model", "arm", "case_id").agg(F.count("error").alias("errors")), ["model", "arm", "case_id"])
    sums = by_case.rollup("model", "arm").agg(F.count("*").alias("cases"), F.count_if("excluded").alias("excluded"), F.count_if(F.col("wrong") & ~F.col("excluded")).alias("wrong"), F.count_if("any_wrong").alias("any_wrong"), F.sum("runs").alias("runs"), F.sum(F.col("runs") - F.col("scored")).alias("unparseable"), F.sum("errors").alias("errors"))
    cost = runs.rollup("model", "arm").agg((F.floor(F.sum("cost") * 100 + 0.5) / 100).alias("cost"))
    same = sums["model"].eqNullSafe(cost["model"]) & sums["arm"].eqNullSafe(cost["arm"])
    return sums.join(cost, same).select(*[sums[c] for c in sums.columns], "cost")


def _beta_tail(k: int, n: int, p: float) -> float:
    """P(X >= k) for n trials of chance p."""
    if k <= 0:
        return 1.0
    if p <= 0 or p >= 1:
        return float(p >= 1)
    i = np.arange(k, n + 1)
    log = [math.lgamma(n + 1) - math.lgamma(x + 1) - math.lgamma(n - x + 1) for x in i.tolist()]
    return float(np.exp(np.asarray(log) + i * math.log(p) + (n - i) * math.log1p(-p)).sum())


def clopper_pearson(k: int, n: int, alpha: float = 0.05) -> tuple[float, float]:
    """The exact interval of k of n, by halving."""

    def solve(f) -> float:
        low, high = 0.0, 1.0
        for _ in range(80):
            mid = (low + high) / 2
            low, high = (mid, high) if f(mid) else (low, mid)
        return (low + high) / 2

    lower = 0.0 if k == 0 else solve(lambda p: _beta_tail(k, n, p) < alpha / 2)
    upper = 1.0 if k == n else solve(lambda p: 1 - _beta_tail(k + 1, n, p) > alpha / 2)
    return lower, upper


def with_interval(counts: DataFrame, alpha: float = 0.05) -> DataFrame:
    """counts (k, n) with lower, upper (4 places) and decision; solved once for each different pair."""

    def run(k: pd.Series, n: pd.Series) -> pd.DataFrame:
        out = [clopper_pearson(int(a), int(b), alpha) if b else (0.0, 1.0) for a, b in zip(k, n, strict=True)]
        return pd.DataFrame(np.floor(np.asarray(out).reshape(-1, 2) * 1e4 + 0.5) / 1e4, columns=["lower", "upper"])

    solved = counts.select("k", "n").distinct().withColumn("i", F.pandas_udf(run, "lower double, upper double")("k", "n"))
    decision = F.when(F.col("lower") >= 0.05, "go").when((F.col("n") < 45) & (F.col("k") >= 1), "undecided").otherwise("not supported")
    return counts.join(solved, ["k", "n"]).select(*counts.columns, F.col("i.lower").alias("lower"), F.col("i.upper").alias("upper")).withColumn("decision", decision)


def pending(cases: DataFrame, models: DataFrame, arms: DataFrame, reps: int, runs: DataFrame) -> DataFrame:
    """case_id, model, arm, rep still to do. cases may be large; models, arms and repetitions are the columns of a plan."""
    plan = cases.select("case_id").join(F.broadcast(models.select("model"))).join(F.broadcast(arms.select("arm"))).withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps))))
    return plan.join(latest(runs).filter("error is null").select(*KEY), KEY, "left_anti")


def estimates(runs: DataFrame, factor: float = 1.5, fallback: float = 0.1) -> DataFrame:
    """model, arm, estimate: mean cost of good calls times a factor, else the greatest of the arm, else a constant."""
    mean = runs.groupBy("model", "arm").agg((F.avg(F.when(F.col("error").isNull(), F.col("cost"))) * factor).alias("own"))
    top = F.max("own").over(Window.partitionBy("arm"))
    return mean.select("model", "arm", (F.floor(F.coalesce("own", top, F.lit(fallback)) * 1e6 + 0.5) / 1e6).alias("estimate"))


def within_budget(plan: DataFrame, cap: float) -> DataFrame:
    """plan (key, seq, estimate): the rows before the first that would exceed the cap, by key."""
    order = Window.partitionBy("key").orderBy("seq")
    summed = plan.withColumn("spent", F.sum("estimate").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return summed.withColumn("over", F.max((F.col("spent") > cap).cast("int")).over(order)).filter("over = 0").drop("over")


def project_cost(runs: DataFrame, prices: DataFrame) -> DataFrame:
    """target, arm (null: all of these), cost of the same calls by another model: mean tokens times its prices, and the mean fee
    as it was, times the calls. runs: arm, tokens_in, tokens_out, fee; prices (a price list): target, price_in, price_out."""
    mean = runs.groupBy("arm").agg(F.count("*").alias("calls"), F.avg("tokens_in").alias("i"), F.avg("tokens_out").alias("o"), F.avg("fee").alias("fee"))
    priced = mean.join(F.broadcast(prices)).withColumn("cost", F.col("calls") * (F.col("i") * F.col("price_in") + F.col("o") * F.col("price_out") + F.col("fee")))
    return priced.rollup("target", "arm").agg((F.floor(F.sum("cost") * 100 + 0.5) / 100).alias("cost")).filter("target is not null")


# Scores ---------------------------------------------------------------------------------------------------------------


def score(runs: DataFrame, cases: DataFrame) -> DataFrame:
    """runs with checks (map of check to boolean) and correct (all of them; null where nothing was parsed). runs: case_id, parsed (struct of
    date, version, article, quote, answer, verdict; null if unparseable); cases: case_id, kind, expected (struct of date, version,
    articles, verdict, claim). A case that expects nothing is answered right."""
    accepted = cases.select("case_id", F.explode("expected.articles").alias("article"))
    accepted = C.with_ids(accepted, "article", "id").groupBy("case_id").agg(F.collect_set(F.coalesce("id", "article")).alias("accepted"))
    told = cases.select("case_id", "kind", "expected").join(accepted, "case_id", "left")
    held = C.with_cited(runs.withColumn("__article", F.col("parsed.article")), "__article", "__id").join(told, "case_id", "left")
    same = lambda a, b: F.coalesce(a == b, F.lit(False))
    low = lambda c: F.lower(F.trim(c))
    p, e = F.col("parsed"), F.col("expected")
    judged = F.col("kind") == "evaluation"
    below = F.coalesce(F.exists("accepted", lambda x: (F.col("__id") == x) | F.startswith(F.col("__id"), F.concat(x, F.lit(".")))), F.lit(False))
    checks = [
        ("verdict", judged, same(low(p["verdict"]), low(e["verdict"]))),
        ("date", ~judged & e["date"].isNotNull(), same(T.parse_date(p["date"]), F.coalesce(T.parse_date(e["date"]), e["date"]))),
        ("version", ~judged & e["version"].isNotNull(), same(T.named_version(p["version"]), F.coalesce(T.named_version(e["version"]), e["version"]))),
        ("article", ~judged & e["articles"].isNotNull(), below),
        ("claim", e["claim"].isNotNull(), T.claim_holds(e["claim"], p["answer"])),
    ]
    made = F.map_from_entries(F.array_compact(F.array(*[F.when(asked, F.struct(F.lit(name).alias("key"), holds.alias("value"))) for name, asked, holds in checks])))
    none = F.expr("cast(map() as map<string, boolean>)")
    out = held.withColumn("checks", F.when(p.isNull(), none).otherwise(made))
    return out.withColumn("correct", F.when(p.isNotNull(), F.forall(F.map_values("checks"), lambda x: x))).select(*runs.columns, "checks", "correct")


def rescored(runs: DataFrame, cases: DataFrame) -> DataFrame:
    """runs (with old checks and correct) scored anew, and changed: whether the score is another than the stored one."""
    fresh = score(runs.withColumnRenamed("checks", "__checks").withColumnRenamed("correct", "__correct"), cases)
    sorted_ = lambda m: F.array_sort(F.map_entries(m))
    same = F.col("correct").eqNullSafe(F.col("__correct")) & sorted_("checks").eqNullSafe(sorted_("__checks"))
    return fresh.withColumn("changed", ~same).drop("__checks", "__correct")


def cells_by(runs: DataFrame, *strata: str) -> DataFrame:
    """As cells, of each model and arm, and of each value of each stratum (columns of runs that are one for each case): model, arm, the
    strata (null: over all), cases, excluded, wrong, any_wrong, strict_wrong, runs, unparseable, errors."""
    last = latest(runs)
    key = ["model", "arm", *strata, "case_id"]
    by_case = last.groupBy(*key).agg(F.count("*").alias("runs"), F.count_if(F.col("correct") == False).alias("wrong_runs"), F.count("correct").alias("scored"), F.count("error").alias("errors"))  # noqa: E712
    wrong, unscored = F.col("wrong_runs") * 2 > F.col("runs"), F.col("runs") - F.col("scored")
    sets = [[F.col("model"), F.col("arm")], *[[F.col("model"), F.col("arm"), F.col(s)] for s in strata]]
    sums = {
        "cases": F.count_if(F.col("scored") > 0), "excluded": F.count_if(F.col("scored") == 0), "wrong": F.count_if(wrong & (F.col("scored") > 0)), "any_wrong": F.count_if(F.col("wrong_runs") > 0),
        "strict_wrong": F.count_if((F.col("wrong_runs") + unscored) * 2 > F.col("runs")), "runs": F.sum("runs"), "unparseable": F.sum(unscored), "errors": F.sum("errors"),
    }
    return by_case.groupingSets(sets, "model", "arm", *strata).agg(F.grouping_id().alias("level"), *[v.alias(k) for k, v in sums.items()]).drop("level")


def tool_use(runs: DataFrame, arm: str) -> DataFrame:
    """model, rate (runs with a tool call, 4 places), and of the runs with and without one: scored and wrong. runs: tool_calls (a number)."""
    last = latest(runs).filter(F.col("arm") == arm)
    used, wrong = F.col("tool_calls") > 0, F.col("correct") == False  # noqa: E712
    out = last.groupBy("model").agg((F.floor(F.count_if(used) / F.count("*") * 1e4 + 0.5) / 1e4).alias("rate"), F.count(F.when(used, F.col("correct"))).alias("scored_with"), F.count_if(used & wrong).alias("wrong_with"), F.count(F.when(~used, F.col("correct"))).alias("scored_without"), F.count_if(~used & wrong).alias("wrong_without"))
    return out


def versions_named(runs: DataFrame) -> DataFrame:
    """model, arm, n (parsed runs), and how many of them name the older version, the newer, both or none."""
    last = latest(runs).filter("parsed is not null").withColumn("named", T.version_named(F.col("parsed.version")))
    of = {"older": F.col("named") == T.OLDER, "newer": F.col("named") == T.NEWER, "both": F.col("named") == "both", "none": F.col("named").isNull()}
    return last.groupBy("model", "arm").agg(F.count("*").alias("n"), *[F.count_if(v).alias(k) for k, v in of.items()])
