"""Repeated trials of models over reports: the plan and its checks, blind aliases, what is left to run, the summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrasift.operators import metrics

#: Reasoning settings, kinds of input, and the quality marks of a rating.
EFFORTS, INPUTS, MARKS = ("low", "medium", "high", "xhigh"), ("pdf", "docx", "txt"), 5


def plan_issues(plan: DataFrame, models: DataFrame, reports: DataFrame) -> DataFrame:
    """plan, code: what keeps a plan from being run.

    plan: plan, repeats. models: plan, model, effort (or null). reports: plan, report, inputs (array of paths).
    Codes: few_repeats, few_models, repeated_model, unknown_effort, few_reports, repeated_report, no_inputs, bad_input.
    """
    m = models.groupBy("plan").agg(F.count("*").alias("m"), F.countDistinct("model").alias("md"), F.count_if(~F.col("effort").isin(*EFFORTS)).alias("bad_effort"))
    odd = F.exists("inputs", lambda p: ~F.lower(F.substring_index(p, ".", -1)).isin(*INPUTS))
    r = reports.groupBy("plan").agg(F.count("*").alias("r"), F.countDistinct("report").alias("rd"), F.count_if(F.coalesce(F.size("inputs"), F.lit(0)) <= 0).alias("empty"), F.count_if(F.coalesce(odd, F.lit(False))).alias("odd"))
    j = plan.join(m, "plan", "left").join(r, "plan", "left").fillna(0)
    rules = {
        "few_repeats": F.col("repeats") < 2,
        "few_models": F.col("md") < 2,
        "repeated_model": F.col("m") > F.col("md"),
        "unknown_effort": F.col("bad_effort") > 0,
        "few_reports": F.col("r") < 2,
        "repeated_report": F.col("r") > F.col("rd"),
        "no_inputs": F.col("empty") > 0,
        "bad_input": F.col("odd") > 0,
    }
    broken = F.filter(F.array(*(F.when(v, F.lit(k)) for k, v in rules.items())), lambda x: x.isNotNull())
    return j.select("plan", F.explode(broken).alias("code"))


def jobs(models: DataFrame, reports: DataFrame, repeats: int, seed: int) -> DataFrame:
    """plan, model, report, repetition, place, alias: a job for each, in the order of running (all reports of a model before the
    next model) and with an alias C001.. from a seeded order that tells nothing about either.

    models: plan, model, pos. reports: plan, report, pos. A plan is the unit of both orders and small.
    """
    j = models.select("plan", "model", F.col("pos").alias("_m")).join(reports.select("plan", "report", F.col("pos").alias("_r")), "plan")
    j = j.withColumn("repetition", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    of = Window.partitionBy("plan")
    drawn = F.sha2(F.concat_ws("/", F.lit(seed).cast("string"), "model", "report", "repetition"), 256)
    j = j.withColumn("place", F.row_number().over(of.orderBy("_m", "_r", "repetition"))).withColumn("alias", F.format_string("C%03d", F.row_number().over(of.orderBy(drawn))))
    return j.select("plan", "model", "report", "repetition", "place", "alias")


def unchanged(inputs: DataFrame, now: DataFrame) -> DataFrame:
    """path, code of inputs (path, sha256) that have gone or differ from what the plan has seen."""
    j = inputs.join(now.select("path", F.col("sha256").alias("_now")), "path", "left")
    code = F.when(F.col("_now").isNull(), "gone").when(F.col("_now") != F.col("sha256"), "changed")
    return j.select("path", code.alias("code")).filter("code is not null")


def left_to_run(planned: DataFrame, results: DataFrame) -> DataFrame:
    """alias, place, state of jobs without a result, in order: `interrupted` ones need a look before they run again.

    results: alias, state (running or completed).
    """
    j = planned.join(results.select("alias", "state"), "alias", "left").filter(~F.col("state").eqNullSafe("completed"))
    return j.select("alias", "place", F.when(F.col("state") == "running", "interrupted").otherwise("pending").alias("state"))


def summary(runs: DataFrame, ratings: DataFrame, by: list[str]) -> DataFrame:
    """The same figures by each key on its own. runs: alias, keys, wall, ready, candidate, calls, first_pass. ratings: alias, mark
    (0 to 4, else an error); a run counts as rated only with all MARKS marks. Ratios over nothing are null."""
    ok = F.when(F.col("mark").between(0, 4), F.col("mark")).when(F.col("mark").isNotNull(), F.raise_error(F.lit("a mark must be from 0 to 4")).cast("double"))
    quality = ratings.groupBy("alias").agg(F.sum(ok).alias("_q"), F.count("mark").alias("_n")).select("alias", F.when(F.col("_n") == MARKS, F.col("_q")).alias("quality"))
    r = runs.join(quality, "alias", "left")
    over = lambda a, b: F.when(b > 0, a / b)
    return metrics.by_each(
        r,
        by,
        F.count("*").alias("runs"),
        F.count_if("ready").alias("n_ready"),
        F.avg("wall").alias("mean_wall"),
        over(F.sum("wall"), F.count_if("candidate")).alias("seconds_per_candidate"),
        over(F.sum("first_pass"), F.sum("calls")).alias("first_pass_rate"),
        F.avg("quality").alias("quality"),
        F.count("quality").alias("rated"),
    )
