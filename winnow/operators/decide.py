"""From posterior draws to labels: ensemble means, quantiles, uncertainty zone, review flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnow.functions.numbers import percent, signif
from winnow.schema import LABELS


def oversampled(labelled: DataFrame, target: Column, times: int = 10) -> DataFrame:
    """Positives repeated ``times`` (column copy), others once."""
    n = F.when(target == "y", times).otherwise(1)
    return labelled.withColumn("copy", F.explode(F.sequence(F.lit(1), n)))


def ensemble_mean(draws: DataFrame) -> DataFrame:
    """(id, draw, p): the mean over models of (id, model, draw, p)."""
    return draws.groupBy("id", "draw").agg(F.avg("p").alias("p"))


def posterior_quantiles(draws: DataFrame, quants: tuple[float, float, float] = (0.01, 0.5, 0.99)) -> DataFrame:
    """(id, pred_low, pred_med, pred_up, pred_delta) of (id, draw, p), interpolated quantiles."""
    if not (len(quants) == 3 and all(0 <= q <= 1 for q in quants)):
        raise ValueError("three quantiles between 0 and 1 are needed")
    low, mid, up = sorted(quants)
    q = draws.groupBy("id").agg(F.percentile("p", F.array(F.lit(low), F.lit(mid), F.lit(up))).alias("q"))
    return q.select("id", F.get("q", 0).alias("pred_low"), F.get("q", 1).alias("pred_med"), F.get("q", 2).alias("pred_up"), (F.get("q", 2) - F.get("q", 0)).alias("pred_delta"))


def array_quantiles(draws: DataFrame, quants: tuple[float, float, float] = (0.01, 0.5, 0.99)) -> DataFrame:
    """The same as ``posterior_quantiles`` of (id, p) with all draws of a record in an array: no shuffle."""
    if not (len(quants) == 3 and all(0 <= q <= 1 for q in quants)):
        raise ValueError("three quantiles between 0 and 1 are needed")
    ordered = draws.select("id", F.array_sort("p").alias("o"))

    def at(q: float) -> Column:
        place = F.lit(q) * (F.size("o") - 1)
        low = F.floor(place).cast("int")
        one, two = F.get("o", low), F.get("o", F.ceil(place).cast("int"))
        return one + (two - one) * (place - low)

    out = ordered.select("id", *(at(q).alias(n) for q, n in zip(sorted(quants), ("pred_low", "pred_med", "pred_up"), strict=True)))
    return out.withColumn("pred_delta", F.col("pred_up") - F.col("pred_low"))


def uncertainty_zone(preds: DataFrame, target: str = "target") -> DataFrame:
    """Preds (with a target column) plus predicted_label: y above and n below the zone between the
    highest negative and the lowest positive, else unk; check where it contradicts the target."""
    edge = preds.agg(F.max(F.when(F.col(target) == "n", F.col("pred_up"))).alias("neg_lim"), F.min(F.when(F.col(target) == "y", F.col("pred_low"))).alias("pos_lim"))
    out = preds.crossJoin(F.broadcast(edge))
    label = F.when((F.col("pred_low") > F.col("neg_lim")) & (F.col("pred_low") > F.col("pos_lim")), "y").when((F.col("pred_up") < F.col("neg_lim")) & (F.col("pred_up") < F.col("pos_lim")), "n").otherwise("unk")
    return out.withColumn("predicted_label", F.when(F.col(target).isNotNull() & (label != F.col(target)) & (label != "unk"), "check").otherwise(label))


def rounded(preds: DataFrame) -> DataFrame:
    """Predictions to three significant digits."""
    return preds.withColumns({c: signif(F.col(c), 3) for c in ("pred_low", "pred_med", "pred_up", "pred_delta") if c in preds.columns})


def review_flags(preds: DataFrame) -> DataFrame:
    """Plus rev_prediction_new: an earlier label or "*" where a person has to look."""
    c = F.col
    settled = c("rev_prediction").isNotNull() | (c("predicted_label") == "n") | (c("rev_manual").isNotNull() & (c("predicted_label") == c("rev_manual")))
    return preds.withColumn("rev_prediction_new", F.when(settled, None).otherwise(F.coalesce(c("rev_previous"), F.lit("*"))))


def rolled_labels(df: DataFrame, stop_on_unreviewed: bool = True) -> DataFrame:
    """The last review taken up: new labels move to Rev_prediction, pending "*" are an error or null."""
    if "Rev_prediction_new" not in df.columns:
        return df
    if stop_on_unreviewed and df.where(F.col("Rev_prediction_new") == "*").limit(1).count():
        raise ValueError('there are records still to review ("*")')
    new = F.when(F.col("Rev_prediction_new") != "*", F.col("Rev_prediction_new"))
    old = F.col("Rev_prediction") if "Rev_prediction" in df.columns else F.lit(None).cast("string")
    return df.withColumns({"Rev_prediction": F.coalesce(new, old), "Rev_prediction_new": F.lit(None).cast("string")})


def stop_statistics(df: DataFrame, target: Column) -> DataFrame:
    """One row: n_records, n_labelled, n_pos, all_labelled, labelled_ratio."""
    s = df.agg(F.count("*").alias("n_records"), F.count(target).alias("n_labelled"), F.count_if(F.coalesce(target == "y", F.lit(False))).alias("n_pos"))
    return s.select("*", (F.col("n_records") == F.col("n_labelled")).alias("all_labelled"), (F.col("n_labelled") / F.col("n_records")).alias("labelled_ratio"))


def stop_reason(df: DataFrame, target: Column, replication: int = 0, stop_after: int = 4, pos_target: int | None = None, labeling_limit: float | None = None) -> str | None:
    """Why the loop should end, or None."""
    s = stop_statistics(df, target).first()
    if s.all_labelled:
        return "all records are labelled"
    if pos_target is not None and s.n_pos >= pos_target:
        return "the number of positives is reached"
    if labeling_limit is not None and (s.labelled_ratio >= labeling_limit if labeling_limit <= 1 else s.n_labelled >= labeling_limit):
        return "the labelling limit is reached"
    return "no new positives in the last replications" if replication > stop_after else None


def changes(df: DataFrame, before: Column, after: Column) -> DataFrame:
    """(change, n, pct) of label moves; a missing label is "unlab."."""
    name = F.concat(F.coalesce(before, F.lit("unlab.")), F.lit(" -> "), F.coalesce(after, F.lit("unlab.")))
    counts = df.groupBy(name.alias("change")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("change", "n", percent(F.col("n") / F.col("total")).alias("pct"))


def compute_changes(df: DataFrame) -> DataFrame:
    """(Indicator, Value) of an annotation table: counts of targets and of label changes, and the
    totals of labelled and newly labelled records as "n (pct)"."""
    have = lambda *names: F.coalesce(*[F.col(c) for c in names if c in df.columns], F.lit(None).cast("string"))
    target, before = have(*LABELS), have(*LABELS[1:])
    rows = df.select(F.coalesce(target, F.lit("unlab.")).alias("t"), F.coalesce(before, F.lit("unlab.")).alias("b"))
    one = rows.groupBy(F.concat(F.lit("Target: "), "t").alias("Indicator")).agg(F.count("*").cast("string").alias("Value"))
    two = rows.groupBy(F.concat(F.lit("Change: "), "b", F.lit(" -> "), "t").alias("Indicator")).agg(F.count("*").cast("string").alias("Value"))
    sums = rows.agg(F.count("*").alias("n"), F.count_if(F.col("t") != "unlab.").alias("labelled"), F.count_if((F.col("t") != F.col("b")) & (F.col("t") != "*")).alias("new"))
    shown = lambda c: F.concat(F.col(c).cast("string"), F.lit(" ("), percent(F.col(c) / F.col("n")), F.lit(")"))
    totals = sums.select(F.explode(F.array(F.struct(F.lit("Total_labeled").alias("Indicator"), shown("labelled").alias("Value")), F.struct(F.lit("New_labels").alias("Indicator"), shown("new").alias("Value")))).alias("r")).select("r.*")
    return one.union(two).union(totals)


def importance(props: DataFrame) -> DataFrame:
    """(term, value, score, n_models) from (model, term, prop): mean, and mean by standard deviation."""
    return props.groupBy("term").agg(F.avg("prop").alias("value"), (F.avg("prop") / F.nullif(F.stddev_samp("prop"), F.lit(0.0))).alias("score"), F.count("*").alias("n_models"))


def poisson_importance(dtm: DataFrame, targets: DataFrame) -> DataFrame:
    """(term, estimate, statistic): the Poisson regression of a 0/1 target on a 0/1 term, in closed
    form: the log of the ratio of the target's means, and that by its standard error.  The table has
    a term once an id."""
    totals = targets.agg(F.count("*").alias("n"), F.sum("y").alias("pos"))
    hit = dtm.where("val > 0").select("id", "term").join(targets, "id").groupBy("term").agg(F.count("*").alias("n1"), F.sum("y").alias("y1"))
    t = hit.crossJoin(F.broadcast(totals)).withColumns({"n0": F.col("n") - F.col("n1"), "y0": F.col("pos") - F.col("y1")}).where("y1 > 0 and y0 > 0 and n0 > 0")
    estimate = F.log((F.col("y1") / F.col("n1")) / (F.col("y0") / F.col("n0")))
    return t.select("term", estimate.alias("estimate"), (estimate / F.sqrt(1 / F.col("y1") + 1 / F.col("y0"))).alias("statistic"))


def extract_importance(importance: DataFrame, dtm: DataFrame, records: DataFrame, num: int = 15, score: float = 1.5) -> DataFrame:
    """(term, value, score, estimate, statistic) of the ``num`` terms of most value with a score above
    ``score``; counts of a field are left out.  The regression takes unlabelled records as negative;
    a term that it can't estimate keeps nulls.  Ties go by term."""
    wanted = importance.where(~F.col("term").rlike(r"^\w+\.count") & (F.col("score") > score)).orderBy(F.col("value").desc(), "term").limit(num).select("term", "value", "score")
    have = [F.col(c) for c in LABELS if c in records.columns]
    target = (F.coalesce(*have, F.lit("n")) == "y").cast("int")
    found = poisson_importance(dtm.join(wanted.select("term"), "term", "left_semi"), records.select(F.col("ID").alias("id"), target.alias("y")))
    return wanted.join(found, "term", "left").select("term", "value", "score", "estimate", "statistic")
