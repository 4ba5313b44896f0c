"""Summaries of sources, labels, iterations and densities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from winnow.functions.numbers import interval, percent, plain, signif


def summarise_vector(df: DataFrame, column: Column) -> DataFrame:
    """(level, n, pct_text) of a column's values; percents are of all rows, null ones included."""
    counts = df.groupBy(column.alias("level")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    out = counts.crossJoin(F.broadcast(total)).where("level is not null")
    return out.select("level", "n", F.concat(F.col("level").cast("string"), F.lit(": "), F.col("n").cast("string"), F.lit(" ("), percent(F.col("n") / F.col("total")), F.lit(")")).alias("pct_text"))


def sources_of(records: DataFrame) -> Column:
    """A record's different sources."""
    return F.array_distinct(F.split("Source", "; *"))


def summarise_by_source(records: DataFrame, total_row: bool = True) -> DataFrame:
    """(source, records, perc, source_specific, source_specific_perc): records with the source, and
    with no other; percents of all records and of the source's.  One grouping set adds the total."""
    lists = records.select(sources_of(records).alias("s"))
    total = lists.agg(F.count("*").alias("total"))
    each = lists.select(F.explode("s").alias("source"), (F.size("s") == 1).alias("own"))
    out = each.groupBy("source").agg(F.count("*").alias("records"), F.count_if("own").alias("source_specific"))
    if total_row:
        out = out.union(lists.agg(F.lit("Total").alias("source"), F.count("*").alias("records"), F.count_if(F.size("s") == 1).alias("source_specific")))
    out = out.crossJoin(F.broadcast(total))
    return out.select("source", "records", percent(F.col("records") / F.col("total")).alias("perc"), "source_specific", percent(F.col("source_specific") / F.col("records")).alias("source_specific_perc"))


def sources_by_session(records: DataFrame, session: Column) -> DataFrame:
    """(session, source, records): each ID counts in the first session that has it."""
    rows = records.select(session.alias("session"), "ID", sources_of(records).alias("s"))
    first = rows.groupBy("ID").agg(F.min(F.struct("session", "s")).alias("r")).select("r.*")
    return first.select("session", F.explode("s").alias("source")).groupBy("session", "source").agg(F.count("*").alias("records"))


def session_source_summary(records: DataFrame, session: Column, global_totals: bool = True) -> DataFrame:
    """(session, source, records, perc, source_specific, source_specific_perc): ``summarise_by_source``
    of the records that are new in each session, that is, whose ID no earlier one has, with a row
    ``Total`` a session; percents and specific records are empty there.

    ``global_totals`` adds the session ``All Sessions``: the records of the last one, as sessions hold
    what those before found.  Rows of one session that share an ID all count.  All sessions are one
    aggregation."""
    rows = records.select(session.alias("session"), F.col("ID").alias("id"), sources_of(records).alias("s"))
    first = rows.groupBy(F.col("id").alias("i_")).agg(F.min("session").alias("first_"))
    new = rows.join(first, F.col("id").eqNullSafe(F.col("i_"))).where("session = first_").select(F.col("session").cast("string").alias("session"), "s")
    if global_totals:
        last = rows.agg(F.max("session").alias("last_"))
        new = new.unionByName(rows.join(F.broadcast(last), F.col("session") == F.col("last_")).select(F.lit("All Sessions").alias("session"), "s"))
    # the total of a session is one more source of each record, so that one pass gives all rows
    each = new.select("session", F.explode(F.array_append(F.transform("s", lambda x: F.struct(x.alias("source"), F.lit(False).alias("all_"))), F.struct(F.lit("Total").alias("source"), F.lit(True).alias("all_")))).alias("e"), (F.size("s") == 1).alias("own"))
    out = each.groupBy("session", "e.source", "e.all_").agg(F.count("*").alias("records"), F.count_if("own").alias("own"))
    total = out.where("all_").select(F.col("session").alias("t_"), F.col("records").alias("total"))
    own = lambda c: F.when(~F.col("all_"), c)
    return out.join(total, F.col("session") == F.col("t_")).select(
        "session", "source", "records", own(percent(F.col("records") / F.col("total"))).alias("perc"), own(F.col("own")).alias("source_specific"), own(percent(F.col("own") / F.col("records"))).alias("source_specific_perc")
    )


def source_lists(summary: DataFrame) -> DataFrame:
    """(session, sources): each session's records by source, as a map."""
    return summary.groupBy("session").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "records")))).alias("sources"))


def source_distribution(records: DataFrame) -> DataFrame:
    """(n_sources, n_records, prop): how many sources records have."""
    counts = records.select(F.size(sources_of(records)).alias("n_sources")).groupBy("n_sources").agg(F.count("*").alias("n_records"))
    total = counts.agg(F.sum("n_records").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("n_sources", "n_records", (F.col("n_records") / F.col("total")).alias("prop"))


#: Kinds of changes in the summaries, by the indicators' fixed names.
CHANGES = {"unlab_y": "Change: unlab. -> y", "unlab_n": "Change: unlab. -> n", "unlab_new": "Change: unlab. -> *", "y_n": "Change: y -> n", "n_y": "Change: n -> y"}


def iteration_summary(results: DataFrame) -> DataFrame:
    """(iteration, positives, negatives, total, changes and each kind) of (iter, Indicator, Value).

    Row 0 is the labelling before the first iteration, from that one's changes."""
    return iteration_summary_by_session(results.withColumn("session", F.lit(0))).drop("session")


def iteration_summary_by_session(results: DataFrame) -> DataFrame:
    """The summary of each session of (session, iter, Indicator, Value), plus session; later sessions
    leave out the labelling before their first iteration, which the first one has.  One aggregation
    for all sessions."""
    number = F.col("Value").try_cast("double")
    of = lambda name: F.coalesce(F.max(F.when(F.col("Indicator") == name, number)), F.lit(0.0)).cast("bigint")
    stay = lambda pattern: F.coalesce(F.sum(F.when(F.col("Indicator").rlike(pattern), number)), F.lit(0.0)).cast("bigint")
    wide = results.groupBy("session", F.col("iter").cast("int").alias("iter")).agg(
        of("Target: y").alias("positives"), of("Target: n").alias("negatives"), *(of(v).alias(k) for k, v in CHANGES.items()), of("N. features").alias("n_features"), stay("^Change: y").alias("y0"), stay("^Change: n").alias("n0")
    )
    first = wide.agg(F.min_by(F.struct("session", "y0", "n0"), F.struct("session", "iter")).alias("s")).where("s is not null")
    told = {"session": F.col("s.session"), "iter": F.lit(0), "positives": F.col("s.y0"), "negatives": F.col("s.n0"), "unlab_y": F.col("s.y0"), "unlab_n": F.col("s.n0")}
    start = first.select(*(v.alias(k) for k, v in told.items()), *(F.lit(0).cast("bigint").alias(c) for c in ("unlab_new", "y_n", "n_y", "n_features")))
    out = start.unionByName(wide.drop("y0", "n0"))
    return out.select(F.col("iter").alias("iteration"), "positives", "negatives", (F.col("positives") + F.col("negatives")).alias("total"), *CHANGES, sum((F.col(k) for k in CHANGES), F.lit(0)).alias("changes"), "n_features", "session")


def classification_trend(records: DataFrame, target: Column, step: int = 20) -> DataFrame:
    """(step, yes, no): cumulative labels at each ``step`` labelled records by Order, and at the last."""
    from winnow.operators.records import ranked

    rows = records.select("Order", target.alias("t")).where("t in ('y', 'n')")
    bins = ranked(rows, [F.col("Order"), F.col("t")], "r").groupBy((F.ceil(F.col("r") / step) * step).alias("bin")).agg(F.count_if(F.col("t") == "y").alias("y"), F.count_if(F.col("t") == "n").alias("n"), F.max("r").alias("last"))
    upto = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return bins.select(F.least("bin", "last").cast("bigint").alias("step"), F.sum("y").over(upto).alias("yes"), F.sum("n").over(upto).alias("no"))


def predictive_density(draws: DataFrame, labels: DataFrame, bins: int = 20) -> DataFrame:
    """(label, bin, n): draws by label in bins of equal width on the logit scale from -10 to 10."""
    logit = F.log(F.col("p") / (1 - F.col("p")))
    place = F.least(F.greatest(F.floor((logit + 10) / 20 * bins), F.lit(0)), F.lit(bins - 1)).cast("int")
    return draws.join(labels, "id").groupBy("label", place.alias("bin")).agg(F.count("*").alias("n"))


def sampled_draws(draws: DataFrame, groups: list[str], size: int = 5000, seed: int = 1) -> DataFrame:
    """Exactly ``size`` of each group's rows (groups, id, draw, p), all of a smaller one: those with the
    least hashes of id and draw.  Parts of a group give their least first, so none is ranked whole."""
    hashed = draws.withColumn("h_", F.md5(F.concat_ws(":", F.lit(seed).cast("string"), F.col("id").cast("string"), F.col("draw").cast("string"))))
    parts = Window.partitionBy(*groups, F.substring("h_", 31, 2)).orderBy("h_")
    few = hashed.withColumn("r_", F.row_number().over(parts)).where(F.col("r_") <= size)
    return few.withColumn("r_", F.row_number().over(Window.partitionBy(*groups).orderBy("h_"))).where(F.col("r_") <= size).drop("r_", "h_")


def kernel_densities(samples: DataFrame, groups: list[str], points: int = 512) -> DataFrame:
    """(groups, place, prob, dens): Gaussian kernel densities of p on the logit scale.

    The bandwidth is 0.9 times the lesser of the standard deviation and the quartiles' distance over 1.34,
    by the fifth root of the size.  Samples are split linearly between the two nearest of ``points`` places
    from three bandwidths below the least to three above the greatest; each place then sums the kernels of
    all places, so a group costs points squared, whatever its size.  Draws of 0 or 1 take no part; groups
    of fewer than two different values have no density."""
    logit = samples.where("p > 0 and p < 1").select(*groups, F.log(F.col("p") / (1 - F.col("p"))).alias("x"))
    quartile = F.percentile("x", F.array(F.lit(0.25), F.lit(0.75)))
    facts = logit.groupBy(*groups).agg(F.count("*").alias("n"), F.min("x").alias("least"), F.max("x").alias("most"), F.stddev_samp("x").alias("sd"), quartile.alias("q"))
    spread = F.when(F.col("q")[1] > F.col("q")[0], F.least("sd", (F.col("q")[1] - F.col("q")[0]) / 1.34)).otherwise(F.col("sd"))
    facts = facts.withColumn("bw", spread * 0.9 * F.pow("n", F.lit(-0.2))).where("bw > 0")
    facts = facts.select(*groups, "n", "bw", (F.col("least") - 3 * F.col("bw")).alias("low"), ((F.col("most") - F.col("least") + 6 * F.col("bw")) / (points - 1)).alias("step"))
    placed = logit.join(facts, groups).select(*groups, ((F.col("x") - F.col("low")) / F.col("step")).alias("at"))
    low = F.least(F.floor("at"), F.lit(points - 2)).cast("int")
    both = F.array(F.struct(low.alias("k"), (1 - (F.col("at") - low)).alias("w")), F.struct((low + 1).alias("k"), (F.col("at") - low).alias("w")))
    bins = placed.select(*groups, F.explode(both).alias("b")).groupBy(*groups, "b.k").agg(F.sum("b.w").alias("w"))
    bins = bins.groupBy(*groups).agg(F.array_sort(F.collect_list(F.struct("k", "w"))).alias("bins"))
    grid = bins.join(facts, groups).withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    off = lambda b: (F.col("place") - b["k"]) * F.col("step") / F.col("bw")
    dens = F.aggregate("bins", F.lit(0.0), lambda s, b: s + b["w"] * F.exp(-off(b) * off(b) / 2)) / (F.col("n") * F.col("bw") * F.sqrt(2 * F.pi()))
    at = F.col("low") + F.col("place") * F.col("step")
    return grid.select(*groups, "place", (1 / (1 + F.exp(-at))).alias("prob"), dens.alias("dens"))


def densities_by_iteration(annotations: DataFrame, draws: DataFrame, bins: int = 20) -> DataFrame:
    """(iteration, label, bin, n, neg_lim, pos_lim) of annotations (iter, ID, labels, Pred_Low, Pred_Up)
    and draws (iter, id, p): each iteration's ``predictive_density``, all draws counted, with its limits
    of the uncertainty zone, the most Pred_Up of the negative and the least Pred_Low of the positive.

    Records up for review count as ``*``, reviewed ones too, but for one more iteration at the end, which
    has the last one's final labels."""
    have = lambda *names: F.coalesce(*[F.col(c) for c in names if c in annotations.columns], F.lit(None).cast("string"))
    at_review = F.when(have("Rev_prediction_new").isNotNull(), "*").otherwise(have("Rev_prediction", "Rev_manual"))
    kept = lambda shift, label: (F.col("iter").alias("from_"), (F.col("iter") + shift).alias("iteration"), F.col("ID").alias("i_"), label.alias("label"), "Pred_Low", "Pred_Up")
    last = annotations.agg(F.max("iter").alias("last_"))
    final = annotations.join(F.broadcast(last), F.col("iter") == F.col("last_")).select(*kept(1, have("Rev_prediction_new", "Rev_prediction", "Rev_manual")))
    told = annotations.select(*kept(0, at_review)).unionByName(final).where("label is not null")
    limits = told.groupBy(F.col("iteration").alias("l_")).agg(F.max(F.when(F.col("label") == "n", F.col("Pred_Up"))).alias("neg_lim"), F.min(F.when(F.col("label") == "y", F.col("Pred_Low"))).alias("pos_lim"))
    logit = F.log(F.col("p") / (1 - F.col("p")))
    place = F.least(F.greatest(F.floor((logit + 10) / 20 * bins), F.lit(0)), F.lit(bins - 1)).cast("int")
    # draws are counted by record and bin before they meet labels, which the last iteration has twice
    binned = draws.groupBy(F.col("iter").alias("d_"), "id", place.alias("bin")).agg(F.count("*").alias("n"))
    counts = binned.join(told, (F.col("d_") == F.col("from_")) & (F.col("id") == F.col("i_"))).groupBy("iteration", "label", "bin").agg(F.sum("n").alias("n"))
    return counts.join(limits, F.col("iteration") == F.col("l_"), "left").select("iteration", "label", "bin", "n", "neg_lim", "pos_lim")


#: Labels of the fields in reports (fixed values).
COMPONENTS = {"ABSTR": "Abstract", "TITLE": "Title", "AUTH": "Author", "KEYS": "Keyword", "MESH": "Mesh term"}


def format_importance(importance: DataFrame) -> DataFrame:
    """(component, term, inclusion_rate, score, rr, statistic) of (term, value, score, estimate, statistic)."""
    name = F.regexp_extract("term", r"^([A-Z]+)__", 1)
    table = F.create_map(*(F.lit(x) for pair in COMPONENTS.items() for x in pair))
    term = F.initcap(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace("term", r"^[A-Z]+__", ""), r"\._\.", " & "), r"\.", " | "), "_", " "))
    return importance.select(
        F.try_element_at(table, name).alias("component"), term.alias("term"), signif(F.col("value") * 10000, 3).alias("inclusion_rate"), signif(F.col("score"), 3).alias("score"),
        plain(signif(F.exp("estimate"), 3)).alias("rr"), plain(signif(F.col("statistic"), 3)).alias("statistic"),
    )


def format_performance(performance: DataFrame) -> DataFrame:
    """(indicator, value) as text of (indicator, low, mid, high)."""
    shares = F.col("indicator").isin("used_prop", "efficiency", "sensitivity", "mod_r2")
    values = F.array("low", "mid", "high")
    single = F.col("low") == F.col("high")
    return performance.select("indicator", F.when(single, plain(F.col("mid"))).when(shares, interval(values, True)).otherwise(interval(values)).alias("value"))


def to_markdown(df: DataFrame, caption: str | None = None, most: int = 1000) -> str:
    """A small table as Markdown; a larger one than ``most`` rows is an error, not cut."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"the table has more than {most} rows")
    lines = [f"**{caption}**", ""] if caption else []
    lines += ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join("" if v is None else str(v).replace("|", "\\|") for v in r) + " |" for r in rows)])
