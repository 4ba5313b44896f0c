"""Expected performance of a review, and the analysis of parameter grids."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow.functions.numbers import percent
from winnow.storage import written


#: Scales and degrees of the student-t priors of the intercept, at the mean x, and of the slope (fixed values).
PRIOR_SCALES, PRIOR_DEGREES = (2.5, 1.5), 3
#: Parameters whose sums a task makes at a time, and the values of x beside them.
DRAW_BLOCK, X_BLOCK = 2048, 512


def _counted(data: DataFrame) -> DataFrame:
    """(x, y, n) of (x, y): equal rows counted, nothing rounded; rows without either are left out."""
    rows = data.select(F.col("x").cast("double").alias("x"), F.col("y").cast("int").alias("y")).where("x is not null and y is not null")
    return written(rows.groupBy("x", "y").agg(F.count("*").alias("n")), "counted")


def _sums(counts: DataFrame, draws: np.ndarray, parts: int, of) -> np.ndarray:
    """(draws, parts): sums over all rows of what ``of`` (x, y, n, block of draws) gives for a block of
    rows and draws.  Each task sums its rows; tasks' sums meet by draw."""
    spark = counts.sparkSession
    told = spark.sparkContext.broadcast(draws)

    def summed(batches):
        own = np.zeros((len(told.value), parts))
        for batch in batches:
            x, y, n = (c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns)
            for i in range(0, len(x), X_BLOCK):
                here = slice(i, i + X_BLOCK)
                for j in range(0, len(own), DRAW_BLOCK):
                    own[j : j + DRAW_BLOCK] += of(x[here], y[here], n[here], told.value[j : j + DRAW_BLOCK])
        for j in range(0, len(own), DRAW_BLOCK):
            block = own[j : j + DRAW_BLOCK]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(j, j + len(block))), pa.array(list(block), pa.list_(pa.float64()))], names=["draw", "sums"])

    found = counts.select("x", "y", "n").mapInArrow(summed, "draw long, sums array<double>")
    found = found.groupBy("draw").agg(*(F.sum(F.col("sums")[k]).alias(f"s{k}") for k in range(parts)))
    out = np.zeros((len(draws), parts))
    for r in found.collect():  # one row a draw
        out[r.draw] = r[1:]
    return out


def _log_prior(b: np.ndarray) -> np.ndarray:
    return -(PRIOR_DEGREES + 1) / 2 * np.log1p((b / np.array(PRIOR_SCALES)) ** 2 / PRIOR_DEGREES).sum(-1)


def positivity_mode(data: DataFrame, steps: int = 25) -> tuple[np.ndarray, np.ndarray, float]:
    """(mode, negative Hessian there, mean of x) of the posterior of ``positivity_model``: Newton's steps
    over all rows, each one aggregate.  The intercept is that at the mean of x."""
    return _mode(_counted(data), steps)


def _mode(counts: DataFrame, steps: int = 25) -> tuple[np.ndarray, np.ndarray, float]:
    mean = float(counts.agg(F.sum(F.col("x") * F.col("n")) / F.sum("n")).first()[0] or 0.0)
    x, n = F.col("x") - F.lit(mean), F.col("n")
    b = np.zeros(2)
    scales = np.array(PRIOR_SCALES) ** 2 * PRIOR_DEGREES
    for _ in range(steps):
        p = 1 / (1 + F.exp(-(F.lit(float(b[0])) + F.lit(float(b[1])) * x)))
        off, w = n * (F.col("y") - p), n * p * (1 - p)
        s = [v or 0.0 for v in counts.agg(F.sum(off), F.sum(off * x), F.sum(w), F.sum(w * x), F.sum(w * x * x)).first()]
        # the prior's curvature where it is convex, so that steps go uphill
        grad = np.array(s[:2]) - (PRIOR_DEGREES + 1) * b / (scales + b**2)
        hess = np.array([[s[2], s[3]], [s[3], s[4]]]) + np.diag((PRIOR_DEGREES + 1) / (scales + b**2))
        step = np.linalg.solve(hess, grad)
        b = b + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-12:
            break
    return b, hess, mean


def positivity_model(data: DataFrame, iterations: int = 8000, chains: int = 8, seed: int = 1) -> np.ndarray:
    """(draws, 2): posterior of intercept and slope of a logistic regression of y on x = pred_low.

    ``data`` is (x, y), all rows of it unrounded.  Each chain has ``iterations`` steps, the first half to
    warm up.  Its proposals don't depend on where it is: they come from a student-t distribution with
    heavier tails around the mode, so the likelihoods of all proposals of all chains are sums of one pass
    over the data.  Student-t priors with 3 degrees, of the intercept at the mean x and of the slope."""
    counts = _counted(data)
    mode, hess, mean = _mode(counts)
    r, degrees = np.random.default_rng(seed), 5
    root = np.linalg.cholesky(np.linalg.inv(hess))
    normal, chi = r.normal(size=(chains * iterations, 2)), r.chisquare(degrees, size=chains * iterations)
    step = normal / np.sqrt(chi / degrees)[:, None]
    proposed = mode + step @ root.T * 1.2

    def likelihood(x, y, n, b):
        eta = b[:, :1] + b[:, 1:] * (x - mean)
        return ((y * eta - np.logaddexp(0, eta)) * n).sum(1, keepdims=True)

    density = _sums(counts, proposed, 1, likelihood)[:, 0] + _log_prior(proposed)
    weight = (density + (degrees + 2) / 2 * np.log1p((step**2).sum(1) / degrees)).reshape(chains, iterations)
    proposed = proposed.reshape(chains, iterations, 2)
    accept = np.log(r.uniform(size=(chains, iterations)))
    out = np.empty((chains, iterations), np.int64)
    for chain in range(chains):
        at = 0
        for i in range(iterations):
            if accept[chain, i] < weight[chain, i] - weight[chain, at]:
                at = i
            out[chain, i] = at
    kept = np.concatenate([proposed[c][out[c, iterations // 2 :]] for c in range(chains)])
    return np.stack([kept[:, 0] - kept[:, 1] * mean, kept[:, 1]], 1)


def performance(records: DataFrame, target: Column, low: str = "pred_low", quants: tuple[float, float, float] = (0.05, 0.5, 0.95), samples: int = 2500, seed: int = 23797297, iterations: int = 8000) -> DataFrame:
    """(indicator, low, mid, high): expected positives, work and sensitivity of a review.

    ``samples`` draws of the posterior.  Unlabelled records with the same pred_low, unrounded, are one
    binomial a draw, seeded by their value, so results don't depend on the partitioning and only sums by
    draw reach the driver.  A record without pred_low counts as 0.  The fit, R^2, is the variance of the
    fitted labels over that and the variance of what they miss."""
    spark = records.sparkSession
    rows = written(records.select(F.col(low).cast("double").alias("x"), target.alias("t")), "performance")
    labelled = _counted(rows.where("t in ('y', 'n')").select("x", (F.col("t") == "y").cast("int").alias("y")))
    b = positivity_model(rows.where("t in ('y', 'n')").select("x", (F.col("t") == "y").cast("int").alias("y")), iterations=iterations, seed=seed)
    r = np.random.default_rng(seed)
    b = b[r.permutation(len(b))[:samples]]

    def simulated(x, y, n, b):
        found = np.zeros((len(b), 1))
        for value, times in zip(x, n, strict=True):
            chance = 1 / (1 + np.exp(-(b[:, 0] + b[:, 1] * value)))
            found[:, 0] += np.random.default_rng([seed, *np.frombuffer(np.float64(value).tobytes(), np.uint32)]).binomial(int(times), chance)
        return found

    def fit(x, y, n, b):
        f = 1 / (1 + np.exp(-(b[:, :1] + b[:, 1:] * x)))
        return np.stack([(f * n).sum(1), (f * f * n).sum(1), ((y - f) * n).sum(1), ((y - f) ** 2 * n).sum(1)], 1)

    open_ = _counted(rows.where("t is null or t not in ('y', 'n')").select(F.coalesce("x", F.lit(0.0)).alias("x"), F.lit(0).alias("y")))
    told = rows.agg(F.count_if(F.col("t") == "y").alias("obs"), F.count_if(F.col("t").isin("y", "n")).alias("reviewed"), F.count("*").alias("total")).first()
    obs, reviewed, total = told
    positives = obs + _sums(open_, b, 1, simulated)[:, 0].astype(np.int64)
    needed = np.array([negative_hypergeometric(int(total - p), int(p), int(obs), r) for p in positives])
    sums, size = _sums(labelled, b, 4, fit), max(1, labelled.agg(F.sum("n")).first()[0] or 0)
    var_fit, var_rest = sums[:, 1] / size - (sums[:, 0] / size) ** 2, sums[:, 3] / size - (sums[:, 2] / size) ** 2
    r2 = var_fit / np.maximum(var_fit + var_rest, 1e-12)
    q = lambda v: [float(z) for z in np.sort(np.quantile(v, quants))]
    one = lambda v: [float(v)] * 3
    values = {
        "obs_positives": one(obs), "pred_positives": q(positives), "mod_r2": q(r2), "n_reviewed": one(reviewed), "total_records": one(total),
        "used_prop": q(reviewed / np.maximum(needed, 1)), "efficiency": q(1 - reviewed / np.maximum(needed, 1)), "sensitivity": q(obs / np.maximum(positives, 1)),
    }
    return spark.createDataFrame([(k, *v) for k, v in values.items()], "indicator string, low double, mid double, high double")


def negative_hypergeometric(negatives: int, positives: int, wanted: int, r: np.random.Generator) -> int:
    """Random draws needed, without replacement, for so many positives."""
    if not wanted or not positives:
        return 0
    wanted = min(wanted, positives)
    # the wanted-th of the positives' uniform places among all, by a beta-binomial split of the negatives
    share = r.beta(wanted, positives - wanted + 1)
    return wanted + int(r.binomial(negatives, share))


def cumulative_bands(records: DataFrame, target: Column, chance: Column, sims: int = 100, quants: tuple[float, float, float] = (0.05, 0.5, 0.95), seed: int = 1, step: int = 50) -> DataFrame:
    """(place, low, mid, high) of cumulative positives by Order, at each ``step`` places: simulated
    labels are summed by bin and simulation first, so the windows run over bins."""
    from pyspark.sql import Window

    from winnow.operators.records import ranked

    rows = ranked(records.select("Order", "ID", target.alias("t"), chance.alias("p")), [F.col("Order"), F.col("ID")], "place")
    rows = rows.select((F.ceil(F.col("place") / step) * step).cast("bigint").alias("place"), "ID", "t", "p", F.explode(F.sequence(F.lit(1), F.lit(sims))).alias("sim"))
    draw = F.pmod(F.xxhash64("ID", "sim", F.lit(seed)), F.lit(1_000_003)) / 1_000_003
    hit = F.when(F.col("t").isNotNull(), (F.col("t") == "y").cast("int")).otherwise((draw < F.col("p")).cast("int"))
    sums = rows.groupBy("sim", "place").agg(F.sum(hit).alias("h")).withColumn("c", F.sum("h").over(Window.partitionBy("sim").orderBy("place")))
    return sums.groupBy("place").agg(F.percentile("c", F.array(*map(F.lit, quants))).alias("q")).select("place", *(F.get("q", i).alias(n) for i, n in enumerate(("low", "mid", "high"))))


#: Defaults of the parameter grid (fixed values).
GRID = {"resample": [False, True], "n_init": [50, 100, 250, 500], "n_models": [1, 5, 10, 20, 40, 60], "pos_mult": [1, 10, 20], "quant": [(0.1, 0.5, 0.9), (0.05, 0.5, 0.95), (0.01, 0.5, 0.99)]}


def parameter_grid(spark: SparkSession, grid: dict | None = None) -> DataFrame:
    """All combinations, with the session name that encodes them."""
    grid = GRID | (grid or {})
    quants = [(float(q[0]), float(q[1]), float(q[2])) for q in grid["quant"]]
    parts = [("resample", "boolean", grid["resample"]), ("n_init", "int", grid["n_init"]), ("n_models", "int", grid["n_models"]), ("pos_mult", "int", grid["pos_mult"]), ("quant", "array<double>", [list(q) for q in quants])]
    out = None
    for name, kind, values in parts:
        one = spark.createDataFrame([(v,) for v in values], f"{name} {kind}")
        out = one if out is None else out.crossJoin(F.broadcast(one))
    width = F.round((F.array_max("quant") - F.array_min("quant")) * 100).cast("int")
    name = F.concat(F.lit("GridSession."), F.col("n_models").cast("string"), F.lit("Mods."), F.when(F.col("resample"), "y").otherwise("n"), F.lit("Resamp."), F.col("n_init").cast("string"), F.lit("Init."), F.col("pos_mult").cast("string"), F.lit("Mult."), width.cast("string"), F.lit("Quant"))
    return out.withColumn("session", name)


def session_parameters(session: Column) -> dict[str, Column]:
    """The parameters that a grid session's name encodes."""
    number = lambda label: F.regexp_extract(session, rf"(\d+){label}", 1).try_cast("double")
    return {"mods": number("Mods"), "resamp": F.regexp_extract(session, r"([yn])Resamp", 1), "init": number("Init"), "mult": number("Mult"), "quant": number("Quant")}


def grid_scores(results: DataFrame, total_positives: int | Column, total_records: int | Column, score: str = "sens_adj_eff") -> DataFrame:
    """Each session's last iteration of (session, iter, tot_labeled, pos_labels) with its rates and score."""
    last = results.groupBy("session").agg(F.max_by(F.struct("iter", "tot_labeled", "pos_labels"), "iter").alias("r")).select("session", "r.*")
    as_column = lambda v: v if isinstance(v, Column) else F.lit(v)
    out = last.withColumns({"pos_rate": F.col("pos_labels") / F.col("tot_labeled"), "sensitivity": F.col("pos_labels") / as_column(total_positives), "efficiency": 1 - F.col("tot_labeled") / as_column(total_records)})
    out = out.withColumns({"pos_rate_adj_sens": F.col("pos_rate") * F.col("sensitivity"), "sens_adj_eff": F.col("sensitivity") * F.col("efficiency")})
    return out.withColumn("score", F.col(score))


def grid_clusters(scores: DataFrame, least: int = 7, depth: int = 3) -> DataFrame:
    """Scores plus cluster: leaves of a regression tree over the parameters, best mean first.

    One row a session, a few hundred, on the driver."""
    spark = scores.sparkSession
    names = ["mods", "resamp", "init", "mult", "quant"]
    rows = scores.select("session", "score", *(F.coalesce(F.col(c).cast("string"), F.lit("-")).alias(c) for c in names)).collect()
    out, stack = [], [(list(rows), [])]
    while stack:
        part, path = stack.pop()
        best = None
        if len(path) < depth and len(part) >= 2 * least:
            for c in names:
                for v in sorted({r[c] for r in part}):
                    one, two = [r.score for r in part if r[c] == v], [r.score for r in part if r[c] != v]
                    if min(len(one), len(two)) >= least:
                        gain = sum(one) ** 2 / len(one) + sum(two) ** 2 / len(two)
                        if best is None or gain > best[0] + 1e-12:
                            best = gain, c, v
        if best:
            stack += [([r for r in part if r[best[1]] == best[2]], [*path, f"{best[1]} = {best[2]}"]), ([r for r in part if r[best[1]] != best[2]], [*path, f"{best[1]} <> {best[2]}"])]
        else:
            out.append((sum(r.score for r in part) / max(1, len(part)), " & ".join(path), [r.session for r in part]))
    out.sort(key=lambda x: (-x[0], x[1]))
    return scores.join(F.broadcast(spark.createDataFrame([(s, i + 1, rule) for i, (_, rule, ss) in enumerate(out) for s in ss], "session string, cluster int, rule string")), "session")


def best_by_cluster(scores: DataFrame) -> DataFrame:
    """The session with the highest sensitivity, then efficiency, of each cluster."""
    order = F.struct(F.col("sensitivity"), F.col("efficiency"), F.col("session"))
    return scores.groupBy("cluster").agg(F.max_by("session", order).alias("session"), F.max("sensitivity").alias("sensitivity"))


def formatted(scores: DataFrame, total_positives: int, total_records: int) -> DataFrame:
    """Scores as report text."""
    return scores.select("session", F.format_string(f"%d / {total_positives}", F.col("pos_labels").cast("bigint")).alias("pos_labels"), percent(F.col("sensitivity")).alias("sensitivity"), F.format_string(f"%d / {total_records}", F.col("tot_labeled").cast("bigint")).alias("tot_labeled"), percent(F.col("efficiency")).alias("efficiency"))

