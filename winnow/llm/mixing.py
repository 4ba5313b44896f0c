"""Operator 5 [native]: mixing sources to target weights by Efraimidis-Spirakis sampling.

A row's key is -ln(u) / weight, with u drawn from a hash of its id; the smallest keys of a source are
a weighted sample without replacement.  Complete epochs of a source come first; for the rest of its
target its rows are taken in key order up to the token budget.

No source is ever sorted in one task.  ``z = 1 - exp(-key)`` keeps the order and lies in (0, 1); the
prefix sum runs over 4096 buckets of z a source, then over 4096 finer ones within the bucket where
the budget ends, and only the rows of that one, a share of 2 ** -24, are sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quality import words_of
from .tables import named, written

BUCKETS = 4096


def uniform(id_: Column, seed: int) -> Column:
    """In (0, 1), the same on every run: 52 bits of an MD5 of seed and id."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit("")))), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)


def targets(sizes: DataFrame, shares: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources in code point order, null last, get the shares in turn.  Targets share the sum of all
    sizes; one stops at ``most`` times its source's size and the excess is shared again.  That is
    least(cap, level * share) for one level, found by one pass over the sources sorted by cap/share.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    share = F.element_at(F.array(*map(F.lit, shares)), F.pmod(F.row_number().over(order) - 1, F.lit(len(shares))) + 1)
    s = sizes.select("source", "source_size", share.alias("share"), (F.col("source_size") * most).alias("cap"))
    ratio = Window.orderBy(F.col("cap") / F.col("share"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(F.lit(0))
    s = s.withColumn("left", F.sum("source_size").over(whole) - F.sum("cap").over(ratio) + F.col("cap"))
    s = s.withColumn("shares", F.sum("share").over(whole) - F.sum("share").over(ratio) + F.col("share"))
    level = F.col("left").cast("double") / F.col("shares")
    s = s.withColumn("level", F.min(F.when(level <= F.col("cap") / F.col("share"), F.struct((F.col("cap") / F.col("share")).alias("at"), level.alias("level")))).over(whole)["level"])
    return s.select("source", "source_size", F.least(F.col("cap").cast("double"), F.coalesce(F.col("level") * F.col("share"), F.lit(0.0))).alias("target"))


def mix(docs: DataFrame, seed: int = 1, shares: tuple[int, ...] = (5, 2, 1), most: int = 3, weight: Column | None = None) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) for each row of ``docs``.

    ``copies`` says how often the mix takes the row, 0 to ``most``.  ``weight`` is a positive quality
    weight over the column ``words``; without one, the share of different words.  A null text has
    size 0.  Rows equal in source and id have one key and stand or fall together.  Null sources form
    one source, the last.  An empty table gives an empty result.
    """
    docs = named(docs, doc_id="doc_id", text="text", source="source")
    docs = docs.select("doc_id", F.col("source").cast("string").alias("source"), words_of(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("words"))
    if weight is None:
        weight = F.greatest(F.size(F.array_distinct("words")) / F.greatest(F.size("words"), F.lit(1)), F.lit(0.05))
    z = 1 - F.pow(uniform(F.col("doc_id"), seed), 1 / weight)
    rows = written(docs.select("doc_id", "source", F.size("words").cast("long").alias("size"), z.alias("z")), "mix")
    place = F.least(F.col("z"), F.lit(1 - 2.0**-53)) * BUCKETS
    coarse = F.floor(place).cast("int")
    fine = F.least(F.floor((place - F.floor(place)) * BUCKETS), F.lit(BUCKETS - 1)).cast("int")
    rows = rows.select("*", coarse.alias("coarse"), fine.alias("fine"))

    goal = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), shares, most)
    epochs = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(most))).otherwise(0).cast("int")
    goal = goal.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    goal = written(goal.select(F.col("source").alias("s"), "source_size", "target", "epochs", "rest"), "goals")

    def crossing(found: DataFrame, bucket: str, limits: DataFrame, rest: str) -> DataFrame:
        """(s, bucket, rest) where the prefix sum passes the rest, with what is left of it there."""
        sums = found.groupBy("source", bucket).agg(F.sum("size").alias("here"))
        upto = F.sum("here").over(Window.partitionBy("source").orderBy(bucket).rowsBetween(Window.unboundedPreceding, Window.currentRow))
        sums = sums.withColumn("before", upto - F.col("here")).join(limits.select("s", rest), F.col("source").eqNullSafe(F.col("s")))
        passed = F.col("before") + F.col("here") > F.col(rest)
        return sums.where(passed).groupBy("s").agg(F.min_by(F.struct(F.col(bucket), (F.col(rest) - F.col("before")).alias("rest")), bucket).alias("at")).select("s", f"at.{bucket}", F.col("at.rest").alias(f"{bucket}_rest"))

    first = written(crossing(rows, "coarse", goal.where("rest > 0"), "rest"), "coarse")
    near = rows.join(first.withColumnRenamed("coarse", "c"), F.col("source").eqNullSafe(F.col("s")) & (F.col("coarse") == F.col("c"))).drop("s", "c")
    second = written(crossing(near, "fine", first, "coarse_rest"), "fine")
    ends = first.join(second.withColumnRenamed("s", "s2"), F.col("s").eqNullSafe(F.col("s2"))).drop("s2")
    last = near.join(ends.select("s", F.col("fine").alias("f"), "fine_rest"), F.col("source").eqNullSafe(F.col("s")) & (F.col("fine") == F.col("f")))
    # rows with equal keys are peers: taken or left together
    upto = F.sum("size").over(Window.partitionBy("source").orderBy("z", "doc_id").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    peers = F.sum("size").over(Window.partitionBy("source", "z", "doc_id"))
    last = last.withColumn("upto", upto).withColumn("peers", peers).where("upto - peers / 2 <= fine_rest")
    last = last.groupBy("s").agg(F.max(F.struct("z", "doc_id")).alias("end"))
    ends = ends.select(F.col("s").alias("s1"), F.col("coarse").alias("c"), F.col("fine").alias("f"))
    goal = goal.join(ends, F.col("s").eqNullSafe(F.col("s1")), "left").join(last.withColumnRenamed("s", "s2"), F.col("s").eqNullSafe(F.col("s2")), "left")
    goal = written(goal.select("s", "source_size", "target", "epochs", "c", "f", "end"), "goals")
    out = rows.join(goal, F.col("source").eqNullSafe(F.col("s")))
    inside = (F.col("coarse") < F.col("c")) | ((F.col("coarse") == F.col("c")) & ((F.col("fine") < F.col("f")) | ((F.col("fine") == F.col("f")) & (F.struct("z", "doc_id") <= F.col("end")))))
    copies = F.col("epochs") + F.coalesce(inside, F.lit(False)).cast("int")
    return out.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))
