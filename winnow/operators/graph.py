"""Connected components and maximal cliques of term graphs."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.storage import written


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for each node of the undirected edges (a, b); root is the smallest node reachable.

    Alternating large-star and small-star passes.  Each pass takes a minimum a node (combined before
    the shuffle), writes it, and joins it back: both sides of that join are plain shuffles of tables,
    which adaptive execution can split at a hot node.  Raises if it has
    not settled after ``rounds``, rather than return too little.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    state = None
    for _ in range(rounds):
        both = now.union(now.select("v", "u"))
        low = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low")
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = written(large, "large")
        low = written(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        near = large.join(low, "u")
        small = near.select("v", "m").union(near.select("u", "m")).toDF("u", "v").where("u <> v")
        now = written(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
        last, state = state, now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == last:
            roots = now.groupBy("u").agg(F.min("v").alias("root"))
            return roots.union(now.select("v", "v").distinct()).toDF("node", "root")
    raise RuntimeError(f"components have not settled after {rounds} rounds")


def cliques_within(size: int, sizes: list[int], later: int, sees: list[int], largest: int) -> Iterator[list[int]]:
    """Maximal cliques of a node with ``size`` terms and some of its neighbours, those of at most
    ``largest`` terms; neighbours are numbered, the first ``later`` ones may be members.

    Sets are bits of integers, ``sees`` the neighbours of each.  Depth first with a pivot: what the
    pivot sees needs no branch of its own.  Each candidate of a branch ends as a member or unseen by
    one, so the fewest nodes that cover all candidates by themselves and what they don't see are a bound
    on how many terms more a clique of this branch has; a branch that gets too large ends there.
    """
    work: list[tuple[int, list[int], int, int]] = [(size, [], (1 << later) - 1, (1 << len(sees)) - (1 << later))]
    while work:
        terms, chosen, open_, closed = work.pop()
        if terms > largest:
            continue
        if not open_:
            if not closed:
                yield chosen
            continue
        n, most, pivot, covers, rest = open_.bit_count(), -1, 0, [], open_
        while rest:
            i = (rest & -rest).bit_length() - 1
            rest &= rest - 1
            seen = (sees[i] & open_).bit_count()
            covers.append(n - seen)
            if seen > most:
                most, pivot = seen, i
        covers.sort(reverse=True)
        left, more = n, 0
        while left > 0:
            left -= covers[more]
            more += 1
        if terms + more > largest:
            continue
        rest = closed
        while rest and most < n:
            i = (rest & -rest).bit_length() - 1
            rest &= rest - 1
            seen = (sees[i] & open_).bit_count()
            if seen > most:
                most, pivot = seen, i
        rest = open_ & ~sees[pivot]  # empty if one that is out already sees all
        while rest:
            i = (rest & -rest).bit_length() - 1
            rest &= rest - 1
            work.append((terms + sizes[i], [*chosen, i], open_ & sees[i], closed & sees[i]))
            open_ &= ~(1 << i)
            closed |= 1 << i


#: Nodes whose cliques one group seeks, at most about; groups share the lists of common neighbours.
BLOCK = 64


def _block_cliques(pdf, largest: int) -> list[list]:
    """Cliques of the nodes that are at home in a block, from rows (node, home, terms, near)."""
    import numpy as np

    names, terms, home = pdf["node"].tolist(), pdf["terms"].tolist(), pdf["home"].tolist()
    number = {x: i for i, x in enumerate(names)}
    degree = [len(x) for x in pdf["near"]]
    near = [np.array([number[x] for x in row if x in number], np.int64) for row in pdf["near"]]
    place, found = np.full(len(names), -1), []
    for v in range(len(names)):
        if not home[v]:
            continue
        own = sorted(near[v].tolist(), key=lambda u: ((degree[u], names[u]) < (degree[v], names[v]), u))
        later = sum((degree[u], names[u]) > (degree[v], names[v]) for u in own)
        place[own] = np.arange(len(own))
        sees = []
        for u in own:
            at = place[near[u]]
            bits = np.zeros(len(own), bool)
            bits[at[at >= 0]] = True
            sees.append(int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little"))
        place[own] = -1
        found += [[names[v], *(names[own[i]] for i in members)] for members in cliques_within(terms[v], [terms[u] for u in own], later, sees, largest)]
    return found


def maximal_cliques(edges: DataFrame, max_terms: int = 10, classes: DataFrame | None = None) -> DataFrame:
    """(clique, size) of the edges (a, b): maximal cliques of 2 to ``max_terms`` terms, sorted arrays.

    ``classes`` (node, term), if given, has the terms that a node stands for: they see each other and
    what the node sees.  Nodes with the same neighbours, themselves counted, are in the same maximal
    cliques, so they become one as well, and one with too many terms only keeps others from being
    maximal.  Each remaining node is a problem of its own: the cliques in which it has the fewest
    neighbours, ties by value, among its neighbourhood.  Problems come in blocks of nodes with similar
    neighbourhoods, which share most lists; no group gets a component.
    """
    kind = edges.schema["a"].dataType.simpleString()
    edges = edges.where("a <> b")
    both = written(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "both")
    if classes is None:
        classes = both.select(F.col("a").alias("node")).distinct().withColumn("term", F.col("node"))
    classes = written(classes.select("node", "term").distinct(), "classes")
    near = both.groupBy(F.col("a").alias("node")).agg(F.collect_list("b").alias("near"))
    nodes = classes.groupBy("node").agg(F.count("*").alias("n")).join(near, "node", "left").withColumn("near", F.coalesce("near", F.array().cast(f"array<{kind}>")))
    closed = F.to_json(F.array_sort(F.array_append("near", F.col("node"))))
    twins = written(nodes.select("node", "n", F.sha2(closed, 256).alias("twin")), "twins")
    first = twins.groupBy("twin").agg(F.min("node").alias("first"), F.sum("n").alias("terms"))
    reps = written(twins.join(first, "twin").select("node", "first", "terms"), "representatives")

    kept = reps.where("node = first").select("node", "terms")
    inner = both.join(kept.select(F.col("node").alias("a")), "a", "left_semi").join(kept.select(F.col("node").alias("b")), "b", "left_semi")
    lists = kept.join(inner.groupBy(F.col("a").alias("node")).agg(F.collect_list("b").alias("near")), "node", "left")
    lists = lists.withColumn("near", F.coalesce("near", F.array().cast(f"array<{kind}>")))
    alike = F.array_min(F.transform(F.array_append("near", F.col("node")), lambda x: F.xxhash64(x)))
    lists = written(lists.withColumn("block", F.when(F.col("terms") <= max_terms, alike)), "lists")
    parts = lists.where("block is not null").groupBy("block").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    lists = written(lists.join(parts, "block", "left").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts"))).drop("parts"), "lists")
    own = lists.where("block is not null")
    wanted = own.select("block", "part", F.explode("near").alias("node")).union(own.select("block", "part", "node")).distinct()
    told = lists.select("node", "terms", "near", F.col("block").alias("home_block"), F.col("part").alias("home_part"))
    rows = wanted.join(told, "node").select("block", "part", "node", ((F.col("block") == F.col("home_block")) & (F.col("part") == F.col("home_part"))).alias("home"), "terms", "near")
    rows = rows.withColumn("home", F.coalesce("home", F.lit(False)))

    def search(pdf):
        import pandas as pd

        return pd.DataFrame({"clique": pd.Series(_block_cliques(pdf, max_terms), dtype=object)})

    cliques = written(rows.groupBy("block", "part").applyInPandas(search, f"clique array<{kind}>"), "found")
    members = reps.where(F.col("terms") <= max_terms).select("node", "first").join(classes, "node").select("first", "term")
    whole = cliques.select("clique", F.explode("clique").alias("first")).join(members, "first").groupBy("clique").agg(F.array_sort(F.collect_list("term")).alias("terms"))
    return whole.where(F.size("terms") >= 2).select(F.col("terms").alias("clique"), F.size("terms").alias("size"))
