import numpy as np
import pytest
from pyspark.sql import functions as F

from winnow.operators import bart, decide, performance, reporting, rules
from winnow.operators import rules as rules_
from winnow.plans import review
from winnow.sources import sessions


def test_query_text():
    assert rules.rules_to_query(['V__hospital %in% "1"']) == "(hospital)"
    text = rules.rules_to_query(['V__network_patient %in% "1" & V__transmission %in% "1" & V__personnel %in% "0"', 'V__a %in% "1" & V__carlo.monte %in% "0"'])
    assert text == "(((network patient) AND transmission NOT personnel) OR (a NOT (carlo OR monte)))"


def tables(spark):
    rows = {1: "a b", 2: "a b", 3: "a c", 4: "a c noise", 5: "d", 6: "d noise", 7: "c"}
    target = {1: "y", 2: "y", 3: "y", 4: "n", 5: "y", 6: "n", 7: "n"}
    presence = spark.createDataFrame([(i, t) for i, ts in rows.items() for t in ts.split()], "id long, term string")
    return presence, spark.createDataFrame(list(target.items()), "id long, target string")


def test_rules(spark):
    presence, targets = tables(spark)
    told = ['V__a %in% "1"', 'V__a %in% "1" & V__b %in% "1"', 'V__d %in% "1"', 'V__a %in% "0"', 'V__a %in% "1" & V__a %in% "1"']
    frame = rules.rules_frame(spark, told)
    assert frame.count() == 3  # one is only negative, one repeats another
    got = {r.rule: (r.pos, r.neg) for r in rules.rule_scores(frame, presence, targets).collect()}
    assert got == {told[0]: (3, 1), told[1]: (2, 0), told[2]: (1, 1)}
    cum = rules.cumulative(frame, presence, targets).orderBy("rnk").collect()
    assert [(r.cum_pos, r.cum_neg) for r in cum] == [(3, 1), (3, 1), (4, 2)]
    negative = rules.negative_terms(frame, presence, targets)
    assert {(r.rule, r.term) for r in negative.collect()} == {(told[0], "noise"), (told[2], "noise")}
    chained = rules.with_negatives(frame, negative)
    assert chained.count() == 5
    best = {r.rule: (r.pos, r.neg) for r in rules.rule_scores(chained, presence, targets).collect()}
    assert best['V__a %in% "1" & V__noise %in% "0"'] == (3, 0)


def test_simplify(spark):
    presence, targets = tables(spark)
    chosen = ['V__a %in% "1" & V__noise %in% "0"', 'V__a %in% "1" & V__b %in% "1"', 'V__d %in% "1" & V__noise %in% "0" & V__c %in% "0"']
    out = rules.simplified(spark.createDataFrame([(r,) for r in chosen], "rule string"), presence, targets).collect()
    assert {r.rule for r in out} == {chosen[0], 'V__d %in% "1" & V__noise %in% "0"'}
    assert {r.removed_terms for r in out} == {None, 'V__c %in% "0"'}
    left = rules.rules_frame(spark, [r.rule for r in out])
    assert rules.cumulative(left, presence, targets).agg(F.max("cum_pos"), F.max("cum_neg")).first() == (4, 0)


def greedy(sets):
    left, chosen = set().union(*sets.values()) if sets else set(), []
    while left:
        best = max(sorted(sets), key=lambda t: len(sets[t] & left))
        chosen.append(best)
        left -= sets[best]
    return chosen


@pytest.mark.parametrize("seed", range(3))
def test_negative_cover_is_the_greedy_one(spark, seed):
    r = np.random.default_rng(seed)
    terms = [f"word{i:02d}" for i in range(30)]
    n = 150
    target = {i: "y" if i % 10 == 0 else "n" for i in range(n)}
    rows = {i: {"rule" + "ab"[i % 2], "both", *(r.choice(terms, r.integers(0, 6 if target[i] == "n" else 1), replace=False))} for i in range(n)}
    presence = spark.createDataFrame([(i, str(t)) for i, ts in rows.items() for t in ts for _ in range(1 + i % 2)], "id long, term string")
    targets = spark.createDataFrame(list(target.items()), "id long, target string")
    told = {t: f'V__{t} %in% "1"' for t in ("both", "rulea", "ruleb", "absent")}
    got = rules.negative_terms(rules.rules_frame(spark, list(told.values())), presence, targets).orderBy("rule", "step").collect()
    for literal, rule in told.items():
        matched = [i for i, ts in rows.items() if literal in ts]
        sets = {t: {i for i in matched if t in rows[i] and target[i] == "n"} for t in {*terms, "both", "rulea", "ruleb"} - set().union(*(rows[i] for i in matched if target[i] == "y"))}
        want = greedy({t: s for t, s in sets.items() if s})
        assert [(x.step, x.term) for x in got if x.rule == rule] == list(enumerate(want, 1))
    assert rules.negative_terms(rules.rules_frame(spark, list(told.values())), presence.limit(0), targets).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_chains_are_selected_as_rules_of_their_own(spark, seed, monkeypatch):
    r = np.random.default_rng(seed)
    words = [f"word{i:02d}" for i in range(14)]
    n = 120
    target = {i: "y" if i % 6 == 0 else "n" for i in range(n)}
    rows = {i: {"rule" + "ab"[i % 2], "both", *(r.choice(words, r.integers(0, 4 if target[i] == "n" else 2), replace=False))} for i in range(n)}
    presence = spark.createDataFrame([(i, str(t)) for i, ts in rows.items() for t in ts], "id long, term string")
    targets = spark.createDataFrame(list(target.items()), "id long, target string")
    told = ["both", "rulea", "ruleb", "absent"]
    told = rules.rules_frame(spark, [*(f'V__{t} %in% "1"' for t in told), 'V__both %in% "1" & V__word03 %in% "0"'])
    names = {x.rule: x.rule for x in told.collect()}
    # terms that positives have as well, the first of them one that another rule names
    chosen = spark.createDataFrame([(rule, k, w) for rule in names for k, w in enumerate([w for w in ("word03", "word01", "word07", "word02") if w not in rule], 1) if "rulea" not in rule], "rule string, step int, term string")
    want = rules.selection(rules.with_negatives(told, chosen), presence, targets)
    sizes = []
    real = rules.written
    monkeypatch.setattr(rules, "written", lambda df, name: (lambda x: sizes.append((name, x.count())) or x)(real(df, name)))
    got = rules.selection_with_negatives(told, chosen, presence, targets)
    assert got.columns == want.columns and sorted(got.collect()) == sorted(want.collect())
    assert len({x.rule for x in want.collect()}) == want.count() > 12
    assert dict(sizes)["last_chains"] == dict(sizes)["matches"] < 400  # a row a match of the five rules, not of their chains


def simplify(selected, present, positives, negatives, everyone):
    """(rule, removed literals) of the rules that are needed, without literals that aren't.

    One after the other, over sets of record ids; ``present`` has each term's."""
    size = len

    def matched(literals):
        out = None
        for t, w in sorted(literals, key=lambda x: -x[1]):
            has = present.get(t, set())
            out = (set(has) if w else everyone - has) if out is None else (out & has if w else out - has)
        return set() if out is None else out

    def needed(rules):
        hits = [matched(r) & positives for r, _ in rules]
        score = [size(h) - size(matched(r) & negatives) for h, (r, _) in zip(hits, rules, strict=True)]
        keep = set(range(len(rules)))
        for i in sorted(keep, key=lambda i: score[i]):
            rest = set().union(*(hits[j] for j in keep - {i})) if len(keep) > 1 else set()
            if hits[i] <= rest:
                keep -= {i}
        return [rules[i] for i in sorted(keep)]

    rules = needed([(rules_.parse_rule(r), None) for r in selected])
    union = lambda rs: set().union(*(matched(r) for r, _ in rs)) if rs else set()
    whole = union(rules)
    best = size(whole & positives), size(whole & negatives)
    for i in range(len(rules) - 1, -1, -1):
        literals, gone = rules[i][0], []
        for literal in list(literals):
            left = [x for x in literals if x not in (*gone, literal)]
            if not left or not any(w for _, w in left):
                continue
            got = union([*rules[:i], (left, None), *rules[i + 1 :]])
            now = size(got & positives), size(got & negatives)
            if now[0] >= best[0] and now[1] <= best[1]:
                gone.append(literal)
                best = now
        rules[i] = [x for x in literals if x not in gone], rules_.rule_text(gone) if gone else None
    return [(rules_.rule_text(r), removed) for r, removed in needed(rules)]


def test_simplified_as_one_by_one(spark):
    r = np.random.default_rng(3)
    for n_rules, n_terms, share in ((6, 4, 0.5), (14, 7, 0.4), (25, 10, 0.35)):
        terms = [f"t{i}" for i in range(n_terms)]
        held = {i: {t for t in terms if r.uniform() < share} for i in range(60)}
        target = {i: "y" if ("t0" in h and "t1" not in h) or r.uniform() < 0.2 else "n" for i, h in held.items()}
        told = set()
        for _ in range(n_rules):
            chosen = r.choice(terms, size=int(r.integers(1, min(5, n_terms))), replace=False)
            told.add(rules.rule_text([(t, 1 if k == 0 else int(r.integers(2))) for k, t in enumerate(chosen)]))
        presence = spark.createDataFrame([(i, t) for i, h in held.items() for t in h], "id long, term string")
        targets = spark.createDataFrame(list(target.items()), "id long, target string")
        present = {t: {i for i, h in held.items() if t in h} for t in terms}
        sides = [{i for i, v in target.items() if v == side} for side in "yn"]
        want = simplify(sorted(told), present, *sides, set(held))
        found = rules.simplified(spark.createDataFrame([(x,) for x in told], "rule string"), presence, targets).collect()
        assert sorted((x.rule, x.removed_terms or "") for x in found) == sorted((a, b or "") for a, b in want)


def test_zone_partitions_records(spark):
    preds = spark.createDataFrame([(1, 0.9, 0.95, 0.99, "y"), (2, 0.01, 0.02, 0.1, "n"), (3, 0.3, 0.5, 0.7, None), (4, 0.93, 0.95, 0.99, None), (5, 0.0, 0.0, 0.01, None), (6, 0.0, 0.0, 0.05, "y")], "id long, pred_low double, pred_med double, pred_up double, target string")
    got = {r.id: r.predicted_label for r in decide.uncertainty_zone(preds.where("id < 6")).collect()}
    assert got == {1: "unk", 2: "unk", 3: "unk", 4: "y", 5: "n"}
    assert set(got.values()) <= {"y", "n", "unk", "check"}


def test_changes_and_stops(spark):
    df = spark.createDataFrame([(None, None, "y"), ("n", None, None), ("y", "n", None), (None, None, "*")], "Rev_manual string, Rev_prediction string, Rev_prediction_new string")
    got = {r.Indicator: r.Value for r in decide.compute_changes(df).collect()}
    assert got["Target: n"] == "2" and got["Change: unlab. -> y"] == "1" and got["Change: n -> n"] == "2" and got["Total_labeled"] == "4 (100%)" and got["New_labels"] == "1 (25%)"
    with pytest.raises(ValueError, match="review"):
        decide.rolled_labels(df)
    assert [r.Rev_prediction for r in decide.rolled_labels(df, False).collect()] == ["y", None, "n", None]
    target = F.col("Rev_manual")
    assert decide.stop_reason(df, target) is None
    assert decide.stop_reason(df, target, pos_target=1) and decide.stop_reason(df, target, replication=5) and decide.stop_reason(df, target, labeling_limit=0.5)


def test_normal_cdf_and_truncation():
    from statistics import NormalDist

    x = np.linspace(-5, 5, 41)
    assert np.allclose(bart.normal_cdf(x), [NormalDist().cdf(v) for v in x], atol=2e-7)
    r = np.random.default_rng(1)
    z = bart.truncated(np.full(20000, -2.0), np.ones(20000, bool), r)
    assert (z > 0).all() and abs(z.mean() - (-2 + NormalDist().pdf(2) / NormalDist().cdf(-2))) < 0.02


def test_bart_learns():
    r = np.random.default_rng(0)
    x = (r.uniform(size=(300, 6)) < 0.4).astype(float)
    y = ((x[:, 0] > 0) & (x[:, 1] > 0) | (x[:, 2] > 0)).astype(float)
    fitted = bart.Bart(trees=20, burn_in=60, iterations=100, keep=50, seed=3).fit(x[:200], y[:200])
    p = fitted.predict(x).mean(1)
    assert ((p[200:] > 0.5) == (y[200:] > 0)).mean() > 0.93 and fitted.importance[:3].sum() > 0.6


def test_forest_predicts_as_its_members():
    r = np.random.default_rng(2)
    members = []
    for seed, names in ((1, "abcdef"), (2, "cdefgh")):
        x = r.uniform(size=(120, 6)) < 0.4
        fitted = bart.Bart(trees=9, burn_in=20, iterations=30, seed=seed).fit(x, (x[:, 0] & x[:, 1] | x[:, 2]).astype(float))
        members.append((fitted, list(names)))
    forest = bart.Forest([(m.offset, names, bart.flat_trees(m.samples)) for m, names in members])
    for terms in ([], ["a"], ["a", "b", "h", "zz"], list("abcdefgh"), None):
        want = np.mean([m.predict(np.array([[n in (terms or ()) for n in names]]))[0] for m, names in members], axis=0)
        assert np.allclose(forest.draws(terms), want, atol=1e-12) and len(want) == 30


def test_ensemble_has_a_row_an_id_with_all_draws(spark):
    rows = [(i, t, 1) for i in range(60) for t in (["a"] if i % 2 else ["b"]) + [f"w{i % 7}"]] + [(99, "none", 0)]
    labels = spark.createDataFrame([(i, "y" if i % 2 else "n") for i in range(40)], "id long, target string")
    draws, props = bart.ensemble(spark.createDataFrame(rows, "id long, term string, val int"), labels, 2, pos_mult=2, trees=10, burn_in=30, iterations=40)
    found = {r.id: r.p for r in draws.collect()}
    assert set(found) == {*range(60), 99} and {len(p) for p in found.values()} == {40}
    assert all((np.mean(found[i]) > 0.5) == (i % 2 == 1) for i in range(40, 60))
    low = {r.id: (r.pred_low, r.pred_up) for r in decide.array_quantiles(draws, (0.05, 0.5, 0.95)).collect()}
    assert all(np.allclose(low[i], np.quantile(found[i], [0.05, 0.95])) for i in found)


def grown(rows, terms_of, p, depth, least):
    """The same tree by looking at all splits of each node."""
    out, stack = [], [(rows, [], 0)]
    while stack:
        ids, path, d = stack.pop()
        if path:
            out.append(" & ".join(path))
        if d == depth or len(ids) < 2 * least:
            continue
        best = None
        for t in sorted({t for i in ids for t in terms_of[i]}):
            one, two = [p[i] for i in ids if t in terms_of[i]], [p[i] for i in ids if t not in terms_of[i]]
            if min(len(one), len(two)) >= least:
                gain = round(sum(one) ** 2 / len(one) + sum(two) ** 2 / len(two) - (sum(one) + sum(two)) ** 2 / len(ids), 9)
                if gain > 0 and (best is None or gain > best[0]):
                    best = gain, t
        if best:
            for w in (0, 1):
                stack.append(([i for i in ids if (best[1] in terms_of[i]) == w], [*path, f'V__{best[1]} %in% "{w}"'], d + 1))
    return out


def test_held_terms_train_as_a_matrix():
    """Rows that repeat share their record's terms: the same trees, without a byte a row and term."""
    r = np.random.default_rng(6)
    x = r.uniform(size=(60, 7)) < 0.4
    y = (x[:, 2] | (r.uniform(size=60) < 0.2)).astype(float)
    train = np.r_[np.repeat(np.flatnonzero(y == 1), 10), np.flatnonzero(y == 0)]
    held = bart.Held([np.flatnonzero(row) for row in x], 7, train)
    options = {"trees": 8, "burn_in": 20, "iterations": 30, "seed": 3}
    one, other = bart.Bart(**options).fit(x[train], y[train]), bart.Bart(**options).fit(held, y[train])
    assert np.array_equal(one.predict(x), other.predict(x)) and np.array_equal(one.importance, other.importance)
    many = bart.Held([np.arange(20, dtype=np.int32)] * 50, 2000, np.repeat(np.arange(50), 1000))
    assert sum(v.nbytes for v in vars(many).values() if isinstance(v, np.ndarray)) < 1_000_000  # 100 MB as a matrix


def test_repeated_rows_count_once_in_the_trees(monkeypatch):
    """Trees see groups of rows with the same terms: their work does not grow with the copies."""
    longest = []
    real = np.bincount

    def seen(x, weights=None, minlength=0):
        longest.append(len(x))
        return real(x, weights, minlength)

    r = np.random.default_rng(8)
    lists = [np.flatnonzero(r.uniform(size=9) < 0.4) for _ in range(40)] * 2  # each record twice
    held = bart.Held(lists, 9, np.repeat(np.arange(80), 25))
    assert held.n <= 40 and len(held.of) == 2000
    y = np.repeat([float(2 in x) for x in lists], 25)
    monkeypatch.setattr(np, "bincount", seen)
    fitted = bart.Bart(trees=8, burn_in=20, iterations=30, seed=3).fit(held, y)
    assert sum(n > 80 for n in longest) <= 51  # the latent outcomes' sums, once an iteration
    x = np.zeros((40, 9), bool)
    for i, own in enumerate(lists[:40]):
        x[i, own] = True
    assert ((fitted.predict(x).mean(1) > 0.5) == x[:, 2]).all()
    z = bart.truncated(np.full(20000, 0.3), np.ones(20000, bool), r)
    assert (z > 0).all() and abs(z.mean() - 0.917206) < 0.02


def test_a_tree_of_many_draws_is_walked_once():
    lone = np.array([-1], np.int32), np.array([-1], np.int32)
    split = np.array([0, -1, -1], np.int32), np.array([1, -1, -1], np.int32)
    samples = [[(*lone, np.array([v]))] for v in (0.1, 0.2)] + [[(*split, np.array([0.0, v, -v]))] for v in (0.3, 0.4, 0.5)] + [[(*lone, np.array([0.6]))]]
    forest = bart.Forest([(0.05, ["a"], bart.flat_trees(samples))])
    assert forest.count.tolist() == [2, 3, 1] and len(forest.value) == 2 + 6 + 1
    for terms, sign in (([], 1), (["a"], -1)):
        assert np.allclose(forest.draws(terms), bart.normal_cdf(0.05 + np.array([0.1, 0.2, sign * 0.3, sign * 0.4, sign * 0.5, 0.6])), atol=1e-15)


def test_a_worker_keeps_its_forest():
    made = []
    assert [bart._kept_forest(k, lambda: made.append(1) or len(made)) for k in "aaba"] == [1, 1, 2, 3]


def test_tree_state_is_not_sent_through_the_driver(spark, monkeypatch):
    """A state of few different values has tiny files; its joins with the presence are no broadcasts of it."""
    plans = []
    real = bart.written

    def seen(df, name):
        if name in ("splits", "state"):
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df, name)

    monkeypatch.setattr(bart, "written", seen)
    draws = spark.range(400).select("id", F.explode(F.array(*map(F.lit, range(3)))).alias("draw")).withColumn("p", (F.col("id") % 5) / 7)
    presence = spark.range(400).select("id", F.explode(F.array((F.col("id") % 2).cast("string"), (10 + F.col("id") % 5).cast("string"))).alias("term"))
    assert bart.extract_rules(draws, presence, depth=2).count()
    joins = [line for plan in plans for line in plan.splitlines() if "Join" in line and "[id#" in line]
    assert len(joins) >= 3 and not any("Broadcast" in x for x in joins)


def test_trees_grow_as_one_by_one(spark):
    r = np.random.default_rng(8)
    terms_of = {i: {f"t{j}" for j in range(8) if r.uniform() < 0.35} for i in range(150)}
    terms_of[3] = set()
    p = {(i, d): round(float(r.uniform() * 0.2 + 0.4 * (f"t{d % 3}" in terms_of[i]) + 0.3 * ({"t4", "t5"} <= terms_of[i])), 3) for i in terms_of for d in range(6)}
    draws = spark.createDataFrame([(i, d, v) for (i, d), v in p.items()], "id long, draw long, p double")
    presence = spark.createDataFrame([(i, t) for i, ts in terms_of.items() for t in ts], "id long, term string")
    for depth, least in ((1, 5), (4, 5), (3, 30)):
        want: dict = {}
        for d in range(6):
            for rule in grown(list(terms_of), terms_of, {i: p[i, d] for i in terms_of}, depth, least):
                want[rule] = want.get(rule, 0) + 1
        assert {r.rule: r.n for r in bart.extract_rules(draws, presence, depth=depth, least=least).collect()} == want


def test_positivity_against_quadrature(spark):
    """Moments of the posterior by sums over a fine grid of intercepts and slopes, on the unrounded rows."""
    r = np.random.default_rng(4)
    x = r.uniform(size=300) ** 3
    y = (r.uniform(size=300) < 1 / (1 + np.exp(3 - 7 * x))).astype(int)
    frame = spark.createDataFrame([(float(a), int(c)) for a, c in zip(x, y, strict=True)] + [(None, 1), (0.5, None)], "x double, y int")
    a, c = np.meshgrid(np.linspace(-4, 2, 301), np.linspace(-1, 14, 301), indexing="ij")
    log = np.zeros_like(a)
    for v, label in zip(x - x.mean(), y, strict=True):
        eta = a + c * v
        log += label * eta - np.logaddexp(0, eta)
    log += -2 * np.log1p((a / 2.5) ** 2 / 3) - 2 * np.log1p((c / 1.5) ** 2 / 3)
    w = np.exp(log - log.max())
    w /= w.sum()
    intercept = a - c * x.mean()
    draws = performance.positivity_model(frame)
    assert draws.shape == (32_000, 2)
    for found, grid in ((draws[:, 0], intercept), (draws[:, 1], c)):
        mean = (w * grid).sum()
        spread = np.sqrt((w * (grid - mean) ** 2).sum())
        assert abs(found.mean() - mean) < 0.05 * spread and abs(found.std() - spread) < 0.05 * spread
    mode, _, _ = performance.positivity_mode(frame)
    at = np.unravel_index(log.argmax(), log.shape)
    assert abs(mode[0] - a[at]) <= 0.02 and abs(mode[1] - c[at]) <= 0.05


def test_performance(spark):
    rows = [(float(i) / 200, "y" if i > 150 else "n" if i % 2 else None) for i in range(200)]
    frame = spark.createDataFrame(rows, "pred_low double, t string")
    told = [sorted(map(tuple, performance.performance(df, F.col("t"), samples=300, iterations=500).collect())) for df in (frame, frame.repartition(3))]
    for a, b in zip(*told, strict=True):
        assert a[0] == b[0] and np.allclose(a[1:], b[1:], rtol=0.02)
    out = {k: v for k, *v in told[0]}
    assert out["obs_positives"] == [49.0] * 3 and out["total_records"] == [200.0] * 3
    assert out["pred_positives"][0] >= 49 and 0.5 < out["sensitivity"][1] <= 1 and out["mod_r2"][1] > 0.5
    text = {r.indicator: r.value for r in reporting.format_performance(spark.createDataFrame([(k, *v) for k, v in out.items()], "indicator string, low double, mid double, high double")).collect()}
    assert text["obs_positives"] == "49"
    r = np.random.default_rng(1)
    assert abs(np.mean([performance.negative_hypergeometric(90, 10, 5, r) for _ in range(4000)]) - 5 * 101 / 11) < 1


def test_markdown(spark):
    with pytest.raises(ValueError):
        reporting.to_markdown(spark.range(3), most=2)
    assert reporting.to_markdown(spark.createDataFrame([(1, None)], "a int, b string"), "c").endswith("| a | b |\n| --- | --- |\n| 1 |  |")


def test_review_loop(spark, tmp_path):
    rows = [(i, f"id{i}", f"{'heart failure trial' if i % 4 == 0 else 'other matter'} study{i % 5}", "text about hearts" if i % 4 == 0 else "text about stones", None, None, None, ("y" if i % 4 == 0 else "n") if i < 24 else None) for i in range(40)]
    records = spark.createDataFrame(rows, "Order long, ID string, Title string, Abstract string, Authors string, Keywords string, Mesh string, Rev_manual string")
    sessions.create_session(records, "S", str(tmp_path), stamp=False)
    settings = review.Settings(n_models=2, pos_mult=2, learner={"trees": 8, "burn_in": 20, "iterations": 30, "keep": 15}, labeling_limit=0.95)
    truth = records.select("ID", F.when(F.col("Order") % 4 == 0, "y").otherwise("n").alias("label"))
    assert review.simulate(spark, "S", str(tmp_path), truth, settings, most=2)
    files = sessions.session_files("S", str(tmp_path))
    assert len(files["Annotations"]) == len(files["Results"]) == len(files["Samples"]) >= 1
    last = spark.read.parquet(files["Annotations"][-1])
    assert last.count() == 40 and {"Predicted_label", "Pred_Low", "Rev_prediction_new"} <= set(last.columns)
    told = review.consolidated(spark.read.parquet(files["Results"][-1]), last).collect()
    assert {r.Indicator for r in told} >= {"Iter", "Reviewed predictions", "Total_labeled"}


def test_grid_of_reviews(spark, tmp_path):
    """Each point is a session of its own, which starts from the first labels and asks for others."""
    rows = [(i + 1, f"id{i}", f"{'heart failure' if i % 3 == 0 else 'other matter'} study{i % 5}", None, None, None, None, "y" if i % 3 == 0 else "n") for i in range(40)]
    records = spark.createDataFrame(rows, "Order long, ID string, Title string, Abstract string, Authors string, Keywords string, Mesh string, Rev_manual string")
    grid = performance.parameter_grid(spark, {"resample": [False], "n_init": [12, 20], "n_models": [1], "pos_mult": [2], "quant": [(0.05, 0.5, 0.95)]})
    review.evaluate_grid(spark, records, str(tmp_path), grid, review.Settings(learner={"trees": 6, "burn_in": 10, "iterations": 12}), most=1)
    scores = []
    for name, first in (("GridSession.1Mods.nResamp.12Init.2Mult.90Quant", 12), ("GridSession.1Mods.nResamp.20Init.2Mult.90Quant", 20)):
        files = sessions.session_files(name, str(tmp_path))
        assert len(files["Annotations"]) == len(files["Samples"]) == len(files["Results"]) == 1
        told = spark.read.parquet(files["Annotations"][0])
        new = told.where("Rev_prediction_new is not null")
        assert told.where("Rev_manual is not null").count() == first and told.where("Rev_prediction_new = '*'").count() == 0  # what was asked for is answered
        assert all(r.Rev_prediction_new == ("y" if (r.Order - 1) % 3 == 0 else "n") for r in new.where("Rev_manual is null").collect())
        scores.append((name, 1, first, told.where("Rev_manual = 'y'").count()))
    found = performance.grid_scores(spark.createDataFrame(scores, "session string, iter int, tot_labeled int, pos_labels int"), 14, 40)
    rates = {r.init: (r.sensitivity, r.efficiency) for r in found.withColumns(performance.session_parameters(F.col("session"))).collect()}
    assert rates == {12.0: (4 / 14, 1 - 12 / 40), 20.0: (7 / 14, 1 - 20 / 40)}
