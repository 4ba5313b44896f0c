import pytest

from winnow.llm.mixing import mix

from .helpers import frame, prose, words


def goals(sizes):
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    share = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in sizes if s not in capped]
        left = total - sum(3 * sizes[s] for s in capped)
        goal = {s: left * share[s] / sum(share[x] for x in free) for s in free}
        over = {s for s in free if goal[s] > 3 * sizes[s]}
        if not over:
            return {s: 3.0 * sizes[s] if s in capped else goal[s] for s in sizes}
        capped |= over


@pytest.mark.parametrize("rows", [None, [prose(i, 20 + i % 40) for i in range(400)]])
def test_targets_and_takes(spark, rows):
    docs = frame(spark, rows)
    sizes: dict = {}
    for r in docs.collect():
        sizes[r.source] = sizes.get(r.source, 0) + len(words(r.text))
    found = mix(docs).collect()
    assert len(found) == docs.count()
    goal, taken, largest = goals(sizes), {}, {}
    for r in found:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(goal[r.source])
        assert r.taken == r.copies * r.size <= 3 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        largest[r.source] = max(largest.get(r.source, 0), r.size)
    for s in sizes:
        assert abs(taken[s] - goal[s]) <= 2 * largest[s]
    assert sorted(map(str, found)) == sorted(map(str, mix(docs).collect()))


def test_complete_epochs_come_first(spark):
    found = mix(frame(spark, [prose(i, 30) for i in range(200)])).collect()
    for source in {r.source for r in found}:
        copies = {r.copies for r in found if r.source == source}
        assert max(copies) - min(copies) <= 1


def test_empty_table(spark):
    assert mix(frame(spark, [])).collect() == []
