"""Deep lists and long chains, past the bounds of earlier forms."""

from tactilion.operators import joins, windows

#: Down 100 levels and up again, an item twice at each level; a second list; a row without a level.
LEVELS = [n for n in [*range(100), *range(98, -1, -1)] for _ in range(2)]
ROWS = [("a", i, n) for i, n in enumerate(LEVELS)] + [("b", 0, 5), ("b", 1, None), ("b", 2, 5), ("b", 3, None)]


def rows_of(spark, operator):
    items = spark.createDataFrame(ROWS, "list string, at long, level long")
    return {(r[0], r[1]): r[3] for r in operator(items, "list", "at", "level").collect()}


def test_counters_of_many_levels(spark):
    got = rows_of(spark, windows.list_counters)
    for by, at, level in ROWS:
        same = [x for x in ROWS if x[0] == by and x[1] <= at]
        if level is not None:
            last = max((x[1] for x in same if x[2] is not None and x[2] < level), default=-1)
            same = [x for x in same if x[1] > last]
        assert got[by, at] == sum(x[2] == level for x in same)


def test_tree_of_many_levels(spark):
    got = rows_of(spark, windows.level_tree)
    for by, at, level in ROWS:
        assert got[by, at] == max((x[1] for x in ROWS if level is not None and x[0] == by and x[1] < at and x[2] is not None and x[2] < level), default=None)


def test_closure_of_a_long_chain_and_a_cycle(spark):
    edges = [(i + 1, i) for i in range(70)] + [(100, 101), (101, 102), (102, 100)]
    got = {(r.node, r.ancestor): r.steps for r in joins.closure(spark.createDataFrame(edges, "child int, parent int")).collect()}
    want = {(a, b): a - b for a in range(71) for b in range(a)} | {(100 + a, 100 + b): (b - a) % 3 or 3 for a in range(3) for b in range(3)}
    assert got == want
