"""Crawls against a loop that attempts one work after another, uninterrupted and killed after every commit."""

import random
import tempfile

import pytest

from vellum.operators import crawl as C
from vellum.operators.commits import Commits

SCHEMAS = "book long, work long", "work long, eligible boolean, cited_by long, cost double, outcome string, version long", "book long, ordinal long"


def graph(seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(12), 100 + rng.randrange(40)) for _ in range(70)] + [(0, None), (None, 101), (0, 999), (0, 101), (0, 101)]
    works = [(100 + k, rng.random() < 0.85 if k != 3 else None, rng.choice([None, 1, 5, 5, 9]), rng.choice([None, 0.5, 1.25]), rng.choice(["assigned", "assigned", "assigned_existing", "fetch_failed"]), rng.randrange(12) if k % 9 else None) for k in range(40)]
    return edges, works, [(0, 0), (1, 1), (0, 5), (None, 2)]


def one_by_one(edges, works, roots, max_depth=1, max_works=None, max_spend=None):
    known, out, tried = {w[0]: w for w in works}, [], set()
    level = [b for b, _ in sorted({b: o for b, o in sorted(roots, key=lambda r: -r[1]) if b is not None}.items(), key=lambda x: x[1])]
    visited, spent, attempted = set(level), 0.0, 0
    for depth in range(1, max_depth + 1):
        queue, seen = [], set()
        for book in level:
            mine = {w for b, w in edges if b == book and w in known and known[w][1] and w not in tried | seen}
            seen |= mine
            queue += [(w, book) for w in sorted(mine, key=lambda w: (-(known[w][2] if known[w][2] is not None else -1), w))]
        books, stopped = [], None
        for position, (w, book) in enumerate(queue, 1):
            _, _, _, cost, outcome, version = known[w]
            if stopped is None and max_works is not None and attempted >= max_works:
                stopped = "capped"
            if stopped is None and max_spend is not None and spent >= max_spend:
                stopped = "skipped_over_budget"
            if stopped:
                out.append((w, None, depth, book, position, stopped, 0.0))
                continue
            attempted += 1
            tried.add(w)
            paid = (cost or 0.0) if outcome == "assigned" else 0.0
            spent += paid
            got = version if outcome.startswith("assigned") else None
            out.append((w, got, depth, book, position, outcome, paid))
            if got is not None and got not in visited:
                visited.add(got)
                books.append(got)
        if stopped:
            break
        level = books
    return sorted(out)


@pytest.mark.parametrize("bounds", [{}, {"max_depth": 3}, {"max_depth": 9, "max_works": 13}, {"max_depth": 9, "max_spend": 6.0}, {"max_depth": 2, "max_works": 0}, {"max_depth": 4, "max_works": 9, "max_spend": 5.0}])
def test_crawl_equals_one_work_after_another(spark, bounds):
    for seed, slice_works in ((1, None), (2, 4)):
        edges, works, roots = graph(seed)
        frames = [spark.createDataFrame(x, s) for x, s in zip((edges, works, roots), SCHEMAS, strict=True)]
        got = C.crawl(*frames, tempfile.mkdtemp(), slice_works=slice_works, **bounds)
        assert sorted(tuple(r) for r in got.collect()) == one_by_one(edges, works, roots, **bounds)


def test_killed_after_every_commit_and_gone_on(spark):
    class Killed(Exception):
        pass

    def kill(state):
        if not state["done"]:
            raise Killed

    edges, works, roots = graph(2)
    frames = [spark.createDataFrame(x, s) for x, s in zip((edges, works, roots), SCHEMAS, strict=True)]
    folder, bounds, runs = tempfile.mkdtemp(), {"max_depth": 9, "max_works": 20}, 0
    while True:
        runs += 1
        try:
            got = C.crawl(*frames, folder, slice_works=5, on_commit=kill, **bounds)
            break
        except Killed:
            Commits(spark, folder).write(frames[0])  # what a run leaves that dies between two commits
    assert runs > 5
    want = one_by_one(edges, works, roots, **bounds)
    assert sorted(tuple(r) for r in got.collect()) == want
    assert sorted(tuple(r) for r in C.crawl(*frames, folder, **bounds).collect()) == want  # complete: nothing is done again


def test_two_runs_of_one_folder_do_not_both_commit(spark):
    log = Commits(spark, tempfile.mkdtemp())
    assert log.last() is None
    state = log.commit({"x": 1})
    assert log.last() == {"x": 1, "commit": 0}
    log.commit(state)
    with pytest.raises(RuntimeError):
        log.commit(state)


def test_crawl_of_nothing(spark):
    frames = [spark.createDataFrame([], s) for s in SCHEMAS]
    assert C.crawl(*frames, tempfile.mkdtemp(), max_depth=3, max_works=2, max_spend=1.0).count() == 0
