import math
from collections import Counter

import pytest
from llm.edge_rows import ROWS, documents, words

from renderscope.llm import mixing


def shares(sizes, limit=3.0):
    """Targets by filling and sharing again, source by source."""
    total, weight = sum(sizes), [(5.0, 2.0, 1.0)[i % 3] for i in range(len(sizes))]
    full, out = set(), [0.0] * len(sizes)
    while True:
        rest = [i for i in range(len(sizes)) if i not in full]
        left = total - sum(limit * sizes[i] for i in full)
        for i in rest:
            out[i] = left * weight[i] / sum(weight[j] for j in rest)
        over = [i for i in rest if out[i] > limit * sizes[i]]
        if not over:
            return out
        for i in over:
            out[i] = limit * sizes[i]
        full.update(over)


def brute(rows, limit=3.0):
    """Copies that each (source, size) cell takes: rates by halving, rounded along sizes, two single moves."""
    cells = {}
    for r in rows:
        cells.setdefault(r[3], Counter())[len(words(r[1]))] += 1
    names = sorted([s for s in cells if s is not None], key=lambda s: s.encode()) + [None] * (None in cells)
    totals = [sum(size * n for size, n in cells[s].items()) for s in names]
    out = {}
    for source, total, target in zip(names, totals, shares(totals, limit), strict=True):
        counted = sorted(cells[source].items())
        largest = counted[-1][0]

        def rate(tilt, size, largest=largest):
            return min(limit, math.exp(min(tilt * size / largest, 9.0))) if size else 0.0

        full = total == 0 or target >= limit * total
        low, high = -4000.0, 4000.0
        for _ in range(200 * (not full)):
            mid = (low + high) / 2
            over = sum(n * size * rate(mid, size) for size, n in counted) > target
            low, high = (low, mid) if over else (mid, high)
        due, plan = 0.0, []
        for size, n in counted:
            r = limit if full else rate(low, size)
            before, due = math.floor(due + 0.5), due + (r - math.floor(r)) * n
            plan.append([size, n, math.floor(r), math.floor(due + 0.5) - before])
        for _ in range(2):
            gap = target - sum(size * (n * base + more) for size, n, base, more in plan)
            free = [p for p in plan if (p[3] < p[1] and p[2] < limit if gap > 0 else p[3] > 0)]
            best = min(((abs(p[0] - abs(gap)), p[0]) for p in free), default=(math.inf, 0))
            if best[0] < abs(gap):
                next(p for p in plan if p[0] == best[1])[3] += 1 if gap > 0 else -1
        for size, n, base, more in plan:
            out[source, size] = (n * base + more) if size else 0
    return out


def copies_by_cell(rows):
    """The same from documents as a mix hands them out."""
    return Counter((r.source, len(words(r.text))) for r in rows)


def test_against_brute_force(spark):
    rows = [
        (i // 2, " ".join(["w"] * (1 + i * i % 97)), "en", f"s{i % 7 if i % 3 else 0}", 1, "x") for i in range(2000)
    ]
    docs = documents(spark, rows=rows)
    want = {k: n for k, n in brute(rows).items() if n}
    assert copies_by_cell(mixing.repeated(docs).collect()) == want
    # Rows that share an id come out as often as their own plans say.
    planned = Counter()
    for r in mixing.mixed(docs).collect():
        planned[r.doc_id] += r.copies
    assert Counter(r.doc_id for r in mixing.repeated(docs).collect()) == Counter({k: n for k, n in planned.items() if n})


def test_plan_grows_in_proportion(spark):
    docs = documents(spark)
    cells = mixing.sized(docs).groupBy("source", "size").count().withColumnRenamed("count", "n")
    state = mixing.targets(cells)
    state = state.selectExpr("*", "false full", "false done", "0d tilt", "cast(null as double) low", "cast(null as double) high")
    cells, sizes = cells.withColumnRenamed("source", "cell_source"), []
    for _ in range(5):
        state = mixing._newton(state, cells, 3.0)
        sizes.append(len(state._jdf.queryExecution().optimizedPlan().toString()))
    assert sizes[4] - sizes[3] < 1.2 * (sizes[1] - sizes[0])


def test_unsolved_rates_raise(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_JOBS", 1)
    monkeypatch.setattr(mixing, "STEPS_A_JOB", 1)
    rows = [(i, " ".join(["w"] * (1 + i)), "en", f"s{i % 3}", 1, "x") for i in range(90)]
    with pytest.raises(RuntimeError):
        mixing.mixed(documents(spark, rows=rows))


def test_edges(spark):
    got = mixing.mixed(documents(spark, "taken string")).collect()
    assert len(got) == len(ROWS)
    by = {}
    for r in ROWS:
        by[r[3]] = by.get(r[3], 0) + len(words(r[1]))
    names = sorted([n for n in by if n], key=lambda n: n.encode()) + [None]
    want = dict(zip(names, shares([by[n] for n in names]), strict=True))
    source = {r[0]: r[3] for r in ROWS}
    for r in got:
        if r.doc_id is not None:
            assert r.target == pytest.approx(want[source[r.doc_id]]) and r.source_size == by[source[r.doc_id]]
        assert 0 <= r.taken <= 3 * r.size


def test_near_targets_and_reruns(spark):
    rows = [
        (i, " ".join(["w"] * (1 + i * i % 97)), "en", f"s{i % 7 if i % 3 else 0}", 1, "x") for i in range(2000)
    ]
    docs = documents(spark, rows=rows)
    got = {r.doc_id: r for r in mixing.mixed(docs).collect()}
    again = {r.doc_id: r for r in mixing.mixed(docs.repartition(7, "n_chars", "doc_id")).collect()}
    assert got == again
    taken, target = {}, {}
    for r in rows:
        taken[r[3]] = taken.get(r[3], 0) + got[r[0]].taken
        target[r[3]] = got[r[0]].target
    assert all(abs(taken[s] - target[s]) <= 3 for s in target)
    # Rates are a tilt of size: one direction within a source.
    one = sorted((r.size, r.rate) for i, r in got.items() if rows[i][3] == "s1")
    assert [x for _, x in one] in (sorted(x for _, x in one), sorted((x for _, x in one), reverse=True))


def test_hot_cell_is_ranked_in_shares(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANK_ROWS", 8)
    rows = [(i, "a b c", "en", "s" if i % 3 else "t", 1, "x") for i in range(300)]
    got = mixing.mixed(documents(spark, rows=rows)).collect()
    for source_size in {r.source_size for r in got}:
        part = [r for r in got if r.source_size == source_size]
        assert abs(sum(r.taken for r in part) - part[0].target) <= 3


def test_repeated_and_empty(spark):
    docs = documents(spark, "copies string")
    got = mixing.repeated(docs)
    assert got.columns == docs.columns
    assert mixing.mixed(docs.limit(0)).collect() == []
    assert mixing.mixed(docs.filter("text is null or doc_id = 4")).select("taken").distinct().collect()[0][0] == 0
