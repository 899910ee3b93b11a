import itertools
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from riverline.catalog import QUERIES, SQL
from riverline.operators import search

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, db, name):
    a, b = QUERIES[name](spark, DATA).toPandas(), db.sql(SQL[name]).df()
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    for c in cols:
        if a[c].dtype.kind in "fiu" and b[c].dtype.kind in "fiu":
            a[c], b[c] = a[c].astype(float), b[c].astype(float)
    pd.testing.assert_frame_equal(*(x[cols].sort_values(cols).reset_index(drop=True) for x in (a, b)), check_dtype=False)


def test_nearest_segment_at_the_limit(spark, tmp_path):
    """Distances that are 60 only when rounded are within the limit, as in the SQL."""
    event = {k * 7919 % 1000: k for k in range(1000)}  # by y in tenths
    over = [t for t in range(400) if (t + 600) / 10 - t / 10 > 60][:3]
    rows = [(event[y] + 1000 * (2 * line + step), line, "view", 1.0) for k, t in enumerate(over) for line, ys in ((3 * k, [t]), (3 * k + 1, [t + 600, 999])) for step, y in enumerate(ys)]
    pd.DataFrame(rows, columns=["event_id", "user_id", "event_type", "value"]).to_parquet(tmp_path / "events.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    want = sorted(con.sql(SQL["join_nearest_segment"]).fetchall())
    assert sorted(map(tuple, QUERIES["join_nearest_segment"](spark, str(tmp_path)).collect())) == want == [(3 * k + 1, 0, 60.0) for k in range(3)]


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_search_queries_run(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_never_rising_is_the_best_fit():
    rng = np.random.default_rng(1)
    for _ in range(20):
        v = rng.integers(0, 5, 5).astype(float)
        got = search.never_rising(v)
        assert (np.diff(got) <= 1e-12).all()
        grid = np.arange(0, 4.01, 0.5)
        best = min(((np.array(c) - v) ** 2).sum() for c in itertools.product(grid, repeat=5) if all(x >= y for x, y in zip(c, c[1:])))
        assert ((got - v) ** 2).sum() <= best + 1e-9


def test_level_path_equals_enumeration():
    rng = np.random.default_rng(2)
    for _ in range(10):
        cost = rng.integers(0, 9, (5, 4))
        want = min(sum(cost[i][s] for i, s in enumerate(p)) + 2 * sum(abs(a - b) for a, b in zip(p, p[1:])) for p in itertools.product(range(4), repeat=5) if all(abs(a - b) <= 2 for a, b in zip(p, p[1:])))
        assert search.cheapest_levels(cost, 2.0, 2)[1] == want


def test_cascade_equals_enumeration():
    rng = np.random.default_rng(3)
    for _ in range(12):
        sites = sorted(rng.choice(np.arange(10, 500, 35), 4, replace=False).tolist())
        weight, lowest = rng.integers(1, 9), float(rng.choice([-np.inf, 3.5, 5.5]))
        reach = lambda a, b, level, w=weight: (b - a) * abs(level - w) / 10
        build = lambda lift: 7 * lift
        states = {}  # (last site, level) -> the least cost of a chain that ends there
        for n in range(1, 5):
            for chosen in itertools.combinations(sites, n):
                if any(b - a < 60 for a, b in zip((0, *chosen), chosen)):  # the source keeps its distance, too
                    continue
                for ups in itertools.product([2.0, 3.5], repeat=n):
                    level, at, total = 0.0, 0.0, 0.0
                    for s, u in zip(chosen, ups):
                        total += reach(at, s, level) + build(u)
                        at, level = s, round(level + u, 3)
                    if level <= 8 and level >= lowest:
                        key = (at, level)
                        states[key] = min(states.get(key, np.inf), total + reach(at, 500.0, level))
        got = search.cascade(sites, [2.0, 3.5], 500.0, 60.0, 8.0, 0.0, reach, build, terminal_level=lowest, best=3)
        assert np.allclose([c for c, _ in got], sorted(states.values())[:3])
        assert len(search.cascade(sites, [2.0, 3.5], 500.0, 60.0, 8.0, 0.0, reach, build, terminal_level=lowest, best=-1)) == max(0, len(states) - 1)
        for cost, chain in got:
            lifts = np.diff([0.0, *(h for _, h in chain)])
            assert abs(search.cascade_cost(list(zip((s for s, _ in chain), lifts)), 500.0, 0.0, reach, build)[0] - cost) < 1e-9


def test_a_site_near_the_source_is_not_chosen():
    near = search.cascade([10.0], [2.0], 100.0, 60.0, 8.0, 0.0, lambda a, b, level: 0 * (b - a) + 0 * level, lambda lift: 1.0)
    assert near == []


def test_cascade_query_covers_whole_lines(spark):
    from riverline.plans.searches import filled

    lines = filled(spark, DATA).toPandas().sort_values(["line_id", "idx"])
    got = QUERIES["search_cascade"](spark, DATA).toPandas()
    assert lines.idx.max() >= 72
    for line, p in lines.groupby("line_id"):
        x, run = p.chainage.tolist(), [0.0, *np.cumsum(p.filled)]
        best = {(0.0, 0): (0.0, 0)}  # (level, vertex) -> cost; vertex 0 carries no structure
        for k in range(1, len(x)):
            for (level, i), (cost, _) in list(best.items()):
                for lift in (2.5, 4.0):
                    if x[k] - x[i] >= 150 and level + lift <= 12:
                        total = cost + run[k] - run[i] + level * (x[k] - x[i]) / 1000 + 40 * lift
                        best[level + lift, k] = min(best.get((level + lift, k), (np.inf, 0)), (total, i))
        # the first vertex is the source
        want = min((c + run[-2] - run[i] + level * (x[-1] - x[i]) / 1000 for (level, i), (c, _) in best.items() if i), default=None)
        totals = got[got.line_id == line].total
        assert (want is None and not len(totals)) or np.allclose(totals, want, atol=1e-6) and len(totals)


def test_jumps_and_monotone():
    assert search.jumps(np.array([0, 1, 9, 9, 1, 1.0]), 5).tolist() == [False, False, True, True, False, False]
    assert search.shortest([(0, 1, 2.0), (1, 2, 2.0), (0, 2, 5.0)], 0) == {0: 0.0, 1: 2.0, 2: 4.0}


def test_engine_imports_without_text_operators():
    import subprocess
    import sys

    code = "import sys; sys.modules['riverline.llm'] = None; import __spark_entry__ as e; assert 'flagship_volumes' in e.queries() and not any(k.startswith('op') and k[2:3].isdigit() for k in e.queries())"
    assert subprocess.run([sys.executable, "-c", code], cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__)))).returncode == 0


def test_weirs():
    bed, along = np.array([0.0, 1, 4, 4, 9, 20]), np.arange(6) * 100.0
    assert search.crossings_of(bed, along, 3.0, 0.0, 8.0) == [(0.0, 3.0), (pytest.approx(100 + 200 / 3), 6.0), (pytest.approx(340.0), 9.0)]
    found = search.crossings_of(bed, along, 5.0, 0.0, 8.0, implanted=2.0, start=150.0)
    assert found[0] == (200.0, 7.0) and found[1] == (pytest.approx(360.0), 10.0) and len(found) == 2
    with pytest.raises(ValueError):
        search.crossings_of(bed, along, 2.0, 0.0, 8.0, implanted=2.0)


def test_streaming_maximum(spark, tmp_path):
    from riverline.streaming.readings import running_maximum

    spark.createDataFrame([(1, 2.0), (1, 5.0), (2, 1.0)], "user_id long, value double").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("user_id long, value double").parquet(str(tmp_path / "in"))
    q = running_maximum(stream).writeStream.outputMode("update").format("memory").queryName("most").start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.sql("SELECT * FROM most").collect()} == {(1, 5.0), (2, 1.0)}


def test_streaming(spark, tmp_path):
    from riverline.streaming.readings import windowed

    spark.read.parquet(f"{DATA}/events.parquet").select("user_id", "ts", "value").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("user_id long, ts timestamp, value double").parquet(str(tmp_path / "in"))
    q = windowed(stream).writeStream.outputMode("complete").format("memory").queryName("readings").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT sum(n) FROM readings").first()[0] == 1000
