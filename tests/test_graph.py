import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from lodestone.config import EngineConfig
from lodestone.operators import graph

PAGES = "id long, ns int, title string, text_id long"


def tables(spark, n, links, ns=None):
    pages = spark.createDataFrame([(i, 0 if ns is None else ns[i], f"p{i}", i) for i in range(n)], PAGES)
    return pages, spark.createDataFrame(links, "source_id long, target_id long")


def by_numpy(n, links, n_all=None, rounds=50, tol=1e-6):
    out = np.bincount([s for s, _ in links], minlength=n)
    r = np.full(n, 1 / n)
    for _ in range(rounds):
        c = np.zeros(n)
        for s, t in links:
            c[t] += r[s] / out[s]
        new = 0.15 / (n_all or n) + 0.85 * (c + (1 - c.sum()) / n)
        done = np.abs(new - r).max() < tol
        r = new
        if done:
            break
    return r


def test_toy_graph(spark):
    links = [(0, 1), (0, 2), (1, 0), (2, 0)]
    rows = sorted(graph.page_rank(*tables(spark, 4, links)).collect())
    assert np.allclose([r["rank1"] for r in rows], by_numpy(4, links), atol=1e-9)
    assert not any(r["converged"] for r in rows)  # this graph swings: 0.85**50 is over the tolerance
    rows = graph.page_rank(*tables(spark, 4, [(0, 1), (1, 2), (2, 0), (0, 2), (3, 3)])).collect()
    assert all(r["converged"] and r["rank1"] == r["rank2"] for r in rows)


def test_exhausted_rounds_keep_the_vector_before(spark):
    links = [(0, 1), (1, 2), (2, 0), (0, 2)]
    rows = sorted(graph.page_rank(*tables(spark, 3, links), config=EngineConfig(max_iterations=3)).collect())
    assert np.allclose([r["rank1"] for r in rows], by_numpy(3, links, rounds=3, tol=0))
    assert np.allclose([r["rank2"] for r in rows], by_numpy(3, links, rounds=2, tol=0))


def test_teleport_over_all_pages_and_links_out_of_the_namespace(spark):
    pages, links = tables(spark, 4, [(0, 1), (1, 0), (2, 0), (0, 3), (3, 3)], ns=[0, 0, 0, 14])
    rows = sorted(graph.page_rank(pages, links).collect())
    assert [r["id"] for r in rows] == [0, 1, 2]
    assert np.allclose([r["rank1"] for r in rows], by_numpy(3, [(0, 1), (1, 0), (2, 0)], n_all=4), atol=1e-9)
    assert sum(r["rank1"] for r in rows) == pytest.approx(0.85 + 0.15 * 3 / 4)
    assert sum(r["rank1"] for r in graph.page_rank(pages, links, teleport="ns").collect()) == pytest.approx(1)


def test_empty_namespace(spark):
    assert graph.page_rank(*tables(spark, 2, [(0, 1)]), ns=14).count() == 0


def test_degrees_count_links_from_inside_only(spark):
    pages, links = tables(spark, 3, [(0, 1), (2, 1), (1, 1)], ns=[0, 0, 14])
    assert sorted(map(tuple, graph.degrees(pages, links, 0).collect())) == [(0, 0, 1), (1, 2, 1)]
    assert sorted(map(tuple, graph.degrees(pages, links).collect())) == [(0, 0, 1), (1, 3, 1), (2, 0, 1)]


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 7), st.integers(0, 7)), unique=True, max_size=20))
def test_paths_are_shortest(spark, links):
    pages, table = tables(spark, 8, links or [(0, 0)])
    row = graph.shortest_path(pages, table, "p0", "p7").first()
    level, seen = [(0,)], {0}
    while level and level[0][-1] != 7 and not any(p[-1] == 7 for p in level):
        level = sorted(p + (t,) for p in level for s, t in links if s == p[-1] and t not in seen)
        seen |= {p[-1] for p in level}
    best = min((p for p in level if p[-1] == 7), default=None)
    if best is None:
        assert row["error"] == "no path"
    else:
        assert row["path"] == [f"p{i}" for i in best] and row["hops"] == len(best) - 1


def test_path_to_itself_and_unknown_titles(spark):
    pages, links = tables(spark, 2, [(0, 1)])
    assert graph.shortest_path(pages, links, "p0", "p0").first()["hops"] == 0
    assert "no article" in graph.shortest_path(pages, links, "p0", "zz").first()["error"]
