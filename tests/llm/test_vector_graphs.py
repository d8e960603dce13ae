import tracemalloc

import numpy as np
from skylattice.llm import vector_graphs


def vectors():
    rng = np.random.default_rng(7)
    base = rng.normal(size=(300, 16))
    near = base[rng.integers(0, 30, 400)] + rng.normal(scale=0.08, size=(400, 16))
    chain = base[0] + np.cumsum(rng.normal(scale=0.12, size=(40, 16)), 0)
    return np.concatenate([base, near, chain, base[:5], 3 * base[5:8]])


def by_brute_force(v):
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    links = u @ u.T >= 0.9
    np.fill_diagonal(links, False)
    label = np.arange(len(v))
    while True:
        new = np.minimum(label, np.where(links, label[None, :], len(v)).min(1))
        if (new == label).all():
            return links.sum(1), label
        label = new


def test_graphs_find_the_links():
    v = vectors()
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    graph = vector_graphs.build(np.arange(len(u)), np.ones(len(u), np.int64), u)
    again = vector_graphs.Graph.unpacked(graph.packed())
    assert all((a == b).all() for a, b in zip(graph.layers, again.layers)) and len(graph.layers) == len(again.layers)
    truth = u @ graph.exact.T >= 0.9
    found = sum(len(x) for x in vector_graphs.links_in(graph, u))
    assert found >= 0.99 * truth.sum()


def cut_off(pairs, others):
    """A graph of pairs and other vectors with no edges to the second of any pair; its unit vectors, and the pairs."""
    rng = np.random.default_rng(9)
    first = rng.normal(size=(pairs, 32))
    v = np.concatenate([first, first + rng.normal(scale=0.05, size=first.shape), others(rng)])
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    graph = vector_graphs.build(np.arange(len(u)), np.ones(len(u), np.int64), u)
    lost = np.flatnonzero((graph.ids >= pairs) & (graph.ids < 2 * pairs) & (np.arange(len(u)) > 0))
    for layer in graph.layers:
        layer[np.isin(layer, lost)] = -1
    return graph, u


def all_found(graph, u, **how):
    truth = u @ graph.exact.T >= 0.9
    return all((np.sort(x) == np.flatnonzero(t)).all() if len(x) == t.sum() else False for x, t in zip(vector_graphs.links_in(graph, u, **how), truth))


def test_points_out_of_reach_are_found_whatever_a_large_group_has():
    graph, u = cut_off(300, lambda rng: rng.normal(size=32) + rng.normal(scale=0.05, size=(900, 32)))
    assert all_found(graph, u, own=np.arange(len(u)))


def test_rare_links_are_found():
    graph, u = cut_off(30, lambda rng: rng.normal(size=(3000, 32)))
    assert all_found(graph, u, own=np.arange(len(u)))


def test_links_and_components_by_brute_force(spark):
    v = vectors()
    rows = [(k, [float(x) for x in r]) for k, r in enumerate(v)]
    found = vector_graphs.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).toPandas().set_index("vec_id").sort_index()
    links, label = by_brute_force(v)
    assert found.n_links.sum() >= 0.99 * links.sum() and (found.n_links.to_numpy() <= links).all()
    assert (found.component_id.to_numpy() == label).mean() > 0.99 and (found.kept == (found.index == found.component_id)).all()


def test_odd_rows(spark):
    one, two = [1.0, 2.0, 3.0], [1.0, 2.0, 3.1]
    rows = [(1, one), (2, two), (3, None), (4, []), (5, [0.0, 0.0, 0.0]), (6, [1.0, None, 1.0]), (7, [1.0, float("nan"), 1.0]),
            (8, [1.0, float("inf"), 1.0]), (9, one), (9, one), (None, one), (10, [1.0, 2.0]), (11, [-0.0, 0.0, 1e-200]), (12, [0.0, 0.0, 1e200])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS label", "2 AS cid", "3 AS shard")
    found = [(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in vector_graphs.near_vectors(df).collect()]
    assert sorted(found, key=lambda r: (r[0] is None, r[0])) == [
        (1, 4, 1, True), (2, 4, 1, False), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True), (6, 0, 6, True), (7, 0, 7, True),
        (8, 0, 8, True), (9, 4, 1, False), (9, 4, 1, False), (10, 0, 10, True), (11, 1, 11, True), (12, 1, 11, False), (None, 4, None, False)]
    assert vector_graphs.near_vectors(df.limit(0)).count() == 0


def test_memory_stays_bounded_among_near_copies():
    """Hubs that a whole batch links to, and queries that all link with each other: neither is held at once."""
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(40, 48))
    v = np.concatenate([rng.normal(size=(6000, 48)), centers.repeat(60, 0) + rng.normal(scale=0.05, size=(2400, 48))])
    v = v[rng.permutation(len(v))]
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    tracemalloc.start()
    vector_graphs.build(np.arange(len(u)), np.ones(len(u), np.int64), u)
    built = tracemalloc.get_traced_memory()[1]
    same = rng.normal(size=48) + rng.normal(scale=0.02, size=(6000, 48))
    same /= np.linalg.norm(same, axis=1, keepdims=True)
    nothing = np.full((len(same), 1), -1)
    graph = vector_graphs.Graph(np.arange(len(same)), np.ones(len(same), np.int64), same, [nothing])
    tracemalloc.reset_peak()
    assert sum(len(ids) for _, ids in vector_graphs.each_links(graph, same, own=np.arange(len(same)))) == 6000 * 6000
    assert built < 70e6 and tracemalloc.get_traced_memory()[1] < 120e6
    tracemalloc.stop()
