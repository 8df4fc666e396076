import random

from trendspark.operators.components import keyed_components
from trendspark.operators.components import components


def test_a_long_shuffled_path_is_one_component(spark):
    names = list(range(5000))
    random.Random(1).shuffle(names)
    edges = spark.createDataFrame(list(zip(names, names[1:])) + [(10_000, 10_001)], "a long, b long")
    labels = {r["node"]: r["label"] for r in components(edges).collect()}
    assert len(labels) == 5000 and all(labels[n] == 0 for n in range(1, 5000)) and labels[10_001] == 10_000


def test_keys_are_graphs_of_their_own(spark):
    nodes = spark.createDataFrame([(k, n) for k in (0, 1) for n in range(6)], "level int, node long")
    edges = spark.createDataFrame([(0, 0, 1), (0, 2, 1), (1, 4, 5), (1, 3, 5), (1, 0, 0)], "level int, src long, dst long")
    found = {(r["level"], r["node"]): r["comp"] for r in keyed_components(nodes, edges, ["level"]).collect()}
    assert [found[0, n] for n in range(6)] == [0, 0, 0, 3, 4, 5]
    assert [found[1, n] for n in range(6)] == [0, 1, 2, 3, 3, 3]


def test_topics_merge_by_recomputed_means(spark):
    from trendspark.operators.cluster import merge_topics

    means = spark.createDataFrame([(0, [1.0, 0.0, 0.0], 10), (1, [0.99, 0.1, 0.0], 20), (2, [0.0, 1.0, 0.0], 5),
                                   (3, [0.0, 0.0, 1.0], 5), (4, [0.5, 0.7, 0.0], 1)], "topic int, mean array<double>, n long")
    assert merge_topics(means, 4) == {0: 1, 1: 1, 2: 2, 3: 3, 4: 2}  # three topics and the outliers
    assert len(set(merge_topics(means, 2, with_outliers=False).values())) == 2
