"""Walks with a limit of paths against all paths."""

import random

from drydock.operators import graph


def test_second_steps_only_where_first_ones_are_few(spark, rows):
    r = random.Random(6)
    edges = [(f"e{i:03d}", f"n{r.randint(0, 14)}", f"n{min(r.randint(0, 14), r.randint(0, 14))}") for i in range(60)] + [("x1", "far", "n0"), ("x2", "lone", "loner")]
    seeds = [(f"q{i}", f"n{r.randint(0, 14)}") for i in range(12) for _ in range(i % 3 + 1)] + [("qf", "far"), ("ql", "lone"), ("qn", "nowhere")]
    both = [(e, a, b) for e, a, b in edges] + [(e, b, a) for e, a, b in edges if a != b]
    for limit in (1, 4, 30):
        want = []
        for q in sorted({q for q, _ in seeds}):
            one = [(1, s, e, "", b) for q2, s in seeds if q2 == q for e, a, b in both if a == s]
            paths = sorted([x[:4] for x in one] + [(2, s, e, e2, "")[:4] for _, s, e, _, far in one for e2, a, b in both if a == far and e2 != e])[:limit]
            met = {}
            for n, _, e, e2 in paths:
                for x in filter(None, (e, e2)):
                    met[x] = min(n, met.get(x, 9))
            want += [(q, e, n) for e, n in met.items()]
        s = spark.createDataFrame(seeds, "query_id string, id string")
        e = spark.createDataFrame(edges, "edge_id string, head_id string, tail_id string")
        assert rows(graph.neighborhood(s, e, 2, limit), "query_id", "edge_id", "hops") == sorted(want, key=repr)
