"""Reachability against brute force, limits, cycles and history."""

import random
from collections import deque

import pytest

from noticegrid.operators import graph

BRIDGE = ("opportunity_id bigint, document_id bigint, depth int, parent_id bigint, role string, limitation string, "
          "is_root boolean, active boolean, first_seen_at timestamp_ntz")


def brute(roots, edges, max_depth, cap):
    """Queue-based walk in (depth, parent's place, target) order."""
    out = {}
    for notice in {n for n, _ in roots}:
        start = sorted({d for n, d in roots if n == notice})
        seen, queue, marked = set(start), deque((d, 0) for d in start), False
        out.update({(notice, d): (0, None) for d in start})
        while queue:
            parent, depth = queue.popleft()
            for target in sorted(edges.get(parent, ())):
                if target in seen:
                    continue
                seen.add(target)
                limit = "depth_limit" if depth + 1 > max_depth else None
                if len(seen) > cap:
                    if marked:
                        continue
                    limit, marked = "document_limit", True
                out[(notice, target)] = (depth + 1, limit)
                if limit is None:
                    queue.append((target, depth + 1))
    return out


def run(spark, roots, edges, max_depth, cap):
    r = spark.createDataFrame(sorted(roots), "opportunity_id bigint, document_id bigint")
    e = spark.createDataFrame([(d, t, "reference") for d, ts in edges.items() for t in ts], "document_id bigint, target_id bigint, role string")
    return {(x.opportunity_id, x.document_id): (x.depth, x.limitation) for x in graph.reach(r, e, max_depth, cap).collect()}


@pytest.mark.parametrize("seed,max_depth,cap", [(1, 4, 250), (2, 2, 7), (3, 1, 3), (4, 4, 12)])
def test_same_as_brute_force(spark, seed, max_depth, cap):
    rnd = random.Random(seed)
    edges = {d: {rnd.randrange(60) for _ in range(rnd.randrange(6))} for d in range(60)}
    edges[7] = set(range(60))  # one hub that everything can reach
    roots = {(n, rnd.randrange(60)) for n in range(12) for _ in range(rnd.randrange(1, 5))}
    assert run(spark, roots, edges, max_depth, cap) == brute(roots, edges, max_depth, cap)


def test_cap_with_many_links_and_with_many_roots(spark):
    edges = {0: set(range(1, 401)), 401: {500}}
    reached = run(spark, {(1, 0)}, edges, 4, 10)
    assert len(reached) == 11 and sum(limit == "document_limit" for _, limit in reached.values()) == 1
    roots = {(1, d) for d in range(1, 15)} | {(1, 401)}
    assert run(spark, roots, edges, 4, 10) == brute(roots, edges, 4, 10)


def test_chain_cycle_and_depth_limit(spark):
    edges = {1: {2}, 2: {1, 3}, 3: {4}}
    assert run(spark, {(9, 1)}, edges, 1, 250) == {(9, 1): (0, None), (9, 2): (1, None), (9, 3): (2, "depth_limit")}


def test_removed_links_become_inactive_history(spark):
    import datetime as dt

    old = spark.createDataFrame([
        (9, 1, 0, None, "call_content", None, True, True, dt.datetime(2024, 1, 1)),
        (9, 2, 1, 1, "reference", None, False, True, dt.datetime(2024, 1, 2))], BRIDGE)
    links = spark.createDataFrame([(1, 5, "attachment")], "document_id bigint, target_id bigint, role string")
    affected = spark.createDataFrame([(9,)], "opportunity_id bigint")
    rows = {r.document_id: r for r in graph.refresh_notices(affected, old, links, "2024-02-01 00:00:00").collect()}
    assert rows[1].active and rows[1].is_root
    assert not rows[2].active and rows[2].first_seen_at == dt.datetime(2024, 1, 2)
    assert rows[5].active and rows[5].role == "attachment" and rows[5].first_seen_at == dt.datetime(2024, 2, 1)


def whole_walk(roots, edges, max_depth):
    """(depth, parent, role, position) of every document, by a queue in order of reach; ``edges``: document -> {target: roles}."""
    out = {}
    for notice in {n for n, _ in roots}:
        start = sorted({d for n, d in roots if n == notice})
        found = {d: (0, None, "call_content", i + 1) for i, d in enumerate(start)}
        queue = deque(start)
        while queue:
            parent = queue.popleft()
            depth = found[parent][0]
            if depth > max_depth:
                continue
            for target in sorted(edges.get(parent, ())):
                if target not in found:
                    found[target] = (depth + 1, parent, min(edges[parent][target]), len(found) + 1)
                    queue.append(target)
        out.update({(notice, d): row for d, row in found.items()})
    return out


@pytest.mark.parametrize("seed,max_depth,cap", [(1, 4, None), (2, 2, None), (3, 3, 1000), (4, 0, None)])
def test_parents_roles_and_positions(spark, seed, max_depth, cap):
    rnd = random.Random(seed)
    edges = {d: {rnd.randrange(80): [rnd.choice("abc") for _ in range(rnd.randrange(1, 3))] for _ in range(rnd.randrange(5))} for d in range(80)}
    edges[7] = {t: ["hub"] for t in range(80)}
    roots = {(n, rnd.randrange(80)) for n in range(15) for _ in range(rnd.randrange(1, 4))}
    r = spark.createDataFrame(sorted(roots), "opportunity_id bigint, document_id bigint").repartition(5)
    e = spark.createDataFrame([(d, t, role) for d, ts in edges.items() for t, roles in ts.items() for role in roles], "document_id bigint, target_id bigint, role string")
    got = {(x.opportunity_id, x.document_id): (x.depth, x.parent_id, x.role, x.position) for x in graph.reach(r, e, max_depth, cap).collect()}
    assert got == whole_walk(roots, edges, max_depth)


def test_levels_before_are_not_shuffled_again(spark):
    """The plan of a level has one exchange of its own rows by notice; the tables of earlier levels are read in their buckets."""
    edges = [(d, (d * 7 + k) % 50, "reference") for d in range(50) for k in (1, 2)]
    r = spark.createDataFrame([(n, n % 50) for n in range(200)], "opportunity_id bigint, document_id bigint")
    e = spark.createDataFrame(edges, "document_id bigint, target_id bigint, role string")
    spark.conf.set(graph.CO_PARTITION, "false")
    try:
        levels = graph._levels(r, e, 1)
        keys = ["opportunity_id", "document_id"]
        steps = graph._steps(levels[-1], e).repartition(8, "opportunity_id").groupBy(*keys).count()
        for known in levels:
            steps = steps.join(known.select(*keys).hint("merge"), keys, "left_anti")
        plan = steps._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(graph.CO_PARTITION, "true")
    assert plan.count("Exchange hashpartitioning(opportunity_id") == 1 and plan.count("Bucketed: true") >= len(levels)
