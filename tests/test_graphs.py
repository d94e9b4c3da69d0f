"""Graph and tree operators against plain versions, and their number of rounds."""

from __future__ import annotations

import random

import pytest

from waybill.operators import fixpoint, graph
from waybill.operators.tours import list_rank, preorder

NODES, DEPS = "id string", "action_id string, depends_on string"


@pytest.fixture()
def rounds(monkeypatch):
    made = []
    plain = fixpoint._replaced
    monkeypatch.setattr(fixpoint, "_replaced", lambda *a: made.append(1) or plain(*a))
    return made


def plain_levels(nodes, deps):
    known, waits = {}, {n: {d for a, d in deps if a == n and d in nodes} for n in nodes}
    while True:
        new = {n: 1 + max((known[d] for d in w), default=-1) for n, w in waits.items() if n not in known and all(d in known for d in w)}
        if not new:
            return known
        known |= new


def reach(start, next_of):
    found, todo = set(), list(start)
    while todo:
        for n in next_of.get(todo.pop(), ()):
            if n not in found:
                found.add(n)
                todo.append(n)
    return found


def plain_cycles(nodes, deps):
    waits = {}
    for a, d in deps:
        if a in nodes and d in nodes:
            waits.setdefault(a, set()).add(d)
    below = {n: reach([n], waits) for n in nodes}
    looped = {n for n in nodes if n in below[n]}
    return {
        (n, min({n} | {m for m in below[n] if n in below[m]}) if n in looped else n, n in looped)
        for n in nodes if n in looped or below[n] & looped
    }


@pytest.mark.parametrize("seed,density", [(2, 1.3), (3, 3.0)])
def test_random_graphs(frame, seed, density):
    rng = random.Random(seed)
    nodes = [f"n{k:02}" for k in range(40)]
    deps = list({(rng.choice(nodes), rng.choice([*nodes, "gone"])) for _ in range(int(40 * density))})
    levels = graph.dependency_levels(frame([(n,) for n in nodes], NODES), frame(deps, DEPS))
    assert {r.id: r.level for r in levels.collect()} == plain_levels(nodes, deps)
    found = graph.cycle_check(frame([(n,) for n in nodes], NODES), frame(deps, DEPS))
    assert {(r.id, r.component, r.in_cycle) for r in found.collect()} == plain_cycles(nodes, deps)
    status = {n: rng.choice(["failed", "pending", "pending", "pending", "succeeded"]) for n in nodes}
    blocked, new = set(), {n for n in nodes if status[n] == "failed"}
    while new:
        new = {a for a, d in deps if d in new and status[a] == "pending"} - blocked
        blocked |= new
    got = graph.blocked_closure(frame(list(status.items()), "id string, status string"), frame(deps, DEPS))
    assert sorted(r.id for r in got.collect()) == sorted(blocked)


def test_acyclic_graphs_with_many_paths(frame, rounds):
    rng = random.Random(5)
    nodes = [f"n{k:03}" for k in range(60)]
    deps = list({(nodes[b], nodes[a]) for a, b in (sorted(rng.sample(range(60), 2)) for _ in range(400))})
    deps += [(f"l{k}{x}", f"l{k - 1}{y}") for k in range(1, 40) for x in "ab" for y in "ab"]
    nodes += [f"l{k}{x}" for k in range(40) for x in "ab"]
    levels = graph.dependency_levels(frame([(n,) for n in nodes], NODES), frame(deps, DEPS))
    assert {r.id: r.level for r in levels.collect()} == plain_levels(nodes, deps)
    assert len(rounds) <= 12


def test_chains_take_few_rounds(frame, rounds):
    names = [f"c{k:04}" for k in range(1000)]
    nodes, deps = frame([(n,) for n in names], NODES), frame(list(zip(names[1:], names)), DEPS)
    assert {r.id: r.level for r in graph.dependency_levels(nodes, deps).collect()} == {n: k for k, n in enumerate(names)}
    assert len(rounds) <= 15
    rounds.clear()
    actions = frame([(n, "pending" if k else "failed") for k, n in enumerate(names)], "id string, status string")
    assert graph.blocked_closure(actions, deps).count() == 999
    assert len(rounds) <= 15


def test_empty_graph(frame):
    nodes, deps = frame([], NODES), frame([], DEPS)
    assert graph.dependency_levels(nodes, deps).count() == graph.cycle_check(nodes, deps).count() == 0
    assert graph.cycle_check(frame([("a",)], NODES), frame([("a", "a")], DEPS)).collect()[0].in_cycle
    assert graph.blocked_closure(frame([], "id string, status string"), deps).count() == 0


PAGES = "key string, parent string, title string, pos bigint"


def plain_order(pages):
    keys, below = {p[0] for p in pages}, {}
    for key, parent, title, pos in pages:
        below.setdefault(parent if parent in keys else None, []).append((pos, title, key))
    out, stack = [], sorted(below.get(None, []), reverse=True)
    while stack:
        key = stack.pop()[2]
        out.append(key)
        stack += sorted(below.get(key, []), reverse=True)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_random_trees_in_order(frame, seed):
    rng = random.Random(seed)
    pages = []
    for k in range(300):
        parent = None if k == 0 or rng.random() < 0.1 else "nowhere" if rng.random() < 0.05 else f"p{rng.randrange(max(0, k - rng.choice([2, 300])), k)}"
        pages.append((f"p{k}", parent, rng.choice("abc"), rng.randrange(4)))
    rng.shuffle(pages)
    got = graph.tree_emit_order(frame(pages, PAGES)).orderBy("position").collect()
    assert [r.position for r in got] == list(range(1, 301))
    assert [r.key for r in got] == plain_order(pages)


def test_depth_of_5000(frame, rounds):
    pages = [(f"p{k:04}", f"p{k - 1:04}" if k else None, "t", 0) for k in range(5000)]
    pages += [("x", "y", "t", 0), ("y", "x", "t", 0), ("z", "y", "t", 0)]
    flat = {r.key: (r.depth, r.root) for r in graph.flatten_pages(frame(pages, PAGES)).collect()}
    assert all(flat[f"p{k:04}"] == (k, "p0000") for k in range(5000)) and flat["z"] == (None, None)
    assert len(rounds) <= 16


def test_order_of_a_deep_tree(frame):
    pages = [(f"p{k:04}", f"p{k - 1:04}" if k else None, "t", 0) for k in range(60)]
    pages += [(f"q{k:04}", f"p{k:04}", "t", -1 if k % 2 else 1) for k in range(0, 60, 7)]
    pages += [("x", "y", "t", 0), ("y", "x", "t", 0), ("z", "y", "t", 0)]
    got = [r.key for r in graph.tree_emit_order(frame(pages, PAGES)).orderBy("position").collect()]
    assert got == [*plain_order(pages[:-3]), "x", "y", "z"]


def test_one_parent_of_many_and_empty(frame):
    pages = [("r", None, "t", 0)] + [(f"k{k:05}", "r", "t", k) for k in range(3000)]
    got = graph.tree_emit_order(frame(pages, PAGES)).orderBy("position").collect()
    assert [r.key for r in got] == [p[0] for p in pages]
    assert graph.tree_emit_order(frame([], PAGES)).count() == 0
    assert preorder(frame([("a", None, 1, "t")], "key string, up string, pos bigint, title string")).collect()[0].position == 1


def test_list_ranks(frame):
    stops = frame([(3, 1, 5), (1, 2, 0), (2, None, 7), (9, None, 1), (4, 9, 2)], "at bigint, next bigint, w int")
    assert {r["at"]: r.rest for r in list_rank(stops).collect()} == {3: 12, 1: 7, 2: 7, 9: 1, 4: 3}


def test_dependencies_on_what_waits_for_nothing_enter_no_round(frame, monkeypatch):
    deps = [("a", "b"), ("b", "a"), ("c", "a"), ("x", "y"), ("gone", "a"), ("c", "gone")] + [(n, f"leaf{i}") for n in "abc" for i in range(20)]
    nodes = sorted({n for pair in deps for n in pair} - {"gone"})
    seen, solve = [], graph.solve
    monkeypatch.setattr(graph, "solve", lambda base, edges, *more, **named: (seen.append(edges.count()), solve(base, edges, *more, **named))[1])
    found = {(r.id, r.component, r.in_cycle) for r in graph.cycle_check(frame([(n,) for n in nodes + nodes], NODES), frame(deps + deps, DEPS)).collect()}
    assert found == {("a", "a", True), ("b", "a", True), ("c", "c", False)}
    assert seen[:2] == [3, 2]
