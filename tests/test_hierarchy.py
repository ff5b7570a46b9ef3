import random

from claimweave.operators.hierarchy import Hierarchy, containment

EDGES = "source_id string, target_id string, type string, status string, child string, parent string"


def frame(spark, links, extra=()):
    rows = [(p, c, "CONTAINS", "active", "x", "y") for p, c in links]
    return spark.createDataFrame([*rows, *extra], EDGES)


def brute(links):
    nodes = {x for l in links for x in l}
    par, ups, kids = {}, {}, {}
    for p, c in links:
        par[c] = min(par.get(c, p), p)
        ups.setdefault(c, set()).add(p)
        kids.setdefault(p, set()).add(c)

    def closure(x, steps):
        seen, todo = set(), [x]
        while todo:
            for k in steps.get(todo.pop(), ()):
                if k not in seen:
                    seen.add(k)
                    todo.append(k)
        return seen

    down = {x: closure(x, kids) for x in nodes}
    on = {x for x in nodes if x in down[x]}
    out = set()
    for x in nodes:
        lost = bool(({x} | closure(x, ups)) & on)
        y, d = x, 0
        while not lost and y in par:
            y, d = par[y], d + 1
        out.add((x, "" if lost else y, -1 if lost else d, len(down[x] - {x}), int(x in on)))
    return out


def run(spark, links, extra=()):
    out = [tuple(r) for r in Hierarchy(containment(frame(spark, links, extra))).rows().select("node_id", "root_id", "depth", "n_below", "in_cycle").collect()]
    assert len(out) == len(set(out))
    return set(out)


def test_shapes_against_brute_force(spark):
    random.seed(7)
    chain = [(f"c{i}", f"c{i + 1}") for i in range(40)]
    star = [("hub", f"s{i}") for i in range(50)] + [("s1", "s1a"), ("c20", "hub")]
    loops = [("l1", "l2"), ("l2", "l3"), ("l3", "l1"), ("l2", "below"), ("below", "deep"), ("self", "self"), ("self", "under")]
    tree = [(f"t{random.randrange(i)}", f"t{i}") for i in range(1, 60)]
    links = chain + star + loops + tree
    assert run(spark, links + links[:9]) == brute(links)


def test_dirty_ends_and_types(spark):
    extra = [(" a ", "b ", "DECLARES", "active", "x", "y"), ("c", "b", "MEMBER_OF", "active", "x", "y"), ("a", None, "CONTAINS", "active", "x", "y"), ("  ", "z", "CONTAINS", "active", "x", "y"), ("a", "q", "CONTAINS", "rejected", "x", "y"), ("a", "w", "CALLS", "active", "x", "y"), ("a", "v", None, "active", "x", "y")]
    assert run(spark, [], extra) == {("a", "a", 0, 2, 0), ("b", "a", 1, 1, 0), ("c", "a", 2, 0, 0)}


def test_empty_and_second_parent(spark):
    assert run(spark, []) == set()
    links = [("p2", "x"), ("p1", "x"), ("x", "y")]
    assert run(spark, links) == {("p1", "p1", 0, 2, 0), ("p2", "p2", 0, 2, 0), ("x", "p1", 1, 1, 0), ("y", "p1", 2, 0, 0)} == brute(links)


def test_several_parents_against_closure(spark):
    """Diamonds, further parents above each other, loops over further parents, leaves with a lost parent."""
    random.seed(5)
    tree = [(f"t{random.randrange(max(0, i - 6), i)}", f"t{i}") for i in range(1, 50)]
    further = [("t3", "t40"), ("t40", "t47"), ("other", "t20"), ("t2", "t49"), ("u1", "t48")]
    diamond = [("d0", "d1"), ("d0", "d2"), ("d1", "d3"), ("d2", "d3"), ("d3", "d4"), ("d4", "leaf"), ("d1", "leaf")]
    loops = [("q1", "q2"), ("q2", "q3"), ("q3", "q1"), ("a0", "q1"), ("q3", "d2"), ("q2", "qleaf"), ("a1", "qleaf"), ("r1", "r2"), ("r2", "r1"), ("r2", "x9"), ("s0", "x9"), ("x9", "x10"), ("a1", "a2")]
    links = tree + further + diamond + loops
    assert run(spark, links) == brute(links)
    assert run(spark, tree + further) == brute(tree + further)


def test_paths_and_intervals(spark):
    random.seed(11)
    links = [(f"c{i}", f"c{i + 1}") for i in range(25)] + [("hub", f"s{i}") for i in range(30)] + [("s1", f"s1x{i}") for i in range(9)] + [("c9", "hub"), ("l1", "l2"), ("l2", "l1"), ("l2", "below"), ("below", "deep")] + [(f"t{random.randrange(i)}", f"t{i}") for i in range(1, 40)]
    par = {c: p for p, c in links}
    h = Hierarchy(containment(frame(spark, links)))
    path = {r.node_id: r.path for r in h.paths().collect()}
    rows = h.intervals().collect()
    assert len(rows) == len(path) == len(set(par) | set(par.values())) == len({r.node_id for r in rows})
    lost = {"l1", "l2", "below", "deep"}
    spot = {(r.tree_id, r.first): r.node_id for r in rows}
    assert len(spot) == len(rows)
    for r in rows:
        way, x = [r.node_id], r.node_id
        while r.node_id not in lost and x in par:
            x = par[x]
            way.insert(0, x)
        assert path[r.node_id] == ("" if r.node_id in lost else " > ".join(way))
        below, todo = set(), [r.node_id]
        while todo:
            y = todo.pop()
            for c, p in par.items():
                if p == y and c not in below and c not in ("l1", "l2"):
                    below.add(c)
                    todo.append(c)
        assert {spot[r.tree_id, k] for k in range(r.first + 1, r.last + 1)} == below
