import random
from datetime import datetime, timedelta

from veritide.operators import incidents
from veritide.operators.components import components

START = datetime(2024, 1, 1)
ALERT = "alert int, node string, ts timestamp"
EDGE, CHANGE = "source string, target string", "change string, node string, at timestamp"


def plain_components(links):
    parent = {}

    def root(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for a, b in links:
        if a is not None and b is not None:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in parent}


def test_components_of_chains_stars_and_noise(spark):
    rng = random.Random(1)
    names = list(range(400))
    rng.shuffle(names)
    links = [(names[i], names[i + 1]) for i in range(150)] + [(names[200], x) for x in names[201:300]] + [(rng.choice(names[300:]), rng.choice(names[300:])) for _ in range(60)]
    links += [(5, 5), (None, 7), (7, None), links[0]]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a int, b int")).collect()}
    assert got == plain_components(links)
    assert components(spark.createDataFrame([], "a int, b int")).count() == 0


def alerts(spark, *rows):
    return spark.createDataFrame([(i, n, None if m is None else START + timedelta(minutes=m)) for i, (n, m) in enumerate(rows)], ALERT)


def groups(members):
    out = {}
    for r in members.collect():
        out.setdefault(r.incident, set()).add(r.alert)
    return sorted(map(sorted, out.values()))


def test_chains_longer_than_a_hop_and_a_window(spark):
    edges = spark.createDataFrame([("raw.x", "a.x"), ("a.x", "b.x"), ("b.x", "c.x"), ("raw.y", "d.x")], EDGE)
    none = spark.createDataFrame([], CHANGE)
    # Each alert is near the next only; the last stands alone in time, another in lineage.
    rows = [("c.x", 0), ("b.x", 50), ("a.x", 105), ("c.x", 160), ("c.x", 400), ("d.x", 50), ("a.y", 50), ("zz", None)]
    members, signals, reach = incidents.correlate(alerts(spark, *rows), edges, none)
    assert groups(members) == [[0, 1, 2, 3, 6], [4], [5], [7]]
    report = {r.incident: r for r in incidents.described(members, signals, reach).collect()}
    # a.x and raw.x are upstream of four alerts; a.x is nearer.
    assert (report[0].alerts, report[0].nodes, report[0].origin, report[0].covers, report[0].signals) == (5, 4, "a.x", 4, ["lineage", "time"])
    assert report[4].signals == [] and report[7].origin == "zz"


def test_one_change_links_what_lies_hours_apart(spark):
    edges = spark.createDataFrame([("raw.x", "a.x"), ("raw.x", "b.x")], EDGE)
    changes = spark.createDataFrame([("deploy", "raw.x", START), ("later", "raw.x", START + timedelta(hours=30))], CHANGE)
    members, signals, _ = incidents.correlate(alerts(spark, ("a.x", 60), ("b.x", 600), ("a.x", 1500)), edges, changes)
    assert groups(members) == [[0, 1], [2]]
    assert [(r.signal, r.links) for r in signals.collect()] == [("change", 1)]


def test_cells_find_all_that_is_near(spark):
    rng = random.Random(5)
    rows = [(f"d{rng.randrange(3)}.c", rng.randrange(0, 6000)) for _ in range(120)]
    near = [(i, j) for i, a in enumerate(rows) for j, b in enumerate(rows) if a[0] == b[0] and abs(a[1] - b[1]) <= 30]
    members, _, _ = incidents.correlate(alerts(spark, *rows), spark.createDataFrame([], EDGE), spark.createDataFrame([], CHANGE), minutes=30)
    want = plain_components(near)
    assert {r.alert: r.incident for r in members.collect()} == want


def test_causes_are_ranked_by_independent_evidence(spark):
    edges = spark.createDataFrame([("far.x", "mid.x"), ("mid.x", "up.x"), ("up.x", "t.x"), ("side.x", "t.x"), ("t.x", "far.x")], EDGE)
    found = spark.createDataFrame([(1, "t.x", START), (2, "lone.x", START)], "incident int, origin string, opened_at timestamp")
    changes = spark.createDataFrame([("old", "up.*", START - timedelta(days=2)), ("new", "up.x", START - timedelta(hours=1)), ("after", "side.x", START + timedelta(hours=1))], CHANGE)
    failing = spark.createDataFrame([("far.x",), ("t.x",)], "node string")
    priors = spark.createDataFrame([("side.x", 2), ("side.x", 1), ("mid.x", 0)], "node string, times int")
    rows = incidents.ranked_causes(found, edges, changes, failing, priors).collect()
    got = [(r.rank, r.node, r.hops, round(r.score, 4), r.evidence, r.change, r.considered) for r in sorted(rows, key=lambda r: (r.incident, r.rank)) if r.incident == 1]
    assert got == [
        (1, "far.x", 3, 1.0, ["upstream failing"], None, 5), (2, "up.x", 1, 0.7, ["change", "proximity"], "new", 5), (3, "side.x", 1, 0.3625, ["proximity", "prior"], None, 5),
        (4, "t.x", 0, 0.25, ["proximity"], None, 5), (5, "mid.x", 2, 0.25, ["proximity"], None, 5),
    ]
    assert [(r.node, r.considered) for r in rows if r.incident == 2] == [("lone.x", 1)]
    assert incidents.ranked_causes(found, edges, changes, failing, priors, most=1).count() == 2


def test_what_is_upstream_is_written_once_for_each_hop(spark, monkeypatch):
    written, cut = [], incidents.cut
    monkeypatch.setattr(incidents, "cut", lambda df: written.append(cut(df)) or written[-1])
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(5)] + [("n5", "n0"), ("n0", "n0")], "source string, target string")
    got = incidents.upstream(spark.createDataFrame([("n5",), ("n5",), ("n2",)], "node string"), edges)
    assert sorted(tuple(r) for r in got.collect()) == sorted((f"n{n}", f"n{(n - h) % 6}", h) for n in (5, 2) for h in range(6))
    # Two nodes of twelve ancestors in all, and seven edges.
    assert sum(df.count() for df in written) == 12 + 7
