import json
import random

from kinegrid.config import Params
from kinegrid.operators import tubes
from kinegrid.operators.graph import connected_components
from kinegrid.functions.storage import materialise
from kinegrid.sources import sinks

EVENTS = "video_id string, event_id int, y int, x int, t0 int, t1 int"
MEMBERS = "video_id string, tube_id int, event_id int, y int, x int, t0 int, t1 int"


def test_radius_and_overlap(spark):
    rows = [("v", 1, 0, 0, 0, 3), ("v", 2, 2, 2, 3, 6), ("v", 3, 0, 3, 6, 7), ("v", 4, 0, 0, 5, 9), ("w", 5, 0, 1, 0, 9)]
    edges = tubes.neighbour_edges(spark.createDataFrame(rows, EVENTS))
    assert sorted((r.a, r.b) for r in edges.collect()) == [(1, 2), (2, 3), (2, 4)]


def test_small_tubes_go_before_merging(spark):
    rows = [("v", 1, 0, 0, 0, 5), ("v", 2, 0, 1, 0, 5), ("v", 3, 9, 9, 0, 5)]
    got = tubes.merge_events(spark.createDataFrame(rows, EVENTS)).collect()
    assert sorted((r.tube_id, r.event_id) for r in got) == [(1, 1), (1, 2)]


def test_fixpoint_takes_rounds(spark):
    # the first two are near; only their hull is near the third
    rows = [("v", 1, 1, 0, 2, 0, 10), ("v", 1, 2, 0, 3, 0, 10), ("v", 2, 3, 0, 5, 12, 100), ("v", 3, 4, 0, 0, 60, 70)]
    got = tubes.proximity_merge(spark.createDataFrame(rows, MEMBERS))
    assert {r.tube_id for r in got.collect()} == {1}


def test_containment(spark):
    box = lambda i, e, t0, t1: ("v", i, e, 0, 0, t0, t1)
    rows = [box(1, 1, 0, 9), box(2, 2, 0, 9), box(3, 3, 2, 5)]
    kept, removed = tubes.suppress_contained(spark.createDataFrame(rows, MEMBERS))
    assert [r.tube_id for r in removed.collect()] == [3]
    assert sorted((r.tube_id, r.event_id) for r in kept.collect()) == [(1, 1), (2, 2)]


def test_bbox_and_tracks(spark):
    rows = [("v", 1, 1, 1, 2, 0, 1), ("v", 1, 2, 3, 5, 3, 3)]
    track = tubes.tracks(spark.createDataFrame(rows, MEMBERS)).first()
    assert track.spatial_bbox_grid == [2, 1, 6, 4]
    assert [len(f.cells) for f in track.per_frame] == [1, 1, 0, 1]
    told = json.loads(sinks.track_json(tubes.tracks(spark.createDataFrame(rows, MEMBERS))).first().json)
    assert told["num_tubes"] == 1 and told["tubes"][0]["duration"] == 4


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long"), materialise).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 150)}


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long"), materialise).count() == 0


def test_no_tubes(spark):
    cells = spark.createDataFrame([("v", 0, 0, 0, 0.1)], "video_id string, t int, y int, x int, mu double")
    assert tubes.build_tubes(cells, Params()).count() == 0


def test_containment_equals_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for i in range(1, 120):
        y, x, t = rng.randrange(30), rng.randrange(30), rng.randrange(300)
        h, w, n = (rng.choice((0, 1, 3, 20)) for _ in range(3))
        rows += [("vw"[i % 2], i, 2 * i, y, x, t, t + n), ("vw"[i % 2], i, 2 * i + 1, y + h, x + w, t + n * 5, t + n * 9)]
    stats = tubes.tube_stats(spark.createDataFrame(rows, MEMBERS))
    boxes = {(r.video_id, r.tube_id): (r.t0, r.t1, r.y1, r.y2, r.x1, r.x2) for r in stats.collect()}
    inside = lambda a, b: a != b and all(b[k] <= a[k] and a[k + 1] <= b[k + 1] for k in (0, 2, 4))
    want = {i for i, a in boxes.items() if any(i != j and i[0] == j[0] and inside(a, b) for j, b in boxes.items())}
    assert want and {(r.video_id, r.tube_id) for r in tubes.contained(stats).collect()} == want


def test_neighbours_over_stretches_of_time(spark):
    rng = random.Random(5)
    rows = [("v", i, rng.randrange(5), rng.randrange(5), t, t + rng.choice((0, 5, 70, 300))) for i in range(150) for t in [rng.randrange(400)]]
    got = [(r.a, r.b) for r in tubes.neighbour_edges(spark.createDataFrame(rows, EVENTS)).collect()]
    want = [(a[1], b[1]) for a in rows for b in rows if a[1] < b[1] and 1 <= max(abs(a[2] - b[2]), abs(a[3] - b[3])) <= 2 and a[4] <= b[5] and b[4] <= a[5]]
    assert sorted(got) == sorted(want)


def near_by_force(rows, distance, gap):
    tubes_ = {}
    for _, i, _, y, x, t0, t1 in rows:
        cells, a, b = tubes_.get(i, (set(), t0, t1))
        tubes_[i] = (cells | {(y, x)}, min(a, t0), max(b, t1))
    close = lambda a, b: any(max(abs(p[0] - q[0]), abs(p[1] - q[1])) <= distance for p in a for q in b)
    return {(i, j) for i, a in tubes_.items() for j, b in tubes_.items() if i < j and max(b[1] - a[2] - 1, a[1] - b[2] - 1) <= gap and close(a[0], b[0])}


def random_members(rng, n, time):
    return [("v", i, 10 * i + k, rng.randrange(40), rng.randrange(40), t, t + rng.choice((0, 3, 40))) for i in range(1, n) for k in range(rng.randint(1, 3)) for t in [rng.randrange(time)]]


def test_proximity_equals_brute_force(spark):
    rng = random.Random(8)
    rows = random_members(rng, 120, 900)
    df = spark.createDataFrame(rows, MEMBERS)
    for distance, gap, stretch in ((1, 0, 16), (2, 20, 128), (3, 150, 64)):
        got = [(r.a, r.b) for r in tubes.proximity_edges(df, distance, gap, stretch=stretch).collect()]
        assert sorted(got) == sorted(near_by_force(rows, distance, gap)) and got
    some = spark.createDataFrame([("v", i) for i in range(1, 120, 3)], "video_id string, tube_id int")
    got = {(r.a, r.b) for r in tubes.proximity_edges(df, 2, 20, some).collect()}
    assert got == {(a, b) for a, b in near_by_force(rows, 2, 20) if a % 3 == 1 or b % 3 == 1}


def test_merging_by_what_has_grown_equals_merging_all(spark):
    rng = random.Random(9)
    rows = random_members(rng, 90, 700)
    got = {r.event_id: r.tube_id for r in tubes.proximity_merge(spark.createDataFrame(rows, MEMBERS), 2, 20).collect()}
    now = list(rows)
    while edges := near_by_force(now, 2, 20):
        root = {r[1]: r[1] for r in now}
        for _ in root:
            for a, b in edges:
                root[a] = root[b] = min(root[a], root[b])
        now = [(v, root[i], *rest) for v, i, *rest in now]
    groups = lambda pairs: sorted(sorted(e for e, j in pairs if j == i) for i in {j for _, j in pairs})
    assert groups([(r[2], r[1]) for r in now]) == groups(list(got.items()))


def test_tubes_of_other_times_do_not_meet(spark):
    """The pairs that are tested grow with the number of tubes that one cell has had, not with its square."""
    met = {}
    for n in (200, 400, 800):
        rows = [("v", i, i, 0, 0, 40 * i, 40 * i + 5) for i in range(1, n + 1)]
        df = spark.createDataFrame(rows, MEMBERS)
        met[n] = tubes.meetings(df, 2, 20).count()
        assert tubes.proximity_edges(df, 2, 20).count() == 0
    assert met[800] < 4.2 * met[200] and met[800] < 5 * 800
