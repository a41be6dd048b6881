import numpy as np
import pytest

from lodefield.operators import contours
from lodefield.plans import modelling


def cells_of(spark, fields):
    rows = [(z0, int(i) - 3, int(j) - 3, float(v)) for z0, f in fields.items() for (i, j), v in np.ndenumerate(f) if v is not None]
    return spark.createDataFrame(rows, "z0 double, cx bigint, cy bigint, grade_mean double")


def field(seed, n=14):
    rng = np.random.default_rng(seed)
    f = rng.normal(size=(n, n)).astype(object)
    f[rng.random((n, n)) < 0.05] = None
    return f


def walk(segments):
    """Lines by following the segments one at a time: {(z0, level, first crossing): (closed, points)}."""
    after, before, place = {}, {}, {}
    for r in segments:
        a, b = (r.z0, r.level, r.cx, r.cy, r.side), (r.z0, r.level, r.to_cx, r.to_cy, r.to_side)
        assert a not in after and b not in before
        after[a], before[b] = b, a
        for node, at in ((a, (r.x, r.y)), (b, (r.to_x, r.to_y))):
            assert np.allclose(place.setdefault(node, at), at)
    lines, left = {}, set(place)
    for closed, starts in ((False, sorted(n for n in place if n not in before)), (True, sorted(place))):
        for start in starts:
            if start not in left:
                continue
            line, at = [], start
            while at in left:
                left.remove(at)
                line.append(place[at])
                at = after.get(at)
            lines[start] = (closed, line)
    return lines


@pytest.mark.parametrize("levels", [1, 5, 12])
def test_lines_equal_a_walk_along_the_segments(spark, levels):
    segments = contours.contour_segments(cells_of(spark, {0.0: field(1), 20.0: field(2), 40.0: np.full((4, 4), 7.0)}), 10.0, levels)
    want = walk(segments.collect())
    got = {}
    for r in contours.contour_lines(segments).collect():
        got.setdefault((r.z0, r.level, r.line_cx, r.line_cy, r.line_side), {})[r.place] = (r.closed, r.x, r.y)
    assert set(got) == set(want) and {c for c, _ in want.values()} == {False, True}
    for key, (closed, line) in want.items():
        assert sorted(got[key]) == list(range(len(line)))
        assert all(got[key][i][0] == closed and np.allclose(got[key][i][1:], p) for i, p in enumerate(line))


def test_a_round_hill_has_closed_lines_at_its_levels_with_the_top_on_the_left(spark):
    i, j = np.mgrid[0:41, 0:41]
    r = np.hypot(i - 20, j - 20)
    segments = contours.contour_segments(cells_of(spark, {0.0: 100.0 - r}), 1.0, 6)
    rows = segments.collect()
    centre = 20 - 3 + 0.5
    for s in rows:
        # A cell is 1 wide and the cone's slope is 1, so a crossing lies as far from the top as the level is below it.
        assert abs(np.hypot(s.x - centre, s.y - centre) - (100 - s.level)) < 0.1
        assert (s.to_x - s.x) * (centre - s.y) - (s.to_y - s.y) * (centre - s.x) >= -1e-9
    lines = walk(rows)
    inner = {key[1]: closed for key, (closed, _) in lines.items() if 100 - key[1] < 20}
    assert len(inner) >= 3 and all(inner.values())


def test_a_long_spiral_of_one_line_is_chained(spark):
    # One ridge that winds through the grid: its line is far longer than the rounds that chain it.
    f = np.zeros((80, 61))
    for k in range(0, 80, 4):
        f[k, 1:60] = 1.0
        f[k : k + 5, 59 if k % 8 == 0 else 1] = 1.0
    segments = contours.contour_segments(cells_of(spark, {0.0: f}), 1.0, 1)
    lines = walk(segments.collect())
    longest = max(len(line) for _, line in lines.values())
    got = contours.contour_lines(segments).groupBy("line_cx", "line_cy", "line_side", "level").count().agg({"count": "max"}).first()[0]
    assert got == longest > 1000


def test_saddles_follow_the_mean_and_missing_cells_end_lines(spark):
    high = contours.contour_segments(cells_of(spark, {0.0: np.array([[3.0, 0.0], [0.0, 3.0]]), 1.0: np.array([[2.0, 0.0], [0.0, 2.0]])}), 1.0, 1)
    for s in high.collect():  # no segment joins opposite sides of a saddle
        assert {s.side, s.to_side} == {0, 1}
    assert high.count() > 0
    gone = contours.contour_segments(cells_of(spark, {0.0: np.array([[1.0, 2.0], [3.0, float("nan")]])}))
    assert gone.count() == 0 and contours.contour_lines(gone).count() == 0
    empty = contours.contour_segments(cells_of(spark, {0.0: np.zeros((1, 1))}).limit(0))
    assert contours.contour_lines(empty).count() == 0


def test_reports_hold_isolines_of_the_given_cell(spark):
    rows = [(float(10 * i + 5), float(10 * j + 5), -float(d), float(i + j), f"{i}-{j}-{d}") for i in range(8) for j in range(8) for d in (1, 2)]
    df = spark.createDataFrame(rows, "x double, y double, depth double, grade double, sample_id string")
    out = modelling.report_tables(df.filter("depth < -1.5"), df.filter("depth > -1.5"), contour_cell=10.0)
    lines = out["contour_lines"].collect()
    # The grade is (x + y - 10) / 10, so every point lies on its level.
    assert lines and all(abs((r.x + r.y - 10) / 10 - r.level) < 1e-9 for r in lines)
    assert "contour_lines" not in modelling.report_tables(df.filter("depth < -1.5"), df.filter("depth > -1.5"))
