"""Tiles of one shape, weights about outlines and segments of tracks."""

import math
import random

import pytest

from lumentrack.sources import datasets

W, H = 7, 6


def image(spark, w=W, h=H):
    return spark.createDataFrame([(0, y, x, float(10 * y + x), (y * w + x) % 3) for y in range(h) for x in range(w)], "frame int, y int, x int, raw double, label int")


def boxes(spark, *rows):
    return spark.createDataFrame(rows, "frame int, object_id int, x0 int, y0 int, w int, h int")


def tile(row, width):
    return [list(row.raw[i : i + width]) for i in range(0, len(row.raw), width)], [list(row.label[i : i + width]) for i in range(0, len(row.label), width)]


def test_padding_and_back(spark):
    """Objects at the image's border: the middle of the tile is the box, around it the border goes on and labels end."""
    rng = random.Random(2)
    rows = [(0, 1, 0, 0, 2, 3), (0, 2, 4, 3, 3, 3), (0, 3, 0, 0, W, H), (0, 4, 6, 5, 1, 1)] + [(0, 10 + k, rng.randrange(4), rng.randrange(3), rng.randrange(1, 4), rng.randrange(1, 4)) for k in range(6)]
    found = datasets.tensors(boxes(spark, *rows), image(spark), 5, 4, ["raw"], ["label"]).collect()
    assert len(found) == len(rows)
    for r in found:
        raw, label = tile(r, 5)
        top, left = math.floor((4 - r.h) / 2), math.floor((5 - r.w) / 2)
        for i in range(4):
            for j in range(5):
                sy, sx = i - top, j - left
                y, x = r.y0 + min(max(sy, 0), r.h - 1), r.x0 + min(max(sx, 0), r.w - 1)
                assert raw[i][j] == 10 * y + x
                assert label[i][j] == ((y * W + x) % 3 if 0 <= sy < r.h and 0 <= sx < r.w else 0)


def test_stretching(spark):
    whole = (0, 1, 0, 0, W, H)
    same = datasets.tensors(boxes(spark, whole), image(spark), W, H, ["raw"], ["label"], mode="resample").collect()[0]
    assert same.raw == pytest.approx([10.0 * y + x for y in range(H) for x in range(W)]) and same.label == [(y * W + x) % 3 for y in range(H) for x in range(W)]
    twice = datasets.tensors(boxes(spark, (0, 1, 2, 1, 2, 1)), image(spark), 4, 2, ["raw"], ["label"], mode="resample").collect()[0]
    assert twice.raw == pytest.approx([12, 12.25, 12.75, 13] * 2)
    assert twice.label == [(W + 2) % 3] * 2 + [(W + 3) % 3] * 2 + [(W + 2) % 3] * 2 + [(W + 3) % 3] * 2


def test_tiles_of_nothing_and_of_repeated_boxes(spark):
    rows = [(0, 1, 0, 0, 1, 1), (0, 1, 0, 0, 1, 1), (9, 2, 0, 0, 1, 1), (0, 3, None, 0, 1, 1)]
    found = sorted(datasets.tensors(boxes(spark, *rows), image(spark), 1, 2, ["raw"], ["label"]).collect(), key=lambda r: r.object_id)
    assert [(r.object_id, r.raw, r.label) for r in found] == [(1, [0.0, 0.0], [0, 0])] * 2 + [(2, [None, None], [0, 0]), (3, [None, None], [0, 0])]
    assert datasets.tensors(boxes(spark, *rows).filter("false"), image(spark), 1, 2, ["raw"]).count() == 0
    with pytest.raises(ValueError):
        datasets.tensors(boxes(spark, *rows), image(spark), 1, 2, mode="other")


@pytest.mark.parametrize("erase", [False, True])
def test_border_weights(spark, erase):
    rng = random.Random(4)
    pixels = {("a", o, y, x) for o, (t, le) in enumerate([(0, 0), (1, 7), (9, 3)]) for y in range(t, t + 4) for x in range(le, le + 4) if rng.random() < 0.9} | {("b", 0, 3, 3)}
    df = spark.createDataFrame(sorted(pixels), "frame string, object_id int, y int, x int")
    got = {(r.frame, r.y, r.x): r.weight for r in datasets.border_weights(df, 14, 14, 2.0, 10.0, erase_contours=erase).collect()}
    assert len(got) == 2 * 14 * 14
    for (f, y, x), weight in got.items():
        mine = [p for p in pixels if p[0] == f]
        d = sorted(min(math.hypot(y - v, x - u) for _, n, v, u in mine if n == o) for o in {p[1] for p in mine})
        if d[0] == 0:
            own = next(o for _, o, v, u in mine if (v, u) == (y, x))
            edge = not all((f, own, y + a, x + b) in pixels for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0)))
            want = 0 if erase and edge else (196 - len(mine)) / len(mine)
        else:
            want = 1 + (10 * math.exp(-((d[0] + d[1]) ** 2) / 8) if len(d) > 1 else 0)
        assert weight == pytest.approx(want, abs=1e-8)
    assert datasets.border_weights(df, 14, 14, 2.0, 10.0, object_weight=3.0).filter("weight = 3").count() == len(pixels)
    assert datasets.border_weights(df, 14, 14, 2.0, 0.0).filter("frame = 'b' and weight = 1").count() == 195
    assert datasets.border_weights(df.filter("false"), 14, 14, 2.0, 10.0).count() == 0


def test_tracks_are_cut_at_gaps_and_where_no_link_is(spark):
    objects = spark.createDataFrame([(1, "t", 0), (2, "t", 1), (3, "t", 3), (4, "t", 4), (5, "t", 5), (6, "u", 2)], "id int, track string, frame int")
    links = spark.createDataFrame([(1, 2), (2, 3), (4, 5), (4, 5)], "src int, dst int")
    got = {r.id: (r.segment, r.place) for r in datasets.track_segments(objects, links).collect()}
    assert got == {1: (1, 1), 2: (1, 2), 3: (2, 1), 4: (3, 1), 5: (3, 2), 6: (1, 1)}
