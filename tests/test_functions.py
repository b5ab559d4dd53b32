import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenreel.functions import image, text


def test_match_1d_finds_the_shift_and_breaks_ties_low():
    rng = np.random.default_rng(0)
    ref = rng.random((80, 4))
    p, sad, conf, overlap = image.match_1d(ref, ref[7:], 0, 20, 20)
    assert (p, sad, overlap) == (7, 0.0, 73) and conf == np.inf
    assert image.match_1d(np.ones((20, 2)), np.ones((20, 2)), 0, 4, 5)[0] == -4
    p, sad, conf, _ = image.match_1d(ref[:5], ref[:5], 0, 3, 50)
    assert p == -3 and sad == np.inf and np.isnan(conf)


def test_row_profile_drops_the_remainder():
    band = np.arange(30, dtype=np.uint8).reshape(2, 15)
    got = image.row_profile(band, 4, 0)
    assert got.shape == (2, 4) and got[0, 0] == 1 and got[0, 3] == 10
    assert image.row_profile(band, 40, 0).shape == (2, 1)


def test_masks():
    mask = np.zeros((20, 20), bool)
    mask[5:8, 5:8] = True
    assert image.dilate(mask, 2).sum() == 49
    assert image.dilate_cross(mask, 1).sum() == 21
    mask[15, 15] = True
    labels, found = image.components(mask, 2)
    assert len(found) == 1 and found[0]["bbox"] == [5, 5, 8, 8] and found[0]["area"] == 9 and labels[15, 15] == 0
    gap = np.zeros((9, 30), bool)
    gap[4, 5:10] = gap[4, 14:20] = True
    assert image.close(gap, 15, 3)[4, 10:14].all()


@given(st.integers(0, 2**31))
@settings(max_examples=15, deadline=None)
def test_components_agree_with_flood_fill(seed):
    mask = np.random.default_rng(seed).random((12, 13)) < 0.55
    labels, found = image.components(mask)
    seen, n = np.zeros_like(mask), 0
    for y, x in zip(*np.nonzero(mask), strict=True):
        if not seen[y, x]:
            n += 1
            todo, name = [(y, x)], labels[y, x]
            while todo:
                v, u = todo.pop()
                if 0 <= v < 12 and 0 <= u < 13 and mask[v, u] and not seen[v, u]:
                    seen[v, u] = True
                    assert labels[v, u] == name
                    todo += [(v + 1, u), (v - 1, u), (v, u + 1), (v, u - 1)]
    assert n == len(found)


def test_edges_extents_and_clearing():
    grey = np.full((40, 80), 10, np.uint8)
    grey[:, 20:50] = 200
    right, left = image.row_extents(image.canny(grey), exclude_from=70)
    assert set(right[2:-2]) <= {49, 50} and set(left[2:-2]) <= {19, 20}
    rgb = np.repeat(grey[:, :, None], 3, 2)
    rgb[:, 60:] = 99
    out = image.clear_beyond(rgb, right, left, (10, 10, 10), radius=3, inset=0)
    assert (out[:, 52:] == 10).all() and (out[5, 25] == 200).all()
    soft = image.soften_edge(out, np.full(40, 50), (10, 10, 10))
    assert soft[5, 50, 0] > soft[5, 51, 0] > soft[5, 52, 0] >= 10


def test_fills():
    rgb = np.arange(5 * 6 * 3, dtype=np.uint8).reshape(5, 6, 3)
    bad = np.zeros((5, 6), bool)
    bad[:, 2:4] = True
    out = image.fill_rows(rgb, bad)
    assert (out[:, 2] == rgb[:, 1]).all() and (out[:, 3] == rgb[:, 4]).all()
    hole = np.zeros((5, 6), bool)
    hole[2, 2] = True
    assert (image.nearest_fill(rgb, hole)[2, 2] == rgb[2, 1]).all()  # of equals the left one
    flat = np.full((7, 7, 3), 50, np.uint8)
    hole = np.zeros((7, 7), bool)
    hole[2:5, 2:5] = True
    flat[hole] = 0
    assert (image.diffuse_fill(flat, hole) == 50).all()
    seam = np.full((9, 30, 3), 100, np.uint8)
    seam[4] = 10
    assert (image.fix_seams(seam)[4, 6:-6] == 100).all() and (image.fix_seams(seam)[4, 0] == 10).all()
    rgba = np.full((9, 9, 4), 255, np.uint8)
    rgba[4, 4] = 0
    assert (image.grow_holes(rgba, 1)[:, :, 3] == 0).sum() == 5 and (image.grow_holes(rgba, 2) == 0).all(2).sum() == 13
    red = np.zeros((4, 8, 3), np.uint8)
    red[:, :, 0] = 200
    assert np.allclose(image.row_profile(red, 2, 0), 59.8) and np.allclose(image.col_profile(red), 59.8)
    assert image.match_1d(np.arange(60.0), np.arange(60.0) + 0.5, 0, 2, 50)[2] == 1.0  # no other place more than three steps away
    assert image.dense_columns(bad) == [(2, 4)]
    assert image.background(np.array([[[1, 2, 3], [1, 2, 3], [9, 9, 9]]], np.uint8)) == (1, 2, 3)


@pytest.mark.parametrize("shape", [(3, 4), (3, 4, 3), (3, 4, 4)])
def test_png_round_trip(shape):
    x = np.random.default_rng(0).integers(0, 255, shape, dtype=np.uint8)
    assert (image.read_png(image.png(x)) == x).all()


@pytest.mark.parametrize(
    ("a", "b", "score"),
    [("", "x", 0), ("a b", "b a", 100), ("a b c", "a b", 100), ("abcd", "abce", 75), ("x", "y", 0), ("same word", "same wood", 88)],
)
def test_token_set_score(a, b, score):
    assert abs(text.token_set_score(a, b) - score) <= 1


@given(st.text("abc ", max_size=25), st.text("abc ", max_size=25))
@settings(max_examples=200, deadline=None)
def test_score_is_symmetric_and_within_its_bound(a, b):
    got = text.token_set_score(a, b)
    assert got == text.token_set_score(b, a)
    assert got <= text.score_bound(frozenset(a.split()), frozenset(b.split()))


def _lcs(x, y):
    rows = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i, a in enumerate(x):
        for j, b in enumerate(y):
            rows[i + 1][j + 1] = rows[i][j] + 1 if a == b else max(rows[i][j + 1], rows[i + 1][j])
    return rows[-1][-1]


@given(st.text("abcd", max_size=20), st.text("abcd", max_size=20))
@settings(max_examples=200, deadline=None)
def test_common_subsequence(x, y):
    assert text._common(x, y) == _lcs(x, y)


def test_parsed_options():
    from lumenreel.functions.text import parse_circle, parse_colour

    assert parse_colour("0, 128,255") == (0, 128, 255) and parse_circle("-5,640,32") == (-5, 640, 32)
    for parse, wrong in ((parse_colour, "1,2"), (parse_colour, "1,2,256"), (parse_colour, "auto"), (parse_circle, "1,2,3,4"), (parse_circle, "a,2,3")):
        with pytest.raises(ValueError, match="expected"):
            parse(wrong)
