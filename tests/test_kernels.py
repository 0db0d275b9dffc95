from __future__ import annotations

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from laminar.operators import kernels as K


def mask(seed, shape=(6, 9, 8), share=0.7):
    return np.random.default_rng(seed).random(shape) < share


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 10**6), st.floats(0.2, 0.95))
def test_distance_against_all_pairs(seed, share):
    m = mask(seed, share=share)
    bg = np.argwhere(~m)
    got = K.distance(m)
    for at in np.argwhere(m):
        want = np.sqrt(((bg - at) ** 2).sum(1).min()) if len(bg) else np.inf
        assert got[tuple(at)] == want or abs(got[tuple(at)] - want) < 1e-9
    assert (got[~m] == 0).all()


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 10**6), st.floats(0.1, 0.9))
def test_components_against_flood_fill(seed, share):
    m = mask(seed, share=share)
    got, seen, n = K.components(m), np.zeros(m.shape, int), 0
    for at in map(tuple, np.argwhere(m)):
        if seen[at]:
            continue
        n += 1
        wave = [at]
        seen[at] = n
        while wave:
            p = wave.pop()
            for a in range(3):
                for d in (-1, 1):
                    q = (*p[:a], p[a] + d, *p[a + 1 :])
                    if 0 <= q[a] < m.shape[a] and m[q] and not seen[q]:
                        seen[q] = n
                        wave.append(q)
    assert (got == seen).all()


def test_flood_keeps_mask_and_markers():
    m = mask(3)
    markers = np.where(m, np.random.default_rng(1).integers(0, 30, m.shape) == 0, 0) * np.arange(1, m.size + 1).reshape(m.shape)
    out = K.flood(np.random.default_rng(2).random(m.shape), markers, m)
    assert (out[~m] == 0).all() and (out[markers > 0] == markers[markers > 0]).all()
    comp = K.components(m)
    touched = set(comp[markers > 0].tolist())
    assert all((out[m] > 0) == np.isin(comp[m], list(touched)))


def test_flood_of_two_valleys():
    height = np.array([[0, 1, 5, 1, 0]], dtype=float)
    out = K.flood(height, np.array([[1, 0, 0, 0, 2]]), np.ones((1, 5), bool))
    assert out[0, :2].tolist() == [1, 1] and out[0, 3:].tolist() == [2, 2]


def test_gaussian_and_tensor():
    flat = np.ones((9, 9, 9))
    assert np.allclose(K.gaussian(flat, 1.0), 1)
    ramp = np.broadcast_to(np.arange(24.0)[:, None, None], (24, 5, 5))
    assert np.allclose(K.gaussian(ramp, 1.0, 1, 0)[8:16], -1, atol=1e-3) or np.allclose(K.gaussian(ramp, 1.0, 1, 0)[8:16], 1, atol=1e-3)
    sheet = np.exp(-((np.arange(15) - 7) ** 2) / 4.0)[:, None, None] * np.ones((15, 15, 15))
    t = K.structure_tensor(sheet)
    assert abs(t["normal"][5, 7, 7, 0]) > 0.99 and t["planarity"][5, 7, 7] > 0.9
    ridge = K.ridges(sheet)
    assert ridge[7, 7, 7] and not ridge[3, 7, 7]
    d = K.dip(1 - sheet, 4)
    assert d["dip"] > 0.5 and d["contrast"] > 0.5


def test_equalise_range_and_monotone():
    plane = np.random.default_rng(0).random((20, 20))
    out = K.equalise(plane, 64, 1.0)
    order = np.argsort(plane.ravel())
    assert (np.diff(out.ravel()[order]) >= -1e-12).all() and 0 <= out.min() and out.max() <= 1


def test_sample_is_exact_on_the_grid():
    block = np.random.default_rng(0).random((4, 5, 6))
    at = np.argwhere(np.ones_like(block))
    assert np.allclose(K.sample(block, at), block.ravel())
    assert np.isclose(K.sample(block, np.array([[0.5, 0, 0]]))[0], block[:2, 0, 0].mean())
    assert np.isclose(K.sample(block, np.array([[-3, 9, 2.0]]))[0], block[0, 4, 2])


def test_separate_and_split():
    two = np.zeros((7, 20, 20), bool)
    two[1:6, 1:8, :] = True
    two[1:6, 11:18, :] = True
    two[3, 8:11, 9] = True
    lab = K.separate(two, 2.0)
    assert (lab[~two] == 0).all() and lab[3, 4, 10] != lab[3, 14, 10] and len(set(lab[two].tolist()) - {0}) == 2
    out = K.split_stack(two * 0.7)
    assert ((out > 0) == two).all()
    assert 0.5 <= K.scale_of(K.distance(two)) <= 8
