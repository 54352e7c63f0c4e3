"""How many pairs just above the cosine threshold the lattice lets meet."""

from __future__ import annotations

import numpy as np
import pytest

from tidemark.llm import lattice


@pytest.mark.parametrize("dim", [64, 384])
@pytest.mark.parametrize("cosine", [0.9, 0.91, 0.92])
def test_pairs_at_the_threshold_meet(dim, cosine):
    how = lattice.Lattice()
    rng = np.random.default_rng([dim, int(100 * cosine)])
    x, z = rng.normal(size=(2, 2000, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    (own_x, look_x), (own_y, look_y) = (lattice.cell_keys(v, how) for v in (x, cosine * x + np.sqrt(1 - cosine**2) * z))
    width = look_x.shape[1] // how.tables
    met = np.zeros(len(x), bool)
    for t in range(how.tables):
        cells = slice(t * width, (t + 1) * width)
        met |= (look_x[:, cells] == own_y[:, t : t + 1]).any(1) | (look_y[:, cells] == own_x[:, t : t + 1]).any(1)
    assert met.mean() >= 0.99
