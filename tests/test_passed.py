"""F2 F3 F5 F6 of the third round: what hierarchies leave on disk."""

import numpy as np
import pyarrow as pa

from gridweave.operators import packed
from gridweave.options import Options
from gridweave.plans import hierarchy as hier
from gridweave.session import staged
from gridweave.sources import graphs


def test_first_coarse_matrix_is_passed_through(spark, monkeypatch):
    for name, n in (("LOCAL", 0), ("BLOCK", 300), ("AT_ONCE", 200), ("FAR", 2000)):
        monkeypatch.setattr(packed, name, n)
    a = staged(graphs.laplacian(graphs.grid(spark, 14, jump=10.0).edges, 1.0), "a")
    o = {"max_coarse_size": 4, "max_levels": 4, "sp_omega": 0.7}
    got, want = (hier.build(a, Options.of(held_vertices=n, **o)) for n in (1000, 0))
    level = got.levels[1]
    assert level.kept is None and len(got.levels) == 4
    assert [(x.nv, x.ne, x.nnz) for x in got.levels] == [(x.nv, x.ne, x.nnz) for x in want.levels]
    x = np.arange(level.nv) % 5.0
    y, d = level.spmv(x), level.diagonal()
    assert level.kept is None
    for g, w in zip(got.levels, want.levels, strict=True):
        p, q = ({(r.i, r.j): r.v for r in m.matrix.collect()} for m in (g, w))
        assert p.keys() == q.keys() and np.allclose([p[k] for k in p], [q[k] for k in p], rtol=1e-9, atol=1e-9)
    assert np.allclose(level.spmv(x), y) and np.allclose(level.diagonal(), d)


def test_arrays_on_the_wire():
    r = np.random.default_rng(1)
    for a in (r.integers(-(2**31), 2**31 - 1, 999).astype(np.int32), r.integers(-(2**63), 2**63 - 1, 99), r.integers(-(2**15), 2**15, 400).astype(np.int16), r.normal(size=500), np.arange(3), np.zeros(50, np.int32), np.zeros(0)):
        b = packed.unwired(packed.wire((a, True)))[0]
        assert b.dtype == a.dtype and np.array_equal(a, b)
    cols = np.concatenate([np.sort(r.choice(20_000, 120, False)) for _ in range(200)]).astype(np.int32)
    b = packed.Block(0, np.arange(1, 201) * 120, cols, -np.ones(len(cols)))
    part = packed.stored(b)
    assert all(np.array_equal(x, y) for x, y in zip(packed.loaded(part), b, strict=True))
    assert len(pa.compress(part, codec="lz4", asbytes=True)) < 1.8 * len(cols)
