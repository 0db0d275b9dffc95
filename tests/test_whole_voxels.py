from __future__ import annotations

from laminar.plans import registry  # noqa: F401, I001  first: it imports the others in order
from laminar.plans import adapters as A
from laminar.plans.further import voxel_components


def test_voxel_components_take_every_voxel(spark):
    sf = "/root/testdata/sf0.001"
    mask = {(r["slab"], r["z"], r["y"], r["x"]) for r in A.voxels(spark, sf).where("pred > 0").collect()}
    got = {(r["slab"], r["z"], r["y"], r["x"]): r["component"] for r in voxel_components(spark, sf).collect()}
    assert set(got) == mask
    left, groups = set(mask), []
    while left:
        wave = [left.pop()]
        group = set(wave)
        while wave:
            s, z, y, x = wave.pop()
            for n in ((s, z + 1, y, x), (s, z - 1, y, x), (s, z, y + 1, x), (s, z, y - 1, x), (s, z, y, x + 1), (s, z, y, x - 1)):
                if n in left:
                    left.remove(n)
                    group.add(n)
                    wave.append(n)
        groups.append(group)
    assert all(len({got[v] for v in g}) == 1 for g in groups)
    assert len({got[next(iter(g))] for g in groups}) == len(groups)
