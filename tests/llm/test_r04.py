"""Findings of round 4."""

import numpy as np

from quern.llm import jaccard


def test_unrelated_sets_share_no_tile():
    rng = np.random.default_rng(4)
    sizes = np.repeat([30, 180, 400, 1450, 4100], 200)
    hashes = [np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)) for n in sizes]
    first = np.concatenate([[0], np.cumsum([len(h) for h in hashes])])
    keys, begin = jaccard._tiles(np.concatenate(hashes), first)
    owner = np.repeat(np.arange(len(sizes)), np.diff(begin))
    _, inverse = np.unique(keys, return_inverse=True)
    # no tile has two owners: parts without shingles made many that had
    assert len(np.unique(inverse)) == len(np.unique(np.stack([inverse, owner]), axis=1).T)


def test_sets_at_the_threshold_share_a_tile_where_parts_are_uneven():
    """Pairs whose differences spoil as many parts as they can, fullest ones first."""
    rng = np.random.default_rng(5)
    for n in (12, 25, 60, 172, 400, 1000):
        for _ in range(40):
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
            low, parts, reach = jaccard.bands(len(a))
            given = int(parts[np.searchsorted(low, len(a), "right") - 1])
            m = given + int(np.ceil(getattr(jaccard, "SPARE", 0) * given))
            part = ((a >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(int)
            fullest = np.argsort(-np.bincount(part, minlength=m), kind="stable")
            gone = [int(np.flatnonzero(part == p)[0]) for p in fullest if (part == p).any()]
            k = max(k for k in range(len(gone) + 1) if k == 0 or 100 * (len(a) - k) >= 90 * len(a))
            b = np.delete(a, gone[:k])
            keys, begin = jaccard._tiles(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
            assert given < 2 or np.isin(keys[: begin[1]], keys[begin[1] :]).any()
