"""Simhash near-duplicates against brute force."""

import random

import numpy as np
import pytest
import xxhash

from lexiflow.llm import simhash


def slow_fingerprint(text, k=4):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(fps, threshold=4):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= threshold:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(fps))]


def test_fingerprint_matches_the_definition():
    for text in (None, "", "  \t\n", "One", "a b c", "A b C d", "a b c d e", "ÄÖ ab c d\x1ce f g  h", "x " * 500, "tie tie tie tie other words here"):
        assert simhash.fingerprint(text) == slow_fingerprint(text)


@pytest.mark.parametrize("covering", [simhash.COVERING, simhash.WIDER, (5, 2, 1)])
def test_every_link_meets_at_a_home(covering):
    rng = random.Random(1)
    fps = [rng.getrandbits(64) for _ in range(300)]
    for f in fps[:200]:
        for n in range(1, 6):
            for b in rng.sample(range(64), n):
                f ^= 1 << b
            fps.append(f)
    arr = np.unique(np.array(fps, np.uint64))
    anchor, of, home = simhash.replicas(arr, covering)
    at_home, at_all = {}, {}
    for a, i, h in zip(anchor.tolist(), of.tolist(), home.tolist()):
        at_all.setdefault(a, set()).add(i)
        if h:
            at_home.setdefault(a, set()).add(i)
    met = {(i, j) for a, hs in at_home.items() for i in hs for j in at_all[a]}
    for i in range(len(arr)):
        for j in np.flatnonzero(np.bitwise_count(arr ^ arr[i]) <= 4).tolist():
            assert (i, j) in met


def test_components_with_chains_stars_and_grid_cells(spark):
    rng = random.Random(2)
    fps = [rng.getrandbits(64) for _ in range(100)]
    for _ in range(600):  # a cloud round one centre, chains and copies
        f = fps[0] if rng.random() < 0.5 else rng.choice(fps)
        for b in rng.sample(range(64), rng.randint(0, 4)):
            f ^= 1 << b
        fps.append(f)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    want = slow_components(fps)
    least = {}
    for i, r in enumerate(want):
        least.setdefault(r, i)
    from lexiflow.llm.components import components

    for cell in (20_000, 7):
        nodes = spark.createDataFrame([(x,) for x in sorted(set(signed))], "fp long")
        got = {r.node: r.root for r in components(simhash.links(nodes, cell=cell)).collect()}
        named = {}
        for i, x in enumerate(signed):
            named.setdefault(got.get(x, x), set()).add(want[i])
        assert all(len(v) == 1 for v in named.values()) and len(named) == len(set(want))


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(3)
    base = [" ".join(rng.choice("abcdefghij") * 2 + str(rng.randint(0, 50)) for _ in range(120)) for _ in range(30)]
    rows = []
    for i in range(150):
        words = rng.choice(base).split()
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(len(words))] = "new"
        rows.append((1000 - i, " ".join(words)))
    fps = [slow_fingerprint(t) for _, t in rows]
    want, least = slow_components(fps), {}
    for (i, _), r in zip(rows, want):
        least[r] = min(i, least.get(r, i))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in simhash.near_duplicates(df).selectExpr("doc_id", "component_id").collect())
    assert got == sorted((i, least[r]) for (i, _), r in zip(rows, want))
    assert len(set(want)) < 150


def test_near_duplicates_edge_cases(spark):
    long = "word " * 30_000
    rows = [(5, "a b c d e f"), (3, "A B C D E F"), (3, "A B C D E F"), (9, None), (8, ""), (7, " "), (None, "a b c d e f"), (11, long), (10, long + " word")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as fp", "2 as component_id", "3 as node")
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.component_id) for r in simhash.near_duplicates(df).collect())
    assert got == [(-1, 3), (3, 3), (3, 3), (5, 3), (7, 7), (8, 7), (9, 7), (10, 10), (11, 10)]
    empty = simhash.near_duplicates(df.limit(0))
    assert empty.columns == ["doc_id", "fp", "component_id"] and empty.count() == 0


def test_coverings_give_the_same_components(spark):
    rng = random.Random(5)
    fps = [rng.getrandbits(64) for _ in range(200)]
    for _ in range(400):
        f = rng.choice(fps)
        for b in rng.sample(range(64), rng.randint(1, 5)):
            f ^= 1 << b
        fps.append(f)
    fps = sorted(set(fps))
    nodes = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    want = slow_components(fps)
    for covering in (simhash.COVERING, simhash.WIDER, (5, 2, 1)):
        roots = {int(np.int64(r.node).view(np.uint64)): int(np.int64(r.root).view(np.uint64)) for r in simhash.components(simhash.links(nodes, covering=covering, cell=100)).collect()}
        groups = {}
        for f in fps:
            groups.setdefault(roots.get(f, f), set()).add(f)
        expected = {}
        for i, r in enumerate(want):
            expected.setdefault(r, set()).add(fps[i])
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_incomplete_coverings_are_refused():
    for covering, threshold in (((3, 1, 1), 6), ((7, 3, 0), 5), ((7, 3, 2), 4), ((2, 2, 1), 4), ((8, 1, 0), 4)):
        with pytest.raises(ValueError):
            simhash.check_covering(covering, threshold)
    for covering, threshold in (((3, 1, 1), 5), ((7, 3, 0), 4), ((5, 2, 1), 4)):
        simhash.check_covering(covering, threshold)
