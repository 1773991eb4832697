import re

import numpy as np
import pytest
import xxhash

from reqsieve.llm import queries, simhash


def brute_print(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    """(id, fingerprint, component) of each row, by all pairs."""
    prints = [brute_print(t) for _, t in rows]
    values = np.array(sorted(set(prints)), np.uint64)
    parent = list(range(len(values)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for k in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(values ^ values[k]) <= 3):
            parent[find(int(j))] = find(k)
    place = {int(v): k for k, v in enumerate(values)}
    least = {}
    for (id, _), p in zip(rows, prints):
        if id is not None:
            least[find(place[p])] = min(id, least.get(find(place[p]), id))
    return sorted(((id, f"{p:016x}", least.get(find(place[p]))) for (id, _), p in zip(rows, prints)), key=repr)


def found(frame):
    return sorted(((r.doc_id, r.fingerprint, r.component_id) for r in frame.collect()), key=repr)


def made_up():
    draw = np.random.default_rng(3)
    words = lambda n: [f"W{x}" for x in draw.integers(0, 300, n)]
    rows = []
    for _ in range(30):
        text = words(200)
        for changes in range(6):
            changed = list(text)
            for at in draw.integers(0, 200, changes):
                changed[at] = "new"
            rows.append((len(rows), "\t".join(changed)))
    text = words(1500)  # a large group of near copies
    for k in range(300):
        changed = list(text)
        for at in draw.integers(0, 1500, 4):
            changed[at] = f"c{k}"
        rows.append((len(rows), " ".join(changed)))
    return rows + [(None, None), (None, ""), (900, " \n"), (901, "One"), (902, "one two"), (None, "ONE two"), (903, "é É\x0bx  y z"), (904, "long " * 30_000), (904, "long " * 30_000)]


@pytest.mark.parametrize("limits", [{}, {"block_members": 20, "task_queries": 30}])
def test_brute_force(spark, monkeypatch, limits):
    monkeypatch.setattr(simhash, "SHARD_LEAST", 20)  # several shards
    rows = made_up()
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, print string, label int").repartition(4)
    got = found(simhash.simhash_components(docs, **limits))
    assert got == brute(rows) and len({c for _, _, c in got}) < len(rows) / 2


def test_given_documents(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD_LEAST", 100)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    assert found(queries.op13_simhash_components(spark, "/root/testdata/sf0.01")) == brute(rows)


@pytest.mark.parametrize("rows", [[], [(None, None)], [(2, "a"), (2, "a"), (1, "A")]])
def test_small_tables(spark, rows):
    assert found(simhash.simhash_components(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_pieces_change_nothing():
    draw = np.random.default_rng(8)
    for text in (" ".join(f"w{x}" for x in draw.integers(0, 99, 3000)), "x" * 5000, "a b " + "y" * 3000 + " c", " \t "):
        assert simhash.fingerprint(text, piece_bytes=64) == simhash.fingerprint(text) == brute_print(text)


def near_points(draw, n, flips):
    bits = np.uint64(1) << draw.integers(0, 64, (n, flips)).astype(np.uint64)
    return np.unique(np.bitwise_xor.reduce(bits, axis=1) ^ np.uint64(0x123456789ABCDEF))


def test_the_forest_joins_all_links_and_no_more():
    draw = np.random.default_rng(4)
    points = np.unique(np.concatenate([draw.integers(0, 1 << 63, 3000).astype(np.uint64), near_points(draw, 2000, 2), near_points(draw, 2000, 8)]))
    members, queries_ = points[::2], points[1::2]
    a, b = simhash.spanning_links(members, queries_, len(members), leaf=8)
    assert len(a) < len(points)
    place = {int(p): k for k, p in enumerate(points)}
    got, expected = np.arange(len(points)), np.arange(len(points))
    simhash.settle(got, np.array([place[int(x)] for x in a]), np.array([place[int(x)] for x in b]))
    left, right = [], []
    for k in range(len(points)):
        near = np.flatnonzero(np.bitwise_count(points ^ points[k]) <= 3)
        if k % 2:  # queries are compared with members alone
            near = near[near % 2 == 0]
        left += [k] * len(near)
        right += near.tolist()
    simhash.settle(expected, np.array(left), np.array(right))
    assert (got == expected).all()


def test_every_near_pair_meets_in_a_shard():
    draw = np.random.default_rng(6)
    points = np.unique(np.concatenate([near_points(draw, 400, 6), draw.integers(0, 1 << 63, 400).astype(np.uint64)]))
    tree = simhash.build(points[::3], 20)
    home, seen = {}, {}
    for leaf, own, guests in simhash.route(tree, points, 3):
        for k in own.tolist():
            assert home.setdefault(k, leaf) == leaf
        seen[leaf] = set(own.tolist()) | set(guests.tolist())
    assert len(home) == len(points) and len(seen) > 10
    for k in range(len(points)):
        for j in np.flatnonzero(np.bitwise_count(points ^ points[k]) <= 3).tolist():
            assert k in seen[home[j]] or j in seen[home[k]]
