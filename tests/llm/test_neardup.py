from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from reqsieve.llm import neardup, textbytes


def brute(rows, idf, similarity=0.8):
    """Class id of each row, by all links between all texts."""
    sets, texts = {}, defaultdict(list)
    for k, (id, text) in enumerate(rows):
        texts[text if text is not None else ("null", k)].append(id)
    for text in texts:
        if isinstance(text, str):
            _, feature, count = neardup.features(*textbytes.column_bytes(pa.array([text], pa.string())), neardup.SHINGLE_WORDS)
            sets[text] = Counter(dict(zip(feature.tolist(), count.tolist())))
    weight = lambda f: float(idf[f & ((1 << neardup.IDF_BITS) - 1)])
    parent = {t: t for t in texts}

    def find(t):
        while parent[t] != t:
            t = parent[t]
        return t

    held = defaultdict(list)
    for text, own in sets.items():
        for f in own:
            held[f].append(text)
    for a, own in sets.items():
        shared = Counter()
        for f, n in own.items():
            for b in held[f]:
                if b > a:
                    shared[b] += weight(f) * min(n, sets[b][f])
        for b, common in shared.items():
            whole = sum(weight(f) * n for s in (own, sets[b]) for f, n in s.items()) - common
            if common / whole >= similarity:
                parent[find(a)] = find(b)
    least = defaultdict(list)
    for text, ids in texts.items():
        least[find(text)] += ids
    order = lambda ids: min(ids, key=lambda i: (i is None, i))
    return [order(least[find(t if t is not None else ("null", k))]) for k, (_, t) in enumerate(rows)]


def near_copies():
    draw = np.random.default_rng(9)
    words = lambda n: [f"w{x}" for x in draw.integers(0, 400, n)]
    rows, common = [], words(12)
    for k in range(25):
        text = words(60 + 8 * k) + common
        for copy in range(1 + k % 4):
            changed = list(text)
            for at in draw.integers(0, len(text), copy * k // 8):
                changed[at] = "new"
            rows.append((len(rows), " ".join(changed)))
    # a chain: each like the next, the ends unlike each other
    text = words(120)
    for k in range(6):
        rows.append((len(rows), " ".join(["x"] * k + text[6 * k :] + words(6 * k))))
    # a large group around one text
    text = words(150)
    for k in range(60):
        changed = list(text)
        for at in draw.integers(0, 150, 3):
            changed[at] = f"c{k}"
        rows.append((len(rows), " ".join(changed)))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, node string").repartition(4)


def test_brute_force(spark):
    rows = near_copies() + [(900, None), (901, None), (902, ""), (903, ""), (904, "?!"), (905, "One two"), (906, "one, two"), (907, "one two three")]
    rows += [(950, rows[3][1]), (3, rows[3][1]), (None, rows[3][1]), (None, "alone without an id"), (908, "w " * 20_000)]
    docs = frame(spark, rows)
    found = neardup.text_classes(docs)
    total, frequencies = neardup.document_frequencies(docs)
    assert total == sum(bool(textbytes.words(*textbytes.column_bytes(pa.array([t], pa.string()))).start.size) for _, t in rows)
    expected = brute(rows, neardup.inverse_frequencies(total, frequencies))
    got = sorted(((r.doc_id, r.class_id) for r in found.collect()), key=repr)
    assert got == sorted(((i, c) for (i, _), c in zip(rows, expected)), key=repr)


def test_one_row_of_each_class_stays(spark):
    rows = near_copies() + [(1, None), (1, None), (2, ""), (3, ""), (7, "a b c d e f g"), (7, "a b c d e f g"), (None, "no id"), (None, "no id")]
    docs = frame(spark, rows).withColumnRenamed("node", "count")
    left = neardup.drop_near_duplicates(docs)
    assert left.schema == docs.schema
    total, frequencies = neardup.document_frequencies(docs)
    classes = brute(rows, neardup.inverse_frequencies(total, frequencies))
    kept = left.collect()
    assert sum(r.text is None for r in kept) == 2
    expected = {c for (_, t), c in zip(rows, classes) if t is not None}
    texts = [r for r in kept if r.text is not None]
    assert len(texts) == len(expected) and {r.doc_id for r in texts} == expected


def test_document_frequencies_cover_all_rows(spark):
    rows = [(k, f"a b c d e {k % 3} f g h i") for k in range(50)]
    total, frequencies = neardup.document_frequencies(frame(spark, rows))
    tally = np.zeros(1 << neardup.IDF_BITS, int)
    for _, text in rows:
        _, feature, _ = neardup.features(*textbytes.column_bytes(pa.array([text], pa.string())), 5)
        tally[np.unique(neardup._bucket(feature))] += 1
    assert total == 50 and (tally == frequencies).all()


def test_samples_agree_as_often_as_the_weights_overlap():
    draw = np.random.default_rng(4)
    sampler = neardup.Sampler(np.zeros(1 << neardup.IDF_BITS, np.float32), 400, 1)
    feature = np.unique(draw.integers(0, 1 << 44, 300).astype(np.uint64))
    left, right = draw.integers(1, 9, len(feature)), draw.integers(1, 9, len(feature))
    left[:60] = right[:60] * 3
    row = np.repeat([0, 1], len(feature))
    _, keys = sampler.band_keys(2, row, np.tile(feature, 2), np.concatenate([left, right]))
    expected = np.minimum(left, right).sum() / np.maximum(left, right).sum()
    assert abs((keys[0] == keys[1]).mean() - expected) < 0.08


def test_classes_close_over_chains_and_stars(spark):
    links = [(b"%03d" % k, b"%03d" % (k + 1)) for k in range(40)] + [(b"100", b"%03d" % k) for k in range(101, 160)] + [(b"200", b"201")]
    from reqsieve.session import Scratch

    with Scratch(spark, "t") as scratch:
        found = neardup.components(spark.createDataFrame(links, "a binary, b binary"), scratch).collect()
    expected = {bytes(n): b"000" if n < b"050" else b"100" if n < b"200" else b"200" for link in links for n in link}
    assert {bytes(r.node): bytes(r.label) for r in found} == expected


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, "")], [(1, "one text only")]])
def test_few_rows(spark, rows):
    found = neardup.text_classes(frame(spark, rows)).collect()
    assert [(r.doc_id, r.class_id, r.stays) for r in found] == [(i, i, True) for i, _ in rows]
    assert neardup.drop_near_duplicates(frame(spark, rows)).count() == len(rows)


def test_recall_at_the_threshold():
    """What the bands promise for a pair at the threshold."""
    missed = (1 - neardup.SIMILARITY**neardup.BAND_SAMPLES) ** neardup.BANDS
    assert missed < 1e-3


def test_a_pair_is_listed_once_not_once_per_shingle(spark, monkeypatch):
    """All members meet in the listing, and it still finds every link."""
    from reqsieve.session import Scratch

    listed, table = [], Scratch.table

    def seen(self, df, name):
        out = table(self, df, name)
        if name in ("able", "telling"):
            groups = out.groupBy("hub", "shingle").count().selectExpr("sum(count * count)").first()[0] or 0
            listed.append((name, groups))
        return out

    draw = np.random.default_rng(3)
    words = lambda n: [f"w{x}" for x in draw.integers(0, 10**6, n)]
    # texts that share a hub's first part, in fives that share 80 words more and are almost links
    rows, common = [], words(200)
    rows.append((0, " ".join(common)))
    for k in range(6):
        own = words(80)
        rows += [(10 * k + j + 1, " ".join(common + own + words(34))) for j in range(5)]
    monkeypatch.setattr(neardup, "HUB_ROUNDS", 0)
    monkeypatch.setattr(Scratch, "table", seen)
    docs = frame(spark, rows)
    found = {r.doc_id: r.class_id for r in neardup.text_classes(docs).collect()}
    total, frequencies = neardup.document_frequencies(docs)
    assert found == dict(zip([i for i, _ in rows], brute(rows, neardup.inverse_frequencies(total, frequencies))))
    able, telling = (sum(n for k, n in listed if k == name) for name in ("able", "telling"))
    assert 0 < telling <= able / 4


def test_members_and_shingles_are_joined_once_a_table(spark, monkeypatch):
    """No join of members by shingle is made again for the list of what stays."""
    from reqsieve.session import Scratch

    joins, table = [], Scratch.table

    def seen(self, df, name):
        plan = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
        joins.append((sum("Join " in line and "shingle#" in line for line in plan), name))
        return table(self, df, name)

    monkeypatch.setattr(Scratch, "table", seen)
    rows = near_copies()
    docs = frame(spark, rows)
    found = {r.doc_id: r.class_id for r in neardup.text_classes(docs).collect()}
    total, frequencies = neardup.document_frequencies(docs)
    assert found == dict(zip([i for i, _ in rows], brute(rows, neardup.inverse_frequencies(total, frequencies))))
    assert max(joins)[0] == 1, max(joins)
