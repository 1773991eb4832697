import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from reqsieve.llm import queries, spelling


def brute(rows, divisor=97):
    """word -> (n, n_near, form, form_n, root), by wildcards."""
    counts = Counter()
    for id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            digest = zlib.crc32(f"{'' if id is None else id}:{run}".encode())
            if digest % divisor == 0:
                run = run[: digest % len(run)] + run[digest % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    replaced, shorter, near = defaultdict(set), defaultdict(set), defaultdict(set)
    for w in words:
        for k in range(len(w)):
            replaced[w[:k], w[k + 1 :]].add(w)
            shorter[w[:k] + w[k + 1 :]].add(w)
    for group in replaced.values():
        for w in group:
            near[w] |= group - {w}
    for w in words:
        for longer in shorter[w]:
            near[w].add(longer)
            near[longer].add(w)
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {w: (n, len(near[w]), form[w], words.get(form[w]), root(w)) for w, n in words.items()}


def found(frame):
    rows = frame.collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in rows}


def made_up():
    draw = np.random.default_rng(1)
    letters, sizes = list("abÀÿ×"), [2, 4, 5, 5, 6, 6, 7, 8]
    word = lambda: "".join(draw.choice(letters, draw.choice(sizes)))
    rows = [(k, " ".join(word() for _ in range(300))) for k in range(40)]
    return rows + [(None, "Straße straße STRASSE, Éclair"), (1, None), (2, ""), (3, "?! 12"), (7, "x" * 70 + " " + "x" * 71 + " yyyyy"), (7, "x" * 70 + " " + "x" * 71 + " yyyyy"), (8, "x" * 70 + " " + "x" * 71)]


@pytest.mark.parametrize("divisor, list_words", [(97, 20_000), (3, 20_000), (97, 5)])
def test_brute_force(spark, divisor, list_words):
    rows = made_up()
    docs = spark.createDataFrame([(*r, "x", 0) for r in rows], "doc_id long, text string, word string, n int").repartition(4)
    assert found(spelling.spelling_forms(docs, divisor=divisor, list_words=list_words)) == brute(rows, divisor)


def test_given_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    assert found(queries.op12_spelling_variants(spark, "/root/testdata/sf0.01")) == brute(rows)


def test_chains_follow_to_the_end(spark):
    times = {"aaaaa": 3, "aaaab": 6, "aaabb": 12, "aabbb": 24, "abbbb": 48, "bbbbb": 96, "bbbbbc": 192, "bbbbcc": 400}
    rows = [(k, " ".join([w] * n)) for k, (w, n) in enumerate(times.items())]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = found(spelling.spelling_forms(docs, divisor=1 << 31))
    assert {w: r[4] for w, r in got.items()} == dict.fromkeys(times, "bbbbcc") and got == brute(rows, 1 << 31)


def test_hot_list_is_cut(spark):
    """Words that share all but their last letters: one list, far over the limit."""
    draw = np.random.default_rng(3)
    words = {"commonbeginning" + "".join(draw.choice(list("abcdefgh"), 4)) for _ in range(900)}
    rows = [(k, " ".join([w] * 3)) for k, w in enumerate(sorted(words))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = found(spelling.spelling_forms(docs, divisor=1 << 31, list_words=50))
    assert got == brute(rows, 1 << 31) and max(r[1] for r in got.values()) > 5


def test_long_texts_go_in_pieces(spark, monkeypatch):
    words = ["alpha", "alphas", "bétaa", "gamma"] * 2000
    whole = found(spelling.spelling_forms(spark.createDataFrame([(5, " ".join(words))], "doc_id long, text string")))
    raw = np.frombuffer(" ".join(words).encode(), np.uint8)
    clean = spelling.letters_only(raw)
    pieces = list(spelling._pieces(clean, np.array([0, len(clean)]), 100))
    assert max(len(p[1]) for p in pieces) < 110 and b"".join(p[1].tobytes() for p in pieces) == clean.tobytes()
    assert all(p[1][0] == 0x20 or k == 0 for k, p in enumerate(pieces))
    assert whole == brute([(5, " ".join(words))])


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, "ab cd")], [(1, "word " * 3)]])
def test_nothing_to_find(spark, rows):
    got = spelling.spelling_forms(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"] and got.count() == 0


def test_long_words_do_not_widen_short_ones():
    words = sorted([b"a" * 5000, b"a" * 4999 + b"b", b"abcde", b"abcdf"])
    m = np.array([len(w) for w in words])
    a, count, best = spelling._near_of_block(sorted(words, key=len), np.array([9, 8, 7, 6]), np.sort(m), np.sort(m) // 2, np.sort(m) + 1)
    assert a.tolist() == [0, 1, 2, 3] and count.tolist() == [1] * 4 and best.tolist() == [1, 0, 3, 2]
