import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from reqsieve.llm import forced_bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
PARTS = [
    " ", "  ", "\n", "a", "the", ".", "é", "é", "日本", "\t", "　", "<|endoftext|>", "<|startoftext|>", "<|END", "Σ", "ΑΣ", "İ", "ß", "😀", "\x00",
    "1", "12", "\r\n", "\x1c", "\x85", "word", "'s", "'re", "'", "ǅ", "ﬁ", "...!!", "$$$", "Ⅷ", "½", "​", "qxz", "zxq", "𝒳", "x" * 30, "aab" * 40, "࢏",
    "\U00010943", "ÀÉ", "ª", "²",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def own():
    return forced_bpe.Codec(forced_bpe.read_rules(PATH))


def texts():
    draw = random.Random(3)
    return ["".join(draw.choices(PARTS, k=draw.randint(0, 14))) for _ in range(4000)] + ["", "a" * 5000, "qz" * 40, "<|endoftext|>" * 3]


def test_the_library_encodes_and_decodes_the_same(library, own):
    made = texts()
    expected = [e.ids for e in library.encode_batch(made, add_special_tokens=False)]
    got = own.encode(made)
    assert [[int(i) for i in g.split()] for g in got] == expected
    assert [own.decode(g) for g in got] == [library.decode(e, skip_special_tokens=False) for e in expected]


def test_a_small_memory_changes_nothing(own, monkeypatch):
    made = texts()[:600]
    expected = own.encode(made)
    monkeypatch.setattr(forced_bpe, "MEMORY", 20)
    assert [own.encode([t])[0] for t in made] == expected


def test_cut_places_are_inside_no_token(own):
    """Every adjacent pair of every vocabulary token is known, so no token spans a cut."""
    letters = {c: b for b, c in enumerate(own.letters)}
    for token in own.vocabulary:
        ends = token.endswith("</w>") and token != "</w>"
        codes = [letters[c] for c in (token[:-4] if ends else token) if c in letters]
        for k in range(1, len(codes)):
            assert (own.last if ends and k == len(codes) - 1 else own.inside)[codes[k - 1], codes[k]]
    assert (~own.inside).sum() > 60_000


def test_rows(spark, library):
    rows = [*enumerate(texts()[:800]), (None, "no id"), (9999, None), (5, "twice"), (5, "twice")]
    frame = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, ids int").repartition(3)
    outputs = ("ids", "decoded", "ids_sha256", "decoded_sha256")
    found = forced_bpe.encode_decode(frame, PATH, ["doc_id"], outputs=outputs).collect()
    expected = []
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for id, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        written, decoded = " ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False)
        expected.append((id, len(ids), written, decoded, sha(written), sha(decoded)))
    assert sorted(map(tuple, found), key=repr) == sorted(expected, key=repr)
    assert forced_bpe.encode_decode(frame.limit(0), PATH, ["doc_id"]).count() == 0


def test_other_rules_are_refused():
    with pytest.raises(ValueError):
        forced_bpe.Codec(forced_bpe.read_rules(public_tokenizers.path("byte_bpe_50k.json")))
