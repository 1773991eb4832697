import random

import public_tokenizers
import pytest
import sentencepiece

from reqsieve.llm import token_counts

PATH = public_tokenizers.path("piece_bpe_32k.model")
PARTS = [
    " ", "  ", "\n", "a", "the", ".", "é", "日", "\t", "　", "<s>", "▁", " a", "😀", "\x00", "1", "\r\n", "    ", "word", "</s>", "\xa0", "<0x0A>", "ing",
]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def texts():
    draw = random.Random(7)
    made = ["".join(draw.choices(PARTS, k=draw.randint(0, 14))) for _ in range(4000)]
    return [*made, "", " ", "\n", "  ", "\n ", " \n", "x" * 30_000, " " * 1000, "a" + " " * 77, " " * 33 + "\n" + " " * 20, made[5], made[5]]


def test_the_library_counts_the_same(spark, library):
    rows = [*enumerate(texts()), (None, "no id"), (9999, None)]
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, n_tokens int, n_bytes int").repartition(3)
    found = token_counts.count_tokens(frame, PATH, ["doc_id"]).collect()
    expected = [(i, len((t or "").encode()), len(library.encode(t or ""))) for i, t in rows]
    assert sorted(map(tuple, found), key=repr) == sorted(expected, key=repr)


def test_real_texts(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, PATH, ["doc_id"]).collect()}
    assert found == {r.doc_id: len(library.encode(r.text)) for r in docs.collect()}


def test_shortcuts_are_single_tokens_and_memory_does_not_matter(library, monkeypatch):
    monkeypatch.setattr(token_counts, "MEMORY_BITS", 3)
    own = token_counts.Counter(token_counts.read_model(PATH))
    assert (own.shortcut != 0).sum() > 20_000
    made = texts()[:1500]
    data, offsets = token_counts.textbytes.column_bytes(token_counts.pa.array([t.replace("▁", " ") for t in made]))
    assert own.count(data, offsets).tolist() == [len(library.encode(t)) for t in made]


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert token_counts.count_tokens(empty, PATH, ["doc_id"]).count() == 0
