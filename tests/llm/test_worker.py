import tracemalloc
import weakref

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from reqsieve.llm import decontaminate, forced_bpe, neardup, quality, worker


class Shared:
    """A broadcast value as a task sees it."""

    def __init__(self, value):
        self.value, self.id = value, 1


def sampler():
    return neardup._sampler(Shared(np.ones(1 << neardup.IDF_BITS, np.float32)), 2, 2)


def one_batch():
    return iter([pa.RecordBatch.from_arrays([pa.array(["a"])], names=["text"])])


def test_a_table_goes_before_a_task_of_another_operator():
    made = weakref.ref(forced_bpe.codec(forced_bpe.read_rules(public_tokenizers.path("word_bpe_49k.json"))))
    assert made() is not None
    seen = []
    task = worker.lean(lambda batches: (seen.append((sampler(), made())) or b for b in batches), "sampler")
    assert next(iter(task(one_batch()))).column(0).to_pylist() == ["a"]
    assert seen[0][1] is None  # the codec was no longer there
    again = worker.lean(lambda batches: (seen.append((sampler(), None)) or b for b in batches), "sampler")
    list(again(one_batch()))
    assert seen[1][0] is seen[0][0]  # tasks of one operator share theirs
    list(worker.lean(lambda batches: batches)(one_batch()))
    assert not worker._held


def test_memory_is_given_back_after_each_batch(monkeypatch):
    returned = []
    monkeypatch.setattr(worker, "give_back", lambda: returned.append(1))
    rows = []
    for batch in worker.lean(lambda batches: batches)(pa.table({"k": range(30)}).to_batches(10).__iter__()):
        rows += batch.column("k").to_pylist()
    assert rows == list(range(30)) and len(returned) == 5  # before, after each of three, at the end


@pytest.fixture(scope="module")
def column():
    draw = np.random.default_rng(5)
    words = np.array([f"word{k}" for k in range(3000)])
    made = pa.array([" ".join(words[draw.integers(0, 3000, 500)]) for _ in range(1200)])
    assert made.nbytes > 4 << 20
    return made


@pytest.mark.parametrize(("name", "most"), [("quality", 24), ("neardup", 8), ("decontaminate", 16)])
def test_a_batch_takes_little_memory(column, name, most):
    index = decontaminate.build_index(pa.table({"item_id": [1], "text": [" ".join(f"word{k}" for k in range(20))]}))
    sampler()
    run = {
        "quality": lambda: quality._text_features(column),
        "neardup": lambda: [sampler().band_keys(last - first, *neardup.features(data, offsets, 5)) for first, last, data, offsets in neardup._row_chunks(column)],
        "decontaminate": lambda: list(decontaminate._searched([index], column)),
    }[name]
    tracemalloc.start()
    run()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # in chunks of a megabyte these were 54, 13 and 21 MB
    assert peak < most << 20
