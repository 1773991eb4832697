"""The registered queries of the folder, and the pipeline, against SQL or brute force."""

import hashlib
import re
import shutil
import subprocess
import sys
import zlib
from collections import defaultdict
from pathlib import Path

import corpus_pipeline
import public_tokenizers
import pytest
from check_oracle import compare, connect
from tokenizers import Tokenizer

import __spark_entry__ as contract
from reqsieve.llm import oracle, queries

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


@pytest.mark.parametrize("name", oracle.ORACLE_SQL)
def test_sql(spark, duck, name):
    assert compare(spark, duck, SMALL, name) == ""


def test_every_operator_is_registered_once():
    numbers = sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES)
    assert numbers == list(range(1, 14))
    assert set(queries.QUERIES) | {"pipeline"} <= set(contract.queries())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "near_dedup", "benchmark_decontamination", "encode_decode"]


def test_shards(spark):
    found = queries.op2_jump_hash_shards(spark, SMALL).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    slots = defaultdict(list)
    for r in found:
        raw = docs[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 16, zlib.crc32(raw), "key")
        assert 0 <= r.shard < 40 and r.grown_shard in (r.shard, 40)
        slots[r.shard].append(r.slot)
    assert len(found) == len(docs) and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_pipeline_stages(spark):
    """Each stage on what its predecessor kept, against a plainer way."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    good = corpus_pipeline.quality_classifier(spark, docs, SMALL)
    predicted = {r.doc_id: r.predicted for r in queries.op7_positive_unlabelled_quality(spark, SMALL).collect()}
    assert good.schema == docs.schema and {r.doc_id for r in good.collect()} == {i for i, p in predicted.items() if p}
    single = corpus_pipeline.near_dedup(spark, good, SMALL)
    assert single.schema == docs.schema
    kept = {r.doc_id for r in single.collect()}
    words = {i: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", texts[i].lower()) for i in texts}
    shingles = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in words.items()}
    alike = lambda a, b: len(shingles[a] & shingles[b]) / len(shingles[a] | shingles[b])
    passed = sorted(i for i, p in predicted.items() if p)
    for i in passed:
        if i not in kept:  # every document that goes has a like one
            assert max(alike(i, j) for j in passed if j != i) > 0.6
    assert not any(alike(i, j) > 0.95 for i in kept for j in kept if i < j)
    clean = corpus_pipeline.benchmark_decontamination(spark, single, SMALL)
    hit = {r.doc_id for r in queries.op5_suffix_array_decontamination(spark, SMALL).filter("contaminated").collect()}
    left = {r.doc_id for r in clean.collect()}
    assert clean.schema == docs.schema and left == kept - hit
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for r in corpus_pipeline.run(spark, SMALL).collect():
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        left.remove(r.doc_id)
    assert not left


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None)], [(1, "", "en", "s", 0), (1, "", "en", "s", 0)]])
def test_pipeline_stages_on_odd_tables(spark, rows):
    docs = spark.createDataFrame(rows, spark.read.parquet(f"{SMALL}/documents.parquet").schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SMALL).count() <= len(rows)


def test_the_rest_works_without_the_folder(tmp_path):
    root = Path(contract.__file__).parent
    shutil.copytree(root / "reqsieve", tmp_path / "reqsieve", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert len(e.queries()) >= 54 and not any(n.startswith('op') and n[2].isdigit() for n in e.queries()); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin"})
