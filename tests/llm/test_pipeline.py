"""The pipeline on the small tables: each stage against what its operator decides, and the whole against brute force."""

import collections
import zlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from tests.llm.test_operators import expected_groups, expected_kept

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    out = [docs]
    for name, stage in pipeline.STAGES:
        stage(spark, docs, SF_DIR).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
        out.append(docs)
    return out


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_stages_return_documents(stages):
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "quality", "near_copies", "passages", "packing"]
    assert all(s.dtypes == stages[0].dtypes for s in stages[:-1])


def test_filters_keep_clean_documents(spark, stages):
    labels = rows(spark.read.parquet(f"{SF_DIR}/labels.parquet"))
    kept = rows(stages[2])
    clean = [i for i, r in labels.items() if r["quality"] == 1 and r["toxic"] == 0]
    assert sum(i in kept for i in clean) >= 0.9 * len(clean)


def test_one_document_of_each_group_stays(stages):
    before, after = rows(stages[2]), rows(stages[3])
    ids = sorted(before)
    groups, _ = expected_groups([before[i]["text"] for i in ids], 5)
    assert sorted(after) == [i for k, i in enumerate(ids) if groups[k] == k]


def test_passages_go(stages):
    import hashlib

    before, after = rows(stages[3]), rows(stages[4])
    ids = sorted(before)
    for i, (_, gone, digest) in zip(ids, expected_kept([before[i]["text"] for i in ids], 35)):
        assert hashlib.sha256(b" ".join(after[i]["text"].encode().split())).hexdigest() == digest and after[i]["n_chars"] == len(after[i]["text"])
        assert gone or after[i]["text"] == before[i]["text"]


def test_packing_holds_every_token(stages):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokens = {i: len(library.encode(r["text"], add_special_tokens=False).ids) + 1 for i, r in rows(stages[4]).items()}
    found, windows = collections.Counter(), collections.Counter()
    for r in stages[5].collect():
        found[r["doc_id"]] += r["length"]
        windows[r["sequence_id"]] += r["length"]
    assert found == tokens and max(windows.values()) <= 1024
    assert zlib.crc32(b"") == 0


def test_run_gives_what_the_stages_give(spark, stages):
    whole = pipeline.run(spark, SF_DIR).select("doc_id", "start", "length", "ids_crc32").collect()
    assert sorted(whole) == sorted(stages[5].select("doc_id", "start", "length", "ids_crc32").collect())
