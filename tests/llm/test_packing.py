import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from __spark_entry__ import queries
from citesift.llm import packing

QUERY = "op13_concatenate_and_cut"


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(packing.default_path())


def whole_ids(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, packing.END_ID]


ODD = ["it's'T're", "ΣΑΣ Σ", "İ I", "é ́x", "a b\x1cc d", "<|endoftext|>x<|startoftext|>", "１２3½", "\x85", "한국 ᄀ ᅡ"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=20), st.sampled_from(ODD), st.sampled_from([" ", "\n", "\t", "\r\n", "\f\v"])), max_size=8))
def test_words_give_the_ids_of_the_whole_text(parts):
    text = "".join(parts).encode("utf-8", "replace").decode()
    words = packing.word_ids(packing.default_path())
    assert np.frombuffer(words.encode(text.encode()), "<u4").tolist() == whole_ids(words.tokenizer, text)[:-1]


LATIN = "abcdeéßöñÀŒÿZ'sTtreld019.,!?#-–…’"


@settings(max_examples=500, deadline=None)
@given(st.lists(st.one_of(st.text(LATIN, max_size=14), st.sampled_from(["don't", "we'LL've", "aaaa", "THE", "<|", "'re'"])), max_size=8))
def test_merging_stretches_equals_the_tokenizer(parts):
    text = " ".join(parts)
    words = packing.word_ids(packing.default_path())
    assert words.merger is not None
    assert np.frombuffer(words.encode(text.encode()), "<u4").tolist() == whole_ids(words.tokenizer, text)[:-1]


def test_every_text_of_the_tables(spark, tokenizer):
    words = packing.word_ids(packing.default_path())
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    for text, found in zip(texts, tokenizer.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(words.encode(text.encode()), "<u4").tolist() == found.ids


def test_other_models_are_asked(tokenizer):
    import public_tokenizers

    other = packing.WordIds(public_tokenizers.path("byte_bpe_50k.json"))
    assert other.merger is None
    assert np.frombuffer(other.encode(b"plain"), "<u4").tolist() == other.tokenizer.encode("plain").ids


def test_memory_is_bounded_in_bytes(monkeypatch, tokenizer):
    monkeypatch.setattr(packing, "REMEMBERED_BYTES", 64 << 10)
    words = packing.WordIds(packing.default_path())
    text = " ".join(f"word{i}" for i in range(2000)) + " " + "long" * 3000
    assert np.frombuffer(words.encode(text.encode()), "<u4").tolist() == whole_ids(tokenizer, text)[:-1]
    held = [*words.words.items(), *words.stretches.items()]
    assert held and sum(packing.ENTRY_BYTES + len(k) + len(v) for k, v in held) <= 64 << 10


def check_pieces(pieces, texts, tokenizer, context):
    """Pieces cover every document once, sequences are gapless and full, and ids are the tokenizer's."""
    wanted = sorted(whole_ids(tokenizer, t) for t in texts)
    by_sequence, pool = {}, {}
    for p in pieces:
        ids = np.frombuffer(p["ids"], "<u4").tolist()
        assert len(ids) == p["length"] > 0
        by_sequence.setdefault(p["sequence_id"], []).append((p["offset"], p["length"], p["doc_id"]))
        pool.setdefault(p["sequence_id"] * context + p["offset"] - p["start"], []).append((p["start"], p["doc_tokens"], ids))
    for sequence, found in by_sequence.items():
        at = 0
        for offset, length, _ in sorted(found, key=lambda x: x[0]):
            assert offset == at
            at += length
        assert at == context or sequence == max(by_sequence)
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    documents = []
    for found in pool.values():
        ids = []
        for start, size, part in sorted(found):
            assert start == len(ids)
            ids += part
        assert len(ids) == size
        documents.append(ids)
    assert sorted(documents) == wanted


def test_pieces_and_sequences(spark, docs, tokenizer):
    rng = random.Random(2)
    texts = [" ".join(rng.choices(["alpha", "Beta", "it's", "42", "naïve", "zzzqqx"], k=rng.randrange(40))) for _ in range(80)]
    texts += [None, "", " \n", "over " * 900, "same text", "same text"]
    table = docs([(i if i != 7 else None, t) for i, t in enumerate(texts)]).withColumn("part", F.lit("x")).withColumn("IDS", F.lit(0))
    found = packing.pack(table.repartition(5), context=64).cache()
    check_pieces(found.collect(), texts, tokenizer, 64)
    whole = packing.sequences(found).orderBy("sequence_id").collect()
    joined = [i for r in whole for i in np.frombuffer(r["ids"], "<u4").tolist()]
    assert all(r["length"] == 64 for r in whole[:-1]) and len(joined) == sum(len(whole_ids(tokenizer, t)) for t in texts)
    found.unpersist()


def test_many_partitions_without_a_broadcast(monkeypatch, spark, docs, tokenizer):
    monkeypatch.setattr(packing, "SMALL_PARTS", 0)
    texts = [f"text number {i} " * (i % 7) for i in range(50)]
    check_pieces(packing.pack(docs(list(enumerate(texts))).repartition(9), context=16).collect(), texts, tokenizer, 16)


def test_query_equals_the_tokenizer(spark, tokenizer):
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    ids = {i: whole_ids(tokenizer, t) for i, t in texts.items()}
    seen = dict.fromkeys(ids, 0)
    for r in queries()[QUERY](spark, sf).orderBy("doc_id", "start").collect():
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert seen[r["doc_id"]] == r["start"] and r["doc_tokens"] == len(ids[r["doc_id"]])
        assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes()) and r["offset"] + r["length"] <= 4096
        seen[r["doc_id"]] += r["length"]
    assert seen == {i: len(x) for i, x in ids.items()}


def test_empty_table(spark, docs, folder):
    assert queries()[QUERY](spark, folder(documents=docs([]))).count() == 0
