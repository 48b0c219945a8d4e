"""Plane files against plain encodings of whole texts, and as files."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from siftmill.llm import token_planes as tp

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def plain():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda text: [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("kind", [tp.BYTE_PLANES, tp.BIT_PLANES])
@pytest.mark.parametrize("block", [1, 7, 64])
def test_files_give_back_ids_keys_and_any_run(kind, block):
    rng = np.random.default_rng(block)
    docs = [(None, []), (5, [1]), (-(2**63), rng.integers(0, 2**32, 100)), (5, rng.integers(0, 300, 200)), (9, []), (2**63 - 1, [0] * 130)]
    writer = tp.FileWriter(kind, block)
    for key, ids in docs:
        writer.add(key, np.array(ids, np.uint32))
    reader = tp.FileReader(writer.close())
    every = np.concatenate([np.array(ids, np.uint32) for _, ids in docs])
    assert [k for k, _, _ in reader.documents()] == [k for k, _ in docs]
    for (_, start, end), (_, ids) in zip(reader.documents(), docs, strict=True):
        assert np.array_equal(np.concatenate([np.zeros(0, np.uint32), *reader.run(start, end)]), np.array(ids, np.uint32))
    for a, b in [(0, 0), (0, len(every)), (3, 4), (95, 260)]:
        assert np.array_equal(np.concatenate([np.zeros(0, np.uint32), *reader.run(a, b)]), every[a:b])


def test_empty_file_and_cut_file():
    content = tp.FileWriter().close()
    assert list(tp.FileReader(content).documents()) == []
    with pytest.raises(ValueError):
        tp.FileReader(content[:-1] + b"x")


def test_parts_encode_like_whole_texts(plain):
    rng = random.Random(1)
    pieces = ["it's", "IT'S", "''s", "don't", "größe", "ÀÉ", "é", "́", " ", "\x85", "\x1c", "\t", "\n\r", "  ", "12", "²½", "ΣΑΣ", "İ", "ﬁ", "日本", "<|endoftext|>", "<|", "|>", "a" * 40, "_-_", "😀", "'", "ª", " ", "​", "x"]
    encoder = tp.Encoder(open(PATH, encoding="utf-8").read())
    assert encoder.parts
    for _ in range(3000):
        text = "".join(rng.choice(pieces) + rng.choice(["", " ", "  ", "\n"]) for _ in range(rng.randrange(12)))
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == plain(text)[:-1], repr(text)


def test_long_texts_are_cut_at_spaces_and_caches_are_emptied(plain, monkeypatch):
    monkeypatch.setattr(tp, "PIECE_CHARS", 10)
    monkeypatch.setattr(tp, "MOST_PARTS", 5)
    encoder = tp.Encoder(open(PATH, encoding="utf-8").read())
    text = "one two, three's four\nfive " * 20 + "without" * 9
    assert np.frombuffer(encoder.encode(text), "<u4").tolist() == plain(text)[:-1]


def test_other_tokenizers_encode_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder, tokenizer = tp.Encoder(open(path, encoding="utf-8").read()), Tokenizer.from_file(path)
    assert not encoder.parts
    assert np.frombuffer(encoder.encode("It's  a test "), "<u4").tolist() == tokenizer.encode("It's  a test ", add_special_tokens=False).ids


def test_table_with_null_repeated_and_clashing_columns(spark, plain, monkeypatch):
    words = ["the", "of", "Straße", "naïve", "x1", "don't"]
    rng = random.Random(3)
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(30))) for _ in range(60)]
    rows = [(rng.choice([None, 4, 7, k]), rng.choice([None, "", t]), "p", k) for k, t in enumerate(texts)] + [(4, "same text", "q", 0)] * 40 + [(8, "long " * 50_000, "q", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, part string, place int").repartition(5)
    got = tp.token_columns(docs, PATH).orderBy("start").collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in got) == sorted((k is not None, k or 0, len(plain(t)), crc(plain(t))) for k, t, *_ in rows)
    assert [r.doc_id is not None for r in got] == sorted(r.doc_id is not None for r in got)
    keys = [r.doc_id for r in got if r.doc_id is not None]
    assert keys == sorted(keys)
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
    assert tp.token_columns(docs.limit(0), PATH).collect() == []


def test_query_equals_plain_encodings(spark, plain):
    from siftmill.llm.queries import op11_token_planes

    folder = "/root/testdata/sf0.001"
    docs = sorted(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect())
    start, want = 0, []
    for d in docs:
        ids = plain(d.text)
        want.append((d.doc_id, start, len(ids), crc(ids)))
        start += len(ids)
    assert sorted(map(tuple, op11_token_planes(spark, folder).collect())) == want
