import zlib

import numpy as np
import public_tokenizers
import pytest

from parcelwise.llm import token_files as T

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [None, "", " ", "Hello  WORLD\tfoo\nbar'll x's", "naïve É́ Ünïcode éa", "a" * 3000, "<|endoftext|> x <|startoftext|>y", "<|ENDOFTEXT|> Big<|endoftext|>AND more", "it's' word'', ab--' o'clock\u00a0x\x85y za\u017c\u00f3\u0142\u0107! \u043f\u0440\u0438\u0432\u0435\u0442?! \u03c3\u03c2. a\u0301b. \u0149 \u01c5", "1234 5.6, x y z", "́lead space ́mark", "İstanbul ΑΣ Σ", "日本語 テキスト", "a. b, c., d.. e.\"f.\" x's, 9, é, ß. ÉA, \u0301. ,", "don't, I'LL. ...and \u2026 \u0130\u0307, \ud55c\u1100\u1161,"]


def whole(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids + [T.END_ID]


def test_pieces_encode_like_whole_texts():
    encoder = T.WordEncoder(PATH)
    got = encoder.encode([(t or "").encode() for t in TEXTS])
    assert [np.frombuffer(g, encoder.kind).tolist() + [T.END_ID] for g in got] == [whole(t) for t in TEXTS]


def test_other_tokenizers_encode_whole_texts():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder, plain = T.WordEncoder(path), Tokenizer.from_file(path)
    got = encoder.encode([(t or "").encode() for t in TEXTS])
    assert [np.frombuffer(g, encoder.kind).tolist() for g in got] == [plain.encode(t or "", add_special_tokens=False).ids for t in TEXTS]


def test_memory_of_words_is_bounded(monkeypatch):
    monkeypatch.setattr(T, "REMEMBERED_WORDS", 5)
    encoder = T.WordEncoder(PATH)
    for t in TEXTS:
        assert np.frombuffer(encoder.encode([(t or "").encode()])[0], encoder.kind).tolist() + [T.END_ID] == whole(t)


@pytest.mark.parametrize("shards", [1, 3, 8])
def test_files_read_back(spark, shards):
    rows = [(5 * n - 10, t, "x") for n, t in enumerate(TEXTS)] + [(None, "null id", "x"), (40, "again", "x"), (40, "again", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(4)
    got = sorted(((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in T.read(T.write(docs, PATH, shards=shards)).collect()), key=lambda r: r[0])
    starts, at = [], 0
    for _, _, n, _ in got:
        starts.append(at)
        at += n
    assert [g[0] for g in got] == starts
    assert [g[1] for g in got] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i or 0))
    crc = lambda t: (len(whole(t)), zlib.crc32(np.array(whole(t), "<u4").tobytes()))
    assert sorted((g[1] is None, g[1] or 0, *g[2:]) for g in got) == sorted((i is None, i or 0, *crc(t)) for i, t, _ in rows)


def test_empty_table(spark):
    assert T.read(T.write(spark.createDataFrame([], "doc_id long, text string"), PATH)).collect() == []
