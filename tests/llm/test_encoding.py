import random

import pytest

from claimweave.llm.encoding import TrieEncoder, encode_corpus

TEXTS = ["", " ", "  ", "a", " a  b\t c\n\n d", "It's we'll I'M don't", "naïve café — 日本語テキスト。", "x" * 3000, "=" * 300, "<|endoftext|> hi", "\r\n\r\n x \x1c y\x00", "123456 7 8,9.10", "a\u00a0b \u2003c", "😀😀 é́", "aaaa aaaaa aaaaaaa", "\n \n  \n"]


def test_equals_the_tokenizer(vocabulary):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(vocabulary)
    t.encode_special_tokens = True
    random.seed(1)
    alphabet = "abcdefgh ABC  \n\t.,;'-_=/\\019éßж日 "
    texts = TEXTS + ["".join(random.choice(alphabet) for _ in range(random.randrange(200))) for _ in range(400)]
    enc = TrieEncoder(vocabulary)
    for batch in (texts, texts[::-1]):
        offsets, ids = enc.encode_batch(batch)
        for i, text in enumerate(batch):
            assert ids[offsets[i] : offsets[i + 1]].tolist() == t.encode(text, add_special_tokens=False).ids, text


def test_frame_has_a_row_for_every_text(spark, vocabulary):
    df = spark.createDataFrame([(1, "a b", "x"), (2, None, "x"), (3, "", "x"), (3, "", "x")], "doc_id bigint, text string, ids string")
    out = sorted((r.doc_id, list(r.ids)) for r in encode_corpus(df).collect())
    assert [k for k, _ in out] == [1, 2, 3, 3] and out[0][1] and not any(v for k, v in out if k > 1)
    assert encode_corpus(df.limit(0)).count() == 0
