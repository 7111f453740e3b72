"""The corpus's table of words, and what is left to the tasks, against the library."""

import base64
import random
from collections import Counter

import public_tokenizers
import pytest
import tiktoken

from ledgerloom.llm import byte_bpe, token_counts
from tokenizers import Tokenizer

RANKS, JSON = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def encoding():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts(seed=2):
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyzéßü中'") for _ in range(n))
    words = [word(rng.randint(3, 14)) for _ in range(300)]
    return [" ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) for _ in range(200)] + [None, "", word(5000), "a" * 3000, " " * 500]


@pytest.mark.parametrize("most", [byte_bpe.MAX_SHIPPED, 20, 0])
def test_ids_with_all_some_and_no_words_shipped(spark, encoding, most):
    rows = list(enumerate(odd_texts()))
    docs = spark.createDataFrame(rows + rows[:3], "doc_id long, text string")
    got = byte_bpe.round_trip(docs, RANKS, most=most).collect()
    wanted = {i: encoding.encode_ordinary(t or "") for i, t in rows}
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows + rows[:3])
    for r in got:
        assert [int.from_bytes(r.ids[k : k + 4], "little") for k in range(0, len(r.ids), 4)] == wanted[r.doc_id]
        assert bytes(r.decoded).decode() == (dict(rows)[r.doc_id] or "")


def test_table_of_words(spark, encoding):
    texts = ["zzyzzx zzyzzx the", " zzyzzx", None, "q" * 100]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    found = {bytes(r.word): r.n for r in byte_bpe.corpus_words(docs, RANKS).collect()}
    assert found == {b"zzyzzx": 1, b" zzyzzx": 2}
    for r in byte_bpe.replayed(byte_bpe.corpus_words(docs, RANKS), RANKS).collect():
        assert [int.from_bytes(r.ids[k : k + 4], "little") for k in range(0, len(r.ids), 4)] == encoding.encode_ordinary(bytes(r.word).decode())


def test_words_out_of_rank_order(encoding):
    rng, table = random.Random(8), byte_bpe.Ranks(RANKS)
    for n in (1, 2, 7, 40, 400):
        for _ in range(30):
            text = "".join(rng.choice("abestrinoüé") for _ in range(n))
            parts = [int(table.byte_rank[b]) for b in text.encode()]
            assert byte_bpe._one_by_one(parts, table.pairs) == encoding.encode_single_piece(text) if hasattr(encoding, "encode_single_piece") else encoding.encode_ordinary(text)


def test_a_word_of_any_length_keeps_the_count_table_small(monkeypatch):
    rng = random.Random(5)
    word = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(30_000))
    monkeypatch.setattr(token_counts, "MAX_STATES", 3000)
    counter = token_counts.Counter(JSON)
    assert counter.count([word, "aaab" * 5000]) == [len(e.ids) for e in Tokenizer.from_file(JSON).encode_batch([word, "aaab" * 5000], add_special_tokens=False)]
    assert len(counter.transducer.states) <= 3001
    fresh = token_counts.Counter(JSON)
    fresh.count(["ab" * 50_000])
    assert len(fresh.transducer.states) < 200  # prefixes that end alike share a state
