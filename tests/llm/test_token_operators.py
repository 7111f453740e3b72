"""Token counts, byte-level BPE, and the word machine they share, against the tokenizers' own libraries."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from tokenizers import Tokenizer

from ledgerloom.llm import byte_bpe, pretokens, token_counts

JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ALPHABET = [*"abstredvlmxyzAB  \t\n'''0129!?#é中١ǅ\U0001f600-_.\r\x85\x1c\x0b", "'s", "'re", "'ll", "'ve", "  ", "<|endoftext|>"]


def fuzz(n: int, seed: int) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 30))) for _ in range(n)] + ["", " ", "\n", "'", "'r", "a" * 3000, " " * 700, "ab" * 900]


@pytest.fixture(scope="module")
def texts(spark):
    return [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()] + fuzz(1500, 1)


@pytest.fixture(scope="module")
def encoding():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_words_are_the_patterns_matches(texts):
    words = pretokens.Pretokens(texts)
    for i, text in enumerate(texts[-400:], len(texts) - 400):
        own = [words.word(k).decode() for k in range(words.bounds[i], words.bounds[i + 1])]
        assert "".join(own) == text
        if not set(text) & {"\x1c", "\x85"}:  # what counts as white space there differs between regex libraries
            assert own == regex.findall(public_tokenizers.PATTERN, text)


def test_chunk_maps_compose_to_a_run_from_the_start():
    classes = np.random.default_rng(3).integers(0, pretokens.CLASSES, pretokens.CHUNK * 9).astype(np.uint8)
    starts = pretokens.start_states(pretokens.state_maps(np.ascontiguousarray(classes.reshape(9, -1).T)))
    state = 0
    for k, c in enumerate(classes):
        if k % pretokens.CHUNK == 0:
            assert starts[k // pretokens.CHUNK] == state * pretokens.CLASSES
        state = int(pretokens.NEXT[state * pretokens.CLASSES + c])


def test_counts_equal_the_library(texts):
    wanted = [len(e.ids) for e in Tokenizer.from_file(JSON).encode_batch(texts, add_special_tokens=False)]
    assert token_counts.Counter(JSON).count(texts) == wanted


def test_transducer_forgets_and_stays_right(monkeypatch, texts):
    monkeypatch.setattr(token_counts, "MAX_STATES", 50)
    monkeypatch.setattr(token_counts, "MAX_PAIRS", 20)
    wanted = [len(e.ids) for e in Tokenizer.from_file(JSON).encode_batch(texts[:40], add_special_tokens=False)]
    assert token_counts.Counter(JSON).count(texts[:40]) == wanted


def test_ids_equal_the_library_and_decode_back(texts, encoding):
    codec = byte_bpe.Codec(RANKS)
    for text, ids in zip(texts, codec.encode(texts), strict=True):
        assert ids.tolist() == encoding.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()


def test_count_query_edges(spark):
    docs = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "hello<|endoftext|>'s", 5), (3, "hello<|endoftext|>'s", 5), (None, "x " * 2000, 5)], "doc_id long, text string, n_tokens int")
    got = sorted(((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(docs, JSON).collect()), key=str)
    library = Tokenizer.from_file(JSON)
    n = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    one = n("hello<|endoftext|>'s")
    assert got == sorted([(1, 0, 0, False), (2, 0, 0, False), (3, 20, one, False), (3, 20, one, False), (None, 4000, n("x " * 2000), True)], key=str)
    assert token_counts.count_tokens(docs.limit(0), JSON).count() == 0


def test_round_trip_edges(spark, encoding):
    docs = spark.createDataFrame([(1, None, b"x"), (2, "ab ß\n", b"x"), (2, "ab ß\n", b"x")], "doc_id long, text string, ids binary")
    rows = byte_bpe.round_trip(docs, RANKS).orderBy("doc_id").collect()
    assert [(r.n_tokens, bytes(r.decoded)) for r in rows] == [(0, b""), *[(len(encoding.encode_ordinary("ab ß\n")), "ab ß\n".encode())] * 2]
    assert bytes(rows[1].ids) == np.array(encoding.encode_ordinary("ab ß\n"), "<u4").tobytes()
    back = byte_bpe.decode(byte_bpe.encode(docs, RANKS), RANKS).orderBy("doc_id").collect()
    assert hashlib.sha256(back[1].decoded).digest() == hashlib.sha256("ab ß\n".encode()).digest()
