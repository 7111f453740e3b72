"""Ids that no token has."""

import numpy as np
import public_tokenizers

from ledgerloom.llm import byte_bpe

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def test_invalid_ids_give_null(spark):
    docs = spark.createDataFrame([(1, "some text, decoded"), (2, ""), (3, None)], "doc_id long, text string")
    good = byte_bpe.encode(docs, RANKS)
    packed = lambda *ids: bytearray(np.array(ids, "<u4").tobytes())
    rows = [(11, packed(50_256)), (12, packed(5, 2**32 - 1)), (13, bytearray(b"abc")), (14, None), (15, packed(5, 6))]
    got = {r.doc_id: r.decoded for r in byte_bpe.decode(good.select("doc_id", "ids").unionByName(spark.createDataFrame(rows, "doc_id long, ids binary")), RANKS).collect()}
    assert bytes(got[1]) == b"some text, decoded" and bytes(got[2]) == bytes(got[3]) == b"" and got[15] is not None
    assert [got[i] for i in (11, 12, 13, 14)] == [None] * 4
