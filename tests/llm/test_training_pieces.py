from ledgerloom.llm import language_model as lm
from ledgerloom.llm.decontaminate import Shipped


def test_every_training_word_is_in_one_piece(spark):
    texts = [(str(i), "a b c " * i) for i in range(60)] + [("x", None), (None, "d")]
    docs = spark.createDataFrame(texts, "id string, text string")
    lexicon = lm.lexicon(docs, lm.word_counts(docs.select("text")), 10, 10)
    found = lm.pieces(docs, Shipped(spark.sparkContext.broadcast(lexicon)), 16).collect()
    assert sum(len(r.ids) - 1 for r in found) == lexicon.n == sum(len((t or "").split()) + 1 for _, t in texts)
    assert max(len(r.ids) for r in found) == 17 and sum(r.ids[0] == -1 for r in found) == len(texts)
