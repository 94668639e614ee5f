"""Rows without words stay as they are in one_per_group."""

from collections import Counter

from arcweave.llm.jaccard_join import JaccardJoin


def test_rows_without_words_stay_as_they_are(spark):
    text = "q w e r t y u"
    rows = [(None, None, "a"), (None, None, "b"), (None, "", "c"), (None, " \n", "d"), (None, "", "c"), (1, "", "e"), (1, "", "f"), (5, text, "g"), (5, text, "h"), (None, text, "i"), (None, "other words of no one else", "j"), (None, "\u00a0", "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = Counter(r["source"] for r in JaccardJoin().one_per_group(docs).collect())
    assert kept.pop("g", 0) + kept.pop("h", 0) == 1
    assert kept == Counter("abccdefjk")
