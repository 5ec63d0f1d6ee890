from firstlook.llm import learning


def test_a_repeated_id_has_one_text_whatever_the_order(spark):
    rows = [(1, "b"), (1, "a"), (1, None), (2, None), (3, "x"), (4, "not asked for")]
    docs, ids = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, 0), (2, 1), (3, 0)], "doc_id long, label int")
    found = [{tuple(r) for r in learning.with_texts(docs.repartition(n, "text"), ids).select("doc_id", "label", "text").collect()} for n in (1, 3, 5)]
    assert found[0] == found[1] == found[2] and len(found[0]) == 3
    assert {(2, 1, None), (3, 0, "x")} < found[0]
