"""The pipeline's join where one id stands in rows of different texts."""

from sparkloom.llm import ngram_join


def test_rows_of_one_id_and_different_texts_stay(spark):
    one, two = (" ".join(f"{k}{i}" for i in range(60)) for k in "ab")
    near = two.replace("b59", "x")
    rows = [(1, near, 0), (1, one, 1), (2, two, 2), (3, one, 3), (4, "quite another clean text", 4), (4, "and one more that is clean", 5), (4, "", 6), (4, None, 7), (4, "  ", 8), (5, "", 9), (6, "Same set here", 10), (6, "same  set here", 11), (None, one, 12), (None, "", 13), (7, "alone with its id", 14)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int").repartition(3)
    kept = {r.n: r for r in ngram_join.one_of_each(df, width=5, percent=80).collect()}
    # Of each component one row: 0 of (0, 2), 1 of (1, 3), the least text of (10, 11); no row for its id alone.
    assert sorted(kept) == [0, 1, 4, 5, 6, 7, 8, 9, 10, 12, 13, 14]
    assert all(tuple(kept[n]) == (i, t, n) for i, t, n in rows if n in kept)
