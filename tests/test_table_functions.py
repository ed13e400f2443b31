import pytest

from pairgate.sources import table_functions as T


def test_functions_in_sql_text(spark):
    T.register(spark)
    T.register_views(
        spark,
        {
            "udtf_texts": spark.createDataFrame([(1, "abcdefg", "A:BC:"), (2, "", "A"), (3, None, None)], "id int, text string, chains string"),
            "udtf_turns": spark.createDataFrame([(1, 3, "c"), (1, 1, "a"), (1, 2, "b"), (2, 1, "x"), (None, 1, "n")], "conv int, turn int, text string"),
        },
    )
    rows = lambda q: sorted(tuple(r) for r in spark.sql(q).collect())
    assert rows("SELECT id, w.* FROM udtf_texts, LATERAL sequence_windows(text, 3) w") == [
        (1, 0, 3, "abc"), (1, 3, 6, "def"), (1, 6, 7, "g"), (2, 0, 0, ""),
    ]
    assert rows("SELECT id, c.* FROM udtf_texts, LATERAL sequence_chains(chains, ':') c") == [(1, 0, "A"), (1, 1, "BC"), (1, 2, ""), (2, 0, "A")]
    numbered = spark.sql("SELECT * FROM numbered_rows(TABLE(udtf_turns) PARTITION BY conv ORDER BY turn)")
    assert numbered.columns == ["conv", "turn", "text", "nth"]
    assert {(r.conv, r.text, r.nth) for r in numbered.collect()} == {(1, "a", 1), (1, "b", 2), (1, "c", 3), (2, "x", 1), (None, "n", 1)}
    head = spark.sql("SELECT text FROM head_rows(TABLE(udtf_turns) PARTITION BY conv ORDER BY (turn DESC), 2)")
    assert {r.text for r in head.collect()} == {"c", "b", "x", "n"}


def test_wrong_arguments_are_refused(spark):
    T.register(spark)
    spark.range(2).withColumnRenamed("id", "nth").createOrReplaceTempView("udtf_nth")
    with pytest.raises(Exception, match="already has a column nth"):
        spark.sql("SELECT * FROM numbered_rows(TABLE(udtf_nth) PARTITION BY nth)").collect()
    with pytest.raises(Exception, match="at least one character"):
        spark.sql("SELECT * FROM sequence_windows('abc', 0)").collect()
