from pagemill.operators import positions, tagging


def test_only_texts_with_changes_get_a_list(spark):
    rows = spark.createDataFrame([(1, "A b, a b."), (2, "c"), (3, ""), (4, None)], "k int, text string")
    texts = positions.cut(rows, "k")
    changes = spark.createDataFrame([("b", "xx"), ("a", ""), ("z", "y")], "token string, value string")
    found = {r.k: r.changes for r in positions.with_changes(texts, "k", changes).collect()}
    assert positions.changed(found.pop(1)) == {"b": "xx", "a": ""}
    assert found == {2: None, 3: None, 4: None}
    assert {r.k: r.text for r in positions.replaced(texts, "k", changes).collect()} == {1: "A xx, xx.", 2: "c", 3: "", 4: ""}


def test_first_tags_of_batches_equal_those_of_columns(spark):
    words = ["the", "The", "walking", "ring", "3.5,1", "3a", "Bonn", "NASA", "was", "news", "class", "n't", "x", "Testing", "best", "aBc", "eD"]
    rows = spark.createDataFrame([(w,) for w in words], "w string")
    expected = [r.t for r in rows.select(tagging.tag(rows.w).alias("t")).collect()]
    assert [tagging._TAGS[tagging._first_code(w) - 1] for w in words] == expected
