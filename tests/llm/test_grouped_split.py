def test_all_keys_of_a_question_are_tied(spark):
    from grainlake.llm.grouped_split import key_components

    keys = spark.range(1).selectExpr("transform(sequence(1, 100003), i -> lpad(string(i), 6, '0')) as keys")
    label = key_components(keys)
    assert label.count() == 100_003 and label.filter("label <> '000001'").isEmpty()
