def test_both_tables_come_out_in_one_form(spark, tmp_path):
    from grainlake.llm.queries import p2_one_form

    spark.createDataFrame([(1, "hòa"), (1, "hòa"), (2, None)], "id bigint, passage string").write.parquet(f"{tmp_path}/selected_contexts.parquet")
    spark.createDataFrame([("1", "ｈòa")], "qid string, question string").write.parquet(f"{tmp_path}/train.parquet")
    rows = sorted(map(tuple, p2_one_form(spark, str(tmp_path)).collect()), key=str)
    assert rows == sorted([("selected_contexts", "1", "hòa"), ("selected_contexts", "2", None), ("train", "1", "hòa")], key=str)
