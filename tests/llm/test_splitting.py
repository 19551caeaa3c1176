def test_heading_after_a_finished_sentence(spark):
    from grainlake.llm.splitting import article_starts

    for end in ("ở cả hai địa điểm.", "thiết bị điện tử.", "phạt tù.", "bước tiếp theo;", "nghiêm trọng.”", "tài khoản."):
        text = f"Điều 3. Một\nNộp hồ sơ {end}\nĐiều 4. Hai"
        assert article_starts(text) == [0, text.index("Điều 4")], end


def test_reference_across_a_line_break_opens_nothing(spark):
    from grainlake.llm.splitting import article_starts

    for end in ("quy định tại", "theo khoản 2", "điểm đ", "căn cứ", "chiếu theo"):
        assert article_starts(f"Điều 3. Một\nThực hiện {end}\nĐiều 4. của luật này") == [0], end
