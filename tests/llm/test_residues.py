def cases(spark, rows):
    from grainlake.llm.residues import residue_documents

    df = spark.createDataFrame([(i, t, h, 1) for i, (t, h) in enumerate(rows)] * 2, "doc_id bigint, text string, source string, line int")
    return sorted(r[0] for r in residue_documents(df).collect())


def test_cases_and_no_cases(spark):
    found = ["Ngày ký: {{ date }}", "theo [TÊN CƠ QUAN] lộ trình", "qua %s định", "Nội dung\nLorem ipsum dolor sit amet, ut labore et dolore magna.", "503 - Không tìm thấy trang\n", "HÃY BẬT JAVASCRIPT ĐỂ XEM VĂN BẢN NÀY", "Trang chủ | Tra cứu | Đăng nhập\nAccess denied!"]
    none = [None, " ", "Mức 5%s được viết nhầm", "[Sửa đổi] [Bãi bỏ một phần] Khoản này", "Tôi là ________________, cư trú", "{a + b} x 12%", "vì sao cổng dịch vụ báo lỗi 404 cho viên chức", "đọc được cả khi tắt JavaScript"]
    assert cases(spark, [(t, None) for t in found + none]) == list(range(len(found)))


def test_a_notice_in_every_footer_is_boilerplate(spark):
    notice = "Vui lòng cho phép cookie và tập lệnh để tiếp tục."
    rows = [(f"Nội dung thật số {i}\n{notice}", "a.vn") for i in range(5)] + [(notice, "a.vn"), (f"Nội dung\n{notice}", "b.vn"), ("Chân trang {{ year }}", "a.vn")]
    assert cases(spark, rows) == [5, 6, 7]
    assert cases(spark, rows[:1]) == [0]
