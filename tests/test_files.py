"""Readers, writers, compaction, and the rules of the entry."""

import json
import os
import subprocess
import sys
import zipfile
from pathlib import Path

import pytest

from grainlake.sources import files, sinks

ROOT = Path(__file__).resolve().parents[1]


def test_corpus_of_json_files(spark, tmp_path):
    docs = {"a/context_7.json": {"passage": "p", "link": "https://x.vn/luat-moi-12.aspx"}, "b/context_8.json": {"id": 8, "name": "n", "passage": None}, "c/context_9.json": {"id": "8", "name": "later", "passage": "z", "link": None}}
    for name, value in docs.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(json.dumps(value))
    got = {r["doc_id"]: r.asDict() for r in files.read_corpus(spark, str(tmp_path), names_from_links=True).collect()}
    assert set(got) == {"7", "8"} and got["7"]["name"] == "luat moi" and got["8"]["name"] == "later" and got["8"]["link"] == ""


def test_questions_keep_their_order(spark, tmp_path):
    path = tmp_path / "q.json"
    path.write_text(json.dumps({"9": {"question": "một", "answer": "x"}, "10": {"question": " "}}))
    assert [(r["pos"], r["qid"], r["answer"]) for r in files.read_questions(spark, str(path)).orderBy("pos").collect()] == [(0, "9", "x"), (1, "10", None)]
    with pytest.raises(ValueError):
        files.read_questions(spark, str(path), strict=True)


def test_words_records_and_paths(spark, tmp_path):
    (tmp_path / "s.txt").write_text("có thể\n\n và \n")
    assert sorted(r[0] for r in files.read_stopwords(spark, str(tmp_path / "s.txt")).collect()) == ["có_thể", "và"]
    (tmp_path / "t1").write_text("a|b|")
    (tmp_path / "p1").write_text("x|y|")
    assert [(r["target"], r["prediction"]) for r in files.paired_records(spark, str(tmp_path / "t1"), str(tmp_path / "p1"), "|").orderBy("pos").collect()] == [("a", "x"), ("b", "y")]
    (tmp_path / "p1").write_text("x|y|z|")
    with pytest.raises(ValueError):
        files.paired_records(spark, str(tmp_path / "t1"), str(tmp_path / "p1"), "|")
    (tmp_path / "empty").write_text("")
    assert files.first_existing(spark, str(tmp_path), ["no", "empty", "t1"]).endswith("/t1")
    with pytest.raises(FileNotFoundError):
        files.first_existing(spark, str(tmp_path), ["no"])
    (tmp_path / "selected-contexts" / "selected-contexts").mkdir(parents=True)
    assert files.context_folder(spark, str(tmp_path)).endswith("selected-contexts/selected-contexts")


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("2", "hai\"x"), ("1", None)], "qid string, answer string")
    path = str(tmp_path / "o" / "submission.json")
    sinks.write_submission(df, path)
    assert json.loads(Path(path).read_text()) == {"1": {"answer": ""}, "2": {"answer": 'hai"x'}}
    sinks.zip_submission(path, str(tmp_path / "s.zip"))
    assert zipfile.ZipFile(tmp_path / "s.zip").namelist() == ["submission.json"]
    with pytest.raises(ValueError):
        sinks.write_submission(df.union(df), path)
    assert sinks.artifact_names("public", True)["archive"] == "public_smoke_submission.zip"
    sinks.write_aggregates(spark.createDataFrame([("rouge1-P", 0.1, 0.2, 0.3)], "score_type string, low double, mid double, high double"), str(tmp_path / "a.csv"))
    assert (tmp_path / "a.csv").read_text() == "score_type,low,mid,high\nrouge1-P,0.100000,0.200000,0.300000\n"
    table = str(tmp_path / "t")
    for n in (3, 2):
        sinks.replace_table(spark.range(n), table)
        assert spark.read.parquet(table).count() == n
    assert sorted(os.listdir(tmp_path)) == ["a.csv", "o", "s.zip", "t"]
    listed = sinks.manifest(spark, str(tmp_path / "o"))
    sinks.check_manifest(spark, str(tmp_path / "o"), listed)
    with pytest.raises(ValueError):
        sinks.check_manifest(spark, str(tmp_path / "o"), [{**listed[0], "size": 0}])
    one = spark.createDataFrame([("q", 1.0, 0.5, 0.6)], "qid string, precision double, recall double, fmeasure double")
    sinks.write_scores({"rouge1": one, "rouge2": one}, str(tmp_path / "scores"))
    assert spark.read.option("header", True).csv(str(tmp_path / "scores")).columns == ["id", "rouge1-P", "rouge1-R", "rouge1-F", "rouge2-P", "rouge2-R", "rouge2-F"]
    sinks.write_groups(spark.createDataFrame([(i, f"l{i}") for i in range(6)], "pos int, value string"), str(tmp_path / "g"))
    assert sorted(p.read_text() for p in (tmp_path / "g").rglob("*.txt")) == ["l0\nl1\nl2\nl3\n", "l4\nl5\n"]


def test_compaction_takes_the_latest_complete_state(spark, tmp_path):
    from grainlake.operators.compaction import compact_delivery

    doc = lambda i, p: json.dumps({"id": i, "passage": p})
    rows = [
        (1, "context_5.json", "2024-01-01", json.dumps({"passage": ""})), (2, "x.json", "2024-01-02", doc("7", "old")), (3, "x2.json", "2024-01-03", doc(7, "new") + "\n{damaged\n" + doc(8, "z")),
        (4, "x3.json", None, doc(7, "no date")), (5, "x4.json", "2024-01-03", doc(7, "same date")), (6, "x5.json", "2024-02-01", None), (7, "context_99999999999999999999.json", "2024-02-01", json.dumps({"passage": "p"})),
        (8, "x6.json", "2024-02-01", doc(9223372036854775807, "last")), (9, "x7.json", "2024-02-01", json.dumps({"id": 7})),
    ]
    df = spark.createDataFrame([(*r, 0) for r in rows + rows[:2]], "file_id bigint, file_path string, modified_at string, raw_json string, id int").selectExpr("file_id", "file_path", "cast(modified_at as timestamp) as modified_at", "raw_json", "id")
    path = str(tmp_path / "t")
    got = sorted((r["id"], r["file_id"], r["passage"]) for r in compact_delivery(df, path).collect())
    assert got == [(5, 1, ""), (7, 3, "new"), (8, 3, "z"), (9223372036854775807, 8, "last")]
    with pytest.raises(FileExistsError):
        compact_delivery(df, path)
    assert sorted(os.listdir(tmp_path)) == ["t"]
    assert compact_delivery(df.limit(0), str(tmp_path / "e")).isEmpty()


def run(code, **env):
    return subprocess.run([sys.executable, "-c", code], cwd=env.pop("cwd", ROOT), env=os.environ | env, capture_output=True, text=True, timeout=120)


def test_queries_load_without_a_session():
    done = run("import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q); print(len(q))")
    assert done.returncode == 0 and int(done.stdout) >= 90, done.stderr


def test_the_rest_stands_without_the_subpackage(tmp_path):
    import shutil

    shutil.copytree(ROOT / "grainlake", tmp_path / "grainlake", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    done = run("import __spark_entry__ as e; assert 'p5_found' in e.queries() and 'p1_found' not in e.queries()", cwd=tmp_path, PYTHONPATH="")
    assert done.returncode == 0, done.stderr
