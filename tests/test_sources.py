import pytest

from topicloom.operators import keywords as W
from topicloom.sources import files


def test_csv_round_trip(spark, tmp_path):
    rows = [(1, 'a, "q"\nline', 1.5), (2, None, None), (3, "  padded ", 2.0), (4, "n/a", 3.0)]
    df = spark.createDataFrame(rows, "id bigint, t string, d double")
    files.write_csv(df, str(tmp_path / "c"))
    text = "".join(p.read_text() for p in (tmp_path / "c").glob("*.csv"))
    assert "2,NaN,NaN" in text
    back = files.read_csv(spark, str(tmp_path / "c"), "id bigint, t string, d double").orderBy("id").collect()
    assert [tuple(r) for r in back] == [rows[0], rows[1], rows[2], (4, None, 3.0)]


def test_json_lines(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"title": "t", "extra": 1, "journal-ref": "J 2018"}\n{"abstract": "b"}\n')
    got = files.read_json_lines(spark, str(tmp_path / "p.json")).collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted([("t", None, "J 2018"), (None, "b", None)], key=str)


def test_xml_files_and_columns(spark, tmp_path):
    page = "<s><totalCnt>2</totalCnt><prec><링크>/a?b=1&amp;c</링크></prec><prec><링크>/d</링크></prec></s>"
    (tmp_path / "x.xml").write_text(page, encoding="utf-8")
    got = files.read_xml_records(spark, str(tmp_path / "x.xml"), "prec", "`링크` string").collect()
    assert sorted(r[0] for r in got) == ["/a?b=1&c", "/d"]
    df = spark.createDataFrame([(7, page)], "page int, payload string")
    rows = files.xml_listing(df, "payload", "prec", "링크", "totalCnt").orderBy("pos").collect()
    assert [tuple(r) for r in rows] == [(7, 2, 0, "/a?b=1&c"), (7, 2, 1, "/d")]
    detail = spark.createDataFrame([(1, "<d><a>x</a><b></b></d>")], "id int, payload string")
    assert tuple(files.xml_detail(detail, "payload", {"a": "issue", "b": "summary", "c": "contents"}).first()) == (1, "x", None, None)


def test_word_list_with_carriage_returns(spark, tmp_path):
    (tmp_path / "w.txt").write_bytes("그리고\r\n그리고\r\n 두 말 \r\n\r\n".encode())
    words = [r[0] for r in files.read_word_list(spark, str(tmp_path / "w.txt")).collect()]
    assert sorted(words) == ["그리고", "두 말"]


def test_text_and_json_sinks(spark, tmp_path):
    files.write_lines(spark.createDataFrame([("가",), ("b",)], "sentence string"), str(tmp_path / "t"))
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "t")).collect()) == ["b", "가"]
    files.write_json(spark.sql("SELECT 1 AS id, named_struct('a', named_struct('b', 'x')) AS c"), str(tmp_path / "j"))
    assert spark.read.schema("id int, c struct<a: struct<b: string>>").json(str(tmp_path / "j")).first()["c"]["a"]["b"] == "x"


def test_csv_columns_are_found_by_header_name(spark, tmp_path):
    path = tmp_path / "h.csv"
    path.write_text(",year,title\n0,2018,first\n1,,second\n")
    got = files.read_csv(spark, str(path), "title string, year int").collect()
    assert sorted((r["title"], r["year"]) for r in got) == [("first", 2018), ("second", None)]
    with pytest.raises(ValueError, match="no column abstract"):
        files.read_csv(spark, str(path), "title string, abstract string")


@pytest.mark.parametrize("body", ["title,year\na,20x8\n", "title,year\na\n"])
def test_bad_csv_cells_raise_or_are_null(spark, tmp_path, body):
    path = tmp_path / "b.csv"
    path.write_text(body)
    with pytest.raises(Exception):
        files.read_csv(spark, str(path), "title string, year int").collect()
    assert [tuple(r) for r in files.read_csv(spark, str(path), "title string, year int", mode="null").collect()] == [("a", None)]


def test_broken_json_lines_raise_or_are_null(spark, tmp_path):
    path = tmp_path / "b.json"
    path.write_text('{"title": "t"}\n{"title": \n')
    with pytest.raises(Exception):
        files.read_json_lines(spark, str(path)).collect()
    assert files.read_json_lines(spark, str(path), mode="null").count() == 2
