"""The data source of records against the files themselves."""

import json

import pytest

from evidentia.sources import records as R

KIND = "id string, categories string, n long, year int, line long, bad string"


@pytest.fixture
def source(spark):
    spark.dataSource.register(R.Records)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    yield spark
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def lines(k):
    return [json.dumps({"id": f"{15 + n % 3}01.{n:05d}", "categories": "ab"[n % 2], "n": n, "more": [1]}) for n in range(k)]


@pytest.mark.parametrize("group", [40, 1 << 20])
def test_lines(source, tmp_path, group):
    (tmp_path / "a.jsonl").write_text("\n".join([*lines(30), "", "not json", "[1]", '{"id": 5, "n": "x", "categories": {"k": 1}}', "é" * 50]))
    (tmp_path / "_skip").write_text("no")
    (tmp_path / "b.jsonl").write_text("")
    read = source.read.format("records").schema(KIND).option("group_bytes", group)
    got = read.load(str(tmp_path)).collect()
    assert sorted((r.id, r.n, r.year) for r in got if r.bad is None and r.n is not None) == sorted((f"{15 + n % 3}01.{n:05d}", n, 2015 + n % 3) for n in range(30))
    assert sorted(r.bad for r in got if r.bad) == sorted(["not json", "[1]", "é" * 50])
    assert [(r.id, r.n, r.categories) for r in got if r.bad is None and r.n is None] == [("5", None, '{"k": 1}')]
    assert len({r.line for r in got}) == len(got) == 34
    few = read.load(str(tmp_path)).where("year >= 2016 and categories = 'a' and n < 20 and length(id) = 10")
    assert sorted(r.n for r in few.collect()) == [n for n in range(20) if n % 3 and n % 2 == 0]
    if group == 40:
        assert read.load(str(tmp_path)).rdd.getNumPartitions() > 5


def test_files_of_other_years_are_not_opened(source, tmp_path):
    for name in ("1501.00001.xml", "1602.00001.xml", "notes.xml"):
        (tmp_path / name).write_text(f"<p>{name}</p>")
    (tmp_path / "1701.00001.xml").symlink_to(tmp_path / "1501.00001.xml")
    read = source.read.format("records").option("kind", "files")
    assert sorted((r.name, r.year) for r in read.load(str(tmp_path)).select("name", "year").collect()) == [
        ("1501.00001.xml", 2015), ("1602.00001.xml", 2016), ("1701.00001.xml", 2017), ("notes.xml", None),
    ]
    reader = R.RecordReader(R.StructType(), {"path": str(tmp_path), "kind": "files"})
    reader.wanted = [("year", R.GreaterThanOrEqual, 2016)]
    assert [n.rsplit("/", 1)[-1] for p in reader.partitions() for n, _, _ in p.files] == ["1602.00001.xml", "1701.00001.xml"]
    assert [r.text for r in read.load(str(tmp_path)).where("year = 2016").collect()] == ["<p>1602.00001.xml</p>"]


def test_a_stream_goes_on_behind_the_last_whole_line(source, tmp_path):
    file, seen = tmp_path / "in" / "a.jsonl", []
    file.parent.mkdir()

    def run():
        stream = source.readStream.format("records").schema("n long, line long").option("group_bytes", 100).load(str(file.parent))
        out = stream.writeStream.foreachBatch(lambda b, _: seen.extend(r.n for r in b.collect()))
        out.option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()

    whole = lines(20)
    file.write_text("\n".join(whole[:8]) + "\n" + whole[8][:10])
    run()
    assert sorted(seen) == list(range(8))
    with file.open("a") as more:
        more.write(whole[8][10:] + "\n" + "\n".join(whole[9:15]) + "\n")
    (file.parent / "b.jsonl").write_text("\n".join(whole[15:]) + "\n")
    run()
    run()
    assert sorted(seen) == list(range(20))
