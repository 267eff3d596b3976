"""CSV files and JSON documents in ranges, against readers of whole files."""

import csv
import io
import json
import random

import pytest

from weftflow.sources import files, ranges


@pytest.fixture
def small_ranges(spark):
    """Files are split at a given number of bytes."""
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {k: spark.conf.get(k) for k in keys}

    def put(size):
        spark.conf.set(keys[0], str(size))
        spark.conf.set(keys[1], "1")

    yield put
    for k, v in before.items():
        spark.conf.set(k, v)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def csv_text(seed, signs, n, eol):
    random.seed(seed)
    out = io.StringIO()
    writer = csv.writer(out, lineterminator=eol)
    writer.writerow(["h1", "h2", "h3"])
    for _ in range(n):
        writer.writerow(["".join(random.choice(signs) for _ in range(random.choice([1, 3, 9, 30]))) for _ in range(3)])
    return out.getvalue()


@pytest.mark.parametrize(("seed", "signs", "eol"), [(1, ["a", ",", '"', "\n", "é"], "\n"), (2, ["b", '"', '""', "\n\n"], "\n"), (3, ["c", "\n", '"', ","], "\r\n"), (4, ["d", "e"], "\n")])
def test_csv_as_multi_line(spark, tmp_path, small_ranges, seed, signs, eol):
    path = tmp_path / "a.csv"
    path.write_text(csv_text(seed, signs, 60, eol), newline="")
    whole = rows(spark.read.schema("h1 string, h2 string, h3 string").option("header", True).option("multiLine", True).option("escape", '"').csv(str(path)))
    size = path.stat().st_size
    for part in (size + 1, size // 7, size // 13):
        small_ranges(part)
        df = files.read_csv(spark, str(path))
        assert rows(df) == whole
        if part < size:
            assert ranges.lines(spark, str(path)).rdd.getNumPartitions() >= 7  # as many tasks as ranges


def test_csv_quotes_within_fields(spark, tmp_path, small_ranges):
    path = tmp_path / "a.csv"
    path.write_text('a,b\n5" pipe,x\n"say ""hi""",y\n"one\n\ntwo","three\n"\n\n"a"b,c\n' * 5)
    whole = rows(spark.read.schema("a string, b string").option("header", True).option("multiLine", True).option("escape", '"').csv(str(path)))
    small_ranges(11)
    assert rows(files.read_csv(spark, str(path))) == whole


def test_csv_of_several_files_and_none(spark, tmp_path, small_ranges):
    folder = tmp_path / "many"
    folder.mkdir()
    for i in range(3):
        (folder / f"{i}.csv").write_text(f'a,b\n{i},"x\ny"\n{i},z\n')
    small_ranges(7)
    assert rows(files.read_csv(spark, str(folder))) == sorted((str(i), v) for i in range(3) for v in ("x\ny", "z"))
    (tmp_path / "head.csv").write_text("a,b\n")
    empty = files.read_csv(spark, str(tmp_path / "head.csv"))
    assert empty.columns == ["a", "b"] and rows(empty) == []


def value(depth):
    r = random.random()
    if r < 0.3:
        return "".join(random.choice('ab"\\{}[],:é \n') for _ in range(random.choice([0, 2, 9])))
    if r < 0.6 or not depth:
        return random.choice([None, True, 7, -1])
    if r < 0.8:
        return [value(depth - 1) for _ in range(random.randint(0, 3))]
    return {random.choice(["a", "b", "data", "items", "x}y"]): value(depth - 1) for _ in range(random.randint(0, 3))}


@pytest.mark.parametrize("form", range(6))
def test_json_items(spark, tmp_path, small_ranges, form):
    random.seed(form)
    items = [random.randint(0, 99) for _ in range(40)] if form == 1 else [{"k": i, "v": value(3)} for i in range(30)]
    document = [items, items, {"meta": value(2), "items": items, "rows": [1]}, {"results": items, "z": value(2)}, {"data": {"a": 1}, "records": items, "c": "data"}, {"x": value(2), "n": 1}][form]
    path = tmp_path / "a.json"
    path.write_text(json.dumps(document, ensure_ascii=bool(form % 2), indent=2 if form % 3 else None))
    want = sorted(json.dumps(x, sort_keys=True) for x in (items if form < 5 else [document]))
    for part in (path.stat().st_size + 1, path.stat().st_size // 9):
        small_ranges(part)
        got = [json.loads(r.item) for r in ranges.json_items(spark, str(path), files.ENVELOPES).collect()]
        assert sorted(json.dumps(x, sort_keys=True) for x in got) == want


def test_json_rows(spark, tmp_path, small_ranges):
    path = tmp_path / "a.json"
    path.write_text('﻿ {"meta": {"data": 1}, "items": [{"a": 1, "s": "}]"}, {"a": 2}, 3, "x"], "items": [{"a": 5}, {"a": 6, "s": "\\"}"}]}')
    small_ranges(17)
    df = files.read_json(spark, str(path))
    assert df.columns == ["a", "s"] and rows(df) == [(5, None), (6, '"}')]  # of a field that stands twice the last counts
    assert rows(files.read_json(spark, str(path), "items array<struct<s string>>, meta struct<data long>")) == [('"}',), (None,)]
    path.write_text('[{"a": 1}, 2, "x", [3]]')
    assert rows(files.read_json(spark, str(path))) == [(1, None), (None, "2"), (None, "[3]"), (None, "x")]
    path.write_text("[]")
    assert rows(files.read_json(spark, str(path))) == []


def test_changed_ranges_are_an_error(spark, tmp_path, small_ranges):
    path = tmp_path / "a.csv"
    path.write_text("a,b\n" + "1,2\n" * 100)
    small_ranges(1000)
    df = files.read_csv(spark, str(path))
    small_ranges(23)
    with pytest.raises(Exception, match="ranges of a file changed"):
        df.collect()
