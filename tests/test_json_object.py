"""JSON objects that fill a file, read in ranges and written by many tasks, against the json module."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from curatrix.sources import json_object as J

NASTY = ['a"b', "a\\", '\\"', "{[,:]}", "é, ü:  ", "", "\\\\\"", "x\n\ty", '","', "}{", "\\u0041", "😀"]


def value(rng, depth=0):
    kind = rng.randrange(7 if depth < 4 else 4)
    if kind < 2:
        return "".join(rng.choice(NASTY) for _ in range(rng.randrange(4)))
    if kind < 4:
        return rng.choice([None, True, False, 0, -1.5, 1e30, 12345])
    if kind < 6:
        return [value(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {rng.choice(NASTY) + str(i): value(rng, depth + 1) for i in range(rng.randrange(4))}


def scanned(path, level=1, size=1 << 40):
    """What read_entries does, in this process."""
    source = J.Source(path)
    ranges = [J.Range(path, i, min(i + size, source.handle.size())) for i in range(0, source.handle.size(), size)]
    for a, b in zip(ranges, ranges[1:]):
        parity, outside, inside = J.state_of(source, a.start, a.end)
        b.inside, b.depth = a.inside ^ bool(parity), a.depth + (inside if a.inside else outside)
    for a, b in zip(ranges, ranges[1:]):
        n, separator, colon = J.census_of(source, a, level)
        b.first, b.separator, b.colon = a.first + n, max(a.separator, separator), max(a.colon, colon)
    return [e for r in ranges for e in J.entries_of(source, r, level)]


@pytest.mark.parametrize("seed", range(8))
@pytest.mark.parametrize("indent", [None, 2])
def test_any_ranges_give_all_entries(tmp_path, monkeypatch, seed, indent):
    rng = random.Random(seed)
    monkeypatch.setattr(J, "BLOCK", rng.choice([3, 16, 1000]))
    path, top = str(tmp_path / "x.json"), rng.choice([list, dict])
    data = {rng.choice(NASTY) + str(i): value(rng) for i in range(25)}
    data = list(data.values()) if top is list else data
    with open(path, "w", encoding="utf-8") as f:
        json.dump(data, f, ensure_ascii=bool(seed % 2), indent=indent)
    pairs = list(data.items()) if top is dict else [(None, v) for v in data]
    for size in (1, 2, 7, 50, 1 << 30):
        got = scanned(path, 1, size)
        assert [(k, json.loads(v)) for _, _, k, v in got] == pairs and [n for n, *_ in got] == list(range(len(pairs)))
    if top is dict:
        inner = [(m, k, v) for m, x in data.items() if isinstance(x, dict | list) for k, v in (x.items() if isinstance(x, dict) else ((None, v) for v in x))]
        for size in (1, 5, 64, 1 << 30):
            assert [(m, k, json.loads(v)) for _, m, k, v in scanned(path, 2, size)] == inner


@pytest.mark.parametrize("text, found", [("{}", 0), ("[]", 0), (" { } ", 0), ('{"a":1}', 1), ("[1]", 1), ('\n[ "a" , [ ] ]\n', 2), ("", 0)])
def test_small_texts(tmp_path, text, found):
    path = tmp_path / "x.json"
    path.write_text(text)
    assert len(scanned(str(path), 1, 2)) == found


@pytest.mark.parametrize("text", ['{"a": 1', '{"a', '[1, "x]'])
def test_texts_that_end_too_soon(tmp_path, text):
    path = tmp_path / "x.json"
    path.write_text(text)
    with pytest.raises(ValueError):
        scanned(str(path))


def test_empty_and_missing_files(spark, tmp_path):
    (tmp_path / "x.json").write_text("")
    assert J.read_entries(spark, str(tmp_path / "x.json")).collect() == [] and J.read_entries(spark, str(tmp_path)).count() == 0
    (tmp_path / "y.json").write_text('{"a": 1}')
    assert [(r.file.rsplit("/", 1)[1], r.key) for r in J.read_entries(spark, f"file:{tmp_path}").collect()] == [("y.json", "a")]
    with pytest.raises(FileNotFoundError):
        J.read_entries(spark, str(tmp_path / "none.json"))


def test_a_file_is_read_by_many_tasks(spark, tmp_path):
    path = str(tmp_path / "x.json")
    data = {f"k{i}": [{"i": i, "s": "\\\"{" * (i % 5)}] for i in range(5000)}
    with open(path, "w") as f:
        json.dump({"meta": {"n": 1}, "list": list(range(3000)), "data": data, "none": {}}, f)
    df = J.read_entries(spark, path, 2, "data", 10_000)
    assert df.rdd.getNumPartitions() > 10
    assert {r.key: json.loads(r.value) for r in df.collect()} == data
    listed = J.read_entries(spark, path, 2, "list", 10_000).orderBy("ord").collect()
    assert [json.loads(r.value) for r in listed] == list(range(3000))
    tops = J.read_entries(spark, path, 1, range_bytes=10_000).collect()
    assert [r.key for r in sorted(tops, key=lambda r: r.ord)] == ["meta", "list", "data", "none"]
    assert len({r[0] for r in df.groupBy(F.spark_partition_id()).count().collect()}) > 10


def test_many_tasks_write_one_file(spark, tmp_path):
    path = str(tmp_path / "x.json")
    df = spark.range(1000).select(F.when(F.col("id") < 500, "a").otherwise("b").alias("member"), F.when(F.col("id") < 500, F.concat(F.lit('k"'), "id")).alias("key"), F.to_json(F.struct("id")).alias("value"), "id")
    J.write_entries(df.repartitionByRange(7, "id").sortWithinPartitions("id"), path, members=[("first", "array"), ("a", "object")])
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    assert list(data) == ["first", "a", "b"] and data["first"] == [] and data["a"]['k"7'] == {"id": 7} and [x["id"] for x in data["b"]] == list(range(500, 1000)) and list(data["a"]) == [f'k"{i}' for i in range(500)]
    assert [p.name for p in tmp_path.iterdir()] == ["x.json"]
    with pytest.raises(Exception, match="FileExistsError|x.json"):
        J.write_entries(df, path)
    J.write_entries(df.where("false"), path, "array", mode="overwrite")
    with open(path) as f:
        assert json.load(f) == []


def test_scanning_is_fast_and_bounded(tmp_path):
    """A value of 40 MB, and 40 MB of small ones."""
    path = str(tmp_path / "x.json")
    with open(path, "w") as f:
        json.dump({"one": "ab\\\"" * 6_000_000, "many": {f"key{i}": i for i in range(1_500_000)}}, f)
    began = time.perf_counter()
    source = J.Source(path)
    size = source.handle.size()
    J.state_of(source, 0, size)
    assert size > 40e6 and time.perf_counter() - began < 20
    assert [len(v) for *_, v in J.entries_of(source, J.Range(path, 0, size), 1)][0] > 24e6
