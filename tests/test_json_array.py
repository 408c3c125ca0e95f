"""The splittable reader of JSON arrays against json.loads and Spark's own reader of lines."""

import json
import random

import pyarrow as pa
import pytest

from tidegauge.sources import arrays, files

SCHEMA = "id long, text string, inner struct<a: array<struct<b: string>>>"


@pytest.fixture
def blocks_of(spark):
    """Sets the size of blocks, as small as a test needs."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}
    yield lambda size: [spark.conf.set(n, str(size)) for n in names]
    for n, v in before.items():
        spark.conf.set(n, v)


def objects(n, seed, longest=60):
    r = random.Random(seed)
    signs = ['"', "\\", "}", "{", "]", "[", ",", "\n", " ", "a", "é", "\U0001f30a", '\\"}', "}}", '"},{"', " "]
    text = lambda: "".join(r.choice(signs) for _ in range(r.randrange(longest)))
    return [{"id": i, "text": r.choice([None, text()]), "inner": {"a": [{"b": text()} for _ in range(r.randrange(4))]}} for i in range(n)]


def texts(spark, path):
    return sorted((json.loads(r["value"]) for r in arrays.json_array_texts(spark, str(path)).collect()), key=lambda x: x["id"])


@pytest.mark.parametrize(("size", "seed"), [(90, 1), (200, 2), (700, 3), (1 << 20, 4)])
def test_any_block_size_gives_the_same_objects(spark, blocks_of, tmp_path, size, seed):
    made = objects(40, seed)
    (tmp_path / "one.json").write_text(json.dumps(made, ensure_ascii=seed % 2 == 0, indent=None if seed < 3 else 1), encoding="utf-8")
    blocks_of(size)
    assert arrays._fragments(spark, str(tmp_path)).select("block").distinct().count() > (1 if size < 5000 else 0)
    assert texts(spark, tmp_path) == made


def test_an_object_longer_than_many_blocks(spark, blocks_of, tmp_path):
    made = [{"id": 0, "text": "x"}, {"id": 1, "text": '"}' * 3000 + "{[" * 500}, {"id": 2, "inner": {"a": [{"b": "}"}] * 400}}, {"id": 3}]
    (tmp_path / "long.json").write_text(json.dumps(made))
    blocks_of(256)
    assert texts(spark, tmp_path) == made


def test_shuffled_blocks_give_the_same(spark, blocks_of, tmp_path, monkeypatch):
    made = objects(20, 9)
    (tmp_path / "one.json").write_text(json.dumps(made))
    blocks_of(120)
    monkeypatch.setattr(arrays, "BROADCAST_BLOCKS", 0)
    assert texts(spark, tmp_path) == made


def test_many_files_blanks_and_empty_arrays(spark, blocks_of, tmp_path):
    made = objects(30, 5)
    for i in range(3):
        (tmp_path / f"{i}.json").write_text(" \n" * i + json.dumps(made[i * 10 : i * 10 + 10]) + "\n" * i)
    (tmp_path / "none.json").write_text("[ ]\n")
    (tmp_path / "blank.json").write_text(" \n")
    (tmp_path / "empty.json").write_text("")
    (tmp_path / "mark.json").write_text("﻿" + json.dumps([{"id": 99}]), encoding="utf-8")
    blocks_of(100)
    assert texts(spark, tmp_path) == [*made, {"id": 99}]


@pytest.mark.parametrize("text", ['{"id": 1}', '[{"id": 1}, {"id": 2', '[{"id": 1}, 5]', "[1, 2]", '[[{"id": 1}]]', '[{"id": "open}]', 'x[{"id": 1}]', "null"])
def test_what_is_no_array_of_objects_is_an_error(spark, tmp_path, text):
    (tmp_path / "bad.json").write_text(text)
    with pytest.raises(Exception, match="array"):
        arrays.json_array_texts(spark, str(tmp_path)).collect()


def test_round_trip_and_the_reader_of_lines(spark, blocks_of, tmp_path):
    made = spark.createDataFrame(objects(60, 6), SCHEMA).repartition(3)
    arrays.write_json_array(made, str(tmp_path / "arrays"))
    made.write.json(str(tmp_path / "lines"))
    for part in (tmp_path / "arrays").glob("part-*"):
        json.loads(part.read_text(encoding="utf-8"))
    blocks_of(700)
    got = arrays.read_json_array(spark, str(tmp_path / "arrays"), made.schema)
    want = spark.read.schema(made.schema).json(str(tmp_path / "lines"))
    by_id = lambda df: sorted(map(repr, df.collect()))
    assert by_id(got) == by_id(want) == by_id(made)


def test_articles_of_an_array(spark, blocks_of, tmp_path):
    rows = [{"doc_id": str(i), "ts": "2024-01-02T03:04:05Z" if i % 2 else "bad", "title": f"t{i}", "body": "b}" * i, "source": None, "other": {"x": 1}} for i in range(40)]
    (tmp_path / "a.json").write_text(json.dumps(rows))
    (tmp_path / "b.jsonl").write_text("\n".join(map(json.dumps, rows)))
    blocks_of(150)
    got, want = files.articles_json_array(spark, str(tmp_path / "a.json")), files.articles_json_lines(spark, str(tmp_path / "b.jsonl"))
    assert got.schema == want.schema
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_few_texts_at_a_time_are_objects():
    """A batch of long texts is taken in parts, and what was cut out waits for no thousand others."""
    from tidegauge.sources import arrays

    texts = ["[" * (i == 0) + "," * (i > 0) + '{"a": "' + "x" * 20_000 + '"' for i in range(950)] + ["]"]
    n = len(texts)
    whole = {"file": ["f"] * n, "block": [0] * n, "value": texts, "inside": [False] * n, "depth": [0] * n, "edge": [0] * n}
    made = list(arrays._objects(iter([pa.RecordBatch.from_pydict(whole)]), False)) + list(arrays._objects(iter([pa.RecordBatch.from_pydict(whole)]), True))
    assert max(b.nbytes for b in made) < 2_000_000 and max(b.num_rows for b in arrays._parts(iter(made))) <= arrays.PART
    objects = [x for b in arrays._clean(b.select(["edge", "text"]) for b in made) for x in b.column(0).to_pylist()]
    assert sorted(len(x) for x in objects) == [20_009] * 950
