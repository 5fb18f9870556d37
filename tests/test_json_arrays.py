import json
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.sources.json_arrays import effect, object_texts, pieces_of, range_effects, read_json_array

SCHEMA = "id long, text string, more struct<a:array<string>, b:string>"


@pytest.fixture
def ranges(spark):
    """Byte ranges of the size asked for."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    old = {n: spark.conf.get(n, None) for n in names}

    def to(size):
        spark.conf.set(names[0], str(size))
        spark.conf.set(names[1], "0")
        spark.conf.set(names[2], "1")

    yield to
    for n, v in old.items():
        spark.conf.set(n, v) if v is not None else spark.conf.unset(n)


def documents(rng, n):
    bits = ["{", "}", '"', "\\", "[", "]", ",", ":", "\n", "é", "法", " ", "a", '"}', '{"id": 1}', "\\\\}", "},{", "\t"]
    text = lambda: "".join(rng.choice(bits) for _ in range(rng.randint(0, 30)))
    return [{"id": i, "text": text() if i % 7 else None, "more": {"a": [text() for _ in range(rng.randint(0, 3))], "b": text()}} for i in range(n)]


@pytest.mark.parametrize("size", [40, 1000])
def test_same_as_one_task(spark, tmp_path, ranges, size):
    """Cuts inside strings, after backslashes, in nested objects: the same rows as Spark's reader of whole files."""
    rng, n = random.Random(size), 5 if size < 1000 else 60
    for k, dump in enumerate((dict(), dict(indent=2), dict(ensure_ascii=False), dict(separators=(",", ":")))):
        (tmp_path / f"{k}.json").write_text(json.dumps(documents(rng, n), **dump), encoding="utf-8")
    (tmp_path / "4.json").write_text("[]")
    (tmp_path / "5.json").write_text(" \n" + json.dumps(documents(rng, 1)[0]))
    (tmp_path / "6.json").write_text("\n".join(map(json.dumps, documents(rng, 9))))
    ranges(size)
    for k in range(6):
        path = f"file://{tmp_path}/{k}.json"
        want = spark.read.schema(SCHEMA).option("multiLine", True).json(path)
        assert sorted(map(repr, read_json_array(spark, path, SCHEMA).collect())) == sorted(map(repr, want.collect())), k
    assert read_json_array(spark, f"file://{tmp_path}", SCHEMA).count() == 4 * n + 1 + 9
    if size < 1000:
        assert len(range_effects(pieces_of(spark, f"file://{tmp_path}/0.json"))) > 8


def test_an_object_over_many_ranges(spark, tmp_path, ranges):
    rows = [{"id": 1, "text": "x"}, {"id": 2, "text": '}"{' * 2000}, {"id": 3, "text": "y"}]
    (tmp_path / "a.json").write_text(json.dumps(rows))
    ranges(256)
    got = {r.id: r.text for r in read_json_array(spark, f"file://{tmp_path}/a.json", SCHEMA).collect()}
    assert got == {r["id"]: r["text"] for r in rows}


def test_unfinished_and_broken_objects(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"id": 1}, {"id": oops}, {"id": 2, "text": "no end')
    assert sorted(r.id or 0 for r in read_json_array(spark, f"file://{tmp_path}/a.json", SCHEMA).collect()) == [0, 1]


def test_effects_compose():
    text = json.dumps(documents(random.Random(4), 30))
    for cut in range(0, len(text), 7):
        if text[:cut].endswith("\\"):
            continue  # pieces end with a brace, never after a backslash
        first, depth = effect(text[:cut], False)
        second, more = effect(text[cut:], first)
        assert (second, depth + more) == (False, 0)


def test_large_file_in_many_tasks(spark, tmp_path):
    n = 60_000
    with open(tmp_path / "a.json", "w") as f:
        f.write("[" + ", ".join(json.dumps({"id": i, "text": f'a "{i}" {{b}} ' * 20}) for i in range(n)) + "]")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    df = read_json_array(spark, f"file://{tmp_path}/a.json", SCHEMA)
    assert df.agg(F.count("*"), F.sum("id")).first() == (n, n * (n - 1) // 2) and object_texts(spark, f"file://{tmp_path}/a.json").rdd.getNumPartitions() > 15
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)
