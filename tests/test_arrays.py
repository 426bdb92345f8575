"""JSON arrays read in parts against the whole, cut at every byte."""

import json
import random

import numpy as np
import pytest

from docketspark.sources import arrays, cases

ODD = [{"a": 'quo"te } ] { [', "b": [{"c": "1"}, {"c": "\\"}]}, {"a": "\\\\", "b": []}, {"a": "é中 \\u00e9 \\\" }", "b": [{"c": "}{"}]}, {}, {"a": "x" * 3000, "b": None}]
SCHEMA = "a string, b array<struct<c:string>>"


def random_records(rng, n):
    piece = lambda: "".join(rng.choice('ab"\\{}[]:, \n\té中') for _ in range(rng.randint(0, 12)))
    return [{"a": piece(), "b": [{"c": piece()} for _ in range(rng.randint(0, 3))]} for _ in range(n)]


def slow_state(data):
    """(kind of place, depth) by a walk over the bytes."""
    kind, depth = arrays.OUTSIDE, 0
    for c in data:
        if kind == arrays.ESCAPED:
            kind = arrays.INSIDE
        elif kind == arrays.INSIDE:
            kind = arrays.ESCAPED if c == 92 else arrays.OUTSIDE if c == 34 else kind
        elif c == 34:
            kind = arrays.INSIDE
        else:
            depth += (c in b"{[") - (c in b"}]")
    return kind, depth


def test_effects_compose_at_every_cut():
    data = json.dumps(ODD[:4], ensure_ascii=False, indent=1).encode()
    whole = arrays.effect_of(np.frombuffer(data, np.uint8))
    assert (whole.ends[0], whole.deeper[0]) == slow_state(data) == (arrays.OUTSIDE, 0)
    for i in range(len(data) + 1):
        a, b = (arrays.effect_of(np.frombuffer(x, np.uint8)) for x in (data[:i], data[i:]))
        both = a.then(b)
        assert (both.ends[0], both.deeper[0], both.size) == (whole.ends[0], whole.deeper[0], whole.size)
        assert (a.ends[0], a.deeper[0]) == slow_state(data[:i])


def read(spark, path, split, **options):
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        df = cases.read_json(spark, path, SCHEMA, **options)
        return sorted((str(r) for r in df.collect())), df.rdd.getNumPartitions()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("indent,split", [(None, "40"), (None, "64k"), (2, "97"), (2, "333")])
def test_arrays_equal_lines(spark, tmp_path, indent, split):
    records = ODD + random_records(random.Random(indent), 60)
    (tmp_path / "a.json").write_text(json.dumps(records, ensure_ascii=False, indent=indent))
    (tmp_path / "l.json").write_text("\n".join(json.dumps(r) for r in records))
    found, _ = read(spark, str(tmp_path / "a.json"), split)
    assert found == sorted(str(r) for r in spark.read.schema(SCHEMA).json(str(tmp_path / "l.json")).collect())


def test_splits_are_read_by_several_tasks(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(random_records(random.Random(1), 2000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        rows = arrays.pieces(spark, str(tmp_path / "a.json"))
        assert rows.rdd.getNumPartitions() > 8
        known = arrays.entries(arrays.effects(rows))
        data = (tmp_path / "a.json").read_bytes()
        assert len(known) > 8
        for kind, depth, offset, _ in known.values():
            assert (kind, depth) == slow_state(data[:offset])
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_several_files_empty_arrays_and_marks(spark, tmp_path):
    for name, text in {"a": '﻿ [ {"a":"1"} ,\n{"a":"2"}]\n ', "b": "[]", "c": '[{"a":"3"}]', "d": " [ ] ", "e": ""}.items():
        (tmp_path / f"{name}.json").write_text(text, encoding="utf-8")
    assert sorted(r.a for r in arrays.read_array(spark, str(tmp_path), SCHEMA).collect()) == ["1", "2", "3"]


@pytest.mark.parametrize("text,at", [('[{"a":"1"},{"a":"2"}', 20), ('[{"a":"1"} {"a":"2"}]', 10), ('[{"a":"1"},]', 11), ('[{"a":"1"}] x', 10), ('[{"a":"1"},{"a":"2"},3]', 21), ('[{"a":"1"},{"a":2 2}]', 11), ('[{"a":"1', 0)])
def test_broken_input_is_named_with_its_byte(spark, tmp_path, text, at):
    (tmp_path / "a.json").write_text(text)
    with pytest.raises(Exception, match=rf"a\.json.* byte {at}"):
        arrays.read_array(spark, str(tmp_path / "a.json"), SCHEMA).collect()
    assert len(arrays.read_array(spark, str(tmp_path / "a.json"), SCHEMA, strict=False).collect()) <= 2


def test_few_bytes_at_once(spark, tmp_path, monkeypatch):
    """Whatever a batch of rows holds, a pass looks at CHUNK bytes at once, and records that lie across are whole."""
    import pyarrow as pa

    rows = [(f"{{{i}" + "x" * (i % 50), "f", 0) for i in range(2000)] + [("y" * (3 * arrays.CHUNK), "f", 0)]
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array(["f"] * len(rows)), pa.array([0] * len(rows))], ["value", "path", "start"])
    (key, parts), *rest = ((k, [bytes(d) for d in ds]) for k, ds in arrays.stretches(iter([batch])))
    assert key == ("f", 0) and not rest and max(map(len, parts)) <= arrays.CHUNK and len(parts) > 3
    assert b"".join(parts).decode() == "".join(r[0] + "}" for r in rows)
    monkeypatch.setattr(arrays, "CHUNK", 5)
    place = tmp_path / "a.json"
    place.write_text(json.dumps(ODD, ensure_ascii=False))
    parts = [x for b in arrays.parted(iter([batch.slice(0, 30)]), 0) for x in b.column(0).to_pylist()]
    assert parts == [r[0] for r in rows[:30]]
    bytes_ = [np.frombuffer(place.read_bytes()[i : i + 5], np.uint8) for i in range(0, place.stat().st_size, 5)]
    total = arrays.NOTHING
    for b in bytes_:
        total = total.then(arrays.effect_of(b))
    assert (total.ends[0], total.deeper[0], total.size) == (arrays.OUTSIDE, 0, place.stat().st_size)
