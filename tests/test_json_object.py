"""JSON objects cut in parallel against a plain parser."""

import json
import random

import pytest

from warnloom.sources.files import load_cvss_dimension


def record(rng):
    text = "".join(rng.choice(['{', '}', '"', '\\', 'a', ' ', ',', ':', '[', ']', 'é', '\n', '\\"']) for _ in range(rng.randint(0, 12)))
    return {"score": rng.randint(0, 100) / 10, "severity": text, "vector": rng.choice([None, "V:1/{x}"]), "version": "v31", "more": [{"a": [1, {"b": text}]}]}


def objects():
    rng = random.Random(7)
    whole = [{f"CVE-{i}-{k}": rng.choice([record(rng), record(rng), None]) for k in range(n)} for i, n in enumerate([0, 1, 2, 9, 40])]
    files = []
    for i, thing in enumerate(whole):
        files += [json.dumps(thing), json.dumps(thing, indent=2, ensure_ascii=False) + "\n", " " + json.dumps({f"x{i}" + k: v for k, v in thing.items()}, indent=1)]
    one = json.dumps(whole[3])
    files += ["", "   ", "not json", "{} x", one[:-1], one[:-2], one[: len(one) // 2], one + "}", one + " y", one.replace(", ", " ", 1), "[" + one + "]", '"' + "a" * 300, "null", "{" + one, one.replace('"score"', "score", 1)]
    return files


@pytest.mark.parametrize("block", [64, 1 << 20])
def test_entries_equal_a_plain_parser(spark, tmp_path, block):
    want = []
    for i, text in enumerate(objects()):
        folder = tmp_path / f"f{i}"
        folder.mkdir()
        (folder / "cvss.json").write_text(text, encoding="utf-8")
        try:
            parsed = json.loads(text)
        except ValueError:
            parsed = None
        for key, r in (parsed if isinstance(parsed, dict) else {}).items():
            r = r or {}
            want.append((key, r.get("score"), r.get("severity"), r.get("vector"), r.get("version")))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(block))
    try:
        got = [tuple(r) for r in load_cvss_dimension(spark, str(tmp_path)).collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(got, key=repr) == sorted(want, key=repr) and len(want) > 100


def test_one_line_is_read_by_many_tasks(spark, tmp_path):
    whole = {f"CVE-2024-{i}": {"score": 5.0, "severity": "MEDIUM", "vector": "x" * 400, "version": "v31"} for i in range(4000)}
    (tmp_path / "cvss.json").write_text(json.dumps(whole))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
    try:
        read = spark.read.option("lineSep", "}").text(str(tmp_path))
        assert read.rdd.getNumPartitions() >= 8
        assert load_cvss_dimension(spark, str(tmp_path / "cvss.json")).count() == 4000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_missing_file(spark, tmp_path):
    assert load_cvss_dimension(spark, str(tmp_path / "none.json")).count() == 0
