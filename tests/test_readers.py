import json
import random
import re

import pytest
from pyspark.sql import functions as F

from registry.ingest import small_splits
from tessella.errors import NameCollision, TessellaError
from tessella.sources.readers import flatten, infer_json_type, ingest, json_rows, read_csv, read_json, read_json_document
from tessella.sources.split_scan import csv_effect, json_effect
from tessella.sources.store import read_csv_as, write_csv


def test_csv_with_and_without_schema(spark, tmp_path):
    path = write_csv(spark.createDataFrame([(1, "x y"), (2, None)], "`unit no` int, s string"), str(tmp_path / "c"))
    assert ingest(spark, path, "csv", 4).dtypes == [("unitano_4", "int"), ("s_4", "string")]
    assert ingest(spark, path, "csv", 4, "a bigint, b string").dtypes == [("a_4", "bigint"), ("b_4", "string")]


def test_json_lines_and_documents(spark, tmp_path):
    lines, document = tmp_path / "l.json", tmp_path / "d.json"
    lines.write_text('{"a":1,"o":{"p":"x"}}\n{"a":2}\n')
    document.write_text('[{"a":1},\n {"a":2}]')
    assert ingest(spark, str(lines), "json", 1).dtypes == [("a_1", "bigint"), ("oap_1", "string")]
    assert read_json(spark, str(document), document=True).count() == 2


def test_document_in_memory(spark):
    df = read_json_document(spark, '[{"a":1.5,"o":{"p q":"x","n":null}},{"a":2}]')
    assert df.dtypes == [("a", "double"), ("o_n", "string"), ("o_p q", "string")]
    assert df.count() == 2
    assert read_json_document(spark, '{"a": 3}').first().a == 3


def test_json_column_keeps_its_row(spark):
    df = spark.createDataFrame([(1, '{"k": 5}'), (2, "broken"), (3, None)], "id int, j string")
    assert infer_json_type(df, "j") == "STRUCT<k: BIGINT>"
    assert [tuple(r) for r in json_rows(df, "j").orderBy("id").collect()] == [(1, 5), (2, None), (3, None)]


def test_json_that_is_no_object_raises(spark):
    with pytest.raises(TessellaError):
        json_rows(spark.createDataFrame([("1",)], "j string"), "j")
    with pytest.raises(TessellaError):
        ingest(spark, "/nowhere", "xls")


def test_flattening_collisions_raise(spark):
    with pytest.raises(NameCollision):
        flatten(spark.sql("select struct(1 as b) as a, 2 as a_b"))


def test_csv_keeps_every_text(spark, tmp_path):
    texts = [None, "", " a ", "\t", 'say "x"', "a,b", "l1\nl2", "l1\r\nl2", "back\\slash\\", '\\"', "é z", '""', "#c", " \n "]
    df = spark.createDataFrame([(i, t, float(i) if i % 2 else None) for i, t in enumerate(texts)], "k int, t string, x double")
    back = read_csv_as(spark, write_csv(df, str(tmp_path / "csv")), df)
    assert sorted(back.collect()) == sorted(df.collect())
    lines = read_csv(spark, write_csv(df.where("k in (2, 4, 5, 8)"), str(tmp_path / "lines")), df.schema, multiline=False)
    assert sorted(lines.collect()) == sorted(df.where("k in (2, 4, 5, 8)").collect())


def test_json_documents(spark, tmp_path):
    (tmp_path / "a.json").write_text('[\n  {"a b": 1,\n   "c": {"d": "x"}},\n  {"a b": 2, "c": {"d": null}}\n]')
    (tmp_path / "b.json").write_text('{\n "a b": 3,\n "c": {"d": "y"}\n}')
    rows = ingest(spark, str(tmp_path / "*.json"), "json", 1, document=True)
    assert sorted(tuple(r) for r in rows.collect()) == [(1, "x"), (2, None), (3, "y")]
    with pytest.raises(TessellaError):
        ingest(spark, str(tmp_path / "a.json"), "json")
    (tmp_path / "c.json").write_text("no json at all")
    with pytest.raises(TessellaError):
        read_json(spark, str(tmp_path / "c.json"), document=True)


ODD_TEXTS = [
    None, "", " a ", "\t", 'say "x"', "a,b", "l1\nl2", "l1\r\nl2", "back\\slash\\", '\\"', "é z", '""', "#c", " \n ", '"', ',"\n",\n"',
    "x" * 1500 + "\n" + 'y,"' * 300, "\n\n\n", '"\n"', "5\" pipe", "}{][",
]


@pytest.fixture(scope="module")
def odd_table(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(ODD_TEXTS), float(i) if i % 2 else None, rng.choice(ODD_TEXTS)) for i in range(120)]
    return spark.createDataFrame(rows, "k int, t string, x double, `u v` string").coalesce(1)


def test_csv_file_of_several_splits(spark, tmp_path, odd_table):
    """One file with quoted line breaks, also values longer than a split, is read by many tasks."""
    path, want = write_csv(odd_table, str(tmp_path / "csv")), sorted(odd_table.collect(), key=repr)
    for split_bytes in (1500, 6000):
        with small_splits(spark, split_bytes):
            read = read_csv(spark, path, odd_table.schema, split_bytes=split_bytes)
            assert sorted(read.collect(), key=repr) == want
            tasks = read.select(F.spark_partition_id().alias("p")).distinct().count()
            assert tasks > 3
            inferred, whole = read_csv(spark, path, split_bytes=split_bytes), read_csv(spark, path)
            assert inferred.dtypes == whole.dtypes == odd_table.dtypes
            assert sorted(inferred.collect(), key=repr) == sorted(whole.collect(), key=repr)
            assert read_csv(spark, path, "a bigint, b string, c double, d string", split_bytes=split_bytes).columns == list("abcd")


def test_csv_of_other_writers(spark, tmp_path):
    """Windows line ends, stray quotes in values that no quote begins, empty lines, an open quote at the end."""
    folder = tmp_path / "csv"
    folder.mkdir()
    lines = ["k,t", '1,"a\r\nb"', '2,5" pipe', "", '3,x"y"z', '4,"p""q"', "5,", '6,""']
    (folder / "a.csv").write_bytes("\r\n".join(lines * 1).encode() + b"\r\n")
    (folder / "b.csv").write_bytes(b'k,t\n7,plain\n8,"open\nto the end')
    with small_splits(spark, 12):
        rows = read_csv(spark, str(folder), "k int, t string", split_bytes=12).collect()
    found = {r.k: r.t for r in rows}
    assert found == {1: "a\r\nb", 2: '5" pipe', 3: 'x"y"z', 4: 'p"q', 5: None, 6: "", 7: "plain", 8: "open\nto the end"}


def test_folders_with_partition_columns_keep_them(spark, tmp_path, odd_table):
    path = str(tmp_path / "csv")
    odd_table.withColumn("p", F.col("k") % 2).write.partitionBy("p").option("header", True).csv(path)
    assert "p" in read_csv(spark, path, split_bytes=100).columns


def plain_csv(line, quoted):
    """A line, character by character: the quoting behind it."""
    begins, k = not quoted, 0
    while k < len(line):
        if quoted:
            if line[k] == '"' and line[k + 1 : k + 2] == '"':
                k += 1
            elif line[k] == '"':
                quoted = False
        elif begins and line[k] == '"':
            quoted = True
        begins = not quoted and line[k] == ","
        k += 1
    return int(quoted)


def test_effects_of_lines():
    rng = random.Random(4)
    for _ in range(4000):
        line = "".join(rng.choice('"",,a ') for _ in range(rng.randint(0, 12)))
        assert csv_effect(line) == (plain_csv(line, False), plain_csv(line, True)), line
    for _ in range(2000):
        piece = "".join(rng.choice('"{[] a') for _ in range(rng.randint(0, 12))) + rng.choice(["", '\\"x', "\\\\"])
        changes, *opened = json_effect(piece)
        for quoted in (0, 1):
            state, depth = quoted, 0
            for c in re.sub(r"\\.", "", piece) + "}":
                state ^= c == '"'
                depth += 0 if state else {"{": 1, "[": 1, "]": -1, "}": -1}.get(c, 0)
            assert (state != quoted, depth) == (changes, opened[quoted])


def test_json_document_of_several_splits(spark, tmp_path):
    rng = random.Random(5)
    texts = ["x", '}"{', '\\"}', "[", "é\n", "\\", "}" * 40, None, "z" * 900]
    rows = [{"a": i, "s": rng.choice(texts), "o": {"p": [{"q": rng.choice(texts)}, {}]}} for i in range(120)]
    forms = {"min": json.dumps(rows), "indented": json.dumps(rows, indent=2), "objects": "\n".join(json.dumps(r, indent=1) for r in rows)}
    schema = "a bigint, o struct<p: array<struct<q: string>>>, s string"
    for name, text in forms.items():
        (tmp_path / f"{name}.json").write_text(text)
    lines = tmp_path / "lines.txt"
    lines.write_text("\n".join(map(json.dumps, rows)))
    want = sorted(spark.read.schema(schema).json(str(lines)).collect(), key=repr)
    with small_splits(spark, 1200):
        for name in forms:
            path = str(tmp_path / f"{name}.json")
            read = read_json(spark, path, schema, document=True, split_bytes=1200)
            assert sorted(read.collect(), key=repr) == want
            assert read.select(F.spark_partition_id().alias("p")).distinct().count() > 5
        inferred = ingest(spark, str(tmp_path / "min.json"), "json", 1, document=True, split_bytes=1200)
        assert inferred.columns == ["a_1", "oap_1", "s_1"] and inferred.count() == 120


@pytest.mark.parametrize("text", ["no json " * 90, "CUT1", "CUT3", '[{"a":1},' * 90, '{"a": "}' + "x" * 900, '[1, {"a":1}]' + " " * 900])
def test_broken_documents_raise(spark, tmp_path, text):
    whole = json.dumps([{"a": i} for i in range(100)])
    text = {"CUT1": whole[:-1], "CUT3": whole[:-3]}.get(text, text)
    (tmp_path / "x.json").write_text(text)
    with small_splits(spark, 300), pytest.raises(TessellaError):
        read_json(spark, str(tmp_path / "x.json"), document=True, split_bytes=300).collect()
