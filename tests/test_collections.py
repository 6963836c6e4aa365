"""Features of documents cut by many tasks equal those of the whole text."""

import json
import random

import pytest
from geobucket.sources import formats
from geobucket.sources.collections import block_states, _records, features_in
from pyspark.sql import functions as F

ODD = [
    {"type": "Feature", "properties": {"a": 'quote " brace } bracket ] comma , back \\', "features": [1, {"x": "}"}]}, "geometry": None},
    {"features": [{"deep": [[["}", "{", '\\"}', "\\\\"]]]}], "é": "漢字😀" * 9}, {}, {"a": {"b": {"c": {}}}}, {"text": "x" * 700}, {"empty": "", "list": [], "n": -1.5e10, "t": True},
]


def documents():
    r = random.Random(4)
    some = lambda n: [r.choice(ODD) | {"i": i} for i in range(n)]
    return {
        "plain": json.dumps({"type": "FeatureCollection", "features": some(40)}), "last": json.dumps({"bbox": [1, 2], "other": {"features": [1, 2]}, "list": [{"a": 1}, [2]], "features": some(30), "more": [{"no": 1}], "end": {"features": [{"x": 1}]}}),
        "pretty": json.dumps({"features": some(25), "type": 'a "features": [ in a string'}, indent=3, ensure_ascii=False) + "\n \n", "none": json.dumps({"features": []}), "spaces": '{"features" :\n [ \n ] }', "absent": json.dumps({"type": "x", "list": [{"a": 1}]}),
        "values": '{"features":[null, 1, "}", [1,{"a":2}], {"b" : 1.50}]}', "one": json.dumps({"features": [{"long": "y{" * 900}]}), "key": json.dumps({'my"features': [{"no": 1}], "features": [{"yes": 1}]}),
    }


@pytest.mark.parametrize("size", [50, 97, 333, 5000, 1 << 20])
def test_any_split(spark, tmp_path, size):
    for name, text in documents().items():
        (tmp_path / f"{name}.geojson").write_text(text, encoding="utf-8")
    whole = spark.read.text(str(tmp_path), wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.explode(formats.features_of(F.col("value"))).alias("feature"))
    want = sorted(((r.file, r.feature) for r in whole.collect()), key=repr)
    conf = {"spark.sql.files.maxPartitionBytes": str(size), "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "1"}
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = sorted(((r.file, r.feature) for r in formats.read_feature_collection(spark, str(tmp_path)).collect()), key=repr)
        blocks = block_states(_records(spark, str(tmp_path)))
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert got == want and len(want) > 90
    assert (len(blocks) > 20) == (size < 1000)


def test_no_document(spark, tmp_path):
    (tmp_path / "a.geojson").write_text("")
    assert features_in(spark, str(tmp_path)).count() == 0
