"""JSON texts opened level by level, against a plain walk."""

import json

from evidlake.operators.plugins import BUCKETS, json_pairs

DOCS = [
    '{"id":1,"meta":{"k":"x y","n":null,"t":true},"items":[{"code":"a"},{"Errors":{"code":"E1","deep":[[{"code":"z","info":{"q":1}}]]}}]}',
    "[]", "{}", "nope", None, "", "7", '[{"a":[]}]', '{"failure":[{"code":"c","success":{"code":"d"}}],"e":"\u00e9\\n"}',
    "[" * 8 + '{"error":{"x":"deep"}}' + "]" * 8,
]


def walk(value, bucket, out):
    if isinstance(value, dict):
        for key, inner in value.items():
            out.append((key, inner if isinstance(inner, str) else json.dumps(inner, separators=(",", ":")), bucket))
            walk(inner, BUCKETS.get(key.lower(), bucket), out)
    elif isinstance(value, list):
        for inner in value:
            walk(inner, bucket, out)
    return out


def test_pairs_equal_a_plain_walk(spark):
    docs = spark.createDataFrame(list(enumerate(DOCS)), "key int, doc string")
    out = json_pairs(docs.withColumnRenamed("key", "item"), "item", "doc")
    want = []
    for i, doc in enumerate(DOCS):
        try:
            want += [(i, *p) for p in walk(json.loads(doc), "status", [])]
        except (TypeError, ValueError):
            continue
    assert sorted(tuple(r) for r in out.collect()) == sorted(want)
    assert "Python" not in out._jdf.queryExecution().toString()
    assert json_pairs(docs.limit(0).withColumnRenamed("key", "item"), "item", "doc").count() == 0
