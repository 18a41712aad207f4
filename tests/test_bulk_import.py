"""Import batches on rows that a catalog seldom has: no text, empty or undecodable texts, no id, no catalog."""

from collections import Counter

import duckdb

import __spark_entry__ as entry

DOCS = [
    (i, {1: "", 2: None, 3: "a�", 4: "é" * 6000, 5: "é" * 6000 + "x"}.get(i % 9, f"text {i}"), "en", None if i % 4 == 0 else "s") for i in range(90)
] + [(None, "no id", "en", "s")]
LABELS = [(i, 1, None if i % 5 == 0 else i % 2) for i in range(0, 90, 3)] + [(3, 1, 1), (None, 1, 1)]


def test_import_takes_odd_rows_as_its_sql_does(spark, tmp_path):
    docs = spark.createDataFrame(DOCS, "doc_id bigint, text string, lang string, source string").selectExpr("*", "cast(length(text) as bigint) as n_chars")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(LABELS, "doc_id bigint, quality int, toxic int").coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    cur = con.execute(entry.oracle_sql()["src7_bulk_import"])
    names = [d[0] for d in cur.description]
    got = entry.queries()["src7_bulk_import"](spark, str(tmp_path)).select(*names).collect()
    assert Counter(map(tuple, got)) == Counter(cur.fetchall())
    assert sum(r["files"] for r in got) == 92 and sum(r["imported"] + r["rejected"] for r in got) == 82
