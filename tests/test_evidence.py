"""evidence_match against its SQL on passages of every length."""

import duckdb

from tessera import plans

DOCS = [(7, "one two three four"), (3, "two three"), (5, "alone"), (9, "say one  two\tthree"), (1, None), (2, ""), (None, "only here zz")]
ITEMS = [
    (1, "three"), (2, "two three"), (3, ""), (4, "lon"), (5, "ne tw"), (6, "one two thr"), (7, None), (8, "absent"), (9, " "), (10, " two "), (11, "two "), (12, "wo\tthree"),
    (13, "four"), (13, "alone"), (14, "zz"), (None, "two"), (15, "one two three four five"), (16, "two three four"),
]


def test_evidence_of_short_passages(spark, tmp_path):
    con = duckdb.connect()
    for name, rows, schema in (("documents", DOCS, "doc_id long, text string"), ("benchmark", ITEMS, "item_id long, text string")):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
        con.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    want = con.execute(plans.SQL["evidence_match"]).fetchall()
    got = [(r.item_id, r.doc_id) for r in plans.QUERIES["evidence_match"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert {1, 2, 3, 4, 5, 13} <= {i for i, _ in want}
