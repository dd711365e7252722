import json
import tempfile

from edge_rows import base_tables

from issuegrid.sources import tables as io


def test_json_export_keeps_nulls(spark):
    t = base_tables(spark)
    docs = io.to_json_documents(t["issue"].filter("issue_id = 2")).first().document
    assert json.loads(docs)["sprint_id"] is None and "assignee_id" in json.loads(docs)
    out = tempfile.mkdtemp(prefix="json-", dir="/tmp") + "/issues"
    io.export_json(t["issue"], out)
    back = spark.read.schema(t["issue"].schema).json(out)
    assert back.count() == 4 and back.filter("sprint_id IS NULL").count() == 2


def test_round_trip_with_fixed_schema(spark):
    t = base_tables(spark)
    root = tempfile.mkdtemp(prefix="tables-", dir="/tmp")
    io.save_tables(t, root)
    loaded = io.load(spark, root)
    for name, df in t.items():
        assert [(f.name, f.dataType) for f in loaded[name].schema] == [(f.name, f.dataType) for f in df.schema]
        assert loaded[name].exceptAll(df).count() == 0 and df.exceptAll(loaded[name]).count() == 0
