"""Texts that are read by several fields are parsed once."""

from lodestone.sources import repair, reports


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_texts_are_parsed_once(spark):
    r = reports.read_reports(spark.createDataFrame([("1", "{}")], "report string, value string"))
    assert plan(reports.nodes(r, "report")).count("from_json") == 1  # each field and the filter parsed it again
    assert plan(reports.edges(r, "report")).count("from_json") == 1
    p = repair.parse(spark.createDataFrame([("{}",)], "value string")).where("warning is null")
    assert plan(p).count("from_json(StructField(doc_id") == 1
