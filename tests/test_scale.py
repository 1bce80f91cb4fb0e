"""Work that must stay spread over tasks."""

from mise.sources import fixtures as FX


def _nodes(plan):
    yield plan
    children = plan.children()
    for i in range(children.size()):
        yield from _nodes(children.apply(i))


def _plan(df):
    return list(_nodes(df._jdf.queryExecution().optimizedPlan()))


def _part(spark, folder, n=40):
    rows = [(i, f"part {i}", f"Brand#{i % 5}", f"TYPE {i % 3}", i % 50 + 1) for i in range(n)]
    spark.createDataFrame(rows, "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int") \
        .coalesce(1).write.parquet(f"{folder}/part.parquet")


def test_pages_of_a_table_in_one_split_are_made_in_many_tasks(spark, tmp_path):
    _part(spark, tmp_path)
    spark.createDataFrame([(i, f"line {i}\nsecond") for i in range(40)], "doc_id bigint, text string") \
        .coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    for build in (FX.build_ldjson_pages, FX.build_chain_pages, FX.build_site_pages):
        pages = build(spark, str(tmp_path))
        assert pages.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
        # What is dealt out are the table's rows, not the pages.
        dealt = [n for n in _plan(pages) if n.nodeName() == "Repartition"]
        assert len(dealt) == 1 and "html" not in [a.name() for a in _attributes(dealt[0])]


def _attributes(node):
    out = node.output()
    return [out.apply(i) for i in range(out.size())]


def test_all_rows_become_pages(spark, tmp_path):
    _part(spark, tmp_path)
    assert sorted(r.page_id for r in FX.build_ldjson_pages(spark, str(tmp_path)).collect()) == list(range(40))


def test_page_texts_are_quoted_without_a_search_from_every_character(spark):
    import json

    from pyspark.sql import functions as F

    texts = ["", "plain", "[x]", "a & b", "<b>&amp;</b>", 'say "hi"\\', "]", "[", "né\n日", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", FX.jq(F.col("t")).alias("j"), FX.html_escape(F.col("t")).alias("h"))
    assert "regexp" not in df._jdf.queryExecution().optimizedPlan().toString()
    for r in df.collect():
        t = texts[r.i]
        assert r.j == json.dumps(t, ensure_ascii=False)
        assert r.h == (None if t is None else t.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;"))
    escaped = df.select("h")._jdf.queryExecution().optimizedPlan().toString()
    assert escaped.count("Contains") == 3 or escaped.lower().count("contains(") == 3
