"""Landed pages processed as a stream (availableNow trigger, memory sink)."""

import os

from sparkeda.operators import web as W
from sparkeda.streaming import start_page_extraction


def test_page_stream(spark, tmpdir_path):
    src = os.path.join(tmpdir_path, "landed")
    pages = spark.createDataFrame([(1, "https://a.example.com/", "<html><h1>Hi</h1><p>x</p></html>"),
                                   (2, "https://a.example.com/2", "<h2>Two</h2>")], "page_id long, url string, html string")
    pages.write.parquet(src)
    q = start_page_extraction(spark, src, None, extractor=W.headings, name="t_stream", trigger_once=True,
                              query_name="heads_stream", sink_format="memory")
    q.awaitTermination(120)
    got = {(r.page_id, r.nivel, r.contenido) for r in spark.sql("SELECT * FROM heads_stream").collect()}
    assert got == {(1, "h1", "Hi"), (2, "h2", "Two")}
