"""Page queries read whole pages, not their first characters."""

from millrace.plans import registry


def test_payloads_are_found_in_whole_pages(spark, tmp_path):
    own = "<p>" + "x" * 60 + '</p><script>self.__next_f.push([1,"inside "])</script><script type="application/ld+json">{"b":1}</script>'
    spark.createDataFrame([(2, "http://a/", own)], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    assert "inside " in registry.queries()["s19_payloads"](spark, str(tmp_path)).first().payload
    assert registry.queries()["s20_json_ld"](spark, str(tmp_path)).first().found == ['{"b":1}', '{"a":2}']
