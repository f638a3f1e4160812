"""Cells of whole pages, against a plain parser."""

import re

from barloom.plans import market


def test_html_tables_of_long_pages(spark, tmp_path):
    pages = [(1, "<p>" + " ".join(f"word{i}" for i in range(150)) + "</p>"), (2, "<b>few</b> words " * 2), (3, "<table><tr><th>own</th></tr></table>" + "x " * 70 + "longestofall")]
    spark.createDataFrame(pages, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    found = {r["page_id"]: r for r in market.QUERIES["src9_html_tables"](spark, str(tmp_path)).collect()}
    for page, html in pages:
        words = re.split(r"\s+", re.sub(r"<[^>]*>", " ", html))
        own = re.findall(r"<t[dh]>([^<]*)", html)
        assert found[page]["cells"] == 2 * len(words) + len(own)
        assert found[page]["longest"] == max(map(len, [*words, *own, "x y"]))
        assert found[page]["tables"] == 1 + html.count("<table>")
