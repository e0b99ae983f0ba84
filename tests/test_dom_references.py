"""Character references in rewritten blocks."""

import pytest
from oracle import assert_equal

from lexiflow.operators import dom
from lexiflow.queries import core, stored

PAGES = [
    "<title>Die 5 x&amp;&amp</title><p>7 &copy; &quot;a&quot; &lt;b&gt; &amp;lt;",
    "<title>a!! b&quot</title><p>1 &middot; &am</p><p>&a 2</p>",
    "<title>&amp&amp;&amp 12,, &quo</title>",
    "<p>none &amp</p>",
    "",
]


def test_rewritten_pages_equal_sql(spark, tmp_path):
    spark.createDataFrame(list(enumerate(PAGES)), "page_id long, html string").toPandas().to_parquet(f"{tmp_path}/pages.parquet")
    assert_equal(spark, stored.dom_rewritten, core.ORACLES["dom_rewritten"], str(tmp_path))


@pytest.mark.parametrize(
    ("before", "after"),
    [
        ("5 &amp &nbsp;&#38; &", "五 &amp &nbsp;&#38; &amp;"),
        ("&#53; &amp", "五 &amp"),  # what a reference stood for is gone
        ("&amp <b>5</b>&amp; 1 < 2", "&amp 五&amp; 1 &lt; 2<b></b>"),
        ("&not5in; &amp", "&not五in; &amp"),
        ("&NotEqualTilde; 5", "\u2242\u0338 五"),  # two characters
        ("&amp5;", "&amp;;"),  # a kept one would swallow the semicolon
        ("5 & 6 &amp", "五 &amp;  &amp"),
    ],
)
def test_references_that_stay_keep_their_spelling(before, after):
    assert dom.rewrite_text(before, lambda t: t.replace("&5", "&").replace("5", "五").replace("6", "")) == after
