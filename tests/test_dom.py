"""Rewriting HTML in place."""

from lexiflow.operators import dom
from lexiflow.plans import rewrite as rw


def convert(text):
    return text.replace("這不是", "這毋是").replace("a & b", "c < d")


def test_blocks_go_across_inline_markup():
    for before, after in [
        ("<p>這<b>不</b>是</p>", "<p>這毋是<b></b></p>"),
        ("<p>這</p><p>不是</p>", "<p>這</p><p>不是</p>"),
        ("這<br>不是", "這<br>不是"),
        ("<td>這<!-- x --><i> </i>不是", "<td>這毋是<!-- x --><i> </i>"),
        ("<p>a &amp; b</p> &copy;", "<p>c &lt; d</p> &copy;"),
        ("<script>這不是</script><style>這不是</style><textarea>這不是</textarea><!-- 這不是 -->", None),
        ("<div contenteditable=true>這不是<p>這不是</p></div><div contenteditable='false'>這不是</div>", "<div contenteditable=true>這不是<p>這不是</p></div><div contenteditable='false'>這毋是</div>"),
        ("<div contenteditable>這不是<br>x</div>這不是", "<div contenteditable>這不是<br>x</div>這毋是"),
        ("1 < 2 這不是", "1 &lt; 2 這毋是"),
        ("", ""),
        ("<p", None),
    ]:
        assert dom.rewrite_text(before, convert) == (before if after is None else after), before


def test_pages(spark):
    entry = {"entry_id": "a", "src": "不是", "tgt": "毋是", "level": "phrase", "tier": "base", "priority": 0, "context": None, "score": 0.0, "status": "active", "source": "", "trust": "seed", "layer_rank": 5}
    df = spark.createDataFrame([(1, "<p>這 不<b>是</b></p>"), (2, None), (3, "")], "i int, html string")
    got = {r.i: r.html for r in dom.rewrite_html(df, rw.Runtime([entry], [], [], [])).collect()}
    assert got == {1: "<p>這 毋是<b></b></p>", 2: None, 3: ""}
