import time

import pytest

from basketry.llm.html_text import extract, render

CASES = {
    "One <b>two</b>\n three<p>Four<br>five": "One two three\n\nFour\nfive",
    "<h1>A &amp; B</h1><p>x<p>y</p>z": "A & B\n\nx\n\ny\n\nz",
    "<ul><li>a<li>b<ul><li>c</ul><li>d</ul>": "- a\n- b\n  - c\n- d",
    "<ol start=3><li>x<li value=9>y<li>z</ol>": "3. x\n9. y\n10. z",
    "<ol reversed><li>x<li>y</ol>": "2. x\n1. y",
    "<table><tr><th>Name<th>Qty<tr><td>apple<td>1<tr><td>fig<td>22</table>": "Name   Qty\napple  1\nfig    22",
    "<table>stray<td>a<td>b<tr><td rowspan=2>c<td>d<tr><td>e</table>": "stray\n\na  b\nc  d\n   e",
    "<table><tr><td colspan=2>wide cell<td>x<tr><td>1<td>2<td>3</table>": "wide cell  x\n1  2       3",
    "<table><tr><td>" + "w" * 61 + "<td>x<tr><td>1<td>2</table>": "w" * 61 + "  x\n1" + " " * 62 + "2",
    "<table><tr><td>a<td>b<td>c<tr><td colspan=3>t</table>": "a  b  c\nt",
    "<table><tr><td colspan=2>title<tr><td>aa<td>b<td>c<tr><td><td colspan=2>long cell</table>": "title\naa  b  c\n    long cell",
    "<table><tr><td>" + "w" * 5000 + "<td>x" + "<tr><td>1<td>2" * 500 + "</table>": "w" * 5000 + "\n   x" + "\n1  2" * 500,
    "<pre>\n a  b\n  c</pre>d": " a  b\n  c\n\nd",
    "a<script>if (1 < 2) { '</p>' }</script>b<style>p{}</style><template>t</template>c": "abc",
    "<title>t</title><p hidden>h</p><p style='DISPLAY : none'>i</p>k": "k",
    "<span style='visibility:hidden'>a<b style='visibility:visible'>b</b></span>c": "bc",
    "<style>.x,.y p{display:none} @media print{.z{display:none}} #i{visibility:hidden}</style><p class='a x'>1<p class=z>2<p id=i>3<div>4</div>": "2\n\n4",
    "<details><summary>S</summary>no</details><details open><summary>T</summary>yes</details><dialog>no</dialog>": "S\nT\nyes",
    "<dl><dt>t<dd>d<dt>u</dl>": "t\n  d\nu",
    "a<!-- b --><!-->c<!doctype x>d<?e?>f</ g>h": "acdfh",
    "a < b <3 &lt;c&gt; &copy; &#x41;": "a < b <3 <c> © A",
    "<select><option>a<option>b</select>": "a\nb",
    "<p>x</i></div>y</p></p>z": "xy\n\nz",
    "": "",
    "<a href='x>y' b=\"q\">t</a": "t",
}


@pytest.mark.parametrize("page", list(CASES))
def test_layout(page):
    assert render(page) == CASES[page]


#: Pages whose text is seen though a head is left open or a rule hides some of it.
SEEN = {
    "<html><head><title>T</title><body><p>text": "text",
    "<html><head>\n<meta charset=x><link><style>p{}</style>\n<p>a<p>b": "a\n\nb",
    "<head><title>T</title>plain <b>text</b>": "plain text",
    "<head><noscript><link><style>i{}</style></noscript><script>x</script></head><body>a": "a",
    "<head><noscript><p>a</p></noscript>b": "a\n\nb",
    "<head><template>t<i>u</i></template><title>v</title></br>w": "w",
    "<style>.p{display:none} .p.on{display:block}</style><p class=p>a<p class='on p'>b": "b",
    "<style>.p.on{display:block} .p{display:none}</style><p class=p>a<p class='p on'>b": "b",
    "<style>.p{display:none}</style><style>.p{display:flex}</style><p class=p>a": "a",
    "<style>.p{display:flex} .q{display:none}</style><p class='p q'>a<p>b": "b",
    "<style>.p{display:none} #i{display:block} p{display:none}</style><p id=i class=p>a<p>b": "a",
    "<style>.p{display:none}</style><p class=p style='display:block'>a<p class=p style='color:red'>b": "a",
    "<style>.p{display:none !important}</style><p class=p style='display:block'>a<p style='display:none; display:block'>b": "b",
    "<style>.p{visibility:hidden} .p.on{visibility:visible}</style><p class=p>a<b class='p on'>b</b>c": "b",
    "<style>.p{display:none;display:nonsense}</style><p class=p>a<p hidden style='display:block'>b<p hidden>c": "b",
    "<style>.p{display:none}</style><p class=p style='display:revert'>a<div class=p><p style='display:block'>b</div>": "a",
}

#: Pages with selectors of several compounds.
SEEN |= {
    "<style>div > p{display:none}</style><div><p>a<section><p>b</section></div><p>c": "b\n\nc",
    "<style>.m li a{display:none}</style><ul class=m><li>x <a>y</a><ul><li><b><a>z</a></b>w</ul></ul><a>v</a>": "- x\n  - w\n\nv",
    "<style>.m>.n .o{display:none} .o{display:block}</style><div class=m><i class=n><b class=o>a</b></i><b class=o>b</b></div>": "b",
    "<style>.m .n > .o{visibility:hidden}</style><div class=m><div class=n><div class=n><p class=o>a</p><i><p class=o>b</div></div></div>": "b",
    "<style>#i *{display:none}</style><div id=i>a<b>b</b></div>c": "a\nc",
    "<style>body .h{display:none} body > .k{display:none}</style><p class=h>a<div><p class=k>b</div><p class=k>c": "b",
    "<style>p + p{display:none} p[x]{display:none} p:first-child{display:none} > p{display:none} p >{display:none}</style><p x>a<p>b": "a\n\nb",
}


@pytest.mark.parametrize("page", list(SEEN))
def test_seen_text_is_kept(page):
    assert render(page) == SEEN[page]


@pytest.mark.parametrize("page", [
    "<" * 200_000, "<div>" * 60_000 + "x" + "</div>" * 60_000, "<!--" * 80_000, '<a b="' * 80_000, "&" * 200_000, "<ul><li>" * 20_000 + "y",
    "<table><tr><td>" * 5_000 + "z", "<p>" * 80_000, "<style>" + "a{" * 80_000, "<style>" + "@m{" * 30_000, "<style>" + "a a " * 300 + "b{display:none}</style>" + "<a>" * 200 + "<b>x</b>" * 2_000,
    "<style>" + ".a .b{display:none}" * 2_000 + "</style>" + "<div>" * 200 + "<p class=b>x" * 500, "<a " + "x" * 200_000 + ">k",
    "<a " + "= " * 80_000 + ">k", "word " * 200_000, "<table>" + "<tr><td>" + "c" * 100_000 + "<td>d" + "<tr><td>a<td>b" * 5_000])
def test_hostile_pages_take_one_pass(page):
    began = time.time()
    text = render(page)
    assert time.time() - began < 20
    assert len(text) < 3 * len(page) + 10


def test_deep_pages_keep_their_text():
    text = render("<div>" * 1000 + "".join(f"w{i}</div>" for i in range(1000)))
    assert "".join(text.split()) == "".join(f"w{i}" for i in range(1000))


def test_operator(spark):
    pages = spark.createDataFrame([(1, None, "u", 3), (2, "", "u", 3), (2, "<p>é", "u", 3), (2, "<p>é", "u", 3), (None, "x", "u", 3)], "page_id long, html string, text string, id int")
    assert sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in extract(pages).collect()) == [(0, "x", 1), (1, "", 0), (2, "", 0), (2, "é", 1), (2, "é", 1)]
    assert extract(pages.limit(0)).count() == 0
