import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from palisade.llm.html_text import extracted, rendered

CASES = [
    ("<p>One<p>Two", "One\n\nTwo"),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "- a\n- b\n  - c\n- d"),
    ("<ol start=3><li>x</li><li>y</ol>", "3. x\n4. y"),
    ("a<br>b<br><br>c", "a\nb\n\nc"),
    ("<div>a</div><div>b</div>", "a\nb"),
    ("<table><tr><th>Name<th>Age<tr><td>Anna<td>7<tr><td>Bo<td>12</table>", "Name  Age\nAnna  7\nBo    12"),
    ("<table><tr><td colspan=2>wide cell<tr><td>a<td>b</table>", "wide cell\na  b"),
    ("<script>var x='<p>no</p>';</script><style>p{}</style><p>yes", "yes"),
    ("<p hidden>no</p><p style='display: none'>no</p><div style=\"visibility:hidden\"><p>no</div>yes", "yes"),
    ("<head><title>t</title></head><body>yes", "yes"),
    ("<pre>  a\n    b\n</pre>", "  a\n    b"),
    ("<b>bold</b> and <i>more</i>text", "bold and moretext"),
    ("&lt;tag&gt; &amp; &eacute;&#65;", "<tag> & éA"),
    ("<!-- gone -->x<!-- open", "x"),
    ("<template><p>no</template><noscript>no</noscript>yes", "yes"),
    ("<dl><dt>t<dd>d1<dd>d2</dl>", "t\n    d1\n    d2"),
    ("1 < 2 and <", "1 < 2 and <"),
    ("</div></p>x</b>", "x"),
    ("<h1>T</h1>text", "T\n\ntext"),
    ("<a href='x'>link</a>, then", "link, then"),
    ("<select><option>one<option>two</select>yes", "one yes"),
    ("", ""),
    ("   \n ", ""),
    (None, None),
]


@pytest.mark.parametrize("page, text", CASES)
def test_rendering(page, text):
    assert rendered(page) == text


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div>", "</div>", "<ul>", "<li>", "</ul>", "<table>", "<tr>", "<td>", "</table>", "<b>", "</b>", "word", " ", "<pre>", "</pre>", "<br>", "<script>", "</script>", "&amp;", "<", "<p hidden>", "<span"]), max_size=30))
def test_any_markup_renders(parts):
    out = rendered("".join(parts))
    assert isinstance(out, str)
    if not any(p in ("<script>", "<p hidden>", "<span", "<") for p in parts):
        assert out.count("word") == parts.count("word")


def test_deep_and_long_pages():
    assert rendered("<div>" * 5000 + "x" + "</div>" * 5000) == "x"
    assert rendered("<ul><li>" * 300 + "x").endswith("x")
    assert len(rendered("<p>word " * 50_000).split()) == 50_000


def test_pages_table(spark):
    pages = spark.createDataFrame([(1, "u", "<p>a", "old"), (2, None, None, "old"), (2, None, None, "old"), (None, "u", "", None)], ["page_id", "a.b", "html", "text"])
    out = extracted(pages)
    assert out.columns == ["page_id", "a.b", "text"]
    assert sorted(((r[0], r[2]) for r in out.collect()), key=repr) == [(1, "a"), (2, None), (2, None), (None, "")]
    assert extracted(pages.where("false")).count() == 0


@pytest.mark.parametrize(
    "page, text",
    [
        ("<html><head><title>t</title><body><p>Text</body></html>", "Text"),
        ("<p hidden>a<p>b", "b"),
        ("<ul><li hidden>a<li>b</ul>c", "- b\n\nc"),
        ("<table><tr hidden><td>a<tr><td>b</table>", "b"),
        ("<div hidden><p>a<p>b<div>c</div></div>d", "d"),
        ("<ul hidden><li>a<li>b</ul>c", "c"),
        ("<template><p>a<p>b</template>c", "c"),
        ("<div class=\"nav hidden md:block\">a</div><p title='the hidden beach'>b", "a\n\nb"),
        ("<p title='display:none'>a<p aria-hidden=true>b", "a\n\nb"),
        ("<p data-hidden>a<p HIDDEN=''>b<p style='color:red; DISPLAY : none!important'>c", "a"),
        ("<p style=display:none>a</p>b", "b"),
        ("<p>a<template><div>x<p>y</div></template>b", "ab"),
        ("<p>a<noscript><p>x</noscript><svg><desc>x</desc></svg>b", "ab"),
        ("<p>a<canvas><p>x</canvas>b", "ab"),
        ("<head><title>t</title><meta charset=utf-8>\n<p>a", "a"),
        ("<head><title>t</title>a", "a"),
    ],
)
def test_hidden_elements_end_where_they_should(page, text):
    assert rendered(page) == text


@pytest.mark.parametrize(
    "page,text",
    [
        ('<p class="box hidden big">a', "a"),
        ('<div title="the hidden gem">b', "b"),
        ('<p aria-hidden="true">e', "e"),
        ("<svg><title>no</title><text>drawn</text></svg> <math><mi>x</mi></math>", "drawn x"),
        ("<select><option>one<option selected>two</select>", "two"),
        ("<select multiple><option>one<option>two</select>", "one two"),
        ('<div style="visibility:hidden">no<b style="visibility:visible">yes</b>no</div>', "yes"),
        ('<div style="display:none">no<b style="visibility:visible">no</b></div>yes', "yes"),
        ("<table><tr><td rowspan=2>A<td>B<tr><td>C</table>", "A  B\n   C"),
        ("<table><tr><td>a<td rowspan=0>b<td>c<tr><td>dd<td>e<tr><td>f</table>", "a   b  c\ndd     e\nf"),
        ("<ol><li>x<li value=7>y<li>z</ol>", "1. x\n7. y\n8. z"),
        ("a <b x='1>2'>c</b> < d <e", "a c < d <e"),
        ("<p>" + "<div>" * 300 + "x" + "</div>" * 300 + "y", "x\ny"),
        ("<div hidden>" + "<div>" * 300 + "x" + "</div>" * 300 + "</div>y", "y"),
    ],
)
def test_visible_text_of_all_kinds(page, text):
    assert rendered(page) == text


@pytest.mark.parametrize("form", ["<a ", "<!", '<a "', "<a<a", "<a x='", "</p", "<div hidden><b>", "<div hidden><li>", "<div>", "<table><tr><td rowspan=9>x<td>y", "<svg><p>", "<b></i>"])
def test_broken_markup_takes_linear_time(form):
    import time

    def seconds(n):
        began = time.process_time()
        rendered(form * n + "'\">")
        return time.process_time() - began

    seconds(100)
    assert seconds(16_000) < 0.2 + 20 * seconds(2_000)


def test_all_plain_words_of_random_markup_are_kept():
    import random

    rnd, tags = random.Random(4), "p div b i span ul li table tr td th ol h1 section a em dl dt dd pre svg".split()
    for _ in range(300):
        words, page, held = [], [], []
        for k in range(rnd.randrange(1, 60)):
            x = rnd.random()
            if x < 0.4:
                words.append(f"w{k}")
                page.append(f" w{k} ")
            elif x < 0.75 or not held:
                held.append(rnd.choice(tags))
                page.append(f"<{held[-1]} class='hidden x{k}'>")
            else:
                page.append(f"</{held.pop()}>")
        assert sorted(w for w in rendered("".join(page)).split() if w.startswith("w")) == sorted(words)
