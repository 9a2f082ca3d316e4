"""Text that a browser shows is there: drawings, formulas, fallbacks, visibility set anew, heads left open."""

import pytest

from hazemeter.llm.html_text import visible_text


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("a <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>no</annotation></math> b", "a x=1 b"),
        ("<svg><title>no</title><defs><text>no</text></defs><path d='M0'/><desc/><text>one</text><text>two</text></svg>end", "one\ntwo\nend"),
        ("<svg><style/><text>one</text></svg><desc>yes</desc>", "one\nyes"),
        ("<svg><defs><p>yes</p></svg>", "yes"),
        ("<object data=x>instead</object>", "instead"),
        ("<div style='visibility:hidden'>no<img alt=no><span style='visibility: visible'>yes</span>no</div>", "yes"),
        ("<ul style='visibility:hidden'><li>no<li style='visibility:visible'>yes</ul>", "- yes"),
        ("<div style='display:none'>no<b style='visibility:visible'>no</b></div>x", "x"),
        ("<head><title>T</title>Hello<br>world", "Hello\nworld"),
        ("<head><title>T</title> <meta name=x><link href=x><img alt=pic>tail", "pic tail"),
        ("<head><template><div>no</div></template></head>x", "x"),
    ],
)
def test_shown(html, text):
    assert visible_text(html) == text


def test_wide_cells_are_aligned():
    wide = " ".join(["word"] * 12)
    assert visible_text(f"<table><tr><td>{wide}<td>1<tr><td>a<td>2</table>") == f"{wide}  1\n{'a':59}  2"
    longer = " ".join(["word"] * 30)
    lines = visible_text(f"<table><tr><td>{longer}<td>1<tr><td>a<td>2</table>").split("\n")
    assert all(len(x) <= 83 for x in lines)
    assert lines[0].index("1") == lines[-1].index("2") and " ".join(lines).split().count("word") == 30
    assert visible_text(f"<table><tr><td>{longer}</table>") == longer


def test_cells_that_span_rows():
    assert visible_text("<table><tr><td rowspan=2>A<td>b<tr><td>c<tr><td>d<td>e</table>") == "A  b\n   c\nd  e"
    assert visible_text("<table><tr><td rowspan=0 colspan=2>A<td>b<tr><td>c<tr><td>d</table>") == "A    b\n     c\n     d"


def test_deep_boxes_keep_marks():
    assert visible_text("<ul><li>" * 20 + "x") == "- " * 20 + "x"
    assert visible_text("<blockquote>" * 20 + "<table><tr><td>aa<td>b<tr><td>c<td>d").split("\n") == ["> " * 20 + "aa  b", "  " * 20 + "c   d"]
