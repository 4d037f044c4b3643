import html as entities
import random
import tracemalloc
from html.parser import HTMLParser

import pyarrow.parquet as pq
import pytest

from encore.llm.html_text import extract_text, render

SF_DIR = "/root/testdata/sf0.001"

CASES = {
    "<title>t</title><p>one<p>two": "one\n\ntwo",
    "a <b>b</b>c\n d": "a bc d",
    "<ul><li>a<li>b<ol start=3><li>c<li>d</ol></ul>x": "- a\n- b\n  3. c\n  4. d\n\nx",
    "<table><tr><td>x<td>yyyy<tr><td>longer<td>z</table>": "x      | yyyy\nlonger | z",
    "<table><td>a<td>b<tr><th>c</table>": "a | b\nc",
    "<pre>a  b\n  c</pre>": "a  b\n  c",
    "<div hidden>no</div><p style='display : none'>no</p><span aria-hidden=true>yes</span>": "yes",
    "<script>if (a < b) '</p>'</script><style>p{}</style>t<!-- c <p> --><noscript>n</noscript>": "t",
    "&lt;a&gt; &amp; &copy; &#65;": "<a> & © A",
    "x<br>y<br><br>z": "x\ny\n\nz",
    "<dl><dt>t<dd>d</dl>": "t\n  d",
    "a<hr>b": "a\n\nb",
    "</div></p>x</i>": "x",
    "<p>open <a href=\"x>y": "open",
    "<img alt='pic'> <input type=hidden value=v> c": "pic c",
    "1 < 2 and 3 > 2": "1 < 2 and 3 > 2",
    "<details>x<summary>s</summary>y<p>z<summary>t</summary></details>w": "s\nw",
    "<details open><summary>s</summary>y</details>w": "s\ny\nw",
    "<style>.no, #gone {display:none} p.x{visibility:hidden}</style><b class='a no'>1</b>"
    "<b id=gone>2</b><p class=x>3<b style='visibility:visible'>4</b></p><b class=x>5</b>": "4\n\n5",
    "<style>/* .a{display:none} */ .b{display:none} .b{display:block}</style><i class=a>1</i><i class=b>2": "12",
    "<style>.a{display:none!important}</style><i class=a style='display:block'>1</i>2": "2",
    "<style>@media print{b{display:none}} @media screen{i{display:none}}</style><b>1</b><i>2</i>": "1",
    "<style>div b{display:none} b:hover{display:none}</style><div><b>1</b></div>": "1",
    "<style media=print>b{display:none}</style><!--<style>b{display:none}</style>--><b>1</b>": "1",
    "<style>[hidden]{} .s{display:block}</style><b hidden class=s>1</b><b hidden>2</b>": "1",
    "<div style='visibility:hidden'>a<b style='visibility:visible'>b</b></div>": "b",
    "<div style='display:none'>a<b style='display:block'>b</b></div>": "",
    "<math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>no</annotation></math>": "x=1",
    "<svg><title>no</title><defs><text>no</text></defs><g>no<text>a</text></g><text>b</text></svg>": "a b",
    "pick <select><option>a<option selected>b<option>c</select> end": "pick b end",
    "<select><option>a<option>b</select>": "a",
    "<select multiple><option>a<option>b</select>": "a b",
    "<textarea>\none\n  two</textarea>": "one\n  two",
    "<input value=v><input type=checkbox value=w> <input type=submit value='Go on'>": "v Go on",
    "<ol><li>a<li value=5>b<li>c</ol>": "1. a\n5. b\n6. c",
    "<table><tr><td colspan=2>ab<td>c<tr><td>longer<td>d<td>e</table>": "ab         | c\nlonger | d | e",
    "<table><tr><td rowspan=2>x<td>a<tr><td>b<tr><td>c<td>d</table>": "x | a\n  | b\nc | d",
    "<table><tr><td colspan=2>long heading<td>z<tr><td>a<td>b<td>c</table>": "long heading | z\na | b        | c",
    "<table><tr><td>a<table><tr><td>x<td>y<tr><td>longer<td>z</table><td>b</table>":
        "a x | y longer | z | b",
    "plain": "plain", "": "", None: "",
}


@pytest.mark.parametrize("page", CASES)
def test_layout(page):
    assert render(page)[0] == CASES[page]


def test_deep_nesting():
    assert render("<div>" * 50_000 + "x")[0] == "x"
    assert render("<table><tr><td>" * 2_000 + "x")[0] == "x"
    assert render("<a b='" * 20_000)[0] == ""


def test_rows(spark):
    rows = [(1, None, "u"), (2, "", "u"), (None, "<p>a</p>", "u"), (4, "<li>x", "u"), (4, "<li>x", "u")]
    pages = spark.createDataFrame(rows, "page_id long, html string, text string")
    found = sorted(map(tuple, extract_text(pages).collect()), key=str)
    assert found == sorted([
        (1, "", 0, 0, 0, 0), (2, "", 0, 0, 0, 0), (None, "a", 1, 1, 0, 0),
        (4, "- x", 3, 1, 0, 1), (4, "- x", 3, 1, 0, 1)], key=str)
    assert extract_text(pages.limit(0)).count() == 0


def hostile(size):
    """Pages of about that many characters whose layout could be far longer than they are."""
    yield "<table>" + "<tr><td>" + "w" * (size // 2) + "<td>z" + "<tr><td>a<td>b" * (size // 28)
    yield "<table><tr>" + "<td>c" * (size // 10) + "<tr><td>a" * (size // 18)
    yield "<table>" + "<tr><td colspan=1000>a<td colspan=1000>b" * (size // 40)
    yield "<table><tr>" + "<td rowspan=0>r" * (size // 30) + "<tr><td>a" * (size // 18)
    yield "<table><tr><td>a<td>b<tr><td>longer" * (size // 36)
    yield "<ul><li>x" * (size // 9)
    yield "<blockquote>q" * (size // 13)
    yield "<style>" + "a{" * (size // 2)
    yield "<style>" * (size // 7)
    yield "<select><option>o" * (size // 17)


@pytest.mark.parametrize("number", range(10))
def test_memory_is_in_proportion(number):
    for size in (100_000, 400_000):
        page = list(hostile(size))[number]
        tracemalloc.start()
        text = render(page)[0]
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert len(text) <= 16 * size and peak <= 400 * size, (len(text) / size, peak / size)


def test_five_megabytes():
    page = "<table><tr><td>" + "w" * 2_500_000 + "<td>z" + "<tr><td>a<td>b" * 180_000
    lines = render(page)[0].split("\n")
    assert len(lines) == 180_001 and lines[1] == "a | b"


class Visible(HTMLParser):
    """Words that show, of pages whose end tags are all there; a renderer without layout."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.hidden, self.words = [], []

    def handle_starttag(self, tag, attrs):
        if tag not in ("br", "meta", "img", "hr", "input", "link"):
            given = dict(attrs)
            self.hidden.append((tag, tag in ("script", "style", "title", "head") or "hidden" in given))

    def handle_endtag(self, tag):
        while self.hidden and self.hidden.pop()[0] != tag:
            pass

    def handle_data(self, data):
        if not any(hidden for _, hidden in self.hidden):
            self.words += data.split()


def shown_words(page):
    parser = Visible()
    parser.feed(page)
    parser.close()
    return parser.words


def test_words_against_another_renderer():
    draw = random.Random(8)

    def tree(depth):
        if depth == 0 or draw.random() < 0.2:
            return " " + entities.escape(draw.choice(["a<b", "x & y", "word", "é", "two words"])) + " "
        name = draw.choice("div section b i span p blockquote".split())
        inside = "".join(tree(depth - 1) for _ in range(draw.randint(0, 3)))
        if name == "p":
            inside = "p"
        return f"<{name}{draw.choice(['', '', '', ' hidden'])}> {inside} </{name}>"

    for _ in range(300):
        page = "<head><title>t</title><style>x{}</style></head>" + "".join(tree(4) for _ in range(3))
        assert render(page)[0].split() == shown_words(page), page
    for page in pq.read_table(f"{SF_DIR}/pages.parquet").column("html").to_pylist():
        words = [w for line in render(page)[0].split("\n") for w in line.removeprefix("- ").split()]
        assert sorted("".join(words)) == sorted("".join(shown_words(page or "")))
