from lodestring.llm.html_text import render


def test_head_ends_without_its_end_tag():
    assert render("<html><head><title>T</title><h1>Hi</h1><p>text") == "Hi\n\ntext"
    assert render("<head>\n<meta charset=utf-8><link href=x><style>p{}</style>\nplain <b>text</b>") == "plain text"
    assert render("<head><noscript><img alt=no></noscript><template><p>no</template><base href=x><script>no</script><a href=x>yes</a>") == "yes"


def test_formulas_drawings_and_fields_show():
    assert render("<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn><mspace/><semantics><mi>y</mi><annotation>no</annotation></semantics></math> holds") == "so x=2y holds"
    assert render("<p>a<svg><title>no</title><desc/><g><rect/><text x=1>one <tspan>two</tspan></text><text>three</text></g>no<defs><text>no</text></defs></svg>b") == "a one two three b"
    assert render("<svg><foreignObject><p>in</p></foreignObject></svg>out") == "in\n\nout"
    assert render("<p>say <textarea rows=2>\nx &lt; <b>y</b>\n  z</textarea> end") == "say x < <b>y</b>\n  z end"
    assert render("pick <select><option>one<option selected>two<option>three</select> now") == "pick two now"
    assert render("pick <select><option disabled>none<optgroup label=g><option>one<option>two</select> now") == "pick one now"
    assert render("<select multiple><option>one<option>two</select>") == "one\ntwo"


def test_unclosed_ones_hide_nothing():
    assert render("a<svg><g><path d=x /><p>rest<b>!</b>") == "a\n\nrest!"
    assert render("a <math><mi>x<p>rest") == "a x\n\nrest"
    assert render("<select><option>one<option>two<p>rest") == "one\n\nrest"
    assert render("a<textarea>rest <i>&amp;") == "a rest <i>&"
    assert render("<svg/>a<math/>b<svg><svg/><text>c</text></svg>") == "ab c"


def test_a_veil_can_be_lifted():
    assert render("<div style='visibility:hidden'>no <span style='color:red; visibility: visible'>yes</span> <img alt=no></div>out") == "yes\n\nout".replace("\n\n", "\n")
    assert render("<p style='display:none'>no <b style='visibility:visible'>no</b></p>out") == "out"
    assert render("<body><noscript><p>plain</p></noscript>x") == "plain\n\nx"


def test_spans_keep_columns_aligned():
    page = "<table><tr><th colspan=2>Name<th>Age<tr><td>Ann<td>Lee<td>30<tr><td rowspan=2>Bo<td>Ray<td>4<tr><td>Sue<td>51</table>"
    assert render(page) == "Name      Age\nAnn  Lee  30\nBo   Ray  4\n     Sue  51"
    assert render("<table><tr><td colspan=2>a very wide cell<td>x<tr><td>1<td>2<td>3</table>") == "a very wide cell  x\n1  2              3"
    assert render("<table><tr><td rowspan=0>all<td colspan=999999999>a<td>b<tr><td>c</table>") == "all  a  b\n     c"
