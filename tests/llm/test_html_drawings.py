"""Text in and after drawings (svg) and formulas (math)."""

import random

import pytest

from crawlscore.llm import html_text as ht

CASES = {
    # a start tag that ends in '/' is closed at once
    "<body><svg class=\"icon\"/><p>text</p>": "text",
    "<div>a<math/>b</div>c": "ab\nc",
    "<svg><title/><text>t</text></svg>u": "t u",
    "<svg><g/><path d=M0/><style/></path></svg>u": "u",
    "<svg width=\"a=b\"/>u": "u",
    "<svg><script/><text>t</text></svg>": "t",
    # text of drawings
    "<p>See <svg><title>no</title><desc>no</desc><defs><text>no</text></defs><metadata>no</metadata><g>no<text>Chart</text></g></svg> here": "See Chart here",
    "<svg><text>a</text><text>b<tspan>c</tspan><tspan x=0 dy=9>d</tspan></text></svg>": "a bc d",
    "<svg><a><text>a</text></a><text display=none>x</text><text visibility=hidden>y</text><symbol><text>z</text></symbol></svg>": "a",
    "<svg><text>a &lt; <![CDATA[b &lt; c]]></text></svg>": "a < b &lt; c",
    "<svg><foreignObject><div>in<p>para</div></foreignObject></svg>out": "in\n\npara\n\nout",
    "<p>a<svg><foreignObject><p>b</p></foreignObject></svg>c</p>d": "a\n\nb\n\nc\n\nd",
    "<svg><switch><foreignObject><i>once</i></foreignObject><text>once</text></switch></svg>": "once",
    "<svg><path><p>x</p>": "x",
    "<div><svg><g></div>x": "x",
    "<svg style='display:none'><text>x</text></svg>y": "y",
    # formulas
    "<p>If <math> <mi>x</mi> <mo>=</mo> <mn>2</mn> </math>.": "If x=2.",
    "<math><semantics><mi>y</mi><annotation>no</annotation></semantics></math>z": "yz",
    "<math><mfrac><mn>1</mn><mn>2</mn></mfrac></math>": "1 2",
    "<math><mtext>a <b>b</b></mtext><mspace/><mi>c</mi></math>d": "a bcd",
}


@pytest.mark.parametrize("markup", CASES)
def test_drawings_and_formulas(markup):
    assert ht.render(markup) == CASES[markup]


def test_random_drawings_never_fail():
    rng = random.Random(3)
    parts = ["<svg>", "</svg>", "<svg/>", "<math>", "</math>", "<mi>", "</mi>", "<text>", "</text>", "<foreignObject>", "</foreignObject>", "<title>",
             "</title>", "<style/>", "<p>", "</p>", "<table>", "<td>", "</table>", "<li>", "<![CDATA[", "]]>", "w ", "<switch>", "<mfrac>", "<b>", "</b>"]
    for _ in range(3000):
        ht.render("".join(rng.choice(parts) for _ in range(rng.randint(0, 40))))
