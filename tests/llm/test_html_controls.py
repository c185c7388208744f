"""Buttons and fields as boxes of their own, and soft hyphens."""

import pytest

from crawlscore.llm import html_text as ht

CASES = {
    "<button>Go</button><textarea>abc</textarea>": "Go abc",
    "<button>Go</button><button>Stop</button>": "Go Stop",
    "<input type=submit value=Send><input type=reset value=Clear>": "Send Clear",
    "press<button>Go</button>now": "press Go now",
    "press <button> Go </button> now": "press Go now",
    "<button hidden>Go</button>x<button></button>y": "x y",
    "<p><button>Go</button></p><p>b</p>": "Go\n\nb",
    "<table><tr><td><button>a</button><td>b<tr><td>c<td>d</table>": "a  b\nc  d",
    "re&shy;cy\u00adcle <b>&shy;</b>it": "recycle it",
    "<pre>a\u00adb\n c&shy;d</pre>": "ab\n cd",
    "<img alt='mo&shy;tor'>": "motor",
    "<input type=submit value='se&shy;nd'>": "send",
    "\u00ad": "",
}


@pytest.mark.parametrize("markup", CASES)
def test_controls_and_soft_hyphens(markup):
    assert ht.render(markup) == CASES[markup]
