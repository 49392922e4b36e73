"""Licence sentences as they stand in files: wrapped, indented, commented."""

import textwrap

import pytest

from gristmill.llm import licenses

S = licenses.SENTENCES
KNOWN = licenses._known(S)


def scan(text):
    return [(x[0], x[1]) for x in licenses.scan_text(text, KNOWN, licenses.RULES, 2)]


@pytest.mark.parametrize("mark", ["", "# ", " * ", "// ", ";; ", "% ", " " * 40])
@pytest.mark.parametrize("width", [70, 80, 1000])
@pytest.mark.parametrize("line_break", ["\n", "\r\n"])
def test_wrapped_headers(mark, width, line_break):
    def header(*names):
        return line_break.join(mark + x for n in names for x in [*textwrap.wrap(S[n], width), ""])

    assert scan(f"The MIT License (MIT){line_break}{header('mit-1', 'mit-2', 'mit-3')}") == [("MIT", "mit-full")]
    assert scan(header("gpl-1", "gpl-2")) == [("GPL-3.0-or-later", "gpl3-header")]
    assert scan(header("apache-1", "apache-2") + "http://www.apache.org/") == [("Apache-2.0", "apache-header")]
    assert scan(header("bsd-1") + "1. Redistributions") == [("LicenseRef-BSD", "bsd-conditions")]


def test_comment_marks_and_ends():
    assert scan(f"<!-- {S['gpl2-notice']} -->") == [("GPL-2.0-only", "gpl2-notice")]
    assert scan(f"text without an end\n{' ' * 60}{S['cc-by-notice']}\nmore text") == [("CC-BY-4.0", "cc-by-notice")]
    assert scan("Released under the\n\nMIT License.") == scan("Released under the.\nMIT License.") == []
    [(*_, start, end)] = licenses.scan_text("x\n# Released under\n# the MIT License.\ny", KNOWN, licenses.RULES, 2)
    assert (start, end) == (2, 37)
