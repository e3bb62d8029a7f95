"""The one-pass tag scan against a backtracking pattern, and broken pages in linear time."""

from __future__ import annotations

import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from meterloom.llm import maintext

# quotes as quoted strings where the tag still closes, else as stray characters, the latest choice changed first
PATTERN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)>|<[!?/][^>]*>", re.S)
PARTS = st.sampled_from(["<", "<a ", "<p>", "</p>", "</", "<!--", "-->", "<!x", ">", '"', "'", "=", "x y", "/", "<br/>", "<div class=\"nav\">", "t "])


@settings(max_examples=500, deadline=None)
@given(st.lists(PARTS, max_size=14).map("".join))
def test_tokens_are_those_of_the_pattern(html):
    found, at, last = [], 0, html.rfind(">")
    while token := maintext.next_token(html, at, last):
        found.append(token)
        at = token[1]
    assert found == [(m.start(), m.end(), (m[2] or "").lower(), m[3] or "", bool(m[1])) for m in PATTERN.finditer(html)]


@pytest.mark.parametrize("html", ["<p>x</p><a " + '"' * 100_000, "<a" * 200_000, "<a " * 200_000, "<!x" * 200_000, "<a '\">" * 50_000, "<a \"'" * 50_000 + ">"])
def test_broken_pages_take_linear_time(html):
    start = time.time()
    maintext.blocks_of(html)
    assert time.time() - start < 5
