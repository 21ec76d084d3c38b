from __future__ import annotations

from roadflow.llm import pii


def test_plus_before_plain_digits():
    text = "call plus 49 170 1234567 today"
    a = text.index("plus")
    assert pii.disguised_spans(text, pii.plain_spans(text)) == [(a, 3, text.index(" today"))]
    assert pii.disguised_spans("one plus 1 is more", []) == []
