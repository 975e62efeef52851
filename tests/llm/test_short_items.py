"""Benchmark items of few bytes."""

import random

import pytest

from snapgate.llm import decontaminate


@pytest.mark.parametrize("length", range(24, 41))
def test_short_item_at_the_start_of_a_document(length):
    rng = random.Random(length)
    item = bytes(rng.choices(b"abcdefghijklmnop", k=length))
    index = decontaminate.Windows.of([item])
    for offset in range(16):
        texts = [b"z" * (50 + offset), item + b" and more text behind it", b"q" * 40, b"x " + item]
        assert decontaminate.scan(texts, index) == {(1, 0): [1, 0], (3, 0): [1, 0]}


def test_items_below_the_window_are_found_as_whole_words():
    index = decontaminate.Windows.of([b"Tiny  item", b"(what) is it?", b"???", b"", None, b"x" * 40])
    texts = [b"a tiny\nITEM, here", b"a tiny items", b"destiny item", b"so (what) is it?yes", b"what ???", b"tiny item", b"x" * 40, None]
    assert decontaminate.scan(texts, index) == {
        (0, 0): [1, 0], (3, 1): [1, 0], (4, 2): [1, 0], (5, 0): [1, 0], (6, 5): [1, 0]}
