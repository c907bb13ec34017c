"""Buckets of super-k-mers number their words without an object per word."""

import numpy as np
from runlens.llm.substrings import repeated_windows


class Whole(bytes):
    def split(self, *args):
        raise AssertionError("words of a bucket as Python objects")


def test_words_of_a_bucket_are_numbered_at_once():
    strings = [b"a b c d", b"x a b c", b"\xff\xfe b c", b"c d e \xff\xfe b c"]
    found = repeated_windows([Whole(s) for s in strings], np.array([0, 0, 0, 0], np.uint8), 3)
    assert [f.tolist() for f in found] == [[True, False], [False, True], [True], [False, False, False, True]]
    twice = repeated_windows([Whole(s) for s in strings[:1]], np.array([1], np.uint8), 3)
    assert [f.tolist() for f in twice] == [[True, True]]
