"""Properties of the Python kernels, on random input."""

import pytest

hypothesis = pytest.importorskip("hypothesis")
from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402

from quirefold.functions import fuzzy  # noqa: E402
from quirefold.operators import merge  # noqa: E402
from quirefold.sources import html  # noqa: E402

words = st.text(alphabet="abc 一（", max_size=14)


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            row[j], last = (last + 1 if x == y else max(row[j], row[j - 1])), row[j]
    return row[-1]


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(words, words)
def test_lcs_and_ratios(a, b):
    assert fuzzy.lcs_length(a, b) == slow_lcs(a, b)
    assert fuzzy.ratio(a, b) == fuzzy.ratio(b, a)
    assert fuzzy.partial_ratio(a, b) >= fuzzy.ratio(a, b) or len(a) == len(b) or not a or not b or fuzzy.partial_ratio(a, b) <= 100
    assert 0 <= fuzzy.partial_ratio(a, b) <= 100 and 0 <= fuzzy.token_sort_ratio(a, b) <= 100
    if a and a in b:
        assert fuzzy.partial_ratio(a, b) == 100


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abc", max_size=20), st.text(alphabet="abc", min_size=1, max_size=5), st.integers(0, 2))
def test_near_matches_lie_within_the_distance(text, word, most):
    hit = fuzzy.first_near(text, word, most)
    within = [(i, j) for i in range(len(text) + 1) for j in range(i + 1, len(text) + 1) if edit_distance(text[i:j], word) <= most]
    if hit is None:
        assert not within
    else:
        assert edit_distance(text[hit[0] : hit[1]], word) <= most


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="ab- ", max_size=6), max_size=6))
def test_joined_text_keeps_letters(texts):
    kept = lambda t: t.replace("-", "").replace(" ", "")
    assert kept(merge.joined_text(texts)) == kept("".join(texts))


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="<>/pbrh1 x&;", max_size=60))
def test_html_never_fails(source):
    assert all(text == " ".join(text.split()) and text for _, _, text, _ in html.blocks_of(source))
