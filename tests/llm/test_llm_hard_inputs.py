"""Inputs that once failed, lost text or took more than linear time."""

import itertools
import time

import numpy as np
import pytest
from corpus import documents

from waymark.llm import secrets
from waymark.llm.crf import Field, marginals
from waymark.llm.extraction import main_text
from waymark.llm.private import base_spans, find_private, redacted
from waymark.llm.secrets import RULES

TEXT = (
    "The first of the lines is here for all of the readers, and it is long enough to be "
    "taken for a part of the main text of this page by its words."
)
RUSSIAN = (
    "Это первая строка большой статьи о природе северных озёр. Она достаточно длинная, "
    "чтобы считаться основным текстом страницы. Вторая мысль следует сразу за первой."
)


def test_long_digit_run_in_an_address(spark):
    text = "0" * 5000 + "1.2.3.4"
    assert base_spans(text.encode())[0] == (0, 1, 5007)
    rows = [(1, text, "a", "en"), (2, "9" * 6000 + ".2.3.4", "a", "en")]
    found = {r.doc_id: r.spans for r in find_private(documents(spark, rows)).collect()}
    assert [(s.kind, s.end) for s in found[1] if s.base] == [("ip", 5007)]
    masked = redacted(documents(spark, rows)).filter("doc_id = 1").first()
    assert masked.text == "[IP]"


@pytest.mark.parametrize(
    "html, text",
    [
        (f"<div><p>{RUSSIAN} <a href='/x'>ссылка</a></p></div>", f"{RUSSIAN} ссылка"),
        (
            f"<div id=top><p>{TEXT}</p><p>{TEXT}</p><p>{TEXT}</p></div><article>Teaser</article>",
            f"{TEXT}\n{TEXT}\n{TEXT}",
        ),
        (f"<div class='social-history'><h2>Title</h2><p>{TEXT}</p></div>", f"Title\n{TEXT}"),
        (f"<div class='legal-affairs'><p>{TEXT}</p></div>", TEXT),
        (f"<div class='share-price'><p>{TEXT}</p></div>", TEXT),
        (f"<p>{TEXT}</p><div class='share-buttons'><p>{TEXT}</p></div>", TEXT),
        (f"<p class=\"x>{TEXT}</p>", TEXT),
        (f"<p class=\"x>{TEXT} <a href=\"y\">of it</a></p>", f"{TEXT} of it"),
        (f"<p title=\"a > b\">{TEXT}</p>", TEXT),
        (f"<p title=\"a\"class=b>{TEXT}</p>", TEXT),
    ],
)
def test_pages_that_lost_text(html, text):
    assert main_text(html) == text


@pytest.mark.parametrize(
    "part",
    [
        '<a x="1" ', "<a x='", "<a ", "<a " + "x" * 50, "<div>", "<li>", "</p>", "<div></p>",
        "<span hidden>", "<span hidden></b>", "<!-- ", "<script ", "x" * 9 + " <", "a=",
    ],
)
def test_open_tags_take_linear_time(part):
    page = part * (1_000_000 // len(part))
    begin = time.perf_counter()
    main_text(page)
    main_text(f"<p {page}>")
    assert time.perf_counter() - begin < 30


@pytest.mark.parametrize("part", ["eyJ", "ghp_", "token=", "AKIA", "xoxb-", "a1", "-----BEGIN "])
def test_secret_rules_take_linear_time(part):
    data = np.frombuffer((part * (1_000_000 // len(part))).encode(), np.uint8)
    begin = time.perf_counter()
    for rule in RULES:
        secrets.matches(data, rule)
    assert time.perf_counter() - begin < 40


def test_field_equals_enumeration_on_trees():
    """Without cycles the messages are exact; cycles come near."""
    rng = np.random.default_rng(4)
    kinds = 3
    for chain, skip, slack in (
        ([(0, 1), (1, 2)], [(1, 3), (3, 4)], 1e-2),
        ([(0, 1), (1, 2), (2, 3)], [(0, 3)], 0.1),
    ):
        nodes = 1 + max(itertools.chain(*chain, *skip))
        field = Field(rng.normal(size=(9, kinds)), *(rng.normal(size=(2, kinds, kinds)) * 0.7))
        features = rng.integers(0, 9, (nodes, 2))
        own = field.features[features].sum(axis=1)
        exact = np.zeros((nodes, kinds))
        for labels in itertools.product(range(kinds), repeat=nodes):
            score = sum(own[k, y] for k, y in enumerate(labels))
            score += sum(field.chain[labels[a], labels[b]] for a, b in chain)
            score += sum(field.skip[labels[a], labels[b]] for a, b in skip)
            exact[np.arange(nodes), labels] += np.exp(score)
        exact /= exact.sum(axis=1, keepdims=True)
        found = marginals(
            field, features, np.array(chain).reshape(-1, 2), np.array(skip).reshape(-1, 2)
        )
        assert np.abs(found - exact).max() < slack
