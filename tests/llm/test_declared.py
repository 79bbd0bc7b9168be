"""The declared language of a page, wherever its html tag stands."""

import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stellate.llm import langid

LONG = {
    "comment": ("<!-- " + "licence " * 5000 + '-->\n<html class="x" lang="de-AT"><p>', "de"),
    "space": (" \n" * 50_000 + "<HTML\nLANG='fr'>", "fr"),
    "long tag": ('<html data-x="' + "y " * 100_000 + '" lang=es>', "es"),
    "unclosed tags": ("<html " * 30_000 + "x" * 100_000, None),
    "none": ("<html><p>" + "x " * 50_000, None),
    "near the start": ('<!doctype html><html lang="en">', "en"),
    "later tag": ("<html><!-- " + "x" * 3000 + '--><html lang="it">', "it"),
    "null": (None, None),
}


@pytest.mark.parametrize("name", LONG)
def test_declared(name):
    html, want = LONG[name]
    assert langid.declared_language(html) == want


def test_declared_is_evidence(spark):
    model = langid.TextModel([("the word and that", "en"), ("der das und ein", "de")])
    pages = spark.createDataFrame([(i, "https://a.example/x", LONG[k][0]) for i, k in enumerate(("comment", "near the start"))], "page_id long, url string, html string")
    assert {r.page_id: r.declared for r in langid.identify(langid.rows_of(None, pages), model).collect()} == {0: "de", 1: "en"}


def plain_visible(html):
    t = re.sub(r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>|<!--.*?-->", " ", html or "")
    return re.sub(r"<[^>]*>", " ", t)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(["<script", "<STYLE", "<styles", "</script", "</style", " >", ">", "<", "!--", "<!--", "-->", "--", "x", " ", "<p>", "script"]), max_size=25))
def test_visible(parts):
    assert langid.visible("".join(parts)) == plain_visible("".join(parts))


@pytest.mark.parametrize("part", ["<", "<!--", "<script", "<script>", "<style></script", "</script "])
def test_visible_is_linear(part):
    began = time.perf_counter()
    langid.visible(part * (1_000_000 // len(part)))
    assert time.perf_counter() - began < 2
