"""The CRF reads every word of a text."""

import numpy as np
import pytest

from stellate.llm import pii


@pytest.fixture(scope="module")
def crf():
    return pii.CRF(pii.labelled())


def test_label_is_exact(crf):
    """Against Viterbi over the whole line, short lines and one of many pieces."""
    lines = [ws for ws, _ in pii.labelled()]
    rng = np.random.default_rng(0)
    lines += [[w for i in rng.integers(0, 480, n) for w in lines[i]] for n in (1, 40, 300)] + [["1" * 3000], [], ["the"] * 1000]
    got = crf.label(lines)
    assert [[pii.LABELS[x] for x in g] for g in got] == crf.decode(lines)
    assert [g.tolist() for g in crf.label(lines)] == [g.tolist() for g in got]


@pytest.mark.parametrize("address", ["ab (at) mail.org", "jo [at] host.net"])
@pytest.mark.parametrize("before", [0, 400])
def test_address_without_digit_or_sign(spark, crf, address, before):
    text = " ".join(["the report"] * before + ["please write", address, "with the line"])
    at = text.index(address)
    d = spark.createDataFrame([(1, text), (2, "the report of the page"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.personal_data(d, crf).collect()}
    assert got == {1: f"email:{at}:{at + len(address)}", 2: "", 3: ""}


def test_words_of_one_form_weigh_alike(crf):
    words = {w for ws, _ in pii.labelled() for w in ws} | set("É× Éa× ×x a² ٣٣x x٣ 12٣ Straße, ÀÉ-é Ǆa Ω9 (AT) The, the the. 4111111111111111 4111111111111112 ﬁ1 _a a_".split()) | {"x" * 40, "Ab" * 9}
    for w in words:
        other = "".join({"a": "q", "A": "Q", "9": "7"}.get(k, c) if (k := pii._CLASSES.get(ord(c))) else c for c in w)
        for x, y in ((w, other), (other, w)):
            got = crf.label([["the", x, "end"], ["the", y, "end"]])
            assert [[pii.LABELS[i] for i in g] for g in got] == crf.decode([["the", x, "end"], ["the", y, "end"]])
            if crf._form(x) == crf._form(y):
                assert np.allclose(crf._weights(x), crf._weights(y))
