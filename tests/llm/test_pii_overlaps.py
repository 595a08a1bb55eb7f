"""Numbers beside each other and long values are proposed and found whole."""

import numpy as np
import pytest

pytest.importorskip("corvane.llm")

from corvane.llm import pii  # noqa: E402


def found(text):
    return [(text[a:b], kind) for a, b, kind in pii.find(text, *pii.model())[1]]


def test_numbers_beside_each_other_and_after_a_date():
    assert found("call 212-555-0143 212-555-0199 now") == [("212-555-0143", "number"), ("212-555-0199", "number")]
    assert found("at 2024-01-15 555-123-4567 seen") == [("555-123-4567", "number")]


def test_every_end_of_a_run_is_proposed():
    text = "2024-01-15 555-123-4567"
    got = {text[a:b] for a, b, kind in pii.candidates(text, [m.span() for m in pii._DIGITS.finditer(text)]) if kind == "number"}
    assert {"2024-01-15", "555-123-4567", "2024-01-15 555-123-4567", "15 555-123-4567"} <= got


def test_long_values_are_read_to_their_end():
    of = list("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
    secret = "".join(np.random.default_rng(1).choice(of, 2000))
    assert found(f'token = "{secret}"') == [(secret, "secret")]
    name = "a" * 60
    assert found(f"mail {name} (at) host (dot) org now") == [(f"{name} (at) host (dot) org", "mail")]
