import random

import pytest

from inkfold.constants import EDGE_CHARACTERS, SENTINEL
from inkfold.functions import text

M = "⁣"


@pytest.mark.parametrize(
    "value, marked",
    [
        ("a", f"{M}a{M}"),
        (" 'x', ", f"{M}x{M}"),
        ("a,b", f"{M}a,b{M}"),
        ("", ""),
        ("   ", "   "),
        ("　", "　"),
        ("\x85", "\x85"),
        ("\x1c", "\x1c"),
        ("​", f"{M}​{M}"),
        (SENTINEL, SENTINEL),
        (f" {SENTINEL}", f"{M}{SENTINEL}{M}"),
        ("',", f"{M}{M}"),
        (" a", f"{M} a{M}"),
        ("\ta\r\n", f"{M}a{M}"),
        (None, None),
    ],
)
def test_wrap_value(evaluate, value, marked):
    assert evaluate(text.wrap_value, [value]) == [marked]


def test_blank_and_edges_agree_with_python_on_every_character(evaluate):
    characters = [chr(c) for c in range(1, 0x10000) if not 0xD800 <= c < 0xE000]
    assert evaluate(text.is_blank, characters) == [not c.strip() for c in characters]
    for form in ("{}x", "x{}", "x{}y"):
        values = [form.format(c) for c in characters]
        assert evaluate(text.preserve_space, values) == [v != v.strip() for v in values]


def test_edges_of_empty_and_long_text(evaluate):
    values = ["", " ", "\n", "a" * 50000 + " ", " " + "a" * 50000, "a b\nc"]
    assert evaluate(text.preserve_space, values) == [False, True, True, True, True, False]


def test_wrap_agrees_with_python_on_random_text(evaluate):
    pick = random.Random(7)
    letters = EDGE_CHARACTERS + "ab 　ก" + M
    values = ["".join(pick.choices(letters, k=pick.randint(0, 9))) for _ in range(2000)]
    expected = [v if not v.strip() else M + v.strip(EDGE_CHARACTERS) + M for v in values]
    assert evaluate(text.wrap_value, values) == expected


def test_not_found_fill_and_split(evaluate):
    assert evaluate(text.not_found_fill, ["a", "", None]) == ["a", "", SENTINEL]
    values = ["", M, f"a{M}", f"{M}{M}b", "plain"]
    assert evaluate(text.split_marker, values) == [v.split(M) for v in values]
    assert evaluate(text.count_markers, values) == [v.count(M) for v in values]
