"""Each invisible mark is removed where it is the only special character."""

import pytest

from palimpsest.llm.canonical import _INVISIBLE_MARKS, canonical_text


@pytest.mark.parametrize("mark", _INVISIBLE_MARKS)
def test_mark_alone(mark):
    assert canonical_text(f"pass{chr(mark)}word") == "password"
