import pytest

from postbag.operators.cleaning import with_content
from tests.rows import frame, message


@pytest.mark.parametrize("robust", [False, True])
@pytest.mark.parametrize(
    "text, html, expected",
    [
        ("Hello world", None, "Hello world"),
        (None, "<p><strong>Hello</strong> world</p>", "**Hello** world"),
        ("Plain text", "<p>HTML text</p>", "Plain text"),
        ("", "<p>HTML text</p>", "HTML text"),
        ("This is my reply.\n\nOn Mon, Jan 1, 2024, someone wrote:\n> Original message here", None, "This is my reply."),
        (None, "<p>Yes.</p><p>On Mon, Jan 1, 2024, B wrote:</p><p>old</p>", "Yes."),
        (None, None, ""),
        ("", "", ""),
        ("  Hello world  \n\n", None, "Hello world"),
    ],
)
def test_content(spark, text, html, expected, robust):
    found = with_content(frame(spark, [message("1", text=text, html=html)]), robust_html=robust)
    assert found.first()["content"] == expected
    assert "text" not in found.columns and "html" not in found.columns
