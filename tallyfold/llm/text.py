"""Words of whole texts, in blocks of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

#: Characters of a text that are cut into words at a time.
BLOCK = 1 << 20

_SPACE = " \t\n\v\f\r"


def blocks(text: str, size: int = BLOCK) -> Iterator[str]:
    """Pieces of text that end at ASCII white space, of about size characters; together they are the text."""
    at = 0
    while len(text) - at > size:
        end = at + size
        while end < len(text) and text[end] not in _SPACE:
            end += 1
        yield text[at:end]
        at = end
    yield text[at:]


def word_blocks(text: str) -> Iterator[list[bytes]]:
    """The text's words (runs of anything but ASCII white space, A-Z lower-cased) in UTF-8, block by block."""
    for piece in blocks(text):
        yield piece.encode().lower().split()
