"""Terms of a text as bytes: what is left when all ASCII but letters and digits parts, with A-Z as a-z."""

from __future__ import annotations

_LETTERS = b"abcdefghijklmnopqrstuvwxyz"
#: every byte that is no part of a term is a blank; bytes of other characters than ASCII stay as they are
TABLE = bytes(b if b >= 0x80 or chr(b).isdigit() or b in _LETTERS else b + 32 if b + 32 in _LETTERS else 32 for b in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    """The terms of a text in UTF-8, in order; null has none."""
    return text.translate(TABLE).split() if text else []


class Numbers(dict):
    """Numbers for terms, given as they come."""

    def __missing__(self, term: bytes) -> int:
        n = self[term] = len(self)
        return n
