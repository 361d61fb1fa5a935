r"""Terms of a text: maximal runs of ASCII digits and letters and of all characters beyond ASCII, with A-Z alone lower-cased.

In UTF-8 every byte of a character beyond ASCII is at least 0x80, so bytes can be cut without decoding them.
"""

from __future__ import annotations

_KEPT = frozenset(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
_FOLD = bytes(b if b >= 128 else ord(chr(b).lower()) if b in _KEPT else 32 for b in range(256))


def cut(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()
