"""Word splitting on UTF-8 bytes; splitting whole texts runs at memory speed."""

from __future__ import annotations

#: A-Z to a-z, all else unchanged
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: lower case, and every ASCII byte that is neither letter nor digit to a space
ALNUM = bytes(LOWER[b] if b > 127 or chr(LOWER[b]).isalnum() else 32 for b in range(256))


def spaced(text: bytes | None) -> list[bytes]:
    """Runs of bytes other than space and 0x09-0x0D."""
    return text.split() if text else []


def spaced_lower(text: bytes | None) -> list[bytes]:
    return text.translate(LOWER).split() if text else []


def alnum(text: bytes | None) -> list[bytes]:
    """Lower-cased runs of ASCII letters, digits and bytes above 0x7F."""
    return text.translate(ALNUM).split() if text else []
