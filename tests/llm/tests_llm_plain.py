"""Plain versions that several tests share."""

from __future__ import annotations

import hashlib


def plain_removed(rows, length=100):
    """doc_id -> bytes removed and digest of the rest: every window that also starts earlier is covered."""
    seen, out = set(), {}
    for i, text in sorted(rows):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for at in range(len(data) - length + 1):
            window = data[at : at + length]
            if window in seen:
                gone[at : at + length] = b"\1" * length
            seen.add(window)
        out[i] = (sum(gone), hashlib.sha256(bytes(x for x, g in zip(data, gone, strict=True) if not g)).hexdigest())
    return out
