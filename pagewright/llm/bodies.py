"""Decoded bodies of cached responses."""

from __future__ import annotations

import base64
import codecs
from functools import lru_cache


@lru_cache(maxsize=4096)
def codec_name(encoding: str | None) -> str:
    """The codec of an encoding column: null, blank and unknown ones mean UTF-8."""
    name = (encoding or "").strip() or "utf-8"
    try:
        return codecs.lookup(name).name if getattr(codecs.lookup(name), "_is_text_encoding", True) else "utf-8"
    except (LookupError, ValueError):
        return "utf-8"


def raw_body(content: str | None) -> bytes:
    """The bytes of a base64 content; none for a null one or one that isn't base64."""
    try:
        return base64.b64decode(content or "")
    except ValueError:
        return b""


def body_text(content: str | None, encoding: str | None) -> str:
    """The body read in the encoding of its column; what can't be read shows as U+FFFD."""
    return raw_body(content).decode(codec_name(encoding), "replace")
