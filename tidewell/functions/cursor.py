"""Opaque page cursors: base64url of JSON with a version, the command and the last row's sort keys."""

from __future__ import annotations

import base64
import binascii
import json

VERSION = "v1"


class InvalidCursor(ValueError):
    code = "INVALID_CURSOR"


def encode(command: str, keys: dict[str, str | int | float]) -> str:
    data = json.dumps({"schema_version": VERSION, "command": command, "keys": keys}, separators=(",", ":"), ensure_ascii=False)
    return base64.urlsafe_b64encode(data.encode("utf-8")).decode("ascii").rstrip("=")


def decode(text: str, command: str) -> dict[str, str | int | float]:
    """The keys of a cursor of ``command``; anything else raises ``InvalidCursor``."""
    try:
        found = json.loads(base64.urlsafe_b64decode(text + "=" * (-len(text) % 4)))
    except (binascii.Error, ValueError) as e:
        raise InvalidCursor("not a cursor") from e
    if not isinstance(found, dict):
        raise InvalidCursor("not an object")
    for name, wanted in (("schema_version", VERSION), ("command", command)):
        if found.get(name) != wanted:
            raise InvalidCursor(f"{name} is {found.get(name)!r}, not {wanted!r}")
    if not isinstance(found.get("keys"), dict):
        raise InvalidCursor("no keys")
    return found["keys"]
