"""The artist and the time of a photograph, from its EXIF block."""

from __future__ import annotations

import struct
from datetime import datetime

#: Tags of the format.
ARTIST, EXIF_BLOCK, TAKEN, ASCII, LONG = 0x013B, 0x8769, 0x9003, 2, 4


def _block(content: bytes) -> bytes:
    """The TIFF structure inside a JPEG, or of a TIFF itself."""
    if content[:2] != b"\xff\xd8":
        return content if content[:4] in (b"II*\0", b"MM\0*") else b""
    at = 2
    while at + 4 <= len(content) and content[at] == 0xFF and content[at + 1] not in (0xD9, 0xDA):
        size = struct.unpack(">H", content[at + 2 : at + 4])[0]
        if content[at + 1] == 0xE1 and content[at + 4 : at + 10] == b"Exif\0\0":
            return content[at + 10 : at + 2 + size]
        at += 2 + size
    return b""


def read(content: bytes) -> dict:
    """`artist` and `taken_at`, as far as they are there."""
    data, out = _block(content), {}
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if not order:
        return out
    try:
        todo = [struct.unpack(order + "I", data[4:8])[0]]
        while todo:
            at = todo.pop()
            for n in range(struct.unpack(order + "H", data[at : at + 2])[0]):
                tag, kind, size, value = struct.unpack(order + "HHII", data[at + 2 + 12 * n : at + 14 + 12 * n])
                if tag == EXIF_BLOCK and kind == LONG:
                    todo.append(value)
                elif tag in (ARTIST, TAKEN) and kind == ASCII:
                    start = value if size > 4 else at + 10 + 12 * n
                    text = data[start : start + size].rstrip(b"\0").decode("utf-8", "replace").strip()
                    if tag == ARTIST and text:
                        out["artist"] = text
                    elif tag == TAKEN:
                        out["taken_at"] = datetime.strptime(text, "%Y:%m:%d %H:%M:%S")
    except (struct.error, ValueError, IndexError):  # a damaged block says nothing more
        pass
    return out
