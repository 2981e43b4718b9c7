"""A package built in one piece by plain Python, for tests: chunks of literals, greedily filled pages."""

from __future__ import annotations

import numpy as np

from leafmill.functions.bytes import BLOCK
from leafmill.sinks.packages import BREAK, FIRST_BLOCK, FIRST_SIBLING, HALF, HALF_END, HEAD, HEAD_END, LAST_SIBLING, LEAF, catalog, cells
from leafmill.sources.packages import CHUNK, COMPONENT_MAGIC, ENTRY_MARK

__all__ = ["build", "catalog", "cells", "component", "tree_pages"]


def _padded(data: bytes) -> bytes:
    return data + bytes(-len(data) % BLOCK)


def component(data: bytes, start_block: int, kind: int) -> bytes:
    """A component whose chunks hold their bytes as literals."""
    data = _padded(data)
    bodies = []
    for at in range(0, len(data), CHUNK):
        part = data[at : at + CHUNK]
        literal = np.zeros((len(part), 3), np.uint8)
        literal[:, 2] = np.frombuffer(part, np.uint8)
        bodies.append(bytes(2) + len(part).to_bytes(2, "big") + bytes(1) + literal.tobytes())
    head = bytearray(64)
    head[:8], head[15] = COMPONENT_MAGIC, kind
    head[0x16:0x18] = len(bodies).to_bytes(2, "big")
    head[0x18:0x20] = start_block.to_bytes(4, "big") + (start_block + len(data) // BLOCK - 1).to_bytes(4, "big")
    places, at = [], 64 + 4 * len(bodies)
    for body in bodies:
        places.append(at.to_bytes(4, "big"))
        at += len(body)
    return bytes(head) + b"".join(places) + b"".join(bodies)


def tree_pages(rows: list[tuple[bytes, bytes]], first_block: int) -> list[bytes]:
    """Pages of an index tree over sorted (key, record) rows, level by level from the root.

    A branch row has the greatest key below its child; the last row of the last page of a
    level is a sentinel. The first page of a level and the last are flagged.
    """
    leaves, held, size = [], [], 4
    for row in rows:
        if held and size + len(row[1]) > BLOCK:
            leaves.append(held)
            held, size = [], 4
        held.append(row)
        size += len(row[1])
    leaves.append(held)
    levels: list[list[list]] = [leaves]
    highs = [[page[-1][0] if page else b"" for page in leaves]]
    while len(levels[0]) > 1:
        width = max(2, min(254, max(map(len, highs[0]))))
        per_page = (BLOCK - 4) // (width + 4)
        groups = [list(range(k, min(k + per_page, len(levels[0])))) for k in range(0, len(levels[0]), per_page)]
        levels.insert(0, groups)
        highs.insert(0, [highs[0][g[-1]] for g in groups])
    starts, at = [], first_block
    for level in levels:
        starts.append(at)
        at += len(level)
    pages = []
    for depth, level in enumerate(levels):
        for k, page in enumerate(level):
            flags = (FIRST_SIBLING if k == 0 else 0) | (LAST_SIBLING if k == len(level) - 1 else 0)
            if depth == len(levels) - 1:
                body, word = b"".join(r for _, r in page), LEAF | flags
            else:
                width = max(2, min(254, max(map(len, highs[depth + 1]))))
                final = k == len(level) - 1
                keys = [b"\xff" * width if final and child == page[-1] else highs[depth + 1][child][:width] for child in page]
                body, word = b"".join(key.ljust(width, b"\0") + (starts[depth + 1] + child).to_bytes(4, "big") for key, child in zip(keys, page, strict=True)), width | flags
            pages.append((word.to_bytes(2, "big") + len(page).to_bytes(2, "big") + body).ljust(BLOCK, b"\0"))
    return pages


def build(package_id: str, title: str, entries: list[tuple[str, str]]) -> list[tuple[str, str, bytes]]:
    """(dir, name, content) of a package of (headword, text) entries, in index order of their headwords."""
    pointer = lambda first, at: (first + at // BLOCK).to_bytes(4, "big") + (at % BLOCK).to_bytes(2, "big")
    body, titles, places = b"", b"", []
    for headword, text in entries:
        places.append((len(body), len(titles)))
        lines = [HALF + cells(line) + HALF_END for line in text.split("\n")]
        body += ENTRY_MARK + HEAD + HALF + cells(headword) + HALF_END + HEAD_END + BREAK + BREAK.join(lines) + BREAK
        titles += HALF + cells(headword) + HALF_END + BREAK
    body_at = FIRST_BLOCK
    title_at = body_at + len(_padded(body)) // BLOCK
    index_at = title_at + len(_padded(titles)) // BLOCK
    order = sorted(range(len(entries)), key=lambda k: cells(entries[k][0]))
    rows = [(key := cells(entries[k][0])[:254], bytes([len(key)]) + key + pointer(body_at, places[k][0]) + pointer(title_at, places[k][1])) for k in order]
    index = b"".join(tree_pages(rows, index_at))
    parts = [("BODY.BIN", 0x00, body_at, title_at - 1, body), ("TITLE.BIN", 0x05, title_at, index_at - 1, titles), ("INDEX.BIN", 0x91, index_at, index_at + len(index) // BLOCK - 1, index)]
    made = [(package_id, name, component(data, first, kind)) for name, kind, first, _, data in parts]
    return [(package_id, "CATALOG.IDX", catalog(title, [p[:4] for p in parts])), *made]
