"""Chunks of documents: whole small files, Markdown sections, paragraphs, line windows."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: Bytes of a chunk at most, where a text has places to cut.
LIMIT = 16384
HEADING = re.compile(r"^(#{1,6})(?: |$)")
SCHEMA = "file_path string, ordinal int, text string, line_start int, line_end int, heading_path string"


def _size(text: str) -> int:
    return len(text.encode())


def _lines(text: str) -> list[str]:
    return [x.removesuffix("\r") for x in text.removesuffix("\n").split("\n")] if text else []


def _windows(lines: list[str], start: int) -> Iterator[tuple[str, int, int]]:
    """Lines packed while they fit; a line costs its bytes and one."""
    held, size, first = [], 0, start
    for i, line in enumerate(lines):
        cost = _size(line) + 1
        if held and size + cost > LIMIT:
            yield "\n".join(held), first, start + i - 1
            held, size, first = [], 0, start + i
        held.append(line)
        size += cost
    if held:
        yield "\n".join(held), first, start + len(lines) - 1


def _paragraphs(lines: list[str]) -> Iterator[tuple[str, int, int]]:
    """Each paragraph is a chunk; one blank line ends it, a second one begins the next."""
    at = 0
    while at < len(lines):
        end = at + 1
        while end < len(lines) and lines[end].strip():
            end += 1
        part = lines[at:end]
        if any(x.strip() for x in part):
            text = "\n".join(part)
            if _size(text) > LIMIT:
                yield from _windows(part, at + 1)
            else:
                yield text, at + 1, end
        at = end + 1


def _packed(text: str, start: int) -> Iterator[tuple[str, int, int]]:
    """Paragraphs packed while they fit; one that is too large stays whole."""
    held: list[str] = []
    size, first, line = 0, start, start
    for p in text.split("\n\n"):
        if held and size + _size(p) + 2 > LIMIT:
            body = "\n\n".join(held)
            yield body, first, first + body.count("\n")
            held, size, first = [], 0, line
        size += _size(p) + (2 if held else 0)
        held.append(p)
        line += p.count("\n") + 2
    if held:
        body = "\n\n".join(held)
        yield body, first, first + body.count("\n")


def _sections(lines: list[str]) -> Iterator[tuple[list[str], int, str | None]]:
    stack: list[tuple[int, str]] = []
    held, first, path = [], 1, None
    for i, line in enumerate(lines, 1):
        if m := HEADING.match(line):
            if held:
                yield held, first, path
            while stack and stack[-1][0] >= len(m[1]):
                stack.pop()
            stack.append((len(m[1]), line))
            held, first, path = [], i, " > ".join(x for _, x in stack)
        held.append(line)
    if held:
        yield held, first, path


def chunk(path: str, source: str, ext: str) -> list[tuple[str, int, str, int, int, str | None]]:
    """(file_path, ordinal, text, line_start, line_end, heading_path) of a file's chunks; ordinals count up from 0."""
    lines = _lines(source)
    if _size(source) <= LIMIT:
        return [(path, 0, source, 1, max(1, len(lines)), None)]
    found: list[tuple[str, int, int, str | None]] = []
    if ext in ("md", "markdown"):
        for part, first, heading in _sections(lines):
            text = "\n".join(part)
            cut = _packed(text, first) if _size(text) > LIMIT else [(text, first, first + len(part) - 1)]
            found += [(*x, heading) for x in cut]
    else:
        found = [(*x, None) for x in _paragraphs(lines)]
    return [(path, i, *x) for i, x in enumerate(found)]


def chunks(files: DataFrame) -> DataFrame:
    """files: file_path, source, extension. Packing is sequential within a file, so files go through Python in batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for b in batches:
            yield pd.DataFrame([r for p, s, e in zip(b.file_path, b.source, b.extension, strict=True) if s is not None for r in chunk(p, s, e or "")], columns=names)

    return files.select("file_path", "source", "extension").mapInPandas(run, SCHEMA)
