"""Symbols of Rust sources, by a scanner that knows strings, comments and braces."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

SCHEMA = "identifier string, text string, symbol_kind string, file_path string, line_start int, line_end int, embed boolean"
EXCERPT = 10

_SKIP = re.compile(r"""//[^\n]*|/\*|b?r(#*)"|b?"(?:\\.|[^"\\])*"|b?'(?:\\(?:x[0-9a-fA-F]{2}|u\{[^}]*\}|.)|[^'\\\n])'""", re.S)
_ITEM = re.compile(r"(?m)(?:^|(?<=[{};\]]))\s*(?:pub(?:\s*\([^)]*\))?\s+)?(?:(?:default|async|unsafe|extern|const(?=\s+(?:fn|unsafe|async|extern)))\s+)*(macro_rules!|(?:fn|struct|enum|trait|impl|mod|type|const|static|use)\b)")
# What items are called.
_KIND = {"fn": "function", "struct": "struct", "enum": "enum", "trait": "trait", "mod": "module", "type": "typealias", "const": "const", "static": "static", "macro_rules!": "macro"}


def mask(source: str) -> tuple[str, list[tuple[int, int]]]:
    """The source with strings and comments blanked, and where the comments are."""
    out, comments, at = list(source), [], 0
    while m := _SKIP.search(source, at):
        end = m.end()
        if m[0] == "/*":
            depth, end = 1, m.end()
            while depth and (x := re.compile(r"/\*|\*/").search(source, end)):
                depth, end = depth + (1 if x[0] == "/*" else -1), x.end()
            if depth:
                end = len(source)
        elif m[1] is not None:
            close = source.find('"' + m[1], m.end())
            end = len(source) if close < 0 else close + 1 + len(m[1])
        if m[0].startswith(("//", "/*")):
            comments.append((m.start(), end))
        for i in range(m.start(), end):
            if out[i] != "\n":
                out[i] = " "
        at = end
    return "".join(out), comments


def _end(code: str, at: int) -> tuple[int, int | None]:
    """Where an item ends, and where its body begins: at a semicolon, or the brace that closes its first one."""
    depth = 0
    for i in range(at, len(code)):
        c = code[i]
        if c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
        elif c == ";" and depth == 0:
            return i + 1, None
        elif c == "{" and depth == 0:
            level = 0
            for j in range(i, len(code)):
                level += (code[j] == "{") - (code[j] == "}")
                if not level:
                    return j + 1, i
            return len(code), i
    return len(code), None


def _type_name(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip()


def _impl_name(head: str) -> str:
    """`Type`, or `Trait<Type>` of an impl's head."""
    head = head.strip()
    if head.startswith("<"):
        depth = 0
        for i, c in enumerate(head):
            depth += (c == "<") - (c == ">" and head[i - 1] != "-")
            if not depth:
                head = head[i + 1 :]
                break
    head = re.split(r"\bwhere\b", head)[0]
    parts = re.split(r"\bfor\b(?!\s*<)", head, maxsplit=1)
    return _type_name(parts[0]) if len(parts) == 1 else f"{_type_name(parts[0])}<{_type_name(parts[1])}>"


def extract(path: str, source: str, whole: bool = False) -> list[tuple]:
    """Rows of SCHEMA: functions, types, methods and so on, then the file's comments and imports, which aren't embedded.

    A symbol's text is its doc comment, its signature (a function's up to the body, others' first line)
    and, of functions, the body's first lines; with `whole`, structs, enums and traits have all their lines.
    Items in bodies of functions, impls and traits are symbols too, named by their modules alone if they
    aren't methods; but no functions inside methods, functions without a body, or types of a trait.
    """
    code, comments = mask(source)
    lines = source.split("\n")
    line = lambda at: source.count("\n", 0, at) + 1
    found, imports = [], []

    def doc(at: int) -> str:
        k, own = line(at) - 2, []
        while k >= 0:
            first = k
            if lines[k].strip().endswith("*/"):  # a block comment may begin some lines before
                while first > 0 and "/*" not in lines[first]:
                    first -= 1
            if not lines[first].strip().startswith(("///", "//!", "/**")):
                break
            own[:0] = [x.strip() for x in lines[first : k + 1]]
            k = first - 1
        return "\n".join(own)

    def scan(lo: int, hi: int, mods: list[str], owner: str | None, kind_in: str, in_method: bool = False) -> None:
        at = lo
        while (m := _ITEM.search(code, at, hi)) and m.start() < hi:
            word = m[1]
            start = m.start() + len(m[0]) - len(m[0].lstrip())
            end, body = _end(code, m.end())
            at = end
            if word == "use":
                imports.append(lines[line(start) - 1].strip())
                continue
            if word == "impl":
                if body is not None:
                    scan(body + 1, end - 1, mods, _impl_name(code[m.end() : body]), "impl", in_method)
                continue
            name = re.match(r"\s*(?:mut\s+)?(\w+)", code[m.end() :])
            if not name or word in ("const", "static") and name[1] == "_":
                continue
            if word == "fn" and (body is None or in_method and not owner) or kind_in == "trait" and word == "type":
                continue
            kind = {"impl": "implmethod", "trait": "traitmethod"}.get(kind_in, "function") if word == "fn" else _KIND[word]
            head = source[start : body if word == "fn" and body is not None else end].strip()
            head = f"mod {name[1]}" if word == "mod" else head if word == "fn" or whole and word in ("struct", "enum", "trait") else head.split("\n")[0]
            excerpt = ""
            if word == "fn" and body is not None:
                part = source[body:end].split("\n")
                excerpt = "\n".join(part) if len(part) <= EXCERPT else "\n".join(part[:EXCERPT]) + "\n..."
            text = "\n".join(x for x in (doc(start), head, excerpt) if x)
            found.append(("::".join([path, *mods, *([owner] if owner and word == "fn" else []), name[1]]), text, kind, path, line(start), line(max(start, end - 1)), True))
            if word == "mod" and body is not None:
                scan(body + 1, end - 1, [*mods, name[1]], None, "", in_method)
            elif word == "trait" and body is not None:
                scan(body + 1, end - 1, mods, name[1], "trait", in_method)
            elif word == "fn":
                scan(body + 1, end - 1, mods, None, "", in_method or owner is not None)

    scan(0, len(code), [], None, "")
    inside = [(s[4], s[5]) for s in found if s[2] != "module"]
    alone = [source[a:b] for a, b in comments if not any(x <= line(a) <= y for x, y in inside)]
    last = max(1, len(source.splitlines()))
    for what, rows in (("comments", alone), ("imports", imports)):
        if rows:
            found.append((f"{path}::__{what}__", "\n".join(rows), what, path, 1, last, False))
    return found


def symbols(files: DataFrame, whole: bool = False) -> DataFrame:
    """files: file_path, content. Scanning is sequential within a file, so files go through Python in batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([r for p, s in zip(b.file_path, b.content, strict=True) if s is not None for r in extract(p, s, whole)], columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return files.select("file_path", "content").mapInPandas(run, SCHEMA)
