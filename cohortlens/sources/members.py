"""Members of types as rows: fields, constructors, methods, parameters, calls, creations, annotations and imports of brace-language sources.

One row for each, found by a scan of tokens; rules over them are expressions (see operators.architecture)."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

from cohortlens.sources.code import KEYWORDS, TYPES, Token, _closing, scan

MODIFIERS = frozenset("public protected private static final abstract synchronized native strictfp transient volatile default sealed".split())
SCHEMA = """package string, owner string, owner_annotations array<string>, extends string, implements array<string>, kind string, name string, member string, type string, visibility string, modifiers array<string>,
annotations array<string>, args int, statements int, nulls array<string>, text string, line int, end_line int"""


@dataclass
class Row:
    package: str | None
    owner: str | None = None
    owner_annotations: list[str] = field(default_factory=list)
    extends: str | None = None
    implements: list[str] = field(default_factory=list)
    kind: str = ""
    name: str | None = None
    member: str | None = None  # the method or constructor that a parameter, call or creation lies in
    type: str | None = None
    visibility: str | None = None
    modifiers: list[str] = field(default_factory=list)
    annotations: list[str] = field(default_factory=list)
    args: int | None = None
    statements: int | None = None
    nulls: list[str] = field(default_factory=list)  # names that a method sets to null
    text: str | None = None
    line: int = 0
    end_line: int = 0


def _text(tokens: list[Token]) -> str:
    out = ""
    for x in tokens:
        out += (" " if out and (out[-1].isalnum() or out[-1] == "_") and (x.text[0].isalnum() or x.text[0] in "_@\"'") else "") + x.text
    return out


def _split(t: list[Token]) -> list[list[Token]]:
    """Parts between commas outside brackets."""
    out, depth = [[]], 0
    for x in t:
        depth += (x.text in "(<[{") - (x.text in ")>]}") if len(x.text) == 1 else 0
        if x.text == "," and depth == 0:
            out.append([])
        else:
            out[-1].append(x)
    return [p for p in out if p]


class _File:
    def __init__(self, source: str | None):
        self.t = [x for x in scan(source) if x.kind != "comment"]
        self.place = {id(x): i for i, x in enumerate(self.t)}
        self.rows: list[Row] = []
        self.package = None
        i = 0
        while i < len(self.t):
            x = self.t[i]
            if x.text in ("import", "package"):
                end = next((j for j in range(i, len(self.t)) if self.t[j].text == ";"), len(self.t))
                name = "".join(y.text for y in self.t[i + 1 : end] if y.text != "static")
                if x.text == "package":
                    self.package = name
                else:
                    self.rows.append(Row(self.package, kind="import", name=name, text=name, line=x.line, end_line=self.t[min(end, len(self.t) - 1)].line))
                i = end + 1
            else:
                i = self.declaration(i, len(self.t), None)
        for r in self.rows:
            r.package = self.package

    def head(self, i: int, end: int) -> tuple[int, list[str], list[tuple[str, str, int]]]:
        """Modifiers and annotations (name, text, line) from i on, and the place after them."""
        mods, notes = [], []
        while i < end:
            x = self.t[i].text
            if x == "@" and i + 1 < end and self.t[i + 1].text != "interface":
                j = i + 2
                while j + 1 < end and self.t[j].text == ".":
                    j += 2
                if j < end and self.t[j].text == "(":
                    j = (_closing(self.t, j, "(", ")") or end - 1) + 1
                notes.append((self.t[i + 1].text if j == i + 2 or self.t[i + 2].text == "(" else self.t[j - 1].text, _text(self.t[i:j]), self.t[i].line))
                i = j
            elif x in MODIFIERS:
                mods.append(x)
                i += 1
            else:
                break
        return i, mods, notes

    def declaration(self, i: int, end: int, owner: Row | None) -> int:
        """A type or a member of owner that begins at i; the place after it."""
        t, first = self.t, i
        i, mods, notes = self.head(i, end)
        names = [n for n, _, _ in notes]
        if i >= end:
            return end
        x = t[i]
        if x.text in TYPES and i + 1 < end and t[i + 1].kind == "word":
            opening = next((j for j in range(i, end) if t[j].text in ("{", ";")), None)
            if opening is None or t[opening].text == ";":
                return end if opening is None else opening + 1
            close = _closing(t, opening, "{", "}") or end - 1
            parts = {"": [], "extends": [], "implements": []}
            at = ""
            for y in t[i + 2 : opening]:
                at = y.text if y.text in parts else at
                parts[at] += [y] if y.text not in parts else []
            one = Row(None, t[i + 1].text, names, _text(parts["extends"]) or None, [_text(p) for p in _split(parts["implements"])])
            self.add(one, "type", t[i + 1].text, t[i + 1].line, t[close].line, modifiers=mods, annotations=names)
            for name, text, line in notes:
                self.add(one, "annotation", name, line, line, text=text)
            j = opening + 1
            while j < close:
                j = max(j + 1, self.declaration(j, close, one))
            return close + 1
        if owner is None:
            return i + 1
        if x.text == "{":
            return (_closing(t, i, "{", "}") or end - 1) + 1
        if x.text == "<":
            i = (_closing(t, i, "<", ">") or i) + 1
        depth, j = 0, i
        while j < end and not (depth == 0 and t[j].text in ("(", "=", ";", ",", "{", "}")):
            depth += (t[j].text in ("<", "[")) - (t[j].text in (">", "]"))
            j += 1
        if j >= end or t[j].text in ("{", "}") or j == i:
            return j + 1
        visibility = next((m for m in mods if m in ("public", "protected", "private")), "package")
        if t[j].text == "(":
            return self.method(first, i, j, end, owner, mods, notes, visibility)
        stop, depth = j, 0
        while stop < end and not (depth == 0 and t[stop].text == ";"):
            depth += (t[stop].text in "({[") - (t[stop].text in ")}]") if len(t[stop].text) == 1 else 0
            stop += 1
        more = [p[0].text for p in _split(t[j:stop])[1 if t[j].text == "=" else 0 :] if p[0].kind == "word"] if t[j].text != ";" else []
        for name in [t[j - 1].text, *more]:
            self.add(owner, "field", name, t[first].line, t[min(stop, end - 1)].line, type=_text(t[i : j - 1]), visibility=visibility, modifiers=mods, annotations=names)
        return stop + 1

    def method(self, first: int, i: int, paren: int, end: int, owner: Row, mods: list[str], notes: list, visibility: str) -> int:
        t = self.t
        close = _closing(t, paren, "(", ")")
        if close is None:
            return end
        name, j = t[paren - 1].text, close + 1
        while j < end and t[j].text not in ("{", ";"):
            j += 1
        last = (_closing(t, j, "{", "}") or end - 1) if j < end and t[j].text == "{" else min(j, end - 1)
        body = t[j : last + 1] if j < end and t[j].text == "{" else []
        kind = "constructor" if paren - 1 == i and name == owner.owner else "method"
        names = [n for n, _, _ in notes]
        nulls = [body[k - 1].text for k in range(1, len(body) - 1) if body[k].text == "=" and body[k + 1].text == "null"]
        statements = sum(y.text == ";" for y in body) + sum(y.text in ("if", "for", "while", "switch", "try", "do") for y in body)
        self.add(owner, kind, name, t[first].line, t[last].line, type=_text(t[i : paren - 1]) or None, visibility=visibility, modifiers=mods, annotations=names, statements=statements if body else 0, nulls=nulls)
        for note, text, line in notes:
            self.add(owner, "method_annotation", note, line, line, member=name, text=text)
        for part in _split(t[paren + 1 : close]):
            at = self.place[id(part[0])]
            k, _, own = self.head(at, close)
            kept = part[k - at :]
            if kept:
                self.add(owner, "parameter", kept[-1].text, part[0].line, part[-1].line, member=name, type=_text(kept[:-1]), visibility=visibility, annotations=[n for n, _, _ in own], text=kind)
        for k, y in enumerate(body[:-1]):
            if y.kind != "word" or y.text in KEYWORDS:
                continue
            after = k + 1
            if k and body[k - 1].text == "new":
                while after < len(body) and body[after].text == ".":
                    after += 2
                made = body[after - 1].text
                if after < len(body) and body[after].text == "<":
                    after = (_closing(body, after, "<", ">") or after) + 1
                if after < len(body) and body[after].text == "(":
                    stop = _closing(body, after, "(", ")") or len(body) - 1
                    self.add(owner, "new", made, y.line, body[stop].line, member=name, type=made, args=len(_split(body[after + 1 : stop])), text=_text(body[k - 1 : stop + 1]))
            elif body[after].text == "(":
                start = k
                while start >= 2 and body[start - 1].text == "." and (body[start - 2].kind == "word"):
                    start -= 2
                if start and body[start - 1].text == "new":
                    continue
                stop = _closing(body, after, "(", ")") or len(body) - 1
                self.add(owner, "call", _text(body[start : k + 1]), body[start].line, body[stop].line, member=name, args=len(_split(body[after + 1 : stop])), text=_text(body[start : stop + 1]))
        return last + 1

    def add(self, owner: Row, kind: str, name: str, line: int, end_line: int, **more) -> None:
        self.rows.append(Row(None, owner.owner, owner.owner_annotations, owner.extends, owner.implements, kind, name, line=line, end_line=end_line, **more))


def members(files: DataFrame) -> DataFrame:
    """path and a row for each member (see SCHEMA), a batch of files at a time. files: path, text. Null and damaged texts give what comes before the damage."""

    def rows(batches):
        for pdf in batches:
            out = [{"path": path, **asdict(r)} for path, text in zip(pdf["path"], pdf["text"]) for r in _File(text).rows]
            yield pd.DataFrame(out, columns=["path", *Row.__dataclass_fields__])

    return files.select("path", "text").mapInPandas(rows, f"path string, {SCHEMA}")
