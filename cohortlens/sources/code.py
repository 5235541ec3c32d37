"""A scanner for brace languages: methods, statements, complexity and token measures of source texts.

It reads tokens, not a grammar: a method is a name with a parameter list before a block, inside a type's
block. Comments, strings and characters are recognised first, so their content never counts.
Malformed texts give the methods found before the damage; null and empty ones give none."""

from __future__ import annotations

import hashlib
import math
import re
import xml.etree.ElementTree as ET
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r'(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<string>"""(?:\\.|(?!""").)*(?:"""|\Z)|"(?:\\.|[^"\\\n])*"?|\'(?:\\.|[^\'\\\n])*\'?)|(?P<number>\d[\w.]*)|(?P<word>[A-Za-z_$][\w$]*)|(?P<op>->|&&|\|\||[-+*/%=<>!&|^]=|\+\+|--|::|[^\sA-Za-z0-9_$])', re.S)

# Words of the language that cannot name a method.
KEYWORDS = frozenset("abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public record return short static strictfp super switch synchronized this throw throws transient try void volatile while".split())
TYPES = frozenset({"class", "interface", "enum", "record"})
BRANCHES = frozenset({"if", "for", "while", "case", "catch", "?", "&&", "||"})


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    line: int


def scan(source: str | None) -> list[Token]:
    """Tokens in order, comments included, each with the line it starts on (from 1)."""
    out, at, line = [], 0, 1
    for m in TOKEN.finditer(source or ""):
        line += source.count("\n", at, m.start())
        at = m.start()
        out.append(Token(m.lastgroup, m[0], line))
    return out


@dataclass(frozen=True)
class Method:
    name: str
    owner: str
    parameters: int
    tokens: list[Token]  # of the body, braces included
    start: int
    end: int


def _closing(t: list[Token], i: int, opening: str, closing: str) -> int | None:
    depth = 0
    for j in range(i, len(t)):
        depth += (t[j].text == opening) - (t[j].text == closing)
        if depth == 0:
            return j
    return None


def methods(tokens: list[Token]) -> list[Method]:
    """Methods and constructors by start; those of nested types too, and their bodies count for the outer method as well."""
    t = [x for x in tokens if x.kind != "comment"]
    out: list[Method] = []
    owners: list[tuple[str, int]] = []  # open types and the index of their closing brace
    for i, x in enumerate(t):
        while owners and i > owners[-1][1]:
            owners.pop()
        if x.text in TYPES and i + 1 < len(t) and t[i + 1].kind == "word" and t[i + 1].text not in KEYWORDS and (i == 0 or t[i - 1].text != "."):
            opening = next((j for j in range(i, len(t)) if t[j].text in "{;"), None)
            if opening is not None and t[opening].text == "{":
                owners.append((t[i + 1].text, _closing(t, opening, "{", "}") or len(t)))
        if x.kind != "word" or x.text in KEYWORDS or not owners or i + 1 >= len(t) or t[i + 1].text != "(" or (i and t[i - 1].text in (".", "new", "record")):
            continue
        stop = _closing(t, i + 1, "(", ")")
        if stop is None:
            continue
        body = stop + 1
        if body < len(t) and t[body].text == "throws":
            while body < len(t) and t[body].text not in "{;":
                body += 1
        if body >= len(t) or t[body].text != "{":
            continue
        end = _closing(t, body, "{", "}")
        if end is None:
            continue
        inner = t[i + 2 : stop]
        depth = commas = 0
        for y in inner:
            depth += (y.text in "(<[") - (y.text in ")>]")
            commas += y.text == "," and depth == 0
        out.append(Method(x.text, owners[-1][0], commas + 1 if inner else 0, t[body : end + 1], x.line, t[end].line))
    return out


def cyclomatic(tokens: list[Token]) -> int:
    return 1 + sum(x.kind in ("word", "op") and x.text in BRANCHES for x in tokens)


class _Walk:
    """Adds up control structures over tokens: a small descent through statements and expressions.

    A structure costs one and its depth. If, loops, catch and lambdas nest what they hold (their conditions and
    an else too, so an ``else if`` lies one deeper than its if); switch and ?: cost without nesting. Each && and || costs one."""

    def __init__(self, tokens: list[Token]):
        self.t = [x.text if x.kind in ("word", "op") else "" for x in tokens if x.kind != "comment"]
        self.i = self.cost = self.deepest = 0

    def at(self, ahead: int = 0) -> str | None:
        return self.t[self.i + ahead] if self.i + ahead < len(self.t) else None

    def enter(self, depth: int, nests: bool = True) -> int:
        self.cost += 1 + depth
        self.deepest = max(self.deepest, depth + nests)
        return depth + nests

    def block(self, depth: int) -> None:
        """From { to its }."""
        self.i += 1
        while self.at() is not None and self.at() != "}":
            self.statement(depth)
        self.i += 1

    def expression(self, depth: int, stops: str) -> None:
        """Up to one of stops outside brackets, which is left."""
        while self.at() is not None and self.at() not in tuple(stops):
            x = self.at()
            if x in ("(", "["):
                self.i += 1
                self.expression(depth, ")]")
                self.i += 1
            elif x == "{":
                self.block(depth)
            elif x in ("}", ")", "]"):
                return
            elif x == "->":
                self.i += 1
                self.deepest = max(self.deepest, depth + 1)
                if self.at() == "{":
                    self.block(depth + 1)
                else:
                    self.expression(depth + 1, stops + ",")
            elif x == "switch":
                self.switch(depth)
            else:
                wild = x == "?" and self.t[self.i - 1 : self.i] in (["<"], [","]) and self.at(1) in (">", ",", "extends", "super")
                if x == "?" and not wild:
                    self.enter(depth, False)
                self.cost += x in ("&&", "||")
                self.i += 1

    def parens(self, depth: int) -> None:
        if self.at() == "(":
            self.i += 1
            while self.at() is not None and self.at() != ")":
                self.expression(depth, ");")
                self.i += self.at() == ";"
                if self.at() in ("}", "]"):
                    return
            self.i += 1

    def switch(self, depth: int) -> None:
        self.i += 1
        self.enter(depth, False)
        self.parens(depth)
        if self.at() != "{":
            return
        self.i += 1
        while self.at() is not None and self.at() != "}":
            if self.at() in ("case", "default"):
                while self.at() is not None and self.at() not in (":", "->", "}"):
                    self.i += 1
                self.i += self.at() in (":", "->")
            else:
                self.statement(depth)
        self.i += 1

    def statement(self, depth: int) -> None:
        x = self.at()
        if x == "{":
            self.block(depth)
        elif x in ("if", "for", "while", "catch"):
            self.i += 1
            inner = self.enter(depth)
            self.parens(inner)
            self.statement(inner)
            if x == "if" and self.at() == "else":
                self.i += 1
                self.statement(inner)
        elif x == "do":
            self.i += 1
            inner = self.enter(depth)
            self.statement(inner)
            if self.at() == "while":
                self.i += 1
                self.parens(inner)
                self.i += self.at() == ";"
        elif x == "switch":
            self.switch(depth)
        elif x in ("try", "synchronized", "finally", "else"):
            self.i += 1
            self.parens(depth)
            self.statement(depth)
        elif x in TYPES:
            while self.at() is not None and self.at() not in ("{", ";"):
                self.i += 1
            if self.at() == "{":
                self.block(depth)
        else:
            self.expression(depth, ";")
            self.i += self.at() in (";", ")", "]")


def nesting(tokens: list[Token]) -> tuple[int, int]:
    """(deepest nesting, cognitive complexity) of a method's body."""
    walk = _Walk(tokens)
    while walk.at() is not None:
        before = walk.i
        walk.statement(0)
        walk.i += walk.i == before
    return walk.deepest, walk.cost


def halstead(tokens: list[Token]) -> dict[str, float]:
    """Operators are keywords and punctuation but closing brackets; operands names and literals."""
    ops = [x.text for x in tokens if x.kind == "op" and x.text not in ")]}" or x.kind == "word" and x.text in KEYWORDS]
    names = [x.text for x in tokens if x.kind in ("string", "number") or x.kind == "word" and x.text not in KEYWORDS]
    n1, n2, total = len(set(ops)), len(set(names)), len(ops) + len(names)
    volume = total * math.log2(n1 + n2) if n1 + n2 > 1 else 0.0
    difficulty = n1 / 2 * len(names) / n2 if n2 else 0.0
    return {"volume": volume, "difficulty": difficulty, "effort": volume * difficulty}


def statements(tokens: list[Token]) -> list[list[Token]]:
    """A body cut at semicolons and braces outside round brackets."""
    out, now, depth = [], [], 0
    for x in tokens:
        op = x.text if x.kind == "op" else ""
        depth += (op == "(") - (op == ")")
        if depth <= 0 and op in ("{", "}", ";"):
            if now:
                out.append(now)
            now = []
        else:
            now.append(x)
    return out + [now] if now else out


def normalized(statement: list[Token], names: dict[str, str]) -> str:
    """Literals to placeholders (0 and 1 stay), names to _v0, _v1, ... by first use in the method; ``names`` is filled on the way. A name before a bracket is a call and stays."""
    out = []
    for i, x in enumerate(statement):
        if x.kind == "string":
            out.append("_STR_")
        elif x.kind == "number":
            out.append(x.text if x.text in ("0", "1", "0.0", "1.0") else "_NUM_")
        elif x.kind == "word" and x.text[0].islower() and x.text not in KEYWORDS and not (i + 1 < len(statement) and statement[i + 1].text == "(") and not (i and statement[i - 1].text == "."):
            out.append(names.setdefault(x.text, f"_v{len(names)}"))
        else:
            out.append(x.text)
    return " ".join(out)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _explode(df: DataFrame, text: str, rows, fields: str) -> DataFrame:
    rest = [c for c in df.columns if c != text]
    kinds = dict(df.dtypes)
    names = [f.split()[0] for f in fields.split(", ")]

    def run(batches):
        for pdf in batches:
            found = [(i, *row) for i, source in enumerate(pdf[text]) for row in rows(source if isinstance(source, str) else "")]
            out = pd.DataFrame(found, columns=["__row", *names])
            kept = pdf[rest].iloc[out.pop("__row").astype(int)].reset_index(drop=True)
            yield pd.concat([kept, out], axis=1)

    return df.mapInPandas(run, ", ".join([*[f"`{c}` {kinds[c]}" for c in rest], fields]))


def method_metrics(df: DataFrame, text: str) -> DataFrame:
    """A row for each method: all columns of df but the text, then owner, name, parameters, start_line, end_line, loc, cyclomatic, cognitive, nesting, volume, difficulty, effort."""

    def rows(source: str):
        for m in methods(scan(source)):
            deepest, cognitive = nesting(m.tokens)
            h = halstead(m.tokens)
            yield m.owner, m.name, m.parameters, m.start, m.end, m.end - m.start + 1, cyclomatic(m.tokens), cognitive, deepest, h["volume"], h["difficulty"], h["effort"]

    return _explode(df, text, rows, "owner string, name string, parameters int, start_line int, end_line int, loc int, cyclomatic int, cognitive int, nesting int, volume double, difficulty double, effort double")


def statement_fingerprints(df: DataFrame, text: str) -> DataFrame:
    """A row for each statement of each method: owner, method, position, line, raw and normalized (SHA-256), method_hash (of the method's normalised hashes joined)."""

    def rows(source: str):
        for m in methods(scan(source)):
            names: dict[str, str] = {}
            found = [(s[0].line, sha(" ".join(x.text for x in s)), sha(normalized(s, names))) for s in statements(m.tokens)]
            whole = sha("|".join(f[2] for f in found))
            for i, (line, raw, norm) in enumerate(found):
                yield m.owner, m.name, i, line, raw, norm, whole

    return _explode(df, text, rows, "owner string, method string, position int, line int, raw string, normalized string, method_hash string")


def comments(df: DataFrame, text: str) -> DataFrame:
    """A row for each comment: line, comment."""
    return _explode(df, text, lambda source: ((x.line, x.text) for x in scan(source) if x.kind == "comment"), "line int, comment string")


def xml_elements(df: DataFrame, text: str) -> DataFrame:
    """A row for each element of XML layouts, in document order: position, depth, path (tags from the root), element (tag and attributes by name, without name spaces), normalized (ids and sizes masked) and its SHA-256. Malformed, null and empty texts give none."""

    def bare(name: str) -> str:
        return name.rsplit("}", 1)[-1]

    def masked(value: str) -> str:
        value = re.sub(r"^@\+?id/.*", "@id/_ID_", value, flags=re.S)
        return re.sub(r"^-?\d+(?:\.\d+)?(?:dp|sp|px|dip|pt)$", "_DIM_", value)

    def rows(source: str):
        try:
            root = ET.fromstring(source)
        except ET.ParseError:
            return
        stack, i = [(root, ())], 0
        while stack:
            node, above = stack.pop()
            path = (*above, bare(node.tag))
            attributes = sorted((bare(k), v) for k, v in node.attrib.items())
            raw, norm = (" ".join([path[-1], *[f'{k}="{f(v)}"' for k, v in attributes]]) for f in (str, masked))
            yield i, len(above), "/".join(path), raw, norm, sha(norm)
            i += 1
            stack += [(child, path) for child in reversed(node) if isinstance(child.tag, str)]

    return _explode(df, text, rows, "position int, depth int, path string, element string, normalized string, fingerprint string")


def complexity_findings(metrics: DataFrame, limits: dict[str, tuple[float, float]]) -> DataFrame:
    """A row for each measure above its warning limit: kind, severity, value; critical above the second limit. Both limits are strict."""

    def one(kind: str, warn: float, critical: float) -> Column:
        v = F.col(kind).cast("double")
        return F.when(v > warn, F.struct(F.lit(kind).alias("kind"), F.when(v > critical, "CRITICAL").otherwise("WARNING").alias("severity"), v.alias("value")))

    found = F.filter(F.array(*[one(k, *w) for k, w in limits.items()]), lambda f: f.isNotNull())
    return metrics.select("*", F.explode(found).alias("f")).select(*metrics.columns, "f.kind", "f.severity", "f.value")
