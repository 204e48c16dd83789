"""Tokens of the query language."""

from __future__ import annotations

import re
from dataclasses import dataclass


class SyntaxFault(ValueError):
    """The text isn't a statement of the language."""


@dataclass(frozen=True)
class Token:
    kind: str  # word, name (quoted), string, bytes, int, float, param, punct, end
    text: str
    at: int

    @property
    def upper(self) -> str:
        return self.text.upper() if self.kind == "word" else ""


_TOKEN = re.compile(
    r"""(?P<space>\s+|--[^\n]*|//[^\n]*|/\*.*?\*/)
    |(?P<bytes>[xX]'[0-9a-fA-F\s]*')
    |(?P<float>(?:\d[\d_]*\.\d+|\.\d+)(?:[eE][+-]?\d+)?[fFdDmM]?\b|\d[\d_]*[eE][+-]?\d+[fFdDmM]?\b)
    |(?P<int>0[xX][0-9a-fA-F_]+|0[oO][0-7_]+|0[bB][01_]+|\d[\d_]*)
    |(?P<param>\$\w+)
    |(?P<word>[^\W\d]\w*)
    |(?P<string>'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.|"")*")
    |(?P<name>`(?:[^`]|``)*`)
    |(?P<punct>\|\+\||\|\||<>|!=|<=|>=|::|[-+*/%<>=~(){}\[\],.;:|&!?@])""",
    re.X | re.S,
)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}


def _unescape(body: str, quote: str) -> str:
    body = body.replace(quote * 2, quote)
    return re.sub(r"\\(?:u([0-9a-fA-F]{4})|U([0-9a-fA-F]{6})|(.))", lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else _ESCAPES.get(m[3], m[3]), body, flags=re.S)


def tokenize(text: str) -> list[Token]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise SyntaxFault(f"unexpected character {text[at]!r} at {at}")
        kind, raw = m.lastgroup, m.group()
        if kind == "string":
            out.append(Token(kind, _unescape(raw[1:-1], raw[0]), at))
        elif kind == "name":
            out.append(Token(kind, raw[1:-1].replace("``", "`"), at))
        elif kind != "space":
            out.append(Token(kind, raw, at))
        at = m.end()
    out.append(Token("end", "", len(text)))
    return out
