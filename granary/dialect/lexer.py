"""Tokens of the dialect."""

from __future__ import annotations

import re
from dataclasses import dataclass


class DialectError(ValueError):
    """A statement that the dialect refuses, with a reason for people."""


@dataclass(frozen=True)
class Token:
    kind: str  # name, quoted, string, number, op, var, sysvar, end
    text: str
    start: int
    stop: int

    @property
    def word(self) -> str:
        return self.text.upper() if self.kind == "name" else ""


PATTERN = re.compile(
    r"""(?P<space>\s+|--(?=\s|$)[^\n]*|\#[^\n]*|/\*(?!!).*?\*/)
    |(?P<hint>/\*!\d*|\*/)
    |(?P<hex>0[xX][0-9a-fA-F]+|[xX]'[0-9a-fA-F]*')
    |(?P<number>(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)
    |(?P<string>'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.|"")*")
    |(?P<quoted>`(?:[^`]|``)*`)
    |(?P<sysvar>@@(?:global\.|session\.)?\w+)
    |(?P<var>@(?:\w+|'[^']*'))
    |(?P<name>[^\W\d]\w*)
    |(?P<op><=>|->>|->|<<|>>|<=|>=|<>|!=|:=|&&|\|\||[-+*/%^&|~!=<>(),.;?{}:@])""",
    re.X | re.S,
)
# What a backslash and a letter stand for in a string. \% and \_ keep the backslash, for LIKE.
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0", "b": "\b", "Z": "\x1a", "%": "\\%", "_": "\\_"}


def unquote(text: str) -> str:
    mark, body = text[0], text[1:-1]
    return re.sub(rf"\\(.)|{mark}{mark}", lambda m: ESCAPES.get(m[1], m[1]) if m[1] else mark, body, flags=re.S)


def tokenize(sql: str) -> list[Token]:
    """Tokens with their places; comments go, version comments count as their content, adjacent strings are joined."""
    out: list[Token] = []
    at = 0
    while at < len(sql):
        m = PATTERN.match(sql, at)
        if not m:
            raise DialectError(f"Unexpected {sql[at]!r} at character {at + 1}")
        kind, text, at = m.lastgroup, m[0], m.end()
        if kind in ("space", "hint"):
            continue
        if kind == "string":
            text = unquote(text)
            if out and out[-1].kind == "string":
                last = out.pop()
                out.append(Token("string", last.text + text, last.start, at))
                continue
        elif kind == "quoted":
            text = text[1:-1].replace("``", "`")
        elif kind == "hex":
            digits = text[2:] if text[0] == "0" else text[2:-1]
            kind, text = ("number", str(int(digits, 16))) if text[0] == "0" else ("string", bytes.fromhex(digits).decode("utf-8", "replace"))
        elif kind == "var":
            text = text[1:].strip("'")
        elif kind == "sysvar":
            text = text[2:].rpartition(".")[2]
        out.append(Token(kind, text, m.start(), at))
    out.append(Token("end", "", len(sql), len(sql)))
    return out
