"""Tokens of the dialect."""

from __future__ import annotations

import re
from dataclasses import dataclass

from tallyhouse.refusal import Refused

_TOKEN = re.compile(
    r"""\s+|--[^\n]*|/\*.*?\*/
    |(?P<num>\d+(?:\.\d+)?)
    |(?P<str>'(?:[^']|'')*')
    |(?P<quoted>"[^"]+"|`[^`]+`)
    |(?P<word>[A-Za-z_][A-Za-z0-9_]*)
    |(?P<op><=|>=|!=|<>|=>|->|[-+*/%(),.=<>;?\[\]])""",
    re.VERBOSE | re.DOTALL,
)


@dataclass(frozen=True)
class Token:
    kind: str  # num, str, word, quoted, op or end
    text: str
    start: int
    end: int

    @property
    def low(self) -> str:
        return self.text.lower() if self.kind == "word" else ""


def tokens(text: str) -> list[Token]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise Refused("parse_error", f"at {text[at : at + 20]!r}")
        if kind := m.lastgroup:
            body = m.group()
            body = body[1:-1].replace("''", "'") if kind == "str" else body[1:-1] if kind == "quoted" else body
            out.append(Token(kind, body, m.start(), m.end()))
        at = m.end()
    while out and out[-1].kind == "op" and out[-1].text == ";":
        out.pop()
    return [*out, Token("end", "", len(text), len(text))]
