"""Tokens of the SQL dialect, with their places in the text, and the comments between them.

Catalyst drops comments and positions of what it rewrites, so the dialect layer works on tokens: it replaces those that Spark
does not accept and leaves the rest, white space and comments included, as they stand.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

#: Full-width punctuation and what it stands for outside strings.
FULL_WIDTH = {"，": ",", "；": ";", "（": "(", "）": ")"}

_LEX = re.compile(
    r"""
    (?P<hint>/\*\+.*?\*/)
  | (?P<comment>--[^\n]*|/\*.*?\*/)
  | (?P<space>\s+)
  | (?P<string>(?:_[A-Za-z][\w-]*\s*)?'(?:\\.|''|[^'\\])*'|(?:_[A-Za-z][\w-]*\s*)?"(?:\\.|""|[^"\\])*")
  | (?P<quoted>`(?:``|[^`])*`)
  | (?P<charset>_[A-Za-z][\w-]*\s+0[xX][0-9A-Fa-f]+)
  | (?P<param>\$\{[^}]*\})
  | (?P<size>\d+(?:\.\d+)?[bBkKmMgG](?![\w.]))
  | (?P<number>(?:\d+\.\d*|\.\d+|\d+)(?:[eE][+-]?\d+)?(?:BD|[LSYDFlsydf])?(?![\w]))
  | (?P<word>@{0,2}[^\W\d](?:\w|\$(?!\{))*)
  | (?P<op><=>|<>|!=|<=|>=|==|\|\||->|:=|::|[-+*/%&|^~!=<>.,;:()\[\]?@，；（）{}])
  | (?P<other>.)
    """,
    re.X | re.S,
)


@dataclass
class Token:
    kind: str
    text: str
    start: int
    stop: int

    @property
    def up(self) -> str:
        return self.text.upper() if self.kind == "word" else self.text


def tokenize(text: str) -> list[Token]:
    """All tokens, white space and comments too: their texts put together are the text."""
    return [Token(m.lastgroup, m.group(), m.start(), m.end()) for m in _LEX.finditer(text)]


def significant(tokens: list[Token]) -> list[Token]:
    return [t for t in tokens if t.kind not in ("space", "comment")]


def render(tokens: list[Token]) -> str:
    return "".join(t.text for t in tokens)


def split_statements(text: str) -> list[str]:
    """The statements of a script: cut at ; outside strings, comments and BEGIN ... END blocks."""
    out, now, depth = [], [], 0
    tokens = tokenize(text)
    for k, t in enumerate(tokens):
        if t.up == "BEGIN":
            depth += 1
        elif t.up == "END" and depth and not _ends_case(tokens, k) and _word_after(tokens, k) not in ("IF", "LOOP", "WHILE", "CASE", "FOR", "REPEAT"):
            depth -= 1
        if t.kind == "op" and FULL_WIDTH.get(t.text, t.text) == ";" and not depth:
            out.append(render(now))
            now = []
        else:
            now.append(t)
    out.append(render(now))
    return [s.strip() for s in out if any(t.kind not in ("space", "comment") for t in tokenize(s))]


def _word_after(tokens: list[Token], at: int) -> str:
    return next((t.up for t in tokens[at + 1 :] if t.kind not in ("space", "comment")), "")


def _ends_case(tokens: list[Token], at: int) -> bool:
    open_ = 0
    for t in tokens[:at]:
        open_ += (t.up == "CASE") - (t.up == "END" and open_ > 0)
    return open_ > 0


def closing(tokens: list[Token], at: int) -> int:
    """The index of the bracket that closes the one at ``at``."""
    depth = 0
    for k in range(at, len(tokens)):
        if tokens[k].kind == "op":
            depth += (tokens[k].text in "([{") - (tokens[k].text in ")]}")
            if not depth:
                return k
    raise ValueError(f"unclosed bracket at {tokens[at].start}")


def opening(tokens: list[Token], at: int) -> int:
    """The index of the bracket that the one at ``at`` closes."""
    depth = 0
    for k in range(at, -1, -1):
        if tokens[k].kind == "op":
            depth += (tokens[k].text in ")]}") - (tokens[k].text in "([{")
            if not depth:
                return k
    raise ValueError(f"unopened bracket at {tokens[at].start}")
