"""Tokens of the dialect, with byte spans."""

from __future__ import annotations

import re
from dataclasses import dataclass

from tessel.errors import Kind, Span, SqlError
from tessel.types import INT_MAX

#: Fixed words of the dialect; anything else, and any quoted word, is a name.
KEYWORDS = frozenset(
    """AND AS ASC BEGIN BOOL BY BYTES COMMIT COUNT CREATE DELETE DESC EXPLAIN FALSE FROM GROUP INDEX INNER INSERT INT64
    INTO IS JOIN KEY LIMIT MAX MIN NOT NULL ON OR ORDER PRIMARY ROLLBACK SELECT SET SUM TABLE TEXT TRANSACTION TRUE
    UNIQUE UPDATE VALUES WHERE""".split()
)

_TOKEN = re.compile(
    r"""
    (?P<skip>\s+|--[^\n]*|/\*.*?\*/)
  | (?P<open_comment>/\*)
  | (?P<hex>[xX]'(?P<digits>[^']*)(?P<hex_end>'?))
  | (?P<text>'(?:[^']|'')*(?P<text_end>'?))
  | (?P<quoted>"(?:[^"]|"")*(?P<quoted_end>"?))
  | (?P<number>[0-9]+)
  | (?P<word>[A-Za-z_][A-Za-z0-9_]*)
  | (?P<op><>|!=|<=|>=|[=<>(),;.*?-])
    """,
    re.VERBOSE | re.DOTALL,
)


@dataclass(frozen=True)
class Token:
    kind: str  # keyword, name, literal, op, end
    value: object
    span: Span
    quoted: bool = False

    def __str__(self) -> str:
        return "end of input" if self.kind == "end" else f"`{self.value}`"


def lex(sql: str) -> list[Token]:
    ascii_ = sql.isascii()
    byte = (lambda i: i) if ascii_ else _byte_offsets(sql).__getitem__
    out: list[Token] = []
    at = 0

    def fail(message: str, start: int, end: int) -> SqlError:
        return SqlError(Kind.LEX, message, Span(byte(start), byte(end)))

    while at < len(sql):
        m = _TOKEN.match(sql, at)
        if m is None:
            raise fail(f"unexpected character {sql[at]!r}", at, at + 1)
        at = m.end()
        span, kind = Span(byte(m.start()), byte(at)), m.lastgroup
        if m["skip"] is not None:
            continue
        if m["open_comment"] is not None:
            raise fail("comment is not closed", m.start(), len(sql))
        if m["hex"] is not None:
            if not m["hex_end"]:
                raise fail("bytes literal is not closed", m.start(), at)
            if len(m["digits"]) % 2 or not re.fullmatch("[0-9a-fA-F]*", m["digits"]):
                raise fail("bytes literal needs an even number of hex digits", m.start(), at)
            out.append(Token("literal", bytes.fromhex(m["digits"]), span))
        elif m["text"] is not None:
            if not m["text_end"] or len(m["text"]) == 1:
                raise fail("text literal is not closed", m.start(), at)
            out.append(Token("literal", m["text"][1:-1].replace("''", "'"), span))
        elif m["quoted"] is not None:
            name = m["quoted"][1:-1].replace('""', '"')
            if not m["quoted_end"] or len(m["quoted"]) == 1:
                raise fail("quoted name is not closed", m.start(), at)
            if not name:
                raise fail("quoted name is empty", m.start(), at)
            out.append(Token("name", name, span, quoted=True))
        elif m["number"] is not None:
            if int(m["number"]) > INT_MAX:
                raise fail("integer literal is out of the range of INT64", m.start(), at)
            out.append(Token("literal", int(m["number"]), span))
        elif m["word"] is not None:
            upper = m["word"].upper()
            out.append(Token("keyword", upper, span) if upper in KEYWORDS else Token("name", m["word"], span))
        else:
            out.append(Token("op", "<>" if m["op"] == "!=" else m["op"], span))
        assert kind
    end = byte(len(sql))
    out.append(Token("end", None, Span(end, end)))
    return out


def _byte_offsets(sql: str) -> list[int]:
    out, n = [], 0
    for c in sql:
        out.append(n)
        n += len(c.encode("utf-8", "surrogatepass"))
    return [*out, n]
