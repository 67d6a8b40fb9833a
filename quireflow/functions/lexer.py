"""Bytes to values: a tokenizer for the object syntax of page-description files. No Spark in here.

One compiled pattern finds the next token, so most of the work is done by the regex engine. Values
are Python's own: None, bool, int, float, bytes (strings), :class:`Name`, list, dict with bytes keys,
:class:`Ref`. What a caller does not ask for is kept as a slice and parsed later
(:func:`raw_dictionary`).
"""

from __future__ import annotations

import re
from typing import NamedTuple

WS = rb"\x00\t\n\x0c\r "
_DELIM = rb"()<>\[\]{}/%"
_SKIP = re.compile(rb"(?:[" + WS + rb"]++|%[^\r\n]*+)*+")
_NEXT = rb"(?=[" + WS + _DELIM + rb"]|$)"
#: The next token behind white space and comments; a reference is one token.
_TOKEN = re.compile(
    rb"(?:[" + WS + rb"]++|%[^\r\n]*+)*+(?:"  # possessive: nothing is tried twice
    rb"(?P<ref>(\d++)[" + WS + rb"]++(\d++)[" + WS + rb"]++R" + _NEXT + rb")"
    rb"|(?P<num>[+-]?(?:\d+\.?\d*|\.\d+)" + _NEXT + rb")"
    rb"|(?P<name>/[^" + WS + _DELIM + rb"]*)"
    rb"|(?P<dict><<)|(?P<hex><)|(?P<lit>\()|(?P<arr>\[)|(?P<end>>>|[\]>)}{])"
    rb"|(?P<word>[^" + WS + _DELIM + rb"]+))"
)
_LIT_STOP = re.compile(rb"[()\\\r]")
_HASH = re.compile(rb"#([0-9A-Fa-f]{2})")
_NEWLINE = re.compile(rb"\r\n?|\n")

# Single-letter escapes of literal strings.
ESCAPES = {0x6E: b"\n", 0x72: b"\r", 0x74: b"\t", 0x62: b"\x08", 0x66: b"\x0c", 0x28: b"(", 0x29: b")", 0x5C: b"\\"}


class SyntaxProblem(ValueError):
    """Bytes that are no value of the wanted kind."""


class Name(bytes):
    """A name, without its slash, escapes resolved."""


class Ref(NamedTuple):
    """A pointer to an indirect object."""

    obj: int
    gen: int


def skip(data: bytes, at: int) -> int:
    """The place behind white space and comments."""
    return _SKIP.match(data, at).end()  # type: ignore[union-attr]


def literal_string(data: bytes, at: int) -> tuple[bytes, int]:
    """(value, place behind) of a literal string whose parenthesis is at ``at``.

    Nested parentheses balance; a backslash before a line end joins lines, before up to three octal digits
    gives a byte (modulo 256), before anything unknown is dropped; a raw line end is one LF.
    """
    out, depth, i, n = [], 1, at + 1, len(data)
    while True:
        m = _LIT_STOP.search(data, i)
        if m is None:
            raise SyntaxProblem("unterminated string")
        out.append(data[i : m.start()])
        c, i = data[m.start()], m.end()
        if c == 0x28:
            depth += 1
            out.append(b"(")
        elif c == 0x29:
            depth -= 1
            if not depth:
                return b"".join(out), i
            out.append(b")")
        elif c == 0x0D:
            out.append(b"\n")
            i += data[i : i + 1] == b"\n"
        else:
            if i >= n:
                raise SyntaxProblem("unterminated string")
            e = data[i]
            if e in ESCAPES:
                out.append(ESCAPES[e])
                i += 1
            elif 0x30 <= e <= 0x37:
                j = i + 1
                while j < i + 3 and j < n and 0x30 <= data[j] <= 0x37:
                    j += 1
                out.append(bytes([int(data[i:j], 8) & 0xFF]))
                i = j
            elif e in b"\r\n":
                i = _NEWLINE.match(data, i).end()  # type: ignore[union-attr]


def hex_string(data: bytes, at: int) -> tuple[bytes, int]:
    """(value, place behind) of a hexadecimal string; white space inside is ignored, an odd last digit is a high nibble."""
    end = data.find(b">", at + 1)
    if end < 0:
        raise SyntaxProblem("unterminated hexadecimal string")
    digits = data[at + 1 : end].translate(None, b"\x00\t\n\x0c\r ")
    try:
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode("ascii")), end + 1
    except ValueError as e:
        raise SyntaxProblem("no hexadecimal string") from e


def name_value(token: bytes) -> Name:
    """The name of a token that begins with a slash."""
    return Name(_HASH.sub(lambda m: bytes([int(m[1], 16)]), token[1:]) if b"#" in token else token[1:])


def number(token: bytes) -> int | float:
    if len(token) > 300:
        raise SyntaxProblem("a number without end")
    return float(token) if b"." in token else int(token)


_WORDS = {b"true": True, b"false": False, b"null": None}


def value(data: bytes, at: int = 0) -> tuple[object, int]:
    """(value, place behind) of the next object, nested as deep as it is; a keyword that is none raises."""
    match = _TOKEN.match
    opened: list[list | dict] = []
    keys: list[bytes | None] = []
    inside: list | dict | None = None
    v: object
    while True:
        m = match(data, at)
        if m is None:
            raise SyntaxProblem("no value")
        kind, at = m.lastgroup, m.end()
        if kind == "name":
            token = m["name"]
            v = Name(token[1:]) if b"#" not in token else name_value(token)
            if inside.__class__ is dict and keys[-1] is None:
                keys[-1] = v
                continue
        elif kind == "end":
            if inside is None or m["end"] != (b"]" if inside.__class__ is list else b">>") or keys.pop() is not None:
                raise SyntaxProblem(f"no value: {m['end']!r}")
            v = opened.pop()
            inside = opened[-1] if opened else None
        elif inside.__class__ is dict and keys[-1] is None:
            raise SyntaxProblem("a key is no name")
        elif kind == "ref":
            v = Ref(int(m[2]), int(m[3]))
        elif kind == "num":
            v = number(m["num"])
        elif kind == "arr" or kind == "dict":
            inside = [] if kind == "arr" else {}
            opened.append(inside)
            keys.append(None)
            continue
        elif kind == "lit":
            v, at = literal_string(data, at - 1)
        elif kind == "hex":
            v, at = hex_string(data, at - 1)
        elif m["word"] in _WORDS:
            v = _WORDS[m["word"]]
        else:
            raise SyntaxProblem(f"no value: {m['word'][:20]!r}")
        if inside is None:
            return v, at
        if inside.__class__ is list:
            inside.append(v)  # type: ignore[union-attr]
        else:
            inside[keys[-1]] = v  # type: ignore[index]
            keys[-1] = None


_PLAIN_NAME = re.compile(rb"[^!$&'*-.0-;=?-Z^-z|~]")
_IN_LITERAL = re.compile(rb"[()\\\r]")


def syntax(v: object) -> bytes:
    """The syntax of a value: what :func:`value` reads back as the same."""
    if isinstance(v, Name):
        return b"/" + _PLAIN_NAME.sub(lambda m: b"#%02X" % m[0][0], v)
    if isinstance(v, bytes):
        return b"(" + _IN_LITERAL.sub(lambda m: b"\\r" if m[0] == b"\r" else b"\\" + m[0], v) + b")"
    if v is None or isinstance(v, bool):
        return {None: b"null", True: b"true", False: b"false"}[v]
    if isinstance(v, Ref):
        return b"%d %d R" % v
    if isinstance(v, int):
        return b"%d" % v
    if isinstance(v, float):
        return f"{v:.17f}".rstrip("0").encode()
    if isinstance(v, list):
        return b"[" + b" ".join(map(syntax, v)) + b"]"
    if isinstance(v, dict):
        return b"<<" + b" ".join(syntax(Name(k)) + b" " + syntax(x) for k, x in v.items()) + b">>"
    raise TypeError(f"no value: {type(v)}")


def extent(data: bytes, at: int) -> tuple[int, int]:
    """(begin, end) of the next value, without building it."""
    at = skip(data, at)
    _, end = value(data, at)
    return at, end


def raw_dictionary(data: bytes, at: int = 0) -> tuple[dict[bytes, bytes], int]:
    """A dictionary with its values as slices; of a repeated key the last value counts."""
    at = skip(data, at)
    if data[at : at + 2] != b"<<":
        raise SyntaxProblem("no dictionary")
    out: dict[bytes, bytes] = {}
    at += 2
    while True:
        at = skip(data, at)
        if data[at : at + 2] == b">>":
            return out, at + 2
        k = _TOKEN.match(data, at)
        if k is None or k.lastgroup != "name":
            raise SyntaxProblem("a key is no name")
        begin, at = extent(data, k.end())
        out[bytes(name_value(k["name"]))] = data[begin:at]


class Indirect(NamedTuple):
    """An indirect object: its id, the slice of its value, and for a stream where its bytes begin."""

    obj: int
    gen: int
    raw: bytes
    stream_at: int | None


_HEAD = re.compile(rb"(\d+)[" + WS + rb"]+(\d+)[" + WS + rb"]+obj")
_STREAM = re.compile(rb"stream(?:\r\n|\n|\r)")
_END = re.compile(rb"endobj(?=[" + WS + _DELIM + rb"]|$)")


def indirect_value(data: bytes, at: int) -> tuple[Indirect, object]:
    """(indirect object, its value) at a place; white space behind ``obj`` and before ``endobj`` is optional."""
    m = _HEAD.match(data, skip(data, at))
    if m is None:
        raise SyntaxProblem("no indirect object")
    begin = skip(data, m.end())
    v, end = value(data, begin)
    behind = skip(data, end)
    s = _STREAM.match(data, behind) if isinstance(v, dict) else None
    if s is None and not _END.match(data, behind):
        raise SyntaxProblem("endobj is missing")
    return Indirect(int(m[1]), int(m[2]), data[begin:end], s.end() if s else None), v


def indirect(data: bytes, at: int) -> Indirect:
    """The indirect object at a place, without its value."""
    return indirect_value(data, at)[0]


def stream_bytes(data: bytes, at: int, length: object) -> bytes:
    """The undecoded bytes of a stream that begins at ``at``; with a wrong or unknown length, up to ``endstream``."""
    if isinstance(length, int) and not isinstance(length, bool) and length >= 0:
        behind = skip_space(data, at + length)
        if data[behind : behind + 9] == b"endstream":
            return data[at : at + length]
    end = data.find(b"endstream", at)
    if end < 0:
        raise SyntaxProblem("endstream is missing")
    body = data[at:end]
    return body[:-2] if body.endswith(b"\r\n") else body[:-1] if body[-1:] in (b"\n", b"\r") else body


def skip_space(data: bytes, at: int) -> int:
    n = len(data)
    while at < n and data[at] in WS_BYTES:
        at += 1
    return at


WS_BYTES = frozenset(b"\x00\t\n\x0c\r ")


# -- content streams ------------------------------------------------------------------------------

# The operators that are understood, with their category and the operands they take.
# n: number, N: name, s: string, a: array of strings and numbers.
OPERATORS: dict[bytes, tuple[str, str]] = {
    b"BT": ("delimiter", ""), b"ET": ("delimiter", ""),
    b"Tc": ("state", "n"), b"Tw": ("state", "n"), b"Tz": ("state", "n"), b"TL": ("state", "n"), b"Tf": ("state", "Nn"), b"Tr": ("state", "n"), b"Ts": ("state", "n"),
    b"Td": ("position", "nn"), b"TD": ("position", "nn"), b"Tm": ("position", "nnnnnn"), b"T*": ("position", ""),
    b"Tj": ("show", "s"), b"'": ("show", "s"), b'"': ("show", "nns"), b"TJ": ("show", "a"),
}
_IMAGE_END = re.compile(rb"[" + WS + rb"]EI(?=[" + WS + rb"]|$)")


class Operation(NamedTuple):
    """One operator of a content stream. ``error`` says why its operands do not fit."""

    op: str
    category: str
    nums: list[float] | None
    name: bytes | None
    text: bytes | None
    items: list[tuple[bytes | None, float | None]] | None
    raw: bytes
    error: str | None


def _operation(token: bytes, operands: list[object], raw: bytes, more: dict[bytes, tuple[str, str]] | None = None) -> Operation:
    op = token.decode("latin-1")
    known = OPERATORS.get(token) or (more.get(token) if more else None)
    if known is None:
        return Operation(op, "unimplemented", None, None, None, None, raw, None)
    category, wanted = known
    given = operands[-len(wanted) :] if wanted else []
    nums: list[float] = []
    name = text = items = None
    fits = len(given) == len(wanted)
    for want, v in zip(wanted, given, strict=False):
        if want == "n" and isinstance(v, (int, float)) and not isinstance(v, bool):
            nums.append(float(v))
        elif want == "N" and isinstance(v, Name):
            name = bytes(v)
        elif want == "s" and isinstance(v, bytes) and not isinstance(v, Name):
            text = v
        elif want == "a" and isinstance(v, list):
            items = [(x, None) if isinstance(x, bytes) and not isinstance(x, Name) else (None, float(x)) for x in v if isinstance(x, (bytes, int, float)) and not isinstance(x, Name)]
        else:
            fits = False
    if token == b"Tr" and nums and (nums[0] not in range(8)):
        fits = False
    return Operation(op, category, nums or None, name, text, items, raw, None if fits else "operands do not fit")


def operations(data: bytes, more: dict[bytes, tuple[str, str]] | None = None) -> tuple[list[Operation], int]:
    """(operators in order, place where reading stopped). Everything was read if that is the end of the data.

    ``more`` holds further operators with their category and operands, as OPERATORS does. Comments count as white space; an inline image is one operator, its bytes are not read as operators.
    """
    out: list[Operation] = []
    operands: list[object] = []
    at = begin = skip(data, 0)
    n, match = len(data), _TOKEN.match
    while at < n:
        m = match(data, at)
        if m is None:
            break
        kind = m.lastgroup
        if kind == "num" and len(m["num"]) <= 300:
            operands.append(number(m["num"]))
            at = m.end()
        elif kind == "name":
            operands.append(name_value(m["name"]))
            at = m.end()
        elif kind == "word" and m["word"] not in _WORDS:
            at = m.end()
            if m["word"] == b"BI":
                at = _image(data, at)
                out.append(Operation("BI", "unimplemented", None, None, None, None, data[begin:at], None))
            else:
                out.append(_operation(m["word"], operands, data[begin:at], more))
            operands = []
            at = begin = skip(data, at)
        elif kind == "lit":
            try:
                v, at = literal_string(data, m.end() - 1)
            except SyntaxProblem:
                break
            operands.append(v)
        else:
            try:
                v, at = value(data, at)
            except SyntaxProblem:
                break
            operands.append(v)
    at = skip(data, at)
    return out, begin if at < n or operands else n


def _image(data: bytes, at: int) -> int:
    """The place behind an inline image whose BI ends at ``at``."""
    start = re.compile(rb"[" + WS + rb"]ID[" + WS + rb"]").search(data, at - 1)
    m = _IMAGE_END.search(data, start.end() - 1) if start else None
    return m.end() if m else len(data)
