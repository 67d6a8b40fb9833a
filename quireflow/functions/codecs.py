"""Decoding of stream bytes: filters by name, chains of them, and predictors."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np

from quireflow.functions.lexer import Name, SyntaxProblem

# Filters that exist; those without a decoder here are reported as unsupported.
KNOWN = ("ASCIIHexDecode", "ASCII85Decode", "LZWDecode", "FlateDecode", "RunLengthDecode", "CCITTFaxDecode", "JBIG2Decode", "DCTDecode", "JPXDecode", "Crypt")


#: Most bytes that one filter may inflate data to; beyond it the stream is an error, not a full worker.
INFLATED = 1 << 28


def unpredict(data: bytes, predictor: int, columns: int = 1, colors: int = 1, bits: int = 8) -> bytes:
    """Undo a row predictor: 1 none, 10 to 15 by row (each row names its own: none, left, up, average, Paeth)."""
    if predictor < 2:
        return data
    if predictor < 10:
        raise SyntaxProblem(f"unsupported predictor {predictor}")
    step, width = max(1, colors * bits // 8), (columns * colors * bits + 7) // 8
    out, above = bytearray(), np.zeros(width, np.uint8)
    for at in range(0, len(data), width + 1):
        kind, row = data[at], np.frombuffer(data, np.uint8, min(width, len(data) - at - 1), at + 1).copy()
        up = above[: len(row)]
        if kind == 2:
            row += up
        elif kind == 1:
            for i in range(step):
                row[i::step] = np.cumsum(row[i::step], dtype=np.uint8)
        elif kind in (3, 4):
            for i in range(len(row)):
                a, b, c = (int(row[i - step]), int(up[i]), int(up[i - step])) if i >= step else (0, int(up[i]), 0)
                row[i] = (int(row[i]) + ((a + b) // 2 if kind == 3 else _paeth(a, b, c))) & 0xFF
        elif kind:
            raise SyntaxProblem(f"unsupported row filter {kind}")
        out += row.tobytes()
        above = np.zeros(width, np.uint8)
        above[: len(row)] = row
    return bytes(out)


def _paeth(left: int, up: int, corner: int) -> int:
    """Of the three neighbours the one closest to left + up - corner, in this order on ties."""
    want = left + up - corner
    return min((left, up, corner), key=lambda x: abs(want - x))


def _inflate(data: bytes, most: int) -> bytes:
    if not data:
        return b""
    unpack = zlib.decompressobj()
    try:
        plain = unpack.decompress(data, most)
    except zlib.error as e:
        raise SyntaxProblem(f"FlateDecode: {e}") from e
    if not unpack.eof:
        raise SyntaxProblem(f"FlateDecode: more than {most} bytes" if len(plain) == most else "FlateDecode: incomplete data")
    return plain


def _flate(data: bytes, parms: dict[bytes, object]) -> bytes:
    plain = _inflate(data, INFLATED)
    number = lambda k, d: v if isinstance(v := parms.get(k), int) else d
    return unpredict(plain, number(b"Predictor", 1), number(b"Columns", 1), number(b"Colors", 1), number(b"BitsPerComponent", 8))


Decoder = Callable[[bytes, dict[bytes, object]], bytes]
DECODERS: dict[str, Callable[[bytes, dict[bytes, object]], bytes]] = {"FlateDecode": _flate}


def decode(data: bytes, filters: object, parms: object = None, more: dict[str, Decoder] | None = None) -> bytes:
    """``data`` through a filter or a list of filters, left to right; an unknown or unsupported one raises.

    ``more`` holds further decoders by filter name, which go before the built-in ones."""
    chain = [] if filters is None else filters if isinstance(filters, list) else [filters]
    settings = parms if isinstance(parms, list) else [parms] * len(chain)
    for i, f in enumerate(chain):
        name = f.decode("latin-1") if isinstance(f, Name) else str(f)
        decoder = (more or {}).get(name) or DECODERS.get(name)
        if decoder is None:
            raise SyntaxProblem(f"unsupported filter {name}" if name in KNOWN else f"unknown filter {name}")
        own = settings[i] if i < len(settings) else None
        data = decoder(data, own if isinstance(own, dict) else {})
    return data
