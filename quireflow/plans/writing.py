"""Writing page-description syntax: how the queries turn columns into bytes to be read again.

The expressions here are built-in ones; whole files are written by an Arrow-batched function. Nothing
is shared with the readers, so a mistake on one side shows.
"""

from __future__ import annotations

import zlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def raw(c: Column) -> Column:
    """Text of one character a byte, as bytes."""
    return F.encode(c, "ISO-8859-1")


def string_bytes(c: Column) -> Column:
    """The bytes of a text string: Latin-1 where it can be and is not taken for UTF-16, else UTF-16 behind its mark."""
    narrow = c.rlike(r"^[\x00-\xff]*$") & ~c.startswith("þÿ")
    return F.when(narrow, F.encode(F.regexp_replace(c, r"[^\x00-\xff]", "?"), "ISO-8859-1")).otherwise(F.concat(F.unhex(F.lit("FEFF")), F.encode(c, "UTF-16BE")))


def literal(c: Column) -> Column:
    """Bytes as a literal string, as text of one character a byte: special characters escaped, octal for some."""
    s = F.decode(c, "ISO-8859-1")
    s = F.regexp_replace(s, r"([\\()])", r"\\$1")
    s = F.regexp_replace(F.regexp_replace(s, "\r", r"\\r"), "\n", r"\\n")
    return F.concat(F.lit("("), F.regexp_replace(s, "\t", r"\\011"), F.lit(")"))


def hexadecimal(c: Column) -> Column:
    """Bytes as a hexadecimal string; a last zero nibble is left out."""
    return F.concat(F.lit("<"), F.regexp_replace(F.hex(c), "^((?:..)*.)0$", "$1"), F.lit(">"))


def big_endian(c: Column, width: int) -> Column:
    return F.unhex(F.lpad(F.hex(c.cast("bigint")), 2 * width, "0"))


def deflate(c: Column) -> Column:
    return F.udf(lambda b: None if b is None else zlib.compress(bytes(b)), "binary", useArrow=True)(c)


def _escaped(s: str) -> bytes:
    b = s.encode("latin-1") if all(ord(ch) < 256 for ch in s) else b"\xfe\xff" + s.encode("utf-16-be")
    return b"(" + b.replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)").replace(b"\r", b"\\r") + b")"


def document(objects: dict[int, bytes], streams: dict[int, tuple[bytes, bytes]], root: int, packed: bool) -> bytes:
    """A file of objects (number to value) and streams (number to dictionary entries and content).

    Unpacked files have a classic table; packed ones keep their objects in an object stream, their
    cross-reference in a stream with a predictor, and deflate everything.
    """
    out = bytearray(b"%PDF-1.7\n%\xe2\xe3\xcf\xd3\n")
    at: dict[int, int] = {}

    def put(number: int, body: bytes) -> None:
        at[number] = len(out)
        out.extend(b"%d 0 obj\n%s\nendobj\n" % (number, body))

    for number, (entries, content) in streams.items():
        data = zlib.compress(content) if packed else content
        flate = b"/Filter/FlateDecode" if packed else b""
        put(number, b"<<%s%s/Length %d>>stream\n%s\nendstream" % (entries, flate, len(data), data))
    top = max([*objects, *streams]) + 1
    ids = b"/ID[<00><01>]" if packed else b"/ID[(a)(a)]"
    if not packed:
        for number, body in objects.items():
            put(number, body)
        start = len(out)
        out.extend(b"xref\n0 1\n0000000000 65535 f \n")
        for number in sorted(at):
            out.extend(b"%d 1\n%010d 00000 n \n" % (number, at[number]))
        out.extend(b"trailer\n<</Size %d/Root %d 0 R%s>>\n" % (top, root, ids))
    else:
        head, body = b"", b""
        for number, value in objects.items():
            head += b"%d %d " % (number, len(body))
            body += value + b" "
        data = zlib.compress(head + body)
        put(top, b"<</Type/ObjStm/N %d/First %d/Filter/FlateDecode/Length %d>>stream\n%s\nendstream" % (len(objects), len(head), len(data), data))
        start = len(out)
        place = {n: i for i, n in enumerate(objects)}
        rows = []
        for number in range(top + 2):
            if number in place:
                rows.append(b"\x02" + top.to_bytes(4) + place[number].to_bytes(2))
            else:
                spot = start if number == top + 1 else at.get(number)
                rows.append(b"\x00" + bytes(6) if spot is None else b"\x01" + spot.to_bytes(4) + bytes(2))
        above, table = bytes(7), b""
        for row in rows:
            table += b"\x02" + bytes((a - b) & 255 for a, b in zip(row, above, strict=True))
            above = row
        data = zlib.compress(table)
        out.extend(b"%d 0 obj<</Type/XRef/W[1 4 2]/Size %d/Root %d 0 R%s/Filter/FlateDecode/DecodeParms<</Predictor 12/Columns 7>>/Length %d>>stream\n%s\nendstream\nendobj\n" % (top + 1, top + 2, root, ids, len(data), data))
    out.extend(b"startxref\n%d\n%%%%EOF\n" % start)
    return bytes(out)


def customer_file(nation: int, people: list[tuple[int, str, str]]) -> bytes:
    """A file with a page for each (key, name, segment): a tree node for each segment, sizes and rotations
    inherited unless the key is divisible by three, a name and a segment shown on every page."""
    objects: dict[int, bytes] = {1: b"<</Type/Catalog/Pages 2 0 R/PageLayout/TwoColumnLeft>>", 3: b"<</Font<</F1 4 0 R>>>>", 4: b"<</Type/Font/BaseFont/Helvetica>>"}
    streams: dict[int, tuple[bytes, bytes]] = {}
    segments = sorted({s for _, _, s in people})
    number = 5
    nodes = []
    for segment in segments:
        node, number = number, number + 1
        nodes.append(node)
        kids = []
        for key, name, _ in sorted(p for p in people if p[2] == segment):
            page, content, number = number, number + 1, number + 2
            own = b"/MediaBox[0 0 %d 100.5]" % (key % 1000 + 1) if key % 3 == 0 else b""
            objects[page] = b"<</Type/Page/Parent %d 0 R%s/Contents %s>>" % (node, own, b"%d 0 R" % content if key % 2 else b"[%d 0 R]" % content)
            kids.append(b"%d 0 R" % page)
            streams[content] = (b"", b"BT /F1 %d Tf 1 0 0 1 %d.25 700 Tm %s Tj 0 -12.5 Td [%s -250 (x)] TJ ET" % (key % 5 + 8, key % 500, _escaped(name), _escaped(segment)))
        objects[node] = b"<</Type/Pages/Kids[%s]/Count %d/Rotate %d>>" % (b" ".join(kids), len(kids), 90 * (segments.index(segment) % 4))
    objects[2] = b"<</Type/Pages/Kids[%s]/MediaBox[0 0 %d 792]/Resources 3 0 R>>" % (b" ".join(b"%d 0 R" % n for n in nodes), 600 + nation)
    return document(objects, streams, 1, nation % 2 == 1)


def indirect(number: int, body: bytes) -> bytes:
    return b"%d 0 obj\n%s\nendobj\n" % (number, body)


def stream(content: bytes, length: bytes | None = None, more: bytes = b"") -> bytes:
    return b"<<%s/Length %s>>stream\n%s\nendstream" % (more, length or b"%d" % len(content), content)


def revision(before: bytes, objects: dict[int, bytes], freed: dict[int, int], prev: int | None, root: int = 1) -> tuple[bytes, int]:
    """(file, place of its newest section): a revision with a classic table behind ``before``; freed objects have the next generation."""
    out, at = bytearray(before), {}
    for number, body in objects.items():
        at[number] = len(out)
        out += indirect(number, body)
    start = len(out)
    out += b"xref\n" + b"".join(b"%d 1\n%010d 00000 n \n" % (n, a) for n, a in at.items()) + b"".join(b"%d 1\n0000000000 %05d f \n" % x for x in freed.items())
    out += b"trailer\n<</Size %d/Root %d 0 R%s>>\nstartxref\n%d\n%%%%EOF\n" % (max([*objects, *freed]) + 1, root, b"" if prev is None else b"/Prev %d" % prev, start)
    return bytes(out), start


def revised_file(key: int, name: str) -> bytes:
    """Three revisions: a page that says the name; then another content for even keys, and object 9 freed; then an object more."""
    say = lambda s: stream(b"BT /F1 1 Tf %s Tj ET" % _escaped(s), b"8 0 R")
    first = {1: b"<</Type/Catalog/Pages 2 0 R>>", 2: b"<</Type/Pages/Kids[3 0 R]>>", 3: b"<</Type/Page/Contents 4 0 R>>", 4: say(name), 8: b"%d" % len(b"BT /F1 1 Tf %s Tj ET" % _escaped(name)), 9: b"(old)"}
    out, at = revision(b"%PDF-1.4\n", first, {}, None)
    second = {4: say(name[::-1])} if key % 2 == 0 else {10: b"null"}
    out, at = revision(out, second, {9: 1}, at)
    return revision(out, {11: b"/Last"}, {}, at)[0]


def damaged_file(key: int, name: str) -> bytes:
    """By key modulo five: whole, without a catalog, without its end, with a ring of sections, with a content that can't be decoded."""
    kind = key % 5
    tree = {1: b"<</Type/Catalog/Pages 2 0 R>>", 2: b"<</Type/Pages/Kids[3 0 R 5 0 R]>>", 3: b"<</Type/Page/Contents 4 0 R>>", 4: stream(b"BT /F1 1 Tf %s Tj ET" % _escaped(name), None, b"/Filter/LZWDecode" if kind == 4 else b"")}
    if kind == 1:
        del tree[1]
    out, start = revision(b"%PDF-1.4\n", tree, {}, None)
    return out[: start + 20] if kind == 2 else revision(out, {6: b"null"}, {}, len(out) + len(indirect(6, b"null")))[0] if kind == 3 else out


def extended_file(key: int, name: str) -> bytes:
    """An object stream that extends another: the page tree is found through the younger one; a stream for the cross-reference."""
    out, at = bytearray(b"%PDF-1.5\n"), {}

    def put(number: int, body: bytes) -> None:
        at[number] = len(out)
        out.extend(indirect(number, body))

    def pack(objects: dict[int, bytes], more: bytes) -> bytes:
        head, body = b"", b""
        for n, v in objects.items():
            head += b"%d %d " % (n, len(body))
            body += v + b" "
        return stream(head + body, None, b"/Type/ObjStm/N %d/First %d%s" % (len(objects), len(head), more))

    put(4, stream(b"BT /F1 1 Tf %s Tj ET" % _escaped(name), b"7 0 R"))
    put(7, b"%d" % len(b"BT /F1 1 Tf %s Tj ET" % _escaped(name)))
    put(20, pack({2: b"<</Type/Pages/Kids[3 0 R]/MediaBox[0 0 %d 9]>>" % (key % 100 + 1), 3: b"<</Type/Page/Contents 4 0 R>>"}, b""))
    put(21, pack({1: b"<</Type/Catalog/Pages 2 0 R>>"}, b"/Extends 20 0 R"))
    start = len(out)
    rows = b""
    for number in range(23):
        spot = start if number == 22 else at.get(number)
        rows += b"\x02" + (21).to_bytes(4) + bytes(2) if number in (1, 2, 3) else b"\x00" + bytes(6) if spot is None else b"\x01" + spot.to_bytes(4) + bytes(2)
    out.extend(indirect(22, stream(rows, None, b"/Type/XRef/W[1 4 2]/Size 23/Root 1 0 R")))
    out.extend(b"startxref\n%d\n%%%%EOF\n" % start)
    return bytes(out)
