"""A file's structure: startxref, cross-reference sections, objects, object streams. No Spark in here.

Each function takes the bytes of one file once; nothing raises for a malformed file, problems come
back as text beside what could be read.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from quireflow.functions import codecs, lexer
from quireflow.functions.lexer import Name, Ref, SyntaxProblem

_STARTXREF = re.compile(rb"startxref[\x00\t\n\x0c\r ]+(\d+)")
_ENTRY = re.compile(rb"(\d{10}) (\d{5}) ([nf])(?: \n| \r|\r\n|\n|\r)?")
_SUBSECTION = re.compile(rb"[\x00\t\n\x0c\r ]*(\d+) (\d+)[\x00\t\n\x0c\r ]*")


class Entry(NamedTuple):
    """Where an object is; kinds are plain, compressed and free."""

    obj: int
    gen: int
    kind: str
    offset: int | None
    stream_id: int | None
    idx: int | None


class Section(NamedTuple):
    """One revision of the cross-reference, section_ord 0 being the newest."""

    section_ord: int
    offset: int
    kind: str
    prev: int | None
    size: int | None
    root: Ref | None
    id_creation: bytes | None
    id_modification: bytes | None
    entries: list[Entry]


def start_offset(data: bytes) -> int | None:
    """The last startxref of the final 1024 bytes."""
    found = _STARTXREF.findall(data[-1024:])
    return int(found[-1]) if found else None


def table_entries(data: bytes, at: int) -> tuple[list[Entry], int]:
    """The entries of a classic table whose subsections begin at ``at``, free ones included, and the place behind."""
    out: list[Entry] = []
    while m := _SUBSECTION.match(data, at):
        first, n = int(m[1]), int(m[2])
        at = m.end()
        for i in range(n):
            e = _ENTRY.match(data, at)
            if e is None:
                raise SyntaxProblem("no cross-reference entry")
            out.append(Entry(first + i, int(e[2]), "plain" if e[3] == b"n" else "free", int(e[1]), None, None))
            at = e.end()
    return out, at


def stream_entries(data: bytes, widths: list[int], index: list[int]) -> list[Entry]:
    """The entries of a cross-reference stream: fixed-width big-endian fields; a type of width 0 is 1, unknown types are left out."""
    if len(widths) != 3 or any(not isinstance(w, int) or w < 0 for w in widths) or widths[1] == 0:
        raise SyntaxProblem("bad field widths")
    a, b, c = widths
    out: list[Entry] = []
    at = 0
    for first, n in zip(index[::2], index[1::2], strict=False):
        for obj in range(first, first + n):
            if at + a + b + c > len(data):
                return out
            kind = int.from_bytes(data[at : at + a]) if a else 1
            x, y = int.from_bytes(data[at + a : at + a + b]), int.from_bytes(data[at + a + b : at + a + b + c])
            at += a + b + c
            if kind == 0:
                out.append(Entry(obj, y, "free", x, None, None))
            elif kind == 1:
                out.append(Entry(obj, y, "plain", x, None, None))
            elif kind == 2:
                out.append(Entry(obj, 0, "compressed", None, x, y))
    return out


def _section(data: bytes, at: int, order: int) -> Section:
    at = lexer.skip(data, at)
    if data[at : at + 4] == b"xref":
        entries, behind = table_entries(data, at + 4)
        behind = lexer.skip(data, behind)
        if data[behind : behind + 7] != b"trailer":
            raise SyntaxProblem("trailer is missing")
        trailer, _ = lexer.value(data, behind + 7)
        kind = "table"
    else:
        found, trailer = lexer.indirect_value(data, at)
        if found.stream_at is None or not isinstance(trailer, dict):
            raise SyntaxProblem("no cross-reference section")
        plain = codecs.decode(lexer.stream_bytes(data, found.stream_at, trailer.get(b"Length")), trailer.get(b"Filter"), trailer.get(b"DecodeParms"))
        entries = stream_entries(plain, trailer.get(b"W") or [], trailer.get(b"Index") or [0, trailer.get(b"Size") or 0])  # type: ignore[arg-type]
        kind = "stream"
    if not isinstance(trailer, dict):
        raise SyntaxProblem("the trailer is no dictionary")
    ids = trailer.get(b"ID")
    ids = ids if isinstance(ids, list) and len(ids) == 2 and all(isinstance(x, bytes) for x in ids) else [None, None]
    whole = lambda k: v if isinstance(v := trailer.get(k), int) and not isinstance(v, bool) else None
    root = trailer.get(b"Root")
    return Section(order, at, kind, whole(b"Prev"), whole(b"Size"), root if isinstance(root, Ref) else None, ids[0], ids[1], entries)


def sections(data: bytes) -> tuple[int | None, list[Section], str | None]:
    """(startxref, sections from newest to oldest, problem): the chain of Prev, each place visited once."""
    at = first = start_offset(data)
    if at is None:
        return None, [], "startxref is missing"
    out: list[Section] = []
    seen: set[int] = set()
    while at is not None:
        if at in seen:
            return first, out, "the chain of sections is a ring"
        if not 0 <= at < len(data):
            return first, out, "a section lies outside of the file"
        seen.add(at)
        try:
            out.append(_section(data, at, len(out)))
        except (SyntaxProblem, TypeError, ValueError) as e:
            return first, out, str(e)
        at = out[-1].prev
    return first, out, None


class Found(NamedTuple):
    """An indirect object: the slice of its value, its kind, for a stream its decoded content, and a problem."""

    obj: int
    gen: int
    kind: str | None
    raw: bytes | None
    content: bytes | None
    error: str | None


def kind_of(v: object) -> str:
    """The name of a value's kind."""
    if v is None:
        return "null"
    for kind, types in (("boolean", bool), ("integer", int), ("real", float), ("name", Name), ("string", bytes), ("ref", Ref), ("array", list), ("dictionary", dict)):
        if isinstance(v, types):
            return kind
    return "unknown"


class File:
    """One file's bytes and its current entries; resolves references inside the file."""

    def __init__(self, data: bytes, entries: list[Entry], decoders: dict[str, codecs.Decoder] | None = None):
        self.data, self.decoders = data, decoders
        self.at = {(e.obj, e.gen): e for e in entries if e.kind != "free"}
        self.streams: dict[int, dict[int, bytes]] = {}
        self.values: dict[Ref, object] = {}

    def deref(self, v: object) -> object:
        """``v``, or what it points to, over any number of references; a ring of them raises."""
        seen: set[Ref] = set()
        while isinstance(v, Ref):
            if v in seen:
                raise SyntaxProblem("a ring of references")
            seen.add(v)
            if v not in self.values:
                e = self.at.get((v.obj, v.gen))
                if e is None:
                    return None
                self.values[v] = lexer.indirect_value(self.data, e.offset)[1] if e.kind == "plain" else lexer.value(self.member(e))[0]  # type: ignore[arg-type]
            v = self.values[v]
        return v

    def content(self, found: lexer.Indirect, d: dict) -> bytes:
        """The decoded bytes of a stream with its dictionary; its length, filters and their settings may be references."""
        get = lambda k: self.deref(d.get(k))
        filters = get(b"Filter")
        filters = [self.deref(f) for f in filters] if isinstance(filters, list) else filters
        return codecs.decode(lexer.stream_bytes(self.data, found.stream_at, get(b"Length")), filters, get(b"DecodeParms"), self.decoders)  # type: ignore[arg-type]

    def members(self, stream_id: int) -> dict[int, bytes]:
        """The slices of an object stream by object number, those of the streams it extends included; decoded once."""
        if stream_id not in self.streams:
            self.streams[stream_id] = {}
            e = self.at.get((stream_id, 0))
            if e is None or e.kind != "plain":
                raise SyntaxProblem("the object stream is missing")
            found, d = lexer.indirect_value(self.data, e.offset)  # type: ignore[arg-type]
            if found.stream_at is None or not isinstance(d, dict):
                raise SyntaxProblem("no object stream")
            parent = d.get(b"Extends")
            own = split_members(self.content(found, d), self.deref(d.get(b"N")), self.deref(d.get(b"First")))
            self.streams[stream_id] = (self.members(parent.obj) if isinstance(parent, Ref) else {}) | own
        return self.streams[stream_id]

    def member(self, e: Entry) -> bytes:
        raw = self.members(e.stream_id).get(e.obj)  # type: ignore[arg-type]
        if raw is None:
            raise SyntaxProblem("the object stream lacks the object")
        return raw

    def read(self, e: Entry) -> Found:
        """The object of an entry."""
        try:
            if e.kind == "compressed":
                raw = self.member(e)
                return Found(e.obj, e.gen, kind_of(lexer.value(raw)[0]), raw, None, None)
            found, v = lexer.indirect_value(self.data, e.offset)  # type: ignore[arg-type]
            if (found.obj, found.gen) != (e.obj, e.gen):
                return Found(e.obj, e.gen, None, None, None, f"the entry leads to object {found.obj} {found.gen}")
            if found.stream_at is None:
                return Found(e.obj, e.gen, kind_of(v), found.raw, None, None)
            try:
                return Found(e.obj, e.gen, "stream", found.raw, self.content(found, v), None)  # type: ignore[arg-type]
            except SyntaxProblem as problem:
                return Found(e.obj, e.gen, "stream", found.raw, None, str(problem))
        except (SyntaxProblem, TypeError, ValueError, RecursionError) as problem:
            return Found(e.obj, e.gen, None, None, None, str(problem))


def split_members(content: bytes, n: object, first: object) -> dict[int, bytes]:
    """The slices of an object stream's members by object number: n pairs of number and place, counted from ``first``."""
    if not isinstance(n, int) or not isinstance(first, int):
        raise SyntaxProblem("N or First is missing")
    head = content[:first].split()[: 2 * n]
    if len(head) < 2 * n:
        raise SyntaxProblem("the header is too short")
    out = {}
    for obj, at in zip(head[::2], head[1::2], strict=True):
        begin, end = lexer.extent(content, first + int(at))
        out[int(obj)] = content[begin:end]
    return out


def nodes(raw: bytes) -> list[tuple]:
    """A value as rows: node_id, parent_id, key, idx, kind, bool_v, int_v, real_v, bytes_v, name_v, ref_obj, ref_gen; depth first."""
    out: list[tuple] = []
    todo: list[tuple[object, int | None, bytes | None, int | None]] = [(lexer.value(raw)[0], None, None, None)]
    while todo:
        v, parent, key, idx = todo.pop()
        kind, me = kind_of(v), len(out)
        out.append((
            me, parent, key, idx, kind, v if kind == "boolean" else None, v if kind == "integer" else None, v if kind == "real" else None,
            bytes(v) if kind == "string" else None, bytes(v) if kind == "name" else None, v.obj if kind == "ref" else None, v.gen if kind == "ref" else None,  # type: ignore[arg-type,attr-defined]
        ))
        if isinstance(v, dict):
            todo.extend((x, me, bytes(k), None) for k, x in reversed(v.items()))
        elif isinstance(v, list):
            todo.extend((x, me, None, i) for i, x in reversed(list(enumerate(v))))
    return out


# -- catalog and pages ---------------------------------------------------------------------------

# What a catalog may ask for; the first of each is the default.
LAYOUTS = ("SinglePage", "OneColumn", "TwoColumnLeft", "TwoColumnRight", "TwoPageLeft", "TwoPageRight")
MODES = ("UseNone", "UseOutlines", "UseThumbs", "FullScreen", "UseOC", "UseAttachments")
ROTATIONS = (0, 90, 180, 270)


def current(parts: list[Section], oldest_wins: bool = False) -> list[Entry]:
    """One entry for each object: that of the newest section which lists its number, whatever kind and generation.

    With ``oldest_wins`` one for each number and generation, that of the oldest section."""
    chosen: dict[object, Entry] = {}
    for s in parts if oldest_wins else reversed(parts):
        for e in s.entries:
            chosen[(e.obj, e.gen) if oldest_wins else e.obj] = e
    return list(chosen.values())


def catalog(file: File, root: Ref | None) -> tuple[str, str, Ref | None, str | None]:
    """(page layout, page mode, root of the page tree, problem)."""
    d = file.deref(root)
    if not isinstance(d, dict):
        return LAYOUTS[0], MODES[0], None, "the catalog is missing"
    layout, mode, tree = file.deref(d.get(b"PageLayout")), file.deref(d.get(b"PageMode")), d.get(b"Pages")
    name = lambda v, allowed: allowed[0] if v is None else v.decode("latin-1") if isinstance(v, Name) else "?"
    layout, mode = name(layout, LAYOUTS), name(mode, MODES)
    problem = "unknown page layout" if layout not in LAYOUTS else "unknown page mode" if mode not in MODES else None if isinstance(tree, Ref) else "Pages is missing"
    return layout, mode, tree if isinstance(tree, Ref) else None, problem


def _box(file: File, v: object) -> list[float] | None:
    v = file.deref(v)
    if isinstance(v, list) and len(v) == 4:
        v = [file.deref(x) for x in v]
        if all(isinstance(x, (int, float)) and not isinstance(x, bool) for x in v):
            return [float(x) for x in v]  # type: ignore[arg-type]
    return None


INHERITED = (b"Resources", b"MediaBox", b"CropBox", b"Rotate")


def pages(file: File, root: Ref | None) -> list[dict]:
    """The pages below ``root`` in order, each with the properties it has or inherits.

    Kids are visited once, so a ring ends; a kid that is missing or neither page nor node gives a row
    with an error.
    """
    out: list[dict] = []
    seen: set[Ref] = set()
    todo: list[tuple[object, dict[bytes, object]]] = [(root, {})] if root else []
    while todo:
        ref, above = todo.pop()
        row: dict = {"page_ord": len(out), "obj": ref.obj if isinstance(ref, Ref) else None, "gen": ref.gen if isinstance(ref, Ref) else None, "error": None}
        try:
            if not isinstance(ref, Ref):
                raise SyntaxProblem("a kid is no reference")
            if ref in seen:
                raise SyntaxProblem("the page tree is a ring")
            seen.add(ref)
            d = file.deref(ref)
            if not isinstance(d, dict):
                raise SyntaxProblem("a kid is missing")
            own = above | {k: d[k] for k in INHERITED if d.get(k) is not None}
            kids = file.deref(d.get(b"Kids"))
            if d.get(b"Type") == b"Pages" or kids is not None and ref == root and d.get(b"Type") != b"Page":
                kids = kids if isinstance(kids, list) else [kids] if kids is not None else []
                todo.extend((k, own) for k in reversed(kids))
                continue
            if d.get(b"Type") != b"Page":
                raise SyntaxProblem("a kid is neither page nor node")
            contents = d.get(b"Contents")
            if isinstance(contents, Ref) and isinstance(inner := file.deref(contents), list):
                contents = inner
            contents = contents if isinstance(contents, list) else [] if contents is None else [contents]
            rotate, unit, resources = file.deref(own.get(b"Rotate")), file.deref(d.get(b"UserUnit")), own.get(b"Resources")
            fonts = file.deref(r.get(b"Font")) if isinstance(r := file.deref(resources), dict) else None
            row |= {
                "media_box": _box(file, own.get(b"MediaBox")), "crop_box": _box(file, own.get(b"CropBox")), "rotate": rotate if rotate in ROTATIONS and not isinstance(rotate, bool) else None,
                "user_unit": float(unit) if isinstance(unit, (int, float)) else 1.0, "resources": resources if isinstance(resources, Ref) else None,
                "fonts": {k.decode("latin-1"): v for k, v in fonts.items() if isinstance(v, Ref)} if isinstance(fonts, dict) else {}, "contents": [c for c in contents if isinstance(c, Ref)],
                "direct_resources": resources if isinstance(resources, dict) else None,
                "direct_fonts": {k.decode("latin-1"): v for k, v in fonts.items() if isinstance(v, dict)} if isinstance(fonts, dict) else {},
                "own": {k.decode("latin-1"): v for k, v in d.items()},
            }
            if rotate is not None and row["rotate"] is None:
                row["error"] = "unknown rotation"
        except (SyntaxProblem, TypeError, ValueError, RecursionError) as problem:
            row["error"] = str(problem)
        out.append(row)
    return out


def page_content(file: File, contents: list[Ref]) -> tuple[bytes | None, str | None]:
    """(decoded content of a page, problem): its parts in order, a line feed between them."""
    parts = []
    for ref in contents:
        try:
            e = file.at.get((ref.obj, ref.gen))
            if e is None or e.kind != "plain":
                raise SyntaxProblem("a content stream is missing")
            found, d = lexer.indirect_value(file.data, e.offset)  # type: ignore[arg-type]
            if found.stream_at is None:
                raise SyntaxProblem("the content is no stream")
            parts.append(file.content(found, d))  # type: ignore[arg-type]
        except (SyntaxProblem, TypeError, ValueError) as problem:
            return None, str(problem)
    return b"\n".join(parts), None
