"""Column expressions that parse single values.

Built-in expressions wherever they can say it; Python functions, which get Arrow batches and run once a
value, only for strings with escapes, dictionaries and UTF-16. All take BINARY and give NULL for bytes
that are no such value.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quireflow.functions import codecs, lexer, structure

_SPACE = r"[\x00\t\n\f\r ]"


def latin(c: Column) -> Column:
    """Bytes as text, one character a byte."""
    return F.decode(c.cast("binary"), "ISO-8859-1")


def _trimmed(c: Column) -> Column:
    return F.regexp_replace(latin(c), f"^{_SPACE}+|{_SPACE}+$", "")


@cache
def _arrow(f: Callable, kind: str) -> Callable[..., Column]:
    return F.udf(f, kind, useArrow=True)


def _quiet(f: Callable) -> Callable:
    """``f`` with None for a problem."""

    def run(*args: object) -> object:
        try:
            return f(*args)
        except (lexer.SyntaxProblem, ValueError, TypeError, RecursionError, AttributeError):
            return None

    return run


def startxref(c: Column) -> Column:
    """The number behind the last startxref of a file's final 1024 bytes; null if there is none."""
    tail = latin(F.substring(c, -1024, 1024))
    return F.try_element_at(F.regexp_extract_all(tail, F.lit(rf"startxref{_SPACE}+([0-9]+)"), F.lit(1)), F.lit(-1)).try_cast("bigint")


# -- primitives ----------------------------------------------------------------------------------


def boolean(c: Column) -> Column:
    s = _trimmed(c)
    return F.when(s == "true", True).when(s == "false", False)


def is_null(c: Column) -> Column:
    return _trimmed(c) == "null"


def integer(c: Column, kind: str = "int", signed: bool = True) -> Column:
    """An integer with an optional sign (plus only, if unsigned) that fits ``kind``."""
    s = _trimmed(c)
    return F.when(s.rlike(r"^[+-]?\d+$" if signed else r"^\+?\d+$"), s.try_cast(kind))


def positive_byte(c: Column) -> Column:
    """A whole number from 1 to 255."""
    n = integer(c, "smallint", signed=False)
    return F.when(n.between(1, 255), n)


def real(c: Column, kind: str = "float") -> Column:
    s = _trimmed(c)
    return F.when(s.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), s.try_cast(kind))


def number_kind(c: Column) -> Column:
    """'real' for numbers with a point, else 'integer'; null for what is no number."""
    s = _trimmed(c)
    return F.when(s.rlike(r"^[+-]?(\d+\.\d*|\.\d+)$"), "real").when(s.rlike(r"^[+-]?\d+$"), "integer")


def _malformed(c: Column, parsed: Column) -> Column:
    """True for a value that is there and not null, but of another kind."""
    return c.isNotNull() & ~is_null(c) & parsed.isNull()


def optional(c: Column, parse: Callable[[Column], Column]) -> Column:
    """struct<value, error>: the value, or null for ``null`` and for nothing; ``error`` tells what is neither."""
    v = parse(c)
    return F.struct(v.alias("value"), F.when(_malformed(c, v), F.lit("no value of this kind")).alias("error"))


def number_array(c: Column, size: int | None = None, kind: str = "float") -> Column:
    """An array of numbers; null if an item is none or, with ``size``, if there are more or fewer."""
    s = _trimmed(c)
    inner = F.regexp_replace(s, rf"^\[{_SPACE}*|{_SPACE}*\]$", "")
    items = F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, f"{_SPACE}+"))
    out = F.transform(items, lambda x: F.when(x.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)$"), x.try_cast(kind)))
    fits = s.rlike(r"^\[(?s:.*)\]$") & ~F.exists(out, lambda x: x.isNull())
    return F.when(fits & (F.size(out) == size) if size is not None else fits, out)


def number_tuple(c: Column, size: int, kind: str = "float") -> Column:
    """Numbers separated by white space, exactly ``size`` of them, as a struct with fields _1, _2, …"""
    items = F.split(_trimmed(c), f"{_SPACE}+")
    out = F.transform(items, lambda x: F.when(x.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)$"), x.try_cast(kind)))
    whole = (F.size(out) == size) & ~F.exists(out, lambda x: x.isNull())
    return F.when(whole, F.struct(*[F.try_element_at(out, F.lit(i)).alias(f"_{i}") for i in range(1, size + 1)]))


@_quiet
def _items(b: bytes | None) -> list[bytes] | None:
    if b is None:
        return None
    out, at = [], lexer.skip(b, 0)
    while at < len(b):
        begin, end = lexer.extent(b, at)
        at = lexer.skip(b, end)
        if at == end < len(b):
            return None  # items need white space between them
        out.append(b[begin:end])
    return out


def tuple_of(c: Column, parsers: list[Callable[[Column], Column]]) -> Column:
    """Values of any kinds, one behind the other with white space between, as a struct with fields _1, _2, …

    Null unless there are as many as ``parsers`` and each is of its kind; one parser makes a tuple of one."""
    items = _arrow(_items, "array<binary>")(c)
    parts = [p(F.try_element_at(items, F.lit(i))) for i, p in enumerate(parsers, 1)]
    whole = F.size(items) == len(parts)
    for x in parts:
        whole = whole & x.isNotNull()
    return F.when(whole, F.struct(*[x.alias(f"_{i}") for i, x in enumerate(parts, 1)]))


def first_of(c: Column, variants: dict[str, Callable[[Column], Column]]) -> Column:
    """The first variant that parses: struct<variant, one field for each variant>, null if none does."""
    parsed = {n: p(c) for n, p in variants.items()}
    which = F.coalesce(*[F.when(v.isNotNull(), F.lit(n)) for n, v in parsed.items()])
    return F.when(which.isNotNull(), F.struct(which.alias("variant"), *[F.when(which == n, v).alias(n) for n, v in parsed.items()]))


def maybe_array(c: Column) -> Column:
    """A scalar or an array of scalars without nesting, as an array of slices."""
    s = _trimmed(c)
    inner = F.regexp_replace(s, rf"^\[{_SPACE}*|{_SPACE}*\]$", "")
    split = F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, f"{_SPACE}+"))
    return F.transform(F.when(s.startswith("["), split).otherwise(F.array(s)), lambda x: F.encode(x, "ISO-8859-1"))


# -- strings and names ---------------------------------------------------------------------------


@_quiet
def _literal(b: bytes | None) -> bytes | None:
    if b is None:
        return None
    at = lexer.skip(b, 0)
    return lexer.literal_string(b, at)[0] if b[at : at + 1] == b"(" else None


@_quiet
def _name(b: bytes | None) -> bytes | None:
    if b is None:
        return None
    v, _ = lexer.value(b)
    return bytes(v) if isinstance(v, lexer.Name) else None


@_quiet
def _utf16(b: bytes | None) -> str | None:
    return None if b is None else b[2 : len(b) - len(b) % 2].decode("utf-16-be", "replace")


def literal_string(c: Column) -> Column:
    """The bytes of a string in parentheses."""
    return _arrow(_literal, "binary")(c)


def hex_string(c: Column) -> Column:
    """The bytes of a string in angle brackets; an odd last digit is a high nibble."""
    s = F.regexp_replace(latin(c), f"{_SPACE}+", "")
    digits = F.regexp_extract(s, "^<([0-9A-Fa-f]*)>$", 1)
    return F.when(s.rlike("^<[0-9A-Fa-f]*>$"), F.unhex(F.rpad(digits, (F.ceil(F.length(digits) / 2) * 2).cast("int"), F.lit("0"))))


def string(c: Column) -> Column:
    """The bytes of a string in either notation."""
    return F.when(_trimmed(c).startswith("<"), hex_string(c)).otherwise(literal_string(c))


def text(c: Column) -> Column:
    """String bytes as text: UTF-16 behind the mark FE FF (lone surrogates become U+FFFD), else Latin-1."""
    wide = F.startswith(F.hex(F.substring(c, 1, 2)), F.lit("FEFF"))
    return F.when(wide, _arrow(_utf16, "string")(F.when(wide, c))).otherwise(latin(c))


def name(c: Column) -> Column:
    """The bytes of a name, escapes resolved; only names with an escape leave the JVM."""
    s = _trimmed(c)
    plain = s.rlike(r"^/[^\x00\t\n\f\r ()<>\[\]{}/%#]*$")
    return F.when(plain, F.encode(F.substr(s, F.lit(2)), "ISO-8859-1")).when(s.startswith("/"), _arrow(_name, "binary")(c))


def name_text(c: Column) -> Column:
    """Name bytes as text, U+FFFD for what is no UTF-8."""
    return F.make_valid_utf8(c.cast("string"))


def comment(c: Column) -> Column:
    """The text of a comment up to its line end, without leading blanks."""
    pattern = r"^%[ \t]*([^\r\n]*)(?:\r\n|\r|\n)(?s:.*)$"
    return F.when(latin(c).rlike(pattern), F.regexp_extract(latin(c), pattern, 1))


@_quiet
def _shown(texts: list[bytes | None] | None) -> str | None:
    if texts is None:
        return None
    return "".join(_utf16(t) if t[:2] == b"\xfe\xff" else t.decode("latin-1") for t in texts if t is not None)  # type: ignore[misc]


def shown_text(items: Column) -> Column:
    """The text of an array of strings and offsets: its strings behind each other."""
    return _arrow(_shown, "string")(F.transform(items, lambda x: x["text"]))


# -- dates, boxes, ids ---------------------------------------------------------------------------

_DATE = r"^\(?D:(\d{4})(?:(\d{2})(?:(\d{2})(?:(\d{2})(?:(\d{2})(?:(\d{2}))?)?)?)?)?(?:(Z)(?:00'?00'?)?|([+-])(\d{2})'?(?:(\d{2})'?)?)?\)?$"


def date(c: Column) -> Column:
    """struct<year, month, day, hour, minute, second, offset>; what the notation lacks is null, the offset is in minutes."""
    s = _trimmed(c)
    g = lambda i: F.nullif(F.regexp_extract(s, _DATE, i), F.lit("")).try_cast("int")
    sign = F.when(F.regexp_extract(s, _DATE, 8) == "-", -1).otherwise(1)
    offset = F.when(F.regexp_extract(s, _DATE, 7) == "Z", 0).when(F.regexp_extract(s, _DATE, 8) != "", sign * (g(9) * 60 + F.coalesce(g(10), F.lit(0))))
    parts = [g(i).alias(n) for i, n in enumerate(["year", "month", "day", "hour", "minute", "second"], 1)]
    return F.when(s.rlike(_DATE), F.struct(*parts, offset.cast("int").alias("offset")))


def date_timestamp(d: Column) -> Column:
    """The local time a date struct denotes, missing parts at their lowest; null if impossible."""
    part = lambda n, low: F.coalesce(d[n], F.lit(low)).cast("string")
    return F.concat(part("year", 0), F.lit("-"), part("month", 1), F.lit("-"), part("day", 1), F.lit(" "), part("hour", 0), F.lit(":"), part("minute", 0), F.lit(":"), part("second", 0)).try_cast("timestamp_ntz")


def rectangle(c: Column) -> Column:
    a = number_array(c, 4)
    return F.when(a.isNotNull(), F.struct(*[F.try_element_at(a, F.lit(i)).alias(n) for i, n in enumerate(["xmin", "ymin", "xmax", "ymax"], 1)]))


@_quiet
def _file_id(b: bytes | None) -> dict | None:
    if b is None:
        return None
    v, _ = lexer.value(b)
    ok = isinstance(v, list) and len(v) == 2 and all(isinstance(x, bytes) and not isinstance(x, lexer.Name) for x in v)
    return {"creation": v[0], "modification": v[1]} if ok else None


def file_id(c: Column) -> Column:
    """struct<creation, modification> of an array of two strings in either notation."""
    s = _trimmed(c)
    pair = rf"^\[{_SPACE}*(<[0-9A-Fa-f\s]*>){_SPACE}*(<[0-9A-Fa-f\s]*>){_SPACE}*\]$"
    part = lambda i: hex_string(F.encode(F.regexp_extract(s, pair, i), "ISO-8859-1"))
    return F.when(s.rlike(pair), F.struct(part(1).alias("creation"), part(2).alias("modification"))).otherwise(_arrow(_file_id, "creation binary, modification binary")(c))


def was_modified(id_: Column) -> Column:
    """True if a file's two ids differ; false means probably not."""
    return id_["creation"] != id_["modification"]


# -- references and dictionaries -----------------------------------------------------------------

_REFERENCE = rf"^(\d+){_SPACE}+(\d+){_SPACE}+R$"


def reference(c: Column) -> Column:
    s = _trimmed(c)
    ref = F.struct(F.regexp_extract(s, _REFERENCE, 1).try_cast("bigint").alias("obj"), F.regexp_extract(s, _REFERENCE, 2).try_cast("int").alias("gen"))
    return F.when(s.rlike(_REFERENCE), ref)


def ref_or_direct(c: Column) -> Column:
    """struct<ref, direct>: one of the two is null."""
    r = reference(c)
    return F.struct(r.alias("ref"), F.when(r.isNull(), c).alias("direct"))


def without_references(c: Column, parse: Callable[[Column], Column]) -> Column:
    """struct<value, error> where no objects are at hand: a reference can't be followed and is an error."""
    v = parse(c)
    error = F.when(reference(c).isNotNull(), F.lit("a reference without objects")).when(_malformed(c, v), F.lit("no value of this kind"))
    return F.struct(v.alias("value"), error.alias("error"))


@_quiet
def _dictionary(b: bytes | None) -> dict[str, bytes] | None:
    return None if b is None else {k.decode("latin-1"): v for k, v in lexer.raw_dictionary(b)[0].items()}


def dictionary(c: Column) -> Column:
    """map<string, binary> of a dictionary: its values as slices; of a repeated key the last counts."""
    return _arrow(_dictionary, "map<string,binary>")(c)


def typed_map(m: Column, parse: Callable[[Column], Column]) -> Column:
    """The map with parsed values; entries whose value does not parse are left out."""
    return F.map_filter(F.transform_values(m, lambda _, v: parse(v)), lambda _, v: v.isNotNull())


@_quiet
def _array(b: bytes | None) -> list[bytes] | None:
    if b is None:
        return None
    at = lexer.skip(b, 0)
    if b[at : at + 1] != b"[":
        return None
    out, at = [], at + 1
    while True:
        at = lexer.skip(b, at)
        if b[at : at + 1] == b"]":
            return out
        begin, at = lexer.extent(b, at)
        out.append(b[begin:at])


def array(c: Column) -> Column:
    """array<binary>: the slices of an array's items, of any kind."""
    return _arrow(_array, "array<binary>")(c)


@_quiet
def _kind(b: bytes | None) -> str | None:
    return None if b is None else structure.kind_of(lexer.value(b)[0])


def kind(c: Column) -> Column:
    """null, boolean, integer, real, string, name, array, dictionary, ref; null for what is no value."""
    return _arrow(_kind, "string")(c)


NODES = "array<struct<node_id:int,parent_id:int,key:binary,idx:int,kind:string,bool_v:boolean,int_v:bigint,real_v:double,bytes_v:binary,name_v:binary,ref_obj:bigint,ref_gen:int>>"


@_quiet
def _nodes(b: bytes | None) -> list[tuple] | None:
    if b is None:
        return None
    out = []
    for row in structure.nodes(b):
        # integers beyond 64 bits have no column that holds them
        out.append(row if row[6] is None or -(2**63) <= row[6] < 2**63 else (*row[:6], None, *row[7:]))
    return out


def nodes(c: Column) -> Column:
    """A value of any depth as rows: an array to explode, parents before children."""
    return _arrow(_nodes, NODES)(c)


def decoded(c: Column, filters: Column, more: dict[str, codecs.Decoder] | None = None) -> Column:
    """Stream bytes through an array of filter names; null where a filter fails or is unsupported.

    ``more`` holds further decoders by filter name; they travel to the workers with the function."""

    @_quiet
    def run(b: bytes | None, names: list[str] | None) -> bytes | None:
        return None if b is None else codecs.decode(b, [lexer.Name(f.encode("latin-1")) for f in names or []], None, more)

    return F.udf(run, "binary", useArrow=True)(c, filters)


def filter_problem(f: Column, more: dict[str, codecs.Decoder] | None = None) -> Column:
    """Why a filter name can't be used; null if it can."""
    return F.when(f.isin(*codecs.DECODERS, *(more or {})), F.lit(None)).when(f.isin(*codecs.KNOWN), F.concat(F.lit("unsupported filter "), f)).otherwise(F.concat(F.lit("unknown filter "), f))


@_quiet
def _stream(b: bytes | None) -> dict | None:
    if b is None:
        return None
    d, end = lexer.value(b)
    s = lexer._STREAM.match(b, lexer.skip(b, end))
    if s is None or not isinstance(d, dict):
        return None
    content = codecs.decode(lexer.stream_bytes(b, s.end(), d.get(b"Length")), d.get(b"Filter"), d.get(b"DecodeParms"))
    return {"structured": _dictionary(b), "content": content}


def stream(c: Column) -> Column:
    """struct<structured map<string,binary>, content binary> of a dictionary with a stream behind it."""
    return _arrow(_stream, "structured map<string,binary>, content binary")(c)


@_quiet
def _xref_table(b: bytes | None) -> list[tuple] | None:
    if b is None:
        return None
    at = lexer.skip(b, 0)
    return [tuple(e) for e in structure.table_entries(b, at + 4)[0]] if b[at : at + 4] == b"xref" else None


@_quiet
def _xref_stream(b: bytes | None, w: list[int], index: list[int]) -> list[tuple] | None:
    return None if b is None else [tuple(e) for e in structure.stream_entries(b, list(w), list(index))]


ENTRIES = "array<struct<obj:bigint,gen:int,kind:string,offset:bigint,stream_id:bigint,idx:bigint>>"


def xref_table(c: Column) -> Column:
    """The entries of a classic cross-reference table, free ones included."""
    return _arrow(_xref_table, ENTRIES)(c)


def xref_stream(c: Column, widths: Column, index: Column) -> Column:
    """The entries of a decoded cross-reference stream."""
    return _arrow(_xref_stream, ENTRIES)(c, widths, index)


@_quiet
def _members(b: bytes | None, n: int, first: int) -> list[tuple] | None:
    return None if b is None else list(structure.split_members(b, n, first).items())


def object_stream(c: Column, n: Column, first: Column) -> Column:
    """array<struct<obj, raw>>: the members of a decoded object stream."""
    return _arrow(_members, "array<struct<obj:bigint,raw:binary>>")(c, n, first)


OPERATIONS = "struct<ops:array<struct<op:string,category:string,nums:array<double>,name:binary,text:binary,items:array<struct<text:binary,offset:double>>,raw:binary,error:string>>,stopped_at:int>"


@_quiet
def _operations(b: bytes | None) -> dict | None:
    if b is None:
        return None
    ops, at = lexer.operations(b)
    rows = [o._asdict() | {"items": None if o.items is None else [{"text": t, "offset": n} for t, n in o.items]} for o in ops]
    return {"ops": rows, "stopped_at": at}


def operations(c: Column) -> Column:
    """The operators of a content stream, and where reading stopped."""
    return _arrow(_operations, OPERATIONS)(c)


# -- field specifications ------------------------------------------------------------------------


@dataclass(frozen=True)
class FieldSpec:
    """A field of a dictionary: its name, its parser, its key (by default the name in Pascal case), a
    default for a missing or null value (a value, or a column computed from others), a conversion applied
    behind the parser, and whether a reference is followed."""

    name: str
    parse: Callable[[Column], Column]
    key: str | None = None
    default: object = None
    convert: Callable[[Column], Column] | None = None
    required: bool = False
    follow: bool = False

    @property
    def source(self) -> str:
        return self.key or "".join(p.capitalize() for p in self.name.split("_"))


def project(df: DataFrame, dictionary_column: str, specs: list[FieldSpec | list[FieldSpec]], objects: DataFrame | None = None, key: list[str] | None = None, value: str = "raw") -> DataFrame:
    """``df`` with a column for each field of a dictionary map, ``missing``: the required keys it lacks, and
    ``malformed``: the keys whose value is of another kind, which no default replaces.

    A nested list is flattened: its fields come from the same dictionary. Columns of ``df`` that have a
    field's name are replaced. A field to ``follow`` may be a reference, whose ``value`` is joined from
    ``objects`` (obj, gen and the ``key`` columns, unique); one that leads nowhere is null.
    """
    flat = [s for x in specs for s in (x if isinstance(x, list) else [x])]
    m = F.col(dictionary_column)
    slices: dict[str, Column] = {s.name: F.try_element_at(m, F.lit(s.source)) for s in flat}
    for i, s in enumerate(s for s in flat if s.follow):
        if objects is None:
            raise ValueError(f"{s.name} follows references, which needs objects")
        names = [f"_qf{i}_{k}" for k in ("obj", "gen", "value", *(key or []))]
        o = objects.select(*[F.col(k).alias(n) for k, n in zip(["obj", "gen", value, *(key or [])], names, strict=True)])
        ref = reference(slices[s.name])
        same = [ref["obj"] == F.col(names[0]), ref["gen"] == F.col(names[1]), *[F.col(k) == F.col(n) for k, n in zip(key or [], names[3:], strict=True)]]
        df = df.join(o, same, "left")
        slices[s.name] = F.when(ref.isNotNull(), F.col(names[2])).otherwise(slices[s.name])
    out: dict[str, Column] = {}
    bad = []
    for s in flat:
        raw, v = slices[s.name], s.parse(slices[s.name])
        wrong = _malformed(raw, v)
        bad.append(F.when(wrong, F.lit(s.source)))
        v = s.convert(v) if s.convert else v
        default = s.default if isinstance(s.default, Column) else F.lit(s.default)
        out[s.name] = v if s.default is None else F.when(raw.isNull() | is_null(raw), default).otherwise(v)
    lacking = F.array_compact(F.array(*[F.when(F.try_element_at(m, F.lit(s.source)).isNull(), F.lit(s.source)) for s in flat if s.required] or [F.lit(None).cast("string")]))
    done = df.withColumns(out | {"missing": lacking, "malformed": F.array_compact(F.array(*bad))})
    return done.drop(*[c for c in done.columns if c.startswith("_qf")])


#: Parsers by the name of their kind.
PARSERS: dict[str, Callable[[Column], Column]] = {
    "boolean": boolean, "i8": lambda c: integer(c, "tinyint"), "i16": lambda c: integer(c, "smallint"), "i32": integer, "i64": lambda c: integer(c, "bigint"), "i128": lambda c: integer(c, "decimal(38,0)"),
    "u8": lambda c: F.when(integer(c, "smallint", False) < 256, integer(c, "smallint", False)), "u16": lambda c: F.when(integer(c, "int", False) < 65536, integer(c, "int", False)),
    "u32": lambda c: F.when(integer(c, "bigint", False) < 2**32, integer(c, "bigint", False)), "u64": lambda c: integer(c, "decimal(20,0)", False), "nonzero_u8": positive_byte, "f32": real, "f64": lambda c: real(c, "double"),
    "literal_string": literal_string, "hex_string": hex_string, "string": string, "name": name, "date": date, "rectangle": rectangle, "file_id": file_id, "reference": reference,
    "ref_or_direct": ref_or_direct, "dictionary": dictionary, "array": array, "maybe_array": maybe_array, "stream": stream, "raw": lambda c: c,
}


def parse_as(kind_name: str, c: Column) -> Column:
    """The parser of a kind, applied."""
    return PARSERS[kind_name](c)
