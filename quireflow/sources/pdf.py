"""A corpus of page-description files as relational tables.

The bytes of a file are read once by the scan, cross to Python once for each table that is asked for,
and are never shuffled: what belongs to one file (its cross-reference, objects, page tree) is resolved
in the task that holds it, as a file is bounded by the size of a binary value. Each table is built
there column by column, in batches of bounded size. All that follows is DataFrame operations. Tables
are lazy and independent: a query on documents never reads content.

A malformed file is a row with an error in every table, null in the columns that could not be read;
with ``fail_fast`` it ends the query.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from quireflow.functions import lexer, scalars, structure
from quireflow.functions.codecs import Decoder
from quireflow.functions.lexer import Ref, SyntaxProblem
from quireflow.functions.scalars import FieldSpec
from quireflow.operators import textstate

REF = "struct<obj:bigint,gen:int>"
_BOX = "struct<xmin:float,ymin:float,xmax:float,ymax:float>"
_DOCUMENTS = f"path string, startxref bigint, size bigint, root_ref {REF}, id_creation binary, id_modification binary, page_layout string, page_mode string, error string"
_SECTIONS = f"path string, section_ord int, offset bigint, kind string, prev bigint, size bigint, root {REF}, error string"
_ENTRIES = "path string, section_ord int, obj bigint, gen int, kind string, offset bigint, stream_id bigint, idx bigint, error string"
_XREF = "path string, obj bigint, gen int, kind string, offset bigint, stream_id bigint, idx bigint, error string"
_OBJECTS = "path string, obj bigint, gen int, kind string, raw binary, error string"
_PAGES = f"path string, page_ord int, obj bigint, gen int, media_box {_BOX}, crop_box {_BOX}, rotate int, user_unit float, resources {REF}, direct_resources binary, fonts map<string,{REF}>, direct_fonts map<string,binary>, contents array<{REF}>, error string"
_OWN = "path string, page_ord int, obj bigint, gen int, own map<string,binary>, error string"
_CONTENT = "path string, page_ord int, content binary, error string"
_OPERATION = "op string, category string, nums array<double>, name binary, text binary, items array<struct<text:binary,offset:double>>, raw binary, error string, trailing_at int"

PAGE = ["path", "page_ord"]

#: The optional properties of a page that are its own. The keys, in the order of the format's description.
PAGE_PROPERTIES: list[FieldSpec | list[FieldSpec]] = [
    FieldSpec("last_modified", scalars.date),
    *[FieldSpec(n, scalars.rectangle) for n in ("bleed_box", "trim_box", "art_box")],
    *[FieldSpec(n, scalars.dictionary) for n in ("box_color_info", "group")],
    FieldSpec("thumb", scalars.reference), FieldSpec("b", scalars.array), FieldSpec("dur", scalars.PARSERS["f64"]), FieldSpec("trans", scalars.dictionary), FieldSpec("annots", scalars.array),
    FieldSpec("aa", scalars.dictionary, key="AA"), FieldSpec("metadata", scalars.reference), FieldSpec("piece_info", scalars.dictionary), FieldSpec("struct_parents", scalars.PARSERS["raw"]),
    FieldSpec("id", scalars.file_id, key="ID"), FieldSpec("pz", scalars.PARSERS["f64"], key="PZ"), FieldSpec("separation_info", scalars.dictionary), FieldSpec("tabs", scalars.name),
    FieldSpec("template_instantiated", scalars.name), FieldSpec("pres_steps", scalars.dictionary), FieldSpec("vp", scalars.array, key="VP"), FieldSpec("af", scalars.array, key="AF"),
    FieldSpec("output_intents", scalars.array), FieldSpec("d_part", scalars.reference, key="DPart"),
]

#: Rows and bytes of a batch; the batches bound memory, not results.
_ROWS, _BYTES = 20_000, 32_000_000


def _arrow_schema(ddl: str) -> pa.Schema:
    return pa.schema([(f.name, to_arrow_type(f.dataType)) for f in T._parse_datatype_string(ddl).fields])


def _ref(r: object) -> tuple | None:
    return {"obj": r.obj, "gen": r.gen} if isinstance(r, Ref) else None  # type: ignore[return-value]


class _Opened:
    """A file with its sections and current entries."""

    def __init__(self, content: bytes, old: bool, decoders: dict[str, Decoder] | None):
        self.start, self.parts, self.error = structure.sections(content)
        self.entries = structure.current(self.parts, old)
        self.file = structure.File(content, self.entries, decoders)

    def catalog(self) -> tuple[str | None, str | None, Ref | None, str | None]:
        try:
            return structure.catalog(self.file, self.parts[0].root if self.parts else None)
        except (ValueError, TypeError) as e:
            return None, None, None, str(e)

    def pages(self) -> tuple[list[dict], str | None]:
        """(pages, why there are none or not all)."""
        _, _, root, problem = self.catalog()
        return structure.pages(self.file, root), self.error or (problem if root is None else None)


# Each of these yields the rows of one file, without its path, the error last.


def _documents(f: _Opened) -> Iterator[tuple]:
    layout, mode, _, problem = f.catalog()
    new = f.parts[0] if f.parts else None
    yield (f.start, *((new.size, _ref(new.root), new.id_creation, new.id_modification) if new else (None,) * 4), layout, mode, f.error or problem)


def _sections(f: _Opened) -> Iterator[tuple]:
    for s in f.parts:
        yield s.section_ord, s.offset, s.kind, s.prev, s.size, _ref(s.root), None
    if f.error:
        yield (*[None] * 6, f.error)


def _entries(f: _Opened) -> Iterator[tuple]:
    for s in f.parts:
        for e in s.entries:
            yield (s.section_ord, *e, None)
    if f.error:
        yield (*[None] * 7, f.error)


def _xref(f: _Opened) -> Iterator[tuple]:
    for e in f.entries:
        if e.kind != "free":
            yield (*e, None)
    if f.error:
        yield (*[None] * 6, f.error)


def _objects(f: _Opened) -> Iterator[tuple]:
    for e in f.file.at.values():
        found = f.file.read(e)
        yield found.obj, found.gen, found.kind, found.raw, found.error
    if f.error:
        yield (*[None] * 4, f.error)


def _pages(f: _Opened) -> Iterator[tuple]:
    rows, error = f.pages()
    box = lambda v: None if v is None else dict(zip(("xmin", "ymin", "xmax", "ymax"), v, strict=True))
    for r in rows:
        g = r.get
        yield (
            r["page_ord"], r["obj"], r["gen"], box(g("media_box")), box(g("crop_box")), g("rotate"), g("user_unit"), _ref(g("resources")), lexer.syntax(g("direct_resources")) if g("direct_resources") is not None else None,
            [(k, _ref(v)) for k, v in g("fonts", {}).items()], [(k, lexer.syntax(v)) for k, v in g("direct_fonts", {}).items()], [_ref(x) for x in g("contents", [])], r["error"],
        )
    if error:
        yield (*[None] * 12, error)


def _own(f: _Opened) -> Iterator[tuple]:
    rows, error = f.pages()
    for r in rows:
        yield r["page_ord"], r["obj"], r["gen"], [(k, lexer.syntax(v)) for k, v in r.get("own", {}).items()], r["error"]
    if error:
        yield (*[None] * 4, error)


def _contents(f: _Opened, first: int | None, last: int | None) -> Iterator[tuple]:
    rows, error = f.pages()
    for r in rows:
        if (first is None or r["page_ord"] >= first) and (last is None or r["page_ord"] <= last):
            plain, problem = structure.page_content(f.file, r["contents"]) if "contents" in r else (None, r["error"])
            yield r["page_ord"], plain, problem
    if error:
        yield None, None, error


_NO_OPERATION = (None,) * 7


def _operation_rows(content: bytes | None, error: str | None, more: dict[bytes, tuple[str, str]] | None) -> Iterator[tuple]:
    """The operators of a stream: op_ord and the columns of _OPERATION."""
    if error is not None:
        yield (None, *_NO_OPERATION, error, None)
    elif content is not None:
        ops, stopped = lexer.operations(content, more)
        trailing = stopped if stopped < len(content) else None
        for i, o in enumerate(ops, 1):
            yield (i - 1, o.op, o.category, o.nums, o.name, o.text, o.items and [{"text": t, "offset": n} for t, n in o.items], o.raw, o.error, trailing if i == len(ops) else None)
        if trailing is not None and not ops:
            yield (None, *_NO_OPERATION, "no operator could be read", trailing)


def _operations(f: _Opened, first: int | None, last: int | None, more: dict[bytes, tuple[str, str]] | None) -> Iterator[tuple]:
    for ordinal, plain, error in _contents(f, first, last):
        for row in _operation_rows(plain, error, more):
            yield ordinal, *row


def _batches(schema: pa.Schema, rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """The rows in batches; rows are as wide as the schema. A batch ends by number of rows or by bytes of binary values."""
    held: list[tuple] = []
    size = 0
    binary = [i for i, t in enumerate(schema.types) if pa.types.is_binary(t)]

    def batch() -> pa.RecordBatch:
        cols = list(zip(*held, strict=True)) if held else [()] * len(schema)
        return pa.record_batch([pa.array(c, t) for c, t in zip(cols, schema.types, strict=True)], schema=schema)

    for row in rows:
        held.append(row)
        size += sum(len(row[i]) for i in binary if row[i])
        if len(held) >= _ROWS or size >= _BYTES:
            yield batch()
            held, size = [], 0
    yield batch()


class Corpus:
    """The tables of a corpus of files.

    ``files`` has path and content (the binaryFile source, or any DataFrame with these columns).
    ``mode`` 'reference' lets the oldest section win for an object and starts the text state anew with
    every text object; the default follows the standard. ``decoders`` are further stream filters by name,
    ``operators`` further content operators (see ``lexer.OPERATORS``).
    """

    def __init__(self, files: DataFrame, mode: str = "default", fail_fast: bool = False, decoders: dict[str, Decoder] | None = None, operators: dict[bytes, tuple[str, str]] | None = None):
        if mode not in ("default", "reference"):
            raise ValueError(f"unknown mode {mode}")
        self.files, self.mode, self.fail_fast, self.decoders, self.more = files, mode, fail_fast, decoders, operators
        self.text_mode = "reset" if mode == "reference" else "default"

    @classmethod
    def read(cls, spark: SparkSession, path: str, pattern: str = "*.pdf", **options: object) -> Corpus:
        return cls(spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path), **options)  # type: ignore[arg-type]

    def where(self, condition: Column | str) -> Corpus:
        """The corpus of some of the files; conditions on path, length and modificationTime reach the scan."""
        return Corpus(self.files.where(condition), self.mode, self.fail_fast, self.decoders, self.more)

    def _table(self, build: Callable, ddl: str) -> DataFrame:
        old, fail_fast, decoders, schema = self.mode == "reference", self.fail_fast, self.decoders, _arrow_schema(ddl)
        empty = (None,) * (len(schema) - 2)
        at = schema.get_field_index("error")

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
            for b in batches:
                for path, content in zip(b.column(0), b.column(1), strict=True):
                    path, content = path.as_py(), content.as_py()
                    try:
                        made = build(_Opened(content, old, decoders)) if content is not None else iter([(*empty[: at - 1], "no content", *empty[at - 1 :])])
                        for row in made:
                            if fail_fast and row[at - 1] is not None:
                                raise RuntimeError(f"{path}: {row[at - 1]}")
                            yield path, *row
                    except (SyntaxProblem, TypeError, ValueError) as problem:
                        if fail_fast:
                            raise RuntimeError(f"{path}: {problem}") from problem
                        yield path, *empty[: at - 1], str(problem), *empty[at - 1 :]

        return self.files.select("path", "content").mapInArrow(lambda batches: _batches(schema, rows(batches)), ddl)

    def documents(self) -> DataFrame:
        """One row a file: startxref, size, root and ids of its newest section, page layout and mode, error."""
        return self._table(_documents, _DOCUMENTS).withColumn("was_modified", F.col("id_creation") != F.col("id_modification"))

    def xref_sections(self) -> DataFrame:
        """One row for each revision of a cross-reference, section_ord 0 being the newest."""
        return self._table(_sections, _SECTIONS)

    def xref_entries(self) -> DataFrame:
        """Every entry of every section, free ones included."""
        return self._table(_entries, _ENTRIES)

    def xref(self) -> DataFrame:
        """The current entry of each object that is not free, as the mode chooses it: what ``objects`` reads."""
        return self._table(_xref, _XREF)

    def objects(self) -> DataFrame:
        """Every current object with the slice of its value; members of object streams included."""
        return self._table(_objects, _OBJECTS)

    def object_nodes(self) -> DataFrame:
        """The values inside every object as a table of nodes with their parents."""
        return self.objects().where("raw is not null").select("path", "obj", "gen", F.explode(scalars.nodes(F.col("raw"))).alias("n")).select("path", "obj", "gen", "n.*")

    def pages(self) -> DataFrame:
        """The pages in order with own or inherited properties; resources and fonts written in place are in the direct columns."""
        return self._table(_pages, _PAGES)

    def page_properties(self, specs: list[FieldSpec | list[FieldSpec]] = PAGE_PROPERTIES) -> DataFrame:
        """The properties that are a page's own: a column for each of ``specs``."""
        own = self._table(_own, _OWN).withColumnsRenamed({"obj": "page_obj", "gen": "page_gen"})
        return scalars.project(own, "own", specs).drop("own", "missing")

    def page_content(self, first: int | None = None, last: int | None = None) -> DataFrame:
        """The decoded content of the pages, or of those from ``first`` to ``last``."""
        return self._table(partial(_contents, first=first, last=last), _CONTENT)

    def operators(self, first: int | None = None, last: int | None = None) -> DataFrame:
        """One row for each operator of the pages' content, op_ord giving its place. Pages and files that could
        not be read are rows without an operator."""
        return self._table(partial(_operations, first=first, last=last, more=self.more), f"path string, page_ord int, op_ord int, {_OPERATION}")

    def text_spans(self, parameters: dict[str, tuple[str, float]] = textstate.PARAMETERS) -> DataFrame:
        return textstate.text_spans(self.operators(), PAGE, self.text_mode, parameters)

    def page_text(self) -> DataFrame:
        return textstate.page_text(self.operators(), PAGE)

    def tables(self) -> dict[str, Callable[[], DataFrame]]:
        return {f.__name__: f for f in (self.documents, self.xref_sections, self.xref_entries, self.xref, self.objects, self.object_nodes, self.pages, self.page_properties, self.page_content, self.operators, self.text_spans, self.page_text)}

    def register(self, prefix: str = "pdf_") -> None:
        """A temporary view for each table, names beginning with ``prefix``."""
        for name, f in self.tables().items():
            f().createOrReplaceTempView(prefix + name)


def operators_of(df: DataFrame, keys: list[str], content: str, more: dict[bytes, tuple[str, str]] | None = None) -> DataFrame:
    """The operators of a column of content streams: keys, op_ord and the operator; trailing_at is set on
    the last row of a stream that was not read to its end. Null streams have no rows."""
    kinds = [f"`{k}` {dict(df.dtypes)[k]}" for k in keys]
    ddl = ", ".join([*kinds, "op_ord int", _OPERATION])
    schema = _arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for b in batches:
                for *key, data in zip(*[c.to_pylist() for c in b.columns], strict=True):
                    for row in _operation_rows(data, None, more):
                        yield *key, *row

        yield from _batches(schema, rows())

    return df.select(*[F.col(f"`{k}`") for k in keys], F.col(content).cast("binary").alias("_content")).mapInArrow(run, ddl)
