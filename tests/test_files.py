"""Whole files: revisions, rings, references to lengths, inheritance, damage."""

import zlib

import pytest

from quireflow.functions import codecs, structure
from quireflow.plans.writing import customer_file
from quireflow.sources.pdf import Corpus


def plain_file(objects, trailer=b"/Root 1 0 R", prev=None, base=b"%PDF-1.4\n"):
    """A revision with a classic table behind ``base``; objects are written as given."""
    out, at = bytearray(base), {}
    for n, body in objects.items():
        at[n] = len(out)
        out += b"%d 0 obj\n%s\nendobj\n" % (n, body)
    start = len(out)
    out += b"xref\n" + b"".join(b"%d 1\n%010d 00000 n \n" % (n, a) for n, a in at.items())
    out += b"trailer\n<</Size 99%s%s>>\nstartxref\n%d\n%%%%EOF\n" % (trailer, b"/Prev %d" % prev if prev is not None else b"", start)
    return bytes(out), start


def stream(content, length=None):
    return b"<</Length %s>>stream\n%s\nendstream" % (length or b"%d" % len(content), content)


TREE = {
    1: b"<</Type/Catalog/Pages 2 0 R>>", 2: b"<</Type/Pages/Kids[3 0 R 4 0 R]/Resources 8 0 R/MediaBox 9 0 R>>", 3: b"<</Type/Page/Contents[5 0 R 6 0 R]/Rotate 90>>",
    4: b"<</Type/Pages/Kids[2 0 R 7 0 R]>>", 5: stream(b"BT /F1 1 Tf (a) Tj", b"10 0 R"), 6: stream(b"ET"), 7: b"<</Type/Page/MediaBox[0 0 1 1]/Rotate 45>>", 8: b"<<>>", 9: b"[0 0 5 6]", 10: b"18",
}


@pytest.fixture(scope="module")
def corpus(spark):
    first, at = plain_file(TREE)
    second, _ = plain_file({8: b"<</Font<</F1 1 0 R>>>>"}, prev=at, base=first)
    ring, _ = plain_file({1: b"<<>>"}, prev=len(b"%PDF-1.4\n") + len(b"1 0 obj\n<<>>\nendobj\n"))
    rows = [("one", first), ("two", second), ("ring", ring), ("bad", b"no such file"), ("none", None), ("empty", b"")]
    return spark.createDataFrame(rows, "path string, content binary")


def test_documents(corpus):
    got = {r.path: r for r in Corpus(corpus).documents().collect()}
    assert len(got) == 6
    assert got["one"].error is None and got["one"].page_layout == "SinglePage" and got["one"].root_ref.obj == 1
    assert "ring" in got["ring"].error and "startxref" in got["bad"].error and got["none"].error and got["empty"].error


def test_newest_section_wins(corpus):
    new = {(r.path, r.obj): r.offset for r in Corpus(corpus).xref().collect()}
    assert new[("two", 8)] > new[("one", 8)] and new[("two", 3)] == new[("one", 3)]
    raw = {(r.path, r.obj): r.raw for r in Corpus(corpus).objects().collect()}
    old = {(r.path, r.obj): r.raw for r in Corpus(corpus, mode="reference").objects().collect()}
    assert raw[("two", 8)] == b"<</Font<</F1 1 0 R>>>>" and old[("two", 8)] == b"<<>>"


def test_pages(corpus):
    got = [r for r in Corpus(corpus).pages().where("path = 'two'").orderBy("page_ord").collect()]
    assert [r.obj for r in got] == [3, 2, 7]
    assert got[0].media_box.xmax == 5 and got[0].rotate == 90 and got[0].resources.obj == 8 and got[0].fonts["F1"].obj == 1
    assert "ring" in got[1].error and got[2].media_box.xmax == 1 and got[2].error == "unknown rotation" and got[2].user_unit == 1


def test_content_parts_are_separated_and_length_may_be_a_reference(corpus):
    got = Corpus(corpus).page_content().where("path = 'one' and page_ord = 0").first()
    assert bytes(got.content) == b"BT /F1 1 Tf (a) Tj\nET" and got.error is None
    spans = [(r.text, r.error) for r in Corpus(corpus).text_spans().where("path = 'one'").orderBy("page_ord").collect()]
    # the second page is a ring, and one cannot be rotated
    assert spans[0] == ("a", None) and spans[1] == (None, "the page tree is a ring") and len(spans) == 2
    got = Corpus(corpus).page_content(first=1, last=1).where("path = 'one'").collect()
    assert [(r.content, r.error) for r in got] == [(None, "the page tree is a ring")]


BROKEN = {1: b"<</Type/Catalog/Pages 2 0 R>>", 2: b"<</Type/Pages/Kids[3 0 R 4 0 R 5 0 R]>>", 3: b"<</Type/Page/Contents 6 0 R>>", 4: b"<</Type/Page/Contents 7 0 R>>", 6: b"<</Filter/LZWDecode/Length 1>>stream\nx\nendstream", 7: stream(b"BT ET")}
TABLES = ["xref_sections", "xref", "objects", "pages", "page_properties", "page_content", "operators", "text_spans", "page_text", "documents"]


def test_damage_is_a_row_in_every_table(spark):
    """A file without a catalog, a truncated one, nothing at all, and one whose first page cannot be decoded and whose last is missing."""
    no_catalog, _ = plain_file({2: b"<<>>"})
    whole, _ = plain_file(BROKEN)
    files = spark.createDataFrame([("catalog", no_catalog), ("cut", whole[: len(whole) // 2]), ("none", None), ("broken", whole)], "path string, content binary")
    tables = Corpus(files).tables()
    for name in TABLES:
        got = {}
        for r in tables[name]().collect():
            got.setdefault(r.path, []).append(r.error)
        assert "startxref is missing" in got["cut"] and "no content" in got["none"], name
        if name not in ("xref_sections", "xref", "objects"):
            assert "the catalog is missing" in got["catalog"], name
    for name in ("page_content", "operators", "text_spans"):
        got = sorted((r.page_ord, r.error) for r in tables[name]().where("path = 'broken' and error is not null").collect())
        assert got == [(0, "unsupported filter LZWDecode"), (2, "a kid is missing")], name
    assert [r.op for r in tables["operators"]().where("path = 'broken' and op is not null").collect()] == ["BT", "ET"]


@pytest.mark.parametrize("name", TABLES)
def test_fail_fast_in_every_table(spark, name):
    files = spark.createDataFrame([("none", b"nothing")], "path string, content binary")
    with pytest.raises(Exception, match="startxref is missing"):
        Corpus(files, fail_fast=True).tables()[name]().collect()
    if name in ("page_content", "operators", "text_spans", "page_text"):
        whole, _ = plain_file(BROKEN)
        with pytest.raises(Exception, match="unsupported filter"):
            Corpus(spark.createDataFrame([("broken", whole)], "path string, content binary"), fail_fast=True).tables()[name]().collect()


def test_freed_objects_and_modes(spark):
    """xref and objects agree: a newer section frees an object, whatever generation it names, and changes another."""
    first, at = plain_file(TREE)
    out = bytearray(first)
    place = len(out)
    out += b"3 0 obj\n(new)\nendobj\n"
    start = len(out)
    out += b"xref\n3 1\n%010d 00000 n \n5 1\n0000000000 00001 f \ntrailer\n<</Size 99/Root 1 0 R/Prev %d>>\nstartxref\n%d\n%%%%EOF\n" % (place, at, start)
    files = spark.createDataFrame([("f", bytes(out))], "path string, content binary")
    for mode, offset, freed in (("default", place, True), ("reference", None, False)):
        corpus = Corpus(files, mode)
        xref = {r.obj: r.offset for r in corpus.xref().collect()}
        raw = {r.obj: bytes(r.raw) for r in corpus.objects().collect() if r.raw}
        assert set(xref) == set(raw) and (5 not in xref) == freed
        assert (xref[3] == offset and raw[3] == b"(new)") if mode == "default" else raw[3] == TREE[3]


def test_direct_resources_and_fonts(spark):
    tree = {1: b"<</Type/Catalog/Pages 2 0 R>>", 2: b"<</Type/Pages/Kids[3 0 R]>>", 3: b"<</Type/Page/Tabs/S/Resources<</Font<</F1<</Type/Font/Name/A#20B>>/F2 9 0 R>>>>/Dur 2.5/Thumb 7 0 R>>"}
    corpus = Corpus(spark.createDataFrame([("f", plain_file(tree)[0])], "path string, content binary"))
    page = corpus.pages().first()
    assert bytes(page.direct_fonts["F1"]) == b"<</Type /Font /Name /A#20B>>" and page.fonts["F2"].obj == 9 and page.resources is None and bytes(page.direct_resources).startswith(b"<</Font")
    own = corpus.page_properties().first()
    assert (bytes(own.tabs), own.dur, own.thumb.obj, own.art_box) == (b"S", 2.5, 7, None)


def test_rings_of_references_and_deep_values(spark):
    tree = {1: b"<</Type/Catalog/Pages 2 0 R>>", 2: b"<</Type/Pages/Kids 3 0 R>>", 3: b"4 0 R", 4: b"3 0 R", 5: b"[" * 3000 + b"]" * 3000}
    corpus = Corpus(spark.createDataFrame([("f", plain_file(tree)[0])], "path string, content binary"))
    assert [r.error for r in corpus.pages().collect()] == ["a ring of references"]
    assert corpus.object_nodes().where("obj = 5").count() == 3000


def test_decoders_operators_and_bounds(spark, monkeypatch):
    body = {**BROKEN, 6: b"<</Filter/Up/Length 9>>stream\nbt ab zz \nendstream"}
    files = spark.createDataFrame([("f", plain_file(body)[0])], "path string, content binary")
    corpus = Corpus(files, decoders={"Up": lambda data, parms: data.upper()}, operators={b"ZZ": ("own", "")})
    assert [(r.op, r.category) for r in corpus.operators().where("page_ord = 0").orderBy("op_ord").collect()] == [("BT", "delimiter"), ("AB", "unimplemented"), ("ZZ", "own")]
    with pytest.raises(ValueError, match="more than 10 bytes"):
        codecs._inflate(zlib.compress(b"x" * 1000), 10)
    with pytest.raises(ValueError, match="incomplete"):
        codecs._inflate(zlib.compress(b"x" * 1000)[:-3], 10_000)


def test_fail_fast(corpus):
    with pytest.raises(Exception, match="startxref"):
        Corpus(corpus.where("path = 'bad'"), fail_fast=True).documents().collect()
    with pytest.raises(ValueError):
        Corpus(corpus, mode="x")


def test_views_and_source(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(customer_file(1, [(3, "Ann (A)", "HOUSE"), (4, "Żó\\", "HOUSE")]))
    (tmp_path / "b.pdf").write_bytes(customer_file(2, [(5, "Bo", "X")]))
    (tmp_path / "c.txt").write_text("no")
    Corpus.read(spark, str(tmp_path)).register()
    assert [r[0] for r in spark.sql("select text from pdf_text_spans where span_ord = 0 order by 1").collect()] == ["Ann (A)", "Bo", "Żó\\"]
    assert spark.sql("select count(*) from pdf_object_nodes where kind = 'ref'").first()[0] > 0
    assert spark.table("pdf_documents").count() == 2


def test_scan_reads_no_content_for_paths(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(customer_file(1, [(3, "A", "H")]))
    files = spark.read.format("binaryFile").load(str(tmp_path)).where("length < 1000000")
    plan = Corpus(files).documents().select("path", "size")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(length), LessThan(length,1000000)]" in plan


def test_object_streams_extend_and_missing_objects():
    data = customer_file(1, [(3, "A", "H")])
    start, parts, error = structure.sections(data)
    file = structure.File(data, structure.current(parts))
    assert error is None and {f.kind for f in map(file.read, file.at.values())} == {"dictionary", "stream"}
    assert file.deref(structure.Ref(999, 0)) is None
    assert file.read(structure.Entry(1, 0, "plain", 0, None, None)).error
    assert file.read(structure.Entry(999, 0, "compressed", None, 1, 0)).error


def test_catalog_domains():
    for value, fine in ((b"/TwoPageLeft", True), (b"/Nope", False), (b"5", False)):
        data, _ = plain_file({1: b"<</Type/Catalog/Pages 2 0 R/PageLayout%s>>" % (value if value[:1] == b"/" else b" " + value), 2: b"<</Type/Pages/Kids[]>>"})
        _, parts, _ = structure.sections(data)
        assert (structure.catalog(structure.File(data, structure.current(parts)), parts[0].root)[3] is None) == fine
