"""Queries of the page-description operators, with the SQL that states the same result.

No files are supplied with the tables, so each query writes syntax from columns, reads it with the
operator, and the SQL takes the answer straight from the columns.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quireflow.functions import scalars, syntax
from quireflow.functions.scalars import FieldSpec
from quireflow.operators import resolve, textstate
from quireflow.plans import writing
from quireflow.plans.writing import raw
from quireflow.session import ensure_checkpoint_dir, table
from quireflow.sources.pdf import PAGE_PROPERTIES, Corpus, operators_of

_QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def _query(sql: str | None = None) -> Callable:
    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        _QUERIES[f.__name__] = (f, sql)
        return f

    return keep


def _text(*parts: Column | str) -> Column:
    """Parts of text behind each other, as bytes; null parts are empty."""
    return raw(F.concat_ws("", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]))


# -- scalars ---------------------------------------------------------------------------------------


@_query("SELECT doc_id, text FROM documents")
def literal_string(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents")
    written = F.when(F.col("text").isNotNull(), raw(writing.literal(writing.string_bytes(F.col("text")))))
    return t.select("doc_id", scalars.text(scalars.literal_string(written)).alias("text"))


@_query("SELECT c_custkey, c_name AS name FROM customer")
def hex_string(spark: SparkSession, d: str) -> DataFrame:
    written = raw(writing.hexadecimal(writing.string_bytes(F.col("c_name"))))
    return table(spark, d, "customer").select("c_custkey", scalars.text(scalars.string(written)).alias("name"))


@_query("SELECT DISTINCT text_object_id, text_buffer AS text FROM text_objects WHERE text_buffer IS NOT NULL")
def utf16_string(spark: SparkSession, d: str) -> DataFrame:
    written = raw(writing.hexadecimal(F.concat(F.unhex(F.lit("FEFF")), F.encode("text_buffer", "UTF-16BE"))))
    return table(spark, d, "text_objects").where("text_buffer is not null").select("text_object_id", scalars.text(scalars.string(written)).alias("text")).distinct()


@_query("SELECT p_partkey, p_name AS name FROM part")
def name_unescape(spark: SparkSession, d: str) -> DataFrame:
    written = _text("/", F.regexp_replace("p_name", " ", "#20"))
    return table(spark, d, "part").select("p_partkey", scalars.name_text(scalars.name(written)).alias("name"))


@_query("SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INTEGER) AS quantity, l_extendedprice AS price, CAST(l_discount AS FLOAT) AS discount, 'real' AS price_kind, 'integer' AS line_kind FROM lineitem")
def numbers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(
        "l_orderkey", scalars.integer(_text("+", F.col("l_linenumber"))).alias("l_linenumber"), scalars.integer(_text(F.col("l_quantity").cast("int"))).alias("quantity"),
        scalars.real(_text(F.col("l_extendedprice")), "double").alias("price"), scalars.real(_text(F.col("l_discount"))).alias("discount"),
        scalars.number_kind(_text(F.col("l_extendedprice").cast("decimal(20,2)"))).alias("price_kind"), scalars.number_kind(_text(F.col("l_linenumber"))).alias("line_kind"),
    )


@_query("SELECT o_orderkey, TRY_CAST(o_orderkey * 1000003 AS INTEGER) AS as_i32, TRY_CAST(o_orderkey AS SMALLINT) AS as_i16, CASE WHEN o_orderkey BETWEEN 1 AND 255 THEN CAST(o_orderkey AS SMALLINT) END AS as_nonzero_u8 FROM orders")
def integer_limits(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select("o_orderkey", scalars.parse_as("i32", _text(F.col("o_orderkey") * 1000003)).alias("as_i32"), scalars.parse_as("i16", _text(F.col("o_orderkey"))).alias("as_i16"), scalars.parse_as("nonzero_u8", _text(F.col("o_orderkey"))).alias("as_nonzero_u8"))


@_query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'true' WHEN 'O' THEN 'false' END AS flag, o_orderstatus NOT IN ('F', 'O') AS is_null FROM orders")
def booleans(spark: SparkSession, d: str) -> DataFrame:
    word = _text(F.when(F.col("o_orderstatus") == "F", "true").when(F.col("o_orderstatus") == "O", "false").otherwise("null"))
    return table(spark, d, "orders").select("o_orderkey", scalars.boolean(word).cast("string").alias("flag"), scalars.is_null(word).alias("is_null"))


@_query("""SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month, CAST(day(o_orderdate) AS INTEGER) AS day,
    CAST(hour(o_orderdate) AS INTEGER) AS hour, CAST(minute(o_orderdate) AS INTEGER) AS minute, CAST(second(o_orderdate) AS INTEGER) AS second,
    CAST((o_orderkey % 12) * 60 + 30 AS INTEGER) * CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE -1 END AS offset_minutes, date_trunc('second', o_orderdate) AS local_time FROM orders""")
def date_parse(spark: SparkSession, d: str) -> DataFrame:
    sign = F.when(F.col("o_orderkey") % 2 == 0, "+").otherwise("-")
    written = _text("(D:", F.date_format("o_orderdate", "yyyyMMddHHmmss"), sign, F.lpad((F.col("o_orderkey") % 12).cast("string"), 2, "0"), "'30')")
    parsed = table(spark, d, "orders").select("o_orderkey", scalars.date(written).alias("t"))
    return parsed.select("o_orderkey", *[F.col(f"t.{n}") for n in ("year", "month", "day", "hour", "minute", "second")], F.col("t.offset").alias("offset_minutes"), scalars.date_timestamp(F.col("t")).alias("local_time"))


@_query("SELECT DISTINCT path, obj, media_box.xmin AS xmin, media_box.ymin AS ymin, media_box.xmax AS xmax, media_box.ymax AS ymax FROM page_nodes")
def rectangle(spark: SparkSession, d: str) -> DataFrame:
    box = F.col("media_box")
    written = F.when(box.isNotNull(), _text("[ ", *[x for n in ("xmin", "ymin", "xmax", "ymax") for x in (box[n], " ")], "]"))
    r = table(spark, d, "page_nodes").select("path", "obj", scalars.rectangle(written).alias("r"))
    return r.select("path", "obj", "r.xmin", "r.ymin", "r.xmax", "r.ymax").distinct()


@_query("SELECT c_custkey, upper(hex(c_name)) AS creation, upper(hex(c_mktsegment)) AS modification, c_name <> c_mktsegment AS was_modified FROM customer")
def file_id(spark: SparkSession, d: str) -> DataFrame:
    first, second = writing.string_bytes(F.col("c_name")), writing.string_bytes(F.col("c_mktsegment"))
    last = F.when(F.col("c_custkey") % 2 == 0, writing.literal(second)).otherwise(writing.hexadecimal(second))
    ids = table(spark, d, "customer").select("c_custkey", scalars.file_id(_text("[", writing.hexadecimal(first), " ", last, "]")).alias("i"))
    return ids.select("c_custkey", F.hex("i.creation").alias("creation"), F.hex("i.modification").alias("modification"), scalars.was_modified(F.col("i")).alias("was_modified"))


@_query("SELECT DISTINCT block_id, root.obj AS obj, root.gen AS gen, root IS NULL AS is_direct FROM xref_blocks")
def reference_parse(spark: SparkSession, d: str) -> DataFrame:
    written = F.when(F.col("root").isNotNull(), _text(F.col("root.obj"), " ", F.col("root.gen"), " R")).otherwise(_text("null"))
    r = table(spark, d, "xref_blocks").select("block_id", scalars.ref_or_direct(written).alias("r"))
    return r.select("block_id", "r.ref.obj", "r.ref.gen", F.col("r.direct").isNotNull().alias("is_direct")).distinct()


_ORDER_FIELDS = [
    FieldSpec("order_key", scalars.PARSERS["i64"], required=True),
    [FieldSpec("total", scalars.PARSERS["f64"], key="Price"), FieldSpec("status", lambda c: scalars.latin(scalars.name(c)))],
    FieldSpec("priority", lambda c: scalars.text(scalars.string(c)), convert=F.upper),
    FieldSpec("copies", scalars.PARSERS["i32"], default=1),
]


@_query("SELECT o_orderkey AS order_key, o_totalprice AS total, o_orderstatus AS status, upper(o_orderpriority) AS priority, CASE WHEN o_orderkey % 2 = 0 THEN 2 ELSE 1 END AS copies, 0 AS n_missing FROM orders")
def dict_fields(spark: SparkSession, d: str) -> DataFrame:
    copies = F.when(F.col("o_orderkey") % 2 == 0, "/Copies 2").otherwise("/Copies null")
    written = _text("<</OrderKey ", F.col("o_orderkey"), "/Price ", F.col("o_totalprice").cast("decimal(20,4)"), " % note\n/Status/", F.col("o_orderstatus"), "/Priority", writing.literal(writing.string_bytes(F.col("o_orderpriority"))), copies, ">>")
    m = table(spark, d, "orders").select(scalars.dictionary(written).alias("m"))
    return scalars.project(m, "m", _ORDER_FIELDS).select("order_key", F.col("total").cast("double"), "status", "priority", "copies", F.size("missing").alias("n_missing"))


@_query("SELECT s_suppkey, key, v FROM (SELECT s_suppkey, unnest(['A', 'B']) AS key, unnest([s_suppkey, CAST(s_nationkey AS BIGINT)]) AS v FROM supplier)")
def map_drop_bad(spark: SparkSession, d: str) -> DataFrame:
    written = _text("<</A ", F.col("s_suppkey"), "/B ", F.col("s_nationkey"), "/C /", F.regexp_replace("s_name", "[^A-Za-z0-9]", ""), "/D [1 2]/A ", F.col("s_suppkey"), ">>")
    m = table(spark, d, "supplier").select("s_suppkey", scalars.typed_map(scalars.dictionary(written), scalars.PARSERS["i64"]).alias("m"))
    return m.select("s_suppkey", F.explode("m").alias("key", "v"))


@_query("""SELECT DISTINCT resource_id, e.key AS key, CASE WHEN e.value IS NULL THEN 'null' ELSE 'ref' END AS kind, e.value.obj AS ref_obj, e.value.gen AS ref_gen
    FROM (SELECT resource_id, unnest(map_entries(font)) AS e FROM page_resources)""")
def object_nodes(spark: SparkSession, d: str) -> DataFrame:
    fonts = F.transform(F.map_entries("font"), lambda e: F.concat(F.lit("/"), e["key"], F.lit(" "), F.when(e["value"].isNull(), "null").otherwise(F.concat_ws(" ", e["value"]["obj"].cast("string"), e["value"]["gen"].cast("string"), F.lit("R")))))
    written = _text("<</Font<<", F.array_join(fonts, ""), ">>>>")
    n = table(spark, d, "page_resources").where("font is not null").select("resource_id", F.explode(scalars.nodes(written)).alias("n"))
    return n.where("n.node_id > 1").select("resource_id", scalars.latin(F.col("n.key")).alias("key"), "n.kind", "n.ref_obj", "n.ref_gen").distinct()


@_query("SELECT o_orderkey, o_orderstatus AS item, CAST(1 AS INTEGER) AS n FROM orders")
def scalar_or_array(spark: SparkSession, d: str) -> DataFrame:
    one = F.concat(F.lit("/"), F.col("o_orderstatus"))
    written = F.when(F.col("o_orderkey") % 2 == 0, _text("[", one, "]")).otherwise(_text(one))
    a = table(spark, d, "orders").select("o_orderkey", scalars.maybe_array(written).alias("a"))
    return a.select("o_orderkey", scalars.latin(scalars.name(F.try_element_at("a", F.lit(1)))).alias("item"), F.size("a").alias("n"))


@_query("""SELECT DISTINCT prop_id, CAST(year(recorded_at) AS INTEGER) AS modified_year, CAST(obj AS FLOAT) AS bleed_x, CAST(gen AS FLOAT) AS trim_y, CAST(prop_id % 1000 AS FLOAT) AS art_x, 1 AS n_box_color, 'Transparency' AS group_s,
    obj AS thumb_obj, 2 AS n_b, dur, CASE WHEN prop_id % 2 = 0 THEN 'Wipe' END AS trans_s, CAST(prop_id % 3 AS INTEGER) AS n_annots, 1 AS n_aa, obj + 1 AS metadata_obj, 'App' AS piece_key, CAST(prop_id % 7 AS VARCHAR) AS struct_parents,
    'AB' AS id_creation, CAST(1.5 AS DOUBLE) AS pz, 'Cyan' AS separation, tabs, CASE WHEN prop_id % 5 = 0 THEN 'Tem plate' END AS template_instantiated, 2 AS n_pres_steps, 1 AS n_vp, 2 AS n_af, 0 AS n_output_intents, obj + 2 AS d_part_obj FROM page_props""")
def page_properties(spark: SparkSession, d: str) -> DataFrame:
    """All properties of their own that pages may have, present and absent."""
    p, obj, gen = F.col("prop_id"), F.col("obj"), F.col("gen")
    written = {
        "LastModified": F.concat(F.lit("(D:"), F.date_format("recorded_at", "yyyyMMddHHmm"), F.lit(")")), "BleedBox": F.format_string("[%d 0 9 9]", obj), "TrimBox": F.format_string("[0 %d 9 9]", gen), "ArtBox": F.format_string("[ %d 0 9 9 ]", p % 1000),
        "BoxColorInfo": F.lit("<</CropBox<</S/D>>>>"), "Group": F.lit("<</S/Transparency>>"), "Thumb": F.format_string("%d 0 R", obj), "B": F.format_string("[%d 0 R %d 0 R]", obj, obj), "Dur": syntax.real(F.col("dur"), 6),
        "Trans": F.when(p % 2 == 0, "<</S/Wipe>>").otherwise("null"), "Annots": syntax.array(F.transform(F.sequence(F.lit(1), (p % 3).cast("int") + 1), lambda i: F.when(i > 1, F.concat(i.cast("string"), F.lit(" 0 R"))).otherwise(""))),
        "AA": F.lit("<</O 5 0 R>>"), "Metadata": F.format_string("%d 0 R", obj + 1), "PieceInfo": F.lit("<</App<</Private 1>>>>"), "StructParents": (p % 7).cast("string"), "ID": F.lit("[<4142><43>]"), "PZ": F.lit("1.5"), "SeparationInfo": F.lit("<</DeviceColorant/Cyan>>"),
        "Tabs": syntax.name(F.encode("tabs", "ISO-8859-1")), "TemplateInstantiated": F.when(p % 5 == 0, "/Tem#20plate").otherwise("null"), "PresSteps": F.lit("<</NA 1 0 R/PA 2 0 R>>"), "VP": F.lit("[<</BBox[0 0 1 1]>>]"), "AF": F.lit("[1 0 R 2 0 R]"), "OutputIntents": F.lit("[]"), "DPart": F.format_string("%d 0 R", obj + 2),
    }
    m = table(spark, d, "page_props").select("prop_id", scalars.dictionary(raw(syntax.dictionary(written))).alias("m"))
    f = scalars.project(m, "m", PAGE_PROPERTIES)
    of = lambda c, k: scalars.latin(scalars.name(F.try_element_at(c, F.lit(k))))
    return f.select(
        "prop_id", F.col("last_modified.year").alias("modified_year"), F.col("bleed_box.xmin").alias("bleed_x"), F.col("trim_box.ymin").alias("trim_y"), F.col("art_box.xmin").alias("art_x"), F.size("box_color_info").alias("n_box_color"), of("group", "S").alias("group_s"),
        F.col("thumb.obj").alias("thumb_obj"), F.size("b").alias("n_b"), "dur", of("trans", "S").alias("trans_s"), F.size("annots").alias("n_annots"), F.size("aa").alias("n_aa"), F.col("metadata.obj").alias("metadata_obj"), F.map_keys("piece_info")[0].alias("piece_key"), scalars.latin(F.col("struct_parents")).alias("struct_parents"),
        scalars.latin(F.col("id.creation")).alias("id_creation"), "pz", of("separation_info", "DeviceColorant").alias("separation"), scalars.latin(F.col("tabs")).alias("tabs"), scalars.latin(F.col("template_instantiated")).alias("template_instantiated"), F.size("pres_steps").alias("n_pres_steps"),
        F.size("vp").alias("n_vp"), F.size("af").alias("n_af"), F.size("output_intents").alias("n_output_intents"), F.col("d_part.obj").alias("d_part_obj"),
    ).distinct()


@_query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey AS BIGINT) END AS value, o_orderkey % 3 = 2 AS is_malformed FROM orders")
def optional_values(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("o_orderkey")
    written = F.when(key % 3 == 0, _text(key)).when(key % 3 == 1, _text(" null ")).otherwise(_text("/", key))
    v = table(spark, d, "orders").select("o_orderkey", scalars.optional(written, scalars.PARSERS["i64"]).alias("v"))
    return v.select("o_orderkey", "v.value", F.col("v.error").isNotNull().alias("is_malformed"))


@_query("""SELECT p_partkey, CASE WHEN p_partkey % 4 > 0 THEN p_name END AS name, CASE WHEN p_partkey % 4 > 0 THEN p_size END AS size, CASE WHEN p_partkey % 4 > 0 THEN p_brand END AS brand, CASE WHEN p_partkey % 4 > 0 THEN 2 END AS n_items,
    p_size AS only, CASE WHEN p_partkey % 3 = 0 THEN 'number' WHEN p_partkey % 3 = 1 THEN 'word' END AS variant, CASE WHEN p_partkey % 3 = 1 THEN p_type END AS word FROM part""")
def mixed_tuples(spark: SparkSession, d: str) -> DataFrame:
    """Values of several kinds one behind the other; a tuple of one; the first variant that parses."""
    p = table(spark, d, "part")
    name, brand = syntax.string(F.encode("p_name", "ISO-8859-1")), syntax.name(F.encode("p_brand", "ISO-8859-1"))
    short = F.when(F.col("p_partkey") % 4 == 0, "").otherwise(" [1 (])]")
    word = syntax.name(F.encode("p_type", "ISO-8859-1"))
    either = F.when(F.col("p_partkey") % 3 == 0, F.col("p_size").cast("string")).when(F.col("p_partkey") % 3 == 1, word).otherwise("(neither)")
    t = p.select(
        "p_partkey", scalars.tuple_of(_text(name, "\n% note\n ", F.col("p_size"), " ", brand, short), [scalars.PARSERS["string"], scalars.integer, scalars.name, scalars.array]).alias("t"),
        scalars.tuple_of(_text(F.col("p_size"), " "), [scalars.integer]).alias("one"), scalars.first_of(_text(either), {"number": scalars.integer, "word": scalars.name}).alias("v"),
    )
    return t.select("p_partkey", scalars.text(F.col("t._1")).alias("name"), F.col("t._2").alias("size"), scalars.latin(F.col("t._3")).alias("brand"), F.when(F.col("t").isNotNull(), F.size("t._4")).alias("n_items"), F.col("one._1").alias("only"), "v.variant", scalars.latin(F.col("v.word")).alias("word"))


@_query("SELECT c_custkey, c_name AS note, CAST(c_custkey % 5 AS INTEGER) AS n_items, CAST(c_custkey AS VARCHAR) AS as_is FROM customer")
def comments(spark: SparkSession, d: str) -> DataFrame:
    """The text of a comment; an array with comments between and before its items; a value left as it is."""
    many = F.array_join(F.transform(F.sequence(F.lit(0), (F.col("c_custkey") % 5).cast("int")), lambda i: F.when(i > 0, F.concat(i.cast("string"), F.lit(" % [ ( \r\n"))).otherwise("")), "")
    c = table(spark, d, "customer").select("c_custkey", scalars.comment(_text("% \t", F.col("c_name"), "\r\nrest")).alias("note"), scalars.array(_text("% a\n  %b\r[%c\n", many, "]")).alias("a"), scalars.parse_as("raw", _text(F.col("c_custkey"))).alias("r"))
    return c.select("c_custkey", "note", F.size("a").alias("n_items"), scalars.latin(F.col("r")).alias("as_is"))


@_query("""SELECT o_orderkey, 'integer,real,boolean,string,string,name,ref,null,array,dictionary' AS kinds, o_orderkey AS int_v, round(o_totalprice, 2) AS real_v, o_orderstatus = 'F' AS bool_v, o_orderpriority AS text, o_orderpriority || ' (#/)' AS name, o_custkey AS ref_obj FROM orders""")
def object_syntax(spark: SparkSession, d: str) -> DataFrame:
    """Values of every kind written from columns and read again."""
    priority = F.encode("o_orderpriority", "ISO-8859-1")
    written = syntax.dictionary({
        "A": syntax.integer(F.col("o_orderkey")), "B": syntax.real(F.round("o_totalprice", 2), 4), "C": syntax.boolean(F.col("o_orderstatus") == "F"), "D": syntax.string(priority), "E": syntax.hex_string(priority), "F": syntax.name(F.concat(priority, raw(F.lit(" (#/)")))),
        "G": syntax.reference(F.struct(F.col("o_custkey").alias("obj"), F.lit(0).alias("gen"))), "H": syntax.integer(F.lit(None)), "I": syntax.array(syntax.integer(F.lit(1)), syntax.name(raw(F.lit("x")))), "J": syntax.dictionary({"K": syntax.integer(F.lit(2))}),
    })
    n = table(spark, d, "orders").select("o_orderkey", F.filter(scalars.nodes(raw(written)), lambda x: x["parent_id"] == 0).alias("n"))
    at = lambda i, c: F.try_element_at("n", F.lit(i))[c]
    return n.select("o_orderkey", F.array_join(F.transform("n", lambda x: x["kind"]), ",").alias("kinds"), at(1, "int_v").alias("int_v"), at(2, "real_v").alias("real_v"), at(3, "bool_v").alias("bool_v"), F.when(at(4, "bytes_v") == at(5, "bytes_v"), scalars.text(at(4, "bytes_v"))).alias("text"), scalars.latin(at(6, "name_v")).alias("name"), at(7, "ref_obj").alias("ref_obj"))


# -- streams and cross-references ------------------------------------------------------------------


@_query("SELECT doc_id, text FROM documents")
def flate_chain(spark: SparkSession, d: str) -> DataFrame:
    data = writing.deflate(writing.deflate(F.encode("text", "UTF-8")))
    return table(spark, d, "documents").select("doc_id", F.decode(scalars.decoded(data, F.array(F.lit("FlateDecode"), F.lit("FlateDecode"))), "UTF-8").alias("text"))


@_query("SELECT p_partkey, p_name AS content, p_brand AS brand, true AS has_length FROM part")
def stream_object(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "part").withColumn("data", writing.deflate(F.encode("p_name", "ISO-8859-1")))
    head = _text("<</Filter/FlateDecode/Brand", writing.literal(F.encode("p_brand", "ISO-8859-1")), "/Length ", F.length("data"), ">>\nstream\r\n")
    s = t.select("p_partkey", scalars.stream(F.concat(head, F.col("data"), raw(F.lit("\nendstream")))).alias("s"))
    return s.select("p_partkey", scalars.latin(F.col("s.content")).alias("content"), scalars.latin(scalars.string(F.try_element_at("s.structured", F.lit("Brand")))).alias("brand"), F.map_contains_key("s.structured", "Length").alias("has_length"))


@_query("SELECT DISTINCT path, startxref FROM pdf_files")
def startxref(spark: SparkSession, d: str) -> DataFrame:
    tail = F.concat(raw(F.repeat(F.lit("x"), 2000)), _text("startxref\n1\nstartxref ", F.coalesce(F.col("startxref").cast("string"), F.lit("1")), "\n%%EOF"))
    none = F.concat(_text("startxref 5\n"), raw(F.repeat(F.lit("x"), 2000)))
    written = F.when(F.col("startxref").isNull(), none).otherwise(tail)
    return table(spark, d, "pdf_files").select("path", scalars.startxref(written).alias("startxref")).distinct()


@_query("""SELECT DISTINCT block_id, x.obj AS obj, x.gen AS gen, x.byte_pos AS byte_pos FROM (SELECT block_id, unnest(xrefs) AS x FROM xref_blocks) WHERE x.kind = 'plain'""")
def xref_table(spark: SparkSession, d: str) -> DataFrame:
    line = lambda x: F.format_string("%d 1\n%010d %05d %s \n", x["obj"], F.coalesce(x["byte_pos"], F.lit(0)), x["gen"], F.when(x["kind"] == "plain", "n").otherwise("f"))
    entries = F.filter("xrefs", lambda x: x["kind"].isin("plain", "free") & x["obj"].isNotNull() & x["gen"].isNotNull())
    t = table(spark, d, "xref_blocks").select("block_id", F.explode(scalars.xref_table(_text("xref\n", F.array_join(F.transform(entries, line), ""), "trailer"))).alias("e"))
    return t.where("e.kind = 'plain'").select("block_id", "e.obj", "e.gen", F.col("e.offset").alias("byte_pos")).distinct()


@_query("""SELECT DISTINCT block_id, x.obj AS obj, CASE WHEN x.kind = 'plain' THEN x.gen ELSE 0 END AS gen, x.kind AS kind, x.byte_pos AS byte_pos, x.stream_id AS stream_id, x.idx AS idx
    FROM (SELECT block_id, unnest(xrefs) AS x FROM xref_blocks) WHERE x.kind IN ('plain', 'compressed')""")
def xref_stream(spark: SparkSession, d: str) -> DataFrame:
    entries = F.filter("xrefs", lambda x: x["kind"].isin("plain", "compressed", "free") & x["obj"].isNotNull())
    number = lambda c, w: F.lpad(F.hex(F.coalesce(c, F.lit(0)).cast("bigint")), 2 * w, "0")
    row = lambda x: F.concat(
        F.when(x["kind"] == "free", "00").when(x["kind"] == "plain", "01").otherwise("02"),
        F.when(x["kind"] == "compressed", number(x["stream_id"], 5)).otherwise(number(x["byte_pos"], 5)),
        F.when(x["kind"] == "compressed", number(x["idx"], 2)).otherwise(number(x["gen"], 2)),
    )
    t = table(spark, d, "xref_blocks").select("block_id", entries.alias("x"))
    index = F.flatten(F.transform("x", lambda x: F.array(x["obj"], F.lit(1).cast("bigint"))))
    e = t.select("block_id", F.explode(scalars.xref_stream(F.unhex(F.array_join(F.transform("x", row), "")), F.array(*[F.lit(i) for i in (1, 5, 2)]), index)).alias("e"))
    return e.where("e.kind <> 'free'").select("block_id", "e.obj", "e.gen", "e.kind", F.col("e.offset").alias("byte_pos"), "e.stream_id", "e.idx").distinct()


@_query("""SELECT path, obj, gen, kind, start_pos FROM (SELECT path, start_pos, x.obj AS obj, x.gen AS gen, x.kind AS kind,
    row_number() OVER (PARTITION BY path, x.obj, x.gen ORDER BY start_pos DESC, pos DESC) AS rn FROM
    (SELECT path, start_pos, unnest(xrefs) AS x, unnest(range(len(xrefs))) AS pos FROM xref_blocks)) WHERE rn = 1""")
def xref_latest(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "xref_blocks").select("path", "start_pos", F.posexplode("xrefs").alias("pos", "x")).select("path", "start_pos", "pos", "x.obj", "x.gen", "x.kind")
    return resolve.newest(e, ["path", "obj", "gen"], [F.desc("start_pos"), F.desc("pos")]).select("path", "obj", "gen", "kind", "start_pos")


@_query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority ELSE c_name END AS name FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def resolve_direct_or_ref(spark: SparkSession, d: str) -> DataFrame:
    direct = writing.literal(writing.string_bytes(F.col("o_orderpriority")))
    written = F.when(F.col("o_orderkey") % 3 == 0, _text(direct)).otherwise(_text(F.col("o_custkey"), " 0 R"))
    orders = table(spark, d, "orders").select("o_orderkey", scalars.ref_or_direct(written).alias("either"))
    objects = table(spark, d, "customer").select(F.col("c_custkey").alias("obj"), F.lit(0).alias("gen"), raw(writing.literal(writing.string_bytes(F.col("c_name")))).alias("raw"))
    done = resolve.resolve_or_direct(orders, "either", objects, "raw", "found")
    return done.select("o_orderkey", scalars.text(scalars.string(F.col("found"))).alias("name"))


@_query("""WITH n AS (SELECT DISTINCT path, obj, gen, node_type, kids FROM page_nodes), k AS (SELECT path, obj, unnest(kids) AS k, unnest(range(len(kids))) AS pos FROM n)
    SELECT k.path, k.obj, string_agg(coalesce(m.node_type, '-'), ',' ORDER BY k.pos) AS kid_types FROM k LEFT JOIN n m ON m.path = k.path AND m.obj = k.k.obj AND m.gen = k.k.gen GROUP BY 1, 2""")
def resolve_items(spark: SparkSession, d: str) -> DataFrame:
    nodes = table(spark, d, "page_nodes").select("path", "obj", "gen", "node_type", "kids").distinct()
    items = F.transform("kids", lambda k: F.struct(k.alias("ref"), F.lit(None).cast("string").alias("direct")))
    objects = nodes.select("path", "obj", "gen", F.col("node_type").alias("value"))
    rows = nodes.where(F.size("kids") > 0).select("path", F.col("obj").alias("parent"), items.alias("items"))
    found = resolve.resolve_items(rows, ["path", "parent"], "items", objects, "value", "kinds", ["path"])
    kinds = F.array_join(F.transform("kinds", lambda k: F.coalesce(k, F.lit("-"))), ",")
    return found.select("path", F.col("parent").alias("obj"), kinds.alias("kid_types"))


@_query("SELECT p_partkey, p_name AS name, p_size AS size FROM part")
def object_stream(spark: SparkSession, d: str) -> DataFrame:
    """Parts in object streams of up to a hundred members."""
    body = F.concat(F.lit("<</Name"), writing.literal(writing.string_bytes(F.col("p_name"))), F.lit("/Size "), F.col("p_size").cast("string"), F.lit(">> "))
    p = table(spark, d, "part").select(F.floor(F.col("p_partkey") / 100).alias("stream"), F.struct("p_partkey", body.alias("body")).alias("m"))
    s = p.groupBy("stream").agg(F.array_sort(F.collect_list("m")).alias("m"))
    start = F.struct(F.lit("").alias("head"), F.lit("").alias("body"))
    packed = F.aggregate("m", start, lambda a, x: F.struct(F.concat(a["head"], x["p_partkey"].cast("string"), F.lit(" "), F.length(a["body"]).cast("string"), F.lit(" ")).alias("head"), F.concat(a["body"], x["body"]).alias("body")))
    s = s.select(packed.alias("s"), F.size("m").alias("n"))
    members = s.select(F.explode(scalars.object_stream(_text(F.col("s.head"), F.col("s.body")), F.col("n"), F.length("s.head"))).alias("x"))
    m = members.select(F.col("x.obj").alias("p_partkey"), scalars.dictionary(F.col("x.raw")).alias("m"))
    return scalars.project(m, "m", [FieldSpec("name", lambda c: scalars.text(scalars.string(c))), FieldSpec("size", scalars.integer)]).select("p_partkey", "name", "size")


@_query("SELECT l_orderkey, string_agg(CAST(l_linenumber AS VARCHAR) || l_returnflag, chr(10) ORDER BY l_linenumber, l_returnflag) AS content FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_returnflag FROM lineitem) GROUP BY 1")
def content_concat(spark: SparkSession, d: str) -> DataFrame:
    """Binary parts of a group in order, a line feed between them."""
    parts = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", _text(F.col("l_linenumber"), F.col("l_returnflag")).alias("part")).distinct()
    return resolve.concat_parts(parts, ["l_orderkey"], "l_linenumber", "part", "content").select("l_orderkey", scalars.latin(F.col("content")).alias("content"))


@_query("SELECT p_partkey, CASE p_size % 3 WHEN 1 THEN 'unsupported filter LZWDecode' WHEN 2 THEN 'unknown filter Own' END AS problem, upper(p_name) AS own FROM part")
def filter_names(spark: SparkSession, d: str) -> DataFrame:
    """Which filters can be used; a stream through a decoder of one's own and a built-in one."""
    own = {"Own": lambda data, settings: data.upper()}
    f = F.when(F.col("p_size") % 3 == 0, "FlateDecode").when(F.col("p_size") % 3 == 1, "LZWDecode").otherwise("Own")
    data = writing.deflate(F.encode("p_name", "UTF-8"))
    return table(spark, d, "part").select("p_partkey", scalars.filter_problem(f).alias("problem"), F.decode(scalars.decoded(data, F.array(F.lit("FlateDecode"), F.lit("Own")), own), "UTF-8").alias("own"))


def _customers_as_objects(spark: SparkSession, d: str) -> DataFrame:
    """Each customer's name as a string object, with generation 0."""
    return table(spark, d, "customer").select(F.col("c_custkey").alias("obj"), F.lit(0).alias("gen"), raw(writing.literal(writing.string_bytes(F.col("c_name")))).alias("raw"))


@_query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END AS value, CASE WHEN o_orderkey % 2 = 1 THEN 'a reference without objects' END AS error FROM orders")
def references_without_objects(spark: SparkSession, d: str) -> DataFrame:
    written = F.when(F.col("o_orderkey") % 2 == 0, _text(syntax.string(F.encode("o_orderpriority", "ISO-8859-1")))).otherwise(_text(F.col("o_custkey"), " 0 R"))
    v = table(spark, d, "orders").select("o_orderkey", scalars.without_references(written, scalars.string).alias("v"))
    return v.select("o_orderkey", scalars.text(F.col("v.value")).alias("value"), "v.error")


@_query("""WITH o AS (SELECT o_orderkey, o_orderpriority AS p, c_name AS n FROM orders LEFT JOIN customer ON c_custkey = o_custkey)
    SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN p WHEN 1 THEN coalesce(n, '-') WHEN 2 THEN p || ',' || coalesce(n, '-') ELSE '' END AS either, CASE WHEN o_orderkey % 3 > 0 THEN p || ',' || coalesce(n, '-') END AS two,
      CASE WHEN n IS NOT NULL AND o_orderkey % 3 > 0 THEN n END AS first, CASE WHEN n IS NOT NULL AND o_orderkey % 3 > 0 THEN o_orderkey END AS second FROM o""")
def resolve_arrays(spark: SparkSession, d: str) -> DataFrame:
    """A value or an array of values, an array of fixed length, and a tuple: every item may be a reference."""
    objects, key = _customers_as_objects(spark, d), F.col("o_orderkey")
    own, ref = syntax.string(F.encode("o_orderpriority", "ISO-8859-1")), F.concat(F.col("o_custkey").cast("string"), F.lit(" 0 R"))
    either = F.when(key % 4 == 0, _text(own)).when(key % 4 == 1, _text(ref)).when(key % 4 == 2, _text("[", own, ref, "]")).otherwise(_text("[]"))
    third = F.when(key % 3 == 0, F.lit(" 7")).otherwise("")
    t = table(spark, d, "orders").select("o_orderkey", either.alias("either"), scalars.array(_text("[", own, ref, third, "]")).alias("two"), _text("[", ref, " ", key, third, "]").alias("pair"))
    by = ["o_orderkey"]
    text = lambda c: F.array_join(F.transform(c, lambda x: F.coalesce(scalars.latin(F.substring(x, F.lit(2), F.length(x) - 2)), F.lit("-"))), ",")
    a = resolve.resolve_maybe_array(t, by, "either", objects, "raw", "either")
    b = resolve.resolve_items(t.select("o_orderkey", F.transform("two", scalars.ref_or_direct).alias("two")), by, "two", objects, "raw", "two", size=2)
    c = resolve.resolve_tuple(t, by, "pair", objects, "raw", "pair", [scalars.string, scalars.PARSERS["i64"]])
    return a.join(b, by).join(c, by).select("o_orderkey", text("either").alias("either"), text("two").alias("two"), scalars.text(F.col("pair._1")).alias("first"), F.col("pair._2").alias("second"))


@_query("""SELECT o_orderkey AS order_key, c_name AS name, CASE o_orderkey % 3 WHEN 0 THEN o_orderkey % 10 WHEN 1 THEN o_orderkey * 2 END AS copies, CASE o_orderkey % 3 WHEN 2 THEN 'Copies' ELSE '' END AS malformed
    FROM orders LEFT JOIN customer ON c_custkey = o_custkey""")
def resolved_fields(spark: SparkSession, d: str) -> DataFrame:
    """Fields that are references, a computed default, and a malformed value that no default hides."""
    key = F.col("o_orderkey")
    copies = F.when(key % 3 == 0, (key % 10).cast("string")).when(key % 3 == 1, "null").otherwise("/Many")
    m = table(spark, d, "orders").select("o_orderkey", scalars.dictionary(_text("<</OrderKey ", key, "/Name ", F.col("o_custkey"), " 0 R/Copies ", copies, ">>")).alias("m"))
    specs = [FieldSpec("order_key", scalars.PARSERS["i64"], required=True), FieldSpec("name", scalars.string, follow=True), FieldSpec("copies", scalars.PARSERS["i64"], default=F.col("o_orderkey") * 2)]
    done = scalars.project(m, "m", specs, _customers_as_objects(spark, d))
    return done.select("order_key", scalars.text(F.col("name")).alias("name"), "copies", F.array_join("malformed", ",").alias("malformed"))


# -- content ---------------------------------------------------------------------------------------


def _text_content(spark: SparkSession, d: str) -> DataFrame:
    """Every text object as a content stream: font, place, then a string or an array of strings and offsets."""
    t = table(spark, d, "text_objects").select("text_object_id", "font", "font_size", "pos_x", "pos_y", "text_buffer", "buffer").distinct()
    items = F.transform(F.filter("buffer", lambda x: x["txt"].isNotNull() | x["shift"].isNotNull()), lambda x: F.when(x["txt"].isNotNull(), writing.literal(writing.string_bytes(x["txt"]))).otherwise(F.concat(F.lit(" "), x["shift"].cast("decimal(20,4)").cast("string"), F.lit(" "))))
    font = F.when(F.col("font").isNotNull() & F.col("font_size").isNotNull(), F.concat(F.lit("/"), "font", F.lit(" "), F.col("font_size").cast("decimal(20,4)").cast("string"), F.lit(" Tf ")))
    place = F.when(F.col("pos_x").isNotNull() & F.col("pos_y").isNotNull(), F.concat(F.lit("1 0 0 1 "), F.col("pos_x").cast("decimal(20,4)").cast("string"), F.lit(" "), F.col("pos_y").cast("decimal(20,4)").cast("string"), F.lit(" Tm ")))
    shown = F.when(F.col("text_buffer").isNotNull(), F.concat(writing.literal(writing.string_bytes(F.col("text_buffer"))), F.lit(" Tj ")))
    array = F.when(F.col("buffer").isNotNull(), F.concat(F.lit("["), F.array_join(items, ""), F.lit("] TJ ")))
    return t.select("text_object_id", _text("q BT ", font, place, shown, array, "ET Q").alias("content"))


@_query("""WITH t AS (SELECT DISTINCT text_object_id, font, font_size, pos_x, pos_y, text_buffer, buffer FROM text_objects)
    SELECT text_object_id, 4 + CASE WHEN font IS NOT NULL AND font_size IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN pos_x IS NOT NULL AND pos_y IS NOT NULL THEN 1 ELSE 0 END
      + CASE WHEN text_buffer IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN buffer IS NOT NULL THEN 1 ELSE 0 END AS n_ops,
      CASE WHEN text_buffer IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN buffer IS NOT NULL THEN 1 ELSE 0 END AS n_show, 2 AS n_unknown, 0 AS n_errors FROM t""")
def operators_count(spark: SparkSession, d: str) -> DataFrame:
    ops = operators_of(_text_content(spark, d), ["text_object_id"], "content")
    count = lambda c: F.count_if(c).cast("int")
    return ops.groupBy("text_object_id").agg(F.count(F.lit(1)).cast("int").alias("n_ops"), count(F.col("category") == "show").alias("n_show"), count(F.col("category") == "unimplemented").alias("n_unknown"), count(F.col("error").isNotNull() | F.col("trailing_at").isNotNull()).alias("n_errors"))


@_query("""WITH t AS (SELECT DISTINCT text_object_id, font, font_size, pos_x, pos_y, text_buffer, buffer FROM text_objects),
    i AS (SELECT *, unnest(buffer) AS x, unnest(range(len(buffer))) AS pos FROM t),
    s AS (SELECT text_object_id, font, font_size, coalesce(pos_x, 0) + CASE WHEN pos_y IS NULL THEN -coalesce(pos_x, 0) ELSE 0 END AS x0, CASE WHEN pos_x IS NULL THEN 0 ELSE coalesce(pos_y, 0) END AS y0, -1 AS pos, text_buffer AS txt, CAST(NULL AS FLOAT) AS shift FROM t
      UNION ALL SELECT text_object_id, font, font_size, coalesce(pos_x, 0) + CASE WHEN pos_y IS NULL THEN -coalesce(pos_x, 0) ELSE 0 END, CASE WHEN pos_x IS NULL THEN 0 ELSE coalesce(pos_y, 0) END, pos, x.txt, CASE WHEN x.txt IS NULL THEN x.shift END FROM i),
    w AS (SELECT *, sum(coalesce(CAST(shift AS DOUBLE), 0)) OVER (PARTITION BY text_object_id ORDER BY pos) AS moved FROM s)
    SELECT text_object_id, CAST(row_number() OVER (PARTITION BY text_object_id ORDER BY pos) - 1 AS INTEGER) AS span_ord, CAST(floor((x0 - moved / 1000 + 0.0001) * 10) AS BIGINT) AS x_tenth, CAST(floor((y0 + 0.0001) * 10) AS BIGINT) AS y_tenth, txt AS text,
      CASE WHEN font_size IS NULL THEN NULL ELSE font END AS font, CASE WHEN font IS NULL THEN NULL ELSE font_size END AS font_size FROM w WHERE txt IS NOT NULL""")
def text_positions(spark: SparkSession, d: str) -> DataFrame:
    spans = textstate.text_spans(operators_of(_text_content(spark, d), ["text_object_id"], "content"), ["text_object_id"])
    # positions are single floats: tenths are compared, away from their edges
    tenth = lambda c: F.floor((F.col(c).cast("double") + 0.0001) * 10).cast("bigint")
    return spans.select("text_object_id", "span_ord", tenth("x").alias("x_tenth"), tenth("y").alias("y_tenth"), "text", "font", "font_size")


@_query("""WITH t AS (SELECT DISTINCT text_object_id, text_buffer, buffer FROM text_objects)
    SELECT text_object_id, chr(10) || coalesce(text_buffer, '') || coalesce((SELECT string_agg(u.x.txt, '' ORDER BY u.pos) FROM (SELECT unnest(buffer) AS x, unnest(range(len(buffer))) AS pos) u), '') AS page_text FROM t""")
def page_text(spark: SparkSession, d: str) -> DataFrame:
    return textstate.page_text(operators_of(_text_content(spark, d), ["text_object_id"], "content"), ["text_object_id"]).drop("error")


@_query("""WITH e AS (SELECT user_id, event_id, value, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn, event_id % 4 AS k FROM events),
    w AS (SELECT user_id, event_id, k, round(coalesce(last_value(CASE WHEN k = 0 THEN round(value * 4) / 4 END IGNORE NULLS) OVER s, 0) * 100) AS cs, round(coalesce(last_value(CASE WHEN k = 1 THEN round(value * 4) / 4 END IGNORE NULLS) OVER s, 0) * 100) AS ld, sum(CASE WHEN k = 2 THEN 1 ELSE 0 END) OVER s AS n
      FROM e WINDOW s AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
    SELECT user_id, CAST(event_id AS VARCHAR) AS text, CAST(cs AS BIGINT) AS char_spacing_hundredth, CAST(ld AS BIGINT) AS leading_hundredth FROM w WHERE k = 3""")
def text_state_running(spark: SparkSession, d: str) -> DataFrame:
    """State set by some operators and seen by the ones that show text, a page for each user."""
    e = table(spark, d, "events").select("user_id", F.col("event_id").alias("op_ord"), (F.col("event_id") % 4).alias("k"), (F.round(F.col("value") * 4) / 4).alias("v"))
    op = F.when(F.col("k") == 0, "Tc").when(F.col("k") == 1, "TL").when(F.col("k") == 2, "T*").otherwise("Tj")
    nums = F.when(F.col("k") < 2, F.array(F.coalesce("v", F.lit(0.0))))
    ops = e.select("user_id", "op_ord", op.alias("op"), nums.alias("nums"), F.lit(None).cast("binary").alias("name"), F.when(F.col("k") == 3, _text(F.col("op_ord"))).alias("text"), F.lit(None).cast("array<struct<text:binary,offset:double>>").alias("items"))
    begin = e.groupBy("user_id").agg((F.min("op_ord") - 1).alias("op_ord")).select("user_id", "op_ord", F.lit("BT").alias("op"), *[F.lit(None).cast(t).alias(n) for n, t in ops.dtypes[3:]])
    spans = textstate.text_spans(ops.unionByName(begin), ["user_id"])
    cents = lambda c: F.round(F.col(c) * 100).cast("bigint")
    return spans.select("user_id", "text", cents("char_spacing").alias("char_spacing_hundredth"), cents("leading").alias("leading_hundredth"))


@_query("""WITH o AS (SELECT o_orderkey, o_orderkey % 7 + 1 AS n, unnest([0, 1]) AS t FROM orders), k AS (SELECT *, n + t AS m, unnest([0, 1, 2, 3]) AS s FROM o)
    SELECT o_orderkey, CAST(t AS INTEGER) AS text_obj_ord, CAST(s AS INTEGER) AS span_ord, CAST(0 AS FLOAT) AS x, CAST(-(s + 1) * m AS FLOAT) AS y, chr(CAST(97 + s AS INTEGER)) AS text, 'F1' AS font, CAST(m AS DOUBLE) AS leading,
      CAST(CASE WHEN s = 3 THEN 3 * m ELSE m + 20 END AS DOUBLE) AS char_spacing, CAST(CASE WHEN s = 3 THEN 2 * m ELSE m END AS DOUBLE) AS word_spacing, CAST(100 + m AS DOUBLE) AS horizontal_scaling, CAST(m % 8 AS DOUBLE) AS rendering_mode, CAST(-m AS DOUBLE) AS rise, CAST(t * 5 AS DOUBLE) AS tint FROM k""")
def text_operators(spark: SparkSession, d: str) -> DataFrame:
    """Two text objects a page, with every operator that sets state, moves by lines or shows, and one operator more."""
    n = F.col("o_orderkey") % 7 + 1

    def one(m: Column, more: str) -> list[Column | str]:
        return [f"BT {more} /F1 9 Tf ", m, " Tw ", m + 20, " Tc ", m + 100, " Tz ", m % 8, " Tr ", -m, " Ts 0 ", -m, " TD (a) Tj T* (b) Tj (c) ' ", m * 2, " ", m * 3, ' (d) " ET ']

    pages = table(spark, d, "orders").select("o_orderkey", _text(*one(n, ""), *one(n + 1, "5 Tint")).alias("content"))
    ops = operators_of(pages, ["o_orderkey"], "content", {b"Tint": ("state", "n")})
    spans = textstate.text_spans(ops, ["o_orderkey"], parameters=textstate.PARAMETERS | {"tint": ("Tint", 0.0)})
    return spans.select("o_orderkey", "text_obj_ord", "span_ord", "x", "y", "text", "font", "leading", *textstate.PARAMETERS, "tint")


@_query("""SELECT c_custkey, m AS mode, CASE WHEN m = 'default' THEN 'F1' END AS font, CAST(CASE WHEN m = 'default' THEN c_custkey % 9 ELSE 0 END AS DOUBLE) AS word_spacing, CASE WHEN m = 'reset' THEN 'text shown before font' END AS error
    FROM (SELECT c_custkey, unnest(['default', 'reset']) AS m FROM customer)""")
def text_state_modes(spark: SparkSession, d: str) -> DataFrame:
    """State set in one text object, as the next one sees it in either mode."""
    pages = table(spark, d, "customer").select("c_custkey", _text("BT /F1 9 Tf ", F.col("c_custkey") % 9, " Tw ET BT (x) Tj ET").alias("content"))
    ops = operators_of(pages, ["c_custkey"], "content")
    both = [textstate.text_spans(ops, ["c_custkey"], mode).select("c_custkey", F.lit(mode).alias("mode"), "font", "word_spacing", "error") for mode in ("default", "reset")]
    return both[0].unionByName(both[1])


@_query("""SELECT c_custkey, CAST(0 AS INTEGER) AS text_obj_ord, CASE c_custkey % 4 WHEN 1 THEN 'text shown before font' ELSE 'incomplete text object' END AS error FROM customer WHERE c_custkey % 4 IN (1, 2)
    UNION ALL SELECT c_custkey, 1, 'text shown before font' FROM customer WHERE c_custkey % 4 = 1""")
def text_object_problems(spark: SparkSession, d: str) -> DataFrame:
    """Text objects that show before a font or never end, beside whole and empty ones."""
    k = F.col("c_custkey") % 4
    content = F.when(k == 0, "BT /F1 1 Tf (a) Tj ET").when(k == 1, "BT (a) Tj /F1 1 Tf ET BT [(b)] TJ ET").when(k == 2, "BT /F1 1 Tf (b) Tj").otherwise("q Q")
    ops = operators_of(table(spark, d, "customer").select("c_custkey", raw(content).alias("content")), ["c_custkey"], "content")
    return textstate.text_object_problems(ops, ["c_custkey"])


# -- whole files -----------------------------------------------------------------------------------


def customer_corpus(spark: SparkSession, d: str) -> Corpus:
    """The customers as files: one for every nation and hundred keys, a page for each customer."""
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), F.floor(F.col("c_custkey") / 100).alias("part"), F.struct("c_custkey", "c_name", "c_mktsegment").alias("p"))
    # a number of partitions of our own: small rows that mean much work would be merged into one task
    spread = c.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "nation", "part")
    g = spread.groupBy("nation", "part").agg(F.collect_list("p").alias("people"))

    def write(nation: int, people: list) -> bytes:
        return writing.customer_file(nation, [(p["c_custkey"], p["c_name"], p["c_mktsegment"]) for p in people])

    content = F.udf(write, "binary", useArrow=True)("nation", "people")
    return Corpus(g.select(F.concat_ws("/", F.lit("n"), F.col("nation").cast("string"), F.col("part").cast("string")).alias("path"), content.alias("content")))


_FILES = """p AS (SELECT 'n/' || c_nationkey || '/' || (c_custkey // 100) AS path, c_nationkey, c_custkey, c_name, c_mktsegment,
      CAST(row_number() OVER (PARTITION BY c_nationkey, c_custkey // 100 ORDER BY c_mktsegment, c_custkey) - 1 AS INTEGER) AS page_ord,
      CAST(dense_rank() OVER (PARTITION BY c_nationkey, c_custkey // 100 ORDER BY c_mktsegment) - 1 AS INTEGER) AS seg FROM customer)"""


@_query(f"""WITH {_FILES} SELECT path, CAST(CASE WHEN min(c_nationkey) % 2 = 1 THEN 7 + max(seg) + 2 * count(*) + 1 ELSE 5 + max(seg) + 1 + 2 * count(*) END AS BIGINT) AS size, CAST(1 AS BIGINT) AS root_obj,
    'TwoColumnLeft' AS page_layout, 'UseNone' AS page_mode, min(c_nationkey) % 2 = 1 AS was_modified, true AS is_fine FROM p GROUP BY path""")
def pdf_documents(spark: SparkSession, d: str) -> DataFrame:
    t = customer_corpus(spark, d).documents()
    return t.select("path", "size", F.col("root_ref.obj").alias("root_obj"), "page_layout", "page_mode", "was_modified", F.col("error").isNull().alias("is_fine"))


@_query(f"""WITH {_FILES}, f AS (SELECT path, min(c_nationkey) % 2 = 1 AS packed, count(*) AS n, max(seg) + 1 AS s FROM p GROUP BY path)
    SELECT path, 'plain' AS kind, CASE WHEN packed THEN n + 2 ELSE 4 + s + 2 * n END AS n_entries FROM f UNION ALL SELECT path, 'compressed', 4 + s + n FROM f WHERE packed""")
def pdf_xref(spark: SparkSession, d: str) -> DataFrame:
    return customer_corpus(spark, d).xref().groupBy("path", "kind").agg(F.count(F.lit(1)).alias("n_entries"))


@_query(f"""WITH {_FILES}, f AS (SELECT path, min(c_nationkey) % 2 = 1 AS packed, count(*) AS n, max(seg) + 1 AS s FROM p GROUP BY path)
    SELECT path, 'dictionary' AS kind, 4 + s + n AS n_objects, CAST(0 AS BIGINT) AS n_errors FROM f UNION ALL SELECT path, 'stream', CASE WHEN packed THEN n + 2 ELSE n END, 0 FROM f""")
def pdf_objects(spark: SparkSession, d: str) -> DataFrame:
    return customer_corpus(spark, d).objects().groupBy("path", "kind").agg(F.count(F.lit(1)).alias("n_objects"), F.count_if(F.col("error").isNotNull()).alias("n_errors"))


@_query(f"""WITH {_FILES} SELECT path, page_ord, CAST(CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 1000 + 1 ELSE 600 + c_nationkey END AS FLOAT) AS xmax, CAST(CASE WHEN c_custkey % 3 = 0 THEN 100.5 ELSE 792 END AS FLOAT) AS ymax,
    CAST(90 * (seg % 4) AS INTEGER) AS rotate, CAST(1 AS FLOAT) AS user_unit, CAST(3 AS BIGINT) AS resources_obj, CAST(4 AS BIGINT) AS font_obj, 1 AS n_contents FROM p""")
def pdf_pages(spark: SparkSession, d: str) -> DataFrame:
    t = customer_corpus(spark, d).pages()
    return t.select("path", "page_ord", F.col("media_box.xmax").alias("xmax"), F.col("media_box.ymax").alias("ymax"), "rotate", "user_unit", F.col("resources.obj").alias("resources_obj"), F.try_element_at("fonts", F.lit("F1"))["obj"].alias("font_obj"), F.size("contents").alias("n_contents"))


@_query(f"""WITH {_FILES} SELECT path, page_ord, 'BT /F1 ' || (c_custkey % 5 + 8) || ' Tf 1 0 0 1 ' || (c_custkey % 500) || '.25 700 Tm (' || c_name || ') Tj 0 -12.5 Td [(' || c_mktsegment || ') -250 (x)] TJ ET' AS content FROM p""")
def pdf_page_content(spark: SparkSession, d: str) -> DataFrame:
    return customer_corpus(spark, d).page_content().select("path", "page_ord", scalars.latin(F.col("content")).alias("content"))


@_query(f"""WITH {_FILES} SELECT path, page_ord, CAST(o AS INTEGER) AS op_ord, ['BT', 'Tf', 'Tm', 'Tj', 'Td', 'TJ', 'ET'][o + 1] AS op, ['delimiter', 'state', 'position', 'show', 'position', 'show', 'delimiter'][o + 1] AS category
    FROM (SELECT path, page_ord, unnest(range(7)) AS o FROM p)""")
def pdf_operators(spark: SparkSession, d: str) -> DataFrame:
    return customer_corpus(spark, d).operators().select("path", "page_ord", "op_ord", "op", "category")


@_query(f"""WITH {_FILES}, s AS (SELECT *, unnest([0, 1, 2]) AS o FROM p)
    SELECT path, page_ord, 0 AS text_obj_ord, CAST(o AS INTEGER) AS span_ord, CAST(c_custkey % 500 + 0.25 + CASE WHEN o = 2 THEN 0.25 ELSE 0 END AS FLOAT) AS x, CAST(CASE WHEN o = 0 THEN 700 ELSE 687.5 END AS FLOAT) AS y,
      CASE o WHEN 0 THEN c_name WHEN 1 THEN c_mktsegment ELSE 'x' END AS text, 'F1' AS font, CAST(c_custkey % 5 + 8 AS FLOAT) AS font_size FROM s""")
def pdf_text_spans(spark: SparkSession, d: str) -> DataFrame:
    return customer_corpus(spark, d).text_spans().select("path", "page_ord", "text_obj_ord", "span_ord", "x", "y", "text", "font", "font_size")


@_query(f"WITH {_FILES} SELECT path, page_ord, chr(10) || c_name || c_mktsegment || 'x' AS page_text FROM p")
def pdf_page_text(spark: SparkSession, d: str) -> DataFrame:
    return customer_corpus(spark, d).page_text().select("path", "page_ord", "page_text")


def _supplier_corpus(spark: SparkSession, d: str, write: Callable[[int, str], bytes], **options: object) -> Corpus:
    content = F.udf(write, "binary", useArrow=True)("s_suppkey", "s_name")
    return Corpus(table(spark, d, "supplier").select(F.concat(F.lit("s/"), F.col("s_suppkey").cast("string")).alias("path"), content.alias("content")), **options)  # type: ignore[arg-type]


@_query("""WITH s AS (SELECT 's/' || s_suppkey AS path, s_suppkey % 2 = 0 AS even, s_name FROM supplier), m AS (SELECT *, unnest(['default', 'reference']) AS mode FROM s)
    SELECT path, mode, CAST(3 AS BIGINT) AS n_sections, CASE WHEN mode = 'default' THEN CASE WHEN even THEN '1,2,3,4,8,11' ELSE '1,2,3,4,8,10,11' END ELSE CASE WHEN even THEN '1,2,3,4,8,9,11' ELSE '1,2,3,4,8,9,10,11' END END AS objects,
      CASE WHEN even AND mode = 'default' THEN reverse(s_name) ELSE s_name END AS said, true AS agrees FROM m""")
def pdf_revisions(spark: SparkSession, d: str) -> DataFrame:
    """Files of three sections that change and free objects, lengths of streams being references: both modes."""
    out = None
    for mode in ("default", "reference"):
        c = _supplier_corpus(spark, d, writing.revised_file, mode=mode)
        numbers = lambda t, name: t.where("obj is not null").groupBy("path").agg(F.array_join(F.array_sort(F.collect_list("obj")), ",").alias(name))
        n = c.xref_sections().groupBy("path").agg(F.count(F.lit(1)).alias("n_sections"))
        said = c.text_spans().select("path", F.col("text").alias("said"))
        both = numbers(c.xref(), "objects").join(numbers(c.objects(), "read"), "path").join(n, "path").join(said, "path")
        both = both.select("path", F.lit(mode).alias("mode"), "n_sections", "objects", "said", (F.col("objects") == F.col("read")).alias("agrees"))
        out = both if out is None else out.unionByName(both)
    return out  # type: ignore[return-value]


@_query("""WITH s AS (SELECT 's/' || s_suppkey AS path, s_suppkey % 5 AS k, s_name FROM supplier)
    SELECT path, CAST(NULL AS INTEGER) AS page_ord, CAST(NULL AS VARCHAR) AS text, CASE k WHEN 1 THEN 'the catalog is missing' WHEN 2 THEN 'startxref is missing' ELSE 'the chain of sections is a ring' END AS error FROM s WHERE k IN (1, 2)
    UNION ALL SELECT path, 0, s_name, NULL FROM s WHERE k = 0 UNION ALL SELECT path, 1, NULL, 'a kid is missing' FROM s WHERE k IN (0, 4) UNION ALL SELECT path, 0, NULL, 'unsupported filter LZWDecode' FROM s WHERE k = 4
    UNION ALL SELECT path, NULL, NULL, 'the chain of sections is a ring' FROM s WHERE k = 3""")
def pdf_damage(spark: SparkSession, d: str) -> DataFrame:
    """Damaged files: what could be read, and a row for what could not."""
    return _supplier_corpus(spark, d, writing.damaged_file).text_spans().select("path", "page_ord", "text", "error")


@_query("""SELECT 's/' || s_suppkey AS path, s_name AS text, CAST(s_suppkey % 100 + 1 AS FLOAT) AS xmax, CAST(3 AS BIGINT) AS n_members FROM supplier""")
def pdf_extended_streams(spark: SparkSession, d: str) -> DataFrame:
    """Objects found through an object stream that extends another one."""
    c = _supplier_corpus(spark, d, writing.extended_file)
    members = c.objects().where("obj < 4 and error is null").groupBy("path").agg(F.count(F.lit(1)).alias("n_members"))
    pages = c.pages().select("path", F.col("media_box.xmax").alias("xmax"))
    return c.text_spans().select("path", "text").join(pages, "path").join(members, "path").select("path", "text", "xmax", "n_members")


@_query(f"WITH {_FILES} SELECT path, page_ord, chr(10) || c_name || c_mktsegment || 'x' AS page_text FROM p")
def pdf_written_text(spark: SparkSession, d: str) -> DataFrame:
    """The text of pages written to a sink and read again, in the folder that all executors share."""
    at = f"{ensure_checkpoint_dir(spark)}/written-{uuid.uuid4().hex}"
    customer_corpus(spark, d).page_text().select("path", "page_ord", "page_text").write.json(at)
    return spark.read.schema("path string, page_ord int, page_text string").json(at)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, (f, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _QUERIES.items() if sql}
