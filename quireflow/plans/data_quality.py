"""Queries of the general data-pipeline operators, with the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quireflow.operators import changefeed, hierarchy, orphans, timestamps
from quireflow.session import cut, few, table


def _references(spark: SparkSession, d: str) -> DataFrame:
    return orphans.object_references(table(spark, d, "xref_blocks"), table(spark, d, "page_resources"))


def _month() -> Column:
    return F.date_format("at", "yyyy-MM").alias("ref_month")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    lost = orphans.orphan_references(_references(spark, d), table(spark, d, "objects"), ["path", "obj", "gen"])
    return lost.select("ref_table", "ref_id", "slot", _month()).distinct()


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    refs = _references(spark, d).distinct().select("*", _month())
    return orphans.orphan_report(refs, table(spark, d, "objects"), ["path", "obj", "gen"], ["ref_table", "ref_month"])


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.hierarchy(table(spark, d, "page_nodes"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return changefeed.current_entries(table(spark, d, "xref_blocks"), table(spark, d, "pdf_files"))


def _dated(spark: SparkSession, d: str) -> DataFrame:
    """page_props with the archive of the file, its zone and its order of day and month."""
    files = table(spark, d, "pdf_files").dropna(subset=["path"]).groupBy("path").agg(F.max("archive_key").alias("archive_key"))
    archives = table(spark, d, "archives").groupBy("archive_key").agg(F.max_by(F.struct("tz", "day_first"), F.struct("title", "tz", "day_first")).alias("a")).select("archive_key", "a.tz", "a.day_first")
    props = table(spark, d, "page_props").select("prop_id", "path", "last_modified", "date_offset", "received_at")
    return props.join(files, "path", "left").join(archives, "archive_key", "left")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    done = timestamps.normalise_timestamps(_dated(spark, d), "last_modified", "date_offset", "tz", "day_first")
    # the filter stays above the aggregate; on the plain column it would be pushed down and parse every text twice
    return done.where("prop_id is not null").groupBy("prop_id").agg(F.max("utc_us").alias("utc_us")).where("utc_us is not null")


def _read(spark: SparkSession, d: str) -> DataFrame:
    """Each distinct text with its local time, its instant and where its zone came from."""
    rows = timestamps.normalise_timestamps(_dated(spark, d), "last_modified", "date_offset", "tz", "day_first", local="local_us", source="zone_from")
    return rows.select("prop_id", "archive_key", "tz", "local_us", "utc_us", "zone_from").distinct()


def _zones(spark: SparkSession, d: str, rows: DataFrame) -> DataFrame:
    """For every archive the zone whose offset history fits the texts that name a zone of their own best."""
    candidates = [r[0] for r in few(table(spark, d, "archives").select("tz").dropna().distinct().orderBy("tz"), 1000)]
    own = F.col("zone_from") == "text"
    # no filter: it would be pushed down and parse every text a second time
    seen = rows.select("archive_key", "tz", F.when(own, F.col("local_us")).alias("local_us"), F.when(own, F.col("utc_us")).alias("utc_us"))
    return timestamps.estimate_zones(seen, ["archive_key", "tz"], "local_us", "utc_us", candidates, exact=True).where("archive_key is not null")


def p5_zones(spark: SparkSession, d: str) -> DataFrame:
    """For every archive, also those whose zone is unknown, the estimated zone and how many observations speak against it."""
    return _zones(spark, d, _read(spark, d))


def p5_estimated(spark: SparkSession, d: str) -> DataFrame:
    """Texts without any zone, of archives without one: the instant by the archive's estimated zone, beside UTC's."""
    rows = cut(_read(spark, d))
    zones = _zones(spark, d, rows).where("tz is null").select("archive_key", "zone")
    bare = rows.where("zone_from = 'none'").join(zones, "archive_key")
    return bare.select("prop_id", "archive_key", "zone", "utc_us", timestamps.convert_local(F.col("local_us"), F.col("zone")).alias("estimated_us"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_report, p3_found, p4_found, p5_found, p5_zones, p5_estimated)}


_REFS = """
refs AS (
  SELECT DISTINCT 'xref_blocks.xrefs' AS ref_table, block_id AS ref_id, CAST(pos AS VARCHAR) AS slot, path,
         CASE WHEN x.kind = 'plain' THEN x.obj ELSE x.stream_id END AS obj, CASE WHEN x.kind = 'plain' THEN x.gen ELSE 0 END AS gen, recorded_at AS at_time
  FROM (SELECT block_id, path, recorded_at, unnest(xrefs) AS x, unnest(range(len(xrefs))) AS pos FROM xref_blocks) WHERE x.kind IN ('plain', 'compressed')
  UNION
  SELECT DISTINCT 'xref_blocks.root', block_id, 'root', path, root.obj, root.gen, recorded_at FROM xref_blocks
  UNION
  SELECT DISTINCT 'page_resources.font', resource_id, e.key, path, e.value.obj, e.value.gen, recorded_at
  FROM (SELECT resource_id, path, recorded_at, unnest(map_entries(font)) AS e FROM page_resources)
),
kept AS (SELECT * FROM refs WHERE path IS NOT NULL AND obj IS NOT NULL AND gen IS NOT NULL),
lost AS (
  SELECT * FROM kept r WHERE NOT EXISTS (
    SELECT 1 FROM objects o WHERE o.path = r.path AND o.obj = r.obj AND o.gen = r.gen AND o.recorded_at <= r.at_time AND (o.removed_at IS NULL OR o.removed_at > r.at_time))
)
"""

_P3 = """
WITH RECURSIVE nodes AS (SELECT DISTINCT path, obj, gen, kids, resources_ref FROM page_nodes),
edges AS (
  SELECT DISTINCT n.path, n.up, m.obj FROM (SELECT path, obj AS up, unnest(kids) AS k FROM nodes) n JOIN nodes m ON m.path = n.path AND m.obj = n.k.obj AND m.gen = n.k.gen
),
walk AS (
  SELECT path, obj, obj AS root_obj, 0 AS depth_no, [obj] AS way, coalesce(resources_ref.obj, -1) AS res_obj FROM nodes n
  WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.path = n.path AND e.obj = n.obj)
  UNION ALL
  SELECT w.path, e.obj, w.root_obj, w.depth_no + 1, list_append(w.way, e.obj), coalesce(n.resources_ref.obj, w.res_obj)
  FROM walk w JOIN edges e ON e.path = w.path AND e.up = w.obj JOIN nodes n ON n.path = e.path AND n.obj = e.obj WHERE NOT list_contains(w.way, e.obj)
),
below AS (
  SELECT path, up AS anc, obj FROM edges
  UNION
  SELECT b.path, b.anc, e.obj FROM below b JOIN edges e ON e.path = b.path AND e.up = b.obj
),
sums AS (SELECT path, anc AS obj, count(*) FILTER (WHERE anc <> obj) AS n_below, max(CASE WHEN anc = obj THEN 1 ELSE 0 END) AS on_cycle FROM below GROUP BY 1, 2)
SELECT n.path, n.obj, coalesce(w.root_obj, -1) AS root_obj, CAST(coalesce(w.depth_no, -1) AS INTEGER) AS depth_no, coalesce(array_to_string(w.way, '/'), '') AS tree_path,
       CAST(coalesce(s.on_cycle, 0) AS INTEGER) AS on_cycle, CAST(coalesce(s.n_below, 0) AS INTEGER) AS n_below, coalesce(w.res_obj, -1) AS res_obj
FROM nodes n LEFT JOIN walk w ON w.path = n.path AND w.obj = n.obj LEFT JOIN sums s ON s.path = n.path AND s.obj = n.obj
"""

_P4 = """
WITH RECURSIVE blocks AS (SELECT path, start_pos, any_value(prev) AS prev, any_value(xrefs) AS xrefs FROM xref_blocks GROUP BY 1, 2),
heads AS (SELECT DISTINCT path, startxref FROM pdf_files WHERE startxref IS NOT NULL),
chain AS (
  SELECT b.path, b.start_pos, b.prev, 0 AS ord, [b.start_pos] AS seen FROM heads h JOIN blocks b ON b.path = h.path AND b.start_pos = h.startxref
  UNION ALL
  SELECT b.path, b.start_pos, b.prev, c.ord + 1, list_append(c.seen, b.start_pos) FROM chain c JOIN blocks b ON b.path = c.path AND b.start_pos = c.prev WHERE NOT list_contains(c.seen, b.start_pos)
),
entries AS (
  SELECT path, ord, pos, x FROM (SELECT c.path, c.ord, unnest(b.xrefs) AS x, unnest(range(len(b.xrefs))) AS pos FROM chain c JOIN blocks b ON b.path = c.path AND b.start_pos = c.start_pos)
  WHERE x.kind IN ('plain', 'compressed', 'free') AND x.obj IS NOT NULL
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY path, x.obj ORDER BY ord, pos DESC) AS rn FROM entries)
SELECT path, x.obj AS obj, coalesce(x.gen, -1) AS gen, coalesce(x.byte_pos, -1) AS byte_pos, coalesce(x.stream_id, -1) AS stream_id, coalesce(x.idx, -1) AS idx FROM ranked WHERE rn = 1 AND x.kind <> 'free'
"""


_P5 = r"""
WITH z(name, minutes) AS (VALUES ('Z', 0), ('UT', 0), ('UTC', 0), ('GMT', 0), ('WET', 0), ('WEST', 60), ('BST', 60), ('CET', 60), ('CEST', 120), ('EET', 120), ('EEST', 180), ('MSK', 180), ('EST', -300), ('EDT', -240), ('CST', -360), ('CDT', -300), ('MST', -420), ('MDT', -360), ('PST', -480), ('PDT', -420), ('JST', 540), ('AEST', 600), ('AEDT', 660), ('NZST', 720), ('NZDT', 780)),
f AS (SELECT path, max(archive_key) AS archive_key FROM pdf_files WHERE path IS NOT NULL GROUP BY 1),
t AS (SELECT DISTINCT prop_id, date_offset, a.tz, coalesce(a.day_first, true) AS day_first, trim(CASE WHEN trim(last_modified) LIKE '(%)' THEN trim(trim(last_modified), '()') ELSE last_modified END) AS s
  FROM page_props p LEFT JOIN f USING (path) LEFT JOIN archives a USING (archive_key) WHERE last_modified IS NOT NULL AND prop_id IS NOT NULL),
g AS (SELECT *, regexp_extract(s, '^D:(\d{4})(\d\d)?(\d\d)?(\d\d)?(\d\d)?(\d\d)?(.*)$', ['y', 'm', 'd', 'h', 'i', 'sec', 'tail']) AS a, regexp_extract(s, '^(\d{4})(\d\d)(\d\d)T?(\d\d)(\d\d)(\d\d)(.*)$', ['y', 'm', 'd', 'h', 'i', 'sec', 'tail']) AS b,
  regexp_extract(s, '^(\d{4})-(\d+)-(\d+)(?:[T ](\d+):(\d+)(?::(\d+(?:\.\d+)?))?)?(.*)$', ['y', 'm', 'd', 'h', 'i', 'sec', 'tail']) AS c, regexp_extract(s, '^(\d+)[./](\d+)[./](\d{4})(?: +(\d+):(\d+)(?::(\d+))?)? *([AP]M)?(.*)$', ['d', 'm', 'y', 'h', 'i', 'sec', 'half', 'tail']) AS e,
  regexp_extract(s, '^(?:[A-Za-z]+, )?(\d+) ([A-Z][a-z]+) (\d{4})(?: (\d+):(\d+)(?::(\d+))?)?(.*)$', ['d', 'm', 'y', 'h', 'i', 'sec', 'tail']) AS n, regexp_extract(s, '^([A-Z][a-z]+) (\d+), (\d{4})(?: (\d+):(\d+)(?::(\d+))?)? *([AP]M)?(.*)$', ['m', 'd', 'y', 'h', 'i', 'sec', 'half', 'tail']) AS u FROM t),
p AS (SELECT prop_id, date_offset, tz, s, coalesce(nullif(a.y, ''), nullif(b.y, ''), nullif(c.y, ''), nullif(e.y, ''), nullif(n.y, ''), nullif(u.y, '')) AS y,
  CASE WHEN a.y <> '' THEN a.m WHEN b.y <> '' THEN b.m WHEN c.y <> '' THEN c.m WHEN e.y <> '' THEN CASE WHEN day_first OR s LIKE '%.%.%' THEN e.m ELSE e.d END
    ELSE CAST((strpos('janfebmaraprmayjunjulaugsepoctnovdec', lower(left(n.m || u.m, 3))) + 2) // 3 AS VARCHAR) END AS m,
  CASE WHEN a.y <> '' THEN a.d WHEN b.y <> '' THEN b.d WHEN c.y <> '' THEN c.d WHEN e.y <> '' THEN CASE WHEN day_first OR s LIKE '%.%.%' THEN e.d ELSE e.m END ELSE n.d || u.d END AS d,
  a.h || CASE WHEN a.y = '' THEN b.h || c.h || e.h || n.h || u.h ELSE '' END AS h, a.i || CASE WHEN a.y = '' THEN b.i || c.i || e.i || n.i || u.i ELSE '' END AS i, a.sec || CASE WHEN a.y = '' THEN b.sec || c.sec || e.sec || n.sec || u.sec ELSE '' END AS sec,
  e.half || u.half AS half, regexp_replace(a.tail || CASE WHEN a.y = '' THEN b.tail || c.tail || e.tail || n.tail || u.tail ELSE '' END, '[][ '':]', '', 'g') AS zone FROM g),
l AS (SELECT *, TRY_CAST(y || '-' || lpad(coalesce(nullif(m, ''), '1'), 2, '0') || '-' || lpad(coalesce(nullif(d, ''), '1'), 2, '0') || ' ' || lpad(CAST(CASE half WHEN '' THEN CAST(coalesce(nullif(h, ''), '0') AS INTEGER) WHEN 'AM' THEN CAST(h AS INTEGER) % 12 ELSE CAST(h AS INTEGER) % 12 + 12 END AS VARCHAR), 2, '0')
    || ':' || coalesce(nullif(i, ''), '00') || ':' || CASE WHEN sec = '' THEN '00' ELSE sec END AS TIMESTAMP) AS local,
  CASE WHEN zone = '' THEN date_offset WHEN regexp_matches(zone, '^[+-]\d{2}(\d\d)?$') THEN CAST(left(zone, 1) || '1' AS INTEGER) * (60 * CAST(substr(zone, 2, 2) AS INTEGER) + CAST(coalesce(nullif(substr(zone, 4), ''), '0') AS INTEGER))
    WHEN regexp_matches(zone, '^Z0+$') THEN 0 ELSE (SELECT minutes FROM z WHERE z.name = upper(zone)) END AS fixed,
  CASE WHEN zone = '' THEN coalesce(tz, 'UTC') WHEN zone LIKE '%/%' THEN zone END AS named FROM p WHERE y IS NOT NULL),
w AS (SELECT prop_id, local, fixed, named, timezone(named, local) AS inst FROM l WHERE local IS NOT NULL AND s <> '' AND NOT regexp_matches(s, '^\d+$')
  UNION ALL SELECT prop_id, local, CASE WHEN named IS NULL THEN fixed ELSE date_offset END, named, timezone(named, local) FROM l WHERE local IS NOT NULL AND regexp_matches(s, '^\d{14}$'))
SELECT prop_id, max(CASE WHEN fixed IS NOT NULL THEN epoch_us(local) - CAST(fixed AS BIGINT) * 60000000 WHEN timezone(named, inst - INTERVAL 1 HOUR) = local THEN epoch_us(inst) - 3600000000 ELSE epoch_us(inst) END) AS utc_us FROM w WHERE fixed IS NOT NULL OR named IS NOT NULL GROUP BY 1
UNION ALL SELECT DISTINCT prop_id, CAST(s AS BIGINT) * CASE WHEN length(s) < 12 THEN 1000000 WHEN length(s) < 14 THEN 1000 ELSE 1 END FROM t WHERE regexp_matches(s, '^(\d{9,11}|\d{13}|\d{15,18})$')
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"WITH {_REFS} SELECT DISTINCT ref_table, ref_id, slot, strftime(at_time, '%Y-%m') AS ref_month FROM lost",
        "p1_report": f"""WITH {_REFS}, n AS (SELECT ref_table, strftime(at_time, '%Y-%m') AS ref_month, count(*) AS n_refs FROM kept GROUP BY 1, 2),
            m AS (SELECT ref_table, strftime(at_time, '%Y-%m') AS ref_month, count(*) AS n_orphans FROM lost GROUP BY 1, 2)
            SELECT n.ref_table, n.ref_month, n.n_refs, coalesce(m.n_orphans, 0) AS n_orphans FROM n LEFT JOIN m ON n.ref_table = m.ref_table AND n.ref_month IS NOT DISTINCT FROM m.ref_month""",
        "p3_found": _P3,
        "p4_found": _P4,
        "p5_found": _P5,
    }
