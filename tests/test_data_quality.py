"""The general data-pipeline operators against brute force, and their defined edge cases."""

import random
from datetime import datetime, timedelta
from pathlib import Path
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from quireflow.operators import changefeed, hierarchy, orphans, resolve, timestamps

T0 = datetime(2020, 1, 1)


def at(days):
    return None if days is None else T0 + timedelta(days=days)


# -- references to records that do not exist -------------------------------------------------------

REFS = "ref_id int, path string, obj bigint, gen int, at timestamp_ntz, recorded_at string"
PARENTS = "path string, obj bigint, gen int, recorded_at timestamp_ntz, removed_at timestamp_ntz, ref_id string"


def test_orphans_against_brute_force(spark):
    rng = random.Random(1)
    day = lambda: rng.choice([None, *range(0, 200, 7)])
    parents = [(rng.choice("abc"), rng.randint(1, 6), rng.randint(0, 1), at(day()), at(day()), "x") for _ in range(150)]
    parents += [("a", 1, 0, at(5), at(5), "x"), ("a", None, 0, at(0), None, "x"), (None, 1, 0, at(0), None, "x")] + parents[:9]
    refs = [(i, rng.choice(["a", "b", "c", None]), rng.choice([1, 2, 3, 4, 5, 6, 9, None]), rng.randint(0, 1), at(day()), "y") for i in range(300)]
    valid = lambda r: any((p[0], p[1], p[2]) == (r[1], r[2], r[3]) and p[3] and r[4] and p[3] <= r[4] and (not p[4] or p[4] > r[4]) for p in parents)
    want = sorted(r[0] for r in refs if r[1] is not None and r[2] is not None and not valid(r))
    df = spark.createDataFrame(refs, REFS)
    got = orphans.orphan_references(df, spark.createDataFrame(parents, PARENTS), ["path", "obj", "gen"])
    assert got.columns == df.columns and sorted(r.ref_id for r in got.collect()) == want
    none = orphans.orphan_references(df, spark.createDataFrame([], PARENTS), ["path", "obj", "gen"])
    assert none.count() == df.dropna(subset=["path", "obj", "gen"]).count()
    assert orphans.orphan_references(df.limit(0), spark.createDataFrame(parents, PARENTS), ["path", "obj", "gen"]).count() == 0
    report = {r.path: (r.n_refs, r.n_orphans) for r in orphans.orphan_report(df, spark.createDataFrame(parents, PARENTS), ["path", "obj", "gen"], ["path"]).collect()}
    assert None not in report and sum(v[1] for v in report.values()) == len(want)


# -- hierarchies -----------------------------------------------------------------------------------

NODES = "path string, obj bigint, gen int, kids array<struct<obj:bigint,gen:int>>, resources_ref struct<obj:bigint,gen:int>, recorded_at timestamp_ntz, n int, rank string"


def forest(rng, n):
    """Nodes with random kids: trees, shared kids, rings, dangling and repeated kids, null and empty lists."""
    rows = []
    for path in "pqrstuvw":
        for i in range(n):
            kids = [(rng.randint(i + 1, n + 2), 0) for _ in range(rng.choice([0, 1, 1, 2]))]
            if rng.random() < 0.1:
                kids += [(rng.randint(0, n), rng.choice([0, 0, 1, None]))]
            rows.append((path, i, 0, rng.choice([kids, kids, kids or None, kids + kids]), (100 + i, 0) if rng.random() < 0.3 else None, T0, i, "x"))
    return rows


def brute_hierarchy(rows):
    node = {(r[0], r[1]): r for r in rows}
    kids = {k: sorted({(k[0], c[0]) for c in (r[3] or []) if c[1] is not None and (k[0], c[0]) in node and node[(k[0], c[0])][2] == c[1]}) for k, r in node.items()}
    child = {c for k in kids for c in kids[k]}
    way = {k: [k] for k in node if k not in child}
    level = sorted(way)
    while level:
        step = {}
        for k in sorted(level):
            for c in kids[k]:
                if c not in way and (c not in step or step[c][-1] > k):
                    step[c] = [*way[k]]
                    step[c][-1:] = [k]
        way |= {c: [*w, c] for c, w in step.items()}
        level = list(step)
    out = []
    for k, r in node.items():
        seen, todo = set(), list(kids[k])
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += kids[x]
        w = way.get(k)
        res = next((node[x][4][0] for x in reversed(w) if node[x][4]), -1) if w else -1
        out.append((*k, w[0][1] if w else -1, len(w) - 1 if w else -1, "/".join(str(x[1]) for x in w) if w else "", int(k in seen), len(seen - {k}), res))
    return sorted(out)


def test_hierarchy_against_brute_force(spark):
    rows = forest(random.Random(3), 14)
    df = spark.createDataFrame(rows + rows[:20] + [(None, 1, 0, None, None, T0, 0, ""), ("p", None, 0, None, None, T0, 0, "")], NODES)
    assert sorted(tuple(r) for r in hierarchy.hierarchy(df).collect()) == brute_hierarchy(rows)


def test_hierarchy_sizes_and_edges(spark):
    chain = [("deep", i, 0, [(i + 1, 0)], None, T0, 0, "") for i in range(600)] + [("self", 1, 0, [(1, 0)], (7, 0), T0, 0, ""), ("old", 1, 0, None, (1, 0), T0, 0, ""), ("old", 1, 0, None, (2, 0), at(1), 0, "")]
    got = {(r.path, r.obj): r for r in hierarchy.hierarchy(spark.createDataFrame(chain, NODES)).collect()}
    assert got[("deep", 599)].depth_no == 599 and got[("deep", 0)].n_below == 599 and got[("deep", 599)].tree_path.startswith("0/1/2/")
    assert got[("self", 1)].on_cycle == 1 and got[("self", 1)].root_obj == -1 and got[("self", 1)].res_obj == -1
    assert got[("old", 1)].res_obj == 2
    assert hierarchy.hierarchy(spark.createDataFrame([], NODES)).count() == 0


def test_hierarchy_takes_very_deep_trees(spark):
    n = 5000
    chain = spark.range(n).selectExpr("'deep' as path", "id as obj", "0 as gen", "array(struct(id + 1 as obj, 0 as gen)) as kids", "cast(null as struct<obj:bigint,gen:int>) as resources_ref", "timestamp_ntz '2020-01-01 00:00:00' as recorded_at")
    got = hierarchy.hierarchy(chain).agg(F.max("depth_no"), F.max("n_below"), F.sum("n_below"), F.max("on_cycle"), F.max(F.length("tree_path"))).first()
    assert tuple(got) == (n - 1, n - 1, n * (n - 1) // 2, 0, len("/".join(map(str, range(n)))))


def test_hierarchy_joins_and_has_no_python(spark):
    # two rings that share a node, a tree below them, and a second parent
    rows = [("p", 1, 0, [(2, 0), (4, 0)], None, T0, 0, ""), ("p", 2, 0, [(3, 0)], None, T0, 0, ""), ("p", 3, 0, [(1, 0), (4, 0)], None, T0, 0, ""), ("p", 4, 0, [(1, 0), (5, 0)], None, T0, 0, ""), ("p", 5, 0, None, None, T0, 0, ""), ("p", 9, 0, [(5, 0), (2, 0)], (7, 0), T0, 0, "")]
    got = hierarchy.hierarchy(spark.createDataFrame(rows, NODES))
    assert sorted(tuple(r) for r in got.collect()) == brute_hierarchy(rows)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" in plan and "MapIn" not in plan


# -- change feeds ----------------------------------------------------------------------------------

BLOCKS = "block_id bigint, path string, start_pos bigint, prev bigint, xrefs array<struct<obj:bigint,gen:int,kind:string,byte_pos:bigint,stream_id:bigint,idx:bigint>>, recorded_at timestamp_ntz, ord int, s string"
FILES = "path string, startxref bigint, received_at timestamp_ntz, a string"


def brute_feed(blocks, files):
    at_pos = {(b[1], b[2]): b for b in blocks}
    out = []
    for path, start, *_ in files:
        state, seen, pos = {}, set(), start
        while pos is not None and (path, pos) in at_pos and pos not in seen:
            seen.add(pos)
            block = at_pos[(path, pos)]
            mine = {}
            for e in block[4] or []:
                if e[2] in ("plain", "compressed", "free") and e[0] is not None:
                    mine[e[0]] = e
            state = mine | state
            pos = block[3]
        out += [(path, o, *[-1 if x is None else x for x in (e[1], e[3], e[4], e[5])]) for o, e in state.items() if e[2] != "free"]
    return sorted(out)


def test_base_rows_come_last(spark):
    changes = spark.createDataFrame([("a", 1, 0, "new", False), ("a", 1, 3, "old", False), ("b", 1, 2, None, True), (None, 1, 0, "x", False)], "p string, k int, ord int, v string, dead boolean")
    base = spark.createDataFrame([("a", 1, "base", 5), ("b", 1, "base", 5), ("c", 1, "base", 5), (None, 1, "base", 5)], "p string, k int, v string, extra int")
    got = changefeed.resolve_newest_first(changes, ["p", "k"], F.col("ord"), ["v"], F.col("dead"), F.col("ord"), base)
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1  # only the base is moved
    assert sorted(tuple(r) for r in got.collect()) == [("a", 1, "new"), ("c", 1, "base")]
    assert sorted(r.p for r in changefeed.resolve_newest_first(changes.limit(0), ["p", "k"], F.col("ord"), ["v"], F.col("dead"), F.col("ord"), base).collect()) == ["a", "b", "c"]


def test_checkpoints_of_rounds_are_deleted(spark, tmp_path):
    blocks = spark.createDataFrame([(i, "p", i, i - 1 if i else None, [(1, 0, "plain", i, None, None)], T0, 0, "") for i in range(40)], BLOCKS)
    files = spark.createDataFrame([("p", 39, T0, "")], FILES)
    folder = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    before = set(folder.iterdir())
    assert changefeed.current_entries(blocks, files).collect()[0].byte_pos == 39
    assert len(set(folder.iterdir()) - before) == 1


def test_change_feed_against_brute_force(spark):
    rng = random.Random(5)
    blocks, files = [], []
    for f in range(25):
        n = rng.choice([1, 2, 5, 17, 40])
        for i in range(n):
            entries = [(rng.randint(1, 9) if rng.random() > 0.03 else None, rng.randint(0, 2), rng.choice(["plain", "compressed", "free", "null", None]), rng.choice([None, i]), None, rng.randint(0, 3)) for _ in range(rng.randint(0, 6))]
            blocks.append((len(blocks), f"f{f}", i * 10, rng.choice([None, i * 10 - 10, i * 10 - 10, i * 10 - 10, rng.randint(-3, n + 2) * 10]), rng.choice([entries, entries, entries, None]), T0, 1, "x"))
        files.append((f"f{f}", rng.choice([None, (n - 1) * 10, (n - 1) * 10, (n - 1) * 10, 7]), T0, "x"))
    again = [(1000 + b[0], *b[1:]) for b in blocks[::3]]
    got = changefeed.current_entries(spark.createDataFrame(blocks + blocks[::4] + again, BLOCKS), spark.createDataFrame(files + files[::2] + [(None, 1, T0, "")], FILES))
    assert sorted(tuple(r) for r in got.collect()) == brute_feed(blocks, files)


def test_change_feed_without_rows(spark):
    blocks, files = spark.createDataFrame([], BLOCKS), spark.createDataFrame([("a", 1, T0, "")], FILES)
    assert changefeed.current_entries(blocks, files).count() == 0
    assert changefeed.current_entries(spark.createDataFrame([(1, "a", 1, 1, [], T0, 1, "")], BLOCKS), files).columns == ["path", "obj", "gen", "byte_pos", "stream_id", "idx"]


# -- timestamps ------------------------------------------------------------------------------------


def us(*parts, minutes=0):
    return (datetime(*parts) - datetime(1970, 1, 1)) // timedelta(microseconds=1) - minutes * 60_000_000


TEXTS = [
    ("D:20161019223640", None, None, None, us(2016, 10, 19, 22, 36, 40)), ("D:20161019223640", 60, "Asia/Tokyo", None, us(2016, 10, 19, 22, 36, 40, minutes=60)), ("D:20161019223640", None, "Asia/Tokyo", None, us(2016, 10, 19, 22, 36, 40, minutes=540)),
    ("(D:20200501134307+01'00')", 99, None, None, us(2020, 5, 1, 13, 43, 7, minutes=60)), ("D:2021", None, None, None, us(2021, 1, 1)), ("D:202105", 0, None, None, us(2021, 5, 1)), ("D:2010083018-03'30", None, None, None, us(2010, 8, 30, 18, minutes=-210)),
    ("D:20201226171730Z00'00'", 5, None, None, us(2020, 12, 26, 17, 17, 30)), ("D:20111002+14'", None, None, None, us(2011, 10, 2, minutes=840)), ("20151120T094844Z", 60, None, None, us(2015, 11, 20, 9, 48, 44)), ("20110303093209", None, None, None, us(2011, 3, 3, 9, 32, 9)),
    ("1562228060", 60, "Asia/Tokyo", None, 1562228060 * 10**6), ("1617036134530", None, None, None, 1617036134530000), ("1741084377336048", None, None, None, 1741084377336048), ("20110303", None, None, None, us(2011, 3, 3)), ("201103031200", None, None, None, us(2011, 3, 3, 12)),
    ("946684800000", None, None, None, 946684800000000), ("2010-11-07", -480, None, None, us(2010, 11, 7, minutes=-480)), ("2011-06-20T10:21:23.922", 0, None, None, us(2011, 6, 20, 10, 21, 23, 922000)), ("2022-07-13 23:42:14.193305678+09:30", None, None, None, us(2022, 7, 13, 23, 42, 14, 193305, minutes=570)),
    ("2019-08-03T16:03:58[Europe/Berlin]", 0, None, None, us(2019, 8, 3, 16, 3, 58, minutes=120)), ("2014-03-17 18:33:48 America/Chicago", None, None, None, us(2014, 3, 17, 18, 33, 48, minutes=-300)), ("2014-03-17 18:33:48 Nowhere/Land", None, None, None, None), ("2018-05-16 14:31:42 CET", 5, None, None, us(2018, 5, 16, 14, 31, 42, minutes=60)),
    ("2018-05-16 14:31:42 QQQ", None, None, None, None), ("01.12.2013 23:41:07", None, None, False, us(2013, 12, 1, 23, 41, 7)), ("3/4/2022 1:11 AM", 0, None, True, us(2022, 4, 3, 1, 11)), ("3/4/2022 12:11 AM", 0, None, False, us(2022, 3, 4, 0, 11)), ("3/4/2022 12:11 PM", 0, None, None, us(2022, 4, 3, 12, 11)), ("13/4/2022 1:11", 0, None, False, None),
    ("Fri, 05 Aug 2016 14:47:37 +0200", None, None, None, us(2016, 8, 5, 14, 47, 37, minutes=120)), ("5 Apr 2014 03:35:58 CEST", None, None, None, us(2014, 4, 5, 3, 35, 58, minutes=120)), ("Apr 12, 2010 7:30 PM", 0, None, None, us(2010, 4, 12, 19, 30)), ("Foo 12, 2010 7:30 PM", 0, None, None, None), ("Apr 12, 2010 13:30 PM", 0, None, None, None),
    ("2014-02-30 10:15:00", None, None, None, None), ("2012-02-29", None, None, None, us(2012, 2, 29)), ("D:20131345093000Z", None, None, None, None), ("0000-00-00 00:00:00", None, None, None, None), ("2023-06-11T25:61:00Z", None, None, None, None), ("D:", None, None, None, None), ("", None, None, None, None), ("  ", None, None, None, None),
    (None, 5, "UTC", True, None), ("null", None, None, None, None), ("n/a", None, None, None, None), ("x" * 100_000, None, None, None, None), ("9" * 400, None, None, None, None), (" D:2020 ", None, "Nowhere", None, us(2020, 1, 1)),
    ("2021-03-28 02:30:00", None, "Europe/Berlin", None, us(2021, 3, 28, 1, 30)), ("2021-10-31 02:30:00", None, "Europe/Berlin", None, us(2021, 10, 31, 0, 30)),
]


def test_timestamps(spark):
    df = spark.createDataFrame([(i, *t[:4], "kept", "kept") for i, t in enumerate(TEXTS)], "i int, t string, off int, tz string, df boolean, zone string, _s string")
    got = timestamps.normalise_timestamps(df, "t", "off", "tz", "df")
    assert got.columns == [*df.columns, "utc_us"] and got.where("zone <> 'kept' or _s <> 'kept'").count() == 0
    assert {r.i: r.utc_us for r in got.collect()} == {i: t[4] for i, t in enumerate(TEXTS)}
    assert timestamps.normalise_timestamps(df.limit(0), "t", "off", "tz", "df").count() == 0


def test_summer_time_like_the_zone_database(spark):
    zones = ["Europe/Berlin", "America/New_York", "Australia/Adelaide", "Pacific/Auckland", "Asia/Kathmandu"]
    rows = []
    for z in zones:
        for h in range(0, 24 * 366, 5):
            local = datetime(2021, 1, 1) + timedelta(hours=h, minutes=h % 60)
            rows.append((z, local.strftime("%Y-%m-%d %H:%M:%S"), us(*local.timetuple()[:6]) - int(local.replace(tzinfo=ZoneInfo(z)).utcoffset().total_seconds()) * 10**6))
    df = spark.createDataFrame(rows, "z string, t string, want bigint").withColumns({"o": F.lit(None).cast("int"), "d": F.lit(True)})
    assert timestamps.normalise_timestamps(df, "t", "o", "z", "d").where("utc_us <> want or utc_us is null").count() == 0


def test_zone_estimates(spark):
    rows = []
    for k, z in enumerate(["Europe/Berlin", "America/New_York", "Asia/Tokyo"]):
        for m in range(12):
            local = datetime(2021, m + 1, 5, 12)
            utc = us(*local.timetuple()[:6]) - int(local.replace(tzinfo=ZoneInfo(z)).utcoffset().total_seconds()) * 10**6
            rows.append((k, us(*local.timetuple()[:6]), utc if m != 3 else utc + 1))
    df = spark.createDataFrame([*rows, (9, None, 1)], "g int, l bigint, s bigint")
    zones = ["UTC", "Asia/Tokyo", "Europe/Berlin", "America/New_York"]
    got = {r.g: (r.zone, r.n_seen, r.n_violations) for r in timestamps.estimate_zones(df, ["g"], "l", "s", zones, exact=True).collect()}
    assert got == {0: ("Europe/Berlin", 12, 1), 1: ("America/New_York", 12, 1), 2: ("Asia/Tokyo", 12, 1)}
    late = timestamps.estimate_zones(df.where("g = 1"), ["g"], "l", "s", ["UTC", "America/New_York"]).first()
    assert late.zone == "UTC" and late.n_violations == 0
    with pytest.raises(ValueError):
        timestamps.estimate_zones(df, ["g"], "l", "s", [])


# -- joins of references ---------------------------------------------------------------------------


def test_resolving(spark):
    objects = spark.createDataFrame([("a", 1, 0, "one"), ("a", 2, 0, "two"), ("b", 1, 0, "other")], "path string, obj bigint, gen int, v string")
    df = spark.createDataFrame([(1, "a", [((1, 0), None), (None, "x"), ((9, 0), None)]), (2, "a", []), (3, "a", None)], "i int, path string, items array<struct<ref:struct<obj:bigint,gen:int>,direct:string>>")
    got = {r.i: r.out for r in resolve.resolve_items(df, ["i", "path"], "items", objects.where("path = 'a'"), "v", "out").collect()}
    assert got == {1: ["one", "x", None], 2: [], 3: None}
    one = resolve.resolve(df.select("i", "path", F.col("items")[0]["ref"].alias("r")).where("i = 1"), F.col("r"), objects, "v", "found", ["path"])
    assert one.columns == ["i", "path", "r", "found"] and one.first().found == "one"


def test_estimated_zones_of_archives_whose_zone_is_known(spark):
    """Held-out check: the estimate must find the offset history of each archive, from ingestion alone or from exact instants."""
    rng = random.Random(11)
    zones = ["Europe/Berlin", "America/New_York", "Asia/Tokyo", "UTC"]
    rows = []
    for i in range(4000):
        zone = zones[i % 4]
        utc = datetime(2015, 1, 1, tzinfo=ZoneInfo("UTC")) + timedelta(minutes=rng.randint(0, 5_000_000))
        local = utc.astimezone(ZoneInfo(zone)).replace(tzinfo=None, fold=0)
        us = lambda t: int(t.timestamp()) * 1_000_000
        rows.append((zone, us(local.replace(tzinfo=ZoneInfo("UTC"))), us(utc), us(utc + timedelta(seconds=rng.randint(0, 3000)))))
    df = spark.createDataFrame(rows, "zone_is string, local_us bigint, utc_us bigint, seen_us bigint")
    exact = timestamps.estimate_zones(df, ["zone_is"], "local_us", "utc_us", zones, exact=True).collect()
    assert all(r.zone == r.zone_is for r in exact) and len(exact) == 4 and max(r.n_violations for r in exact) <= 3
    # ingestion bounds the instant from above only: zones further west would come after it, so the westernmost that fits is meant
    west = ["America/New_York", "UTC", "Europe/Berlin", "Asia/Tokyo"]
    late = timestamps.estimate_zones(df, ["zone_is"], "local_us", "seen_us", west).collect()
    assert all(r.zone == r.zone_is for r in late) and len(late) == 4


def test_local_time_and_source_of_the_zone(spark):
    rows = [("2020-07-01 12:00 +02:00", 60, "Asia/Tokyo"), ("2020-07-01 12:00", 60, "Asia/Tokyo"), ("2020-07-01 12:00", None, "Asia/Tokyo"), ("2020-07-01 12:00", None, None), ("1593604800", 60, None), ("nothing", 60, "UTC"), (None, None, None)]
    df = spark.createDataFrame(rows, "t string, o int, z string").withColumn("f", F.lit(True))
    got = timestamps.normalise_timestamps(df, "t", "o", "z", "f", local="local_us", source="from").collect()
    noon = 1593604800 * 1_000_000
    assert [(r["from"], r.local_us, None if r.utc_us is None else (noon - r.utc_us) // 3_600_000_000) for r in got] == [("text", noon, 2), ("offset", noon, 1), ("zone", noon, 9), ("none", noon, 0), ("epoch", None, 0), (None, None, None), (None, None, None)]
