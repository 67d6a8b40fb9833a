"""Mixed timestamp notations and time zones, brought to one UTC instant.

Everything is a built-in expression: each notation is one anchored pattern that rewrites the text
to ``year|month|day|hour|minute|second|fraction|half|zone``, and a forgiving cast checks the date and
applies the zone, so no row can raise. Zones come in this order: in the text, a separate offset, a named zone, UTC.

``estimate_zones`` picks, for groups whose zone is unknown, the candidate zone (an offset history)
that violates the fewest observations.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Zone abbreviations and their minutes east of UTC.
ABBREVIATIONS = {
    "Z": 0, "UT": 0, "UTC": 0, "GMT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180, "MSK": 180,
    "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "JST": 540, "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780,
}

_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?"
_TAIL = r"\s*([AaPp][Mm](?![A-Za-z]))?\s*(.*)$"

#: (pattern, replacement). Replacements have nine parts; month may be a name.
_NOTATIONS: list[tuple[str, str]] = [
    (r"^D:\s*(\d{4})(?:(\d{2})(?:(\d{2})(?:(\d{2})(?:(\d{2})(\d{2})?)?)?)?)?\s*((?:[Z+-].*)?)$", "$1|$2|$3|$4|$5|$6|||$7"),
    (r"^(\d{4})(\d{2})(\d{2})(?:(\d{2})(\d{2})(\d{2})?)?\s*((?:[Z+-].*)?)$", "$1|$2|$3|$4|$5|$6|||$7"),
    (r"^(\d{4})(\d{2})?$", "$1|$2|||||||"),
    (r"^(\d{4})(\d{2})(\d{2})T(\d{2})(\d{2})(?:(\d{2})(?:[.,](\d{1,9}))?)?\s*(.*)$", "$1|$2|$3|$4|$5|$6|$7||$8"),
    (r"^(\d{4})-(\d{1,2})(?:-(\d{1,2})(?:[Tt ]\s*" + _CLOCK + ")?)?" + _TAIL, "$1|$2|$3|$4|$5|$6|$7|$8|$9"),
    (r"^(\d{1,2})\.(\d{1,2})\.(\d{4})(?:,?\s+" + _CLOCK + ")?" + _TAIL, "$3|$2|$1|$4|$5|$6|$7|$8|$9"),
    (r"^(?:[A-Za-z]{3,9},?\s+)?(\d{1,2})\s+([A-Za-z]{3,9})\.?\s+(\d{4})(?:,?\s+" + _CLOCK + ")?" + _TAIL, "$3|$2|$1|$4|$5|$6|$7|$8|$9"),
    (r"^([A-Za-z]{3,9})\.?\s+(\d{1,2}),?\s+(\d{4})(?:,?\s+" + _CLOCK + ")?" + _TAIL, "$3|$1|$2|$4|$5|$6|$7|$8|$9"),
]
_SLASHES = r"^(\d{1,2})/(\d{1,2})/(\d{4})(?:,?\s+" + _CLOCK + ")?" + _TAIL
_DAY_FIRST, _MONTH_FIRST = "$3|$2|$1|$4|$5|$6|$7|$8|$9", "$3|$1|$2|$4|$5|$6|$7|$8|$9"


def _zone_name(tail: Column) -> Column:
    """A zone that a cast understands, from the text behind a time; '' for none, null when it is no zone."""
    z = F.regexp_replace(tail, r"[\[\]' :]", "")
    fixed = F.create_map(*[F.lit(x) for name, m in ABBREVIATIONS.items() for x in (name, f"{'-' if m < 0 else '+'}{abs(m) // 60:02d}:{abs(m) % 60:02d}")])
    return (
        F.when(z == "", F.lit(""))
        .when(z.rlike(r"^[+-]\d{4}$"), F.regexp_replace(z, r"^(...)(..)$", "$1:$2"))
        .when(z.rlike(r"^[+-]\d{2}$"), F.concat(z, F.lit(":00")))
        .when(z.rlike(r"^[+-]\d$"), F.regexp_replace(z, r"^(.)(.)$", "$10$2:00"))
        .when(z.rlike("^Z0+$"), F.lit("+00:00"))
        .when(z.rlike("^[A-Za-z]+/[A-Za-z]"), z)
        .otherwise(F.try_element_at(fixed, F.upper(z)))
    )


def normalise_timestamps(df: DataFrame, text: str, offset_minutes: str, zone: str, day_first: str, out: str = "utc_us", local: str | None = None, source: str | None = None) -> DataFrame:
    """``df`` with ``out``: microseconds since 1970-01-01 UTC, or null where ``text`` denotes no possible date.

    ``local`` names a column for the time as written, as if it were UTC, ``source`` one for where the zone
    came from: 'text', 'offset', 'zone', 'none', or 'epoch' for counted seconds; null where there is no date.

    Null, blank and unparsable texts give null. Missing parts take their lowest value. Digits alone
    are a date when they have 4, 6, 8, 12 or 14 places and fit one, else seconds (9 to 11 places),
    milliseconds (12, 13) or microseconds (15 and more) since 1970. The zone is the one in the text,
    else ``offset_minutes``, else ``zone``, else UTC; a text with a zone that is not understood gives
    null, an unknown name in ``zone`` counts as none. A local time that occurs twice is the earlier
    instant; one that is skipped moves forward by the gap. A null ``day_first`` means day first.
    """
    s = F.trim(F.regexp_replace(F.trim(F.col(text)), r"^\(\s*(.*?)\s*\)$", "$1"))
    canon = F.when(F.col("_qf_s").rlike(_SLASHES), F.when(F.coalesce(F.col(day_first), F.lit(True)), F.regexp_replace("_qf_s", _SLASHES, _DAY_FIRST)).otherwise(F.regexp_replace("_qf_s", _SLASHES, _MONTH_FIRST)))
    for pattern, parts in _NOTATIONS:
        canon = canon.when(F.col("_qf_s").rlike(pattern), F.regexp_replace("_qf_s", pattern, parts))
    # the lambda keeps this projection out of the whole-stage method, which would grow too large to compile
    d = df.withColumn("_qf_s", s).withColumn("_qf_p", F.transform(F.split(canon, r"\|"), lambda x: F.trim(x)))

    def part(i: int, default: str = "") -> Column:
        return F.coalesce(F.nullif(F.try_element_at("_qf_p", F.lit(i + 1)), F.lit("")), F.lit(default))

    names = F.create_map(*[F.lit(x) for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split(), 1) for x in (m, str(i))])
    month = F.when(part(1).rlike("^[A-Za-z]"), F.try_element_at(names, F.lower(F.substring(part(1), 1, 3)))).otherwise(part(1, "1"))
    twelve = part(3).try_cast("int")
    hour = F.when(part(7) == "", part(3, "0")).when(twelve.between(1, 12), (twelve % 12 + F.when(F.upper(part(7)) == "PM", 12).otherwise(0)).cast("string"))
    day = F.concat(part(0), F.lit("-"), month, F.lit("-"), part(2, "1"), F.lit(" "))
    clock = F.concat(hour, F.lit(":"), part(4, "0"), F.lit(":"), part(5, "0"), F.lit("."), part(6, "0"))
    d = d.withColumn("_qf_local", F.when(part(0).rlike("[1-9]"), F.concat(day, clock, F.lit(" ")))).withColumn("_qf_zone", F.when(F.col("_qf_p").isNotNull(), _zone_name(part(8))))
    offset = F.when(F.col("_qf_zone") == "", F.col(offset_minutes)).cast("bigint")
    as_utc = F.unix_micros(F.concat("_qf_local", F.lit("+00:00")).try_cast("timestamp"))
    there = F.when(F.col("_qf_zone") != "", F.col("_qf_zone")).when(F.col("_qf_zone") == "", F.col(zone))
    in_zone = F.unix_micros(F.concat("_qf_local", there).try_cast("timestamp"))
    n, places = F.col("_qf_s").try_cast("bigint"), F.length("_qf_s")
    epoch = F.when(F.col("_qf_s").rlike(r"^\d{9,18}$") & (places != 14) & ~((places == 12) & as_utc.isNotNull()), F.when(places < 12, n * 1_000_000).when(places < 14, n * 1000).otherwise(n))
    utc = F.when(epoch.isNotNull(), epoch).when(offset.isNotNull(), as_utc - offset * 60_000_000).when(F.col("_qf_zone") == "", F.coalesce(in_zone, as_utc)).otherwise(in_zone)
    known = F.when(epoch.isNotNull(), "epoch").when(utc.isNull(), None).when(F.col("_qf_zone") != "", "text").when(offset.isNotNull(), "offset").when(in_zone.isNotNull(), "zone").otherwise("none")
    more = {out: utc} | ({local: F.when(epoch.isNull(), as_utc)} if local else {}) | ({source: known} if source else {})
    return d.select(*[F.col(f"`{c}`") for c in df.columns if c not in more], *[c.alias(n) for n, c in more.items()])


def convert_local(local_us: Column, zone: Column) -> Column:
    """Microseconds of a local time, as if it were UTC, to UTC by the whole offset history of a zone."""
    return F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(local_us), zone))


def estimate_zones(df: DataFrame, group: list[str], local_us: str, seen_us: str, candidates: Sequence[str], exact: bool = False) -> DataFrame:
    """Per group the candidate zone that violates the fewest observations: group, zone, n_seen, n_violations.

    An observation is a local time and a UTC time in microseconds. With ``exact`` both denote the same
    instant and a violation is any difference; else ``seen_us`` is an ingestion and a violation is a
    local time that would come after it. Ties go to the zone named first. Rows with a null are no
    observations; groups without one are left out. One aggregation with a column per candidate, so
    a hot group is combined before the shuffle.
    """
    known = list(dict.fromkeys(candidates))
    if not known:
        raise ValueError("there is no candidate zone")

    def violated(zone: str) -> Column:
        utc = convert_local(F.col(local_us), F.lit(zone))
        return (utc != F.col(seen_us)) if exact else (utc > F.col(seen_us))

    # no filter on the two times: it would be pushed down and parse every text a second time
    both = F.col(local_us).isNotNull() & F.col(seen_us).isNotNull()
    counts = df.groupBy(*group).agg(F.count_if(both).alias("n_seen"), *[F.count_if(both & violated(z)).alias(f"_v{i}") for i, z in enumerate(known)]).where("n_seen > 0")
    best = F.array_min(F.array(*[F.struct(F.col(f"_v{i}").alias("v"), F.lit(i).alias("i")) for i in range(len(known))]))
    names = F.array(*[F.lit(z) for z in known])
    return counts.withColumn("_best", best).select(*group, F.element_at(names, F.col("_best.i") + 1).alias("zone"), "n_seen", F.col("_best.v").alias("n_violations"))
