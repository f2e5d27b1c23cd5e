"""Written times in SQL, by format lists and round trips over clocks, apart from the operator's own patterns."""

from __future__ import annotations

from asofkit.functions.instants import ABBREVIATIONS, CLOCKS

_TAIL = r"(?:\s*(?:Z|z|[+-]\d\d:?\d\d|" + "|".join(sorted(ABBREVIATIONS, key=len, reverse=True)) + r"|\bET|\[[A-Za-z_]+/[A-Za-z_/]+\]|[A-Za-z_]+/[A-Za-z_/]+))$"
_FORMATS = [
    "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M:%S", "%Y%m%dT%H%M%S", "%Y%m%d%H%M%S", "%m/%d/%Y %H:%M", "%m/%d/%Y %I:%M %p", "%d.%m.%Y %H:%M", "%d %b %Y %H:%M:%S", "%d %B %Y %H:%M:%S", "%B %d %Y %I:%M %p",
    "%b %d %Y %I:%M %p", "%d.%m.%Y", "%m/%d/%Y", "%d %B %Y", "%d %b %Y", "%B %d %Y", "%b %d %Y", "%Y-%m-%d", "%Y/%m/%d", "%Y%m%d", "%Y-%m-%dT%H:%M", "%Y-%m-%d %H:%M", "%Y/%m/%d %H:%M", "%Y/%m/%d %H:%M:%S",
]
_OFFSETS = " ".join(f"WHEN '{k}' THEN {v}" for k, v in ABBREVIATIONS.items())


def _times(rows: str, name: str) -> str:
    """CTEs that add `ts`, the UTC timestamp that `v` names on the clock of `zone`, to the rows of a query; their names begin with `name`."""
    clock = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CLOCKS.items())
    return rf"""{name}_raw AS MATERIALIZED ({rows}),
    {name}_cut AS (SELECT *, trim(v) AS s, regexp_extract(trim(v), '{_TAIL}') AS tail FROM {name}_raw),
    {name}_head AS (SELECT *, upper(trim(tail, ' []')) AS t, trim(tail, ' []') AS z, CASE WHEN tail = '' THEN s ELSE left(s, length(s) - length(tail)) END AS h FROM {name}_cut),
    {name}_plain AS (SELECT *, regexp_extract(h, ':\d\d\.(\d+)$', 1) AS fraction,
        regexp_replace(replace(replace(replace(replace(replace(regexp_replace(h, '(:\d\d)\.\d+$', '\1'), 'a.m.', 'AM'), 'p.m.', 'PM'), '. ', ' '), ',', ''), 'Sept ', 'Sep '), '^[A-Z][a-z]+ (\d)', '\1') AS p0,
        regexp_matches(h, '^(Mon|Tue|Wed|Thu|Fri|Sat|Sun)') AS dow FROM {name}_head),
    {name}_parsed AS (SELECT *, CASE WHEN dow THEN p0 ELSE regexp_replace(replace(replace(replace(replace(replace(regexp_replace(h, '(:\d\d)\.\d+$', '\1'), 'a.m.', 'AM'), 'p.m.', 'PM'), '. ', ' '), ',', ''), 'Sept ', 'Sep '), ' +', ' ') END AS p FROM {name}_plain),
    {name}_local AS (SELECT *, CASE WHEN regexp_full_match(s, '\d{{10}}|\d{{13}}|\d{{16}}') THEN make_timestamp(CAST(s AS BIGINT) * CASE length(s) WHEN 10 THEN 1000000 WHEN 13 THEN 1000 ELSE 1 END)
            WHEN regexp_full_match(p, '\d+') AND length(p) NOT IN (8, 14) THEN NULL
            ELSE try_strptime(p, {_FORMATS}) + to_microseconds(CAST(rpad(coalesce(nullif(left(fraction, 6), ''), '0'), 6, '0') AS BIGINT)) END AS l,
        regexp_full_match(s, '\d{{10}}|\d{{13}}|\d{{16}}') AS epoch, NOT contains(p, ':') AND NOT regexp_full_match(p, '\d{{8}}T\d{{6}}|\d{{14}}') AS dated FROM {name}_parsed),
    {name}_zoned AS (SELECT *, CASE WHEN epoch OR dated AND t = '' THEN 0 WHEN regexp_full_match(t, '[+-]\d\d:?\d\d') THEN (CASE t[1] WHEN '-' THEN -1 ELSE 1 END) * (60 * CAST(t[2:3] AS INTEGER) + CAST(right(t, 2) AS INTEGER))
            ELSE CASE t {_OFFSETS} END END AS minutes, CASE WHEN t = '' THEN zone WHEN contains(z, '/') THEN z ELSE CASE t {clock} END END AS clock FROM {name}_local),
    {name}_instant AS (SELECT *, CASE WHEN minutes IS NULL AND NOT dated AND clock IS NOT NULL THEN timezone(clock, l) END AS u FROM {name}_zoned),
    {name}_times AS (SELECT * EXCLUDE (s, tail, t, z, h, fraction, p0, dow, p, l, epoch, dated, minutes, clock, u), CASE WHEN minutes IS NOT NULL AND (NOT dated OR t = '') THEN l - to_minutes(minutes)
        WHEN timezone(clock, u) = l AND timezone(clock, u - INTERVAL 1 HOUR) <> l AND timezone(clock, u + INTERVAL 1 HOUR) <> l THEN timezone('UTC', u) END AS ts FROM {name}_instant)"""


_ZONES = "(SELECT lower(trim(domain)) AS outlet, min(zone_name) AS zone FROM outlet_zones GROUP BY 1)"


def headline_times(field: str) -> str:
    """CTEs ending in {field}_times: row_ix, v, zone and ts of each headline."""
    return _times(f"SELECT row_ix, {field} AS v, zone FROM cluster_news_titles n LEFT JOIN {_ZONES} z ON lower(trim(n.domain)) = z.outlet", field)


_HOST = r"nullif(regexp_replace(lower(regexp_extract(trim(url), '(?i)^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '^www\.', ''), '')"
FOUND_SQL = f"""WITH {_times(f'''SELECT source_table, row_ix, field_name, v, zone FROM (
        SELECT 'cluster_news_titles' AS source_table, row_ix, 'seendate' AS field_name, seendate AS v, lower(trim(domain)) AS outlet FROM cluster_news_titles
        UNION ALL SELECT 'cluster_news_titles', row_ix, 'published_at', published_at, lower(trim(domain)) FROM cluster_news_titles
        UNION ALL SELECT 'pipeline_documents', row_ix, 'date', date, {_HOST} FROM pipeline_documents) x LEFT JOIN {_ZONES} z USING (outlet)''', "all")}
    SELECT source_table, row_ix, field_name, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z' AS utc_at FROM all_times WHERE ts IS NOT NULL
        AND NOT regexp_full_match(v, '\\d{{4}}-\\d\\d-\\d\\dT\\d\\d:\\d\\d:\\d\\dZ|\\d{{8}}T\\d{{6}}Z') AND NOT (field_name = 'date' AND regexp_full_match(v, '\\d{{4}}-\\d\\d-\\d\\d'))"""
