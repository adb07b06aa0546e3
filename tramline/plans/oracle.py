"""The same queries as ANSI SQL for DuckDB."""

from __future__ import annotations

ID = "(CASE WHEN lower({t}) IN ('','nan','none','null') THEN NULL WHEN regexp_full_match({t},'[0-9]+\\.0') THEN left({t},length({t})-2) ELSE {t} END)"


def clean_id(c: str) -> str:
    """Trimmed, without a final .0 after digits, null for no id."""
    return ID.format(t=f"trim({c}, ' \t')")


def clean_route(c: str) -> str:
    return f"(CASE WHEN {clean_id(c)} NOT IN ('0','X','x') THEN {clean_id(c)} END)"


def real_date(c: str) -> str:
    return f"(length({c})=8 AND left({c},4)>'0000' AND try_strptime({c},'%Y%m%d') IS NOT NULL)"


def readable(c: str) -> str:
    """14 digits of a readable time, else null."""
    t = f"regexp_replace(regexp_replace(trim({c}, ' \t'),'\\.0$',''),'[^0-9]','','g')"
    t = f"(CASE length({t}) WHEN 14 THEN {t} WHEN 12 THEN {t}||'00' WHEN 10 THEN {t}||'0000' END)"
    return f"(CASE WHEN {real_date(f'left({t},8)')} AND substr({t},9,2)<'24' AND substr({t},11,2)<'60' AND substr({t},13,2)<'60' THEN {t} END)"


def service_day(d: str, r: str) -> str:
    digits = f"left(regexp_replace({r},'[^0-9]','','g'),8)"
    return f"(CASE WHEN regexp_full_match({clean_id(d)},'[0-9]{{8}}') THEN {clean_id(d)} WHEN length({digits})=8 THEN {digits} END)"


def _field(i: int) -> str:
    """Field i of a line as trimmed text, quotes undone."""
    f = '(?:[^",]*|"(?:[^"]|"")*")'
    raw = f"regexp_extract(l,'^(?:{f},){{{i}}}({f})(?:,|$)',1)"
    return f"trim(CASE WHEN left({raw},1)='\"' THEN replace(substr({raw},2,length({raw})-2),'\"\"','\"') ELSE {raw} END, ' \t')"


def _lines(feed: str, n: int, names: list[str]) -> str:
    f = '(?:[^",]*|"(?:[^"]|"")*")'
    cols = ", ".join(f"{_field(i)} AS {c}" for i, c in enumerate(names))
    return f"SELECT line_id, file_name, line_no, {cols}, regexp_full_match(l,'{f}(?:,{f}){{{n - 1}}}') AS ok FROM (SELECT *, regexp_replace(raw_text,'\\r$','') AS l FROM raw_lines WHERE feed='{feed}')"


LEG = ["service_date", "card_id", "transfer_id", "ride_dtm", "alight_dtm", "serial_num", "mode_code", "transfer_count", "route_id", "origin_stop_id", "destination_stop_id", "passengers", "source_label"]
OD = ["date", "hour", "origin_stop_id", "destination_stop_id", "passengers"]
_STOP = "regexp_full_match({0},'[0-9]{{9}}(\\.0)?')"
_POS = "regexp_full_match(passengers,'[0-9]+(\\.[0-9]+)?') AND try_cast(passengers AS DOUBLE)>0"
_DATE = "regexp_full_match({0},'[0-9]{{8}}') AND "
LEG_OK = f"ok AND {_DATE.format('service_date')}{real_date('service_date')} AND card_id<>'' AND transfer_id<>'' AND {readable('ride_dtm')} IS NOT NULL AND {_STOP.format('origin_stop_id')} AND {_STOP.format('destination_stop_id')} AND {_POS}"
OD_OK = f"ok AND {_DATE.format('date')}{real_date('date')} AND regexp_full_match(hour,'[0-9]{{1,2}}') AND try_cast(hour AS INT)<24 AND {_STOP.format('origin_stop_id')} AND {_STOP.format('destination_stop_id')} AND {_POS}"
_LEG_LINES, _OD_LINES = _lines("legs", 13, LEG), _lines("daily_od", 5, OD)

SQL: dict[str, str] = {}
SQL["p1_found"] = f"SELECT line_id FROM ({_LEG_LINES}) WHERE ({LEG_OK}) IS NOT TRUE UNION ALL SELECT line_id FROM ({_OD_LINES}) WHERE ({OD_OK}) IS NOT TRUE"
SQL["p1_legs"] = f"SELECT line_id, file_name, line_no, {', '.join(c if c != 'passengers' else 'CAST(passengers AS DOUBLE) AS passengers' for c in LEG)} FROM ({_LEG_LINES}) WHERE {LEG_OK}"
SQL["p1_daily_od"] = f"SELECT line_id, file_name, line_no, date, CAST(hour AS INT) AS hour, origin_stop_id, destination_stop_id, CAST(passengers AS DOUBLE) AS passengers FROM ({_OD_LINES}) WHERE {OD_OK}"

_F = '(?:[^",]*|"(?:[^"]|"")*")'
_TOLD = {"date": "not a real date", "hour": "not an hour 0-23", "time": "unreadable time", "stop": "not a nine-digit stop id", "pos": "not a number above 0", "filled": "never"}


def _check(kind: str, c: str) -> str:
    return {"date": f"{_DATE.format(c)}{real_date(c)}", "hour": f"regexp_full_match({c},'[0-9]{{1,2}}') AND try_cast({c} AS INT)<24", "time": f"{readable(c)} IS NOT NULL", "stop": _STOP.format(c), "pos": _POS, "filled": f"{c}<>''"}[kind]


def _reasons(feed: str, n: int, names: list[str], checks: dict[str, str]) -> str:
    """Reason and field of each bad line: its form first, then the first field that fails."""
    commas = f"len(string_split(regexp_replace(l,'\"(?:[^\"]|\"\")*\"','','g'),','))"
    form = f"""CASE WHEN raw_text IS NULL THEN 'no line' WHEN regexp_matches(l,'^(?:{_F},)*"(?:[^"]|"")*$') THEN 'quote not closed' WHEN regexp_matches(l,'^(?:{_F},)*"(?:[^"]|"")*"[^,"]') THEN 'text after a closing quote'
    WHEN regexp_matches(l,'^(?:{_F},)*[^",]+"') THEN 'quote inside an open field' WHEN {commas}<{n} THEN 'too few fields' WHEN {commas}>{n} THEN 'too many fields' END"""
    at = "CASE " + " ".join(f"WHEN ({_check(k, c)}) IS NOT TRUE THEN '{c}'" for c, k in checks.items()) + " END"
    why = "CASE field " + " ".join(f"WHEN '{c}' THEN CASE WHEN {c}='' THEN 'empty' ELSE '{_TOLD[k]}' END" for c, k in checks.items()) + " END"
    cols = ", ".join(f"{_field(i)} AS {c}" for i, c in enumerate(names))
    return f"SELECT '{feed}' AS feed, coalesce(form, {why}) AS reason, field FROM (SELECT *, CASE WHEN form IS NULL THEN {at} END AS field FROM (SELECT *, {form} AS form, {cols} FROM (SELECT *, regexp_replace(raw_text,'\r$','') AS l FROM raw_lines WHERE feed='{feed}'))) WHERE form IS NOT NULL OR field IS NOT NULL"


_LEG_WHY = _reasons("legs", 13, LEG, {"service_date": "date", "card_id": "filled", "transfer_id": "filled", "ride_dtm": "time", "origin_stop_id": "stop", "destination_stop_id": "stop", "passengers": "pos"})
_OD_WHY = _reasons("daily_od", 5, OD, {"date": "date", "hour": "hour", "origin_stop_id": "stop", "destination_stop_id": "stop", "passengers": "pos"})
SQL["p1_reasons"] = f"SELECT feed, reason, field, count(*) AS n_lines FROM ({_LEG_WHY} UNION ALL {_OD_WHY}) GROUP BY 1,2,3"


def _totals(name: str, key: str) -> str:
    return f"SELECT '{name}' AS table_name, {key} AS key_value, count(*) AS n_rows, CAST(sum(CASE WHEN NOT isnan(passengers) THEN CAST(passengers AS DECIMAL(28,6)) END) AS DOUBLE) AS total FROM {name} GROUP BY 2"


SQL["p3_totals"] = f"{_totals('legs', clean_route('route_id'))} UNION ALL {_totals('daily_od', clean_id('origin_stop_id'))}"
SQL["p3_found"] = f"SELECT table_name, key_value FROM (SELECT *, sum(n_rows) OVER (PARTITION BY table_name) AS n FROM ({SQL['p3_totals']})) WHERE key_value IS NOT NULL AND n_rows >= 0.02*n"

_HEAD = "lower(trim(replace({0}, chr(65279), ''), ' \t'))"
_SCHEMAS = f"""
WITH al AS (SELECT {_HEAD.format('alias')} AS h, min(canonical_name) AS c FROM field_aliases GROUP BY 1 UNION SELECT DISTINCT lower(canonical_name), canonical_name FROM field_aliases),
al2 AS (SELECT h, min(c) AS c FROM al GROUP BY 1),
kv AS (SELECT feed, file_name, file_date, e.key AS k, e.type AS t FROM leg_files, json_each(record_json) AS e),
f0 AS (SELECT feed, file_name, file_date, {_HEAD.format('k')} AS h, bool_or(t='VARCHAR' OR t='OBJECT' OR t='ARRAY') AS s, bool_or(t IN ('UBIGINT','BIGINT','HUGEINT')) AS i, bool_or(t='DOUBLE') AS d, bool_or(t='BOOLEAN') AS b FROM kv GROUP BY 1,2,3,4),
f1 AS (SELECT feed, file_name, file_date, coalesce(c, f0.h) AS field_name, string_agg(f0.h, '|' ORDER BY f0.h) AS headers, bool_or(s) AS s, bool_or(i) AS i, bool_or(d) AS d, bool_or(b) AS b FROM f0 LEFT JOIN al2 ON al2.h=f0.h GROUP BY 1,2,3,4),
f2 AS (SELECT feed, file_name, file_date, field_name, headers, CASE WHEN s OR (b AND (i OR d)) THEN 'text' WHEN d THEN 'decimal' WHEN i THEN 'integer' WHEN b THEN 'boolean' END AS type FROM f1),
files AS (SELECT feed, file_date, min(file_name) AS file_name, lead(file_date) OVER w AS nd, lead(min(file_name)) OVER w AS nn, row_number() OVER w AS rn FROM leg_files GROUP BY feed, file_date WINDOW w AS (PARTITION BY feed ORDER BY file_date)),
new AS (SELECT f2.feed, f2.file_date, files.file_name, field_name, headers, type FROM f2 JOIN files USING (feed, file_date) WHERE rn>1),
old AS (SELECT f2.feed, nd AS file_date, nn AS file_name, field_name, headers, type FROM f2 JOIN files USING (feed, file_date) WHERE nn IS NOT NULL),
both_ AS (SELECT coalesce(n.feed,o.feed) AS feed, coalesce(n.file_date,o.file_date) AS file_date, coalesce(n.file_name,o.file_name) AS file_name, coalesce(n.field_name,o.field_name) AS field_name, o.headers AS oh, n.headers AS nh, o.type AS ot, n.type AS nt FROM new n FULL JOIN old o ON n.feed=o.feed AND n.file_date=o.file_date AND n.field_name=o.field_name),
ch AS (SELECT *, 'added' AS change_kind, oh AS before, nh AS after FROM both_ WHERE oh IS NULL UNION ALL SELECT *, 'removed', oh, nh FROM both_ WHERE nh IS NULL UNION ALL SELECT *, 'renamed', oh, nh FROM both_ WHERE oh<>nh UNION ALL SELECT *, 'retyped', ot, nt FROM both_ WHERE oh IS NOT NULL AND nh IS NOT NULL AND ot<>nt)
"""
SQL["p4_found"] = _SCHEMAS + "SELECT file_name, field_name, change_kind FROM ch"
SQL["p4_changes"] = _SCHEMAS + "SELECT feed, file_date, file_name, field_name, change_kind, before, after FROM ch"

_REFS = f"""
WITH st AS (SELECT {clean_id('stop_id')} AS stop, coalesce({clean_id('registered_on')},'') AS a, {clean_id('retired_on')} AS z FROM stops),
m AS (SELECT {clean_id('card_stop_id')} AS card, min({clean_id('model_stop_id')}) AS model FROM stop_id_map WHERE {clean_id('model_stop_id')} IS NOT NULL GROUP BY 1),
t AS (SELECT trip_hash, 'origin_stop_id' AS field_name, service_date, {clean_id('origin_stop_id')} AS ref FROM purpose_trips UNION ALL SELECT trip_hash, 'destination_stop_id', service_date, {clean_id('destination_stop_id')} FROM purpose_trips),
r AS (SELECT t.*, CASE WHEN EXISTS (SELECT 1 FROM st WHERE st.stop=t.ref) THEN t.ref ELSE coalesce(m.model, t.ref) END AS key FROM t LEFT JOIN m ON m.card=t.ref WHERE t.ref IS NOT NULL),
o AS (SELECT r.*, EXISTS (SELECT 1 FROM st WHERE st.stop=r.key AND st.a<=r.service_date AND (st.z IS NULL OR r.service_date<st.z)) AS ok FROM r)
"""
SQL["p5_found"] = _REFS + "SELECT DISTINCT trip_hash, field_name FROM o WHERE NOT ok"
SQL["p5_by_day"] = _REFS + "SELECT field_name, service_date, count(*) AS n_refs, CAST(sum(CASE WHEN ok THEN 0 ELSE 1 END) AS BIGINT) AS n_orphans FROM o GROUP BY 1,2"

_MONTHLY = _REFS.replace("service_date, {0}".format(clean_id("origin_stop_id")), "service_date, date_trunc('month', CAST(loaded_at AS DATE)) AS month, CAST(loaded_at AS DATE) AS loaded, {0}".format(clean_id("origin_stop_id"))).replace(
    "service_date, {0}".format(clean_id("destination_stop_id")), "service_date, date_trunc('month', CAST(loaded_at AS DATE)), CAST(loaded_at AS DATE), {0}".format(clean_id("destination_stop_id"))
)
SQL["p5_snapshots"] = (
    _MONTHLY.rstrip()
    + f""",
mm AS (SELECT month, max(loaded) AS loaded_until, row_number() OVER (ORDER BY month NULLS FIRST) AS k, strftime(lead(month) OVER (ORDER BY month NULLS FIRST),'%Y%m%d') AS until FROM r GROUP BY month),
g AS (SELECT field_name, key, service_date, k, count(*) AS n FROM r JOIN mm ON r.month IS NOT DISTINCT FROM mm.month GROUP BY ALL),
c AS (SELECT mm.k, mm.loaded_until, mm.until, field_name, key, service_date, sum(n) AS n FROM g JOIN mm ON g.k<=mm.k GROUP BY ALL),
p AS (SELECT * FROM st WHERE stop IS NOT NULL AND (z IS NULL OR z>a)),
l AS (SELECT c.k, c.loaded_until, field_name, key, service_date, n, coalesce(sum(CASE WHEN a<=service_date AND (until IS NULL OR a<until) THEN 1 ELSE 0 END),0)-coalesce(sum(CASE WHEN z<=service_date AND (until IS NULL OR z<until) THEN 1 ELSE 0 END),0) AS live FROM c LEFT JOIN p ON p.stop=c.key GROUP BY ALL)
SELECT loaded_until, field_name, service_date, CAST(sum(n) AS BIGINT) AS n_refs, CAST(sum(CASE WHEN live<=0 THEN n ELSE 0 END) AS BIGINT) AS n_orphans FROM l GROUP BY k, loaded_until, field_name, service_date"""
)

_RIDES = f"""
WITH l AS (SELECT {clean_id('card_id')} AS card_id, {service_day('service_date', 'ride_dtm')} AS service_date, {readable('ride_dtm')} AS s, {readable('alight_dtm')} AS e FROM legs),
v AS (SELECT * FROM l WHERE card_id IS NOT NULL AND service_date IS NOT NULL AND e>s),
q AS (SELECT *, max(e) OVER (PARTITION BY card_id, service_date ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM v)
"""
SQL["p6_found"] = _RIDES + "SELECT card_id, service_date, pe AS gap_start, s AS gap_end FROM q WHERE s>pe"
SQL["p6_periods"] = _RIDES + ", i AS (SELECT *, sum(CASE WHEN pe IS NULL OR s>pe THEN 1 ELSE 0 END) OVER (PARTITION BY card_id, service_date ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM q) SELECT card_id, service_date, min(s) AS period_start, max(e) AS period_end FROM i GROUP BY card_id, service_date, g"
