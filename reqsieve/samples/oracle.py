"""The same results as plain SQL over the sample tables, for checking."""

from __future__ import annotations

_REQUESTS = """
requests as (
  select e.event_id as request_id, cast(e.ts as timestamp) as ts,
         concat('m', cast(e.user_id % 4 as varchar(10))) as monitor_id,
         p.p_partkey as publisherId,
         case when n.n_nationkey % 5 = 0 then '' else n.n_name end as country,
         p.p_size as age,
         case when e.event_type = 'view' then 'null' when e.event_type = 'error' then null
              else o.o_orderstatus end as gender,
         case when p.p_size % 7 = 0 then '' else p.p_brand end as brand,
         (p.p_size % 5 + 1) * 50 as height,
         (p.p_size % 3 + 1) * 320 as width,
         case when o.o_orderpriority = '4-NOT SPECIFIED' then '(null)'
              when o.o_orderpriority = '5-LOW' then null else o.o_orderpriority end as connectionType,
         (e.event_id % 2 = 0) as withBundleId,
         (e.user_id % 3 = 0) as withGeoInfo,
         e.value as rtbFloorSent,
         cast(case when e.event_type = 'purchase' or e.value > 60 then 1.0 else 0.0 end as double) as isWinning
  from events e
  join orders o on o.o_orderkey = e.event_id
  join customer c on c.c_custkey = o.o_custkey
  join nation n on n.n_nationkey = c.c_nationkey
  join part p on p.p_partkey = e.event_id % (select count(*) from part)
)"""

_ID = "md5(concat_ws(chr(31), {}))".format(", ".join(
    f"coalesce('v' || cast({c} as varchar), 'n')" for c in
    ("publisherId", "country", "age", "gender", "brand", "height", "width", "connectionType", "withBundleId", "withGeoInfo", "rtbFloorSent")
))

_GENDER = {
    "training": "case when gender is null or gender = 'null' then 'NA' else gender end",
    "prediction": "coalesce(gender, 'NA')",
}
_GENDER["unified"] = _GENDER["training"]
_CON_TYPE = {
    "training": "coalesce(connectionType, 'NA')",
    "prediction": "case when connectionType is null or connectionType = '(null)' then 'NA' else connectionType end",
}
_CON_TYPE["unified"] = _CON_TYPE["prediction"]


def _features(mode: str) -> str:
    return f"""cast(publisherId as varchar) as publisherId,
    case when country is null or country = '' then 'NA' else country end as country,
    age, {_GENDER[mode]} as gender,
    case when brand is null or brand = '' then 'NA' else brand end as brand,
    height, width, {_CON_TYPE[mode]} as conType,
    cast(withBundleId as integer) as withBundleId, cast(withGeoInfo as integer) as withGeo,
    rtbFloorSent as rtbFloorPriceSent, {_ID} as featuresId"""


def _rows(mode: str, source: str = "requests") -> str:
    return f"select request_id, ts, monitor_id, {_features(mode)}, isWinning from {source}"


def _scored(mode: str = "training", floor: float = 0.02, name: str = "scored") -> str:
    return f"""
{name}_rows as ({_rows(mode)}),
{name}_weights as (
  select *,
    case gender when 'F' then 0.2 when 'O' then 0.1 when 'P' then -0.1 when 'NA' then 0.0 end::double as w_gender,
    case conType when '1-URGENT' then 0.3 when '2-HIGH' then -0.2 when '(null)' then 0.15 when 'NA' then 0.0 end::double as w_con
  from {name}_rows),
{name}_p as (
  select *, 1.0::double / (1.0::double + exp(-(-1.2::double + {floor}::double * rtbFloorPriceSent - 0.01::double * age
    + 0.25::double * withBundleId - 0.3::double * withGeo + w_gender + w_con))) as p1 from {name}_weights),
{name} as (
  select *, case when p1 is null then 'failure' else 'ok' end as status, 1.0::double - p1 as p0,
    case when p1 > 0.5 then 1.0 when p1 <= 0.5 then 0.0 end::double as prediction,
    p1 <= 0.5 as to_filter,
    case when p1 > 0.5 then p1 else 1.0::double - p1 end as precision,
    isWinning <> 1.0 as real_positive
  from {name}_p)"""


def _with(*parts: str, query: str) -> str:
    return "with recursive " + ", ".join(parts) + "\n" + query


def _gated(threshold: str = "0.7::double") -> str:
    return f"gated as (select *, coalesce(to_filter and precision >= {threshold}, false) as filtered from scored)"


_SUMS = """count(*)::bigint as input, count(*) filter (filtered)::bigint as filtered,
    count(*) filter (filtered and real_positive)::bigint as false_negative,
    count(*) filter (status = 'failure')::bigint as invalid,
    count(*) filter (real_positive)::bigint as real_value,
    coalesce(sum(cast(round(precision, 6) as decimal(18, 6))), 0) as total"""
_SHOWN = """input, filtered, false_negative, invalid, real_value,
    cast(total as double) as precision_sum, cast(total as double) / input as avg_precision"""


def _counted(keys: str = "", source: str = "gated") -> str:
    lead = f"{keys}, " if keys else ""
    by = " group by all" if keys else ""
    return f"counted as (select {lead}{_SUMS} from {source}{by})"


_CSV = """
texts as (
  select *, cast(age as varchar) as age_text, cast(rtbFloorSent as varchar) as floor_text from requests),
whole as (
  select age, concat_ws(',', cast(request_id as varchar), country,
      case when age % 11 = 0 then age_text || '.7' when age % 13 = 0 then ' ' || age_text
           when age % 17 = 0 then '+' || age_text else age_text end,
      coalesce(gender, '')) as head,
    concat_ws(',', case when age % 8 = 0 then '"' || brand else brand end,
      cast(height as varchar), cast(width as varchar), coalesce(connectionType, ''),
      case when age % 6 = 0 then '' when withBundleId then '1' else '0' end,
      case when withGeoInfo then '1' else '0' end, cast(publisherId as varchar),
      case when age % 9 = 3 then floor_text || 'd' when age % 9 = 4 then ' ' || floor_text
           when age % 9 = 5 then floor_text || 'x' else floor_text end,
      case when age % 19 = 0 then '' else cast(isWinning as varchar) end) as tail
  from texts),
lines as (
  select string_split(case when age % 23 = 0 then head when age % 5 = 0 then head || ',' || tail || ',extra'
                           else head || ',' || tail end, ',') as f from whole),
fields as (
  select f[1] as id, f[2] as country, f[3] as age, f[4] as gender, f[5] as brand, f[6] as height, f[7] as width,
    f[8] as connectionType, f[9] as withBundleId, f[10] as withGeoInfo, f[11] as publisherId,
    coalesce(f[12], '') as rtbFloorSent, coalesce(f[13], '') as isWinning from lines),
checked as (
  select *, case
    when not coalesce(regexp_full_match(publisherId, '[+-]?[0-9]+'), false) then 'publisherId'
    when not coalesce(regexp_full_match(age, '[+-]?[0-9]+'), false) then 'age'
    when not coalesce(regexp_full_match(height, '[+-]?[0-9]+'), false) then 'height'
    when not coalesce(regexp_full_match(width, '[+-]?[0-9]+'), false) then 'width'
    when not regexp_full_match(trim(rtbFloorSent), '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?[fFdD]?') then 'rtbFloorSent'
    when not regexp_full_match(trim(isWinning), '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?[fFdD]?') then 'isWinning'
    end as reject_reason from fields)"""


def _ranked(columns: dict[str, str], source: str) -> str:
    """Categories of each column by falling frequency, ties in text order."""
    return ",\n".join(
        f"rank_{c} as (select {c} as category, row_number() over (order by count(*) desc, {c}) - 1 as idx "
        f"from {source} group by {c})"
        for c in columns
    )


_CATEGORICAL = {c: c for c in ("publisherId", "country", "gender", "brand", "conType")}


def _indexed(source: str) -> str:
    joins = " ".join(f"join rank_{c} on rank_{c}.category = normal.{c}" for c in _CATEGORICAL)
    picks = ", ".join(f"rank_{c}.idx as {c}_index" for c in _CATEGORICAL)
    return _with(
        _REQUESTS,
        f"normal as ({_rows('training')})",
        f"vocabulary as (select * from normal where {source})",
        _ranked(_CATEGORICAL, "vocabulary"),
        query=f"select request_id, {picks} from normal {joins}",
    )


def _one_hot() -> str:
    return _with(
        _REQUESTS,
        f"normal as ({_rows('training')})",
        _ranked(_CATEGORICAL, "normal"),
        query=" union all ".join(
            f"""select request_id, '{c}' as feature, case when idx < n - 1 then idx else -1 end::bigint as slot, (n - 1)::bigint as slots
                from normal join rank_{c} on rank_{c}.category = normal.{c}, (select count(*) as n from rank_{c})"""
            for c in _CATEGORICAL
        ),
    )


def _assembled() -> str:
    joins = " ".join(f"join rank_{c} on rank_{c}.category = normal.{c}" for c in _CATEGORICAL)
    widths = " + ".join(f"(select count(*) - 1 from rank_{c})" for c in _CATEGORICAL)
    active = " + ".join(f"(rank_{c}.idx < (select count(*) - 1 from rank_{c}))::bigint" for c in _CATEGORICAL)
    numbers = ("age", "height", "width", "withBundleId", "withGeo", "rtbFloorPriceSent")
    filled = " + ".join(f"({c} <> 0)::bigint" for c in numbers)
    return _with(
        _REQUESTS,
        f"normal as ({_rows('training')})",
        _ranked(_CATEGORICAL, "normal"),
        query=f"""select request_id, (6 + {widths})::bigint as slots, ({active} + {filled})::bigint as filled,
            round({" + ".join(numbers)} + {active}, 4) as total from normal {joins}""",
    )


# A regression on one category without penalty: the log-odds of each category in the training part.
_ODDS = f"""normal as ({_rows('training')}),
ranked as (select gender as category, row_number() over (order by count(*) desc, gender) as place, count(*) over () as places
  from normal group by gender),
parts as (select *, {{part}} as part from normal),
rates as (select gender, avg(isWinning) as rate, ln(sum(isWinning) / sum(1 - isWinning)) as odds
  from parts where part = 'train' group by gender)"""


def _odds() -> str:
    return _ODDS.format(part=_hash_part("request_id"))


def _coefficients() -> str:
    last = "(select odds from rates join ranked on category = gender where place = places)"
    return _with(
        _REQUESTS,
        _odds(),
        query=f"""select '(intercept)' as feature, 'intercept' as kind, null::varchar as category, round({last}, 4) as coefficient
            union all select 'gender', 'category', category, round(odds - {last}, 4) from rates join ranked on category = gender""",
    )


#: The fit's fixed penalty and its share on absolute values.
_REG, _MIXING = "0.3::double", "7.482741259139502e-05::double"


def _penalised() -> str:
    """Newton's method on two standardised numbers and an intercept, one row per step."""
    grad = lambda k: f"g{k} + {_REG} * (1 - {_MIXING}) * b{k} + {_REG} * {_MIXING} * sign(b{k})"
    return _with(
        _REQUESTS,
        f"normal as ({_rows('training')})",
        f"""learned as (select *, (age - m1) / s1 as u1, (rtbFloorPriceSent - m2) / s2 as u2 from (
              select *, avg(age) over () as m1, stddev_samp(age) over () as s1,
                avg(rtbFloorPriceSent) over () as m2, stddev_samp(rtbFloorPriceSent) over () as s2
              from normal where {_hash_part('request_id')} = 'train'))""",
        f"""steps(k, b0, b1, b2) as (
              select 0, 0.0::double, 0.0::double, 0.0::double
              union all
              select k + 1,
                b0 - (d0 * (h11 * h22 - h12 * h12) - h01 * (d1 * h22 - h12 * d2) + h02 * (d1 * h12 - h11 * d2)) / det,
                b1 - (h00 * (d1 * h22 - h12 * d2) - d0 * (h01 * h22 - h12 * h02) + h02 * (h01 * d2 - d1 * h02)) / det,
                b2 - (h00 * (h11 * d2 - d1 * h12) - h01 * (h01 * d2 - d1 * h02) + d0 * (h01 * h12 - h11 * h02)) / det
              from (select *, h00 * (h11 * h22 - h12 * h12) - h01 * (h01 * h22 - h12 * h02) + h02 * (h01 * h12 - h11 * h02) as det
                from (select k, b0, b1, b2, h00, h01, h02, h12, h11 + {_REG} * (1 - {_MIXING}) as h11, h22 + {_REG} * (1 - {_MIXING}) as h22,
                    g0 as d0, {grad(1)} as d1, {grad(2)} as d2
                  from (select k, b0, b1, b2, avg(p - isWinning) as g0, avg((p - isWinning) * u1) as g1, avg((p - isWinning) * u2) as g2,
                      avg(w) as h00, avg(w * u1) as h01, avg(w * u2) as h02, avg(w * u1 * u1) as h11, avg(w * u1 * u2) as h12, avg(w * u2 * u2) as h22
                    from (select *, p * (1 - p) as w from (select *, 1 / (1 + exp(-(b0 + b1 * u1 + b2 * u2))) as p from steps, learned where k < 12))
                    group by k, b0, b1, b2))))""",
        """found as (select b0 - b1 * m1 / s1 - b2 * m2 / s2 as intercept, b1 / s1 as age, b2 / s2 as floor
              from steps, (select any_value(m1) as m1, any_value(s1) as s1, any_value(m2) as m2, any_value(s2) as s2 from learned) where k = 12)""",
        query="""select '(intercept)' as feature, 'intercept' as kind, round(intercept, 5) as coefficient from found
            union all select 'age', 'numeric', round(age, 5) from found
            union all select 'rtbFloorPriceSent', 'numeric', round(floor, 5) from found""",
    )


def _optimality_fixed() -> str:
    numbers = {"rtbFloorPriceSent": 0.02, "age": -0.01, "withBundleId": 0.25, "withGeo": -0.3}
    texts = {"gender": {"F": 0.2, "O": 0.1, "P": -0.1, "NA": 0.0}, "conType": {"1-URGENT": 0.3, "2-HIGH": -0.2, "(null)": 0.15, "NA": 0.0}}
    parts = ["select '(intercept)' as feature, null::varchar as category, -1.2::double as c, 1.0::double as s, avg(r) as g from learned"]
    parts += [f"select '{f}', null, {c}::double, stddev_samp({f}), avg(r * {f}) / stddev_samp({f}) from learned" for f, c in numbers.items()]
    parts += [
        f"select '{f}', '{v}', {c}::double, stddev_samp(({f} = '{v}')::int), coalesce(avg(r * ({f} = '{v}')::int) / nullif(stddev_samp(({f} = '{v}')::int), 0), 0) from learned"
        for f, values in texts.items()
        for v, c in values.items()
    ]
    return _score(
        f"""select feature, category, round(s, 6) as deviation, round(g, 6) as gradient, round(case
              when feature = '(intercept)' then abs(g) when s = 0 then abs(c)
              when c <> 0 then abs(g + {_REG} * (1 - {_MIXING}) * c * s + {_REG} * {_MIXING} * sign(c))
              else greatest(abs(g) - {_REG} * {_MIXING}, 0) end, 6) as violation from entries""",
        "training",
        f"learned as (select *, p1 - isWinning as r from scored where status = 'ok' and {_hash_part('request_id')} = 'train')",
        f"entries as ({' union all '.join(parts)})",
    )


_NUMBERS = ("age", "height", "width", "withBundleId", "withGeo", "rtbFloorPriceSent")


def _path_start() -> str:
    numbers = [
        f"select '{f}' as feature, stddev_samp({f}) as s, (avg(isWinning) * avg({f}) - avg(isWinning * {f})) / nullif(stddev_samp({f}), 0) as g from learned"
        for f in _NUMBERS
    ]
    slots = [
        f"""select '{c}', sqrt(m * (1 - m) * n / (n - 1)), (y * m - w) / sqrt(m * (1 - m) * n / (n - 1)) from (
              select n, y, count(*) / n as m, sum(isWinning) / n as w
              from learned join rank_{c} on rank_{c}.category = {c}, (select count(*) as n, avg(isWinning) as y from learned)
              where idx < (select count(*) - 1 from rank_{c}) group by {c}, n, y)"""
        for c in _CATEGORICAL
    ]
    return _with(
        _REQUESTS,
        f"normal as ({_rows('training')})",
        f"learned as (select * from normal where {_hash_part('request_id')} = 'train')",
        _ranked(_CATEGORICAL, "normal"),
        f"slopes as ({' union all '.join(numbers + slots)})",
        query="""select feature, count(*) as n_coefficients, round(max(abs(g)), 6) as steepest,
            (select round(max(abs(g)) / 0.5, 6) from slopes where s > 0) as largest_penalty from slopes where s > 0 group by feature""",
    )


def _certificate() -> str:
    widths = " union all ".join(f"select count(distinct {c}) as n from normal" for c in _CATEGORICAL)
    return _with(
        _REQUESTS,
        f"normal as ({_rows('training')})",
        f"widths as ({widths})",
        query=f"""select 'intercept' as kind, 1::bigint as n_coefficients, 1::bigint as n_checked, true as optimal
            union all select 'numeric', {len(_NUMBERS)}, {len(_NUMBERS)}, true
            union all select 'category', sum(n)::bigint, (sum(n) - count(*))::bigint, true from widths""",
    )


def _area(part: str) -> str:
    """Area under ROC of the category rates on a part, by counting pairs."""
    return f"""
scores as (select rate as score, isWinning = 1.0 as won from parts join rates using (gender) where part = '{part}'),
tallies as (select score, count(*) filter (won) as p, count(*) filter (not won) as n from scores group by score),
areas as (select sum(p * (coalesce(below, 0) + n / 2.0)) / (sum(p) * sum(n)) as area, sum(p) as p, sum(n) as n
  from (select *, sum(n) over (order by score rows between unbounded preceding and 1 preceding) as below from tallies))"""


_SCORE_COLUMNS = """request_id, featuresId as features_id, status, prediction, round(p0, 6) as probability_0,
    round(p1, 6) as probability_1, to_filter, case when p1 is not null then round(precision, 6) end as precision"""


def _score(query: str, mode: str = "training", *more: str) -> str:
    return _with(_REQUESTS, _scored(mode), *more, query=query)


def _report(keys: str = "", shown: str = "", threshold: str = "0.7::double") -> str:
    lead = f"{shown or keys}, " if keys else ""
    return _score(f"select {lead}{_SHOWN} from counted", "training", _gated(threshold), _counted(keys))


def _merged(input_column: str) -> str:
    return _score(
        f"select day, {_SHOWN} from merged",
        "training",
        _gated(),
        _counted("date_trunc('hour', ts) as hour, monitor_id"),
        f"""merged as (select cast(hour as date) as day, sum({input_column})::bigint as input,
            sum(filtered)::bigint as filtered, sum(false_negative)::bigint as false_negative,
            sum(invalid)::bigint as invalid, sum(real_value)::bigint as real_value, sum(total) as total
            from counted group by 1)""",
    )


def _flush() -> str:
    period = 6 * 3_600_000
    return _score(
        f"""select monitor_id, epoch_ms(start_ms) as window_start, window_end, {_SHOWN} from windows""",
        "training",
        _gated(),
        # The clock counts whole elapsed milliseconds; epoch_ms would round up.
        """ranked as (select *, epoch_us(ts) // 1000 as ms,
             row_number() over (partition by monitor_id order by ts, request_id) as rn from gated)""",
        "good as (select monitor_id, ms, min(rn) as rn from ranked where status = 'ok' group by 1, 2)",
        "starts as (select monitor_id, min(ms) as ms from ranked group by 1)",
        f"""hops as (select s.monitor_id, s.ms, g.ms as next_ms, g.rn as next_rn
             from (select monitor_id, ms from good union select monitor_id, ms from starts) s
             asof join good g on s.monitor_id = g.monitor_id and s.ms + {period} <= g.ms)""",
        """chain as (
             select h.monitor_id, 0::bigint as after_rn, h.ms as start_ms, h.next_ms, h.next_rn
             from starts s join hops h on h.monitor_id = s.monitor_id and h.ms = s.ms
             union all
             select h.monitor_id, c.next_rn, h.ms, h.next_ms, h.next_rn
             from chain c join hops h on h.monitor_id = c.monitor_id and h.ms = c.next_ms)""",
        f"""windows as (select c.monitor_id, c.start_ms, max(r.ts) as window_end, {_SUMS}
             from chain c join ranked r on r.monitor_id = c.monitor_id and r.rn > c.after_rn and r.rn <= c.next_rn
             group by c.monitor_id, c.start_ms)""",
    )


def _json() -> str:
    def text(c: str) -> str:
        return f"""'"{c}":"' || {c} || '"'"""

    def number(c: str) -> str:
        return f"""'"{c}":' || cast({c} as varchar)"""

    parts = [
        text("publisherId"), text("country"), number("age"), text("gender"), text("brand"), number("height"),
        number("width"), text("conType"), number("withBundleId"), number("withGeo"),
        """'"rtbFloorPriceSent":' || cast(cast(rtbFloorPriceSent as decimal(18, 6)) as varchar)""", text("featuresId"),
    ]
    body = " || ',' || ".join(parts)
    return _with(_REQUESTS, f"normal as ({_rows('training')})", query=f"select request_id, '{{' || {body} || '}}' as features from normal")


def _hash_part(key: str) -> str:
    bucket = f"('0x' || substr(md5(cast({key} as varchar)), 1, 8))::bigint % 10"
    return f"case when {bucket} < 8 then 'train' when {bucket} = 8 then 'cv' else 'test' end"


_NORMALIZED = """request_id, publisherId, country, age, gender, brand, height, width, conType, withBundleId, withGeo,
    rtbFloorPriceSent, featuresId"""


def _slot(feature: str, width: int) -> str:
    return f"(('0x' || substr(md5('{feature}=' || {feature}), 1, 8))::bigint % {width})"


def _normalized(mode: str, label: bool = True) -> str:
    columns = _NORMALIZED + (", isWinning" if label else "")
    return _with(_REQUESTS, f"normal as ({_rows(mode)})", query=f"select {columns} from normal")


_REQUEST_COLUMNS = (
    "request_id", "ts", "monitor_id", "publisherId", "country", "age", "gender", "brand", "height", "width",
    "connectionType", "withBundleId", "withGeoInfo", "rtbFloorSent", "isWinning",
)
# In the order of the table's columns.
_STRICT = ("country", "gender", "connectionType")


def oracle_sql() -> dict[str, str]:
    tumbling = _report("date_trunc('hour', ts) as window_start, monitor_id", "window_start, monitor_id")
    flush = _flush()
    score_fixed = _score(f"select {_SCORE_COLUMNS} from scored")
    metrics = [
        ("Request-Histogram", "input"), ("FilteredByPrediction-Counter", "filtered"),
        ("FalseNegative-Counter", "false_negative"), ("EvalFailure-Counter", "invalid"), ("RealAd-Counter", "real_value"),
    ]
    return {
        "feature_select": _with(
            _REQUESTS, query="select request_id, publisherId, country, age, rtbFloorSent, isWinning from requests"
        ),
        "csv_parse": _with(
            _REQUESTS,
            _CSV,
            query="""select id, cast(publisherId as bigint) as publisherId, country, cast(age as integer) as age, gender, brand,
                cast(height as integer) as height, cast(width as integer) as width, connectionType,
                withBundleId <> '0' as withBundleId, withGeoInfo <> '0' as withGeoInfo,
                cast(regexp_replace(trim(rtbFloorSent), '[fFdD]$', '') as double) as rtbFloorSent,
                cast(regexp_replace(trim(isWinning), '[fFdD]$', '') as double) as isWinning
                from checked where reject_reason is null""",
        ),
        "csv_rejects": _with(_REQUESTS, _CSV, query="select id, reject_reason from checked where reject_reason is not null"),
        "normalize_training": _normalized("training"),
        "normalize_prediction": _normalized("prediction", label=False),
        "normalize_unified": _normalized("unified"),
        "normalize_mixed": _with(
            _REQUESTS,
            f"labelled as ({_rows('training')})",
            f"unlabelled as ({_rows('prediction')})",
            query=f"""select {_NORMALIZED}, isWinning from labelled where withBundleId = 1
                union all select {_NORMALIZED}, null from unlabelled where withBundleId = 0""",
        ),
        "normalize_defaults": _with(
            _REQUESTS,
            query="""select 'prediction' as mode, request_id, case when brand <> '' then age else -1 end as age,
                  case when country <> '' then rtbFloorSent else 0.0::double end as rtbFloorPriceSent from requests
                union all
                select 'training', request_id, case when brand <> '' then age end,
                  case when country <> '' then rtbFloorSent end from requests""",
        ),
        "features_id": _with(_REQUESTS, query=f"select request_id, {_ID} as features_id from requests"),
        "feature_map_json": _json(),
        "label_outcome": _with(
            _REQUESTS,
            query="""select request_id, isWinning <> 1.0 as real_positive, cast(isWinning <> 1.0 as bigint) as real_count,
                isWinning = 1.0 as won from requests""",
        ),
        "hash_split": _with(_REQUESTS, query=f"select request_id, {_hash_part('request_id')} as part from requests"),
        "vocabulary": _with(
            _REQUESTS,
            f"normal as ({_rows('training')})",
            query=" union all ".join(
                f"""select '{c}' as feature, {c} as category, count(*) as frequency,
                    row_number() over (order by count(*) desc, {c}) - 1 as idx from normal group by {c}"""
                for c in _CATEGORICAL
            ),
        ),
        "random_split": _with(_REQUESTS, query="select request_id, 1::bigint as n_parts from requests"),
        "trained_fields": _with(
            _REQUESTS,
            f"normal as ({_rows('training')})",
            query="""select '(intercept)' as feature, 'intercept' as kind, cast(null as varchar) as category
                union all select unnest(['age', 'height', 'width', 'withBundleId', 'withGeo', 'rtbFloorPriceSent']), 'numeric', null"""
            + "".join(f" union all select distinct '{c}', 'category', {c} from normal" for c in _CATEGORICAL),
        ),
        "string_index": _indexed("true"),
        "string_index_joined": _indexed("true"),
        "string_index_skip": _indexed("isWinning = 1.0 and rtbFloorPriceSent > 100"),
        "one_hot": _one_hot(),
        "prepare_status": _with(
            _REQUESTS,
            """checked as (select request_id, case
                when brand = '' then 'bad_type:rtbFloorPriceSent'
                when gender is null then 'null_value:gender'
                when gender not in ('F', 'O', 'P', 'NA') then 'unseen_category:gender'
                when connectionType is null then 'null_value:conType'
                when connectionType not in ('1-URGENT', '2-HIGH', '(null)', 'NA') then 'unseen_category:conType'
                end as problem from requests)""",
            query="""select request_id, case when problem is null then 'ok' else 'failure' end as status,
                split_part(problem, ':', 1) as failure_reason,
                case when problem is not null then split_part(problem, ':', 2) end as failed_field from checked""",
        ),
        "prepare_missing_field": _with(
            _REQUESTS,
            query="""select request_id, 'failure' as status, 'missing_field' as failure_reason, 'age' as failed_field,
                cast(null as boolean) as to_filter from requests""",
        ),
        "score_fixed": score_fixed,
        "score_unlabelled": _score(f"select {_SCORE_COLUMNS} from scored", "prediction"),
        "score_default_on_failure": _score(
            """select request_id, case when status = 'ok' then featuresId else 'NA' end as features_id,
                coalesce(to_filter, false) as to_filter,
                case when status = 'ok' then round(precision, 6) else 0.0::double end as precision from scored"""
        ),
        "prediction_from_class": _score(
            """select request_id, case when status = 'ok' then cast(request_id as varchar) end as features_id,
                prediction = 0.0 as to_filter, case when status = 'ok' then round(precision, 6) end as precision from scored"""
        ),
        "score_csv_line": _score(
            """select request_id, concat(cast(to_filter as varchar), ',', cast(cast(precision as decimal(18, 6)) as varchar)) as line
                from scored where status = 'ok'"""
        ),
        "confidence_gate": _score("select request_id, to_filter, filtered from gated", "training", _gated()),
        "gate_off": _score("select request_id, to_filter, coalesce(to_filter, false) as filtered from scored"),
        "route_written": _score("select request_id, status, to_filter, filtered from gated", "training", _gated()),
        "score_with_counters": _score(
            f"select 'counted' as source, {_SHOWN}, input as n_written, filtered as n_filtered from counted", "training", _gated(), _counted()
        ),
        "route_kept": _score("select request_id, status, to_filter from gated where not filtered", "training", _gated()),
        "route_filtered": _score("select request_id, status, to_filter from gated where filtered", "training", _gated()),
        "coefficient_table_lookup": _score(
            "select request_id, gender, conType, w_gender as gender_coefficient, w_con as conType_coefficient from scored"
        ),
        "score_by_model_date": _with(
            _REQUESTS,
            _scored(name="scored"),
            _scored(floor=0.05, name="later"),
            query="""select '20240101' as model_date, request_id, to_filter,
                  case when status = 'ok' then round(precision, 6) end as precision from scored
                union all select '20240201', request_id, to_filter,
                  case when status = 'ok' then round(precision, 6) end from later""",
        ),
        "score_as_of": _with(
            _REQUESTS,
            _scored(name="early"),
            _scored(floor=0.05, name="late"),
            """chosen as (select request_id, strftime(ts, '%Y%m%d') as day from requests)""",
            """ungendered as (select request_id, 1.0::double / (1.0::double + exp(-(-1.2::double + 0.05::double * rtbFloorPriceSent - 0.01::double * age
                 + 0.25::double * withBundleId - 0.3::double * withGeo + w_con))) as q1 from late_weights)""",
            """judged as (select request_id, case when day >= '20240119' then '20240119' when day >= '20240108' then '20240108' end as model_date,
                 case when day >= '20240119' then q1 when day >= '20240108' then p1 end as p from chosen join early using (request_id) join ungendered using (request_id))""",
            query="""select request_id, model_date, case when p is null then 'failure' else 'ok' end as status,
                case when model_date is null then 'no_model' end as failure_reason, p <= 0.5 as to_filter,
                round(case when p > 0.5 then p else 1.0::double - p end, 6) as precision from judged""",
        ),
        "score_large_vocabulary": _with(
            _REQUESTS,
            f"normal as ({_rows('training')})",
            """weighed as (select normal.*, 1.0::double / (1.0::double + exp(-(-0.5::double + 0.02::double * rtbFloorPriceSent
                 + (p.p_size - 25) / 50.0::double))) as p1
               from normal left join part p on cast(p.p_partkey as varchar) = normal.publisherId and p.p_size % 10 <> 0)""",
            """scored as (select *, case when p1 is null then 'failure' else 'ok' end as status, 1.0::double - p1 as p0,
                 case when p1 > 0.5 then 1.0 when p1 <= 0.5 then 0.0 end::double as prediction, p1 <= 0.5 as to_filter,
                 case when p1 > 0.5 then p1 else 1.0::double - p1 end as precision from weighed)""",
            query=f"select {_SCORE_COLUMNS} from scored",
        ),
        "counters_total": _report(),
        "counters_by_monitor": _report("monitor_id"),
        "counters_intended_polarity": _score(
            f"select {_SHOWN} from counted",
            "training",
            """gated as (select * replace (isWinning = 1.0 as real_positive), coalesce(to_filter, false) as filtered
                from scored)""",
            _counted(),
        ),
        "counters_tumbling": tumbling,
        "counters_default_period": _report("time_bucket(interval '30 seconds', ts) as window_start", "window_start"),
        "counters_flush": flush,
        "counters_merge": _merged("input"),
        "counters_merge_compat": _merged("real_value"),
        "metrics_long": _score(
            " union all ".join(f"select monitor_id, '{name}' as metric, {c} as value from counted" for name, c in metrics),
            "training",
            _gated(),
            _counted("monitor_id"),
        ),
        "metrics_log_line": _score(
            """select monitor_id, concat_ws(',', cast(input as varchar), cast(real_value as varchar),
                cast(filtered as varchar), cast(false_negative as varchar), cast(invalid as varchar),
                cast(cast(cast(total as double) / input as decimal(18, 6)) as varchar)) as line from counted""",
            "training",
            _gated(),
            _counted("monitor_id"),
        ),
        "confusion_matrix": _score(
            "select real_positive as real, filtered as predicted, count(*) as n from gated where status = 'ok' group by 1, 2",
            "training",
            _gated(),
        ),
        "quality_ratios": _score(
            """select *, n_scored / n_rows as coverage,
                (true_positive + true_negative) / nullif(n_scored, 0) as accuracy,
                true_positive / nullif(true_positive + false_positive, 0) as precision,
                true_positive / nullif(true_positive + false_negative, 0) as recall from cells""",
            "training",
            _gated(),
            """cells as (select monitor_id, count(*) as n_rows, count(*) filter (status = 'ok') as n_scored,
                count(*) filter (status = 'ok' and real_positive and filtered) as true_positive,
                count(*) filter (status = 'ok' and not real_positive and filtered) as false_positive,
                count(*) filter (status = 'ok' and real_positive and not filtered) as false_negative,
                count(*) filter (status = 'ok' and not real_positive and not filtered) as true_negative
                from gated group by 1)""",
        ),
        "holdout_confusion": _score(
            f"""select isWinning as real, prediction as predicted, count(*) as n from scored
                where status = 'ok' and {_hash_part('request_id')} = 'test' group by 1, 2"""
        ),
        "assembled": _assembled(),
        "normalize_custom_rules": _with(
            _REQUESTS,
            query="""select request_id, cast(publisherId as varchar) as publisherId,
                case when country is null or country in ('', 'FRANCE', 'CHINA') then 'NA' else country end as country,
                case when gender is null or gender in ('F', 'null') then 'NA' else gender end as gender,
                case when brand is null or brand in ('Brand#11', 'Brand#23') then 'NA' else brand end as brand,
                connectionType as conType from requests""",
        ),
        "declared_schema": _with(
            _REQUESTS,
            query="""select * from (values ('publisherId', 'bigint', 'string'), ('feature1', 'string', null)) as v(field, declared, found),
                (select count(*) as n_rows from requests)""",
        ),
        "declared_not_null": _with(
            _REQUESTS,
            query=" union all ".join(
                f"""select '{c}' as field, {str(c in _STRICT).lower()} as not_null, count(*) as n_rows,
                    count(*) filter ({c} is null) as n_null, {f"count(*) filter ({c} is null)" if c in _STRICT else "0::bigint"} as n_rejected from requests"""
                for c in _REQUEST_COLUMNS
            ),
        ),
        "null_rejected_rows": _with(
            _REQUESTS,
            query=f"""select request_id, concat_ws(',', {", ".join(f"case when {c} is null then '{c}' end" for c in _STRICT)}) as null_fields
                from requests where {" or ".join(f"{c} is null" for c in _STRICT)}""",
        ),
        "csv_accounting": _with(
            _REQUESTS,
            _CSV,
            query="""select 3::bigint as n_files, n + blanks + 3 as n_lines, kept as n_kept, n - kept as n_rejected, 3::bigint as n_header,
                blanks as n_blank, true as adds_up, sum_age, sum_publisher
                from (select count(*) as n, count(*) filter (reject_reason is null) as kept, count(*) filter (id::bigint % 40 = 0) as blanks,
                    sum(case when reject_reason is null then age::bigint end)::bigint as sum_age,
                    sum(case when reject_reason is null then publisherId::bigint end)::bigint as sum_publisher from checked)""",
        ),
        "export_declared": _coefficients(),
        "train_hashed": _with(
            _REQUESTS,
            f"normal as (select *, {_slot('country', 8)} as slot from ({_rows('training')}))",
            f"rates as (select slot, avg(isWinning) as rate from normal where {_hash_part('request_id')} = 'train' group by slot)",
            query="""select country, count(*) as n_rows, round(any_value(rate), 4) as probability, any_value(slot) as slot
                from normal join rates using (slot) group by country""",
        ),
        "hashed_collisions": _with(
            _REQUESTS,
            f"normal as ({_rows('training')})",
            query=" union all ".join(
                f"""select '{c}' as feature, count(*) as slots, sum(n)::bigint as categories, sum(case when n > 1 then n else 0 end)::bigint as colliding
                    from (select {_slot(c, 64)} as slot, count(distinct {c}) as n from normal group by 1)"""
                for c in _CATEGORICAL
            ),
        ),
        "train_saturated": _coefficients(),
        "train_pipeline_saturated": _coefficients(),
        "train_penalised": _penalised(),
        "train_certificate": _certificate(),
        "optimality_fixed": _optimality_fixed(),
        "penalty_path_start": _path_start(),
        "tune_saturated": _with(
            _REQUESTS,
            _odds(),
            _area("cv"),
            query="""select 0.0::double as reg_param, 1.0::double as elastic_net_param, round(area, 6) as area_under_roc from areas
                union all select 10.0, 1.0, 0.5""",
        ),
        "holdout_saturated": _with(
            _REQUESTS,
            _odds(),
            _area("test"),
            query="""select round(area, 6) as area_under_roc,
                (select round(avg(((score > 0.5) = won)::int), 6) from scores) as accuracy,
                round((p + n) / (select count(*) from parts where part = 'test'), 6) as coverage from areas""",
        ),
        "model_round_trip": _with(
            _REQUESTS,
            _odds(),
            query="""select request_id, round(rate, 4) as pipeline_probability, round(rate, 4) as published_probability
                from parts join rates using (gender) where part = 'test'""",
        ),
        "split_sizes": _with(
            _REQUESTS,
            f"parts as (select {_hash_part('request_id')} as part from requests)",
            query="""select part, count(*) as cached_rows, count(*) as rows, true as was_cached from parts group by part""",
        ),
        "stored_split": _with(
            _REQUESTS,
            query="""select part, n_rows, true as near_its_share
                from (values ('train'), ('cv'), ('test')) as v(part), (select count(*) as n_rows from requests)""",
        ),
        "holdout_fixed": _score(
            """select p::bigint as positives, n::bigint as negatives, round(area, 6) as area_under_roc from areas""",
            "training",
            f"""tallies as (select p1 as score, count(*) filter (isWinning = 1.0) as p, count(*) filter (isWinning <> 1.0) as n
                from scored where status = 'ok' and {_hash_part('request_id')} = 'test' group by p1)""",
            """areas as (select sum(p * (coalesce(below, 0) + n / 2.0)) / (sum(p) * sum(n)) as area, sum(p) as p, sum(n) as n
                from (select *, sum(n) over (order by score rows between unbounded preceding and 1 preceding) as below from tallies))""",
        ),
        "counters_null_ts": _report(
            "case when request_id % 10 <> 0 then date_trunc('day', ts) end as window_start", "window_start"
        ),
        "sink_switches": _with(
            _REQUESTS,
            "windows as (select distinct time_bucket(interval '7 days', ts, timestamp '1970-01-01') as w, monitor_id from requests)",
            query="""select m as metric_monitoring, l as send_metric_logging, case when m then 5 * n else 0 end::bigint as metric_rows,
                case when l then n else 0 end::bigint as log_lines
                from (values (true, true), (true, false), (false, true), (false, false)) as v(m, l), (select count(*) as n from windows)""",
        ),
        "stream_score": score_fixed,
        "stream_counters_late": tumbling,
        "stream_metric_deltas": _score(
            " union all ".join(f"select monitor_id, '{name}' as metric, {c} as value from counted" for name, c in metrics),
            "training",
            _gated(),
            _counted("monitor_id"),
        ),
        "stream_counters": tumbling,
        "stream_flush": flush,
        "stream_period_once": _score(
            f"select window_start, monitor_id, kind, 1::bigint as n_reports, {_SHOWN} from counted",
            "training",
            _gated(),
            """times as (select min(epoch_us(ts)) as t0, max(epoch_us(ts)) as t1 from requests)""",
            """arrived as (
              select gated.*, time_bucket(interval '1 hour', ts) as window_start,
                request_id % 50 = 0 and (epoch_us(ts) - t0) * 8 < t1 - t0 as late, t1 from gated, times)""",
            """kinds as (
              select *, case
                when late and bool_or(not late) over (partition by window_start, monitor_id) then 'correction'
                when epoch_ms(window_start) + 3600000 > t1 // 1000 - 86400000 then 'open'
                else 'final' end as kind from arrived)""",
            _counted("window_start, monitor_id, kind", "kinds"),
        ),
    }
