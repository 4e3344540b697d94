"""The registered queries once more, as plain SQL for an independent engine."""

from __future__ import annotations

from rowmend.operators.repair import feature_weights
from rowmend.plans import catalog
from rowmend.sources import views

FEATURES = views.ORDER_FEATURES
DISCRETE = ["o_orderstatus", "o_orderpriority", "c_mktsegment", "o_month"]
NUMERIC = ["c_nationkey", "o_totalprice", "c_acctbal"]
GOWER_NUMERIC = ["o_month", "c_nationkey", "o_totalprice", "c_acctbal"]
LIST = ", ".join(FEATURES)

SCORE = views.FROZEN_SCORE
for _literal in ("1.0", "0.0", "0.25", "0.2", "500000.0", "10000.0", "11000.0"):
    SCORE = SCORE.replace(f"{_literal}D", f"{_literal}::double")

ORDERS = f"""om as (
  select o_orderkey as row_id, o_orderstatus, o_orderpriority, c_mktsegment,
         month(o_orderdate)::int as o_month, c_nationkey, o_totalprice, c_acctbal,
         {views.LABEL_RULE} as label, {SCORE} as score
  from orders join customer on o_custkey = c_custkey)"""
FLAGGED = f"{ORDERS}, fl as (select *, (score >= 0.5)::int as pred from om)"
CUSTOMERS = """cm as (
  select c_custkey, c_name, c_nationkey, case when c_acctbal >= 0 then c_acctbal end as c_acctbal,
         case when c_custkey % 17 <> 0 then c_mktsegment end as c_mktsegment
  from customer)"""
LINES = "li as (select * from lineitem)"
LINE_NUMBERS = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
]
LINE_COLUMNS = [*LINE_NUMBERS, "l_returnflag", "l_linestatus", "l_shipdate"]
DOCS = """dl as (
  select d.doc_id, lang, source, n_chars, 1 - quality as label
  from documents d join labels l on d.doc_id = l.doc_id)"""
EVENTS = """ev as (
  select user_id as id, event_id as seq, event_type as status, ts as updated, props as payload from events)"""


def _split_sql(source: str, seed: str, share: str, flag: str) -> str:
    """Exact class shares by largest remainder, rows ordered by hash."""
    return f"""
  n_{flag} as (select label, count(*) as n, sum(count(*)) over () as total from {source} group by label),
  t_{flag} as (select *, total - ceil({share}::double * total)::bigint as train from n_{flag}),
  w_{flag} as (select *, (train * n) // total as whole, (train * n) % total as rest from t_{flag}),
  c_{flag} as (select *, whole + case when row_number() over (order by rest desc, label::varchar)
                 <= train - sum(whole) over () then 1 else 0 end as want from w_{flag}),
  r_{flag} as (select s.*, row_number() over (partition by s.label
                 order by md5(s.row_id::varchar || ':{seed}'), s.row_id) as place from {source} s),
  {flag} as (select r.* exclude (place), (r.place <= c.want)::int as is_{flag}
             from r_{flag} r join c_{flag} c on r.label = c.label)"""


TRAIN = f"{ORDERS}, {_split_sql('om', '42', '0.2', 'train')}"


def _literal(value: float) -> str:
    return f"'{value!r}'::double"


SCALES = ", ".join(
    f"""(select case when quantile_cont({c}, 0.95) > quantile_cont({c}, 0.05)
          then quantile_cont({c}, 0.95) - quantile_cont({c}, 0.05) else max({c}) - min({c}) end
         from om where label = 0)::double as s_{c}""" for c in NUMERIC
)
RANGES = ", ".join(
    f"(select min({c}) from om where label = 0)::double as lo_{c}, "
    f"(select max({c}) from om where label = 0)::double as hi_{c}" for c in GOWER_NUMERIC
)


def _mixed_sql(weights: dict[str, float], q: str = "q", p: str = "p") -> str:
    terms, total = [], 0.0
    for c in FEATURES:
        w = weights[c]
        total += w
        if c in DISCRETE:
            term = f"case when {q}.{c} is distinct from {p}.{c} then 1.0::double else 0.0::double end"
        else:
            term = f"abs({p}.{c}::double - {q}.{c}::double) / sc.s_{c}"
        terms.append(f"{_literal(w)} * ({term})")
    return f"({' + '.join(terms)}) / {_literal(total)}"


def _gower_sql() -> str:
    terms = []
    for c in FEATURES:
        if c in GOWER_NUMERIC:
            terms.append(
                f"abs(p.{c}::double - q.{c}::double) / (greatest(q.{c}, rg.hi_{c}) - least(q.{c}, rg.lo_{c}))"
            )
        else:
            terms.append(f"(case when q.{c} is distinct from p.{c} then 1.0::double else 0.0::double end)")
    return f"({' + '.join(terms)}) / 7.0::double"


def _nearest_sql(name: str, queries: str, distance: str, extra: str, k: int) -> str:
    """The k smallest (distance, pool_id) of every query row, by comparing all pairs."""
    return f"""
  {name}_all as (
    select q.row_id, min({{'d': {distance}, 'id': p.row_id}}, {k}) as best
    from {queries} q, (select * from om where label = 0) p, {extra} group by q.row_id),
  {name} as (
    select row_id, unnest(best).d as distance, unnest(best).id as pool_id,
           generate_subscripts(best, 1) as rank from {name}_all)"""


EQUAL = {c: 1.0 for c in FEATURES}
NEAREST = f"""{ORDERS}, sc as materialized (select {SCALES}),
  an as (select * from om where label = 1),
  {_nearest_sql('nn', 'an', _mixed_sql(EQUAL), 'sc', 9)}"""
GOWER = f"""{ORDERS}, rg as materialized (select {RANGES}),
  an as (select * from om where label = 1),
  {_nearest_sql('nn', 'an', _gower_sql(), 'rg', 5)}"""


def _agreed_sql(name: str, found: str, discrete: list[str], features: list[str] = FEATURES) -> str:
    """Mode (smallest on ties) or median of the neighbours' values, one row per query."""
    parts, joins = [], []
    for c in features:
        if c in discrete:
            parts.append(f"""
  {name}_{c} as (
    select row_id, v from (
      select f.row_id, p.{c} as v, row_number() over (partition by f.row_id order by count(*) desc, p.{c}) as o
      from {found} f join om p on p.row_id = f.pool_id group by f.row_id, p.{c}) where o = 1)""")
            joins.append(f"join {name}_{c} on {name}_{c}.row_id = m.row_id")
    medians = ", ".join(
        f"quantile_cont(p.{c}::double, 0.5) as agreed_{c}" for c in features if c not in discrete
    )
    parts.append(f"""
  {name}_m as (select f.row_id, {medians} from {found} f join om p on p.row_id = f.pool_id group by f.row_id)""")
    chosen = ", ".join(
        f"{name}_{c}.v as agreed_{c}" if c in discrete else f"m.agreed_{c}" for c in features
    )
    parts.append(f"""
  {name} as (select m.row_id, {chosen} from {name}_m m {' '.join(joins)})""")
    return ",".join(parts)


GOWER_TEXT = [c for c in FEATURES if c not in GOWER_NUMERIC]
SUGGESTED = f"""{GOWER}, {_agreed_sql('ag', 'nn', GOWER_TEXT)},
  sg as ({' union all '.join(
    f"select row_id, '{c}' as feature, null::double as suggested_number, agreed_{c}::varchar as suggested_text from ag"
    if c in GOWER_TEXT else
    f"select row_id, '{c}' as feature, case when agreed_{c} = floor(agreed_{c}) then agreed_{c} "
    f"else round(agreed_{c}, 2) end as suggested_number, null::varchar as suggested_text from ag"
    for c in FEATURES)})"""

CONTRIBUTIONS = "fc as (" + " union all ".join(
    f"select row_id, '{c}' as feature, ({text})::double as contribution from om"
    for c, text in catalog.FROZEN_CONTRIBUTIONS.items()
) + ")"
TOP = """tp as (
  select * from (select *, row_number() over (partition by row_id order by contribution desc, feature) as place
                 from fc where contribution > 0) where place <= 3)"""

_APPLY_COLUMNS = ", ".join(
    f"coalesce(max(round_even(case when s.feature = '{c}' then s.suggested_number end, 0))::int, any_value(a.{c})) as {c}"
    if c in ("o_month", "c_nationkey") else
    f"coalesce(max(case when s.feature = '{c}' then s.suggested_number end), any_value(a.{c})) as {c}"
    if c in GOWER_NUMERIC else
    f"coalesce(max(case when s.feature = '{c}' then s.suggested_text end), any_value(a.{c})) as {c}"
    for c in FEATURES
)
APPLIED = f"""{SUGGESTED}, {CONTRIBUTIONS}, {TOP},
  ap as (select a.row_id, {_APPLY_COLUMNS}
         from an a left join (select sg.* from sg join tp on sg.row_id = tp.row_id and sg.feature = tp.feature) s
           on s.row_id = a.row_id group by a.row_id)"""

DETECTED = f"""{FLAGGED}, bd as (
  select row_id, {LIST}, round(score, 4) as risk_score, pred as prediction,
         case when pred = 1 then 'Anomaly' else 'Normal' end as status from fl)"""

PRF = """c as (select count(*) filter (label = 1 and pred = 1) as tp, count(*) filter (label <> 1 and pred = 1) as fp,
                  count(*) filter (label = 1 and pred <> 1) as fn, count(*) filter (label <> 1 and pred <> 1) as tn
           from {source}),
  pr as (select *, case when tp + fp > 0 then tp / (tp + fp) else 0 end as p,
                case when tp + fn > 0 then tp / (tp + fn) else 0 end as r from c),
  f as (select *, case when p + r > 0 then 2 * p * r / (p + r) else 0 end as f1,
               case when 4 * p + r > 0 then 5 * p * r / (4 * p + r) else 0 end as f2 from pr)"""
WEIGHTED = """k as (select label as v, count(*) as support, count(*) filter (pred = label) as tp from {source} group by label),
  q as (select pred as v, count(*) as called from {source} group by pred),
  g as (select support, coalesce(tp / nullif(called, 0), 0) as p, tp / support as r from k left join q using (v)),
  w as (select sum(p * support) / sum(support) as wp, sum(r * support) / sum(support) as wr,
               sum(case when p + r > 0 then 2 * p * r / (p + r) else 0 end * support) / sum(support) as wf from g)"""
AUC = """ds as (select score, count(*) filter (label = 1) as pos, count(*) filter (label <> 1) as neg
              from {source} group by score),
  rk as (select *, sum(neg) over (order by score desc) as upto from ds),
  au as (select (sum(pos)::double * sum(neg)::double - sum(pos * (upto - neg / 2.0::double)))
                / (sum(pos)::double * sum(neg)::double) as auc from rk)"""


def _stand_in_sql() -> str:
    parts = []
    for name, text in catalog.STAND_INS.items():
        source = f"(select label, ({text})::double as score, (({text})::double >= 0.5)::int as pred from om)"
        body = ", ".join([PRF.format(source=source), WEIGHTED.format(source=source), AUC.format(source=source)])
        parts.append(f"""
  select '{name}' as model, unnest(['accuracy', 'f1', 'f1_weighted', 'auc']) as metric,
         unnest([a, b, d, e]) as value from (
    with {body} select round((tp + tn) / (tp + tn + fp + fn), 12) as a, round(f1, 12) as b,
                       round(wf, 12) as d, round(auc, 9) as e from f, w, au)""")
    return f"with {ORDERS} " + " union all ".join(parts)


def _repair_rounds(rounds: int, k: int) -> str:
    """The greedy search written out round by round."""
    weights = feature_weights(catalog.FROZEN_IMPORTANCES)
    mutable = [c for c in sorted(FEATURES, key=lambda c: -weights[c]) if c != "c_nationkey"]
    parts = [f"with {ORDERS}, sc as materialized (select {SCALES})", f"""
  st0 as materialized (select row_id, {LIST}, score as before_score, score, 1 as pred, [] ::varchar[] as changed,
               true as open from om where score >= 0.5)"""]
    for i in range(rounds):
        parts.append(f"  op{i} as (select * from st{i} where open)")
        parts.append(_nearest_sql(f"nn{i}", f"op{i}", _mixed_sql(weights), "sc", k))
        parts.append(_agreed_sql(f"ag{i}", f"nn{i}", DISCRETE))
        trials = []
        for place, c in enumerate(mutable):
            candidate = f"a.agreed_{c}"
            if c == "o_totalprice":
                candidate = f"least(greatest({candidate}, 20000.0::double), 300000.0::double)"
            elif c == "c_acctbal":
                candidate = f"greatest({candidate}, 0.0::double)"
            columns = ", ".join(f"{candidate} as {n}" if n == c else f"o.{n}" for n in FEATURES)
            trials.append(f"""
    select o.row_id, {columns}, o.before_score, o.score as was, o.changed, '{c}' as feature, {place} as place,
           {_literal(weights[c])} as weight
    from op{i} o join ag{i} a on a.row_id = o.row_id
    where not list_contains(o.changed, '{c}') and o.{c} is distinct from {candidate}""")
        parts.append(f"  tr{i} as ({' union all '.join(trials)})")
        parts.append(f"  ts{i} as (select *, {SCORE} as score from tr{i})")
        parts.append(f"""
  be{i} as (select * from (
    select *, (score >= 0.5)::int as pred, row_number() over (partition by row_id
      order by (score >= 0.5)::int, was - score desc, weight desc, place) as o
    from ts{i} where score < 0.5 or was - score >= 0.0001::double) where o = 1)""")
        kept = ", ".join(f"case when b.row_id is null then s.{c} else b.{c} end as {c}" for c in FEATURES)
        parts.append(f"""
  st{i + 1} as materialized (
    select s.row_id, {kept}, s.before_score, coalesce(b.score, s.score) as score,
           coalesce(b.pred, s.pred) as pred,
           case when b.row_id is null then s.changed else list_append(s.changed, b.feature) end as changed,
           s.open and b.row_id is not null and b.pred = 1 as open
    from st{i} s left join be{i} b on b.row_id = s.row_id)""")
    return ",\n".join(parts)


def _repair_sql(rounds: int, k: int) -> str:
    shown = ", ".join(f"round({c}, 6) as {c}" if c in ("o_totalprice", "c_acctbal") else c for c in FEATURES)
    return _repair_rounds(rounds, k) + f"""
  select row_id, {shown},
         case when pred = 0 then 'repaired' when score < before_score then 'partially_repaired'
              else 'not_repaired' end as status,
         round(before_score, 6) as before_score, round(score, 6) as after_score,
         len(changed)::int as applied_changes, array_to_string(changed, ',') as changed
  from st{rounds}"""


def _changes_sql(rounds: int, k: int) -> str:
    made = " union all ".join(
        f"select row_id, feature, round(was, 6) as before_score, round(score, 6) as after_score from be{i}"
        for i in range(rounds)
    )
    return f"{_repair_rounds(rounds, k)} {made}"


_LEVELS = " union all ".join(
    f"""select d.doc_id, '{c}_' || l.v as indicator, (d.{c} is not distinct from l.v)::int as flag
        from documents d, (select v from (select distinct {c} as v from documents where {c} is not null)
                    qualify row_number() over (order by v) > 1) l""" for c in ("lang", "source")
)

_DESCRIBE = " union all ".join(
    f"""select '{c}' as "column", count({c}) as n, round(avg({c}), 2) as mean, round(stddev_samp({c}), 2) as std,
        round(min({c}), 2)::double as "min", round(quantile_cont({c}, 0.25), 2) as p25,
        round(quantile_cont({c}, 0.5), 2) as p50, round(quantile_cont({c}, 0.75), 2) as p75,
        round(max({c}), 2)::double as "max" from li"""
    for c in LINE_NUMBERS
)

_OUTCOMES = f"""{FLAGGED}, oc as (
  select row_id, score, pred, greatest(0.0::double, score - case when c_mktsegment = 'MACHINERY' then 0.2::double
           when o_month > 6 then 0.1::double else 0.0::double end) as after, o_month = 12 as dry from fl),
  oo as (select *, (after >= 0.5)::int as after_pred from oc)"""


def all_oracles() -> dict[str, str]:
    sql = {
        "csv_scan": f"with {CUSTOMERS} select * replace (c_nationkey::bigint as c_nationkey) from cm",
        "csv_scan_breaks": "select doc_id, md5(text) as text_md5, lang, source, n_chars from documents",
        "load_state": f"with {TRAIN} select row_id, {LIST} from train where is_train = 1 and label = 0",
        "head_preview": f"with {ORDERS} select row_id, {LIST} from om order by row_id limit 5",
        "scored_csv_sink": f"""with {DETECTED} select * replace (o_month::bigint as o_month,
            c_nationkey::bigint as c_nationkey, prediction::bigint as prediction) from bd""",
        "scored_csv_anomalies": f"""with {DETECTED} select * replace (o_month::bigint as o_month,
            c_nationkey::bigint as c_nationkey, prediction::bigint as prediction) from bd where prediction = 1""",
        "saved_scores": f"with {TRAIN} select row_id, 1::int as same from train where is_train = 0",
        "attribution_sums": f"with {ORDERS} select row_id, {len(FEATURES)}::bigint as features, 1::int as adds_up from om",
        "target_check_failures": f"""with {ORDERS}, {CUSTOMERS}, v as (
              select 'o_totalprice' as target, o_totalprice::varchar as v from om
              union all select 'c_mktsegment', c_mktsegment from cm
              union all select 'only', '1' from om
              union all select 'rare', (row_id = (select min(row_id) from om))::varchar from om),
            g as (select target, v, count(*) as n from v group by target, v)
            select target, sum(n)::bigint as n_rows, coalesce(sum(n) filter (v is null), 0)::bigint as missing_count,
                   count(v) as unique_count, min(n) filter (v is not null) as min_class_count,
                   case target when 'o_totalprice' then 'UNSUPPORTED_TARGET_TYPE' else 'INVALID_INPUT' end as code,
                   case target when 'o_totalprice' then 'target looks continuous'
                               when 'c_mktsegment' then 'target has missing values'
                               when 'only' then 'target has fewer than two classes'
                               else 'a class has fewer than two rows' end as reason
            from g group by target""",
        "batch_detect_range": f"""with {DETECTED} select * from (
            select *, row_number() over (order by row_id) - 1 as sample_id from bd) where sample_id between 100 and 400""",
        "suggest_repairs_frozen": f"""with {SUGGESTED}, {CONTRIBUTIONS}, {TOP}
            select sg.row_id, sg.feature, tp.place, sg.suggested_number, sg.suggested_text,
                   round(tp.contribution, 9) as impact, 'agreed by the 5 nearest healthy rows' as reason
            from sg join tp on sg.row_id = tp.row_id and sg.feature = tp.feature""",
        "greedy_repair_dry": f"""with {FLAGGED} select row_id,
            {', '.join(f"round({c}, 6) as {c}" if c in ("o_totalprice", "c_acctbal") else c for c in FEATURES)},
            case when pred = 1 then 'anomaly_detected' else 'already_normal' end as status,
            round(score, 6) as before_score, round(score, 6) as after_score, 0::int as applied_changes, '' as changed from fl""",
        "table_overview": f"""with {LINES} select count(*) as n_rows, {len(LINE_COLUMNS)}::bigint as n_columns,
            (count(*) * {len(LINE_COLUMNS)} - {" - ".join(f"count({c})" for c in LINE_COLUMNS)})::bigint as missing_cells,
            round((count(*) * (4 + 8 * 8) + sum(strlen(l_returnflag) + strlen(l_linestatus))) / 1024.0::double, 6)
              as size_kb from li""",
        "missing_report": f"""with {CUSTOMERS}, m as (
            select unnest(['c_custkey', 'c_name', 'c_nationkey', 'c_acctbal', 'c_mktsegment']) as "column",
                   unnest([count(*) - count(c_custkey), count(*) - count(c_name), count(*) - count(c_nationkey),
                           count(*) - count(c_acctbal), count(*) - count(c_mktsegment)]) as missing_count, count(*) as n from cm)
            select "column", missing_count, round(missing_count / n * 100, 2) as missing_percent
            from m where missing_count > 0""",
        "numeric_describe": f"with {LINES} {_DESCRIBE}",
        "category_distribution": f"""with {CUSTOMERS}, u as (
            select 'c_mktsegment' as "column", c_mktsegment as value from cm
            union all select 'c_name', c_name from cm
            union all select 'nation', c_nationkey::varchar from cm)
            select "column", value, count(*) as n,
                   round(count(*) / (select count(*) from cm) * 100, 2) as percent
            from u where value is not null group by "column", value""",
        "target_distribution": f"""with {ORDERS}, c as (
            select count(*) as n_rows, count(*) filter (label = 0) as n_normal, count(*) filter (label = 1) as n_anomaly,
                   round(avg(label), 6) as positive_rate from om)
            select *, round(n_normal / n_rows * 100, 1) as normal_percent,
                   round(n_anomaly / n_rows * 100, 1) as anomaly_percent,
                   case when n_anomaly > 0 then '1:' || (n_normal // greatest(n_anomaly, 1))::varchar else 'N/A' end
                     as imbalance_ratio from c""",
        "target_check": f"""with {ORDERS}, g as (select label, count(*) as n from om group by label)
            select 'label' as target, sum(n)::bigint as n_rows, coalesce(sum(n) filter (label is null), 0)::bigint as missing_count,
                   count(label) as unique_count, round(count(label) / sum(n) filter (label is not null), 6) as unique_ratio,
                   min(n) filter (label is not null) as min_class_count, 'OK' as code, '' as reason, '' as suggestion from g""",
        "drop_columns": f"with {ORDERS} select {LIST}, score from om",
        "mean_impute": f"""with {CUSTOMERS} select c_custkey, c_name, c_nationkey,
            round(coalesce(c_acctbal, avg(c_acctbal) over ()), 6) as c_acctbal, c_mktsegment from cm""",
        "row_filter": f"with {CUSTOMERS} select * from cm where c_mktsegment is distinct from 'MACHINERY'",
        "label_encode": f"""with {CUSTOMERS} select *,
            (dense_rank() over (order by coalesce(c_mktsegment, 'nan')) - 1)::int as c_mktsegment_idx from cm""",
        "one_hot": _LEVELS,
        "one_hot_sparse": """with v as (
              select distinct 'lang' as col, lang::varchar as value from documents where lang is not null
              union all select distinct 'source', source::varchar from documents where source is not null),
            n as (select col, value, row_number() over (partition by col order by value) as nth,
              row_number() over (order by col, value) - 1 - dense_rank() over (order by col) as place from v)
            select doc_id, concat_ws(' ', l.place, s.place) as flags from documents
              left join n l on l.col = 'lang' and l.value = lang and l.nth > 1
              left join n s on s.col = 'source' and s.value = source and s.nth > 1""",
        "standardise": f"with {ORDERS} select row_id, " + ", ".join(
            f"round(({c} - avg({c}) over ()) / stddev_pop({c}) over (), 6) as {c}_z" for c in NUMERIC
        ) + " from om",
        "stratified_split": f"with {TRAIN} select row_id, label, is_train from train",
        "validation_split": f"""with {TRAIN}, tr as (select * from train where is_train = 1),
            {_split_sql('tr', '42:val', '0.25', 'fit')} select row_id, label, is_fit from fit""",
        "random_split": f"""with {ORDERS} select row_id,
            ((('0x' || substr(md5(row_id::varchar || ':42'), 1, 8))::bigint % 10000) >= 2000)::int as is_train from om""",
        "class_weights": f"""with {ORDERS} select row_id, label,
            round(count(*) over () / ((select count(distinct label) from om) * count(*) over (partition by label)), 9)
              as class_weight from om""",
        "healthy_pool": f"with {TRAIN} select row_id, {LIST} from train where is_train = 1 and label = 0",
        "discrete_columns": f"with {ORDERS} " + " union all ".join(
            f"""select '{c}' as "column", 'discrete' as kind""" if c in DISCRETE[:3] else
            f"""select '{c}' as "column", case when count(distinct {c}) <= 12 then 'discrete' else 'numeric' end as kind from om"""
            if c in ("o_month", "c_nationkey") else f"""select '{c}' as "column", 'numeric' as kind"""
            for c in FEATURES
        ),
        "gower_distance": f"with {GOWER} select row_id, pool_id, rank::int as rank, round(distance, 9) as distance from nn",
        "mixed_distance": f"with {NEAREST} select row_id, pool_id, round(distance, 9) as distance from nn",
        "knn_join": f"with {NEAREST} select row_id, pool_id, rank::int as rank, round(distance, 9) as distance from nn",
        "numeric_scales": f"with {ORDERS}, sc as (select {SCALES}) " + " union all ".join(
            f"select '{c}' as feature, 1.0::double as scale" if c in DISCRETE else
            f"select '{c}' as feature, round(s_{c}, 6) as scale from sc" for c in FEATURES
        ),
        "neighbour_consensus": f"with {NEAREST}, {_agreed_sql('ag', 'nn', DISCRETE)} select row_id, " + ", ".join(
            f"agreed_{c}" if c in DISCRETE else f"round(agreed_{c}, 6) as agreed_{c}" for c in FEATURES
        ) + " from ag",
        "suggested_value": f"with {SUGGESTED} select * from sg",
        "confusion_matrix": f"""with {FLAGGED}, l as (select distinct unnest([label, pred]) as v from fl),
            n as (select label, pred, count(*) as n from fl group by label, pred)
            select a.v as actual, b.v as predicted, coalesce(n.n, 0) as n,
                   case when a.v = 0 and b.v = 0 then 'TN' when a.v = 0 and b.v = 1 then 'FP'
                        when a.v = 1 and b.v = 0 then 'FN' when a.v = 1 and b.v = 1 then 'TP' end as cell,
                   round(coalesce(n.n, 0) / sum(coalesce(n.n, 0)) over (partition by a.v), 6) as share
            from l a cross join l b left join n on n.label = a.v and n.pred = b.v""",
        "accuracy": f"with {FLAGGED} select round(avg((label = pred)::int), 12) as accuracy from fl",
        "anomaly_prf": f"""with {FLAGGED}, {PRF.format(source='fl')}
            select round(p, 12) as precision, round(r, 12) as recall, round(f1, 12) as f1 from f""",
        "weighted_prf": f"""with {FLAGGED}, {WEIGHTED.format(source='fl')} select round(wp, 12) as precision_weighted,
            round(wr, 12) as recall_weighted, round(wf, 12) as f1_weighted from w""",
        "fbeta": f"with {FLAGGED}, {PRF.format(source='fl')} select 2.0::double as beta, round(f2, 12) as fbeta from f",
        "roc_auc": f"with {FLAGGED}, {AUC.format(source='fl')} select round(auc, 9) as auc from au",
        "roc_curve": f"""with {FLAGGED}, ds as (
              select score, count(*) filter (label = 1) as pos, count(*) filter (label <> 1) as neg from fl group by score),
            rk as (select *, sum(pos) over o as tp, sum(neg) over o as fp, lead(pos) over o as np, lead(neg) over o as nn
                   from ds window o as (order by score desc))
            select 0.0::double as fpr, 0.0::double as tpr, null::double as threshold
            union all select round(fp / (select sum(neg) from ds), 9), round(tp / (select sum(pos) from ds), 9),
                   round(score, 9) from rk where np is null or np <> pos or nn <> neg""",
        "metric_report": f"""with {FLAGGED}, {PRF.format(source='fl')}, {WEIGHTED.format(source='fl')}, {AUC.format(source='fl')},
            x as (select [('f1', f1), ('precision', p), ('recall', r), ('f1_anomaly', f1), ('precision_anomaly', p),
              ('recall_anomaly', r), ('f1_weighted', wf), ('precision_weighted', wp), ('recall_weighted', wr),
              ('accuracy', (tp + tn) / (tp + tn + fp + fn)), ('auc', round(auc, 9)), ('confusion_tn', tn::double),
              ('confusion_fp', fp::double), ('confusion_fn', fn::double), ('confusion_tp', tp::double),
              ('decision_threshold', 0.5::double)] as m from f, w, au)
            select e[1] as metric, round(e[2], 12) as value from (select unnest(m) as e from x)""",
        "select_threshold": f"""with {ORDERS}, cand as (
              select distinct t from (select unnest([0.3, 0.4, 0.5, 0.6, 0.7]::double[]) as t
                union all select unnest(quantile_cont(score, [{', '.join(_literal(0.02 + i * 0.02) for i in range(49))}]))
                from om) where t between 0 and 1),
            e as (select t, count(*) filter (label = 1 and score >= t) as tp,
                         count(*) filter (label <> 1 and score >= t) as fp, count(*) filter (label = 1) as pos,
                         count(*) as n from cand, om group by t),
            p as (select *, case when tp + fp > 0 then tp / (tp + fp) else 0 end as p,
                         case when pos > 0 then tp / pos else 0 end as r from e),
            f as (select *, case when 4 * p + r > 0 then 5 * p * r / (4 * p + r) else 0 end as f from p)
            select round(t, 6) as decision_threshold, 2.0::double as beta, 0.5::double as min_precision,
                   round(f, 6) as selected_fbeta, round(r, 6) as selected_recall, round(p, 6) as selected_precision,
                   n as threshold_rows from f where p >= 0.5
            order by f desc, r desc, p desc, abs(t - 0.5), t limit 1""",
        "model_comparison": _stand_in_sql(),
        "top_positive_features": f"""with {ORDERS}, {CONTRIBUTIONS}, {TOP}
            select row_id, feature, round(contribution, 9) as contribution, place::int as place from tp""",
        "global_attribution": f"""with {ORDERS}, {CONTRIBUTIONS} select feature, count(*) as n,
            round(avg(abs(contribution)), 6) as mean_abs, round(avg(contribution), 6) as mean,
            round(quantile_cont(abs(contribution), 0.25), 6) as p25, round(quantile_cont(abs(contribution), 0.5), 6) as p50,
            round(quantile_cont(abs(contribution), 0.75), 6) as p75 from fc group by feature""",
        "batch_detect": f"with {DETECTED} select * from bd",
        "detect_summary": f"""with {DETECTED} select count(*) as total, count(*) filter (prediction = 1) as anomalies,
            count(*) filter (prediction <> 1) as normals,
            round(count(*) filter (prediction = 1) / count(*) * 100, 2) as anomaly_rate from bd""",
        "detect_filter": f"with {DETECTED} select row_id, status, risk_score, {LIST} from bd where prediction = 1",
        "anomaly_ids": f"with {DETECTED} select row_id from bd where prediction = 1",
        "lookup_rows": f"""with {DETECTED} select row_id, {LIST} from om
            where row_id in (select row_id from bd where prediction = 1)""",
        "apply_suggestions": f"with {APPLIED} select row_id, {LIST} from ap",
        "verify_repeated_keys": f"""with {ORDERS} select row_id, 2::bigint as n_rows, 2::bigint as n_numbers
            from om where label = 1""",
        "verify_repairs": f"""with {APPLIED}, af as (select row_id, {SCORE} as s from ap)
            select o.row_id, round(o.score, 6) as before_score, round(af.s, 6) as after_score,
                   (o.score >= 0.5)::int as before_pred, (af.s >= 0.5)::int as after_pred,
                   (af.s < 0.5)::int as success from an o join af on af.row_id = o.row_id""",
        "greedy_repair": _repair_sql(3, 9),
        "repair_report_sink": _changes_sql(3, 9),
        "clip_bounds": f"""with {ORDERS} select row_id,
            least(greatest(o_totalprice, 20000.0::double), 300000.0::double) as o_totalprice,
            greatest(c_acctbal, 0.0::double) as c_acctbal from om""",
        "cast_like": f"""with {ORDERS} select row_id, round_even(o_totalprice / 20000, 0)::int as as_integer,
            round_even(c_nationkey / 2.0::double, 0)::int as as_even,
            case when o_orderpriority in ('1-URGENT', '2-HIGH') then o_orderpriority else c_mktsegment end as in_domain,
            coalesce(nullif(o_orderstatus, 'P'), 'kept') as filled from om""",
        "repair_status": f"""with {_OUTCOMES} select row_id, case when pred = 0 then 'already_normal'
            when after_pred = 0 then 'repaired' when dry then 'anomaly_detected'
            when after < score then 'partially_repaired' else 'not_repaired' end as status from oo""",
        "repair_summary": f"""with {_OUTCOMES} select case when pred = 0 then 'already_normal'
            when after_pred = 0 then 'repaired' when after < score then 'partially_repaired'
            else 'not_repaired' end as status, count(*) as n, sum((after < score)::int)::bigint as changes,
            round(avg(score - after), 6) as mean_reduction from oo group by 1""",
        "latest_per_key": f"""with {EVENTS} select id, seq, status, payload from ev
            qualify row_number() over (partition by id order by updated desc, seq desc) = 1""",
        "upsert_latest": f"""with {EVENTS} select id, seq, status, payload from ev
            qualify row_number() over (partition by id order by updated desc, seq desc) = 1""",
        "keep_recent_n": f"""with {EVENTS}, l as (select * from ev
            qualify row_number() over (partition by id order by updated desc, seq desc) = 1)
            select id, seq, status from l order by updated desc, id desc limit 50""",
        "lookup_by_key": f"with {EVENTS} select id, seq, status, payload from ev where id = 8",
        "recent_n": f"with {EVENTS} select id, seq, status from ev order by updated desc, seq desc limit 20",
        "parse_payload": f"""with {EVENTS} select seq, (payload::json ->> 'k')::bigint as k,
            '{{"k":' || (payload::json ->> 'k') || '}}' as rendered from ev""",
        "epoch_ms": f"""with {EVENTS}, m as (
            select seq, coalesce(epoch_us(case when status <> 'error' then updated end) // 1000, 0) as ended_ms from ev)
            select seq, ended_ms, case when ended_ms > 0 then strftime(make_timestamp(ended_ms * 1000), '%Y-%m-%dT%H:%M:%S.%g') end
              as restored from m""",
    }
    return sql
