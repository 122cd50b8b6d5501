"""SQL twins of the catalog for DuckDB.

Named views are shared; a query pulls in the ones it needs, in order. Where it
is easy the SQL takes another road than the Spark job: dense grids instead of
gap expansion, pair sums instead of vectors, lag joins instead of arrays.
"""

from __future__ import annotations

import re

from basketlab.operators.facts import HEALTH_FIELDS, INSTANT, LINE_ITEMS, MERGED_BY_MAX, PER_SHARE, RATIOS
from basketlab.operators.forward import ARM_LABELS
from basketlab.operators.scoring import FACTORS, SECTOR_NEUTRAL, STRENGTH_LABELS
from basketlab.params import COVARIANCE_DAYS, COVARIANCE_ROWS, COVARIANCE_YEARS
from basketlab.params import WEEKLY_BARS as P
from basketlab.plans.catalog import STALE_DAYS, SWEEP, WHOLE

TD = P.trading_days
VIEWS: dict[str, str] = {}
SQL: dict[str, str] = {}


def r(expr: str, digits: int = 6) -> str:
    # prices are cents over shares and can end in an exact half: both sides nudge
    nudge = " + 1e-9" if digits == 6 else ""
    return f"(round({expr}{nudge}, {digits}) + 0.0)"


def even(expr: str, digits: int) -> str:
    return f"(round_even(round({expr}, {digits + 6}), {digits}) + 0.0)"


def day(expr: str) -> str:
    return f"cast({expr} as varchar)"


def flag(expr: str) -> str:
    return f"coalesce({expr}, false)"


def values(rows) -> str:
    def lit(v):
        if isinstance(v, bool):
            return "true" if v else "false"
        return f"'{v}'" if isinstance(v, str) else str(v)

    return ", ".join("(" + ", ".join(lit(v) for v in row) + ")" for row in rows)


def resolve(body: str) -> str:
    """Prepends every view the body mentions, dependencies first."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in VIEWS:
            if name not in order and re.search(rf"\b{name}\b", text):
                visit_name(name)

    def visit_name(name: str) -> None:
        if name in order:
            return
        for other in VIEWS:
            if other != name and re.search(rf"\b{other}\b", VIEWS[name]):
                visit_name(other)
        order.append(name)

    visit(body)
    if not order:
        return body
    ctes = ",\n".join(f"{n} as ({VIEWS[n]})" for n in order)
    if body.lstrip().lower().startswith("with "):
        return f"with {ctes},\n{body.lstrip()[5:]}"
    return f"with {ctes}\n{body}"


# --- landed data ----------------------------------------------------------------------

VIEWS["v_sec"] = """
select cast(s_suppkey as varchar) as security, s_name as name,
       case when n_regionkey = 3 then 'Unknown' else r_name end as sector,
       n_name as sub_industry, s_acctbal as balance
from supplier join nation on s_nationkey = n_nationkey
join region on n_regionkey = r_regionkey"""

VIEWS["v_bars"] = """
select cast(l_suppkey as varchar) as security,
       cast(date_trunc('week', l_shipdate) as date) as date,
       sum(l_extendedprice) / sum(l_quantity) as close, sum(l_quantity) as volume
from lineitem group by 1, 2"""

VIEWS["v_cal"] = """
select date, row_number() over (order by date) - 1 as t, count(*) over () as n
from (select distinct date from v_bars)"""

VIEWS["v_grid"] = """
select s.security, c.date, c.t, b.close, b.volume
from (select distinct security from v_bars) s cross join v_cal c
left join v_bars b on b.security = s.security and b.date = c.date"""

VIEWS["v_filled"] = """
select *, last_value(close ignore nulls) over (partition by security order by date) as filled
from v_grid"""

VIEWS["v_ret"] = """
select * from (
  select security, date, t,
         close / lag(close) over (partition by security order by date) - 1 as ret
  from v_grid) where ret is not null"""

VIEWS["v_cret"] = "select security, date, t, greatest(least(ret, 0.5), -0.5) as ret from v_ret"

VIEWS["v_bench"] = "select date, avg(ret) as bench from v_cret group by date"

VIEWS["v_rf"] = """
select cast(o_orderdate as date) as date, avg(o_totalprice) / 1e7 as rf_annual
from orders group by 1"""

VIEWS["v_rfcal"] = f"""
select c.date, coalesce(f.rf_annual, {P.risk_free}) as rf_annual
from v_cal c asof left join v_rf f on c.date >= f.date"""

VIEWS["v_marks"] = """
select cast(ts as date) as date,
       case when event_type in ('click', 'signup') then 'qubo_classical'
            when event_type = 'purchase' then 'qubo_quantum' else 'greedy' end as arm,
       (avg(value) - 50.0) / 5000.0 as ret
from events group by 1, 2"""

VIEWS["v_gauges"] = """
select case l_returnflag when 'A' then 'S&P 500' when 'N' then 'Nasdaq Composite'
            else 'VIX' end as gauge,
       cast(date_trunc('week', l_shipdate) as date) as date,
       avg(l_extendedprice) / case when l_returnflag in ('A', 'N') then 10.0 else 2000.0 end as close
from lineitem group by l_returnflag, 2"""

# --- facts ----------------------------------------------------------------------------

_LINES = [
    (1, "us-gaap", "Revenues", "USD", False, 1.0, "all"),
    (2, "us-gaap", "SalesRevenueNet", "USD", False, 1.0, "all"),
    (3, "us-gaap", "NetIncomeLoss", "USD", False, 0.1, "all"),
    (3, "us-gaap", "EarningsPerShareDiluted", "USD/shares", False, 0.0001, "all"),
    (3, "us-gaap", "CommonStockDividendsPerShareDeclared", "USD/shares", False, 0.00002, "third0"),
    (4, "us-gaap", "StockholdersEquity", "USD", True, 0.5, "all"),
    (4, "us-gaap", "LongTermDebt", "USD", True, 0.2, "odd"),
    (5, "us-gaap", "OperatingIncomeLoss", "USD", False, 0.2, "all"),
    (5, "us-gaap", "GrossProfit", "USD", False, 0.35, "third1"),
    (5, "us-gaap", "CostOfRevenue", "USD", False, 0.6, "third2"),
    (6, "us-gaap", "NetCashProvidedByUsedInOperatingActivities", "USD", False, 0.3, "all"),
    (7, "us-gaap", "PaymentsToAcquirePropertyPlantAndEquipment", "USD", False, 0.1, "before"),
    (7, "us-gaap", "PaymentsToAcquireProductiveAssets", "USD", False, 0.1, "after"),
    (7, "dei", "EntityCommonStockSharesOutstanding", "shares", True, 0.01, "all"),
]
VIEWS["v_lines"] = f"""
select * from (values {values(_LINES)}) as x(ln, taxonomy, concept, unit, inst, scale, cond)"""

VIEWS["v_facts"] = """
select cast(l_suppkey as varchar) as entity, taxonomy, concept, unit,
       case when not inst then make_date(year(l_shipdate), 12, 31)
            - cast(300 + 3 * l_quantity as integer) end as "start",
       make_date(year(l_shipdate), 12, 31) as "end",
       l_extendedprice * cast(scale as double) as val,
       cast(l_shipdate as date) as filed,
       case when l_linestatus = 'F' then '10-K' else '10-Q' end as form,
       l_orderkey, l_linenumber, l_partkey, l_quantity
from lineitem join v_lines on l_linenumber = ln
where case cond when 'all' then true when 'third0' then l_suppkey % 3 = 0
      when 'third1' then l_suppkey % 3 = 1 when 'third2' then l_suppkey % 3 = 2
      when 'odd' then l_suppkey % 2 = 1 when 'before' then year(l_shipdate) < 1999
      else year(l_shipdate) >= 1998 end"""

_ITEMS = [
    (c, item, i, "USD/shares" if item in PER_SHARE else "USD", item in INSTANT, item in MERGED_BY_MAX)
    for item, concepts in LINE_ITEMS.items() for i, c in enumerate(concepts)
]
VIEWS["v_items"] = f"""
select * from (values {values(_ITEMS)}) as x(concept, item, priority, unit, instant, merged)"""

_ANNUAL = """
select f.*, i.item, i.priority, i.merged
from {facts} f join v_items i on f.concept = i.concept and f.unit = i.unit
where f.taxonomy = 'us-gaap' and f.form like '10-K%'
  and (i.instant or date_diff('day', f."start", f."end") between 330 and 400)"""
_CSERIES = """
select entity, item, concept, priority, merged, "end", val from {annual}
qualify row_number() over (partition by entity, item, concept, "end"
  order by filed desc, l_orderkey desc, l_linenumber desc, l_partkey desc, l_quantity desc) = 1"""
_SERIES = """
select entity, item, "end", max(val) as val from (
  select *, min(priority) over (partition by entity, item) as best from {cseries})
where merged or priority = best group by 1, 2, 3"""
_WIDE = """
select entity, "end", """ + ", ".join(
    f"max(val) filter (where item = '{i}') as {i}" for i in LINE_ITEMS
) + " from {series} group by 1, 2"
_ANCH = """
select *, max("end") filter (where revenue is not null) over (partition by entity) as rev_end,
       count(revenue) over (partition by entity) as rev_n,
       case when cfo is not null and capex is not null then
         count(*) filter (where cfo is not null and capex is not null)
           over (partition by entity order by "end" desc) end as fcf_rank
from {wide}"""
_GROWTH = """
select a.entity, max(a.rev_end) as rev_end, max(a.rev_n) as rev_n,
       max(a.revenue) filter (where a."end" = a.rev_end) as rev_last,
       max(x.end_a) as anchor_end, max(x.val_a) as anchor_val
from {anch} a left join (
  select entity, "end" as end_a, revenue as val_a from {anch}
  where revenue is not null and "end" < rev_end
  qualify row_number() over (partition by entity
    order by abs(date_diff('day', rev_end - 1096, "end")), "end", revenue) = 1) x
  on a.entity = x.entity
group by a.entity"""
_CAGR = """
select *, case when rev_n >= 3 and rev_last > 0 and anchor_val > 0 then
    case when g <= 10.0 then g end end as growth
from (select *, power(rev_last / anchor_val,
        365.25 / date_diff('day', anchor_end, rev_end)) - 1 as g from {growth})"""
_FCF = """
select entity, avg(cfo - capex) as avg_fcf,
       avg(cfo - capex) filter (where revenue > 0) as margin_fcf,
       avg(revenue) filter (where revenue > 0) as margin_rev, count(*) as fcf_years
from {anch} where fcf_rank <= 3 group by entity"""
_SHARES = """
select entity, val as shares from {facts}
where taxonomy = 'dei' and concept = 'EntityCommonStockSharesOutstanding'
qualify row_number() over (partition by entity order by "end" desc, val desc) = 1"""
_LATEST = "select entity, " + ", ".join(
    f"arg_max({i}, \"end\") filter (where {i} is not null) as {i}"
    for i in LINE_ITEMS if i not in ("cfo", "capex")
) + " from {wide} group by entity"


def gate(num: str, den: str, cap: float = 1.005) -> str:
    m = f"(({num}) / nullif({den}, 0))"
    return f"case when {m} <= {cap} then {m} end"


_RATIOS = """
select security, price, price / eps as "peRatio", dps / nullif(price, 0) as "dividendYield",
  """ + gate("coalesce(gross_profit, revenue - cost_of_revenue)", "revenue") + """ as "grossMargin",
  """ + gate("operating_income", "revenue") + """ as "operatingMargin",
  """ + gate("net_income", "revenue") + """ as "netMargin",
  net_income / equity as "returnOnEquity",
  """ + gate("margin_fcf", "margin_rev") + """ as "fcfMargin",
  avg_fcf / nullif(cap, 0) as "fcfYield", growth as "revenueGrowth",
  lt_debt / equity as "debtToEquity", cap as "marketCap"
from (
  select *, price * coalesce(case when net_income > 0 then net_income / eps end, nullif(shares, 0)) as cap
  from (
    select p.security, p.price,
      case when l.revenue > 0 then l.revenue end as revenue, l.net_income, l.gross_profit,
      l.cost_of_revenue, l.operating_income,
      case when l.equity > 0 then l.equity end as equity,
      case when l.eps > 0 then l.eps end as eps, l.dps, l.lt_debt,
      c.growth, f.avg_fcf, f.margin_fcf, f.margin_rev, s.shares
    from v_surv p left join {latest} l on p.security = l.entity
    left join {cagr} c on p.security = c.entity
    left join {fcf} f on p.security = f.entity
    left join {shares} s on p.security = s.entity))"""


def fact_views(prefix: str, facts: str) -> None:
    """The chain from facts to ratios under names starting with `prefix`."""
    names = {
        "annual": _ANNUAL, "cseries": _CSERIES, "series": _SERIES, "wide": _WIDE,
        "anch": _ANCH, "growth": _GROWTH, "cagr": _CAGR, "fcf": _FCF, "shares": _SHARES,
        "latest": _LATEST, "ratios": _RATIOS,
    }
    full = {k: f"{prefix}{k}" for k in names} | {"series": f"{prefix}years"}
    for k, text in names.items():
        for other, view in full.items():
            text = text.replace("{" + other + "}", view)
        VIEWS[full[k]] = text.replace("{facts}", facts)


# --- prices and screen ------------------------------------------------------------------

def _trailing(positive: bool) -> str:
    cols = []
    for name, k in P.return_windows:
        base = f"max(case when t = n - 1 - {k} then filled end)"
        if positive:
            base = f"case when {base} > 0 then {base} end"
        cols.append(f"case when max(n) > {k} then max(case when t = n - 1 then filled end) / nullif({base}, 0) - 1 end as \"{name}\"")
    return (
        "select security, max(case when t = n - 1 then filled end) as price, "
        + ", ".join(cols)
        + " from (select f.*, c.n from v_filled f join v_cal c on f.date = c.date) group by security"
    )


VIEWS["v_trail"] = _trailing(False)
VIEWS["v_screened"] = f"""
select *, case when n_obs < {P.min_history_rows} then 'insufficientHistory'
     when avg_volume < {P.volume_floor} then 'lowLiquidity'
     when last_price < {P.min_price} then 'lowPrice' end as reason
from (select security, count(close) as n_obs, avg(volume) as avg_volume,
             arg_max(close, date) as last_price from v_bars group by security)"""
VIEWS["v_surv"] = "select security, last_price as price from v_screened where reason is null"

fact_views("v_", "v_facts")

_HEALTH = "coalesce(" + ", ".join(f'"{h}"' for h in HEALTH_FIELDS) + ")"
VIEWS["v_names"] = f"""
select q.*, {", ".join('t."' + n + '"' for n, _ in P.return_windows)}, s.name,
       coalesce(s.sector, 'Unknown') as sector, s.sub_industry
from v_ratios q left join v_trail t on q.security = t.security
left join v_sec s on q.security = s.security
where {_HEALTH} is not null"""

# --- scores -------------------------------------------------------------------------------

_OBS = []
for _pillar, _members in FACTORS.items():
    for _f, _d in _members.items():
        _v = 'case when "peRatio" > 0 then "peRatio" end' if _f == "peRatio" else f'"{_f}"'
        _OBS.append(
            f"select security, sector, '{_pillar}' as pillar, '{_f}' as factor, '{_d}' as direction, "
            f"{'true' if _pillar in SECTOR_NEUTRAL else 'false'} as neutral, {_v} as value from v_names"
        )
VIEWS["v_obs"] = "select * from (" + " union all ".join(_OBS) + ") where value is not null"
VIEWS["v_ranked"] = f"""
select *, case when direction = 'lower' then 100 - uni else uni end as pctl_universe,
  case when use_sector then case when direction = 'lower' then 100 - sec else sec end
       else case when direction = 'lower' then 100 - uni else uni end end as pctl
from (
  select *, neutral and sector <> 'Unknown' and n_sec >= {P.sector_min_count} as use_sector,
    100.0 * (r_uni - 1 + (ties_uni + 1) / 2.0) / n_uni as uni,
    100.0 * (r_sec - 1 + (ties_sec + 1) / 2.0) / n_sec as sec
  from (
    select *, rank() over (partition by factor order by value) as r_uni,
      count(*) over (partition by factor, value) as ties_uni,
      count(*) over (partition by factor) as n_uni,
      rank() over (partition by factor, sector order by value) as r_sec,
      count(*) over (partition by factor, sector, value) as ties_sec,
      count(*) over (partition by factor, sector) as n_sec
    from v_obs))"""
VIEWS["v_pillars"] = "select n.security, " + ", ".join(
    f"coalesce(50 + (avg(pctl) filter (where pillar = '{p}') - 50) "
    f"* (count(pctl) filter (where pillar = '{p}') / {float(len(m))}), 50.0) as {p}"
    for p, m in FACTORS.items()
) + " from v_names n left join v_ranked r on n.security = r.security group by n.security"
_WIDE_PCTL = ", ".join(
    f"{even(f'''max(pctl) filter (where factor = '{f}')''', 1)} as \"{f}_pctl\", "
    f"coalesce(bool_or(use_sector) filter (where factor = '{f}'), false) as \"{f}_sectorRanked\""
    for m in FACTORS.values() for f in m
)
VIEWS["v_pctls"] = f"select security, {_WIDE_PCTL} from v_ranked group by security"
VIEWS["v_scores"] = f"""
select security, {even('health', 2)} as "healthScore", {even('valuation', 2)} as "valuationScore",
  {even('momentum', 2)} as "momentumScore",
  {even(f'{P.weight_health} * health + {P.weight_valuation} * valuation + {P.weight_momentum} * momentum', 2)} as score
from v_pillars"""
VIEWS["v_med"] = """
select sector, median("peRatio") as pe_median, count("peRatio") as n
from v_names where "peRatio" is not null group by sector"""
VIEWS["v_scored"] = """
select n.*, s."healthScore", s."valuationScore", s."momentumScore", s.score,
       p.* exclude (security), m.pe_median
from v_names n join v_scores s on n.security = s.security
left join v_pctls p on n.security = p.security left join v_med m on n.sector = m.sector"""
VIEWS["v_best"] = """
select *, row_number() over (order by score desc, security) as pos from v_scored"""
VIEWS["v_pool"] = f"select * from v_best where pos <= {P.pool_size}"

_STRONG = " union all ".join(
    f"select security, \"{f}_pctl\" as p, '{label} of ' || printf('%.1f', \"{f}\" * 100.0) || '% — ' || "
    f"case when \"{f}_pctl\" >= 99.5 then 'the highest in ' else 'top ' || "
    f"cast(cast(greatest(1, round_even(round(100 - \"{f}_pctl\", 6), 0)) as bigint) as varchar) || '% of ' end || "
    f"case when \"{f}_sectorRanked\" then 'its sector' else 'the universe' end as txt "
    f"from v_scored where \"{f}_pctl\" >= 80 and \"{f}\" is not null"
    for f, label in STRENGTH_LABELS.items()
)
VIEWS["v_strong"] = f"""
select security, p, txt, row_number() over (partition by security order by p desc, txt desc) as place
from ({_STRONG}) qualify place <= 4"""
_REL = '("peRatio" / nullif(case when pe_median > 0 then pe_median end, 0) - 1)'
VIEWS["v_said"] = f"""
select security,
  coalesce(nullif(concat_ws(' | ', strong, low_debt, cheap), ''),
    'Balanced profile — no single standout factor, ranks on consistency') as reasons,
  concat_ws(' | ', premium, no_earnings, burning, levered, declining) as flags
from (
  select b.security, x.strong,
    case when "debtToEquity_pctl" >= 80 and "debtToEquity" is not null
      then 'Low leverage — debt/equity of ' || printf('%.2f', "debtToEquity") end as low_debt,
    case when {_REL} <= -0.15 then 'Trades at a ' || printf('%.0f', abs({_REL}) * 100) ||
      '% discount to its sector (P/E ' || printf('%.1f', "peRatio") || ' vs ' ||
      printf('%.1f', pe_median) || ' median)' end as cheap,
    case when {_REL} >= 0.25 then 'Premium valuation — P/E ' || printf('%.1f', "peRatio") ||
      ' vs sector median ' || printf('%.1f', pe_median) end as premium,
    case when "peRatio" is null then
      'No positive earnings (P/E not meaningful) — valuation rests on growth' end as no_earnings,
    case when "fcfMargin" < 0 then 'Currently free-cash-flow negative' end as burning,
    case when "debtToEquity" > 2 then 'Elevated leverage — debt/equity ' || printf('%.1f', "debtToEquity") end as levered,
    case when "revenueGrowth" < 0 then 'Revenue declining — ' || printf('%.0f', abs("revenueGrowth") * 100) ||
      '%/yr over ~3 years' end as declining
  from v_scored b left join (
    select security, string_agg(txt, ' | ' order by place) as strong from v_strong group by security) x
  on b.security = x.security)"""


# --- portfolios --------------------------------------------------------------------------

def capped(source: str, key: str, score: str = "score", cap: float = P.max_weight) -> str:
    """Closed form over the whole portfolio."""
    return f"""
select * exclude (s_, k_, above_, total_, m_, lam_k, lam),
  case when s_ <= 0 then 0.0 when m_ * {cap} <= 1 + 1e-12 then 1.0 / m_
       else least({cap}, lam * s_) end as weight
from (
  select *, min_by(lam_k, k_) filter (where s_ > 0 and lam_k * s_ <= {cap} + 1e-12)
              over (partition by {key}) as lam
  from (
    select *, (1 - (k_ - 1) * {cap}) / nullif(total_ - above_, 0) as lam_k
    from (
      select *, coalesce(sum(s_) over (partition by {key} order by s_ desc, security
                  rows between unbounded preceding and 1 preceding), 0) as above_
      from (
        select *, row_number() over (partition by {key} order by s_ desc, security) as k_,
               sum(s_) over (partition by {key}) as total_,
               count(*) filter (where s_ > 0) over (partition by {key}) as m_
        from (select *, coalesce(greatest({score}, 0), 0) as s_ from {source})))))"""


VIEWS["v_hold"] = "select sector as portfolio, security, balance as score from v_sec"
VIEWS["v_book"] = capped("v_hold", "portfolio")


def returns_of(weights: str) -> str:
    return f"""
select p.portfolio, c.date, coalesce(x.ret, 0.0) as ret
from (select distinct portfolio from {weights}) p cross join v_cal c
left join (select w.portfolio, q.date, sum(w.weight * q.ret) as ret
  from {weights} w join v_cret q on w.security = q.security group by 1, 2) x
on p.portfolio = x.portfolio and c.date = x.date"""


VIEWS["v_pret"] = returns_of("v_book")
VIEWS["v_series"] = f"""
select r.portfolio, r.date, r.ret, b.bench, f.rf_annual, f.rf_annual / {TD} as rf
from v_pret r left join v_bench b on r.date = b.date join v_rfcal f on r.date = f.date"""
VIEWS["v_al"] = "select *, ret - bench as active from v_series where bench is not null"


def draw(*parts: str) -> str:
    text = " || '|' || ".join(f"cast({p} as varchar)" for p in parts)
    return f"cast(concat('0x', substr(md5({text}), 1, 8)) as bigint)"


VIEWS["v_cand"] = f"""
select 'top' as basket, security from v_pool where pos <= {P.basket_size}
union all
select 'sector', security from (
  select security, row_number() over (partition by sector order by pos) as k,
         (select count(distinct sector) from v_pool) as ns from v_pool)
where k <= ceil({float(P.basket_size)} / ns)
union all
select 'mix' || cast(rep as varchar), security from (
  select rep, security, row_number() over (partition by rep order by {draw('rep', 'pos', chr(39) + 'basket' + chr(39))}, pos) as k
  from v_pool cross join (select unnest(range(1, 21)) as rep))
where k <= {P.basket_size}"""
VIEWS["v_topped"] = f"select 'greedy' as portfolio, security, score from v_best where pos <= {P.top_n}"
VIEWS["v_topfund"] = capped("v_topped", "portfolio")
VIEWS["v_stocks"] = f"""
select b.*, a.fw as "fundWeight" from v_best b left join (
  select security, {r('weight', 5)} as fw from v_topfund) a
on b.security = a.security where b.pos <= {P.top_n}"""

# --- covariance panel --------------------------------------------------------------------

COV_WINDOW = COVARIANCE_ROWS * COVARIANCE_YEARS
VIEWS["v_lbars"] = f"""
select cast(l_suppkey as varchar) as security,
       date '1970-01-01' + cast(floor(date_diff('day', date '1970-01-01', cast(l_shipdate as date)) / {float(COVARIANCE_DAYS)}) * {COVARIANCE_DAYS} as integer) as date,
       sum(l_extendedprice) / sum(l_quantity) as close
from lineitem group by 1, 2"""
VIEWS["v_lcal"] = """
select date, row_number() over (order by date) - 1 as t, count(*) over () as n
from (select distinct date from v_lbars)"""
VIEWS["v_panel"] = """
select security, date, close from v_lbars where security in (select security from v_pool)"""
VIEWS["v_pdense"] = """
select s.security, c.date, p.close from (select security from v_pool) s
cross join v_lcal c left join v_panel p on p.security = s.security and p.date = c.date"""
VIEWS["v_paneltail"] = f"""
select security, date, greatest(least(ret, 0.5), -0.5) as ret from (
  select security, date, close / lag(close) over (partition by security order by date) - 1 as ret
  from v_pdense)
where ret is not null and date in (select date from v_lcal where t >= n - {COV_WINDOW})"""
VIEWS["v_pkept"] = f"""
select security from v_paneltail group by security
having count(ret) / cast(least({COV_WINDOW}, (select max(n) from v_lcal)) as double) >= {P.min_coverage}"""
VIEWS["v_prows"] = """
select security, date, ret from v_paneltail
where security in (select security from v_pkept)
  and date in (select date from v_paneltail where security in (select security from v_pkept)
    group by date having count(*) = (select count(*) from v_pkept))"""
_Q = 0.5 ** (1.0 / P.ewma_halflife)
VIEWS["v_pdates"] = f"""
select date, k, n, wr / sum(wr) over () as w from (
  select date, row_number() over (order by date) - 1 as k, count(*) over () as n,
         power({_Q!r}, count(*) over () - row_number() over (order by date)) as wr
  from (select distinct date from v_prows))"""
_PAIRS = """
from v_prows a join v_prows b on a.date = b.date join v_pdates d on a.date = d.date
join v_pool pa on a.security = pa.security join v_pool pb on b.security = pb.security
where pa.pos <= pb.pos and d.n >= 60 group by pa.pos, pb.pos, a.security, b.security"""
_IJ = "select pa.pos as i, pb.pos as j, a.security as security_i, b.security as security_j, "
VIEWS["v_covs"] = _IJ + "covar_samp(a.ret, b.ret) as c " + _PAIRS
VIEWS["v_cove"] = _IJ + "sum(d.w * a.ret * b.ret) - sum(d.w * a.ret) * sum(d.w * b.ret) as c " + _PAIRS
VIEWS["v_covp"] = _IJ + "covar_pop(a.ret, b.ret) as c " + _PAIRS
VIEWS["v_lw"] = """
select case when least(beta, delta) = 0 then 0 else least(beta, delta) / delta end as shrink, mu
from (
  select mu, (norm2 - 2 * mu * trace + p * mu * mu) / p as delta,
         (fourth / n - norm2) / (p * n) as beta
  from (
    select sum(case when i = j then c * c else 2 * c * c end) as norm2,
           sum(c) filter (where i = j) as trace,
           (select count(*) from v_pkept) as p, (select max(n) from v_pdates) as n,
           sum(c) filter (where i = j) / (select count(*) from v_pkept) as mu
    from v_covp) a,
  (select sum(q * q) as fourth from (
    select date, sum((ret - m) * (ret - m)) as q from (
      select *, avg(ret) over (partition by security) as m from v_prows) group by date)) b)"""
VIEWS["v_covl"] = """
select i, j, security_i, security_j,
  (1 - shrink) * c + case when i = j then shrink * mu else 0 end as c from v_covp, v_lw"""
VIEWS["v_terms"] = f"""
select i, j, security_i, security_j,
  case when i = j then -{P.l1} * greatest(a.score, 0) / 100 + {P.l2} * c / m + {P.l3} * (1 - 2.0 * {P.basket_size})
       else 2 * {P.l2} * c / m + 2 * {P.l3} + case when a.sector = b.sector then {P.l4} else 0 end end as coef
from v_cove join v_pool a on security_i = a.security join v_pool b on security_j = b.security,
(select max(abs(c)) as m from v_cove)"""
VIEWS["v_parts"] = f"""
select x.basket, x.size, x.quality, coalesce(y.risk, 0) as risk,
  x.size * x.size - 2.0 * {P.basket_size} * x.size as size_term, coalesce(y.same, 0) as same_sector
from (select basket, count(*) as size, sum(greatest(p.score, 0) / 100) as quality
  from v_cand c join v_pool p on c.security = p.security
  where c.security in (select security from v_pkept) group by basket) x
left join (
  select a.basket, sum(case when i = j then c / m else 2 * c / m end) as risk,
    count(*) filter (where i <> j and pa.sector = pb.sector) as same
  from v_cand a join v_cove on a.security = security_i
  join v_cand b on a.basket = b.basket and b.security = security_j
  join v_pool pa on pa.security = security_i join v_pool pb on pb.security = security_j,
  (select max(abs(c)) as m from v_cove) group by a.basket) y on x.basket = y.basket"""
VIEWS["v_selected"] = f"""
select security, score from v_pool where pos <= {P.basket_size}"""


def schemes_of(name: str, source: str) -> None:
    """Views `name`_1, _2 and `name`: weights of `source` (tag, security, score), whose
    schemes are called by the tag and their kind."""
    VIEWS[f"{name}_in1"] = f"select tag || 'score_capped' as scheme, security, score from {source}"
    VIEWS[f"{name}_in2"] = f"""
select tag || 'inverse_vol' as scheme, s.security, s.score, 1 / sqrt(c.c) as inv_vol
from {source} s left join v_cove c on c.i = c.j and c.security_i = s.security"""
    VIEWS[f"{name}_1"] = capped(f"{name}_in1", "scheme")
    VIEWS[f"{name}_2"] = capped(f"{name}_in2", "scheme", "inv_vol")
    VIEWS[name] = f"""
select scheme, security, score, weight from {name}_1
union all select scheme, security, score, weight from {name}_2
union all select tag || 'equal', security, score, 1.0 / count(*) over (partition by tag) from {source}"""
    VIEWS[f"{name}_rep"] = f"""
select x.*, y.wcw, {P.l2} * y.wcw / m - {P.l1} * quality as objective,
  names * {P.max_weight} >= 1 - 1e-12 and names = covered and abs(total - 1) <= 1e-8
    and maxw <= {P.max_weight} + 1e-9 as feasible
from (select scheme, count(*) as names,
    count(*) filter (where security in (select security from v_pkept)) as covered, sum(weight) as total, max(weight) as maxw,
    count(*) filter (where weight >= {P.max_weight} - 1e-9) as at_cap,
    1 / sum(weight * weight) as eff, sum(weight * greatest(score, 0) / 100) as quality
  from {name} group by scheme) x
left join (select a.scheme, sum(case when i = j then 1 else 2 end * a.weight * b.weight * c) as wcw
  from {name} a join v_cove on a.security = security_i
  join {name} b on a.scheme = b.scheme and b.security = security_j group by a.scheme) y
on x.scheme = y.scheme, (select max(abs(c)) as m from v_cove)"""


def energy(l1, l2, l3, l4) -> str:
    return f"(-{l1} * quality + {l2} * risk + {l3} * size_term + {l4} * same_sector)"


VIEWS["v_plain"] = "select '' as tag, security, score from v_selected"
schemes_of("v_schemes", "v_plain")
VIEWS["v_winner"] = f"""
select arm, arg_min(basket, row(e, basket)) as basket, min(e) as e, stddev_pop(raw) as spread, count(*) as reads
from (select basket, {energy(P.l1, P.l2, P.l3, P.l4)} as raw, round({energy(P.l1, P.l2, P.l3, P.l4)}, 9) as e,
    case when basket like 'mix%' and cast(replace(basket, 'mix', '0') as integer) > 10
      then 'qubo_quantum' else 'qubo_classical' end as arm from v_parts
  where basket in ('top', 'sector') or basket like 'mix%') group by arm"""
VIEWS["v_chosen"] = """
select x.arm, p.security, p.sector, p.score, x.arm || '|' as tag
from (select 'greedy' as arm, security from v_cand where basket = 'top'
  union all select w.arm, c.security from v_winner w join v_cand c on w.basket = c.basket) x
join v_pool p on x.security = p.security"""
schemes_of("v_asch", "v_chosen")
VIEWS["v_choice"] = """
select arm, coalesce(best, 'score_capped') as scheme, best is not null as found
from (select split_part(scheme, '|', 1) as arm,
    arg_min(split_part(scheme, '|', 2), row(round(objective, 9), split_part(scheme, '|', 2))) filter (where feasible) as best
  from v_asch_rep group by 1)"""
VIEWS["v_arms"] = """
select c.arm as portfolio, c.security, c.sector, c.score, w.weight
from v_chosen c join v_choice h on c.arm = h.arm join v_asch w on w.security = c.security
  and w.scheme = c.arm || '|' || case when c.arm = 'greedy' then 'score_capped' else h.scheme end"""

# --- forward record -----------------------------------------------------------------------

VIEWS["v_rfmap"] = f"""
select d.date, coalesce(f.rf_annual, {P.risk_free}) / {TD} as rf
from (select distinct date from v_marks) d
asof left join (select cast(date + interval 25 year as date) as date, rf_annual from v_rf) f
on d.date >= f.date"""
VIEWS["v_rffill"] = """
select d.date, coalesce(m.rf, (select avg(rf) from v_rfmap)) as rf
from (select distinct date from v_marks) d left join v_rfmap m on d.date = m.date"""
VIEWS["v_aligned_marks"] = """
select * from v_marks where date in (
  select date from v_marks where ret is not null group by date
  having count(*) = (select count(distinct arm) from v_marks))"""
VIEWS["v_fwd"] = """
select a.arm, a.date, a.ret, b.ret as base, a.ret - b.ret as active, f.rf
from v_aligned_marks a join v_aligned_marks b on a.date = b.date and b.arm = 'greedy'
join v_rffill f on a.date = f.date where a.arm <> 'greedy'"""


def phi(z: str) -> str:
    t = f"(1 / (1 + 0.3275911 * abs({z}) / sqrt(2)))"
    poly = (
        f"{t} * (0.254829592 + {t} * (-0.284496736 + {t} * (1.421413741 + {t} * "
        f"(-1.453152027 + {t} * 1.061405429))))"
    )
    erf = f"(1 - {poly} * exp(-({z}) * ({z}) / 2))"
    return f"case when {z} >= 0 then (1 + {erf}) / 2 else (1 - {erf}) / 2 end"


def moments(x: str, keys: str, source: str) -> str:
    return f"""
select {keys}, n, sr, case when den > 0 then sr * sqrt(n - 1) / sqrt(den) end as z
from (select *, 1 - g3 * sr + (g4 - 1) / 4 * sr * sr as den from (
  select {keys}, count(*) as n, avg(x) / nullif(stddev_samp(x), 0) as sr,
    avg(power(x - m, 3)) / power(avg(power(x - m, 2)), 1.5) as g3,
    avg(power(x - m, 4)) / power(avg(power(x - m, 2)), 2) as g4
  from (select {keys}, {x} as x, avg({x}) over (partition by {keys}) as m from {source})
  group by {keys}))"""


def drawdowns(keys: str, ret: str, source: str) -> str:
    return f"""
select *, curve / max(curve) over (partition by {keys} order by date
  rows unbounded preceding) - 1 as dd
from (select *, product(1 + {ret}) over (partition by {keys} order by date
  rows unbounded preceding) as curve from {source})"""


def hac_mean(keys: str, value: str, source: str) -> str:
    """One row per group: n, mean and the t-statistic by a lag self-join."""
    on = " and ".join(f"a.{k.strip()} = b.{k.strip()}" for k in keys.split(","))
    ak = ", ".join(f"a.{k.strip()}" for k in keys.split(","))
    return f"""
select {keys}, n, case when n >= 3 and var > 0 then mean / sqrt(var / n) end as t_stat
from (
  select {ak}, max(a.n) as n, max(a.mean) as mean,
    sum(case when a.i = b.i then 1 else 2 * (1 - (a.i - b.i) / (a.lags + 1.0)) end * a.x * b.x)
      / max(a.n) as var
  from ({_hac_rows(keys, value, source)}) a join ({_hac_rows(keys, value, source)}) b
    on {on} and a.i - b.i between 0 and a.lags
  group by {ak})"""


def _hac_rows(keys: str, value: str, source: str) -> str:
    return f"""
select *, x0 - mean as x, least(greatest(1, cast(floor(4 * power(n / 100.0, 2 / 9.0)) as integer)), n - 1) as lags
from (select {keys}, {value} as x0, row_number() over (partition by {keys} order by date) as i,
  count(*) over (partition by {keys}) as n, avg({value}) over (partition by {keys}) as mean
  from {source})"""


def hac_alpha(keys: str, source: str) -> str:
    on = " and ".join(f"a.{k.strip()} = b.{k.strip()}" for k in keys.split(","))
    ak = ", ".join(f"a.{k.strip()}" for k in keys.split(","))
    rows = f"""
select *, e * (sx2 - x * sx) / (n * sx2 - sx * sx) as z,
  cast(floor(4 * power(n / 100.0, 2 / 9.0)) as integer) as lags
from (select *, y - alpha - slope * x as e from (
  select *, regr_slope(y, x) over (partition by {keys}) as slope,
    regr_intercept(y, x) over (partition by {keys}) as alpha,
    count(*) over (partition by {keys}) as n, sum(x) over (partition by {keys}) as sx,
    sum(x * x) over (partition by {keys}) as sx2,
    row_number() over (partition by {keys} order by date) as i
  from (select {keys}, date, ret - rf as y, bench - rf as x from {source})))"""
    return f"""
select {keys}, n, case when n >= 60 then alpha * {TD} end as alpha_annual,
  case when n >= 60 and v > 0 then alpha / sqrt(v) end as t_stat
from (select {ak}, max(a.n) as n, max(a.alpha) as alpha,
    sum(case when a.i = b.i then 1 else 2 * (1 - (a.i - b.i) / (a.lags + 1.0)) end * a.z * b.z) as v
  from ({rows}) a join ({rows}) b on {on} and a.i - b.i between 0 and a.lags group by {ak})"""


def ann(ret: str) -> str:
    return f"(power(product(1 + {ret}), {TD}.0 / count({ret})) - 1)"


def vol(x: str) -> str:
    return f"(stddev_samp({x}) * sqrt({TD}))"


DOWN = f"(sqrt(avg(case when ret < rf then (ret - rf) * (ret - rf) end)) * sqrt({TD}))"
SHARPE = f"coalesce(({ann('ret')} - avg(rf_annual)) / nullif({vol('ret')}, 0), 0)"
SORTINO = f"coalesce(({ann('ret')} - avg(rf_annual)) / nullif({DOWN}, 0), 0)"
CALMAR = f"coalesce({ann('ret')} / nullif(abs(min(dd)), 0), 0)"
BETA = "(covar_samp(ret, bench) / nullif(var_samp(bench), 0))"
ALPHA = f"({ann('ret')} - (avg(rf_annual) + {BETA} * ({ann('bench')} - avg(rf_annual))))"
SKEW = "(avg(power(ret - m, 3)) / power(avg(power(ret - m, 2)), 1.5))"
KURT = "(avg(power(ret - m, 4)) / power(avg(power(ret - m, 2)), 2) - 3)"

VIEWS["v_dd"] = drawdowns("portfolio", "ret", "v_series")
VIEWS["v_runs"] = """
select portfolio, count(*) as len from (
  select *, i - row_number() over (partition by portfolio, under order by i) as g from (
    select portfolio, dd < 0 as under, row_number() over (partition by portfolio order by date) as i
    from v_dd)) where under group by portfolio, g"""
VIEWS["v_win"] = f"""
select a.*, y.years from (
  select *, row_number() over (partition by portfolio order by date desc) as back,
         count(*) over (partition by portfolio) as have from v_al) a,
  (values {values([(y,) for y in P.fund_windows])}) as y(years)
where back <= y.years * {TD} and have >= floor(y.years * {TD * 0.9} + 1e-9)"""
VIEWS["v_windd"] = drawdowns("portfolio, years", "ret", "v_win")
VIEWS["v_nav"] = """
select portfolio, date, f / first_value(f) over (partition by portfolio order by date) as fund,
       b / first_value(b) over (partition by portfolio order by date) as benchmark
from (select portfolio, date,
  product(1 + ret) over (partition by portfolio order by date rows unbounded preceding) as f,
  product(1 + bench) over (partition by portfolio order by date rows unbounded preceding) as b
  from v_al)"""
VIEWS["v_fnav"] = """
select date, arm, product(1 + ret) over (partition by arm order by date rows unbounded preceding) as nav
from v_marks where ret is not null"""
VIEWS["v_armpairs"] = """
select a.arm as arm_a, b.arm as arm_b, a.arm || '_vs_' || b.arm as pair
from (values ('greedy', 1), ('qubo_classical', 2), ('qubo_quantum', 3)) a(arm, o),
     (values ('greedy', 1), ('qubo_classical', 2), ('qubo_quantum', 3)) b(arm, o) where a.o < b.o"""
VIEWS["v_member"] = """
select p.pair, x.security,
  exists (select 1 from v_arms a where a.portfolio = p.arm_a and a.security = x.security) as in_a,
  exists (select 1 from v_arms a where a.portfolio = p.arm_b and a.security = x.security) as in_b
from v_armpairs p, (select distinct security from v_arms) x"""


def panel(keys: str, source: str) -> str:
    """The gated forward panel for `source` (keys, date, ret, base, active, rf)."""
    on = lambda a: " and ".join(f"x.{k.strip()} = {a}.{k.strip()}" for k in keys.split(","))
    sort = lambda ret: (
        f"({ann(ret)} - avg(rf) * {TD}) / nullif(sqrt(avg(case when {ret} < rf then "
        f"({ret} - rf) * ({ret} - rf) end)) * sqrt({TD}), 0)"
    )
    xk = ", ".join(f"x.{k.strip()}" for k in keys.split(","))
    return f"""
select {xk}, x.n as "nDays", {r('growth - 1', 4)} as "activeReturnCumulative",
  case when x.n >= 20 then {r('annual', 4)} end as "activeReturnAnnualised",
  case when x.n >= 20 then {r('te', 4)} end as "trackingError",
  case when x.n >= 20 then {r('annual / nullif(te, 0)', 3)} end as "informationRatio",
  case when x.n >= 20 then {r(f'pa.sr * sqrt({TD})', 3)} end as sharpe_arm,
  case when x.n >= 20 then {r(f'pb.sr * sqrt({TD})', 3)} end as sharpe_baseline,
  {r('da.dd', 4)} as "maxDrawdown_arm", {r('db.dd', 4)} as "maxDrawdown_baseline",
  case when x.n >= 20 then {r('sa', 3)} end as sortino_arm,
  case when x.n >= 20 then {r('sb', 3)} end as sortino_baseline,
  case when x.n >= 60 then {r('ga / nullif(abs(da.dd), 0)', 3)} end as calmar_arm,
  case when x.n >= 60 then {r('gb / nullif(abs(db.dd), 0)', 3)} end as calmar_baseline,
  case when x.n >= 20 then {r(phi('pa.z'), 3)} end as "probSharpe_arm",
  case when x.n >= 20 then {r(phi('pb.z'), 3)} end as "probSharpe_baseline",
  {r('h.t_stat', 3)} as "neweyWestT"
from (select {keys}, count(*) as n, product(1 + active) as growth, avg(active) * {TD} as annual,
  {vol('active')} as te, {sort('ret')} as sa, {sort('base')} as sb, {ann('ret')} as ga, {ann('base')} as gb
  from {source} group by {keys}) x
join ({moments('ret - rf', keys, source)}) pa on {on('pa')}
join ({moments('base - rf', keys, source)}) pb on {on('pb')}
join (select {keys}, min(dd) as dd from ({drawdowns(keys, 'ret', source)}) group by {keys}) da on {on('da')}
join (select {keys}, min(dd) as dd from ({drawdowns(keys, 'base', source)}) group by {keys}) db on {on('db')}
join ({hac_mean(keys, 'active', source)}) h on {on('h')}"""


def _sr(x: str) -> str:
    return f"avg({x}) / nullif(stddev_samp({x}), 0) * sqrt({TD})"


VIEWS["v_boot"] = f"""
with base as (
  select arm, ret - rf as xa, base - rf as xb,
    row_number() over (partition by arm order by date) - 1 as i from v_fwd),
obs as (
  select arm, count(*) as n, {_sr('xa')} - {_sr('xb')} as observed,
    greatest(1, cast(round(power(count(*), 1 / 3.0)) as bigint)) as block
  from base group by arm),
draws as (
  select o.arm, k.rep, s.b * o.block + f.o as at, o.n,
    {draw('k.rep', 's.b', chr(39) + 'block' + chr(39))} % (o.n - o.block + 1) + f.o as i
  from obs o, (select unnest(range(0, {P.n_boot})) as rep) k,
    lateral (select unnest(range(0, cast(ceil(o.n / cast(o.block as double)) as bigint))) as b) s,
    lateral (select unnest(range(0, o.block)) as o) f
  where o.n >= 10),
reps as (
  select d.arm, d.rep, {_sr('b.xa')} - {_sr('b.xb')} as diff
  from draws d join base b on d.arm = b.arm and d.i = b.i where d.at < d.n
  group by d.arm, d.rep)
select o.arm, o.n, o.observed, x.lo, x.hi, x.p from obs o left join (
  select arm, quantile_cont(diff, 0.025) as lo, quantile_cont(diff, 0.975) as hi,
    least(1.0, 2 * least(avg(case when diff <= 0 then 1.0 else 0 end),
                         avg(case when diff >= 0 then 1.0 else 0 end))) as p
  from reps group by arm) x on o.arm = x.arm"""


# --- one text per query --------------------------------------------------------------------

def _rr(*cols: str) -> str:
    """Rounded columns under their own names."""
    return ", ".join(f'{r(chr(34) + c + chr(34))} as "{c}"' for c in cols)


WINDOWS = [n for n, _ in P.return_windows]

SQL["universe_load"] = """
with lists as (
  select 0 as prio, 'large' as nm, s_suppkey as k from supplier where s_suppkey % 2 = 0
  union all select 1, 'mid', s_suppkey from supplier where s_suppkey % 3 = 0
  union all select 2, 'small', s_suppkey from supplier where s_suppkey % 5 < 3),
last as (select * from lists qualify row_number() over (partition by k order by prio desc) = 1)
select 'T' || k as ticker, case when k % 13 <> 0 then nm || ' ' || k else 'T' || k end as name,
  case when k % 7 <> 0 then nm else 'Unknown' end as sector,
  case when k % 5 <> 0 then nm || ' sub' else '' end as sub_industry,
  case when k % 11 <> 0 then cast(k as bigint) end as cik from last"""
SQL["bars_load"] = f"""
select security, {day('date')} as date, {_rr('close', 'volume')} from v_bars
where security in (select security from v_sec where sector = 'ASIA')
  and date between date '2001-07-01' - 1095 and date '2001-06-30'"""
SQL["facts_flatten"] = f"""
select entity, taxonomy, concept, unit, {day('"start"')} as "start", {day('"end"')} as "end",
  {_rr('val')}, {day('filed')} as filed, form from v_facts"""
SQL["rf_load"] = f"""
with base as (select date, round(rf_annual * 100, 4) as pct, year(date) as batch from v_rf),
every as (select * from base union all select date, pct + 0.5, batch + 1 from base where month(date) = 12)
select {day('date')} as date, {r('arg_max(pct, batch) / 100')} as rf_annual
from every group by date"""
SQL["rf_fallback"] = f"""
select 'primary' as source, count(*) as n, {day('min(date)')} as first_date, {r('avg(rf_annual)')} as mean_rf from v_rf
union all select 'cached', count(*), {day('min(date)')}, {r('avg(rf_annual + 0.01)')} from v_rf
union all select 'constant', 1, '1990-01-01', {P.risk_free}"""
def logged(expr: str) -> str:
    """Six decimals as the log stores them: exact halves away from zero."""
    return f"cast(round(cast({expr} as decimal(24, 12)), 6) as double)"


SQL["log_read"] = f"""
select {day('date')} as date, arm, {logged('ret')} as ret from v_marks"""

SQL["rejects"] = """
select 'log' as source, 'kept' as cause, count(distinct date) as n from v_marks
union all select 'yields', 'kept', count(*) + count(*) filter (where month(date) = 12) from v_rf"""
SQL["log_upsert"] = f"""
select {day('m.date')} as date, case when m.date >= date '2024-01-10' then 'daily' else 'weekly' end as "runType", m.arm,
  case when m.date < date '2024-01-10' then {logged('m.ret')} when day(m.date) % 9 <> 0 then {logged('m.ret * 1.5')} end as ret,
  {logged('f.nav')} as nav
from v_marks m left join v_fnav f on m.date = f.date and m.arm = f.arm"""
SQL["snapshot_write"] = f"""
select true as success, 'weekly' as run_type, pos as rank, security as ticker, sector, score,
  {_rr('peRatio', 'return6M')}, "fundWeight" from v_stocks"""
VIEWS["v_recent"] = """
select * from v_gauges where date >= (select max(date) from v_gauges) - 10"""
SQL["gauge_load"] = f"select gauge, {day('date')} as date, {_rr('close')} from v_recent"

SQL["annual_span_filter"] = f"""
select entity, item, concept, {day('"start"')} as "start", {day('"end"')} as "end", {_rr('val')},
  {day('filed')} as filed, form from v_annual"""
SQL["liquidity_screen"] = f"""
select security, n_obs, {_rr('avg_volume', 'last_price')} from v_screened where reason is null"""
SQL["screen_reason"] = "select security, reason from v_screened"
SQL["health_data_filter"] = f"select security, {_rr(*HEALTH_FIELDS)} from v_ratios where {_HEALTH} is not null"
SQL["positive_pe"] = f"""
select security, case when "peRatio" > 0
  then {r('"peRatio"')} end as pe_ranked from v_ratios"""
SQL["margin_gate"] = f"""
select entity, {day('"end"')} as "end", {r(gate('net_income', 'revenue'))} as margin from v_wide"""
SQL["growth_gate"] = f"""
select entity, case when growth <= 10 then {r('growth')} end as growth from v_cagr"""
SQL["clean_returns"] = f"select security, {day('date')} as date, {_rr('ret')} from v_cret"
SQL["finite_rows"] = f"select {day('date')} as date, security, {_rr('ret')} from v_prows"
SQL["coverage_filter"] = f"""
select security, {r('cover')} as coverage, cover >= {P.min_coverage} as kept from (
  select security, count(ret) / cast(max(w) as double) as cover from v_cret,
    (select count(*) as w, min(t) as t0 from v_cal where t >= n - {P.cov_window})
  where t >= t0 group by security)"""
SQL["regime_label"] = f"""
select {day('date')} as date, {_rr('close')}, case when close < {P.vix_risk_on} then 'risk-on'
  when close > {P.vix_risk_off} then 'risk-off' else 'neutral' end as regime,
  case when close > 30 then 'high' when close > 20 then 'moderate' else 'low' end as level
from v_gauges where gauge = 'VIX'"""
VIEWS["v_prefix"] = f"""
select a.portfolio, h.horizon, a.date, a.ret, a.bench as base, a.active, a.rf from (
  select *, row_number() over (partition by portfolio order by date) as i from v_al) a,
  (values (2), (3), (19), (20), (59), (60), ({WHOLE})) as h(horizon) where a.i <= h.horizon"""
SQL["stat_gate"] = f"""
select portfolio, horizon, "nDays", "activeReturnCumulative", "activeReturnAnnualised", "trackingError",
  calmar_arm, calmar_baseline, "neweyWestT" from ({panel('portfolio, horizon', 'v_prefix')})"""
_DETAIL = """
select a.security, s.name, s.sector, s.pos as rank, s.score, s.security is null as partial,
  coalesce(a.weight, s."fundWeight") as weight
from v_arms a left join v_stocks s on a.security = s.security where a.portfolio = '{}'"""
SQL["holdings_query"] = f"""
select security, name, sector, {_rr('weight')}, partial from ({_DETAIL.format('qubo_classical')})
where security like '%2%' or lower(name) like '%2%'"""
SQL["reasons"] = "select security, reasons from v_said"
SQL["risk_flags"] = "select security, flags from v_said"

SQL["calendar_grid"] = f"select security, {day('date')} as date, {_rr('close', 'volume')} from v_grid"
SQL["score_join"] = f"""
select security, {_rr('netMargin', 'returnOnEquity', 'return6M', 'return3M')},
  "healthScore", "valuationScore", "momentumScore", score from v_scored"""
SQL["sector_lookup"] = """
select b.security, coalesce(s.sector, 'Unknown') as sector
from (select distinct security from v_bars) b
left join v_sec s on b.security = s.security"""
SQL["benchmark_align"] = f"select portfolio, {day('date')} as date, {_rr('ret', 'bench')} from v_al"
SQL["rf_asof"] = f"""
select {day('date')} as date, {_rr('rf_annual')}, {r(f'rf_annual / {TD} * 1000')} as rf_daily_milli from v_rfcal"""
SQL["rf_mean_fill"] = f"select {day('date')} as date, {r('rf * 1000')} as rf_milli from v_rffill"
SQL["fcf_match"] = f"""
select entity, {day('"end"')} as "end", {r('cfo - capex')} as fcf, {_rr('revenue')} from v_anch
where cfo is not null and capex is not null"""
SQL["growth_anchor"] = f"""
select entity, {day('rev_end')} as rev_end, {_rr('rev_last')}, {day('anchor_end')} as anchor_end,
  {_rr('anchor_val')} from v_growth where rev_end is not null"""
SQL["candidate_pairs"] = """
select a.pos as i, b.pos as j, a.security as security_i, b.security as security_j,
  a.sector = b.sector as same_sector from v_pool a join v_pool b on a.pos < b.pos"""
SQL["arm_pairs"] = "select * from v_armpairs"
SQL["selection_diff"] = """
select pair, case when in_a then 'onlyA' else 'onlyB' end as side, security from v_member where in_a <> in_b"""
SQL["held_semi"] = f"""
select portfolio, security, {r('weight / sum(weight) over (partition by portfolio)')} as weight
from v_book where security in (select security from v_bars where date >= date '2001-10-29')"""
SQL["holdings_detail"] = f"""
select security, partial, rank, score, {_rr('weight')} from ({_DETAIL.format('qubo_quantum')})"""
SQL["nav_overlay"] = f"""
select coalesce(a.portfolio, b.portfolio) as portfolio, {day('coalesce(a.date, b.date)')} as date,
  {_rr('fund', 'benchmark')}, {r('nav')} as forward
from v_nav a full outer join (
  select p.portfolio, date - 9135 as date, nav from v_fnav cross join (select distinct portfolio from v_nav) p
  where arm = 'greedy') b on a.portfolio = b.portfolio and a.date = b.date"""

SQL["annual_series"] = f'select entity, item, {day(chr(34) + "end" + chr(34))} as "end", {_rr("val")} from v_years'
SQL["merged_annual_max"] = f"""
select entity, item, {day('"end"')} as "end", {r('max(val)')} as val, count(val) as concepts
from v_cseries where merged group by entity, item, "end" """
SQL["latest_value"] = f"""
select entity, item, {day('max("end")')} as "end", {r('arg_max(val, "end")')} as val
from v_years group by entity, item"""
SQL["shares_outstanding"] = f"select entity, {_rr('shares')} from v_shares"
SQL["revenue_cagr"] = f'select entity, rev_n, {r("growth")} as "revenueGrowth" from v_cagr'
SQL["matched_fcf"] = f"select entity, {_rr('avg_fcf', 'margin_fcf', 'margin_rev')}, fcf_years from v_fcf"
SQL["fundamental_ratios"] = f"select security, {_rr(*RATIOS)} from v_ratios"
SQL["fundamentals_coverage"] = 'select count("netMargin") as usable, count(*) as names from v_ratios'
SQL["sector_pe_median"] = f"select sector, {_rr('pe_median')}, n from v_med"
SQL["pillar_score"] = f"select security, {_rr('health', 'valuation', 'momentum')} from v_pillars"
SQL["composite_score"] = "select * from v_scores"
SQL["screen_funnel"] = f"""
select u.n as universe_size, s.ok as screened_count, f.ok as scored_count, u.n - f.ok as excluded_count,
  s.h as "insufficientHistory", s.l as "lowLiquidity", s.p as "lowPrice",
  cast(0 as bigint) as "missingFundamentals", f.n - f.ok as "noHealthData"
from (select count(*) as n from v_sec) u,
  (select count(*) filter (where reason is null) as ok,
     count(*) filter (where reason = 'insufficientHistory') as h,
     count(*) filter (where reason = 'lowLiquidity') as l,
     count(*) filter (where reason = 'lowPrice') as p from v_screened) s,
  (select count(*) as n, count({_HEALTH}) as ok from v_ratios) f"""
SQL["portfolio_returns"] = f"select portfolio, {day('date')} as date, {_rr('ret')} from v_pret"
SQL["latest_mark"] = f"""
select a.portfolio, {day('max(c.last)')} as date,
  {r('sum(a.weight * coalesce(q.ret, 0)) / sum(a.weight)')} as weekly_ret,
  {r('sum(a.weight * coalesce(d.ret, 0)) / sum(a.weight)')} as daily_ret
from v_arms a cross join (select max(date) as last from v_cal) c
left join v_cret q on a.security = q.security and q.date = c.last
left join v_ret d on a.security = d.security and d.date = c.last group by a.portfolio"""


def _blend(f: str, digits: int | None) -> str:
    e = f'sum("{f}" * weight) / nullif(sum(weight) filter (where "{f}" is not null), 0)'
    return r(e, digits or 6)


SQL["blended_fundamentals"] = f"""
select portfolio, {_blend('peRatio', 2)} as pe, {_blend('fcfYield', 4)} as "fcfYield",
  {_blend('revenueGrowth', 4)} as "revenueGrowth", {_blend('returnOnEquity', 4)} as "returnOnEquity",
  {_blend('netMargin', 4)} as "netMargin", {_blend('dividendYield', 6)} as "weightedDividendYield",
  count("netMargin") as coverage
from v_book b join v_scored s on b.security = s.security group by portfolio"""
VIEWS["v_breakdown"] = f"""
select portfolio, sector, {r('sum(weight)', 4)} as weight from v_arms group by 1, 2"""
SQL["sector_breakdown"] = "select * from v_breakdown"


def per_portfolio(source: str, **cols: str) -> str:
    body = ", ".join(f'{r(e)} as "{n}"' for n, e in cols.items())
    return f"select portfolio, {body} from {source} group by portfolio"


_S = "v_series"
_M = "(select *, avg(ret) over (partition by portfolio) as m from v_series)"
_V = "(select *, quantile_cont(ret, 0.05) over (partition by portfolio) as q from v_series)"
TE = vol("ret - bench")
SQL["annual_return"] = per_portfolio(_S, annual_return=ann("ret"))
SQL["annual_volatility"] = per_portfolio(_S, annual_volatility=vol("ret"))
SQL["sharpe_ratio"] = per_portfolio(_S, sharpe_ratio=SHARPE)
SQL["sharpe_excess"] = per_portfolio(_S, sharpe_excess=_sr("ret - rf"))
SQL["sortino_ratio"] = per_portfolio(
    _S, sortino_ratio=SORTINO, sortino_forward=f"({ann('ret')} - avg(rf) * {TD}) / nullif({DOWN}, 0)"
)
SQL["calmar_ratio"] = per_portfolio("v_dd", calmar_ratio=CALMAR)
SQL["value_at_risk"] = per_portfolio(_S, value_at_risk="-quantile_cont(ret, 0.05)")
SQL["conditional_var"] = per_portfolio(_V, conditional_var="-avg(ret) filter (where ret <= q)")
SQL["win_rate"] = per_portfolio(_S, win_rate="avg(case when ret > 0 then 1.0 else 0.0 end)")
SQL["skew_kurtosis"] = per_portfolio(_M, skewness=SKEW, kurtosis=KURT)
SQL["beta"] = per_portfolio("v_al", beta=BETA)
SQL["capm_alpha"] = per_portfolio("v_al", capm_alpha=ALPHA)
SQL["tracking_error"] = per_portfolio("v_al", tracking_error=TE)
_IR = f"({ann('ret')} - {ann('bench')}) / nullif({TE}, 0)"
SQL["information_ratio"] = per_portfolio(
    "v_al", information_ratio=_IR, information_forward=f"avg(ret - bench) * {TD} / nullif({TE}, 0)"
)
SQL["metrics_summary"] = f"""
select a.portfolio, {r('a.a1')} as "annualReturn", {r('a.a2')} as "annualVolatility",
  {r('a.a3')} as "sharpeRatio", {r('a.a4')} as "sortinoRatio", {r('d.d1')} as "maximumDrawdown",
  {r('d.d2')} as "calmarRatio", {r('a.a5')} as "valueAtRisk95", {r('v.v1')} as "conditionalVar95",
  {r('a.a6')} as "winRate", {r('k.k1')} as skewness, {r('k.k2')} as kurtosis,
  u.len as "maxDrawdownDuration", {r('l.l1')} as beta, {r('l.l2')} as "trackingError",
  {r('l.l3')} as "informationRatio"
from (select portfolio, {ann('ret')} as a1, {vol('ret')} as a2, {SHARPE} as a3, {SORTINO} as a4,
   -quantile_cont(ret, 0.05) as a5, avg(case when ret > 0 then 1.0 else 0.0 end) as a6
   from v_series group by 1) a
join (select portfolio, min(dd) as d1, {CALMAR} as d2 from v_dd group by 1) d on a.portfolio = d.portfolio
join (select portfolio, -avg(ret) filter (where ret <= q) as v1 from {_V} group by 1) v on a.portfolio = v.portfolio
join (select portfolio, {SKEW} as k1, {KURT} as k2 from {_M} group by 1) k on a.portfolio = k.portfolio
left join (select portfolio, max(len) as len from v_runs group by 1) u on a.portfolio = u.portfolio
join (select portfolio, {BETA} as l1, {TE} as l2, {_IR} as l3 from v_al group by 1) l on a.portfolio = l.portfolio"""


def windows_of(win: str, dd: str) -> str:
    return f"""
select a.portfolio, a.years, {r(ann('ret'), 4)} as "annualReturn", {r(vol('ret'), 4)} as "annualVolatility",
  {r(SHARPE, 3)} as "sharpeRatio", {r(SORTINO, 3)} as "sortinoRatio", {r('min(dd)', 4)} as "maximumDrawdown",
  {r(CALMAR, 3)} as "calmarRatio", {r(ALPHA, 4)} as alpha, {r(BETA, 3)} as beta,
  {r(ann('bench'), 4)} as "benchmarkReturn", {r('max(h.t_stat)', 2)} as "alphaTStat"
from {dd} a join ({hac_alpha('portfolio, years', win)}) h
on a.portfolio = h.portfolio and a.years = h.years group by a.portfolio, a.years"""


SQL["window_metrics"] = windows_of("v_win", "v_windd")
SQL["alpha_newey_west"] = f"""
select portfolio, n, {r('alpha_annual')} as "alphaAnnual", {r('t_stat')} as "alphaTStat"
from ({hac_alpha('portfolio', 'v_al')})"""
SQL["newey_west_mean"] = f"""
select portfolio, n, {r('t_stat')} as t_stat from ({hac_mean('portfolio', 'active', 'v_al')})"""
SQL["prob_sharpe"] = f"""
select portfolio, {r(phi('z'))} as prob_sharpe from ({moments('ret - rf', 'portfolio', 'v_series')})"""
SQL["cumulative_active"] = f"""
select arm, count(*) as n_days, {r('product(1 + active) - 1')} as cumulative_active from v_fwd group by arm"""
SQL["forward_stats"] = f"""
select p.*, {r('b.observed', 4)} as difference, {r('b.lo', 4)} as ci_low, {r('b.hi', 4)} as ci_high,
  {r('b.p', 4)} as "pValue", 'greedy' as "vsBaseline"
from ({panel('arm', 'v_fwd')}) p join v_boot b on p.arm = b.arm"""
SQL["selection_jaccard"] = f"""
select pair, {r('count(*) filter (where in_a and in_b) / cast(count(*) filter (where in_a or in_b) as double)', 4)} as jaccard,
  count(*) filter (where in_a and in_b) as "overlapCount", count(*) filter (where in_a) as "nA",
  count(*) filter (where in_b) as "nB" from v_member group by pair"""
for _key, _view in (("cov_sample", "v_covs"), ("cov_ewma", "v_cove"), ("cov_ledoit", "v_covl")):
    SQL[_key] = f"select i, j, security_i, security_j, {r('c * 1e4')} as cov_bp from {_view}"
_CHANGE = """
select gauge, arg_max(close, date) as price, arg_max(close, date) / arg_min(close, date) - 1 as change
from v_recent group by gauge"""
SQL["gauge_change"] = f'select gauge, {r("price")} as price, {r("change")} as "weeklyReturn" from ({_CHANGE})'
SQL["market_summary"] = f"""
select {r('vix', 2)} as vix, {r('coalesce(sp, 0)')} as "sp500Return", {r('coalesce(nq, 0)')} as "nasdaqReturn",
  0.0::double as "treasuryYield",
  case when vix < {P.vix_risk_on} then 'risk-on' when vix > {P.vix_risk_off} then 'risk-off' else 'neutral' end as "riskSentiment",
  case when vix > 30 then 'high' when vix > 20 then 'moderate' else 'low' end as "volatilityLevel"
from (select max(price) filter (where gauge = 'VIX') as vix,
  max(change) filter (where gauge = 'S&P 500') as sp,
  max(change) filter (where gauge = 'Nasdaq Composite') as nq from ({_CHANGE}))"""
SQL["weight_report"] = f"""
select scheme, names, {r('total')} as total, {r('maxw')} as "maxWeight", at_cap as "namesAtCap",
  {r('eff')} as "effectiveN", {r('objective')} as objective, feasible, {r('wcw * 1e4')} as "wCw_bp", covered from v_schemes_rep"""
VIEWS["v_armal"] = f"""
select a.portfolio, a.date, a.ret, b.bench, f.rf_annual, f.rf_annual / {TD} as rf
from ({returns_of('v_arms')}) a join v_bench b on a.date = b.date join v_rfcal f on a.date = f.date"""
VIEWS["v_armnav"] = VIEWS["v_nav"].replace("v_al)", "v_armal)")
VIEWS["v_armwin"] = VIEWS["v_win"].replace("v_al)", "v_armal)")
VIEWS["v_armwindd"] = drawdowns("portfolio, years", "ret", "v_armwin")
VIEWS["v_armwm"] = windows_of("v_armwin", "v_armwindd")
VIEWS["v_armblend"] = f"""
select portfolio, {_blend('peRatio', 2)} as pe, {_blend('fcfYield', 4)} as "fcfYield", {_blend('revenueGrowth', 4)} as "revenueGrowth",
  {_blend('returnOnEquity', 4)} as "returnOnEquity", {_blend('netMargin', 4)} as "netMargin"
from v_arms a join v_names x on a.security = x.security group by 1"""
VIEWS["v_armpoints"] = f"""
select portfolio, list({{'date': cast(date as varchar), 'fund': {r('fund', 4)}, 'benchmark': {r('benchmark', 4)}}} order by date) as points
from (select *, row_number() over (partition by portfolio order by date) - 1 as i,
  count(*) over (partition by portfolio) as n from v_armnav)
where i % greatest(1, n // {P.nav_points}) = 0 or i = n - 1 group by 1"""


def metrics(years: int) -> str:
    fields = "annualReturn annualVolatility sharpeRatio sortinoRatio maximumDrawdown calmarRatio alpha beta benchmarkReturn alphaTStat"
    return f"""(select portfolio, {{{", ".join(f"'{f}': {chr(34)}{f}{chr(34)}" for f in fields.split())}}} as m
  from v_armwm where years = {years})"""


VIEWS["v_funds"] = f"""
select w.portfolio, {{'constituents': w.constituents,
    'blended': {{'pe': b.pe, 'fcfYield': b."fcfYield", 'revenueGrowth': b."revenueGrowth", 'returnOnEquity': b."returnOnEquity", 'netMargin': b."netMargin"}},
    {", ".join(f"'metrics{y}Y': m{y}.m" for y in P.fund_windows)},
    'navSeries': n.points, 'sectorBreakdown': s.parts, 'name': 'Screened fund',
    'weighting': case when w.portfolio = 'greedy' then 'score-weighted' when h.found then 'objective-weighted'
      else 'score-weighted (fallback)' end, 'benchmark': '{P.benchmark}'}} as fund
from (select portfolio, count(*) as constituents from v_arms group by 1) w join v_choice h on w.portfolio = h.arm
left join v_armblend b on w.portfolio = b.portfolio
{" ".join(f"left join {metrics(y)} m{y} on w.portfolio = m{y}.portfolio" for y in P.fund_windows)}
left join v_armpoints n on w.portfolio = n.portfolio
left join (select portfolio, list({{'sector': sector, 'weight': weight}} order by weight desc, sector) as parts
  from v_breakdown group by 1) s on w.portfolio = s.portfolio"""


def leaves(document: str, source: str, keys: str = "") -> str:
    """Every leaf of a nested value of `source`, by path."""
    return f"""
select {keys} replace(t.fullkey, '"', '') as path,
  case when t.type in ('VARCHAR', 'BOOLEAN') then t.atom ->> '$' end as text,
  case when t.type not in ('VARCHAR', 'BOOLEAN', 'NULL') then {r('cast(t.atom as double)')} end as number
from (select {keys} to_json({document}) as doc from {source}) d, json_tree(d.doc) t where t.type not in ('OBJECT', 'ARRAY')"""


SQL["arm_fund_report"] = leaves("fund", "v_funds", "portfolio,")
_ORDER = "case {} when 'greedy' then 1 when 'qubo_classical' then 2 else 3 end"
VIEWS["v_armdoc"] = f"""
select a.portfolio, {{'key': a.portfolio, 'label': {{label}}, 'isQuantum': a.portfolio = 'qubo_quantum',
    'selection': a.names, 'weights': a.weights, 'fund': f.fund, 'diagnostics': {{'solver': d.solver, 'isQuantum': d."isQuantum",
      'numReads': d."numReads", 'bestEnergy': {r('d."bestEnergy"')}, 'energyStd': {r('d."energyStd"')},
      'lambdas': case when d.lambdas_l1 is not null then {{'l1': d.lambdas_l1, 'l2': d.lambdas_l2, 'l3': d.lambdas_l3, 'l4': d.lambdas_l4}} end,
      'targetSize': d."targetSize", 'weighting': d.weighting, 'weightingNote': d."weightingNote",
      'weightLambdas': case when d.lambdas_l1 is not null then {{'l1': d."weightLambdas_l1", 'l2': d."weightLambdas_l2"}} end,
      'wSigmaWScore': {r('d.score_wcw', 8)}, 'wSigmaW': {r('d.wcw', 8)}, 'maxWeight': {r('d.maxw', 5)},
      'namesAtCap': d.at_cap, 'effectiveN': {r('d.eff', 1)}}}}} as arm
from (select portfolio, list(security order by security) as names,
    map_from_entries(list((security, {r('weight', 5)}) order by security)) as weights from v_arms group by 1) a
join v_funds f on a.portfolio = f.portfolio join v_diag d on a.portfolio = d.arm""".replace(
    "{label}", "case a.portfolio " + " ".join(f"when '{k}' then '{v}'" for k, v in ARM_LABELS.items()) + " end"
)
VIEWS["v_jaccard"] = SQL["selection_jaccard"]
VIEWS["v_pairdoc"] = """
select list({'pair': j.pair, 'jaccard': j.jaccard, 'overlapCount': j."overlapCount", 'nA': j."nA", 'nB': j."nB",
  'onlyA': o.a, 'onlyB': o.b} order by j.pair) as pairs
from v_jaccard j join (select pair, list(security order by security) filter (where in_a and not in_b) as a,
  list(security order by security) filter (where in_b and not in_a) as b from v_member group by 1) o on j.pair = o.pair"""
VIEWS["v_fstats"] = SQL["forward_stats"]
VIEWS["v_fnavdoc"] = f"""
select list({{'date': cast(date as varchar), 'nav': nav}} order by date) as points
from (select date, map_from_entries(list((arm, {r('nav', 5)}) order by arm)) as nav from v_fnav group by 1)"""
VIEWS["v_research"] = f"""
select {{'schemaVersion': 1, 'asOf': {day('(select max(date) from v_cal)')}, 'inceptionDate': {day('(select min(date) from v_marks)')},
  'baselineArm': 'greedy', 'armOrder': ['greedy', 'qubo_classical', 'qubo_quantum'],
  'arms': (select list(arm order by {_ORDER.format('portfolio')}) from v_armdoc),
  'selectionComparison': (select pairs from v_pairdoc),
  'forwardStats': (select list(x order by x.arm) from v_fstats x),
  'forwardNav': (select points from v_fnavdoc)}} as doc"""
SQL["research_block"] = leaves("doc", "v_research")


def _listed(column: str) -> str:
    return f"case when {column} = '' then [] else string_split({column}, ' | ') end"


_NUMBERS = ["price", "score", "healthScore", "valuationScore", "momentumScore", *RATIOS, *WINDOWS, "fundWeight"]
VIEWS["v_stockdoc"] = f"""
select list({{'rank': s.pos, 'ticker': s.security, 'name': s.name, 'sector': s.sector, 'subIndustry': s.sub_industry,
  {", ".join(f"'{c}': s.{chr(34)}{c}{chr(34)}" for c in _NUMBERS)},
  'reasons': {_listed('x.reasons')}, 'flags': {_listed('x.flags')}}} order by s.pos) as stocks
from v_stocks s join v_said x on s.security = x.security"""
VIEWS["v_conditions"] = SQL["market_summary"]
VIEWS["v_funnel"] = SQL["screen_funnel"]
_FACTORS_SQL = ", ".join(f"'{pillar}Factors': [{', '.join(repr(m) for m in members)}]" for pillar, members in FACTORS.items())
VIEWS["v_snapshot"] = f"""
select {{'success': true, 'date': {day('(select max(date) from v_cal)')}, 'elapsed_seconds': null, 'backend_version': '1.0.0', 'run_type': 'weekly',
  'portfolio': {{'asOf': {day('(select max(date) from v_cal)')}, 'universeSize': f.universe_size, 'screenedCount': f.screened_count,
    'scoredCount': f.scored_count, 'excludedCount': f.excluded_count,
    'exclusionReasons': {{'insufficientHistory': f."insufficientHistory", 'lowLiquidity': f."lowLiquidity", 'lowPrice': f."lowPrice",
      'missingFundamentals': f."missingFundamentals", 'noHealthData': f."noHealthData"}},
    'minHistoryYears': {float(P.min_history_years)}, 'pricesAsOf': {day('(select max(date) from v_cal)')},
    'methodology': {{'weights': {{'health': {P.weight_health}, 'valuation': {P.weight_valuation}, 'momentum': {P.weight_momentum}}},
      {_FACTORS_SQL}, 'sectorNeutral': {{'pillars': ['health', 'valuation'], 'groupBy': 'sector', 'minCount': {P.sector_min_count},
        'momentumScope': 'universe-wide'}}}},
    'stocks': (select stocks from v_stockdoc), 'fund': (select fund from v_funds where portfolio = 'greedy'),
    'research': (select doc from v_research),
    'marketConditions': {{'date': {day('(select max(date) from v_gauges)')}, 'vix': m.vix, 'sp500Return': m."sp500Return", 'nasdaqReturn': m."nasdaqReturn",
      'treasuryYield': m."treasuryYield", 'riskSentiment': m."riskSentiment", 'volatilityLevel': m."volatilityLevel"}}}}}} as doc
from v_funnel f, v_conditions m"""
SQL["snapshot_read"] = leaves("doc", "v_snapshot")


_ALL_OBS = "(" + " union all ".join(_OBS) + ")"
SQL["pct_rank_universe"] = f"""
select o.security, o.factor, {r('o.value')} as value, {r('k.pctl_universe')} as pctl
from {_ALL_OBS} o left join v_ranked k on o.security = k.security and o.factor = k.factor"""
SQL["pct_rank_sector"] = f"""
select o.security, o.sector, o.factor, {r('k.pctl')} as pctl, coalesce(k.use_sector, false) as "sectorRanked"
from {_ALL_OBS} o left join v_ranked k on o.security = k.security and o.factor = k.factor"""
SQL["ffill_prices"] = f"select security, {day('date')} as date, {_rr('filled')} from v_filled"
SQL["trailing_returns"] = f"""
select a.security, {r('a.price')} as price, {", ".join(r('a."' + n + '"') + f' as "{n}"' for n in WINDOWS)},
  {r('b."return1Y"')} as "return1Y_daily"
from v_trail a join ({_trailing(True)}) b on a.security = b.security"""
SQL["daily_returns"] = f"select security, {day('date')} as date, {_rr('ret')} from v_ret"
SQL["nav_series"] = f"select portfolio, {day('date')} as date, {_rr('fund', 'benchmark')} from v_nav"
SQL["nav_downsample"] = f"""
select portfolio, {day('date')} as date, {_rr('fund', 'benchmark')} from (
  select *, row_number() over (partition by portfolio order by date) - 1 as i,
    count(*) over (partition by portfolio) as n from v_nav)
where i % greatest(1, n // {P.nav_points}) = 0 or i = n - 1"""
SQL["max_drawdown"] = per_portfolio("v_dd", max_drawdown="min(dd)")
SQL["drawdown_duration"] = """
select p.portfolio, max(u.len) as rows_below_peak from (select distinct portfolio from v_series) p
left join v_runs u on p.portfolio = u.portfolio group by p.portfolio"""
SQL["tail_rows"] = f"""
select security, {day('date')} as date, {_rr('ret')}, back from (
  select *, row_number() over (partition by security order by date desc) as back from v_cret) where back <= 60"""
SQL["ewma_weights"] = f"select k as row, {r('w')} as weight from v_pdates"
_AC = _hac_rows("portfolio", "active * 100", "v_al")
SQL["autocov_lags"] = f"""
select a.portfolio, l.lag, {r('max(1 - l.lag / (a.lags + 1.0))')} as weight, {r('sum(a.x * b.x)')} as autocov
from ({_AC}) a, lateral (select unnest(range(0, a.lags + 1)) as lag) l, ({_AC}) b
where a.portfolio = b.portfolio and a.i - l.lag = b.i group by a.portfolio, l.lag"""
SQL["forward_nav"] = f"select {day('date')} as date, arm, {r('nav', 5)} as nav from v_fnav"
SQL["forward_sparkline"] = f"""
select d.i, {r('f.nav', 5)} as v from v_fnav f join (
  select date, row_number() over (order by date) - 1 as i from (select distinct date from v_fnav)) d
on f.date = d.date where f.arm = 'qubo_quantum'"""
SQL["capped_weights"] = f"select portfolio, security, {_rr('weight')} from v_book"
SQL["rank_number"] = f"select pos as rank, security, score from v_best where pos <= {P.top_n}"

SQL["screen_top_n"] = f"""
select s.pos as rank, s.security, s.name, s.sector, s.sub_industry, {r('s.price')} as price, s.score,
  s."healthScore", s."valuationScore", s."momentumScore",
  {", ".join(r('s."' + c + '"') + f' as "{c}"' for c in RATIOS + WINDOWS)}, s."fundWeight",
  x.reasons, x.flags from v_stocks s join v_said x on s.security = x.security"""
SQL["candidate_pool"] = f"select pos, security, sector, score, {_rr(*RATIOS)} from v_pool"
SQL["recent_matched_years"] = f"""
select entity, {day('"end"')} as "end", fcf_rank from v_anch where fcf_rank <= 3"""
SQL["top_strengths"] = "select security, place - 1 as place, p as pctl, txt as strength from v_strong"
SQL["top_sectors"] = """
select *, row_number() over (partition by portfolio order by weight desc, sector) as place
from v_breakdown qualify place <= 3"""
SQL["sector_options"] = f"select distinct sector from ({_DETAIL.format('qubo_classical')}) where not partial"
SQL["reprice_universe"] = f"""
select security from v_stocks union select security from v_arms union select '{P.benchmark}'"""
SQL["selection_sets"] = """
select pair, security, case when in_a and in_b then 'both' when in_a then 'only_a' else 'only_b' end as side
from v_member where in_a or in_b"""
SQL["aligned_dates"] = f"select {day('date')} as date, arm, {_rr('ret')} from v_aligned_marks"

SQL["block_bootstrap_sharpe"] = f"""
select arm, n, {r('observed', 4)} as difference, {r('lo', 4)} as ci_low, {r('hi', 4)} as ci_high,
  {r('p', 4)} as "pValue" from v_boot"""
SQL["objective_terms"] = f"select i, j, security_i, security_j, {r('coef')} as coef from v_terms"


SQL["score_candidate_selections"] = f"""
select basket, size, {r('e')} as energy, {r('stddev_pop(e) over ()')} as energy_std,
  row_number() over (order by round(e, 9), basket) = 1 as is_best
from (select *, {energy(P.l1, P.l2, P.l3, P.l4)} as e from v_parts)"""
SQL["lambda_sweep"] = f"""
select l1, l2, l3, l4, arg_min(basket, row(e, basket)) as basket, {r('min(e)')} as energy,
  arg_min(size, row(e, basket)) as size, {r('stddev_pop(e)')} as energy_std
from (select g.*, p.basket, p.size, round({energy('g.l1', 'g.l2', 'g.l3', 'g.l4')}, 9) as e
  from v_parts p, (select cast(a as double) as l1, cast(b as double) as l2, cast(c as double) as l3,
    cast(d as double) as l4 from (values {values(SWEEP)}) as x(a, b, c, d)) g)
group by l1, l2, l3, l4"""
SQL["choose_weights"] = f"""
select coalesce(s, 'score_capped') as scheme, case when s is null then 'score_fallback' else 'objective' end as weighting,
  {r('coalesce(o, so)')} as objective, {r('sw * 1e4')} as "wCwScore_bp"
from (select arg_min(scheme, row(round(objective, 9), scheme)) filter (where feasible) as s,
  min(objective) filter (where feasible) as o, max(objective) filter (where scheme = 'score_capped') as so,
  max(wcw) filter (where scheme = 'score_capped') as sw from v_schemes_rep)"""

SQL["arm_choice"] = f"""
select a.portfolio, w.basket, h.scheme, a.security, a.sector, {r('a.weight')} as weight
from v_arms a join v_choice h on a.portfolio = h.arm left join v_winner w on a.portfolio = w.arm"""
_OWN = "case when h.arm <> 'greedy' then {} end"
VIEWS["v_diag"] = f"""
select h.arm, case when h.arm = 'greedy' then 'none' else 'candidates' end as solver,
  h.arm = 'qubo_quantum' as "isQuantum", w.reads as "numReads", w.e as "bestEnergy", w.spread as "energyStd",
  {_OWN.format(P.basket_size)} as "targetSize",
  {", ".join(_OWN.format(f"{float(getattr(P, n))}::double") + f' as lambdas_{n}' for n in ("l1", "l2", "l3", "l4"))},
  {", ".join(_OWN.format(f"{float(getattr(P, n))}::double") + f' as "weightLambdas_{n}"' for n in ("l1", "l2"))},
  {_OWN.format("case when h.found then 'objective' else 'score_fallback' end")} as weighting,
  case when h.arm <> 'greedy' and not h.found then case when x.names > x.covered then 'selection not fully covered by covariance'
    when x.names * {P.max_weight} < 1 - 1e-12 then 'cap infeasible' else 'no feasible scheme' end end as "weightingNote",
  {_OWN.format("s.wcw")} as score_wcw, {_OWN.format("case when h.found then x.wcw end")} as wcw,
  {_OWN.format("x.maxw")} as maxw, {_OWN.format("case when h.found then x.at_cap end")} as at_cap,
  {_OWN.format("x.eff")} as eff
from v_choice h join v_asch_rep x on x.scheme = h.arm || '|' || h.scheme
join v_asch_rep s on s.scheme = h.arm || '|score_capped' left join v_winner w on h.arm = w.arm"""
SQL["arm_diagnostics"] = f"""
select arm, solver, "isQuantum", "numReads", {r('"bestEnergy"')} as "bestEnergy", {r('"energyStd"')} as "energyStd",
  cast("targetSize" as bigint) as "targetSize", lambdas_l1, lambdas_l2, lambdas_l3, lambdas_l4, "weightLambdas_l1",
  "weightLambdas_l2", weighting, "weightingNote", {r(r('score_wcw', 8) + ' * 1e4')} as "wSigmaWScore_bp",
  {r(r('wcw', 8) + ' * 1e4')} as "wSigmaW_bp", {r('maxw', 5)} as "maxWeight", at_cap as "namesAtCap",
  {r('eff', 1)} as "effectiveN" from v_diag"""
SQL["stream_daily_marks"] = f"""
select p.portfolio, {day('c.date')} as date, {r('coalesce(x.ret, 0.0)')} as ret
from (select distinct portfolio from v_book) p cross join v_cal c left join (
  select b.portfolio, q.date, sum(b.weight * q.ret) / max(t.total) as ret
  from v_book b join v_ret q on b.security = q.security
  join (select portfolio, sum(weight) as total from v_book group by 1) t on b.portfolio = t.portfolio
  group by b.portfolio, q.date) x on p.portfolio = x.portfolio and c.date = x.date"""
SQL["stream_log_upsert"] = f"""
select {day('date')} as date, case when date >= date '2024-01-05' then 'daily' else 'weekly' end as "runType", arm,
  {logged("ret * case when date >= date '2024-01-08' then 2.0 when date >= date '2024-01-05' then 1.5 else 1.0 end")} as ret
from v_marks"""


# --- a weekly document of four weeks ago, refreshed -----------------------------------------

def copied(prefix: str, new: dict[str, str], only: list[str] | None = None) -> None:
    """Copies of all views that rest on those of `new` (or of `only` some), under names
    with a prefix, with the views of `new` in their place."""
    names = set(only or ())
    while only is None:
        more = {v for v, body in VIEWS.items() if v not in new and any(re.search(rf"\b{n}\b", body) for n in names | set(new))}
        if more == names:
            break
        names = more
    swap = new | {n: prefix + n for n in names}
    pattern = re.compile(r"\b(" + "|".join(swap) + r")\b")
    for n in names:
        VIEWS[prefix + n] = pattern.sub(lambda m: swap[m.group(1)], VIEWS[n])


_FIRST_VIEWS = dict(VIEWS)
copied("w_", {"v_bars": "w_bars"})
VIEWS["w_bars"] = f"select * from v_bars where date <= (select max(date) from v_bars) - {STALE_DAYS}"
VIEWS["d_frozen"] = f"select portfolio, security, sector, {r('weight', 5)} as weight from w_v_arms"
VIEWS["d_own"] = "select * from d_frozen where portfolio = 'greedy'"
copied(
    "d_", {"v_arms": "d_own", "v_names": "w_v_names", "v_choice": "w_v_choice"},
    "v_armal v_armnav v_armwin v_armwindd v_armwm v_armblend v_armpoints v_breakdown v_funds".split(),
)
VIEWS["d_marks"] = f"""
select date, arm, {logged('ret')} as ret from v_marks
union all select (select max(date) from v_cal), portfolio, {logged('sum(weight * coalesce(ret, 0)) / sum(weight)')}
from d_frozen a left join (select security as s, ret from v_ret where date = (select max(date) from v_cal)) q on a.security = q.s
group by portfolio"""
copied(
    "d_", {"v_marks": "d_marks"},
    [v for v in _FIRST_VIEWS if v in ("v_fstats", "v_fnavdoc", "v_fnav", "v_rfmap", "v_rffill", "v_aligned_marks", "v_fwd")
     or re.search(r"\bv_fwd\b", _FIRST_VIEWS[v]) or v.startswith("v_boot")],
)
VIEWS["d_trail"] = _trailing(True)
VIEWS["d_stockdoc"] = f"""
select list({{'rank': s.pos, 'ticker': s.security, 'name': s.name, 'sector': s.sector, 'subIndustry': s.sub_industry,
  {", ".join(f"'{c}': {'t' if c in ('price', *WINDOWS) else 's'}.{chr(34)}{c}{chr(34)}" for c in _NUMBERS)},
  'reasons': {_listed('x.reasons')}, 'flags': {_listed('x.flags')}}} order by s.pos) as stocks
from w_v_stocks s join w_v_said x on s.security = x.security join d_trail t on s.security = t.security"""
_DAILY = VIEWS["w_v_research"]
for _part in ("fstats", "fnavdoc"):
    _DAILY = re.sub(rf"\b(w_)?v_{_part}\b", f"d_v_{_part}", _DAILY)
VIEWS["d_research"] = _DAILY
_DAILY = VIEWS["w_v_snapshot"].replace("'run_type': 'weekly'", "'run_type': 'daily'").replace("w_v_stockdoc", "d_stockdoc")
_DAILY = _DAILY.replace("w_v_funds", "d_v_funds").replace("w_v_research", "d_research")
_NEWEST = day("(select max(date) from v_gauges)")
_DAILY = re.sub(r"'(pricesAsOf|success': true, 'date)': cast\(\(select max\(date\) from w_v_cal\) as varchar\)", rf"'\1': {_NEWEST}", _DAILY)
VIEWS["d_snapshot"] = _DAILY
_SAID = ", ".join(
    f"'{c}': case when {e} is not null then {w} end"
    for c, e, w in [
        ("solver", "d.solver", "d.solver"), ("weighting", "d.weighting", "d.weighting"), ("weightingNote", 'd."weightingNote"', 'd."weightingNote"'),
        ("bestEnergy", 'd."bestEnergy"', "printf('%.6f', round(d.\"bestEnergy\", 6))"),
        ("energyStd", 'd."energyStd"', "printf('%.6f', round(d.\"energyStd\", 6))"),
        ("maxWeight", "d.maxw", "printf('%.5f', round(d.maxw, 5))"), ("effectiveN", "d.eff", "printf('%.1f', round(d.eff, 1))"),
    ]
)
VIEWS["v_lastmark"] = f"""
select a.portfolio, {logged('sum(a.weight * coalesce(q.ret, 0)) / sum(a.weight)')} as ret
from v_arms a left join (select * from v_ret where date = (select max(date) from v_cal)) q on a.security = q.security group by 1"""
VIEWS["v_records"] = f"""
select cast(date as varchar) as date, {{'runType': 'daily', 'armReturns': map_from_entries(list((arm, {logged('ret')}) order by arm)),
  'armNav': map(), 'rebalance': null}} as doc
from v_marks where date > (select max(date) from v_marks) - 14 group by date
union all
select {day('(select max(date) from v_cal)')}, {{'runType': 'weekly',
  'armReturns': (select map_from_entries(list((portfolio, ret) order by portfolio)) from v_lastmark), 'armNav': map(),
  'rebalance': {{'selectionByArm': (select map_from_entries(list((portfolio, names) order by portfolio)) from
      (select portfolio, list(security order by security) as names from v_arms group by 1)),
    'diagnosticsByArm': (select map_from_entries(list((d.arm, {{{_SAID}}}) order by d.arm)) from v_diag d)}}}}"""
SQL["log_rebalance"] = leaves("doc", "(select date, to_json(doc) as doc from v_records)", "date,")
SQL["daily_refresh"] = leaves("doc", "d_snapshot")


def oracles() -> dict[str, str]:
    return {name: resolve(body.strip()) for name, body in SQL.items()}
