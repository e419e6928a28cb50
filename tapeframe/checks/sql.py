"""SQL text of the adapter views and a few shorthands, expanded to plain SQL before use:

r6(x)       six decimals with the rounding edge off the short decimals
div(a, b)   null where b is 0
imb(a, b)   (a - b)/(a + b)
fsum(x, c)  sum over rows with c, 0 when there are none; favg, fstd, fcnt(c) alike
ew(t)       exp(-s/t)
skew(x)     population skewness
"""

from __future__ import annotations

DAYS = "date_diff('day', cast(l_shipdate as date), make_date(cast(year(l_shipdate) as int),12,31))"
TIES = "l_orderkey, l_linenumber, l_partkey"

VIEWS = {
    "base": f"""select l_suppkey*10 + (year(l_shipdate)-1995) as sample_id, {DAYS} as d, l_suppkey, {TIES},
       floor(l_extendedprice/l_quantity)/1e3 as px, l_quantity as volume, l_discount, l_tax,
       case when l_linestatus='F' then 0 else 1 end as side, case when l_returnflag='R' then 1 else 0 end as order_action
from lineitem""",
    "trade": f"select sample_id, 60e0*d/366 as s, px as price, volume, side, {TIES} from base",
    "ord": f"""select sample_id, 60e0*d/366 as s, floor(px*(1e0-l_discount)*1e3)/1e3 as price, volume, side, order_action, {TIES}
from base""",
    "market": """select sample_id, 600e0*d/366 as s,
       max(px)+0.001e0 as ask_price_1, case when d % 97 = 5 then 0e0 else min(px)-0.001e0 end as bid_price_1,
       max(px)+0.002e0 as ask_price_2, case when d % 97 = 5 then 0e0 else min(px)-0.003e0 end as bid_price_2,
       coalesce(sum(case when side=1 then volume end),0e0) as ask_volume_1,
       coalesce(sum(case when side=0 then volume end),0e0) as bid_volume_1,
       sum(volume) as ask_volume_2, sum(volume)+10e0 as bid_volume_2,
       case when d % 11 = 3 then null else avg(px) end as transaction_avgprice,
       case when d % 11 = 3 then null else sum(volume) end as transaction_volume
from base group by sample_id, d""",
    "label": """select sample_id, cast(l_suppkey % 12 as int) as month, avg(l_tax)-avg(l_discount) as target
from base group by sample_id, l_suppkey""",
    "calendar": "select s_suppkey*10 + unnest(range(0,8)) as sample_id from supplier",
    "months": "select distinct sample_id, cast(l_suppkey % 12 as int) as month from base",
    "pred": """select label.*, p_a, p_b, p_c from label join (select sample_id, avg(price)-2e0 as p_a,
      sum(case when side=0 then volume else -volume end) as p_b, max(price) as p_c from trade group by 1) using (sample_id)""",
    "tr": f"""select *, cast(floor(s) as int) as sec, case when side=0 then 1e0 else -1e0 end as sgn,
       row_number() over w - 1 as idx, count(*) over (partition by sample_id) as n,
       {", ".join(f"price - lag(price,{k}) over w as dp{k}" for k in (1, 7, 14, 21, 30))},
       {", ".join(f"volume - lag(volume,{k}) over w as dv{k}" for k in (1, 7, 14, 21))},
       s - lag(s) over w as gap
from trade window w as (partition by sample_id order by s, {TIES})""",
    "orr": f"""select *, cast(floor(s) as int) as sec, case when side=0 then 1e0 else -1e0 end as sgn,
       case when order_action=0 then 1e0 else -1e0 end as act,
       case when (side=0) = (order_action=0) then volume else -volume end as flow,
       row_number() over w - 1 as idx, count(*) over (partition by sample_id) as n,
       {", ".join(f"price - lag(price,{k}) over w as dp{k}" for k in (1, 7, 14))},
       {", ".join(f"volume - lag(volume,{k}) over w as dv{k}" for k in (1, 14))},
       s - lag(s) over w as gap
from ord window w as (partition by sample_id order by s, {TIES})""",
    "bk0": """select *, ask_price_1>0 and bid_price_1>0 as valid, (ask_price_1+bid_price_1)/2 as mid,
       div(ask_price_1*bid_volume_1 + bid_price_1*ask_volume_1, ask_volume_1+bid_volume_1) as micro,
       ask_price_1-bid_price_1 as spread,
       case when ask_price_1>0 and bid_price_1>0 then (ask_price_1+bid_price_1)/2 end as mid_v,
       case when ask_price_1>0 and bid_price_1>0 then ask_price_1-bid_price_1 end as spread_v,
       imb(bid_volume_1, ask_volume_1) as imbal, ask_volume_1-bid_volume_1 as tilt
from market""",
    "bk": """select *, row_number() over w - 1 as idx, count(*) over (partition by sample_id) as n,
       mid - lag(mid) over w as dmid, coalesce(mid_v - lag(mid_v) over w, 0e0) as dmid_v,
       coalesce(tilt - lag(tilt) over w, 0e0) as dofi
from bk0 window w as (partition by sample_id order by s)""",
}
NEEDS = {
    "trade": ["base"], "ord": ["base"], "market": ["base"], "label": ["base"], "months": ["base"],
    "pred": ["label", "trade"],
    "tr": ["trade"], "orr": ["ord"], "bk0": ["market"], "bk": ["bk0"],
}

SHORT = {
    "r6": lambda x: f"floor(({x})*1e6+0.4871e0)/1e6",
    "div": lambda a, b: f"(({a})/nullif(cast({b} as double),0e0))",
    "imb": lambda a, b: f"((({a})-({b}))/nullif(cast(({a})+({b}) as double),0e0))",
    "fsum": lambda x, c="true": f"coalesce(sum({x}) filter (where {c}),0e0)",
    "favg": lambda x, c: f"avg({x}) filter (where {c})",
    "fstd": lambda x, c: f"stddev_samp({x}) filter (where {c})",
    "fcnt": lambda c: f"count(*) filter (where {c})",
    "ew": lambda t: f"exp(-s/{t}e0)",
    "skew": lambda x: f"(skewness({x})*(count({x})-2)/sqrt(count({x})*(count({x})-1.0e0)))",
    "cosine": lambda p, y: f"(sum(({p})*({y}))/nullif(sqrt(sum(({p})*({p})) filter (where ({y}) is not null)*sum(({y})*({y})) filter (where ({p}) is not null)),0e0))",
}


def expand(text: str) -> str:
    """Replaces every shorthand call, innermost arguments first."""
    out, i = [], 0
    while i < len(text):
        if text[i].isalpha() or text[i] == "_":
            j = i
            while j < len(text) and (text[j].isalnum() or text[j] == "_"):
                j += 1
            word = text[i:j]
            if word in SHORT and j < len(text) and text[j] == "(":
                depth, k, args, start = 1, j + 1, [], j + 1
                while depth:
                    c = text[k]
                    depth += (c == "(") - (c == ")")
                    if (c == "," and depth == 1) or depth == 0:
                        args.append(text[start:k].strip())
                        start = k + 1
                    k += 1
                out.append(SHORT[word](*[expand(a) for a in args]))
                i = k
                continue
            out.append(word)
            i = j
            continue
        out.append(text[i])
        i += 1
    return "".join(out)


def with_views(views: str, ctes: str, select: str) -> str:
    order: list[str] = []

    def add(name: str) -> None:
        for dep in NEEDS.get(name, []):
            add(dep)
        if name not in order:
            order.append(name)

    for v in views.split():
        add(v)
    parts = [f"{v} as ({VIEWS[v]})" for v in order]
    if ctes.strip():
        parts.append(ctes.strip().rstrip(","))
    head = "with " + ",\n".join(parts) + "\n" if parts else ""
    return expand(head + select.strip())
