"""DuckDB forms of the column building blocks, for the oracles."""

from __future__ import annotations


def nearest(x: str, q: float, group: str) -> str:
    """A scalar per group: the nearest-rank quantile."""
    return f"list_sort(list({x}) filter ({x} is not null))[floor((count({x}) - 1) * {q}::double + 0.5::double)::int + 1]"


def buckets(source: str, name: str, x: str, n: int) -> str:
    """``source`` with quantile by average rank."""
    return f"""{name} as (select * exclude (rk, ties, held), case when {x} is null or held < {n} then null
        else (least(greatest(floor((rk + (ties - 1) / 2.0::double - 1) / held * {n}), 0), {n} - 1) + 1)::int end as quantile
        from (select *, rank() over (partition by trade_date, {x} is null order by {x}) as rk, count(*) over (partition by trade_date, {x}) as ties, count({x}) over (partition by trade_date) as held from {source}))"""


def terciles(source: str, name: str, x: str, label: str) -> str:
    return f"""{name} as (select s.*, case when {x} is null then null when {x} <= lo then 'L' when {x} >= hi then 'H' else 'N' end as {label}
        from {source} s join (select trade_date as td, {nearest(x, 0.3, '')} as lo, {nearest(x, 0.7, '')} as hi from {source} group by trade_date) e on s.trade_date = e.td)"""


def long_short(source: str, long: str, short: str, name: str, weight: str = "1.0::double") -> str:
    """A select of trade_date and the factor."""

    def leg(mask: str) -> str:
        return f"case when sum(case when {mask} then w end) > 0 then 0.5::double * coalesce(sum(case when {mask} then w * ret end), 0) / sum(case when {mask} then w end) else 0 end"

    return f"""select trade_date, {leg('l')} - {leg('s')} as {name} from (select trade_date, ret, {weight} as w, coalesce({long}, false) as l, coalesce({short}, false) as s from {source} where ret is not null)
        where l or s group by trade_date"""


VALUE_WEIGHT = "greatest(coalesce(market_cap, 0), 0)"
