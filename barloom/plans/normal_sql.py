"""The normal distribution and what is built on it as SQL text."""

from math import e
from statistics import NormalDist


def cdf_sql(z: str) -> str:
    """Hart's approximation of the probability below ``z``; NULL stays NULL."""
    x = f"abs({z})"
    above = f"((((((3.52624965998911e-02 * {x} + 0.700383064443688) * {x} + 6.37396220353165) * {x} + 33.912866078383) * {x} + 112.079291497871) * {x} + 221.213596169931) * {x} + 220.206867912376)"
    below = f"(((((((8.83883476483184e-02 * {x} + 1.75566716318264) * {x} + 16.064177579207) * {x} + 86.7807322029461) * {x} + 296.564248779674) * {x} + 637.333633378831) * {x} + 793.826512519948) * {x} + 440.413735824752)"
    far = f"({x} + 1.0 / ({x} + 2.0 / ({x} + 3.0 / ({x} + 4.0 / ({x} + 0.65)))))"
    tail = f"(case when {x} > 37 then 0.0 when {x} < 7.07106781186547 then exp(-{x} * {x} / 2) * {above} / {below} else exp(-{x} * {x} / 2) / ({far} * 2.506628274631) end)"
    return f"(case when {z} > 0 then 1 - {tail} when {z} <= 0 then {tail} end)"


def luck_sql(n: str, most: int = 160) -> str:
    """Expected maximum of ``n`` standard normal trials, for 2 to ``most`` of them."""
    quantile, gamma = NormalDist().inv_cdf, 0.5772156649015329
    level = lambda k: (1 - gamma) * quantile(1 - 1 / k) + gamma * quantile(1 - 1 / (k * e))
    return f"(case {n} " + " ".join(f"when {k} then {level(k)!r}" for k in range(2, most + 1)) + " end)"


def deflated_sql(name: str, source: str, run: str, groups: str, declared: int = 0) -> str:
    """Tables ``{name}_mo`` (moments by run), ``{name}_lv`` (trials and luck by group) and ``{name}_df`` (both, with psr and dsr) from ``source(groups, run, ret)``."""
    by = f"{groups}, {run}" if groups else run
    join = f"join {name}_lv using ({groups})" if groups else f"cross join {name}_lv"
    over = f"over (partition by {by})"
    z = lambda bench: f"(case when n >= 3 and 1 - skew * sharpe + (kurt - 1) / 4 * sharpe * sharpe > 0 then (sharpe - {bench}) * sqrt(n - 1) / sqrt(1 - skew * sharpe + (kurt - 1) / 4 * sharpe * sharpe) end)"
    return f"""{name}_ce as (select {by}, ret, avg(ret) {over} as m from {source} where ret is not null),
{name}_mo as (select {by}, count(*) as n, case when count(*) >= 2 and stddev_samp(ret) > 1e-15 then avg(ret) / stddev_samp(ret) end as sharpe, avg((ret - m) ** 3) / pow(avg((ret - m) ** 2), 1.5) as skew, avg((ret - m) ** 4) / pow(avg((ret - m) ** 2), 2) as kurt from {name}_ce group by {by}),
{name}_lv as (select {groups + ',' if groups else ''} count(*) as trials, avg(sharpe) as mean, stddev_samp(sharpe) as std, case when count(*) >= 2 then stddev_samp(sharpe) * {luck_sql(f'greatest(count(*), {declared})')} end as sr_null from {name}_mo where sharpe is not null {'group by ' + groups if groups else ''}),
{name}_zz as (select *, {z('0')} as z0, {z('sr_null')} as z1 from {name}_mo {join}),
{name}_df as (select *, {cdf_sql('z0')} as psr, {cdf_sql('z1')} as dsr, row_number() over ({'partition by ' + groups if groups else ''} order by sharpe desc nulls last, {run}) as place from {name}_zz)"""
