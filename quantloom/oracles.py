"""DuckDB SQL of the iterative methods, as common table expressions over log2 cells c(entity, ion, sample, quant).

A recursive term carries all cells and their effects from round to round; window functions take the place of matrix rows and columns.
"""

from __future__ import annotations


def level(fit: str, out: str) -> tuple[str, ...]:
    """out: the fit's estimates shifted so that their mean is that of all data; an entity of one ion keeps its values."""
    return (
        f"{out}_k as (select entity, avg(quant) as mu, count(distinct ion) as ions from c group by entity)",
        f"{out}_e as (select entity, avg(estimate) as mean from {fit} group by entity)",
        f"{out} as (select f.entity, f.sample, case when ions = 1 then quant else estimate + mu - mean end as estimate from {fit} f join {out}_k using (entity) join {out}_e using (entity) left join c on ions = 1 and c.entity = f.entity and c.sample = f.sample)",
    )


def polish(out: str, eps: float, rounds: int, weights: str | None = None) -> tuple[str, ...]:
    """out(entity, sample, estimate): medians of ions and samples in turn, until the sum of absolute residuals stands still.

    weights: a table (entity, ion, w) for the samples' medians.
    """
    source = f"select c.*, w from c join {weights} using (entity, ion)" if weights else "select *, 1.0::double as w from c"
    if weights:
        ranked = "select *, sum(w) over (o rows unbounded preceding) as reached, sum(w) over (partition by entity, sample) as all_w, lead(r) over o as after, row_number() over o as nth from (select *, round(quant - e, 10) as r from {0}) window o as (partition by entity, sample order by r, w)"
        effect = "select * exclude (r, reached, all_w, after, nth, p), max(case when nth = p then coalesce((reached * r + (all_w - reached) * after) / all_w, r) end) over (partition by entity, sample) as c from (select *, min(case when 2 * reached >= all_w then nth end) over (partition by entity, sample) as p from (" + ranked + "))"
    else:
        effect = "select *, median(quant - e) over (partition by entity, sample) as c from {0}"
    ions = f"(select * exclude (c, e), median(quant - c) over (partition by entity, ion) as e from {out}_r where not done and k < {rounds})"
    return (
        f"""{out}_r as (
select 0 as k, entity, ion, sample, quant, w, 0.0::double as c, 0.0::double as e, 0.0::double as t, false as done from ({source})
union all
select k + 1, entity, ion, sample, quant, w, c, e, total, total = 0 or abs(total - t) < {eps} * total from (
  select *, sum(abs(quant - e - c)) over (partition by entity) as total from ({effect.format(ions)})))""",
        f"{out}_l as (select * from {out}_r where done or k = {rounds})",
        f"{out}_o as (select entity, median(e) as o from (select entity, ion, any_value(e) as e from {out}_l group by all) group by entity)",
        f"{out} as (select entity, sample, any_value(c) + any_value(o) as estimate from {out}_l join {out}_o using (entity) group by entity, sample)",
    )


def huber(out: str, rounds: int = 400, k: float = 1.345, weights: str | None = None) -> tuple[str, ...]:
    """out(entity, sample, estimate): the fixed point of reweighting, one sweep of ions and samples a round, with the MAD as scale."""
    source = f"select c.*, w from c join {weights} using (entity, ion)" if weights else "select *, 1.0::double as w from c"
    return (
        f"""{out}_r as (
select 0 as k, entity, ion, sample, quant, w as own, w, 0.0::double as c from ({source})
union all
select k + 1, entity, ion, sample, quant, own, own * least(1, {k} * s / greatest(abs(r), 1e-300)), c from (
  select *, 1.4826 * median(abs(r - m)) over (partition by entity) as s from (
    select *, median(r) over (partition by entity) as m from (
      select *, quant - e - c as r from (
        select *, sum(w * (quant - e)) over (partition by entity, sample) / sum(w) over (partition by entity, sample) as c from (
          select * exclude (c), sum(w * (quant - c)) over (partition by entity, ion) / sum(w) over (partition by entity, ion) as e from {out}_r where k < {rounds}))))))""",
        f"{out} as (select entity, sample, any_value(c) as estimate from {out}_r where k = {rounds} group by entity, sample)",
    )


def ion_weights(fit: str, out: str, k: float = 1.345, min_m: int = 15) -> tuple[str, ...]:
    """out(entity, ion, w): Huber weights of ions by how far each strays from the fit's profile."""
    return (
        f"{out}_d as (select entity, ion, case when count(*) > 1 then sqrt((select count(distinct sample) from c) * var_pop(quant - estimate)) end as d from c join {fit} using (entity, sample) group by entity, ion)",
        f"{out}_m as (select entity, median(d) as m, count(*) as ions from {out}_d group by entity)",
        f"{out}_s as (select entity, any_value(ions) as ions, 1.4826 * median(abs(d - m)) as s from {out}_d join {out}_m using (entity) group by entity)",
        f"{out} as (select entity, ion, case when s is null or s < 1e-10 or ions < {min_m} or d is null or d <= {k} * s then 1.0 else {k} * s / d end as w from {out}_d join {out}_s using (entity))",
    )


def chosen(fit: str, again: str, out: str, min_m: int = 15) -> tuple[str, ...]:
    """out: the weighted estimates of entities of min_m ions and more, and the first ones of others."""
    return (
        f"{out}_n as (select entity, count(distinct ion) as ions from c group by entity)",
        f"{out} as (select f.entity, f.sample, case when ions >= {min_m} then a.estimate else f.estimate end as estimate from {fit} f join {again} a using (entity, sample) join {out}_n using (entity))",
    )


def weighted_ratios(weights: str, out: str) -> tuple[str, ...]:
    """out(entity, sample_a, sample_b, ratio, n_ions): weighted medians of what samples differ by, over the ions they share."""
    return (
        f"{out}_d as (select a.entity, a.sample as sample_a, b.sample as sample_b, b.quant - a.quant as d, w from c a join c b on a.entity = b.entity and a.ion = b.ion and a.sample < b.sample join {weights} x on x.entity = a.entity and x.ion = a.ion)",
        f"{out}_c as (select *, sum(w) over (o rows unbounded preceding) as reached, sum(w) over (partition by entity, sample_a, sample_b) as all_w, lead(d) over o as after, row_number() over o as nth from {out}_d window o as (partition by entity, sample_a, sample_b order by d, w))",
        f"{out} as (select entity, sample_a, sample_b, min_by(coalesce((reached * d + (all_w - reached) * after) / all_w, d), nth) filter (2 * reached >= all_w) as ratio, count(*) as n_ions from {out}_c group by all)",
    )


def least_squares(ratios: str, labels: str, out: str, rounds: int = 600) -> tuple[str, ...]:
    """out(entity, sample, estimate): MaxLFQ of any components, whose ratios are met by lazy averages over a sample's neighbours.

    labels: entity, sample, component. A component of one sample takes its median.
    """
    return (
        f"{out}_n as (select entity, sample_a as sample, sample_b as other, ratio as d from {ratios} union all select entity, sample_b, sample_a, -ratio from {ratios})",
        f"{out}_e as (select entity, sample, list(struct_pack(o := other, d := d)) as near from {out}_n group by all)",
        f"""{out}_r as (
select 0 as k, entity, sample, 0.0::double as x from {out}_e
union all
select k + 1, entity, sample, (any_value(x) + avg(y - d)) / 2 from (
  select a.k, a.entity, a.sample, a.x, b.x as y, n.d from {out}_r a join {out}_n n on n.entity = a.entity and n.sample = a.sample join {out}_r b on b.k = a.k and b.entity = a.entity and b.sample = n.other where a.k < {rounds})
group by k, entity, sample)""",
        f"{out}_x as (select r.entity, r.sample, component, x from {out}_r r join {labels} using (entity, sample) where k = {rounds})",
        f"{out}_m as (select entity, component, avg(quant) as mu, median(quant) as middle from c join {labels} using (entity, sample) group by all)",
        f"{out}_c as (select entity, component, avg(x) as mean from {out}_x group by all)",
        f"{out} as (select entity, sample, x - mean + mu as estimate from {out}_x join {out}_c using (entity, component) join {out}_m using (entity, component) union all select distinct c.entity, c.sample, middle from c join {labels} using (entity, sample) join {out}_m using (entity, component) left join {out}_e e on e.entity = c.entity and e.sample = c.sample where e.entity is null)",
    )
