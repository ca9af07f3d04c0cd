"""Pieces of the DuckDB SQL that the queries are held against."""

from __future__ import annotations


def r(e: str, places: int = 6) -> str:
    """Rounded, without negative zeros."""
    return f"(case when abs({e}) < {5 * 10 ** -(places + 1):.8f} then 0.0::double else round({e}, {places}) end)"


def uniform(*name: str) -> str:
    """A draw of :mod:`tilewright.functions.seeded`; the name's parts are SQL."""
    return f"(('0x' || substr(md5(concat_ws(':', {', '.join(name)})), 1, 13))::bigint / 4503599627370496.0)"


def normal(*name: str) -> str:
    return f"(sqrt(-2 * ln(1 - {uniform(*name, '0')})) * cos(2 * pi() * {uniform(*name, '1')}))"


E = "e as (select vec_id as i, label, list_transform(embedding, lambda x: x::double) as v from embeddings)"
X = "x as (select vec_id as i, label, generate_subscripts(embedding, 1) - 1 as j, unnest(embedding)::double as v from embeddings)"
PX = "px as (select i as id, 0 as c, (j // 8)::int as y, (j % 8)::int as x, v from x)"


def solve(source: str, n: int | str, name: str = "gj") -> str:
    """Gauss-Jordan elimination of the rows (g, i from 1, r) of positive definite systems with their right-hand sides."""
    return f"""{name}(g, k, i, r) as (
        select g, 0, i, r from {source}
        union all
        select a.g, a.k + 1, a.i,
          case when a.i = p.i then list_transform(p.r, lambda x: x / p.r[p.i])
          else list_transform(list_zip(a.r, p.r), lambda z: z[1] - a.r[p.i] / p.r[p.i] * z[2]) end
        from {name} a join {name} p on p.g = a.g and p.k = a.k and p.i = a.k + 1 where a.k < {n})"""


def moments(source: str) -> str:
    """CTEs m (j, m) of means and c (j, k, v) of the population covariance of a table (i, j, v)."""
    return f"""m as (select j, avg(v) as m from {source} group by j), n as (select count(distinct i) as n from {source}),
      c as (select s.j, s.k, s.v / n.n - a.m * b.m as v from (select a.j, b.j as k, sum(a.v * b.v) as v from {source} a join {source} b using (i) group by all) s
            join m a on a.j = s.j join m b on b.j = s.k cross join n)"""


def inverse(source: str, n: int, name: str = "iv") -> str:
    """CTEs up to the rows (i from 1, r) of the inverse of a positive definite table (j, k, v)."""
    return f"""{name}_0 as (select 0 as g, (j + 1)::int as i, list_concat(list(v order by k), list(case when j = k then 1.0::double else 0.0::double end order by k)) as r from {source} group by j),
      {solve(f"{name}_0", n, f"{name}_gj")}, {name} as materialized (select i, r[{n + 1}:] as r from {name}_gj where k = {n})"""


def softmax_steps(steps: int, reg: float, last: str) -> str:
    """CTEs of softmax regression on embeddings by steps in the metric X'X / n + reg I, from 0; ``last`` (j, class, w)."""
    out = f"""{X}, n as (select count(*) as n from embeddings), cls as (select unnest(range((select max(label) + 1 from embeddings)))::int as class),
      a as (select a.j, b.j as k, sum(a.v * b.v) / any_value(n.n) + case when a.j = b.j then {reg} else 0 end as v from x a join x b using (i), n group by a.j, b.j),
      {inverse('a', 64)}, w0 as (select j, class, 0.0::double as w from (select distinct j from x), cls)"""
    for t in range(steps):
        to = last if t == steps - 1 else f"w{t + 1}"
        out += f""",
      s{t} as materialized (select i, label, class, sum(v * w) as s from x join w{t} using (j) group by all),
      e{t} as materialized (select i, label, class, exp(s - max(s) over (partition by i)) as e from s{t}),
      p{t} as materialized (select i, class, e / sum(e) over (partition by i) - case when label = class then 1 else 0 end as p from e{t}),
      g{t} as materialized (select j, class, sum(v * p) / any_value(n.n) as g from x join p{t} using (i), n group by j, class),
      h{t} as materialized (select class, list(g + {reg} * w order by j) as g from g{t} join w{t} using (j, class) group by class),
      {to} as materialized (select j, class, w - list_dot_product(iv.r, h.g) as w from w{t} join iv on iv.i = j + 1 join h{t} h using (class))"""
    return out


def mixture_steps(k: int, steps: int, floor: float = 1e-3) -> str:
    """CTEs of EM of a diagonal mixture of embeddings; at last g{steps} (c, j, share, mu, var)."""
    out = f"""{X}, z as (select i, row_number() over (order by md5(concat_ws(':', '0', i)), i) - 1 as c from (select distinct i from x) qualify c < {k}),
      g0 as (select c, j, 1.0 / {k} as share, v as mu, 1.0::double as var from x join z using (i))"""
    for t in range(steps):
        out += f""",
      l{t} as materialized (select x.i, c, ln(any_value(share)) - 0.5 * sum(ln(2 * pi() * var) + (v - mu) * (v - mu) / var) as l from x join g{t} using (j) group by x.i, c),
      r{t} as materialized (select i, c, exp(l - max(l) over (partition by i)) as q from l{t}),
      q{t} as materialized (select i, c, q / sum(q) over (partition by i) as q from r{t}),
      g{t + 1} as materialized (select c, j, sum(q) / (select sum(q) from q{t}) as share, sum(q * v) / sum(q) as mu, greatest(sum(q * v * v) / sum(q) - power(sum(q * v) / sum(q), 2), {floor}) as var
        from q{t} join x using (i) group by c, j)"""
    return out


def ridge(regs: str, where: str = "true") -> str:
    """CTEs up to w (g, j, label, w) and s (g, i, label, class, s) of ridge models of embeddings; regs: values rows."""
    return f"""{X}, regs(g) as (values {regs}),
      cls as (select unnest(range((select max(label) + 1 from embeddings)))::int as class),
      tr as (select * from x where {where}),
      xtx as (select a.j, b.j as k, sum(a.v * b.v) as v from tr a join tr b using (i) group by all),
      xty as (select j, label, sum(v) as v from tr group by all),
      xtyf as (select j, class, coalesce(v, 0) as v from (select distinct j from tr) cross join cls left join xty using (j) where xty.label is null or xty.label = class),
      rhs as (select t.j, list(coalesce(xty.v, 0) order by cls.class) as b from (select distinct j from tr) t cross join cls left join xty on xty.j = t.j and xty.label = cls.class group by t.j),
      m as (select g, (j + 1)::int as i, list_concat(list(xtx.v + case when j = k then g else 0 end order by k), any_value(rhs.b)) as r
            from xtx join rhs using (j) cross join regs group by g, j),
      {solve("m", 64)},
      w as (select g, (i - 1)::int as j, generate_subscripts(r[65:], 1) - 1 as class, unnest(r[65:]) as w from gj where k = 64),
      s as (select g, i, label, class, sum(v * w) as s from x join w using (j) group by all),
      pred as (select g, i, label, arg_max(class, s) as pred from (select * from s order by class) group by all)"""
