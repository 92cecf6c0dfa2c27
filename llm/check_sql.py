"""Check SQL of operators whose statements are built from repeated steps."""

from __future__ import annotations


def vector_codes(parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1_024) -> str:
    """Rounds of nearest entries and means, one pair of steps after the other."""
    steps = [f"""
        v as materialized (select row_number() over () as r, vec_id, label,
            list_transform(embedding, lambda x: cast(floor({scale} * cast(x as double)) as bigint)) as v
          from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        p as materialized (select r, part, v[len(v) * part // {parts} + 1 : len(v) * (part + 1) // {parts}] as x
          from v, range({parts}) as t(part)),
        f as (select r, row_number() over (order by vec_id) - 1 as entry from v qualify entry < {entries}),
        b0 as materialized (select part, entry, x from p join f using (r))"""]
    for turn in range(rounds + 1):
        steps.append(f"""
        d{turn} as (select r, p.part, entry, cast(list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))
            as bigint) as away from p join b{turn} as b on p.part = b.part),
        a{turn} as materialized (select r, part, arg_min(entry, away * {entries} + entry) as entry, min(away) as away
          from d{turn} group by r, part)""")
        if turn < rounds:
            steps.append(f"""
        u{turn} as (select part, entry, unnest(x) as value, generate_subscripts(x, 1) as place from a{turn} join p using (r, part)),
        m{turn} as (select part, entry, place, cast(floor(sum(value) / count(*)) as bigint) as value from u{turn} group by all),
        n{turn} as (select part, entry, list(value order by place) as x from m{turn} group by all),
        b{turn + 1} as materialized (select part, entry, coalesce(n{turn}.x, b{turn}.x) as x from b{turn} left join n{turn} using (part, entry))""")
    return f"""with {",".join(steps)},
        c as (select r, string_agg(format('{{:02x}}', entry), '' order by part) as code, cast(sum(away) as bigint) as error
          from a{rounds} group by r),
        k as (select sha256(string_agg(array_to_string(x, ','), ',' order by part, entry)) as codebooks_sha256 from b{rounds})
        select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, codebooks_sha256
        from v join c using (r), k"""
