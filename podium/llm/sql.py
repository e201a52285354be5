"""DuckDB SQL of the longer queries of this subpackage."""

from __future__ import annotations

RESAMPLING = r"""
    with recursive table_ as (
        -- the 256 remainders of one byte, by the rule of the polynomial
        select list(list_reduce(list_prepend(b, range(8)), lambda c, k: xor(c >> 1, 3988292384 * (c & 1))) order by b) as t
        from range(256) as r(b)
    ),
    words as (
        select kind, id, unnest(regexp_extract_all(
            translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as word
        from (select 's' as kind, doc_id as id, text from documents union all select 't', item_id, text from benchmark)
    ),
    counted as (select kind, id, word, count(*) as n from words group by all),
    hashed as (
        select word, xor(4294967295, list_reduce(
            list_prepend(4294967295::bigint, list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::bigint)),
            lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 10000 as bucket
        from (select distinct word, hex(encode(word)) as h from counted), table_
    ),
    buckets as (
        select bucket, coalesce(sum(n) filter (kind = 's'), 0)::double as s, coalesce(sum(n) filter (kind = 't'), 0)::double as t
        from counted join hashed using (word) group by bucket
    ),
    gains as (
        select bucket, floor(1000 * ln((t + 1) * (sum(s) over () + 10000) / ((s + 1) * (sum(t) over () + 10000))))::bigint as gain
        from buckets
    ),
    weights as (
        select id, sum(n)::bigint as n, sum(n * gain)::bigint as weight
        from counted join hashed using (word) join gains using (bucket) where kind = 's' group by id
    ),
    scored as (
        select doc_id, coalesce(n, 0) as n_features, coalesce(weight, 0) as weight,
            coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('2024:' || doc_id)[1:8])::bigint + 0.5::double) / 4294967296)))::bigint as score
        from documents left join weights on doc_id = id
    ),
    drawn as (
        select *, row_number() over (partition by n_features >= 20 order by score desc, doc_id) as place,
            sum((n_features >= 20)::int) over () as n_enough
        from scored
    )
    select doc_id, n_features, weight, score, case when n_features >= 20 and place <= 10 * n_enough // 100 then place end as rank from drawn
"""


def clustering(clusters: int = 40, rounds: int = 5, width: int = 64, scale: int = 256, seed: int = 2) -> str:
    """All rounds one after the other, each as two steps of a chain."""
    steps = [
        f"""kept as materialized (
            select vec_id, list_transform(embedding, lambda x: floor({scale} * x::double)::bigint) as v, row_number() over () as place
            from embeddings
            where len(embedding) = {width} and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = {width}
        )""",
        f"""c0 as materialized (
            select row_number() over (order by sha256('{seed}:' || vec_id)) - 1 as cluster, v as c from kept
            qualify cluster < {clusters}
        )""",
    ]
    for k in range(rounds + 1):
        steps.append(
            f"""a{k} as materialized (
                select place, any_value(vec_id) as vec_id, any_value(v) as v, arg_min(cluster, (d, cluster)) as cluster, min(d) as distance
                from (select *, list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as d from kept, c{k})
                group by place
            )"""
        )
        if k < rounds:
            steps.append(
                f"""c{k + 1} as materialized (
                    select cluster, coalesce(moved, c) as c from c{k} left join (
                        select cluster, list(mean order by dim) as moved from (
                            select cluster, dim, floor(sum(v[dim])::double / count(*))::bigint as mean
                            from a{k}, range(1, {width} + 1) as r(dim) group by cluster, dim
                        ) group by cluster
                    ) using (cluster)
                )"""
            )
    return f"""
        with {", ".join(steps)}
        select vec_id, cluster::int as cluster, distance, sum(distance) over (partition by cluster)::bigint as cluster_inertia,
            sum(distance) over ()::bigint as inertia, sha256(array_to_string(c, ',')) as centroid_sha256
        from a{rounds} join c{rounds} using (cluster)
    """


_PART = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
_LUHN = """list_sum(list_transform(range(length(s.d)), lambda i: (s.d[length(s.d) - i]::int * (1 + i % 2)) % 10 + (s.d[length(s.d) - i]::int * (1 + i % 2)) // 10)) % 10 = 0"""
_MOD97 = """list_reduce(list_prepend(0, list_transform(string_split(s.account[5:] || s.account[1:4], ''), lambda c: ascii(c))),
    lambda r, c: (r * case when c < 58 then 10 else 100 end + c - case when c < 58 then 48 else 55 end) % 97) = 1"""
_APART = r"s.alone and not regexp_matches(s.before, '{}') and not regexp_matches(s.after, '{}')"
_NUMBER = (r"[0-9][ .()-]*$|[A-Za-z._%+@-]$|\+[0-9 ().-]*$", r"^[ .-]?[0-9]|^[A-Za-z_%+@-]")
_SSN = (r"[0-9][ -]?$|[A-Za-z._%+@-]$|\+[0-9 ().-]*$", r"^[ -]?[0-9]|^[A-Za-z_%+@-]")
#: Kind, whether it is a base kind, pattern, test, score of form and checksum, words.
_KINDS = [
    ("email", True, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true", 1, ""),
    ("ip", True, r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", rf"regexp_matches(s.m, '^{_PART}(?:\.{_PART}){{3}}$')", 1, ""),
    ("card", True, r"[0-9](?:[\x20-]?[0-9])+", f"case when length(s.d) between 13 and 19 then {_LUHN} else false end", 1, ""),
    ("phone", True, r"\+[0-9][\x20().0-9-]+[0-9]", "length(s.d) between 9 and 15", 1, ""),
    (
        "iban", False, r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?",
        f"case when length(s.account) between 15 and 34 and {_APART.format('[A-Za-z0-9]$', '^[A-Za-z0-9]')} then {_MOD97} else false end",
        0.9, "iban|account|konto|compte|cuenta",
    ),
    (
        "ssn", False, "[0-9]{3}-[0-9]{2}-[0-9]{4}", f"not regexp_matches(s.m, '^(?:000|666|9)|-00-|-0000$') and {_APART.format(*_SSN)}",
        0.5, "ssn|social security",
    ),
    (
        "phone_national", False, r"\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}", _APART.format(*_NUMBER),
        0.5, "phone|tel|call|fax|mobil|llam",
    ),
]


def personal_data() -> str:
    found = []
    for k, (name, base, pattern, test, score, words) in enumerate(_KINDS):
        if score < 0.75:
            test = rf"({test}) and regexp_matches(lower(s.before), '(?:^|[^\p{{L}}])(?:{words})')"
        found.append(f"""
            select {k} as kind_at, {base} as base, doc_id, list_transform(list_filter(list_transform(range(1, len(ms) + 1), lambda i: struct_pack(
                m := ms[i], d := regexp_replace(ms[i], '[^0-9]', '', 'g'), account := replace(ms[i], ' ', ''),
                before := right(gs[i], 40), after := left(gs[i + 1], 2),
                alone := (length(gs[i]) > 0 or i = 1) and (length(gs[i + 1]) > 0 or i = len(ms)),
                start := list_sum(list_transform(gs[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda g: length(g))), 0)
            )), lambda s: {test}),
            lambda s: struct_pack(kind := '{name}', start_at := s.start::bigint, end_at := (s.start + length(s.m))::bigint)) as spans
            from (
                select doc_id, regexp_extract_all(coalesce(text, ''), '{pattern}') as ms,
                    regexp_split_to_array(coalesce(text, ''), '{pattern}') as gs from documents
            )
        """)
    listed = "coalesce(string_agg(kind || ':' || start_at || ':' || end_at, ',' order by kind_at, start_at){}, '')"
    count = "count(*) filter (kind = '{0}') as n_{0}"
    return f"""
        with found as ({" union all ".join(found)}),
        spans as (select doc_id, kind_at, base, unnest(spans, recursive := true) from found)
        select doc_id, {", ".join(count.format(k) for k in ("email", "ip", "card", "phone"))},
            sha256({listed.format(" filter (base)")}) as base_sha256, {listed.format("")} as spans
        from documents left join spans using (doc_id) group by doc_id
    """

