"""Expressions that Spark SQL and DuckDB spell differently, so that one query text serves both."""

from __future__ import annotations


class Spark:
    name = "spark"
    replace = staticmethod(lambda x, p, r: f"regexp_replace({x}, r'{p}', '{r}')")
    matches = staticmethod(lambda x, p: f"regexp_like({x}, r'{p}')")
    count = staticmethod(lambda x, p: f"regexp_count({x}, r'{p}')")
    sha = staticmethod(lambda x: f"sha2({x}, 256)")
    split = staticmethod(lambda x, p: f"split({x}, r'{p}')")
    keep = staticmethod(lambda a, v, c: f"filter({a}, {v} -> {c})")
    each = staticmethod(lambda a, v, e: f"transform({a}, {v} -> {e})")
    size = staticmethod(lambda a: f"size({a})")
    distinct = staticmethod(lambda a: f"array_distinct({a})")
    overlap = staticmethod(lambda a, b: f"size(array_intersect({a}, {b}))")
    strings = staticmethod(lambda xs: "array(" + ", ".join(f"'{x}'" for x in xs) + ")")
    slice = staticmethod(lambda a, i, n: f"slice({a}, {i}, {n})")
    join = staticmethod(lambda a, s: f"array_join({a}, '{s}')")
    series = staticmethod(lambda a, b: f"explode(sequence({a}, {b}))")
    explode = staticmethod(lambda a: f"explode({a})")
    concat_ordered = staticmethod(lambda x, s, o: f"array_join(transform(array_sort(collect_list(struct({o} as o, {x} as x))), e -> e.x), {s})")
    newline = "chr(10)"
    div = staticmethod(lambda a, b: f"(({a}) div ({b}))")
    dot = staticmethod(lambda a, b: f"aggregate(zip_with({a}, {b}, (x, y) -> cast(x as double) * cast(y as double)), 0D, (s, x) -> s + x)")
    u64 = staticmethod(lambda x: f"cast(conv(array_join(reverse(regexp_extract_all(substring(sha2({x}, 256), 1, 16), '..', 0)), ''), 16, 10) as decimal(20, 0))")
    unit = staticmethod(lambda x: f"(cast(floor({Spark.u64(x)} / 2048) as double) / 9007199254740992.0D)")
    values = staticmethod(lambda rows, names: f"(select * from values {rows} as v({names}))")
    element = staticmethod(lambda a, i: f"element_at({a}, {i})")
    array = staticmethod(lambda *xs: f"array({', '.join(xs)})")
    total = staticmethod(lambda a: f"aggregate({a}, cast(0 as double), (t, v) -> t + v)")
    ordered_list = staticmethod(lambda x, o: f"transform(array_sort(collect_list(struct({o} as o, {x} as x))), e -> e.x)")
    range = staticmethod(lambda a, b: f"sequence({a}, {b})")
    found = staticmethod(lambda x, p: f"regexp_extract_all({x}, r'{p}', 0)")
    extract = staticmethod(lambda x, p: f"regexp_extract({x}, r'{p}', 1)")
    group = staticmethod(lambda k: f"${k}")
    lines = staticmethod(lambda n: "\\n" * n)
    by_parts = staticmethod(lambda x, p, between, match: f"array_join(transform(arrays_zip(split({x}, r'{p}'), regexp_extract_all({x}, r'{p}', 0)), z -> concat({between('z.`0`')}, coalesce({match('z.`1`')}, ''))), '')")


class Duck:
    name = "duck"
    replace = staticmethod(lambda x, p, r: f"regexp_replace({x}, '{p}', '{r}', 'g')")
    matches = staticmethod(lambda x, p: f"regexp_matches({x}, '{p}')")
    count = staticmethod(lambda x, p: f"len(regexp_extract_all({x}, '{p}'))")
    sha = staticmethod(lambda x: f"sha256({x})")
    split = staticmethod(lambda x, p: f"regexp_split_to_array({x}, '{p}')")
    keep = staticmethod(lambda a, v, c: f"list_filter({a}, lambda {v}: {c})")
    each = staticmethod(lambda a, v, e: f"list_transform({a}, lambda {v}: {e})")
    size = staticmethod(lambda a: f"len({a})")
    distinct = staticmethod(lambda a: f"list_distinct({a})")
    overlap = staticmethod(lambda a, b: f"len(list_intersect({a}, {b}))")
    strings = staticmethod(lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]")
    slice = staticmethod(lambda a, i, n: f"list_slice({a}, {i}, {i} + {n} - 1)")
    join = staticmethod(lambda a, s: f"array_to_string({a}, '{s}')")
    series = staticmethod(lambda a, b: f"unnest(range(({a})::bigint, ({b})::bigint + 1))")
    explode = staticmethod(lambda a: f"unnest({a})")
    concat_ordered = staticmethod(lambda x, s, o: f"string_agg({x}, {s} order by {o})")
    newline = "chr(10)"
    div = staticmethod(lambda a, b: f"(({a}) // ({b}))")
    dot = staticmethod(lambda a, b: f"list_dot_product({a}::double[], {b}::double[])")
    u64 = staticmethod(lambda x: f"(list_reduce(list_transform(range(8), lambda byte_no: ('0x' || substring(sha256({x}), 15 - 2 * byte_no, 2))::hugeint), lambda high, low: high * 256 + low))")
    unit = staticmethod(lambda x: f"(({Duck.u64(x)} // 2048)::double / 9007199254740992.0)")
    values = staticmethod(lambda rows, names: f"(select * from (values {rows}) v({names}))")
    element = staticmethod(lambda a, i: f"{a}[{i}]")
    array = staticmethod(lambda *xs: f"[{', '.join(xs)}]")
    total = staticmethod(lambda a: f"coalesce(list_sum({a}), 0)")
    ordered_list = staticmethod(lambda x, o: f"list({x} order by {o})")
    range = staticmethod(lambda a, b: f"range({a}, {b} + 1)")
    found = staticmethod(lambda x, p: f"regexp_extract_all({x}, '{p}')")
    extract = staticmethod(lambda x, p: f"regexp_extract({x}, '{p}', 1)")
    group = staticmethod(lambda k: f"\\{k}")
    lines = staticmethod(lambda n: "\n" * n)
    by_parts = staticmethod(lambda x, p, between, match: f"array_to_string(list_transform(list_zip(regexp_split_to_array({x}, '{p}'), regexp_extract_all({x}, '{p}')), lambda z: {between('z[1]')} || coalesce({match('z[2]')}, '')), '')")
