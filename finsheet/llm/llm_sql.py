"""SQL of the corpus queries that SQL can say: the same answers by all strings, all pairs of lines or all pairs of documents."""

from __future__ import annotations

#: Every string of 50 bytes of every text, as hexadecimal digits.
OP2 = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
s as (select doc_id, unnest(range(0, length(h) // 2 - 49)) as i, unnest(list_transform(range(0, length(h) // 2 - 49), lambda i: substr(h, 2 * i + 1, 100))) as string from d),
m as (select string, min(doc_id) as low from s group by string),
r as (select doc_id, i, case when i > lag(i) over (partition by doc_id order by i) + 50 then 1 else 0 end as new from s join m using (string) where low < doc_id),
n as (select doc_id, i, sum(new) over (partition by doc_id order by i) as run from r),
runs as (select doc_id, min(i) as a, max(i) + 50 as b from n group by doc_id, run),
gaps as (select doc_id, coalesce(lag(b) over (partition by doc_id order by a), 0) as x, a as y from runs union all select doc_id, max(b), null from runs group by doc_id),
kept as (select g.doc_id, string_agg(substr(h, 2 * x + 1, 2 * (coalesce(y, length(h) // 2) - x)), '' order by x) as h from gaps g join d using (doc_id) group by g.doc_id),
sums as (select doc_id, sum(b - a) as n_removed, count(*) as n_spans from runs group by doc_id)
select d.doc_id, cast(length(d.h) // 2 as bigint) as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed, cast(coalesce(n_spans, 0) as bigint) as n_spans, sha256(unhex(coalesce(kept.h, d.h))) as kept_sha256
from d left join sums using (doc_id) left join kept using (doc_id)
"""

#: Lines that share a shingle are compared; components by their smallest member.
OP3 = """
with recursive d as (select doc_id, text, string_split(text, chr(10)) as lines from documents),
l as (select doc_id, unnest(range(1, len(lines) + 1)) as pos, unnest(lines) as line from d where text is not null),
n as (select doc_id, pos, trim(regexp_replace(lower(line), '\\s+', ' ', 'g'), ' ') as k from l),
k as (select doc_id, pos, k from n where k <> ''),
keys as (select distinct k from k),
g as (select distinct k, substr(k, i, 9) as s from keys, unnest(range(1, greatest(1, length(k) - 8) + 1)) as t(i)),
size as (select k, count(*) as n from g group by k),
common as (select a.k as a, b.k as b, count(*) as c from g a join g b on a.s = b.s and a.k < b.k group by a.k, b.k),
link as (select a, b from common join size x on x.k = a join size y on y.k = b where c >= 0.8 * (x.n + y.n - c) - 1e-9),
both_ways as (select a, b from link union all select b, a from link),
reach as (select a as k, a as r from both_ways union select reach.k, b from reach join both_ways on reach.r = both_ways.a),
part as (select k, min(r) as p from reach group by k),
placed as (select doc_id, pos, coalesce(p, k.k) as p from k left join part on part.k = k.k),
gone as (select doc_id, pos from (select doc_id, pos, row_number() over (partition by p order by doc_id, pos) as i from placed) where i > 1),
kept as (select l.doc_id, string_agg(line, chr(10) order by l.pos) as text, count(gone.pos) as n_gone from l left join gone on gone.doc_id = l.doc_id and gone.pos = l.pos group by l.doc_id, ''),
left_ as (select l.doc_id, string_agg(line, chr(10) order by l.pos) as text from l left join gone on gone.doc_id = l.doc_id and gone.pos = l.pos where gone.pos is null group by l.doc_id)
select d.doc_id, cast(case when d.text is null then 0 else len(lines) end as integer) as n_lines, cast(coalesce(n_gone, 0) as integer) as n_removed, sha256(coalesce(left_.text, '')) as kept_sha256
from d left join kept using (doc_id) left join left_ using (doc_id)
"""

#: Documents that share a shingle are compared; copies are documents like others here.
OP9 = """
with recursive w as (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[0-9A-Za-z_\\x{80}-\\x{10FFFF}]+') as w from documents),
g as (
  select distinct doc_id, case when len(w) < 5 then array_to_string(w, ' ') else array_to_string(w[i:i + 4], ' ') end as s
  from w, unnest(range(1, greatest(1, len(w) - 4) + 1)) as t(i) where len(w) > 0
),
size as (select doc_id, count(*) as n from g group by doc_id),
common as (select a.doc_id as a, b.doc_id as b, count(*) as c from g a join g b on a.s = b.s and a.doc_id <> b.doc_id group by a.doc_id, b.doc_id),
link as (select a, b, c = x.n and c = y.n as same from common join size x on x.doc_id = a join size y on y.doc_id = b where c >= 0.8 * (x.n + y.n - c) - 1e-6),
reach as (select a as k, a as r from link union select reach.k, b from reach join link on reach.r = link.a),
part as (select k, min(r) as p from reach group by k),
links as (select a, count(*) as n, min(b) filter (where same) as twin from link group by a)
select w.doc_id, coalesce(p, w.doc_id) as class_id, coalesce(links.n, 0) as n_links, least(w.doc_id, coalesce(twin, w.doc_id)) as rep_id, coalesce(size.n, 0) as n_shingles
from w left join part on part.k = w.doc_id left join links on links.a = w.doc_id left join size using (doc_id)
"""

#: Every rule against every URL.
OP11 = """
with rules(h, p, v) as (values ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
a as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
u as (select page_id, row_number() over () as i, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from a),
best as (select i, max_by(h || p, length(h || p)) as rule, max_by(v, length(h || p)) as verdict from u join rules on (host = h or suffix(host, '.' || h)) and starts_with(path, p) group by i)
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from u left join best using (i)
"""


def _codes() -> str:
    """Lloyd's rounds as one chain of tables, every part against every entry."""
    steps = [
        "with recursive k as (select vec_id, label, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as x from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0)",
        "named as materialized (select vec_id, label, x, row_number() over (order by vec_id, x) as r from k)",
        "v as materialized (select r, part, list_slice(x, part * len(x) // 4 + 1, (part + 1) * len(x) // 4) as y from named, range(4) as t(part))",
        "c0 as materialized (select part, r - 1 as e, y as c from v where r <= 256)",
    ]
    for i in range(5):
        distance = "list_sum(list_transform(list_zip(y, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
        steps.append(f"d{i} as materialized (select r, part, min(({distance}, e)) as m from v join c{i} using (part) group by r, part)")
        if i < 4:
            steps.append(f"u{i} as (select part, e, j, cast(floor(sum(y[j]) / count(*)) as bigint) as z from (select part, m[2] as e, y, unnest(range(1, len(y) + 1)) as j from d{i} join v using (r, part)) group by part, e, j)")
            steps.append(f"c{i + 1} as materialized (select part, e, coalesce(n.c, o.c) as c from c{i} o left join (select part, e, list(z order by j) as c from u{i} group by part, e) n using (part, e))")
    steps += [
        "codes as (select r, string_agg(lower(printf('%02x', m[2])), '' order by part) as code, cast(sum(m[1]) as bigint) as error from d4 group by r)",
        "labels_ as (select label, sum(error) as label_error from named join codes using (r) group by label)",
        "book as (select sha256(string_agg(array_to_string(c, ','), ',' order by part, e)) as codebooks_sha256 from c4)",
    ]
    return ",\n".join(steps) + "\nselect vec_id, code, error, cast(label_error as bigint) as label_error, codebooks_sha256 from named n join codes using (r) join labels_ l on n.label is not distinct from l.label, book"


OP12 = _codes()

#: Bitwise crc32 of each distinct word; no dictionary, every occurrence joined with its bucket's gain.
OP13 = """
with w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents),
o as (select doc_id, unnest(w) as f from w),
q as (select unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) as f from benchmark),
bytes as (select f, hex(encode(f)) as h from (select f from o union select f from q)),
crc as (
  select f, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(0, length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::bigint)),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: case when x & 1 = 1 then xor(x >> 1, 3988292384::bigint) else x >> 1 end)), 4294967295::bigint) % 10000 as b
  from bytes
),
s as (select b, count(*) as s from o join crc using (f) group by b),
t as (select b, count(*) as t from q join crc using (f) group by b),
n as (select (select count(*) from o) as s, (select count(*) from q) as t),
gain as (select b, cast(floor(1000 * ln((coalesce(t.t, 0) + 1.0::double) * (n.s + 10000.0::double) / ((s.s + 1.0::double) * (n.t + 10000.0::double)))) as bigint) as g from s left join t using (b), n),
weight as (select doc_id, sum(g) as weight from o join crc using (f) join gain using (b) group by doc_id),
h as (select doc_id, len(w) as n, ('0x' || substr(sha256('2024:' || doc_id), 1, 8))::bigint as h from w),
scored as (select doc_id, n, cast(coalesce(weight, 0) as bigint) as weight, cast(coalesce(weight, 0) as bigint) + cast(floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296::double))) as bigint) as score from h left join weight using (doc_id)),
placed as (select doc_id, row_number() over (order by score desc, doc_id) as r from scored where n >= 20)
select doc_id, cast(n as bigint) as n_features, weight, score, case when r <= 10 * (select count(*) from placed) // 100 then r end as rank, cast(n as bigint) as n_words
from scored left join placed using (doc_id)
"""
