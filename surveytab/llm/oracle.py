"""SQL for DuckDB that gives the rows of the registered queries."""

NGRAM_JACCARD_JOIN = r"""
with recursive words as (
  select doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') as w
  from documents),
shingles as (
  select doc_id, list_distinct(case
    when len(w) >= 5 then [array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)]
    when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s
  from words),
sizes as (select doc_id, cast(len(s) as bigint) as n_shingles from shingles),
exploded as (select doc_id, unnest(s) as g from shingles),
common as (
  select a.doc_id as a, b.doc_id as b, count(*) as shared
  from exploded a join exploded b on a.g = b.g and a.doc_id < b.doc_id group by all),
links as (
  select a, b from common join sizes x on x.doc_id = a join sizes y on y.doc_id = b
  where 100 * shared >= 75 * (x.n_shingles + y.n_shingles - shared)),
ways as (select a, b from links union all select b, a from links),
reach(doc_id, other) as (
  select doc_id, doc_id from sizes
  union select r.doc_id, w.b from reach r join ways w on w.a = r.other)
select doc_id, any_value(n_shingles) as n_shingles, min(other) as component_id
from reach join sizes using (doc_id) group by doc_id
"""

def _split(level: int) -> str:
    """A level of the splitting tree: half of each node's units, by their keyed hash, go left."""
    return f"""
nodes{level + 1} as (
  select source, unit, node * 2 + case when row_number() over (partition by node
      order by md5('mix|split {level}|' || node || '|' || coalesce(source, chr(0)) || '|' || unit), unit)
    <= (count(*) over (partition by node) + 1) // 2 then 0 else 1 end as node
  from nodes{level}),"""


# Draws are in the order of the operator's hashes, which are MD5 of the same text here.
MIXING = r"""
with sized as (
  select row_number() over () as r, doc_id, source,
    cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size,
    md5('mix|document|' || coalesce(cast(doc_id as varchar), 'null')) as place
  from documents),
sources as (
  select source, sum(size) as source_size,
    cast([5, 2, 1][(row_number() over (order by source nulls last) - 1) % 3 + 1] as double) as weight
  from sized group by source),
stops as (
  select *, cast(source_size as double) * 2 as stop, cast(source_size as double) * 2 / weight as stop_at
  from sources),
levels as (
  select *, (cast(sum(source_size) over () as double) * 1.5 - coalesce(sum(stop) over below, 0))
    / (sum(weight) over () - coalesce(sum(weight) over below, 0)) as level
  from stops
  window below as (order by stop_at, source nulls last rows between unbounded preceding and 1 preceding)),
level as (select *, max(case when level <= stop_at then level end) over () as water from levels),
targets as (
  select source, cast(source_size as bigint) as source_size,
    case when water is null or stop_at <= water then stop else weight * water end as target
  from level),
blocks as (select source, place[1:3] as block, sum(size) as words from sized group by all having sum(size) > 0),
units as (
  select * from (
    select b.source, block, epoch, epoch || '/' || block as unit, target,
      sum(words) over by_epoch - words as begins, row_number() over by_epoch - 1 as rank
    from blocks b join targets t on t.source is not distinct from b.source, (values (1), (2)) as epochs(epoch)
    window by_epoch as (partition by b.source order by epoch, md5('mix|block|' || epoch || '|' || block), block
      rows between unbounded preceding and current row))
  where begins < target),
nodes0 as (select source, unit, 0 as node from units),""" + "".join(map(_split, range(4))) + r"""
quotas as (select source, node as shard, count(*) as quota from nodes4 group by all),
runs as (
  select *, sum(quota) over (partition by source order by shard rows between unbounded preceding and current row) as till
  from quotas),
dealt as (
  select u.source, epoch, block, shard from units u
  join runs q on q.source is not distinct from u.source and rank < till and rank >= till - quota),
draws as (
  select r, source, size, epoch, place[1:3] as block, sum(size) over (
    partition by source order by epoch, md5('mix|block|' || epoch || '|' || place[1:3]), place[1:3],
      md5('mix|inside|' || epoch || '|' || place), size
    rows between unbounded preceding and current row) - size / 2.0 as middle
  from sized, (values (1), (2)) as epochs(epoch) where size > 0),
taken as (
  select r, cast(sum(size) as bigint) as taken, string_agg(cast(shard as varchar), ',' order by draws.epoch) as shards
  from draws join targets on targets.source is not distinct from draws.source
  join dealt on dealt.source is not distinct from draws.source and dealt.epoch = draws.epoch and dealt.block = draws.block
  where middle <= target group by r)
select doc_id, size, source_size, target, coalesce(taken, 0) as taken, coalesce(shards, '') as shards
from sized join targets on targets.source is not distinct from sized.source left join taken using (r)
"""

# CRC-32 by its rule: a table of the bytes, and a step per byte of each different word.
IMPORTANCE_RESAMPLING = r"""
with steps as (
  select list(list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z:
    case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end) order by b) as step
  from (select cast(range as bigint) as b from range(256))),
words as (
  select doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents),
target as (
  select unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as f
  from benchmark),
exploded as (select doc_id, unnest(w) as f from words),
in_documents as (select f, count(*) as n from exploded group by f),
in_target as (select f, count(*) as n from target group by f),
vocabulary as (select f from in_documents union select f from in_target),
hashed as (
  select f, xor(list_reduce(
    list_prepend(4294967295, list_transform(range(length(hex(f)) // 2), lambda i:
      cast(('0x' || substr(hex(f), cast(2 * i + 1 as bigint), 2)) as bigint))),
    lambda c, b: xor(c // 256, step[xor(c, b) % 256 + 1])), 4294967295) % 10000 as bucket
  from vocabulary, steps),
counts as (
  select bucket, cast(coalesce(sum(d.n), 0) as double) as s, cast(coalesce(sum(t.n), 0) as double) as t
  from hashed left join in_documents d using (f) left join in_target t using (f) group by bucket),
wholes as (select sum(s) + 10000 as s_all, sum(t) + 10000 as t_all from counts),
gains as (
  select bucket, cast(floor(1000 * ln((t + 1) * s_all / ((s + 1) * t_all))) as bigint) as gain
  from counts, wholes),
weights as (
  select doc_id, cast(sum(n * gain) as bigint) as weight
  from (select doc_id, f, count(*) as n from exploded group by all) join hashed using (f) join gains using (bucket)
  group by doc_id),
scored as (
  select doc_id, cast(len(w) as bigint) as n_features, coalesce(weight, 0) as weight,
    coalesce(weight, 0) + cast(floor(-1000 * ln(-ln((cast(('0x' || substr(sha256('2024:' || doc_id), 1, 8)) as bigint) + 0.5)
      / 4294967296::double))) as bigint) as score
  from words left join weights using (doc_id)),
ranks as (
  select doc_id, row_number() over (order by score desc, doc_id) as place, count(*) over () as n
  from scored where n_features >= 20)
select s.doc_id, n_features, weight, score, case when place <= 10 * n // 100 then place end as rank
from scored s left join ranks using (doc_id)
"""
