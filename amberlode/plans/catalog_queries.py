"""The queries of the asset engine by name, each with SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import semantics as S
from ..operators import catalog as C
from ..operators import duplicates as D
from ..operators import flows as X
from ..operators import health as H
from ..operators import placement as P
from ..sources import tables as T
from ..streaming import settle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

CUTOFF = "1996-01-01 00:00:00"
SITE = "ASIA"
YEAR = "1995"
OPERATIONS = {"ingest": ["signup"], "sync": ["view", "click"], "scrub": ["error"], "purge": ["purchase"], "backup": []}


def query(name: str, sql: str | None = None):
    """Register a query under its name; sql follows the model's common table expressions."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = f"with recursive {T.DUCK}{sql}"
        return f

    return add


_COPIES = """,
counted as (
  select a.hash, a.size, count(p.hash) filter (where p.state = 'present') as copies,
    count(p.hash) filter (where p.state = 'present' and r.is_offline) as offline_copies, count(p.hash) filter (where p.state = 'corrupt') as bad
  from asset a left join placement p on p.hash = a.hash left join replica r on r.replica = p.replica where a.deleted_at is null group by a.hash, a.size)
"""


def _counted(s: SparkSession, d: str) -> DataFrame:
    return H.copies(T.asset(s, d), T.placement(s, d), T.replica(s, d))


@query("health_totals", "select count(*) as assets, cast(coalesce(sum(size), 0) as bigint) as bytes from asset where deleted_at is null")
def health_totals(s, d):
    return H.totals(T.asset(s, d))


@query("health_per_replica", """select r.replica, r.is_offline, count(a.hash) filter (where p.state = 'present') as present, count(a.hash) filter (where p.state = 'missing') as missing,
  count(a.hash) filter (where p.state = 'corrupt') as corrupt, cast(coalesce(sum(a.size) filter (where p.state = 'present'), 0) as bigint) as bytes
from replica r left join placement p on p.replica = r.replica left join asset a on a.hash = p.hash and a.deleted_at is null group by r.replica, r.is_offline""")  # fmt: skip
def health_per_replica(s, d):
    return H.per_replica(T.asset(s, d), T.placement(s, d), T.replica(s, d))


@query("health_histogram", _COPIES + "select copies, count(*) as assets from counted group by copies")
def health_histogram(s, d):
    return H.histogram(_counted(s, d))


@query("health_checks", _COPIES + """select *, underprotected = 0 and corrupt = 0 and no_offline = 0 as ok from (select count(*) filter (where copies < 3) as underprotected,
  count(*) filter (where copies <= 1) as single_copy, count(*) filter (where offline_copies = 0 and exists (select 1 from replica where is_offline)) as no_offline, count(*) filter (where bad > 0) as corrupt from counted)""")  # fmt: skip
def health_checks(s, d):
    return H.checks(_counted(s, d), T.replica(s, d))


@query("never_verified", "select count(*) as never_verified from placement where state = 'present' and verified_at is null")
def never_verified(s, d):
    return H.never_verified(T.placement(s, d))


@query("copies_per_hash", "select hash, count(*) as copies from placement where state = 'present' group by hash")
def copies_per_hash(s, d):
    return H.copies_per_hash(T.placement(s, d))


@query("timeline_month", "select strftime(captured_at, '%Y') as year, strftime(captured_at, '%m') as month, count(*) as n, cast(sum(size) as bigint) as bytes from asset where captured_at is not null group by 1, 2")
def timeline_month(s, d):
    return C.timeline(T.asset(s, d))


@query("timeline_live", "select strftime(captured_at, '%Y') as year, strftime(captured_at, '%m') as month, count(*) as n, cast(sum(size) as bigint) as bytes from asset where captured_at is not null and deleted_at is null group by 1, 2")
def timeline_live(s, d):
    return C.timeline(T.asset(s, d), live_only=True)


@query("timeline_year_rollup", "select year, month, count(*) as n, cast(sum(size) as bigint) as bytes from (select strftime(captured_at, '%Y') as year, strftime(captured_at, '%m') as month, size from asset where captured_at is not null) group by rollup(year, month)")
def timeline_year_rollup(s, d):
    return C.timeline_rollup(T.asset(s, d))


@query("undated_count", "select count(*) as undated from asset where captured_at is null")
def undated_count(s, d):
    return C.undated(T.asset(s, d))


_PAGE = "hash, size, media_kind, time_source, rel_path"


@query("browse_page", f"select {_PAGE} from asset where deleted_at is null and media_kind = 'image' and strftime(captured_at, '%Y') = '{YEAR}' order by captured_at desc, rel_path desc, hash limit 200 offset 50")
def browse_page(s, d):
    return C.page(C.browse(T.asset(s, d), year=YEAR, kind="image"), 200, 50).select(*_PAGE.split(", "))


@query("browse_count", f"select count(*) as n from asset where deleted_at is null and strftime(captured_at, '%Y-%m') = '{YEAR}-03'")
def browse_count(s, d):
    return C.browse(T.asset(s, d), year=YEAR, month=3).agg(F.count("*").alias("n"))


@query("browse_undated", f"select {_PAGE} from asset where deleted_at is null and captured_at is null")
def browse_undated(s, d):
    return C.browse(T.asset(s, d), undated=True).select(*_PAGE.split(", "))


@query("trash_list", "select hash, size, strftime(deleted_at, '%Y-%m-%dT%H:%M:%S') as deleted_at from asset where deleted_at is not null")
def trash_list(s, d):
    return C.browse(T.asset(s, d), trashed=True).select("hash", "size", S.rendered(F.col("deleted_at")).alias("deleted_at"))


@query("trash_summary", f"select count(*) as n, cast(coalesce(sum(size), 0) as bigint) as bytes, strftime(min(deleted_at), '%Y-%m-%dT%H:%M:%S') as oldest, count(*) filter (where deleted_at < timestamp '{CUTOFF}') as expired from asset where deleted_at is not null")
def trash_summary(s, d):
    return C.trash_summary(T.asset(s, d), CUTOFF)


@query("asset_detail", "select a.hash, a.rel_path, count(p.hash) as placements, string_agg(p.replica || '=' || p.state, ',' order by p.replica) as states from asset a left join placement p on p.hash = a.hash group by a.hash, a.rel_path")
def asset_detail(s, d):
    states = F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "replica", "state"))), ",")
    held = T.placement(s, d).groupBy("hash").agg(F.count("*").alias("placements"), states.alias("states"))
    return T.asset(s, d).select("hash", "rel_path").join(held, "hash", "left").select("hash", "rel_path", F.coalesce("placements", F.lit(0)).alias("placements"), "states")


@query("event_tail", "select id, kind, strftime(moment, '%Y-%m-%dT%H:%M:%S') as \"at\" from event order by id desc limit 20")
def event_tail(s, d):
    return T.event(s, d).orderBy(F.desc("id")).limit(20).select("id", "kind", S.rendered(F.col("at")).alias("at"))


@query("last_run_by_kind", "select kind, strftime(max(moment), '%Y-%m-%dT%H:%M:%S') as last_at, count(*) as n from event group by kind")
def last_run_by_kind(s, d):
    return C.last_run(T.event(s, d))


_OPS = ", ".join(f"('{o}', '{k}')" for o, kinds in OPERATIONS.items() for k in (kinds or [""]))


@query("operations", f", ops(operation, kind) as (values {_OPS}) select operation, strftime(max(moment), '%Y-%m-%dT%H:%M:%S') as last_at from ops left join event on event.kind = ops.kind group by operation")
def operations(s, d):
    return C.operations(T.event(s, d), OPERATIONS)


@query("scrub_due", f"select hash, replica from placement where state = 'present' and (verified_at is null or verified_at < timestamp '{CUTOFF}')")
def scrub_due(s, d):
    return C.scrub_due(T.placement(s, d), CUTOFF).select("hash", "replica")


@query("scrub_next", f"select hash, replica from placement where state = 'present' and replica in ('ASIA', 'EUROPE') and (verified_at is null or verified_at < timestamp '{CUTOFF}') order by verified_at nulls first, hash, replica limit 500")
def scrub_next(s, d):
    return C.oldest_first(C.scrub_due(T.placement(s, d), CUTOFF, ["ASIA", "EUROPE"]), 500).select("hash", "replica")


@query("staleness", "select kind, cast(floor(date_diff('second', max(moment), timestamp '2024-03-01 00:00:00') / 86400.0) as bigint) as days from event group by kind")
def staleness(s, d):
    last = T.event(s, d).groupBy("kind").agg(F.max("at").alias("at"))
    return last.select("kind", S.stale_days(F.col("at"), F.lit("2024-03-01 00:00:00").cast("timestamp_ntz")).alias("days"))


@query("missing_on_replica", f"select hash, size, rel_path from asset a where deleted_at is null and not exists (select 1 from placement p where p.hash = a.hash and p.replica = '{SITE}' and p.state = 'present')")
def missing_on_replica(s, d):
    return C.missing_on(T.asset(s, d), T.placement(s, d), SITE).select("hash", "size", "rel_path")


_SCORE = """,
scored as (select a.hash, a.size, r.replica, r.is_offline,
  -r.weight / ln((cast(cast('0x' || substr(sha256(a.hash || ':' || r.replica), 1, 16) as ubigint) as double) + 1) / 18446744073709551617.0) as score
  from asset a join replica r on r.is_shard),
ranked as (select *, row_number() over (partition by hash order by score desc, replica) as rank from scored),
plan as (select hash, size, replica, cast(rank as integer) as rank from ranked where rank <= 2)
"""


def _shards(s, d):
    return T.replica(s, d).where("is_shard")


@query("plan_rendezvous_top2", _SCORE + "select hash, replica, rank from plan")
def plan_rendezvous_top2(s, d):
    return P.plan(T.asset(s, d), _shards(s, d), 2).select("hash", "replica", "rank")


@query("plan_offline_swap", _SCORE + """, kept as (select *, bool_or(is_offline and rank <= 2) over (partition by hash) as has, min(case when is_offline then rank end) over (partition by hash) as best from ranked)
select hash, replica, cast(case when rank > 2 then 2 else rank end as integer) as rank from kept where (has and rank <= 2) or (not has and (rank < 2 or rank = best))""")  # fmt: skip
def plan_offline_swap(s, d):
    return P.plan(T.asset(s, d), _shards(s, d), 2, require_offline=True).select("hash", "replica", "rank")


@query("plan_stats", _SCORE + "select replica, count(*) as files, cast(sum(size) as bigint) as bytes from plan group by replica")
def plan_stats(s, d):
    return P.plan_stats(P.plan(T.asset(s, d), _shards(s, d), 2))


@query("plan_overflow", _SCORE + "select replica, files, bytes, cast(1000000000 as bigint) as capacity from (select replica, count(*) as files, cast(sum(size) as bigint) as bytes from plan group by replica) where bytes > 1000000000")
def plan_overflow(s, d):
    capacity = {r["replica"]: 10**9 for r in _shards(s, d).select("replica").collect()}
    return P.overflowing(P.plan(T.asset(s, d), _shards(s, d), 2), capacity).withColumn("capacity", F.col("capacity").cast("bigint"))


@query("plan_moved_fraction", _SCORE + """, few as (select * from (select *, row_number() over (partition by hash order by score desc, replica) as k from scored where replica <> 'MIDDLE EAST') where k <= 2)
select count(*) filter (where not exists (select 1 from few f where f.hash = p.hash and f.replica = p.replica)) as moved, count(*) as total from plan p""")  # fmt: skip
def plan_moved_fraction(s, d):
    a, shards = T.asset(s, d), _shards(s, d)
    return P.moved(P.plan(a, shards.where("replica <> 'MIDDLE EAST'"), 2), P.plan(a, shards, 2))


@query("push_list", _SCORE + f"select a.hash, a.size from asset a join plan p on p.hash = a.hash and p.replica = '{SITE}' where deleted_at is null and not exists (select 1 from placement q where q.hash = a.hash and q.replica = '{SITE}' and q.state = 'present')")
def push_list(s, d):
    a = T.asset(s, d)
    return C.missing_on(a, T.placement(s, d), SITE).join(P.plan(a, _shards(s, d), 2).where(F.col("replica") == SITE).select("hash"), "hash", "left_semi").select("hash", "size")


@query("surplus_on_replica", _SCORE + f""", held as (select hash, replica from placement where state = 'present')
select h.hash, count(o.hash) as others, count(o.hash) >= 1 as removable from held h left join held o on o.hash = h.hash and o.replica <> h.replica
where h.replica = '{SITE}' and not exists (select 1 from plan p where p.hash = h.hash and p.replica = '{SITE}') group by h.hash""")  # fmt: skip
def surplus_on_replica(s, d):
    return P.surplus(T.placement(s, d), P.plan(T.asset(s, d), _shards(s, d), 2), SITE, 1)


@query("reconcile_merge", _SCORE + f""", rows as (
  select a.hash, q.state as old, a.o_orderkey % 3 = 0 as here, p.hash is not null as wanted
  from asset a left join placement q on q.hash = a.hash and q.replica = '{SITE}' left join plan p on p.hash = a.hash and p.replica = '{SITE}'),
new as (select *, case when here then 'present' when wanted and old = 'corrupt' then 'corrupt' when wanted then 'missing' end as new from rows)
select hash, old, new, case when new is null then 'delete' when old is null then 'insert' when old <> new then 'update' else 'keep' end as action from new where old is not null or new is not null""")  # fmt: skip
def reconcile_merge(s, d):
    a = T.asset(s, d)
    listing = a.where("o_orderkey % 3 = 0").select("rel_path")
    return C.reconcile(a, T.placement(s, d), listing, P.plan(a, _shards(s, d), 2).where(F.col("replica") == SITE), SITE)


@query("repair_source", """, good as (select hash, arg_min(replica, place) as source from disk where actual = hash group by hash)
select b.hash, b.replica as broken, source from placement b left join good g on g.hash = b.hash where b.state = 'corrupt'""")  # fmt: skip
def repair_source(s, d):
    good = X.good_copies(T.disk(s, d).drop("place"), T.replica(s, d).select("replica", "place"))
    return T.placement(s, d).where("state = 'corrupt'").select("hash", F.col("replica").alias("broken")).join(good.select("hash", "source"), "hash", "left")


@query("dedup_first_seen", "select hash, min(doc_id) as doc_id, '/scan/' || cast(min(doc_id) as varchar) as abs_path, count(*) as files, min(size) as size from source_file group by hash")
def dedup_first_seen(s, d):
    return C.first_seen(T.source_file(s, d))


@query("dedup_source_audit", "select device, count(*) as files, count(distinct hash) as contents, cast(sum(size) as bigint) as bytes from source_file group by device")
def dedup_source_audit(s, d):
    return T.source_file(s, d).groupBy("device").agg(F.count("*").alias("files"), F.countDistinct("hash").alias("contents"), F.sum("size").alias("bytes"))


@query("media_kinds", "select media_kind, ext, count(*) as n from asset group by media_kind, ext")
def media_kinds(s, d):
    return T.asset(s, d).groupBy("media_kind", "ext").agg(F.count("*").alias("n"))


@query("search_prefix_or_path", "select hash, rel_path from asset where starts_with(hash, 'ab') or starts_with(hash, '1995/06') or contains(rel_path, 'ab') or contains(rel_path, '1995/06')")
def search_prefix_or_path(s, d):
    return C.search(T.asset(s, d), ["ab", "1995/06"])


@query("weak_source_redate", "select hash, rel_path, time_source from asset where deleted_at is null and time_source in ('mtime', 'filename', 'unknown')")
def weak_source_redate(s, d):
    return T.asset(s, d).where(S.live(F.col("deleted_at")) & F.col("time_source").isin(*S.WEAK_SOURCES)).select("hash", "rel_path", "time_source")


@query("filename_date", """select hash, strftime(try_cast(y || '-' || m || '-' || d || ' 12:00:00' as timestamp), '%Y-%m-%dT%H:%M:%S') as at from (
  select hash, regexp_extract(name, p, 1) as y, regexp_extract(name, p, 2) as m, regexp_extract(name, p, 3) as d
  from (select hash, 'IMG_19991399_' || strftime(added_at, '%Y-%m-') || lpad(cast(o_orderkey % 40 as varchar), 2, '0') || '.' || ext as name, '((?:19|20)[0-9]{2})[-_.]?(0[1-9]|1[0-2])[-_.]?(0[1-9]|[12][0-9]|3[01])' as p from asset))""")  # fmt: skip
def filename_date(s, d):
    name = F.concat(F.lit("IMG_19991399_"), F.date_format("added_at", "yyyy-MM-"), F.lpad((F.col("o_orderkey") % 40).cast("string"), 2, "0"), F.lit("."), F.col("ext"))
    return T.asset(s, d).select("hash", S.rendered(S.filename_date(name)).alias("at"))


@query("capture_time", """select hash, case when e is not null then 'exif' when m is not null then 'mtime' else 'unknown' end as label, strftime(coalesce(e, m), '%Y-%m-%dT%H:%M:%S') as at from (
  select hash, case when time_source = 'exif' and year(captured_at) <= 1996 then captured_at end as e, case when year(added_at) <= 1996 then added_at end as m from asset)""")  # fmt: skip
def capture_time(s, d):
    exif = F.when(F.col("time_source") == "exif", F.col("captured_at"))
    found = S.capture_time([("exif", exif), ("mtime", F.col("added_at"))], 1995)
    return T.asset(s, d).select("hash", found.alias("x")).select("hash", F.col("x.label").alias("label"), S.rendered(F.col("x.at")).alias("at"))


@query("human_sizes", """select hash, case when size * 9000 < 1048576 then printf('%.1f KB', size * 9000 / 1024.0) when size * 9000 < 1073741824 then printf('%.1f MB', size * 9000 / 1048576.0)
  else printf('%.1f GB', size * 9000 / 1073741824.0) end as shown from asset""")  # fmt: skip
def human_sizes(s, d):
    return T.asset(s, d).select("hash", S.human_size(F.col("size") * 9000).alias("shown"))


_GRID = """,
firsts as (select sha256(text) as hash, min(doc_id) as doc_id from documents group by 1),
tokens as (select f.hash, unnest(string_split_regex(lower(d.text), '[^a-z0-9]+')) as token from firsts f join documents d using (doc_id)),
cells as (select hash, cast(cast('0x' || substr(md5(token), 1, 4) as integer) % 72 as integer) as cell, count(*) as n from tokens where token <> '' group by 1, 2),
places as (select cast(unnest(range(64)) as integer) as p),
bits as (select h.hash, coalesce(bit_or(case when coalesce(l.n, 0) > coalesce(r.n, 0) then cast(1 as ubigint) << cast(63 - p as ubigint) else cast(0 as ubigint) end), 0) as bits
  from (select distinct hash from cells) h cross join places
  left join cells l on l.hash = h.hash and l.cell = p // 8 * 9 + p % 8 left join cells r on r.hash = h.hash and r.cell = p // 8 * 9 + p % 8 + 1 group by h.hash),
hashed as (select hash, bits, lpad(lower(to_hex(bits)), 16, '0') as phash from bits where bit_count(bits) between 5 and 59)
"""
_BANDS = _GRID + """,
bands as (select hash, bits, cast(b as integer) as band, substr(phash, cast(2 * b + 1 as bigint), 2) as part from hashed, (select unnest(range(8)) as b)),
buckets as (select band, part, count(*) as n from bands group by band, part having count(*) between 2 and 400),
pairs as (select distinct x.hash as a, y.hash as b, cast(bit_count(xor(x.bits, y.bits)) as integer) as distance
  from bands x join bands y on x.band = y.band and x.part = y.part and x.hash < y.hash join buckets k on k.band = x.band and k.part = x.part where bit_count(xor(x.bits, y.bits)) <= 5)
"""
_GROUPS = _BANDS + """,
ends as (select a, b from pairs union select b, a from pairs),
reach(hash, root) as (select a, a from ends union select e.b, r.root from reach r join ends e on e.a = r.hash),
grouped as (select hash, min(root) as root from reach group by hash)
"""
_KEEP = _GROUPS + """,
placed as (select g.hash, g.root, f.size, row_number() over (partition by g.root order by f.size desc, f.doc_id) as place from grouped g join (select hash, min(doc_id) as doc_id, min(size) as size from source_file group by hash) f using (hash))
"""
#: With buckets of any size.
_KEEP_WHOLE = _KEEP.replace("having count(*) between 2 and 400", "having count(*) >= 2")


def _hashed(s, d):
    return D.hashes(D.text_grids(T.read(s, d, "documents")))


@query("phash_bits", _GRID + "select hash, phash from hashed")
def phash_bits(s, d):
    return _hashed(s, d).select("hash", "phash")


@query("band_buckets", _BANDS + "select band, part, n from buckets")
def band_buckets(s, d):
    return D.bands(_hashed(s, d)).groupBy("band", "part").agg(F.count("*").alias("n")).where(F.col("n").between(2, D.BUCKET_MOST))


@query("near_dup_pairs", _BANDS + "select a, b, distance from pairs")
def near_dup_pairs(s, d):
    return D.pairs(_hashed(s, d)).select("a", "b", F.col("distance").cast("int").alias("distance"))


@query("near_dup_groups", _GROUPS + "select hash, root from grouped")
def near_dup_groups(s, d):
    return D.groups(D.pairs(_hashed(s, d)))


def _ranked(s, d, whole=False):
    files = C.first_seen(T.source_file(s, d))
    members = files.select("hash", F.col("size").alias("pixels"), F.col("size"), F.lpad(F.col("doc_id").cast("string"), 20, "0").alias("captured_at"))
    return D.keepers(D.whole_groups(_hashed(s, d)) if whole else D.groups(D.pairs(_hashed(s, d))), members)


@query("keeper_rank", _KEEP + "select hash, root, cast(place as integer) as place, place = 1 as keeper from placed")
def keeper_rank(s, d):
    return _ranked(s, d).select("hash", "root", "place", "keeper")


@query("wasted_bytes", _KEEP_WHOLE + "select root, count(*) as members, cast(sum(case when place = 1 then 0 else size end) as bigint) as wasted_bytes from placed group by root")
def wasted_bytes(s, d):
    return D.wasted(_ranked(s, d, whole=True))


_MARKS = """,
marks as (select sha256(d.text) as hash, max(case when l.quality = 0 then 1 else 0 end) as bad from labels l join documents d using (doc_id) group by 1),
stock as (select hash, count(distinct device) as copies from source_file group by hash),
judged as (select p.hash, p.root, p.place, coalesce(m.bad, 0) = 1 as marked, coalesce(s.copies, 0) as copies from placed p left join marks m using (hash) left join stock s using (hash)),
kept as (select *, min(case when not marked then place end) over (partition by root) as first from judged),
gate as (select k.*, (select j.copies from judged j where j.root = k.root and j.place = k.first) as held from kept k)
"""


@query("dup_apply_outcome", _KEEP + _MARKS + "select hash, root, case when not marked then 'untouched' when first is null then 'refused_all_marked' when held < 1 then 'refused_unverified' else 'deleted' end as outcome from gate")
def dup_apply_outcome(s, d):
    docs = T.read(s, d, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("hash"))
    marks = T.read(s, d, "labels").join(docs, "doc_id").groupBy("hash").agg(F.max(F.when(F.col("quality") == 0, "delete")).alias("action"))
    stock = T.source_file(s, d).groupBy("hash").agg(F.countDistinct("device").alias("copies"))
    return D.apply_outcome(_ranked(s, d), marks, stock, 1)


@query("backup_retention", "select owner, kind, name, cast(place as integer) as place, place > 5 as pruned from (select *, row_number() over (partition by owner, kind order by name desc) as place from (select distinct cast(user_id % 50 as bigint) as owner, kind, strftime(moment, '%Y%m%d-%H%M%S') as name from event))")
def backup_retention(s, d):
    shots = T.event(s, d).select((F.col("user_id") % 50).alias("owner"), "kind", F.date_format("at", "yyyyMMdd-HHmmss").alias("name")).distinct()
    return C.retention(shots, 5)


@query("reclaim_outcome", """, files as (select cast(id as bigint) as file, sha256(cast(id * 4 as varchar)) as hash from event),
verified as (select hash, count(*) as copies from placement where state = 'present' and verified_at is not null group by hash)
select file, case when a.hash is null then 'not_imported' when coalesce(v.copies, 0) < 1 then 'short' else 'safe' end as outcome from files f left join asset a on a.hash = f.hash left join verified v on v.hash = f.hash""")  # fmt: skip
def reclaim_outcome(s, d):
    files = T.event(s, d).select(F.col("id").alias("file"), F.sha2((F.col("id") * 4).cast("string").cast("binary"), 256).alias("hash"))
    verified = T.placement(s, d).where("state = 'present' and verified_at is not null").groupBy("hash").agg(F.count("*").alias("copies"))
    return C.reclaim(files, T.asset(s, d), verified, 1).select("file", "outcome")


@query("settle_sessions", """, marked as (select user_id, moment, case when moment - lag(moment) over (partition by user_id order by moment) <= interval 6 hours then 0 else 1 end as fresh from event),
numbered as (select *, sum(fresh) over (partition by user_id order by moment rows unbounded preceding) as session from marked)
select user_id, strftime(min(moment), '%Y-%m-%dT%H:%M:%S') as first_at, strftime(max(moment), '%Y-%m-%dT%H:%M:%S') as last_at, count(*) as changes from numbered group by user_id, session""")  # fmt: skip
def settle_sessions(s, d):
    return settle.sessions(T.event(s, d), 6 * 3600)


@query("state_as_of", f", past as (select *, row_number() over (partition by user_id order by moment desc, id desc) as k from event where moment < timestamp '2024-01-15 00:00:00') select user_id, id, kind from past where k = 1")
def state_as_of(s, d):
    past = T.event(s, d).where(F.col("at") < F.lit("2024-01-15 00:00:00").cast("timestamp_ntz"))
    return past.groupBy("user_id").agg(F.max(F.struct("at", "id", "kind")).alias("x")).select("user_id", F.col("x.id").alias("id"), F.col("x.kind").alias("kind"))


_PHOTOS = "case when id % 2 = 0 then '/library/' else '/other/' end || cast(id as varchar) || '.jpg'"


@query("album_manifest", f"""select kind as album, count(*) as photo_count,
  string_agg('f' || cast(id as varchar) || '|' || case when id % 2 = 0 then substr({_PHOTOS}, 10) else {_PHOTOS} end || '|' || md5(cast(id as varchar)), ',' order by id) as photos from event group by kind""")
def album_manifest(s, d):
    path = F.concat(F.when(F.col("id") % 2 == 0, "/library/").otherwise("/other/"), F.col("id").cast("string"), F.lit(".jpg"))
    photos = T.event(s, d).select(F.col("kind").alias("album"), F.col("id").alias("place"), F.concat(F.lit("f"), F.col("id").cast("string")).alias("file"), path.alias("path"), F.md5(F.col("id").cast("string").cast("binary")).alias("checksum"))
    flat = F.array_join(F.transform("photos", lambda x: F.concat_ws("|", x["file"], x["library_path"], x["checksum"])), ",")
    return X.manifest(photos, "/library/").select("album", "photo_count", flat.alias("photos"))


from . import flow_queries  # noqa: E402, F401  registers the dataflows
