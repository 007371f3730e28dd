"""Queries on the difference between a stored snapshot and a listing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entry_queries.derived import SMALL_FILE, SNAPSHOTS_SQL, components_sql, hashed, listing, state, table
from kindred.operators import snapshot_diff as diff
from kindred.operators.clustering import init_groups
from kindred.operators.numbering import assign_ids
from kindred.plans.thresholds import ALLOWED_THRESHOLDS, max_distance
from kindred.runs import sync
from kindred.sources.listing import IMAGE_EXTENSIONS, extension, is_image
from kindred.sources.scratch import Scratch
from kindred.sources.snapshots import SnapshotStore, has_missing_group, records_for_paths

THRESHOLD = 95


def _shown(name):
    """A missing id shown as -1."""
    return F.coalesce(name, F.lit(-1).cast("bigint")).alias(name)


def extension_filter(spark, sf_dir):
    """Documents named after language and source, URLs of pages as they are."""
    docs = table(spark, sf_dir, "documents")
    suffix = (
        F.when(F.col("lang") == "de", ".JPG").when(F.col("lang") == "en", ".tar.Png")
        .when(F.col("lang") == "es", ".mp4").otherwise("")
    )
    stem = F.when(F.col("source") == "src1", "").otherwise(F.col("doc_id").cast("string"))
    path = F.concat(F.lit("/a.d/"), stem, suffix)
    named = docs.select(path.alias("path")).unionByName(table(spark, sf_dir, "pages").select(F.col("url").alias("path")))
    return named.select("path", extension(F.col("path")).alias("ext"), is_image(F.col("path")).alias("is_image"))


def sync_actions(spark, sf_dir):
    found = diff.diff_snapshots(state(spark, sf_dir), listing(spark, sf_dir))
    return found.select("path", "size", "modified_ns", _shown("image_id"), "action")


def sync_new(spark, sf_dir):
    return diff.new_files(state(spark, sf_dir), listing(spark, sf_dir)).select("path")


def sync_modified(spark, sf_dir):
    return diff.modified_files(state(spark, sf_dir), listing(spark, sf_dir)).select("path")


def sync_to_hash(spark, sf_dir):
    return diff.files_to_hash(state(spark, sf_dir), listing(spark, sf_dir))


def sync_removed(spark, sf_dir):
    return diff.removed_files(state(spark, sf_dir), listing(spark, sf_dir)).select("path")


def _hashed(spark, sf_dir):
    return hashed(diff.files_to_hash(state(spark, sf_dir), listing(spark, sf_dir)))


def sync_stale(spark, sf_dir):
    removed = diff.removed_files(state(spark, sf_dir), listing(spark, sf_dir))
    return diff.stale_paths(removed, diff.unreadable(_hashed(spark, sf_dir)))


def sync_new_ok(spark, sf_dir):
    return diff.hashed_new_paths(diff.new_files(state(spark, sf_dir), listing(spark, sf_dir)), _hashed(spark, sf_dir))


def state_scan(spark, sf_dir):
    return state(spark, sf_dir).select("path", "size", "modified_ns", "phash")


def records(spark, sf_dir):
    """Stored rows of the modified paths."""
    stored = state(spark, sf_dir)
    found = records_for_paths(stored, diff.modified_files(stored, listing(spark, sf_dir)))
    return found.withColumn("group_id", _shown("group_id"))


def _changed(spark, sf_dir):
    """Hashed rows with the id they keep or get."""
    scratch = Scratch(spark)
    stored = state(spark, sf_dir)
    good = scratch.keep(_hashed(spark, sf_dir).where("phash is not null").drop("error"), "good")
    kept = good.join(stored.select("path", "image_id"), "path")
    new = good.join(stored.select("path"), "path", "left_anti")
    return kept.unionByName(assign_ids(new, stored, scratch))


def new_ids(spark, sf_dir):
    stored = state(spark, sf_dir)
    new = diff.new_files(stored, listing(spark, sf_dir))
    return assign_ids(new.select("path"), stored, Scratch(spark)).select("path", "image_id")


def state_upsert(spark, sf_dir):
    found = diff.upsert(state(spark, sf_dir), _changed(spark, sf_dir))
    return found.withColumn("group_id", _shown("group_id"))


def state_delete(spark, sf_dir):
    found = diff.delete(state(spark, sf_dir), sync_stale(spark, sf_dir))
    return found.withColumn("group_id", _shown("group_id"))


def groups_started(spark, sf_dir):
    """After upsert, new rows are labelled with their own id."""
    stored = state(spark, sf_dir)
    new = sync_new_ok(spark, sf_dir)
    found = init_groups(diff.upsert(stored, _changed(spark, sf_dir)), new)
    return found.select("path", "image_id", _shown("group_id"))


def rebuild_decision(spark, sf_dir):
    """Decisions over parts of the actions, for every saved threshold."""
    actions = diff.diff_snapshots(state(spark, sf_dir), listing(spark, sf_dir))
    found = [
        diff.rebuild_decision(actions.where(condition), saved, THRESHOLD).select(
            F.lit(part).alias("part"), F.lit(saved).cast("bigint").alias("saved"), "*"
        )
        for part, condition in ACTION_PARTS.items()
        for saved in ALLOWED_THRESHOLDS
    ]
    return reduce(DataFrame.unionByName, found)


def sync_runs(spark, sf_dir):
    """Two runs over a real store: the stored files, then the current ones."""
    scratch = Scratch(spark)
    store = SnapshotStore(spark, scratch.folder("state"))
    for files in (state(spark, sf_dir).select("path", "size", "modified_ns"), listing(spark, sf_dir)):
        sync(spark, files, store, hashed, THRESHOLD, scratch)
    current = store.manifest()
    saved = F.lit(current.threshold).cast("bigint").alias("threshold")
    return store.read(current).select("path", "size", "modified_ns", "image_id", "phash", "group_id", saved)


def missing_groups(spark, sf_dir):
    return has_missing_group(state(spark, sf_dir))


def run_report(spark, sf_dir):
    actions = diff.diff_snapshots(state(spark, sf_dir), listing(spark, sf_dir))
    return diff.run_counters(actions, _hashed(spark, sf_dir))


_ASSIGNED = """
good as (select path, size, modified_ns, phash from hashed where phash is not null),
fresh as (
  select path, (select max(image_id) from state) + row_number() over (order by path) as image_id
  from good where path not in (select path from state)),
changed as (
  select coalesce(s.image_id, f.image_id)::bigint as image_id, path, g.size, g.modified_ns, g.phash
  from good g left join state s using (path) left join fresh f using (path)),
upserted as (
  select * from state where path not in (select path from changed)
  union all select image_id, path, size, modified_ns, phash, null::bigint from changed)
"""
_WITH = f"with {SNAPSHOTS_SQL} "
_RUNS = f"""with recursive {SNAPSHOTS_SQL},
first_run as materialized (
  select path, size, modified_ns, size * 40503 as h, row_number() over (order by path) as img_id
  from state where size >= {SMALL_FILE}),
later as (
  select l.path, l.size, l.modified_ns, f.img_id,
    case when f.size = l.size and f.modified_ns = l.modified_ns then f.h else l.size * 40503 end as h
  from listing l left join first_run f on f.path = l.path where l.size >= {SMALL_FILE}),
final as materialized (
  select path, size, modified_ns, h, img_id from later where img_id is not null
  union all
  select path, size, modified_ns, h,
    (select max(img_id) from first_run) + row_number() over (order by path) from later where img_id is null),
{components_sql('final', max_distance(THRESHOLD))}
select path, size, modified_ns, img_id::bigint as image_id, h::bigint as phash, group_id::bigint as group_id,
  {THRESHOLD}::bigint as threshold
from final join comp using (img_id)"""
# Parts of the actions with different decisions.
ACTION_PARTS = {
    "all": "true",
    "changed": "action in ('new', 'modified')",
    "gone": "action in ('new', 'removed')",
    "added": "action = 'new' or (action = 'unchanged' and group_id is not null)",
    "ungrouped": "action = 'unchanged'",
}
_PARTS = " union all ".join(f"select '{part}' as part, * from actions where {c}" for part, c in ACTION_PARTS.items())
_SUFFIX = "lower(regexp_extract(path, '[^/](\\.[^./]+)$', 1))"
_IMAGES = ", ".join(f"'{suffix}'" for suffix in IMAGE_EXTENSIONS)

QUERIES = {
    "extension_filter": (
        extension_filter,
        f"""with p as (
          select '/a.d/' || case when source = 'src1' then '' else doc_id::varchar end ||
            case lang when 'de' then '.JPG' when 'en' then '.tar.Png' when 'es' then '.mp4' else '' end as path
          from documents union all select url from pages)
        select path, {_SUFFIX} as ext, {_SUFFIX} in ({_IMAGES}) as is_image from p""",
    ),
    "sync_actions": (sync_actions, _WITH + "select path, size, modified_ns, coalesce(image_id, -1) as image_id, action from actions"),
    "sync_new": (sync_new, _WITH + "select path from listing where path not in (select path from state)"),
    "sync_modified": (sync_modified, _WITH + "select path from actions where action = 'modified'"),
    "sync_to_hash": (
        sync_to_hash,
        _WITH + "select path, size, modified_ns from listing except select path, size, modified_ns from state",
    ),
    "sync_removed": (sync_removed, _WITH + "select path from state where path not in (select path from listing)"),
    "sync_stale": (
        sync_stale,
        _WITH + "select path from actions where action = 'removed' union select path from hashed where phash is null",
    ),
    "sync_new_ok": (
        sync_new_ok,
        _WITH + "select path from hashed join actions using (path) where hashed.phash is not null and action = 'new'",
    ),
    "state_scan": (state_scan, _WITH + "select path, size, modified_ns, phash from state"),
    "records_for_paths": (
        records,
        _WITH + "select image_id, path, phash, coalesce(group_id, -1) as group_id from state where path in "
        "(select path from actions where action = 'modified')",
    ),
    "assign_ids": (
        new_ids,
        _WITH + "select path, ((select max(image_id) from state) + row_number() over (order by path))::bigint "
        "as image_id from actions where action = 'new'",
    ),
    "state_upsert": (state_upsert, _WITH + f", {_ASSIGNED} select * replace (coalesce(group_id, -1) as group_id) from upserted"),
    "state_delete": (
        state_delete,
        _WITH + "select * replace (coalesce(group_id, -1) as group_id) from state where path not in (select path from actions where action = 'removed') "
        "and path not in (select path from hashed where phash is null)",
    ),
    "init_groups": (
        groups_started,
        _WITH + f", {_ASSIGNED} select path, image_id, case when path in (select path from fresh) "
        "then image_id else coalesce(group_id, -1) end as group_id from upserted",
    ),
    "rebuild_decision": (
        rebuild_decision,
        _WITH + f"""select part, saved::bigint as saved, bool_or(action = 'modified') as has_modified,
          bool_or(action = 'removed') as has_removed, saved <> {THRESHOLD} as threshold_changed,
          bool_or(action = 'unchanged' and group_id is null) as has_null_group,
          saved <> {THRESHOLD} or bool_or(action in ('modified', 'removed') or (action = 'unchanged' and group_id is null))
            as full_rebuild
        from ({_PARTS}) p, (values {', '.join(f'({t})' for t in ALLOWED_THRESHOLDS)}) t(saved) group by part, saved""",
    ),
    "sync_runs": (sync_runs, _RUNS),
    "missing_groups": (missing_groups, _WITH + "select bool_or(group_id is null) as has_null_group from state"),
    "run_report": (
        run_report,
        _WITH + """select count(*) filter (h.phash is not null or action = 'unchanged')::bigint as images,
          count(*) filter (action = 'unchanged')::bigint as reused,
          count(*) filter (h.phash is not null)::bigint as calculated,
          count(*) filter (h.phash is not null and action = 'new')::bigint as new_images,
          count(*) filter (h.path is not null and h.phash is null)::bigint as unreadable
        from actions a left join hashed h on h.path = a.path""",
    ),
}
