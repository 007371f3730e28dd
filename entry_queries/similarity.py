"""Queries on fingerprints, similar pairs and groups of the planted variants."""

from __future__ import annotations

from pyspark.sql import functions as F

from entry_queries.derived import HASHES_SQL, components_sql, hashed_variants, table, variants
from kindred.functions.bits import block_values, hamming, hash_parts, probe_values
from kindred.functions.text_hash import hash_texts
from kindred.functions.vector_hash import hash_vectors, hex_hash
from kindred.operators import clustering, grouping, similarity
from kindred.operators.snapshot_diff import unreadable
from kindred.plans.thresholds import ALLOWED_THRESHOLDS, HASH_BITS, max_distance, max_distance_column, similarity_column
from kindred.sources.key_index import scratch_index
from kindred.sources.scratch import Scratch

PROBE_RADIUS = 2


def vector_phash(spark, sf_dir):
    h = hashed_variants(spark, sf_dir)
    return h.select(F.col("image_id").alias("img_id"), "phash", hex_hash(F.col("phash")).alias("hex"))


def parts(spark, sf_dir):
    h = hash_parts(hashed_variants(spark, sf_dir))
    names = [f"p16_{i}" for i in range(4)] + [f"p21_{i}" for i in range(3)]
    return h.select(F.col("image_id").alias("img_id"), *names)


def threshold_distance(spark, sf_dir):
    """Each variant against its original, at every threshold."""
    h = hashed_variants(spark, sf_dir)
    original = h.where("variant = 0").select((F.col("image_id") / 4).cast("bigint").alias("vec_id"), F.col("phash").alias("first"))
    pairs = h.withColumn("vec_id", F.floor(F.col("image_id") / 4)).join(original, "vec_id")
    at = F.explode(F.array(*[F.lit(t) for t in ALLOWED_THRESHOLDS])).alias("threshold")
    distance = hamming(F.col("phash"), F.col("first")).cast("bigint")
    return (
        pairs.select(F.col("image_id").alias("img_id"), distance.alias("distance"), at)
        .withColumn("similarity", similarity_column(F.col("distance")))
        .withColumn("max_distance", max_distance_column(F.col("threshold")))
        .withColumn("similar", F.col("distance") <= F.col("max_distance"))
        .withColumn("threshold", F.col("threshold").cast("bigint"))
    )


def probe_neighbours(spark, sf_dir):
    """Images whose first 16-bit part is within two bits, by mask lookup.

    Parts and counts have at most 65,536 rows, so these are broadcast; Spark would
    choose the probes, which it takes for as few as the parts they are made of.
    """
    h = hashed_variants(spark, sf_dir).withColumn("part", block_values(F.col("phash"), 4)[0])
    kept = Scratch(spark).keep(h.groupBy("part").agg(F.count("*").alias("n")), "parts")
    counts = (
        probe_values(kept.select("part"), "part", HASH_BITS // 4, PROBE_RADIUS)
        .join(F.broadcast(kept.select(F.col("part").alias("probe"), "n")), "probe")
        .groupBy("part")
        .agg(F.sum("n").alias("n_neighbours"))
    )
    return h.join(F.broadcast(counts), "part").select(F.col("image_id").alias("img_id"), "part", "n_neighbours")


def distinct_hashes(spark, sf_dir):
    return similarity.distinct_hashes(hashed_variants(spark, sf_dir))


def bucket_sizes(spark, sf_dir):
    h = hashed_variants(spark, sf_dir)
    return (
        h.select(F.posexplode(F.array(*block_values(F.col("phash"), 4))).alias("part", "value"))
        .groupBy("part", "value")
        .agg(F.count("*").alias("size"))
        .groupBy(F.col("part").cast("bigint").alias("part"))
        .agg(F.count("*").alias("n_buckets"), F.max("size").alias("max_size"))
    )


def candidate_pairs_95(spark, sf_dir):
    h = hashed_variants(spark, sf_dir)
    found = similarity.candidate_counts(h, block_values(F.col("phash"), 4), max_distance(95), Scratch(spark))
    return found.select(*[F.col(c).cast("bigint").alias(c) for c in found.columns])


# The join's forms for large data, forced at any size.
FORMS = {
    "shuffled": similarity.JoinLimits(broadcast_keys=0),
    "tiled": similarity.JoinLimits(broadcast_keys=0, bucket_rows=16, tile_rows=64),
    "rekeyed": similarity.JoinLimits(broadcast_keys=0, bucket_rows=4, rekey_rows=4, tile_rows=64),
    "listed": similarity.JoinLimits(broadcast_keys=0, bucket_rows=16, tile_rows=64, large_buckets=0),
}


def similar_pairs(threshold, limits=similarity.DEFAULT_LIMITS):
    def query(spark, sf_dir):
        scratch = Scratch(spark)
        hashes = scratch.keep(hashed_variants(spark, sf_dir), "hashes")
        pairs = similarity.similar_images(hashes, max_distance(threshold), scratch, limits)
        return pairs.withColumn("similarity", similarity_column(F.col("distance")))

    return query


def _clustered(spark, sf_dir, threshold, scratch, limits=similarity.DEFAULT_LIMITS):
    hashes = scratch.keep(hashed_variants(spark, sf_dir), "hashes")
    return clustering.cluster(hashes, threshold, scratch, limits)


def components(threshold, limits=similarity.DEFAULT_LIMITS):
    def query(spark, sf_dir):
        found = _clustered(spark, sf_dir, threshold, Scratch(spark), limits)
        return found.select(F.col("image_id").alias("img_id"), "group_id")

    return query


def groups(threshold):
    def query(spark, sf_dir):
        scratch = Scratch(spark)
        found = scratch.keep(_clustered(spark, sf_dir, threshold, scratch), "clustered")
        return grouping.group_members(found, scratch).select("id", "size", "path").orderBy("id", "path")

    return query


def group_summary(spark, sf_dir):
    return grouping.group_summary(_clustered(spark, sf_dir, 90, Scratch(spark)))


def _old_and_new(spark, sf_dir, threshold, scratch):
    """Groups of all but the first variants, and the first variants as new."""
    h = scratch.keep(hashed_variants(spark, sf_dir).select("image_id", "variant", "phash"), "hashes")
    old = clustering.cluster(h.where("variant <> 1").drop("variant"), threshold, scratch)
    new = h.where("variant = 1").drop("variant").withColumn("group_id", F.lit(None).cast("bigint"))
    return scratch.keep(old, "settled"), new


def incremental_neighbours(spark, sf_dir):
    scratch = Scratch(spark)
    old, new = _old_and_new(spark, sf_dir, 95, scratch)
    index = scratch_index(scratch.keep(old.select("phash").distinct(), "stored"), max_distance(95), scratch)
    found = clustering.new_neighbours(old, new, 95, scratch, index=index)
    return found.withColumnRenamed("image_id", "img_id")


def incremental_components(threshold, indexed=True):
    """Groups after new rows; the stored keys are in an index, or made in the run."""

    def query(spark, sf_dir):
        scratch = Scratch(spark)
        old, new = _old_and_new(spark, sf_dir, threshold, scratch)
        index = None
        if indexed:
            stored = scratch.keep(old.select("phash").distinct(), "stored")
            index = scratch_index(stored, max_distance(threshold), scratch)
        found = clustering.cluster_incremental(old, new, threshold, scratch, index=index)
        return found.select(F.col("image_id").alias("img_id"), "group_id")

    return query


def regroup_after_delete(spark, sf_dir):
    """Groups at 95% after the first variants are deleted."""
    scratch = Scratch(spark)
    h = scratch.keep(_clustered(spark, sf_dir, 95, scratch), "clustered")
    rest = h.where("variant <> 1").select("image_id", "phash", "group_id")
    found = clustering.regroup(rest, h.where("variant = 1").select("group_id"), rest.limit(0), 95, scratch)
    return found.select(F.col("image_id").alias("img_id"), "group_id")


def regroup_after_change(spark, sf_dir):
    """Groups at 95% after the first variants got their fingerprints in place of others."""
    scratch = Scratch(spark)
    h = scratch.keep(hashed_variants(spark, sf_dir).select("image_id", "variant", "phash"), "hashes")
    before = F.when(F.col("variant") == 1, F.bitwise_not(F.col("phash"))).otherwise(F.col("phash"))
    stored = scratch.keep(clustering.cluster(h.withColumn("phash", before), 95, scratch), "stored")
    rest = stored.where("variant <> 1").select("image_id", "phash", "group_id")
    changed = h.where("variant = 1").select("image_id", "phash", F.lit(None).cast("bigint").alias("group_id"))
    found = clustering.regroup(rest, stored.where("variant = 1").select("group_id"), changed, 95, scratch)
    return found.select(F.col("image_id").alias("img_id"), "group_id")


def merge_groups(spark, sf_dir):
    """Groups at 95% merged into the groups at 90%."""
    scratch = Scratch(spark)
    fine = scratch.keep(_clustered(spark, sf_dir, 95, scratch), "fine")
    coarse = _clustered(spark, sf_dir, 90, scratch).select("image_id", F.col("group_id").alias("new"))
    moves = (
        fine.where("image_id = group_id")
        .join(coarse, "image_id")
        .select(F.col("group_id").alias("old"), "new")
    )
    found = clustering.merge_groups(fine, scratch.keep(moves, "moves"), scratch)
    return found.select(F.col("image_id").alias("img_id"), "group_id")


def unreadable_vectors(spark, sf_dir):
    """Vectors of one label are missing."""
    v = variants(spark, sf_dir).withColumn("e", F.when(F.col("label") != 9, F.col("e")))
    return unreadable(hash_vectors(v, "e")).select("img_id", "error")


def document_hashes(spark, sf_dir):
    return hash_texts(table(spark, sf_dir, "documents"), "text", ["doc_id"]).select("doc_id", "phash", "error")


def document_groups(threshold):
    """Groups of documents whose text fingerprints are similar."""

    def query(spark, sf_dir):
        scratch = Scratch(spark)
        hashes = hash_texts(table(spark, sf_dir, "documents"), "text", ["doc_id"]).where("phash is not null")
        hashes = scratch.keep(hashes.select(F.col("doc_id").alias("image_id"), "phash"), "hashes")
        found = clustering.cluster(hashes, threshold, scratch)
        return found.select(F.col("image_id").alias("doc_id"), "group_id")

    return query


DOCUMENTS_SQL = r"""
w as (select doc_id, list_filter(regexp_split_to_array(lower(text), '[ \n\t]+'), lambda x: x <> '') as a
      from documents where text is not null),
sh as (select doc_id, unnest(case when len(a) < 3 then [array_to_string(a, ' ')]
       else [a[i] || ' ' || a[i + 1] || ' ' || a[i + 2] for i in range(1, len(a) - 1)] end) as g from w),
b as (select doc_id, ('0x' || substr(md5(g), 1, 8))::bigint as hi, ('0x' || substr(md5(g), 9, 8))::bigint as lo from sh),
bits as (select doc_id, p, sum(case when p < 32 then ((hi >> (31 - p)) & 1) * 2 - 1 else ((lo >> (63 - p)) & 1) * 2 - 1 end) as v
         from b, range(64) t(p) group by doc_id, p),
q as (select doc_id, sum(case when v >= 0 and p < 32 then 1::bigint << (31 - p) else 0 end)::bigint as hi,
        sum(case when v >= 0 and p >= 32 then 1::bigint << (63 - p) else 0 end)::bigint as lo
      from bits group by doc_id),
dh as materialized (
  select doc_id as img_id, (case when hi >= 2147483648 then hi - 4294967296 else hi end) * 4294967296 + lo as h from q)
"""


def _pairs_sql(k: int) -> str:
    return f"""with {HASHES_SQL},
d as materialized (select h, min(img_id) as rep from hm group by h)
select least(a.rep, b.rep) as a, greatest(a.rep, b.rep) as b,
  bit_count(xor(a.h, b.h))::bigint as distance, 100.0::double * (1.0::double - bit_count(xor(a.h, b.h)) / 64.0::double) as similarity
from d a join d b on a.h < b.h and bit_count(xor(a.h, b.h)) <= {k}
union all
select d.rep, hm.img_id, 0::bigint, 100.0::double from hm join d using (h) where img_id <> rep"""


def _components_sql(k: int, where: str = "true") -> str:
    return f"""with recursive {HASHES_SQL}, src as (select * from hm where {where}),
{components_sql('src', k)} select img_id, group_id from comp"""


def _groups_sql(k: int) -> str:
    return f"""with recursive {HASHES_SQL}, {components_sql('hm', k)},
g as (select group_id, count(*) as size, row_number() over (order by group_id) as id
      from comp group by group_id having count(*) > 1)
select g.id::bigint as id, g.size::bigint as size, hm.path
from comp join g using (group_id) join hm using (img_id) order by id, path"""


_PARTS = [f"((h >> {48 - 16 * i}) & 65535)" for i in range(4)]
_THIRDS = ["((h >> 43) & 2097151)", "((h >> 22) & 2097151)", "(h & 4194303)"]

QUERIES = {
    "vector_phash": (
        vector_phash,
        f"with {HASHES_SQL} select img_id, h as phash, printf('%016X', case when h < 0 then "
        "h::hugeint + 18446744073709551616 else h::hugeint end::ubigint) as hex from hm",
    ),
    "hash_parts": (
        parts,
        f"with {HASHES_SQL} select img_id, "
        + ", ".join(f"{e}::bigint as p16_{i}" for i, e in enumerate(_PARTS)) + ", "
        + ", ".join(f"{e}::bigint as p21_{i}" for i, e in enumerate(_THIRDS)) + " from hm",
    ),
    "threshold_distance": (
        threshold_distance,
        f"""with {HASHES_SQL}, p as (
          select x.img_id, bit_count(xor(x.h, o.h))::bigint as distance
          from hm x join hm o on o.img_id = x.img_id // 4 * 4)
        select img_id, distance, 100.0::double * (1.0::double - distance / 64.0::double) as similarity,
          t::bigint as threshold, (64 * (100 - t) // 100)::bigint as max_distance,
          distance <= 64 * (100 - t) // 100 as similar
        from p, (values (80), (90), (95), (100)) v(t)""",
    ),
    "probe_neighbours": (
        probe_neighbours,
        f"""with {HASHES_SQL}, p as (select img_id, {_PARTS[0]}::bigint as part from hm),
        c as (select part, count(*) as n from p group by part)
        select p.img_id, p.part, sum(c.n)::bigint as n_neighbours
        from p join c on bit_count(xor(p.part, c.part)) <= {PROBE_RADIUS} group by 1, 2""",
    ),
    "distinct_hashes": (
        distinct_hashes,
        f"with {HASHES_SQL} select h as phash, min(img_id) as id, count(*)::bigint as n from hm group by h",
    ),
    "bucket_sizes": (
        bucket_sizes,
        f"""with {HASHES_SQL}, b as ("""
        + " union all ".join(f"select {i} as part, {e} as value from hm" for i, e in enumerate(_PARTS))
        + """), s as (select part, value, count(*) as size from b group by 1, 2)
        select part::bigint as part, count(*)::bigint as n_buckets, max(size)::bigint as max_size from s group by 1""",
    ),
    "candidate_pairs_95": (
        candidate_pairs_95,
        f"""with {HASHES_SQL}, p as materialized (select img_id, h, """
        + ", ".join(f"{e} as q{i}" for i, e in enumerate(_PARTS))
        + """ from hm)
        select count(*)::bigint as n_candidates, count(*) filter (bit_count(xor(a.h, b.h)) <= 3)::bigint as n_verified
        from p a join p b on a.img_id < b.img_id and (a.q0 = b.q0 or a.q1 = b.q1 or a.q2 = b.q2 or a.q3 = b.q3)""",
    ),
    "group_summary": (
        group_summary,
        f"""with recursive {HASHES_SQL}, {components_sql('hm', 6)},
        g as (select count(*) as size from comp group by group_id having count(*) > 1)
        select count(*)::bigint as n_groups, coalesce(sum(size), 0)::bigint as n_images,
          coalesce(max(size), 0)::bigint as max_size from g""",
    ),
    "incremental_neighbours": (
        incremental_neighbours,
        f"""with recursive {HASHES_SQL}, old as materialized (select * from hm where variant <> 1),
        {components_sql('old', 3)}
        select distinct n.img_id, c.group_id from hm n join old on bit_count(xor(n.h, old.h)) <= 3
        join comp c on c.img_id = old.img_id where n.variant = 1""",
    ),
    "incremental_components_95": (incremental_components(95), _components_sql(3)),
    "incremental_components_90": (incremental_components(90), _components_sql(6)),
    "incremental_components_90_unindexed": (incremental_components(90, False), _components_sql(6)),
    "regroup_after_delete": (regroup_after_delete, _components_sql(3, "variant <> 1")),
    "regroup_after_change": (regroup_after_change, _components_sql(3)),
    "merge_groups": (merge_groups, _components_sql(6)),
    "document_hashes": (
        document_hashes,
        f"""with {DOCUMENTS_SQL} select doc_id, h as phash, case when h is null then 'no text' end as error
        from documents left join dh on doc_id = img_id""",
    ),
    "document_groups_90": (
        document_groups(90),
        f"""with recursive {DOCUMENTS_SQL}, {components_sql('dh', max_distance(90))}
        select img_id as doc_id, group_id from comp""",
    ),
    "unreadable": (
        unreadable_vectors,
        f"with {HASHES_SQL} select img_id, 'no vector' as error from hm where label = 9",
    ),
}
for _t in ALLOWED_THRESHOLDS:
    QUERIES[f"similar_pairs_{_t}"] = (similar_pairs(_t), _pairs_sql(max_distance(_t)))
    QUERIES[f"components_{_t}"] = (components(_t), _components_sql(max_distance(_t)))
    QUERIES[f"groups_{_t}"] = (groups(_t), _groups_sql(max_distance(_t)))
for _form, _limits in FORMS.items():
    QUERIES[f"similar_pairs_90_{_form}"] = (similar_pairs(90, _limits), _pairs_sql(max_distance(90)))
# Blocks with radii chosen from their counted values, row by row and in tiles.
RADII_FORMS = {
    "radii": similarity.JoinLimits(broadcast_keys=0, radii_blocks=8),
    "radii_tiled": similarity.JoinLimits(broadcast_keys=0, bucket_rows=64, tile_rows=64, radii_blocks=6),
}
for _form, _limits in RADII_FORMS.items():
    QUERIES[f"similar_pairs_80_{_form}"] = (similar_pairs(80, _limits), _pairs_sql(max_distance(80)))
QUERIES["components_80_radii"] = (components(80, RADII_FORMS["radii_tiled"]), _components_sql(max_distance(80)))
QUERIES["components_80_tiled"] = (components(80, FORMS["tiled"]), _components_sql(max_distance(80)))
