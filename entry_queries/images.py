"""Queries on image files that Spark writes from the vector table."""

from __future__ import annotations

from pyspark.sql import functions as F

from entry_queries.derived import components_sql, write_colour_images, write_images
from kindred.operators import clustering, grouping
from kindred.sources.images import decode_shards, fingerprint_files
from kindred.sources.listing import list_images, list_images_hadoop, qualified
from kindred.sources.report import SUMMARY_KEYS, report_lines
from kindred.sources.scratch import Scratch


def _relative(path, root):
    plain = F.regexp_replace(path, "^file:/+", "/")
    return F.substring(plain, F.lit(len(root) + 1), F.length(plain))


def _folder(spark, sf_dir, write=write_images):
    """A new folder of images: ``scratch, root``."""
    scratch = Scratch(spark)
    root = qualified(spark, scratch.folder("images"))
    scratch.keep(write(spark, sf_dir, root), "written")
    return scratch, root


def image_listing(spark, sf_dir):
    scratch, root = _folder(spark, sf_dir)
    found = list_images(spark, root, scratch)
    return found.select(_relative(F.col("path"), root).alias("path"), "size")


def image_listing_hadoop(spark, sf_dir):
    scratch, root = _folder(spark, sf_dir)
    found = list_images_hadoop(spark, root, scratch)
    return found.select(_relative(F.col("path"), root).alias("path"), "size")


def image_decode(spark, sf_dir):
    scratch, root = _folder(spark, sf_dir)
    sizes = [F.col(c).cast("bigint").alias(c) for c in ("height", "width", "channels")]
    path = _relative(F.col("path"), root).alias("path")
    files = list_images(spark, root, scratch)
    return decode_shards(
        spark, files, lambda decoded: decoded.select(path, *sizes),
        "path string, height bigint, width bigint, channels bigint", scratch,
    )


def _hashed(spark, sf_dir, write=write_images):
    scratch, root = _folder(spark, sf_dir, write)
    files = list_images(spark, root, scratch)
    hashed = scratch.keep(fingerprint_files(spark, files, scratch=scratch), "hashed")
    path = _relative(F.col("path"), root)
    return scratch, hashed.withColumn("path", path)


def image_phash(spark, sf_dir):
    _, hashed = _hashed(spark, sf_dir)
    return hashed.select("path", "phash", "error")


def image_phash_colour(spark, sf_dir):
    """Pictures in colour and of another size: grey weights and Lanczos resize count."""
    _, hashed = _hashed(spark, sf_dir, write_colour_images)
    return hashed.select("path", "phash", "error")


def _grouped(spark, sf_dir):
    scratch, hashed = _hashed(spark, sf_dir)
    number = F.regexp_extract("path", r"(\d+)\.png$", 1).cast("bigint")
    images = hashed.select(number.alias("image_id"), "path", "phash")
    return scratch, scratch.keep(clustering.cluster(images, 90, scratch), "clustered")


def image_groups_90(spark, sf_dir):
    scratch, images = _grouped(spark, sf_dir)
    return grouping.group_members(images, scratch).select("id", "size", "path").orderBy("id", "path")


def report_document(spark, sf_dir):
    """The lines of the report over these images, with their place."""
    scratch, images = _grouped(spark, sf_dir)
    n = images.count()
    summary = dict(zip(SUMMARY_KEYS, ("/images", 90, n, 0, n, False, n), strict=True))
    none = images.limit(0).select("path", F.lit("").alias("error"))
    return report_lines(summary, images, none, scratch).select(
        F.col("section").cast("bigint").alias("section"), "major", "minor",
        F.col("place").cast("bigint").alias("place"), "line",
    )


# Stored pixels are one byte each, 33 bytes per line; 5 + 6 bytes of zlib frame
# and 57 bytes of PNG frame come on top.
_PNG_BYTES = 32 * 33 + 11 + 57

_IMAGES_SQL = """
v as (
  select vec_id * 4 + j as img_id, '/set' || label || '/' || (vec_id * 4 + j) || '.png' as path,
         [case when i > 0 and (i * 7 + vec_id) % 64 < j * 2 then -embedding[i + 1] else embedding[i + 1] end
          for i in range(64)] as e
  from embeddings, range(4) t(j)),
patch as (
  select img_id, path, i // 8 as py, i % 8 as px,
    floor(least(greatest(e[i + 1]::double * 300.0::double + 128.0::double, 0.0::double), 255.0::double) + 0.5::double) as grey
  from v, range(64) t(i)),
basis as materialized (
  select u, p, sum(case when u = 0 then sqrt(1.0 / 32) else sqrt(2.0 / 32) end * cos(pi() * (2 * x + 1) * u / 64)) as w
  from range(8) t(u), range(8) s(p), range(32) r(x) where x // 4 = p group by u, p),
half as materialized (
  select img_id, path, b.u, py, sum(b.w * grey) as c from patch join basis b on b.p = px group by all),
freq as (
  select img_id, path, b.u * 8 + half.u as i, sum(b.w * c) as c
  from half join basis b on b.p = py group by all),
cut as (
  select img_id, path, list(c order by i) as cs, list_sort(list(c) filter (i > 0))[32] as med
  from freq group by all),
halves as (
  select img_id, path,
    list_sum([case when cs[i + 1] >= med then (1::bigint << (31 - i)) else 0 end for i in range(32)])::bigint as hi,
    list_sum([case when cs[i + 33] >= med then (1::bigint << (31 - i)) else 0 end for i in range(32)])::bigint as lo
  from cut),
hm as materialized (
  select img_id, path,
    (case when hi >= 2147483648 then hi - 4294967296 else hi end) * 4294967296 + lo as h
  from halves)
"""

# Each channel has the vector in another order; 48 x 40 pixels in patches of 6 x 5.
_COLOUR_SQL = """
with lanczos as materialized (
  select size, u, x // (size // 8) as p, sum(w) / sum(sum(w)) over (partition by size, u) as w
  from (select size, u, x, case when abs(t) >= 3 then 0 when t = 0 then 1
               else sin(pi() * t) / (pi() * t) * sin(pi() * t / 3) / (pi() * t / 3) end as w
        from (select size, u, x, (x + 0.5 - (u + 0.5) * size / 32.0)::double / (size / 32.0)::double as t
              from (select unnest([48, 40]) as size), range(32) a(u), range(48) b(x) where x < size))
  group by size, u, x // (size // 8)),
level as (
  select vec_id, '/colour' || label || '/' || vec_id || '.png' as path,
    [floor(least(greatest(x::double * 300.0::double + 128.0::double, 0.0::double), 255.0::double) + 0.5::double)::bigint
     for x in embedding] as e
  from embeddings),
patch as (
  select vec_id, path, i // 8 as py, i % 8 as px,
    (19595 * e[i + 1] + 38470 * e[64 - i] + 7471 * e[(5 * i + 3) % 64 + 1] + 32768) >> 16 as grey
  from level, range(64) t(i)),
wide as materialized (
  select vec_id, path, py, u, least(greatest(floor(sum(w * grey) + 0.5), 0), 255) as grey
  from patch join lanczos on size = 48 and p = px group by all),
tall as materialized (
  select vec_id, path, l.u as r, wide.u as c, least(greatest(floor(sum(w * grey) + 0.5), 0), 255) as grey
  from wide join lanczos l on size = 40 and p = py group by all),
basis as materialized (
  select u, x, case when u = 0 then sqrt(1.0 / 32) else sqrt(2.0 / 32) end * cos(pi() * (2 * x + 1) * u / 64) as w
  from range(8) t(u), range(32) r(x)),
half as materialized (
  select vec_id, path, b.u, r, sum(b.w * grey) as c from tall join basis b on b.x = tall.c group by all),
freq as (
  select vec_id, path, b.u * 8 + half.u as i, sum(b.w * c) as c from half join basis b on b.x = r group by all),
cut as (
  select path, list(c order by i) as cs, list_sort(list(c) filter (i > 0))[32] as med from freq group by vec_id, path),
halves as (
  select path,
    list_sum([case when cs[i + 1] >= med then (1::bigint << (31 - i)) else 0 end for i in range(32)])::bigint as hi,
    list_sum([case when cs[i + 33] >= med then (1::bigint << (31 - i)) else 0 end for i in range(32)])::bigint as lo
  from cut)
select path, (case when hi >= 2147483648 then hi - 4294967296 else hi end) * 4294967296 + lo as phash,
       null::varchar as error
from halves
"""

_GROUPS = f"""with recursive {_IMAGES_SQL}, {components_sql('hm', 6)},
g as (select group_id, count(*) as size, row_number() over (order by group_id) as id
      from comp group by group_id having count(*) > 1),
members as (
  select g.id::bigint as id, g.size::bigint as size, hm.path
  from comp join g using (group_id) join hm using (img_id)) """

_VARIANTS = "select '/set' || label || '/' || (vec_id * 4 + j) || '.png' as path, {} from embeddings, range(4) t(j)"

_DOCUMENT = """, edge as (select *, min(path) over (partition by id) = path as first_one,
  max(path) over (partition by id) = path as last_one, max(id) over () as n from members),
total as (select count(*)::varchar as n from hm)
select 0::bigint as section, 0::bigint as major, '' as minor, place::bigint as place, line
from (select unnest(['{', '  "carpeta_analizada": "/images",', '  "similitud_minima_porcentaje": 90,',
    '  "imagenes_analizadas": ' || n || ',', '  "hashes_reutilizados_cache": 0,',
    '  "hashes_calculados_esta_ejecucion": ' || n || ',', '  "actualizacion_incremental_grupos": false,',
    '  "imagenes_nuevas_agregadas_a_grupos": ' || n || ',', '  "imagenes_no_leidas": [],']) as line,
    generate_subscripts([1, 2, 3, 4, 5, 6, 7, 8, 9], 1) - 1 as place from total)
union all select 2, 0, '', 0, '  "grupos": ['
union all select 3, id, path, 0, '    {' from edge where first_one
union all select 3, id, path, 1, '      "id": ' || id || ',' from edge where first_one
union all select 3, id, path, 2, '      "imagenes": [' from edge where first_one
union all select 3, id, path, 3, '        "' || path || '"' || case when last_one then '' else ',' end from edge
union all select 3, id, path, 4, '      ]' from edge where last_one
union all select 3, id, path, 5, '    }' || case when id = n then '' else ',' end from edge where last_one
union all select 4, 0, '', 0, '  ]'
union all select 4, 0, '', 1, '}'"""

QUERIES = {
    "image_listing": (image_listing, _VARIANTS.format(f"{_PNG_BYTES}::bigint as size")),
    "image_listing_hadoop": (image_listing_hadoop, _VARIANTS.format(f"{_PNG_BYTES}::bigint as size")),
    "image_decode": (
        image_decode,
        _VARIANTS.format("32::bigint as height, 32::bigint as width, 1::bigint as channels"),
    ),
    "image_phash": (image_phash, f"with {_IMAGES_SQL} select path, h as phash, null::varchar as error from hm"),
    "image_phash_colour": (image_phash_colour, _COLOUR_SQL),
    "image_groups_90": (image_groups_90, _GROUPS + "select * from members order by id, path"),
    "report_document": (report_document, _GROUPS + _DOCUMENT),
}
