"""Input tables that Spark (and the SQL text for the check) derive from the given ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.functions.vector_hash import hash_vectors
from kindred.sources.listing import local_path, qualified, remote_path

BASE_NS = 1_700_000_000_000_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- four planted variants of every vector -----------------------------------


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``img_id, path, variant, label, e``: variant j flips up to 2j signs."""
    vectors = table(spark, sf_dir, "embeddings")
    made = vectors.withColumn("variant", F.explode(F.array(*[F.lit(j) for j in range(4)])))
    flipped = F.transform(
        "embedding",
        lambda x, i: F.when(
            (i > 0) & ((i * 7 + F.col("vec_id")) % 64 < F.col("variant") * 2), -x
        ).otherwise(x),
    )
    img_id = F.col("vec_id") * 4 + F.col("variant")
    path = F.concat(F.lit("/set"), F.col("label").cast("string"), F.lit("/"), img_id.cast("string"), F.lit(".png"))
    return made.select(img_id.alias("img_id"), path.alias("path"), "variant", "label", flipped.alias("e"))


def hashed_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``image_id, path, variant, label, phash``."""
    return hash_vectors(variants(spark, sf_dir), "e").select(
        F.col("img_id").alias("image_id"), "path", "variant", "label", "phash"
    )


HASHES_SQL = """
v as (
  select vec_id * 4 + j as img_id, j as variant, label,
         '/set' || label || '/' || (vec_id * 4 + j) || '.png' as path,
         [case when i > 0 and (i * 7 + vec_id) % 64 < j * 2 then -embedding[i + 1] else embedding[i + 1] end
          for i in range(64)] as e
  from embeddings, range(4) t(j)),
m as (select *, list_sort(e[2:64])[32] as med from v),
halves as (
  select img_id, path, variant, label,
    list_sum([case when e[i + 1] >= med then (1::bigint << (31 - i)) else 0 end for i in range(32)])::bigint as hi,
    list_sum([case when e[i + 33] >= med then (1::bigint << (31 - i)) else 0 end for i in range(32)])::bigint as lo
  from m),
hm as materialized (
  select img_id, path, variant, label,
    (case when hi >= 2147483648 then hi - 4294967296 else hi end) * 4294967296 + lo as h
  from halves)
"""


def components_sql(source: str, distance: int, name: str = "comp") -> str:
    """CTEs that end in ``name(img_id, group_id)`` over ``source(img_id, h)``."""
    return f"""
{name}_d as materialized (select h, min(img_id) as rep from {source} group by h),
{name}_e as materialized (
  select a.rep as s, b.rep as d from {name}_d a join {name}_d b
  on a.rep <> b.rep and bit_count(xor(a.h, b.h)) <= {distance}),
{name}_r(n, r) as (
  select rep, rep from {name}_d
  union
  select e.d, c.r from {name}_r c join {name}_e e on e.s = c.n),
{name}_m as (select n, min(r) as group_id from {name}_r group by n),
{name} as materialized (
  select s.img_id, m.group_id from {source} s join {name}_d d using (h) join {name}_m m on m.n = d.rep)
"""


# --- two snapshots of a file tree ---------------------------------------------

EXTENSIONS = {"de": ".JPG", "en": ".png", "es": ".heic", "fr": ".webp"}
GONE_SOURCE, LATE_SOURCE, UNGROUPED_SOURCE = "src7", "src3", "src5"
SMALL_FILE = 500


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    ext = F.lit("")
    for lang, suffix in EXTENSIONS.items():
        ext = F.when(F.col("lang") == lang, suffix).otherwise(ext)
    path = F.concat(F.lit("/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), ext)
    return docs.withColumn("path", path)


def state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored snapshot: one folder is not known yet, one has no groups yet."""
    value = F.col("doc_id") * 2654435761 + F.col("n_chars")
    group = F.when(F.col("source") != UNGROUPED_SOURCE, F.col("doc_id") + 1)
    return _documents(spark, sf_dir).where(F.col("source") != LATE_SOURCE).select(
        (F.col("doc_id") + 1).alias("image_id"),
        "path",
        F.col("n_chars").cast("bigint").alias("size"),
        (F.col("doc_id") * 1_000_000_000 + BASE_NS).alias("modified_ns"),
        value.alias("phash"),
        group.alias("group_id"),
    )


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The current files: one folder is gone, some sizes and times differ."""
    labels = table(spark, sf_dir, "labels")
    longer = F.when(F.col("toxic") == 1, 1).otherwise(0)
    later = F.when(F.col("quality") == 0, 1_000_000_000).otherwise(0)
    return (
        _documents(spark, sf_dir)
        .where(F.col("source") != GONE_SOURCE)
        .join(labels, "doc_id", "left")
        .select(
            "path",
            (F.col("n_chars") + longer).cast("bigint").alias("size"),
            (F.col("doc_id") * 1_000_000_000 + BASE_NS + later).cast("bigint").alias("modified_ns"),
        )
    )


def hashed(files: DataFrame) -> DataFrame:
    """Stand-in for decoding: short files fail, the others get a hash."""
    failed = F.col("size") < SMALL_FILE
    return files.select(
        "path", "size", "modified_ns",
        F.when(~failed, F.col("size") * 40503).alias("phash"),
        F.when(failed, F.lit("too short")).alias("error"),
    )


SNAPSHOTS_SQL = f"""
docs as (
  select doc_id, source, n_chars, '/' || source || '/' || doc_id ||
    case lang when 'de' then '.JPG' when 'en' then '.png' when 'es' then '.heic' when 'fr' then '.webp' else '' end
    as path
  from documents),
state as (
  select (doc_id + 1)::bigint as image_id, path, n_chars::bigint as size,
    ({BASE_NS} + doc_id * 1000000000)::bigint as modified_ns,
    (doc_id * 2654435761 + n_chars)::bigint as phash,
    case when source <> '{UNGROUPED_SOURCE}' then (doc_id + 1)::bigint end as group_id
  from docs where source <> '{LATE_SOURCE}'),
listing as (
  select path, (n_chars + case when toxic = 1 then 1 else 0 end)::bigint as size,
    ({BASE_NS} + doc_id * 1000000000 + case when quality = 0 then 1000000000 else 0 end)::bigint as modified_ns
  from docs left join labels using (doc_id) where source <> '{GONE_SOURCE}'),
actions as (
  select coalesce(f.path, s.path) as path, coalesce(f.size, s.size) as size,
    coalesce(f.modified_ns, s.modified_ns) as modified_ns, s.image_id, s.phash, s.group_id,
    case when s.path is null then 'new' when f.path is null then 'removed'
         when s.size <> f.size or s.modified_ns <> f.modified_ns then 'modified' else 'unchanged' end as action
  from state s full outer join listing f on s.path = f.path),
hashed as (
  select path, size, modified_ns,
    case when size >= {SMALL_FILE} then (size * 40503)::bigint end as phash,
    case when size < {SMALL_FILE} then 'too short' end as error
  from actions where action in ('new', 'modified'))
"""


# --- image files --------------------------------------------------------------

PNG_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def _levels(values):
    """Vector components as 8-bit levels."""
    import numpy as np

    return np.floor(np.clip(np.asarray(values, dtype=np.float64) * 300.0 + 128.0, 0.0, 255.0) + 0.5).astype(np.uint8)


def _stored_png(pixels) -> bytes:
    """A PNG of an (h, w, 1 or 3) array, stored without compression."""
    import struct
    import zlib

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    height, width, channels = pixels.shape
    lines = b"".join(b"\0" + row.tobytes() for row in pixels)
    head = struct.pack(">IIBBBBB", width, height, 8, 2 if channels == 3 else 0, 0, 0, 0)
    return PNG_SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines, 0)) + chunk(b"IEND", b"")


def _grey_png(values) -> bytes:
    """32 x 32 grey pixels; each value is a 4 x 4 patch."""
    import numpy as np

    return _stored_png(np.kron(_levels(values).reshape(8, 8), np.ones((4, 4), np.uint8))[:, :, None])


def _colour_png(values) -> bytes:
    """48 x 40 colour pixels in patches of 6 x 5; each channel has the values in another order."""
    import numpy as np

    levels, i = _levels(values), np.arange(64)
    channels = [levels[order].reshape(8, 8) for order in (i, 63 - i, (5 * i + 3) % 64)]
    return _stored_png(np.stack([np.kron(c, np.ones((5, 6), np.uint8)) for c in channels], axis=2))


def _write_files(root: str, png):
    def run(batches):
        import os

        import pandas as pd
        from pyarrow import fs

        systems = {}
        for batch in batches:
            for row in batch.itertuples(index=False):
                content = png(row.e)
                where = f"{root}{row.path}"
                local = local_path(where)
                system, inner = (fs.LocalFileSystem(), local) if local else remote_path(where, systems)
                system.create_dir(os.path.dirname(inner), recursive=True)
                with system.open_output_stream(inner) as out:
                    out.write(content)
            yield pd.DataFrame({"path": batch["path"]})

    return run


def write_images(spark: SparkSession, sf_dir: str, root: str) -> DataFrame:
    """Write one PNG per vector variant below ``root``."""
    tasks = spark.sparkContext.defaultParallelism
    files = variants(spark, sf_dir).select("path", "e").repartition(tasks, "path")
    return files.mapInPandas(_write_files(qualified(spark, root), _grey_png), "path string")


def write_colour_images(spark: SparkSession, sf_dir: str, root: str) -> DataFrame:
    """Write one colour PNG per vector below ``root``."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    path = F.format_string("/colour%s/%s.png", F.col("label").cast("string"), F.col("vec_id").cast("string"))
    files = vectors.select(path.alias("path"), F.col("embedding").alias("e"))
    files = files.repartition(spark.sparkContext.defaultParallelism, "path")
    return files.mapInPandas(_write_files(qualified(spark, root), _colour_png), "path string")
