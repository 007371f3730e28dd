"""The report of a run as one JSON document, written by all tasks.

Every line of the indented document is one row.  The rows are sorted by their
place in the document and written as text, so the part files, read in the
order of their names, are the document.  No list of members is ever built.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.operators.grouping import numbered_groups
from kindred.operators.skew import join_unique
from kindred.sources.scratch import Scratch

# The keys of the report, in order.
SUMMARY_KEYS = (
    "carpeta_analizada", "similitud_minima_porcentaje", "imagenes_analizadas",
    "hashes_reutilizados_cache", "hashes_calculados_esta_ejecucion",
    "actualizacion_incremental_grupos", "imagenes_nuevas_agregadas_a_grupos",
)
UNREADABLE_KEY, UNREADABLE_FIELDS = "imagenes_no_leidas", ("ruta", "error")
GROUPS_KEY, GROUP_FIELDS = "grupos", ("id", "imagenes")


def _quoted(text: Column) -> Column:
    """A JSON string literal."""
    wrapped = F.to_json(F.struct(text.alias("t")))
    return F.substring(wrapped, F.lit(6), F.length(wrapped) - F.lit(6))


def _lines(df: DataFrame, section: int, *lines: tuple[int, Column, Column]) -> DataFrame:
    """Rows ``section, major, minor, place, line`` for the lines that apply."""
    made = F.array(*[
        F.struct(F.lit(place).alias("place"), F.when(keep, line).alias("line")) for place, keep, line in lines
    ])
    return (
        df.select(F.lit(section).alias("section"), "major", "minor", F.explode(made).alias("l"))
        .where("l.line is not null")
        .select("section", "major", "minor", "l.place", "l.line")
    )


def report_lines(summary: dict, images: DataFrame, unreadable: DataFrame, scratch: Scratch) -> DataFrame:
    """The lines of the document with the columns that order them.

    ``summary`` holds the values of ``SUMMARY_KEYS``; ``images`` has
    ``path, group_id``; ``unreadable`` has ``path, error``.
    """
    spark = images.sparkSession
    always = F.lit(True)
    groups = scratch.keep(numbered_groups(images, scratch), "groups")
    n_groups = groups.count()
    failures = unreadable.select("path", "error")
    last_failure = failures.agg(F.max("path")).first()[0]

    def fixed(section: int, texts: list[str]) -> DataFrame:
        rows = [(section, 0, "", place, text) for place, text in enumerate(texts)]
        return spark.createDataFrame(rows, "section int, major bigint, minor string, place int, line string")

    head = ["{"]
    for key in SUMMARY_KEYS:
        head.append(f"  {json.dumps(key)}: {json.dumps(summary[key], ensure_ascii=False)},")
    head.append(f'  "{UNREADABLE_KEY}": [' + ("" if last_failure is not None else "],"))
    middle = ["  ],"] if last_failure is not None else []
    middle.append(f'  "{GROUPS_KEY}": [' + ("" if n_groups else "]"))
    tail = ["  ]", "}"] if n_groups else ["}"]

    path_key, error_key = UNREADABLE_FIELDS
    failed = _lines(
        failures.select(F.lit(0).cast("bigint").alias("major"), F.col("path").alias("minor"), "error"), 1,
        (0, always, F.lit("    {")),
        (1, always, F.concat(F.lit(f'      "{path_key}": '), _quoted(F.col("minor")), F.lit(","))),
        (2, always, F.concat(F.lit(f'      "{error_key}": '), _quoted(F.col("error")))),
        (3, always, F.concat(F.lit("    }"), F.when(F.col("minor") == last_failure, "").otherwise(","))),
    ) if last_failure is not None else None

    id_key, members_key = GROUP_FIELDS
    members = join_unique(images.select("path", "group_id"), groups, "group_id", "inner", scratch)
    first, last = F.col("minor") == F.col("first_member"), F.col("minor") == F.col("last_member")
    grouped = _lines(
        members.withColumnsRenamed({"id": "major", "path": "minor"}), 3,
        (0, first, F.lit("    {")),
        (1, first, F.concat(F.lit(f'      "{id_key}": '), F.col("major").cast("string"), F.lit(","))),
        (2, first, F.lit(f'      "{members_key}": [')),
        (3, always, F.concat(F.lit("        "), _quoted(F.col("minor")), F.when(last, "").otherwise(","))),
        (4, last, F.lit("      ]")),
        (5, last, F.concat(F.lit("    }"), F.when(F.col("major") == n_groups, "").otherwise(","))),
    )

    lines = fixed(0, head).unionByName(fixed(2, middle)).unionByName(grouped).unionByName(fixed(4, tail))
    return lines if failed is None else lines.unionByName(failed)


def write_report(summary: dict, images: DataFrame, unreadable: DataFrame, path: str, scratch: Scratch) -> None:
    """Replace the report below ``path``: part files that make one document."""
    (
        report_lines(summary, images, unreadable, scratch)
        .orderBy("section", "major", "minor", "place")
        .select("line")
        .write.mode("overwrite")
        .text(path)
    )
