import io
import json
import os
import struct
from concurrent.futures import ThreadPoolExecutor
from itertools import count
from threading import Barrier

import duckdb
import numpy as np
import pictures
import pyarrow as pa
import pytest
from pictures import png, read_png, smooth
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import functions as F

from entry_queries import images as entry_images
from entry_queries.images import _IMAGES_SQL
from kindred.functions import image_hash
from kindred.runs import KEPT_VERSIONS, group_folder, sync
from kindred.sources import images
from kindred.sources.images import decoded_images, fingerprint_files, hash_files, hash_files_jvm, open_input, register_phash
from kindred.sources.listing import _remote_entries, list_images, list_images_hadoop, qualified
from kindred.sources.report import report_lines, write_report
from kindred.sources.scratch import Scratch, shared_folder
from kindred.sources.snapshots import SnapshotStore

cloudpickle.register_pickle_by_value(pictures)


def distance(a, b):
    return ((a ^ b) & (2**64 - 1)).bit_count()


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "fotos"
    (root / "sub" / "deep").mkdir(parents=True)
    (root / "_u").mkdir()
    (root / "a.png").write_bytes(png(smooth(1)))
    (root / "sub" / "A+%2B [1] copy.PNG").write_bytes(png(smooth(1)))
    (root / "sub" / "deep" / "half.png").write_bytes(png(smooth(1, 32)))
    (root / "brighter.png").write_bytes(png(smooth(1) + 20))
    (root / "other.png").write_bytes(png(smooth(2)))
    (root / "black.png").write_bytes(png(np.zeros((20, 30))))
    (root / "bad.jpg").write_text("text")
    (root / "video.mp4").write_bytes(b"x")
    (root / ".jpg").write_bytes(b"x")
    (root / ".hid.png").write_bytes(png(smooth(3)))
    (root / "_u" / "c.png").write_bytes(png(smooth(3)))
    os.symlink(root / "sub", root / "link")
    return root


def test_hash_definition():
    blocks = np.stack([smooth(i, 32).astype(np.float32) for i in range(5)])
    hashes = image_hash.hash_blocks(blocks)
    u, x = np.mgrid[0:32, 0:32]
    full = np.sqrt(np.where(u == 0, 1, 2) / 32) * np.cos(np.pi * (2 * x + 1) * u / 64)
    for block, value in zip(blocks, hashes):
        low = (full @ block @ full.T)[:8, :8].ravel()
        bits = "".join("1" if c >= sorted(low[1:])[31] else "0" for c in low)
        assert f"{int(value) & (2**64 - 1):064b}" == bits
    assert image_hash.hash_blocks(np.zeros((1, 32, 32)))[0] == -1
    assert distance(int(image_hash.hash_blocks(blocks[:1] * 0.5)[0]), int(hashes[0])) == 0
    assert (hashes.view(np.uint64) & np.uint64(2**63 - 1)).tolist() == [
        v for v in (hashes.view(np.uint64) & np.uint64(2**63 - 1)).tolist() if v.bit_count() >= 32]


def test_hashes_are_those_of_doubles_also_where_values_tie():
    """Pixels of two levels, whose coefficients are often equal or nearly so, against the SQL of ``image_phash``."""
    levels = np.random.default_rng(5).integers(0, 2, (400, 64)) * 255
    vectors = pa.array([[(x - 128) / 300 for x in row] for row in levels.tolist()], pa.list_(pa.float32()))
    with duckdb.connect() as duck:
        duck.execute("set threads = 1")
        duck.register("embeddings", pa.table({"vec_id": range(400), "label": [0] * 400, "embedding": vectors}))
        want = dict(duck.execute(f"with {_IMAGES_SQL} select img_id // 4, h from hm where img_id % 4 = 0").fetchall())
    blocks = np.kron(levels.reshape(-1, 8, 8), np.ones((4, 4))).astype(np.float32)
    assert image_hash.hash_blocks(blocks).tolist() == [want[i] for i in range(400)]
    # Neither the stack nor its size has a part in a hash.
    mixed = np.concatenate([blocks[:3], np.random.default_rng(6).integers(0, 256, (2, 32, 32)).astype(np.float32)])
    assert image_hash.hash_blocks(mixed).tolist() == [int(image_hash.hash_blocks(b[None])[0]) for b in mixed]


def test_resize_keeps_flat_pictures():
    for shape in ((32, 32), (100, 7), (5, 300)):
        assert (image_hash.shrink(np.full(shape, 93, np.uint8)) == 93).all()


def test_grey_weights():
    bgr = np.array([[[10, 20, 30], [0, 0, 255], [255, 255, 255]]], np.uint8)
    assert image_hash.grey_of(bgr).tolist() == [[22, 76, 255]]


def test_orientations():
    a = np.arange(6).reshape(2, 3)
    want = {
        1: a, 2: np.fliplr(a), 3: np.rot90(a, 2), 4: np.flipud(a), 5: a.T, 6: np.rot90(a, -1),
        7: np.rot90(a.T, 2), 8: np.rot90(a),
    }
    for orientation, picture in want.items():
        assert (image_hash.upright(a, orientation) == picture).all()
        for order, mark in (("<", b"II"), (">", b"MM")):
            tiff = mark + struct.pack(order + "HIHHHIHH", 42, 8, 1, 0x0112, 3, 1, orientation, 0)
            body = b"Exif\0\0" + tiff
            jpeg = b"\xff\xd8\xff\xe0\0\4ab\xff\xe1" + struct.pack(">H", len(body) + 2) + body + b"\xff\xda"
            plain = png(a)
            late = plain[:-12] + struct.pack(">I", len(tiff)) + b"eXIf" + tiff + bytes(4) + plain[-12:]
            for content in (jpeg, late, tiff):
                assert image_hash.exif_orientation(io.BytesIO(content)) == orientation
    for content in (png(a), b"\xff\xd8\xff\xda", b"", b"GIF89a", b"II*\0\xff\xff\xff\xff", png(a)[:20]):
        assert image_hash.exif_orientation(io.BytesIO(content)) == 1


def test_listing(spark, scratch, folder):
    found = {r.path: (r.size, r.modified_ns) for r in list_images(spark, str(folder), scratch).collect()}
    want = {}
    for where, _, names in os.walk(folder):
        for name in names:
            path = os.path.join(where, name)
            if name not in ("video.mp4", ".jpg"):
                want[path] = (os.stat(path).st_size, os.stat(path).st_mtime_ns)
    assert found == want and len(want) == 9
    with pytest.raises(NotADirectoryError):
        list_images(spark, str(folder / "a.png"), scratch)
    plain = list_images_hadoop(spark, str(folder))
    assert plain.count() == 7 + 2  # hidden names are skipped, linked folders entered
    assert "content" not in plain._jdf.queryExecution().executedPlan().toString()


def test_hadoop_listing_deals_many_files_to_a_task(spark, scratch, tmp_path):
    for i in range(600):
        (tmp_path / f"{i}.png").write_bytes(b"x")
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    found = list_images_hadoop(spark, str(tmp_path), scratch)
    assert found.count() == 600
    assert found.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism + 1  # 19 tasks of 32 files before
    assert spark.conf.get("spark.sql.files.openCostInBytes") == before


@pytest.mark.parametrize("decode", [read_png, None])
def test_fingerprints(spark, scratch, folder, decode):
    files = list_images(spark, str(folder), scratch)
    found = {r.path[len(str(folder)) + 1 :]: r for r in fingerprint_files(spark, files, decode, scratch).collect()}
    assert len(found) == 9
    first = found["a.png"].phash
    assert found["sub/A+%2B [1] copy.PNG"].phash == first
    assert distance(found["sub/deep/half.png"].phash, first) <= 4
    assert distance(found["brighter.png"].phash, first) <= 4
    assert distance(found["other.png"].phash, first) > 12
    assert found["black.png"].phash == -1
    assert found["bad.jpg"].phash is None and found["bad.jpg"].error
    assert found["a.png"].size == os.stat(folder / "a.png").st_size


def test_phash_in_sql(spark, scratch, folder):
    files = list_images(spark, str(folder), scratch)
    want = {r.path: r.phash for r in fingerprint_files(spark, files, read_png, scratch).collect()}
    register_phash(spark, decode=read_png)
    spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(folder)).createOrReplaceTempView("found")
    rows = spark.sql("select path, phash(content) as phash, phash(cast(null as binary)) as none from found").collect()
    got = {r.path.removeprefix("file:"): r.phash for r in rows}
    known = [name for name in ("a.png", "other.png", "bad.jpg", "black.png", "sub/deep/half.png")]
    assert [got[f"{folder}/{n}"] for n in known] == [want[f"{folder}/{n}"] for n in known]
    assert got[f"{folder}/a.png"] is not None and got[f"{folder}/bad.jpg"] is None
    assert all(r.none is None for r in rows)


def test_shards_and_hidden_names(spark, scratch, folder, monkeypatch):
    files = list_images(spark, str(folder), scratch)
    one = {r.path: (r.phash, r.error) for r in hash_files_jvm(spark, files, scratch).collect()}
    monkeypatch.setattr(images, "SHARD_PATHS", 2)
    many = {r.path: (r.phash, r.error) for r in hash_files_jvm(spark, files, scratch).collect()}
    assert one == many and len(one) == 9
    assert one[str(folder / "_u" / "c.png")][0] is not None
    assert one[str(folder / ".hid.png")] == (None, images.HIDDEN_ERROR)
    hidden = files.where(F.col("path").like("%/.hid.png"))
    assert [r.error for r in hash_files_jvm(spark, hidden, scratch).collect()] == [images.HIDDEN_ERROR]
    assert hash_files_jvm(spark, files.limit(0), scratch).count() == 0


def test_shards_are_read_side_by_side(spark, scratch, tmp_path, monkeypatch):
    for i in range(12):
        (tmp_path / f"{i}.png").write_bytes(png(smooth(i)))
    listed = list_images(spark, str(tmp_path), scratch)
    want = {r.path: r.phash for r in hash_files_jvm(spark, listed, scratch).collect()}
    monkeypatch.setattr(images, "SHARD_PATHS", 3)
    met, calls, read = Barrier(2), count(), images.decoded_images

    def wait(*given):
        if next(calls) < 2:
            met.wait(60)
        return read(*given)

    # The first shard goes on when a second has come as far.
    monkeypatch.setattr(images, "decoded_images", wait)
    monkeypatch.setattr(images, "SHARDS_AT_ONCE", 4)
    found = hash_files_jvm(spark, listed, scratch)
    assert {r.path: r.phash for r in found.collect()} == want and len(want) == 12


def test_image_decode_names_its_files_shard_by_shard(spark, monkeypatch):
    """One read of the whole folder keeps all its files on the driver."""
    given, read = [], images.decoded_images

    def seen(spark, paths):
        given.append([paths] if isinstance(paths, str) else paths)
        return read(spark, paths)

    monkeypatch.setattr(images, "decoded_images", seen)
    monkeypatch.setattr(entry_images, "decoded_images", seen, raising=False)
    monkeypatch.setattr(images, "SHARD_PATHS", 500)
    cache = "spark.sql.hive.filesourcePartitionFileCacheSize"
    before = spark.conf.get(cache)
    found = entry_images.image_decode(spark, "/root/testdata/sf0.001")
    assert found.dtypes == [("path", "string")] + [(c, "bigint") for c in ("height", "width", "channels")]
    rows = found.collect()
    assert len({r.path for r in rows}) == len(rows) == 2000 and {tuple(r)[1:] for r in rows} == {(32, 32, 1)}
    assert len(given) == 4 and max(map(len, given)) < 700 and sum(map(len, given)) == 2000
    assert spark.conf.get(cache) == before


def test_shards_give_every_image_the_source_can_read(spark, scratch, folder, monkeypatch):
    schema = "path string, height int, width int, channels int"
    columns = [name.split()[0] for name in schema.split(", ")]
    files = list_images(spark, str(folder), scratch)
    plain = F.regexp_replace("path", "^file:/+", "/").alias("path")
    # A read of the folder also has linked folders and other files, but no folder whose name starts with _.
    listed = {r.path for r in files.collect()}
    whole = decoded_images(spark, [str(folder), str(folder / "_u" / "c.png")]).select(plain, *columns[1:]).collect()
    want = sorted(tuple(r) for r in whole if r.path in listed)
    monkeypatch.setattr(images, "SHARD_PATHS", 2)
    found = images.decode_shards(spark, files, lambda decoded: decoded.select(*columns), schema, scratch)
    assert sorted(map(tuple, found.collect())) == want and len(want) == 8
    assert (str(folder / "bad.jpg"), -1, -1, -1) in want and str(folder / ".hid.png") not in {row[0] for row in want}
    none = images.decode_shards(spark, files.limit(0), lambda decoded: decoded.select(*columns), schema, scratch)
    assert none.columns == columns and none.count() == 0


def test_a_missing_module_fails_the_run(spark, scratch, folder, tmp_path):
    def broken(content):
        raise ImportError("no decoder here")

    store = SnapshotStore(spark, str(tmp_path / "state"))
    files = list_images(spark, str(folder), scratch)
    sync(spark, files, store, lambda f: hash_files(f, read_png), 90, scratch)
    (folder / "a.png").write_bytes(png(smooth(5)))
    files = list_images(spark, str(folder), scratch)
    with pytest.raises(Exception, match="no decoder here"):
        sync(spark, files, store, lambda f: hash_files(f, broken), 90, scratch)
    assert store.versions() == [1]


def test_remote_names(tmp_path):
    systems = {"box://host": (fs.SubTreeFileSystem(str(tmp_path), fs.LocalFileSystem()), "")}
    names = ["a b.png", "a#1.png", "a?1.png", "%2B.png", "é.png"]
    (tmp_path / "in #1").mkdir()
    for name in names:
        (tmp_path / "in #1" / name).write_text(name)
    (tmp_path / "in #1" / "deep er").mkdir()
    found = list(_remote_entries("box://host/in #1", systems))
    assert {path for is_folder, path, _, _ in found if not is_folder} == {"box://host/in #1/" + n for n in names}
    assert [path for is_folder, path, _, _ in found if is_folder] == ["box://host/in #1/deep er"]
    for name in names:
        with open_input("box://host/in #1/" + name, systems) as stream:
            assert stream.read().decode() == name


def test_qualified_paths(spark, tmp_path):
    odd = str(tmp_path / "a b#1?%2B")
    assert qualified(spark, odd) == odd and qualified(spark, "file://" + odd) == odd


def test_both_decoders_agree(spark, scratch, tmp_path):
    for i in range(6):
        picture = np.stack([smooth(i, 50), smooth(i + 50, 50), smooth(i + 90, 50)], axis=2)
        (tmp_path / f"{i}.png").write_bytes(png(picture))
    files = list_images(spark, str(tmp_path), scratch)
    a = {r.path: r.phash for r in hash_files(files, read_png).collect()}
    b = {r.path: r.phash for r in fingerprint_files(spark, files).collect()}
    assert a == b and len(a) == 6
    sizes = {(r.height, r.width, r.channels) for r in decoded_images(spark, str(tmp_path)).collect()}
    assert sizes == {(50, 50, 3)}


def state_of(store):
    return {r.path: (r.image_id, r.phash, r.group_id) for r in store.read().collect()}


def test_runs_over_a_changing_folder(spark, folder, tmp_path):
    state, report = str(tmp_path / "state"), str(tmp_path / "out" / "report")
    store = SnapshotStore(spark, state)

    def run(threshold=90):
        result = group_folder(spark, str(folder), threshold, state, report, read_png)
        parts = sorted(n for n in os.listdir(report) if n.startswith("part-"))
        text = "".join(open(os.path.join(report, n), encoding="utf-8").read() for n in parts)
        document = json.loads(text)
        assert text == json.dumps(document, ensure_ascii=False, indent=2) + "\n"
        assert store.versions() == list(range(1, result_count[0] + 2))[-KEPT_VERSIONS:]  # older ones are deleted
        assert len([n for n in os.listdir(state) if n.startswith("v=")]) <= KEPT_VERSIONS
        folders.append(store.manifest().folder)
        result_count[0] += 1
        return result, document

    result_count, folders = [0], []
    at = lambda *names: [str(folder / n) for n in names]
    similar = sorted(at("a.png", "brighter.png", "sub/A+%2B [1] copy.PNG", "sub/deep/half.png"))
    hidden = at(".hid.png", "_u/c.png")

    assert store.saved_threshold() is None and store.read().isEmpty()
    first, document = run()
    assert (first.images, first.reused, first.calculated, first.new_images, first.full_rebuild) == (8, 0, 8, 8, True)
    assert document["grupos"] == [{"id": 1, "imagenes": hidden}, {"id": 2, "imagenes": similar}]
    assert [r["ruta"] for r in document["imagenes_no_leidas"]] == at("bad.jpg")
    assert document["actualizacion_incremental_grupos"] is False
    before = state_of(store)
    ids = sorted(before)
    assert [before[p][0] for p in ids] == list(range(1, 9))

    # nothing changed: only the unreadable file is tried again
    second, document = run()
    assert (second.reused, second.calculated, second.full_rebuild) == (8, 0, False)
    assert document["actualizacion_incremental_grupos"] is True
    assert len(document["imagenes_no_leidas"]) == 1 and state_of(store) == before

    assert folders[0] == folders[1]  # nothing is written again

    # one more copy: incremental
    (folder / "ñ \"quoted\".png").write_bytes(png(smooth(2) + 3))
    third, document = run()
    assert (third.reused, third.calculated, third.new_images, third.full_rebuild) == (8, 1, 1, False)
    assert state_of(store)[str(folder / "ñ \"quoted\".png")][0] == 9
    assert {"id": 3, "imagenes": sorted(at("other.png", "ñ \"quoted\".png"))} in document["grupos"]

    # modified to unreadable, removed, and modified to another picture
    (folder / "other.png").write_text("broken now")
    (folder / "a.png").unlink()
    (folder / "black.png").write_bytes(png(smooth(1, 48)))
    fourth, document = run()
    assert (fourth.images, fourth.reused, fourth.calculated, fourth.new_images) == (7, 6, 1, 0)
    assert fourth.full_rebuild
    after = state_of(store)
    assert str(folder / "other.png") not in after and str(folder / "a.png") not in after
    assert after[str(folder / "black.png")][0] == before[str(folder / "black.png")][0]
    assert document["grupos"][1]["imagenes"] == sorted(at("black.png", *[p[len(str(folder)) + 1 :] for p in similar[1:]]))
    assert {r["ruta"] for r in document["imagenes_no_leidas"]} == set(at("bad.jpg", "other.png"))

    # another threshold hashes nothing new
    fifth, _ = run(100)
    assert (fifth.calculated, fifth.full_rebuild, store.saved_threshold()) == (0, True, 100)
    labels = state_of(store)
    for _, phash, group in labels.values():
        assert group == min(i for i, other, _ in labels.values() if other == phash)

    store.vacuum(keep=1)
    assert len(store.versions()) == 1 and state_of(store) == labels


def test_of_runs_that_publish_at_the_same_moment_one_succeeds(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path))
    rows = spark.sql("select 1L as image_id, '/a' as path, 1L as size, 1L as modified_ns, 5L as phash, 1L as group_id")
    current = store.publish(rows, 90, None)
    for _ in range(10):
        meeting = Barrier(6)

        def publish(threshold, based_on=current, meeting=meeting):
            meeting.wait()
            try:
                return SnapshotStore(spark, str(tmp_path)).publish(None, threshold, based_on)
            except FileExistsError:
                return None

        with ThreadPoolExecutor(6) as pool:
            published = [x for x in pool.map(publish, range(90, 96)) if x]
        assert len(published) == 1 and store.manifest() == published[0]
        current = published[0]
    assert store.versions() == list(range(1, 12)) and store.read().count() == 1


def test_a_run_that_dies_leaves_the_old_version(spark, tmp_path, monkeypatch):
    store = SnapshotStore(spark, str(tmp_path))
    row = "1L as image_id, '/a' as path, 1L as size, 1L as modified_ns, 5L as phash, 1L as group_id"
    old = spark.sql("select " + row)
    first = store.publish(old, 90, None)

    def dies(source, target):
        raise RuntimeError("killed")

    with monkeypatch.context() as patched:
        patched.setattr(store, "_rename", dies)
        with pytest.raises(RuntimeError):
            store.publish(old.limit(0), 90, first)
    assert store.versions() == [1] and store.read().count() == 1

    # two runs from one version: the second one fails
    second = store.publish(old.unionByName(old), 95, first)
    with pytest.raises(Exception, match="exist"):
        store.publish(old.limit(0), 100, first)
    assert store.manifest() == second and store.read().count() == 2

    third = store.publish(None, 95, second)
    assert (third.version, third.folder) == (3, second.folder)
    store.vacuum(keep=1)
    assert store.versions() == [3] and store.read().count() == 2
    assert len([n for n in os.listdir(tmp_path) if n.startswith("v=")]) == 3  # two of dead runs are young
    store.vacuum(keep=1, orphan_hours=-1)
    left = [n for n in os.listdir(tmp_path) if n.startswith(("v=", ".manifest")) and not n.endswith(".crc")]
    assert len(left) == 1
    assert store.read().count() == 2


def state_count(store):
    return store.read().select("phash").distinct().count()


@pytest.mark.parametrize("index_from", [100])
def test_full_and_step_by_step_runs_agree(spark, scratch, tmp_path, index_from):
    def fingerprint(files):
        value = F.regexp_extract("path", r"(\d+)", 1).cast("bigint")
        return files.withColumn("phash", value.bitwiseXOR(F.shiftleft(value, 20))).withColumn("error", F.lit(None).cast("string"))

    files = spark.range(200).select(
        F.concat(F.lit("/p"), F.lpad(F.col("id").cast("string"), 4, "0"), F.lit(".png")).alias("path"),
        F.lit(1).cast("bigint").alias("size"), F.lit(1).cast("bigint").alias("modified_ns"),
    )
    steps, whole = SnapshotStore(spark, str(tmp_path / "steps")), SnapshotStore(spark, str(tmp_path / "whole"))
    for end in ("/p0080", "/p0150", "/p9"):
        sync(spark, files.where(F.col("path") < end), steps, fingerprint, 95, scratch, index_from)
    sync(spark, files, whole, fingerprint, 95, scratch)
    assert state_of(steps) == state_of(whole)
    shrunk = files.where("path not like '%7.png'")
    sync(spark, shrunk, steps, fingerprint, 95, scratch, index_from)
    index = steps.manifest().index
    assert (index is None) == (index_from > 200)
    steps.vacuum(keep=1, orphan_hours=-1)
    kept = [n for n in os.listdir(tmp_path / "steps") if n.startswith("keys-")]
    assert kept == ([os.path.basename(index["folder"])] if index else [])
    if index:  # holds every fingerprint ever stored, the forgotten ones too
        keys = spark.read.parquet(f"{index['folder']}/keys").select("phash").distinct().count()
        assert keys == 200 == state_count(whole)
    again = SnapshotStore(spark, str(tmp_path / "again"))
    sync(spark, shrunk, again, fingerprint, 95, scratch)
    paths = lambda s: {p: {q for q, w in state_of(s).items() if w[2] == v[2]} for p, v in state_of(s).items()}
    assert paths(steps) == paths(again)


def test_report_without_groups(spark, scratch, tmp_path):
    images = spark.createDataFrame([("/a", 1)], "path string, group_id bigint")
    failed = spark.createDataFrame([("/ü\\\"", "bad\n")], "path string, error string")
    keys = (
        "carpeta_analizada", "similitud_minima_porcentaje", "imagenes_analizadas", "hashes_reutilizados_cache",
        "hashes_calculados_esta_ejecucion", "actualizacion_incremental_grupos", "imagenes_nuevas_agregadas_a_grupos",
    )
    summary = dict.fromkeys(keys, 0) | {"carpeta_analizada": "/ñ"}
    for unread in (failed, failed.limit(0)):
        lines = report_lines(summary, images, unread, scratch).orderBy("section", "major", "minor", "place")
        text = "\n".join(r.line for r in lines.collect())
        want = summary | {"imagenes_no_leidas": [{"ruta": r.path, "error": r.error} for r in unread.collect()], "grupos": []}
        assert text == json.dumps(want, ensure_ascii=False, indent=2)
    write_report(summary, images, failed, str(tmp_path / "r"), scratch)


def test_scratch_is_in_the_named_folder(spark):
    assert Scratch(spark).root.startswith(spark.conf.get("spark.checkpoint.dir"))
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
