import json
import struct
import zlib

import numpy as np
import pytest

import twinsift
from twinsift import cli
from twinsift.api import ImageFinder, VideoFinder
from twinsift.sources.catalog import filter_paths, find_images, walk_files
from twinsift.sources.decoders import ImageFile
from twinsift.sources.media import read_images, read_videos
from twinsift.streaming.fingerprints import arrivals_per_window, exact_matches, watch_images, watch_rows


def png(image):
    """A PNG file of a grey or RGB array."""
    rows = b"".join(b"\0" + r.tobytes() for r in image)

    def part(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", image.shape[1], image.shape[0], 8, 2 if image.ndim == 3 else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(rows)) + part(b"IEND", b"")


@pytest.fixture
def folder(tmp_path):
    i, j = np.mgrid[0:128, 0:128]
    image = np.dstack([i, j, i * j % 256]).astype(np.uint8)
    other = np.random.default_rng(1).integers(0, 256, (64, 64), np.uint8)
    patched = image.copy()
    patched[:6, :6] = 255
    for name, a in {"a.png": image, "sub/b.PNG": image, "sub/c[1].png": patched, "grey.png": other, "d.Png": image, "$RECYCLE.BIN/e.png": image, ".cache/f.png": image, "_g.png": other}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True, parents=True)
        (tmp_path / name).write_bytes(png(a))
    (tmp_path / "bad.jpg").write_text("not an image")
    (tmp_path / "dir.png").mkdir()
    (tmp_path / "notes.txt").write_text("x")
    return tmp_path


def test_listing(spark, folder):
    names = lambda df: sorted(r[0][len(str(folder)) + 1 :] for r in df.select("path").collect())
    assert names(find_images(spark, str(folder))) == ["a.png", "bad.jpg", "grey.png", "sub/b.PNG", "sub/c[1].png"]
    assert names(walk_files(spark, str(folder), [".png", ".jpg"])) == ["_g.png", "a.png", "bad.jpg", "grey.png", "sub/b.PNG", "sub/c[1].png"]
    paths = spark.createDataFrame([("/x/a.png",), ("/x/a.png",), ("/x/.git/b.png",), (None,)], "path string")
    assert [r[0] for r in filter_paths(paths, [".png"]).collect()] == ["/x/a.png"]


def test_images_become_rows_and_groups(spark, folder, capsys):
    finder = ImageFinder(spark, threshold=0.9)
    rows = {r["path"].rsplit("/", 1)[1]: r for r in read_images(spark, finder.find(str(folder))).collect()}
    assert (rows["a.png"]["width"], rows["a.png"]["height"], rows["a.png"]["format"], rows["a.png"]["mode"]) == (128, 128, "PNG", "RGB")
    assert rows["grey.png"]["mode"] == "L" and len(rows["a.png"]["phash"]) == 64
    assert rows["bad.jpg"]["phash"] is None and rows["bad.jpg"]["file_size"] == 12 and rows["bad.jpg"]["width"] == 0
    finder.process(finder.find(str(folder))).cache()
    groups = finder.duplicates()
    held = sorted((r["group_id"], r["path"].rsplit("/", 1)[1]) for r in groups.collect())
    assert (1, "a.png") in held and (1, "b.PNG") in held and all(n != "grey.png" for _, n in held)
    target = folder / "out.json"
    finder.report(groups, str(target))
    said = json.loads(target.read_text())
    assert set(said) == {"duplicate_groups", "total_groups", "total_duplicates", "potential_savings_bytes"}
    assert set(said["duplicate_groups"][0][0]) == {"path", "resolution", "format", "size", "similarity"}
    assert "DUPLICATE IMAGE GROUPS FOUND" in capsys.readouterr().out
    assert finder.similarity(rows["a.png"], rows["b.PNG"]) == 1.0
    assert finder.similarity(rows["a.png"], rows["bad.jpg"]) == 0.0
    assert "whash" not in finder.export().columns


def test_missing_files_are_rows_and_a_decoder_reads_each_file_once(spark, folder):
    files = spark.createDataFrame([(str(folder / "a.png"), 9), (str(folder / "gone.png"), 7), (str(folder / "bad.jpg"), None)], "path string, length long")
    plain = {r["path"].rsplit("/", 1)[1]: r for r in read_images(spark, files).collect()}
    assert set(plain) == {"a.png", "gone.png", "bad.jpg"} and plain["gone.png"]["phash"] is None and plain["gone.png"]["file_size"] == 7
    assert read_images(spark, files.where("length = 7")).first()["width"] == 0

    def decoder(data):
        head = data.find(b"IDAT")
        if head < 0:
            return None
        width, height = struct.unpack(">II", data[16:24])
        rows = np.frombuffer(zlib.decompress(data[head + 4 : -16]), np.uint8).reshape(height, -1)[:, 1:]
        return ImageFile(rows.reshape(height, width, -1), "PNG", "RGB")

    own = {r["path"].rsplit("/", 1)[1]: r for r in read_images(spark, files, decoder=decoder).collect()}
    assert all(own["a.png"][c] == plain["a.png"][c] for c in ("width", "height", "format", "mode", "phash", "ahash", "dhash", "whash", "file_size"))
    assert own["gone.png"]["phash"] is None and own["bad.jpg"]["file_size"] == 12
    single = twinsift.ImageHasher(decoder=decoder).hash_file(str(folder / "a.png"))
    assert single == own["a.png"].asDict()
    assert twinsift.ImageHasher(decoder=decoder).hash_file(str(folder / "gone.png"))["phash"] is None


def test_a_single_video_has_the_row_of_the_table(spark, tmp_path):
    frames = np.random.default_rng(4).integers(0, 256, (47, 24, 24), np.uint8)
    with open(tmp_path / "a.mp4", "wb") as f:
        np.savez(f, frames=frames, fps=0.0)
    (tmp_path / "bad.mp4").write_text("x")
    hasher = twinsift.VideoHasher()
    for row in read_videos(spark.createDataFrame([(str(tmp_path / n), (tmp_path / n).stat().st_size) for n in ("a.mp4", "bad.mp4")], "path string, length long")).collect():
        assert hasher.hash_file(row["path"]) == row.asDict()
    assert hasher.hash_file(str(tmp_path / "gone.mp4"))["file_size"] == 0


def test_exports():
    assert all(getattr(twinsift, n) is not None for n in twinsift.__all__)
    with pytest.raises(AttributeError):
        twinsift.nothing


def test_videos_become_rows_and_groups(spark, tmp_path):
    rng = np.random.default_rng(2)
    frames = rng.integers(0, 256, (60, 32, 32), np.uint8)
    for name, a in {"a.mp4": frames, "b.avi": frames, "c.mkv": frames[::-1].copy() // 2 + rng.integers(0, 128, frames.shape, np.uint8)}.items():
        with open(tmp_path / name, "wb") as f:
            np.savez(f, frames=a, fps=30.0)
    (tmp_path / "bad.mp4").write_text("x")
    finder = VideoFinder(spark)
    rows = {r["path"].rsplit("/", 1)[1]: r for r in read_videos(finder.find(str(tmp_path))).collect()}
    assert (rows["a.mp4"]["frame_count"], rows["a.mp4"]["duration"], len(rows["a.mp4"]["frame_hashes"])) == (60, 2.0, 10)
    assert rows["bad.mp4"]["frame_hashes"] == [] and rows["bad.mp4"]["average_hash"] is None
    finder.process(finder.find(str(tmp_path))).cache()
    assert sorted(r["path"].rsplit("/", 1)[1] for r in finder.duplicates().collect()) == ["a.mp4", "b.avi"]
    assert finder.similarity(rows["a.mp4"], rows["b.avi"]) == 1.0
    assert finder.similarity(rows["a.mp4"], rows["bad.mp4"]) == 0.0
    target = tmp_path / "v.json"
    finder.report(finder.duplicates(), str(target))
    said = json.loads(target.read_text())
    assert "total_duplicates" not in said and set(said["duplicate_groups"][0][0]) == {"path", "resolution", "duration", "size", "similarity"}


def test_command_line(spark, folder, tmp_path_factory, capsys):
    empty = tmp_path_factory.mktemp("empty")
    assert cli.main([]) == 0
    assert cli.main(["images", str(empty / "gone")]) == 1
    assert cli.main(["images", str(empty), "-t", "0"]) == 1
    assert cli.main(["images", str(empty)]) == 0
    assert "holds no images" in capsys.readouterr().out
    (empty / "x.png").write_text("no")
    assert cli.main(["images", str(empty)]) == 1
    assert cli.main(["videos", str(empty)]) == 0
    target = folder / "cli.json"
    assert cli.main(["images", str(folder), "--hash-type", "phash", "-o", str(target)]) == 0
    assert json.loads(target.read_text())["total_groups"] >= 1
    for kind, threshold in (("images", 0.9), ("videos", 0.85)):
        args = cli.parser().parse_args([kind, "x"])
        assert (args.threshold, args.hash_size, args.workers, args.output, args.no_gpu) == (threshold, 16, 4, None, False)


def test_no_groups_write_no_file(spark, tmp_path, capsys):
    finder = ImageFinder(spark)
    finder.add(spark.createDataFrame([("/a", 1, 1, 1, "PNG", "L", "ff" * 32, None, None, None)], "path string, width int, height int, file_size long, format string, mode string, phash string, ahash string, dhash string, whash string"))
    finder.report(finder.duplicates(), str(tmp_path / "none.json"))
    assert not (tmp_path / "none.json").exists()
    assert "No duplicate images" in capsys.readouterr().out
    with pytest.raises(ValueError):
        ImageFinder(spark, threshold=1.5)


def test_streams(spark, folder, tmp_path_factory):
    out = tmp_path_factory.mktemp("stream")
    watch_images(spark, str(folder), str(out / "rows"), str(out / "ck")).awaitTermination()
    first = spark.read.parquet(str(out / "rows"))
    assert sorted(r["path"][len(str(folder)) + 1 :] for r in first.collect()) == ["a.png", "bad.jpg", "grey.png", "sub/b.PNG", "sub/c[1].png"]
    watch_images(spark, str(folder), str(out / "rows"), str(out / "ck")).awaitTermination()
    assert spark.read.parquet(str(out / "rows")).count() == 5
    kind = "path string, phash string, file_size long, scanned_at timestamp"
    spark.sql("select * from values ('/a', 'x', 1L, timestamp'2024-01-01 00:00:00'), ('/b', 'x', 2L, timestamp'2024-01-01 05:00:00'), ('/c', 'y', 4L, timestamp'2024-01-05 00:00:00'), ('/d', 'x', 8L, timestamp'2024-01-05 01:00:00') t(path, phash, file_size, scanned_at)").write.parquet(str(out / "in"))
    query = exact_matches(watch_rows(spark, str(out / "in"), kind)).writeStream.format("memory").queryName("matches").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(tuple(r) for r in spark.table("matches").collect()) == [("x", "/b", "/a"), ("x", "/d", "/a")]
    query = arrivals_per_window(watch_rows(spark, str(out / "in"), kind)).writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted((r["files"], r["bytes"]) for r in spark.table("windows").collect()) == [(2, 3), (2, 12)]
