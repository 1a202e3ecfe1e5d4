import struct
import zlib

from pyspark.sql import functions as F

from twinlabel import functions as T
from twinlabel.plans.images import image_preflight
from twinlabel.sources.readers import read_image_files
from twinlabel.sources.small_files import read_files


def png(width, height):
    def chunk(kind, data):
        body = kind + data
        return struct.pack(">I", len(data)) + body + struct.pack(">I", zlib.crc32(body))

    raw = (b"\x00" + b"\x00\x00\x00" * width) * height
    return (b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0))
            + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_target_size(evaluate):
    rows = [(1800, 1800), (3600, 1800), (1, 3601), (100, 50), (3600, 1), (2400, 1801)]
    got = evaluate(rows, "w int, h int", T.target_size(F.col("w"), F.col("h")))

    def rule(w, h):
        scale = min(1, 1800 / w, 1800 / h)
        return int(w * scale + 0.5), int(h * scale + 0.5)

    assert [(r.width, r.height) for r in got] == [rule(w, h) for w, h in rows]


def test_acceptance_order(evaluate):
    rows = [(0, None, None, "text/html"), (5, None, None, ""), (5, -1, -1, ""), (5, 199, 500, "text/html"),
            (5, 200, 200, "text/html"), (5, 200, 200, ""), (5, 200, 200, None), (5, 300, 200, "image/png")]
    got = evaluate(rows, "l long, w int, h int, c string",
                   T.image_acceptance(*[F.col(c) for c in "lwhc"]))
    assert got == ["empty_body", "undecodable", "undecodable", "too_small", "not_an_image", "ok", "ok",
                   "ok"]


def test_formats(evaluate):
    rows = ["JPEG", "PNG", "WEBP", "GIF", "BMP", None]
    got = evaluate(rows, "x string", T.needs_conversion(F.col("x")), T.final_format(F.col("x")),
                   T.final_mime(F.col("x")))
    assert got == [(False, "JPEG", "image/jpeg"), (False, "PNG", "image/png"),
                   (False, "WEBP", "image/webp"), (False, "GIF", "image/gif"),
                   (True, "JPEG", "image/jpeg"), (True, "JPEG", "image/jpeg")]


def test_page_acceptance(evaluate):
    rows = ["", None, "text/html", "application/xhtml+xml", "application/pdf"]
    assert evaluate(rows, "x string", T.page_acceptance(F.col("x"))) == [
        "ok", "ok", "ok", "ok" if "html" in rows[3] else "not_html", "not_html"]


def jpeg(width, height, segments=0, frame=0xC0, tail=b"\xff\xd9"):
    apps = b"".join(b"\xff\xe1" + struct.pack(">H", 2 + i % 300) + b"\xff" * (i % 300) for i in range(segments))
    sof = b"\xff" + bytes([frame]) + struct.pack(">HBHHB", 11, 8, height, width, 1) + b"\x01\x11\x00"
    return b"\xff\xd8" + apps + b"\xff\xff\xff\x01" + sof + b"\xff\xda\x00\x02" + b"data" + tail


def webp(kind, body):
    return b"RIFF" + struct.pack("<I", 12 + len(body)) + b"WEBP" + kind + struct.pack("<I", len(body)) + body


def test_sizes_from_headers(evaluate):
    broken = bytearray(png(7, 9))
    broken[17] ^= 1
    cases = [
        (png(70_000, 1), (70_000, 1)),
        (png(7, 9) + b"more", (7, 9)),
        (png(7, 9)[:-4], None),
        (bytes(broken), None),
        (jpeg(640, 480), (640, 480)),
        (jpeg(640, 480, 30, 0xC2), (640, 480)),
        (jpeg(300, 65_535, 400), (300, 65_535)),
        (b"\xff\xd8\xff\xda\x00\x02data", None),
        (b"\xff\xd8\xff\xe1\xff\xff", None),
        (b"\xff\xd8\xff", None),
        (b"\xff\xd8\xff\xc0\x00\x0b\x08\x01", None),
        (b"GIF89a" + struct.pack("<HH", 300, 200) + b"\x00", (300, 200)),
        (b"GIF87a\x01", None),
        (b"BM" + b"\x00" * 16 + struct.pack("<ii", 33, -44), (33, 44)),
        (webp(b"VP8X", b"\x00" * 4 + (999).to_bytes(3, "little") + (499).to_bytes(3, "little")), (1000, 500)),
        (webp(b"VP8L", b"\x2f" + ((99) | (199 << 14)).to_bytes(4, "little")), (100, 200)),
        (webp(b"VP8 ", b"\x00\x00\x00\x9d\x01\x2a" + struct.pack("<HH", 320, 240)), (320, 240)),
        (png(0, 5), None),
        (b"", None),
        (None, None),
        (b"hello", None),
    ]
    got = evaluate([c for c, _ in cases], "b binary", T.image_size(F.col("b")))
    assert [g and (g.width, g.height) for g in got] == [want for _, want in cases]


def test_preflight_of_files(spark, tmp_path):
    good = png(200, 200)
    files = {"good.png": good, "small.png": png(199, 200), "cut.png": good[: len(good) // 2],
             "text.jpg": b"hello", "empty.png": b"", "page.png": good}
    for name, body in files.items():
        (tmp_path / name).write_bytes(body)
    base = f"file:{tmp_path}"
    manifest = spark.createDataFrame(
        [(f"{base}/good.png", "Image/PNG; q=1"), (f"{base}/page.png", "text/html"),
         (f"{base}/empty.png", "image/png")],
        "path string, content_type string",
    )
    rows = {r.path.rsplit("/", 1)[1]: r for r in
            image_preflight(read_image_files(spark, str(tmp_path)), manifest).collect()}
    assert {n: (r.status, r.error) for n, r in rows.items()} == {
        "good.png": ("ok", None),
        "small.png": ("download_failed", "too_small: 199x200"),
        "cut.png": ("download_failed", "undecodable"),
        "text.jpg": ("download_failed", "undecodable"),
        "empty.png": ("download_failed", "empty_body"),
        "page.png": ("download_failed", "not_an_image: text/html"),
    }
    ok = rows["good.png"]
    assert (ok.original_format, ok.width, ok.height, ok.mime) == ("PNG", 200, 200, "image/png")
    assert ok.original_bytes == len(good) and ok.api_sha256 == ok.original_sha256
    assert ok.content_type == "image/png" and not ok.converted_for_api


def test_tiny_files_share_tasks(spark, tmp_path):
    for n in range(400):
        (tmp_path / f"{n}.img").write_bytes(b"x")
    assert read_image_files(spark, str(tmp_path)).rdd.getNumPartitions() <= 6


def test_files_are_those_of_sparks_reader(spark, tmp_path):
    names = ["a.img", "b c%20+é#.img", "\u3000ª²\u00a0\u2028\U0001f600~;@&$,!'()[]{}^|`\"<>?\\.img", "x/y/z/deep.img", "x/=1.img", "p=1/_k=2.img"]
    left_out = ["_hidden/a.img", "x/.part.img", "x/_b.img", "a._COPYING_", "x/none.img"]
    for name in [*names, *left_out]:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"" if name == "x/none.img" else name.encode())
    (tmp_path / "empty" / "folder").mkdir(parents=True)

    def facts(frame):
        return sorted((r.path, r.length, bytes(r.content)) for r in frame.collect())

    whole = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    want = whole.load(str(tmp_path)).select(F.col("_metadata.file_path").alias("path"), "length", "content")
    assert [c for *_, c in facts(want)] and {c.decode() for *_, c in facts(want)} == set(names)
    assert facts(read_files(spark, str(tmp_path))) == facts(want)
    assert facts(read_files(spark, f"{tmp_path}/x/y/*")) == facts(read_files(spark, f"{tmp_path}/x/y/z"))
    assert facts(read_files(spark, f"{tmp_path}/a.img")) == facts(want.where("path LIKE '%/a.img'"))
    assert not facts(read_files(spark, f"{tmp_path}/empty"))
    assert facts(read_files(spark, f"{tmp_path}/")) == facts(want)
    # The driver keeps no list of the files.
    assert not any(f.endswith(".img") for f in read_image_files(spark, str(tmp_path)).inputFiles())


def test_a_header_is_read_once(spark, tmp_path, capsys):
    (tmp_path / "a.png").write_bytes(png(300, 200))
    read_image_files(spark, str(tmp_path)).explain()
    assert capsys.readouterr().out.count("crc32(") == 1
