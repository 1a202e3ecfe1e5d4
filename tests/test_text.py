import hashlib
import html
from urllib.parse import urljoin, urlparse

from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from twinlabel import functions as T
from twinlabel.functions.text import truncate_text

X = F.col("x")
quick = settings(
    max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
# No lone surrogates: they are not text Spark can hold.
words = st.text(
    st.one_of(
        st.sampled_from("abcABC-_× \t\n\x0b\x1c\x85\xa0 　ｘＡé/"),
        st.characters(exclude_categories=["Cs"], max_codepoint=0x2FFF),
    ),
    max_size=30,
)


def plain_norm(value):
    value = (value or "").lower()
    for old, new in (("-", " "), ("_", " "), ("×", "x")):
        value = value.replace(old, new)
    return " ".join(value.split())


@quick
@given(st.lists(words, min_size=20, max_size=60))
def test_norm_and_tokens_agree_with_plain_rule(evaluate, values):
    got = evaluate(values, "x string", T.norm(X), T.token_set(X))
    for value, (norm, tokens) in zip(values, got):
        assert norm == plain_norm(value)
        assert set(tokens) == set(plain_norm(value).split()) and len(set(tokens)) == len(tokens)


def test_norm_edges(evaluate):
    got = evaluate(["M8×20-A_b", None, "", "  ", "a　 b", "×"], "x string", T.norm(X))
    assert got == ["m8x20 a b", "", "", "", "a b", "x"]


@quick
@given(st.lists(words, min_size=20, max_size=60))
def test_strip_agrees_with_python(evaluate, values):
    assert evaluate(values, "x string", T.strip(X)) == [v.strip() for v in values]


@quick
@given(st.lists(st.tuples(words, words), min_size=20, max_size=40))
def test_item_name_match_agrees_with_plain_rule(evaluate, pairs):
    def rule(a, b):
        a, b = set(plain_norm(a).split()), set(plain_norm(b).split())
        return bool(a and b and len(a & b) / min(len(a), len(b)) >= 0.5)

    got = evaluate(pairs, "a string, b string", T.item_name_match(F.col("a"), F.col("b")))
    assert got == [rule(a, b) for a, b in pairs]


def test_item_name_match_limits(evaluate):
    rows = [("a b", "a c"), ("a b c", "a x y"), ("", "a"), (None, None), ("a", "A"), ("a", "b")]
    got = evaluate(rows, "a string, b string", T.item_name_match(F.col("a"), F.col("b")))
    assert got == [True, False, False, False, True, False]


def test_category_match_never_null(evaluate):
    rows = [("building-hardware", "Building  Hardware"), ("plumbing", None), (None, None)]
    assert evaluate(rows, "a string, b string", T.category_match(F.col("a"), F.col("b"))) == [
        True, False, True]


def test_payload_limits(evaluate):
    rows = ["", None, "QUJD", "QUJD\n", "QU JD", "data:image/png;base64,QUJD", "AAAA", "AAAAA"]
    assert evaluate(rows, "x string", T.valid_payload(X, 4)) == [
        False, False, True, False, False, False, True, False]


def test_payload_default_limit_is_inclusive(evaluate):
    sizes = evaluate([7_000_000, 7_000_001], "n int", T.valid_payload(F.repeat(F.lit("A"), F.col("n"))))
    assert sizes == [True, False]


def test_base64_is_one_line(evaluate):
    body = bytes(range(256)) * 2
    text, digest, size = evaluate(
        [bytearray(body)], "x binary", T.base64_line(X), T.sha256(X), T.byte_length(X)
    )[0]
    import base64

    assert text == base64.b64encode(body).decode()
    assert digest == hashlib.sha256(body).hexdigest() and size == 512


def test_decode_utf8_replace(evaluate):
    got = evaluate([bytearray(b"a\xffb"), bytearray("é".encode())], "x binary", T.decode_utf8_replace(X))
    assert got == ["a�b", "é"]


def test_media_type(evaluate):
    rows = [None, "", "Image/PNG; q=1", " text/html ;x", "image/jpeg"]
    assert evaluate(rows, "x string", T.media_type(X)) == [
        "", "", "image/png", "text/html", "image/jpeg"]


def test_strip_code_fence(evaluate):
    rows = ['```json\n{"a":1}\n```', "```\nx\n```", " x ", "```json", "``````", "x```", "　a",
            "```JSON\nx```"]
    assert evaluate(rows, "x string", T.strip_code_fence(X)) == [
        '{"a":1}', "x", "x", "", "", "x", "a", "JSON\nx"]


def test_truncate_and_errors(evaluate):
    assert evaluate(["ab😀cd"], "x string", truncate_text(X, 3)) == ["ab😀"]
    assert evaluate([("E", "m"), ("E", None)], "a string, b string",
                    T.error_text(F.col("a"), F.col("b"))) == ["E: m", "E: "]
    rows = [(199, "c", "m"), (200, "c", "m"), (299, None, None), (300, None, "m"), (500, "c", None)]
    got = evaluate(rows, "s int, c string, m string",
                   T.upstream_error(F.col("s"), F.col("c"), F.col("m")))
    assert got == ["HTTP 199: c m", None, None, "HTTP 300: None m", "HTTP 500: c None"]


def test_join_names(evaluate):
    assert evaluate([(["a", "b"],), ([],)], "x array<string>", T.join_names(X)) == ["a／b", ""]


@quick
@given(st.lists(st.text(st.sampled_from("&amp;lt#39x3c;copy éＡ<"), max_size=20), min_size=20,
                max_size=60))
def test_html_unescape_agrees_with_library(evaluate, values):
    assert evaluate(values, "x string", T.html_unescape(X)) == [html.unescape(v) for v in values]


LINKS = ["/a.jpg", "//cdn.x/a.jpg", "a.jpg", "../a.jpg", "/../a/./b.jpg", "https://y.z/a.jpg",
         "http://y.z", "https://y.z/a?", "https://y.z/a#", "https://y.z/a?q=1#f", "?q", "#f", "",
         "/a b.jpg", "mailto:x@y", "HTTPS://Y.Z/a", "/a//b", "/a/..", "https://y.z/a/../b", "/é/ü.png",
         "javascript:void(0)", "/a;b=1", "https://u:p@y.z/a", "/a?x=/../b", "data:image/png;base64,AA="]
BASES = ["https://s.t/p/q/r.html?x#y", "http://s.t", "https://s.t:8080/", "ftp://s.t/a/b", "/rel"]


def test_absolutise_agrees_with_library(evaluate):
    rows = [(b, u) for b in BASES for u in LINKS]
    got = evaluate(rows, "b string, u string", T.absolutise(F.col("b"), F.col("u")))
    assert got == [urljoin(b, u) for b, u in rows]


def test_absolutise_bad_link_is_null(evaluate):
    got = evaluate([("https://s.t/", "http://[x"), (None, "a")], "b string, u string",
                   T.absolutise(F.col("b"), F.col("u")))
    assert got[0] is None


@quick
@given(st.lists(st.text(st.sampled_from("/.:?#ab-éＡ;=&%@ h"), max_size=14), min_size=30, max_size=60))
def test_absolutise_random(evaluate, urls):
    rows = [(BASES[0], u) for u in urls]

    def rule(b, u):
        try:
            return urljoin(b, u)
        except ValueError:
            return None

    assert evaluate(rows, "b string, u string", T.absolutise(F.col("b"), F.col("u"))) == [
        rule(b, u) for b, u in rows]


def test_url_path_lower_agrees_with_library(evaluate):
    rows = [urljoin(b, u) for b in BASES for u in LINKS] + ["https://x/A;B/C;d.JPG", "data:x.jpg;y"]
    assert evaluate(rows, "x string", T.url_path_lower(X)) == [urlparse(u).path.lower() for u in rows]


def test_link_patterns(evaluate):
    page = """<img SRC = "a.jpg" data-src='b.png'><a href="">x</a> <meta content=" c.gif ">
      see https://x.y/z.webp, and "http://q/r" <https://t/u>"""
    got = evaluate([page], "x string", T.attr_values(X), T.bare_urls(X), T.raw_candidates(X))[0]
    assert got[0] == ["a.jpg", "b.png", " c.gif "]
    assert got[1] == ["https://x.y/z.webp,", "http://q/r", "https://t/u"]
    assert got[2] == ["a.jpg", "b.png", "c.gif", "https://x.y/z.webp,", "http://q/r", "https://t/u"]


def test_filters_and_og(evaluate):
    urls = ["https://x/a.JPG?x", "https://x/b.pdf", "https://x/c.png/large", "https://x/?f=d.gif"]
    got = evaluate([(urls, "C"), (urls, ""), (urls, None), (urls, "zz")], "u array<string>, h string",
                   T.image_url_filter(F.col("u")), T.hint_filter(F.col("u"), F.col("h")))
    assert got[0] == ([urls[0], urls[2]], [urls[2]])
    assert [g[1] for g in got[1:]] == [[], [], []]
    og = ['<meta property="og:image" content="a">', "<META content='b' property='og:image'>", "<p>",
          '<meta content="n" property="og:image"><meta property="og:image" content="m">']
    assert evaluate(og, "x string", T.og_image(X)) == ["a", "b", None, "m"]


def test_batches_of_pages_are_small(spark):
    import pyarrow as pa
    from pyspark.sql import functions as F

    @F.arrow_udf("long")
    def size(pages: pa.Array) -> pa.Array:
        return pa.array([pages.nbytes] * len(pages), pa.int64())

    pages = spark.range(0, 300, 1, 1).select(F.repeat(F.lit("&amp;"), 20_000).alias("page"))
    assert pages.select(F.max(size("page"))).first()[0] < 20 << 20
