"""Decontamination, archives and url filter against plain Python."""

import hashlib
import re
from collections import Counter

import pytest

from twinlabel.llm import url_filter, warc
from twinlabel.llm.decontamination import (
    contamination,
    exact_matches,
    phrases_of,
    postings,
    proximity_matches,
    rarest_terms,
    tokenised,
    without_contaminated,
)

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(AZ))


@pytest.fixture(scope="module")
def items(spark, rows):
    base = words(rows[0][1])
    made = [
        (1, " ".join(base[20:45])),
        (2, " ".join(base[30:38])),
        (3, "same id"),
        (4, "!!"),
        (5, None),
        (None, " ".join(base[50:70])),
        (1, "zzz " * 12),
        (7, "Ñandú été ñandú"),
        (8, " ".join(words(rows[8][1])[-10:])),
    ]
    return spark.createDataFrame([(*m, "x", 1) for m in made], "item_id long, text string, phrase string, n int")


def test_contamination(docs, rows, items, no_docs):
    windows = []
    for item, text in [tuple(r)[:2] for r in items.collect()]:
        w = words(text)
        windows += [(item, w[i : i + 10]) for i in range(max(1, len(w) - 9)) if w]
    want = Counter()
    for row in rows:
        w, hit, found = words(row[1]), set(), set()
        for item, window in windows:
            for s in range(len(w) - len(window) + 1) if len(w) < 5000 or item == 8 else ():
                if w[s : s + len(window)] == window:
                    hit.update(range(s, s + len(window)))
                    found.add(item)
        names = ",".join(sorted(str(i) for i in found if i is not None))
        digest = hashlib.sha256(names.encode()).hexdigest()
        want[(row[0], len(w), len(hit), len(found - {None}), digest, bool(hit))] += 1
    assert Counter(tuple(r) for r in contamination(docs, items).collect()) == want
    kept = without_contaminated(docs, items)
    assert kept.columns == docs.columns
    assert Counter(r[0] for r in kept.collect()) == Counter(w[0] for w in want.elements() if not w[5])
    assert contamination(no_docs, items).count() == 0
    clean = contamination(docs, items.limit(0)).collect()
    assert len(clean) == len(rows) and not any(r.contaminated for r in clean)


def test_proximity_finds_what_slipped(spark):
    text = "a b c d rare1 e f g rare2 h"
    made = spark.createDataFrame(
        [(1, text), (2, text.replace("e f g", "e f new g")), (3, "rare2 x rare1"), (4, "a b c d e f g h rare1 " * 3)],
        "doc_id long, text string",
    )
    tokens = tokenised(made)
    anchors = rarest_terms(tokens, phrases_of(spark.createDataFrame([(1, text)], "item_id long, text string")))
    index = postings(tokens, anchors)
    assert {r._key for r in exact_matches(tokens, index, anchors).collect()} == {1}
    assert {r._key for r in proximity_matches(index, anchors, 1).collect()} == {1, 2}
    assert {r._key for r in proximity_matches(index, anchors, 0).collect()} == {1}


PAGES = "page_id long, url string, html string, key string, URL string"


def pages(spark, rows):
    spark.conf.set("spark.sql.caseSensitive", "true")
    made = spark.createDataFrame([(*r, "k", "u") for r in rows], PAGES)
    spark.conf.set("spark.sql.caseSensitive", "false")
    return made


def test_archives_round_trip(spark, tmp_path):
    long = "<p>ü</p>" * 40
    rows = [(i, f"http://h{i % 7}.example.com/{i}", f"<p>{i}</p>" * 30) for i in range(300)]
    rows += [(1000 + i, f"http://same.org/{i}", long) for i in range(40)]
    rows += [(5000, None, None), (5001, "no scheme\n\ttab", "short"), (5002, "", "short"), (None, "http://n.org/", long)]
    rows += [(1000, "http://same.org/0", long), (None, None, "")]
    got = Counter(tuple(r) for r in warc.archived(pages(spark, rows), f"file://{tmp_path}").collect())
    want = Counter()
    for page, _, html in rows:
        data = (html or "").encode()
        revisit = html == long and page != 1000
        want[
            (page, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", 1000 if revisit else None)
        ] += 1
    assert got == want
    some = pages(spark, [(7, "http://h0.example.com/7", ""), (8, "http://h0.example.com/7", "")])
    assert [r.page_id for r in warc.lookup(f"file://{tmp_path}", some).collect()] == [7]


def test_no_pages(spark, tmp_path):
    assert warc.archived(pages(spark, []), f"file://{tmp_path}").count() == 0
    assert url_filter.judged(pages(spark, [])).count() == 0


def test_urls_rules_and_trust(spark):
    link = lambda *hosts: "".join(f'<a HREF = "https://{h}/x">y</a>' for h in hosts)
    rows = [
        (1, "http://www.example.com/en/a", link("good.org", "mailto")),
        (2, "http://shop.example.com/en/a?x=1", None),
        (3, "HTTP://A.Example.COM/de/?q#f", '<a href="/in">x</a><a href=//good.org/>'),
        (4, "http://bad.net/es/1", ""),
        (5, "http://bad.net/de/1", ""),
        (6, "http://friend.org/", link("bad.net", "bad.net")),
        (7, "http://good.org/", '<a href="mailto:x@y">'),
        (8, "http://alone.org#frag", ""),
        (9, None, None),
        (10, "no scheme", "x"),
        (11, "http://example.com", ""),
        (None, "http://www.example.com/en/?://net/es/", ""),
        (5, "http://bad.net/de/1", ""),
    ]
    got = Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.judged(pages(spark, rows)).collect())
    assert got == Counter(
        [
            (1, "www.example.com", "/en/a", "www.example.com/en/", "allow"),
            (2, "shop.example.com", "/en/a", "example.com/en/", "block"),
            (3, "a.example.com", "/de/", "com/", "allow"),
            (4, "bad.net", "/es/1", "net/es/", "block"),
            (5, "bad.net", "/de/1", None, "block"),
            (5, "bad.net", "/de/1", None, "block"),
            (6, "friend.org", "/", None, "block"),
            (7, "good.org", "/", None, "allow"),
            (8, "alone.org", "", None, "allow"),
            (9, "", "", None, "allow"),
            (10, "", "", None, "allow"),
            (11, "example.com", "", None, "allow"),
            (None, "www.example.com", "/en/", "www.example.com/en/", "allow"),
        ]
    )


def test_mass_is_kept(spark):
    made = spark.createDataFrame([("a", "b", 1.0), ("a", "c", 3.0), ("b", "a", 1.0)], "source string, target string, weight double")
    seeds = spark.createDataFrame([("a", 2.0), ("d", 1.0), ("c", 0.0)], "host string, seed double")
    got = {r.host: r.score for r in url_filter.propagate(made, seeds).collect()}
    assert abs(sum(got.values()) - 3) < 1e-9 and got["c"] > got["b"] > 0 and abs(got["d"] - 1) < 1e-9
