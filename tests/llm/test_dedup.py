"""Exact, byte-wise, fuzzy and near duplicates against plain Python."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from twinlabel.llm import near_copies, passages, repeat_removal
from twinlabel.llm.chaining import Contexts
from twinlabel.llm.chaining import align, chains, seeds
from twinlabel.llm.components import components
from twinlabel.llm.exact_dedup import exact_duplicates, without_exact_duplicates
from twinlabel.llm.simhash_dedup import links, near_duplicates, without_near_duplicates
from twinlabel.llm.suffix_array import maximal_repeats

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lowered(text):
    return (text or "").translate(AZ)


def first(value):
    return -(2**70) if value is None else value


def test_exact_duplicates(docs, rows, no_docs):
    groups = defaultdict(list)
    for row in rows:
        groups[lowered(row[1])].append(row[0])
    want = Counter()
    for text, ids in groups.items():
        ids.sort(key=first, reverse=True)
        digest = hashlib.sha256(text.encode()).hexdigest()
        want.update((i, ids[0], len(ids), n == 0, digest) for n, i in enumerate(ids))
    assert Counter(tuple(r) for r in exact_duplicates(docs).collect()) == want
    assert exact_duplicates(no_docs).count() == 0


def test_a_text_cut_into_pieces_keeps_one_row(spark):
    made = spark.createDataFrame([(i, "Same" if i % 3 else f"t{i}") for i in range(300)], "doc_id long, text string")
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_duplicates(made).collect()}
    assert {i for i, (_, _, kept) in got.items() if kept} == {i for i in range(300) if i % 3 == 0} | {299}
    assert got[1] == (299, 200, False)


def test_kept_rows_come_back_whole(docs, rows):
    got = without_exact_duplicates(docs)
    assert got.columns == docs.columns
    assert Counter(r[1] and lowered(r[1]) or "" for r in got.collect()) == Counter({lowered(r[1]) for r in rows})


def by_brute_force(pairs, least):
    texts = [(text or "").encode() for _, text in pairs]
    count = Counter(t[i : i + least] for t in texts for i in range(len(t) - least + 1))
    out = Counter()
    for (doc_id, _), text in zip(pairs, texts):
        covered = bytearray(len(text))
        for i in range(len(text) - least + 1):
            if count[text[i : i + least]] > 1:
                covered[i : i + least] = b"\1" * least
        kept = bytes(b for b, c in zip(text, covered) if not c)
        spans = sum(c and not (i and covered[i - 1]) for i, c in enumerate(covered))
        out[(doc_id, len(text), sum(covered), spans, hashlib.sha256(kept).hexdigest())] += 1
    return out


@pytest.mark.parametrize("group_runs", [1000, 1])
def test_repeated_bytes(docs, rows, no_docs, group_runs):
    got = repeat_removal.without_repeats(docs, group_runs=group_runs)
    assert Counter(tuple(r) for r in got.collect()) == by_brute_force([r[:2] for r in rows], 400)
    assert repeat_removal.without_repeats(no_docs).count() == 0


def test_periodic_and_hot_bytes(spark):
    draw = random.Random(5)
    common = "".join(draw.choice("abcdef") for _ in range(700))
    pairs = [(i, "".join(draw.choice("xyz") for _ in range(draw.randrange(300))) + common[draw.randrange(200) :]) for i in range(60)]
    pairs += [(100, "!" * 1500), (101, "ab" * 300), (102, "!" * 399)]
    made = spark.createDataFrame(pairs, "doc_id long, text string")
    want = by_brute_force(pairs, 400)
    for group_runs in (1000, 10):
        got = repeat_removal.without_repeats(made, group_runs=group_runs)
        assert Counter(tuple(r) for r in got.collect()) == want


def test_maximal_repeats_are_all_and_only_those():
    draw = random.Random(1)
    for _ in range(40):
        strings = [bytes(draw.choice(b"ab") for _ in range(draw.randint(1, 40))) for _ in range(6)]
        found = defaultdict(set)
        for repeat, length, string, offset in zip(*maximal_repeats(strings, 5)):
            found[repeat, int(length)].add((int(string), int(offset)))
        got = {}
        for (_, length), places in found.items():
            string, offset = next(iter(places))
            got[strings[string][offset : offset + length]] = places
        places = defaultdict(set)
        for i, s in enumerate(strings):
            for a in range(len(s)):
                for b in range(a + 5, len(s) + 1):
                    places[s[a:b]].add((i, a))
        want = {}
        for w, at in places.items():
            left = {strings[i][a - 1 : a] or ("start", i) for i, a in at}
            right = {strings[i][a + len(w) : a + len(w) + 1] or ("end", i) for i, a in at}
            if len(at) > 1 and len(left) > 1 and len(right) > 1:
                want[w] = at
        assert got == want


def fingerprint(text):
    words = [w for w in "".join(" " if c in "\t\n\v\f\r" else c for c in lowered(text)).split(" ") if w]
    parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    ones = np.zeros(64, int)
    for part in parts:
        h = xxhash.xxh64_intdigest(part.encode(), 42)
        ones += [(h >> b) & 1 for b in range(64)]
    return sum(1 << b for b in range(64) if ones[b] * 2 > len(parts))


def test_near_duplicates(docs, rows, no_docs):
    prints = [fingerprint(r[1]) for r in rows]
    component = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                old, new = component[a], component[b]
                component = [new if c == old else c for c in component]
    want = Counter()
    for k, row in enumerate(rows):
        ids = [r[0] for r, c in zip(rows, component) if c == component[k] and r[0] is not None]
        want[(row[0], format(prints[k], "016x"), min(ids, default=None))] += 1
    assert Counter(tuple(r) for r in near_duplicates(docs).collect()) == want
    assert near_duplicates(no_docs).count() == 0
    kept = without_near_duplicates(docs)
    assert kept.columns == docs.columns
    smallest = {}
    for row, c in zip(rows, component):
        smallest.setdefault(c, []).append(row[0])
    stay = [min([i for i in ids if i is not None], default=None) for ids in smallest.values()]
    assert Counter(r[0] for r in kept.collect()) == Counter(stay)


def test_components_without_an_id_of_their_own_keep_a_row(spark):
    draw = random.Random(12)
    texts = [" ".join(str(draw.randrange(10**6)) for _ in range(60)) for _ in range(9)]
    ids = [None] * 5 + [7] * 3 + [8]
    made = spark.createDataFrame([*zip(ids, texts), (None, texts[0]), (9, texts[8])], "doc_id long, text string")
    prints = [fingerprint(t) for t in texts]
    assert min((a ^ b).bit_count() for n, a in enumerate(prints) for b in prints[:n]) > 3
    kept = Counter((r.doc_id, r.text) for r in without_near_duplicates(made).collect())
    assert kept == Counter(zip(ids, texts))


def test_all_links_of_clustered_fingerprints(spark):
    draw = random.Random(9)
    points = set()
    for _ in range(60):
        centre = draw.getrandbits(64)
        points.add(centre)
        for _ in range(40):
            points.add(centre ^ sum(1 << b for b in draw.sample(range(64), draw.randint(1, 4))))
    points |= {draw.getrandbits(64) for _ in range(2000)}
    points = sorted(points)
    made = spark.createDataFrame([(p - 2**64 if p >= 2**63 else p,) for p in points], "fingerprint long")
    got = {r.node % 2**64: r.component % 2**64 for r in components(links(made)).collect()}
    values = np.array(points, dtype=np.uint64)
    label = np.arange(len(points))
    for k in range(len(points)):
        for j in np.flatnonzero(np.bitwise_count(values ^ values[k]) <= 3):
            if label[j] != label[k]:
                label[label == label[j]] = label[k]
    groups = defaultdict(set)
    for p, c in zip(points, label):
        groups[c].add(p)
    again = defaultdict(set)
    for p in points:
        again[got.get(p, p)].add(p)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, again.values()))


def test_components_of_a_long_path_and_a_hub(spark):
    pairs = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5, 5)]
    made = spark.createDataFrame(pairs, "a long, b long")
    got = {r.node: r.component for r in components(made).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {1000 + i: 1000 for i in range(1, 200)}


def test_equal_words_share_a_seed():
    draw = np.random.default_rng(2)
    for _ in range(50):
        common = draw.integers(0, 2**63, 23).astype(np.uint64)
        one = np.concatenate([draw.integers(0, 2**63, 30).astype(np.uint64), common])
        two = np.concatenate([common, draw.integers(0, 2**63, 30).astype(np.uint64)])
        assert set(seeds(one, 8, 16)[0].tolist()) & set(seeds(two, 8, 16)[0].tolist())


def test_best_chain_equals_a_search_over_all_pairs():
    draw = np.random.default_rng(4)
    for _ in range(40):
        n = 25
        i, j = draw.integers(0, 60, n), draw.integers(0, 60, n)
        order = np.lexsort((j, i))
        i, j = i[order], j[order]
        score = np.full(n, 8.0)
        for b in range(n):
            for a in range(n):
                if i[a] < i[b] and j[a] < j[b]:
                    score[b] = max(score[b], score[a] + 8 - 0.2 * (i[b] - i[a] + j[b] - j[a]))
        best = next(chains(i, j, 8, 0.2, 0))
        ends = {(int(i[k]), int(j[k])) for k in np.flatnonzero(np.isclose(score, score.max()))}
        assert best[2:] in ends


def test_alignment_passes_over_changes():
    a = np.arange(100)
    b = np.concatenate([[900], a[:40], [500, 501], a[41:70], a[72:], [901]])
    assert align(a, b, 10, 11) == (0, 100, 1, 100, 97)


def test_shared_passages(docs, rows, no_docs):
    got = [tuple(r) for r in passages.shared_passages(docs).collect()]
    pairs = {(r[0], r[3]) for r in got}
    assert (10, 11) in pairs and (11, 10) in pairs
    assert {1, 2, 3, 6, 7} <= {r[0] for r in got}
    assert not {4, 5, 8, 9, 2**40} & {r[0] for r in got}
    (passage,) = {r[1:3] for r in got if r[0] == 10}
    assert passage == (40, 130)
    assert passages.shared_passages(no_docs).count() == 0


def test_a_passage_of_many_documents_gives_no_pairs_of_all(spark):
    draw = random.Random(8)
    word = lambda: f"w{draw.randrange(10**6)}"
    common = [word() for _ in range(60)]
    texts = [" ".join([word() for _ in range(30)] + common + [word() for _ in range(30)]) for _ in range(80)]
    made = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = passages.shared_passages(made).collect()
    assert {r.doc_id for r in got} == set(range(80)) and len(got) <= 4 * 80


def shingles(text):
    words = text.split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def similarity(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def test_near_copies_at_their_similarity(spark):
    """Pairs of texts with words changed: nine of ten at 0.8 and above go, others stay."""
    draw = random.Random(8)
    pairs = []
    for size in (60, 200, 600):
        for k in range(120):
            words = [str(draw.randrange(10**6)) for _ in range(size)]
            other = list(words)
            for at in draw.sample(range(size), max(1, round(size * (k % 12 + 1) / 200))):
                other[at] = "x" + str(draw.randrange(10**6))
            pairs.append((" ".join(words), " ".join(other)))
    rows = [(2 * i + side, text, "keep") for i, pair in enumerate(pairs) for side, text in enumerate(pair)]
    made = spark.createDataFrame(rows, "doc_id long, text string, component string")
    kept = {r.doc_id for r in near_copies.without_near_copies(made).collect()}
    assert kept >= set(range(0, 2 * len(pairs), 2))
    near = [i for i, p in enumerate(pairs) if similarity(*p) >= 0.8]
    far = [i for i, p in enumerate(pairs) if similarity(*p) < 0.65]
    missed = [i for i in near if 2 * i + 1 in kept]
    lost = [i for i in far if 2 * i + 1 not in kept]
    assert len(near) > 100 and len(far) > 40
    assert len(missed) <= len(near) / 10 and len(lost) <= len(far) / 20, (len(missed), len(near), len(lost), len(far))


def test_near_copies_of_odd_rows(docs, rows, no_docs):
    kept = near_copies.without_near_copies(docs)
    assert kept.columns == docs.columns and near_copies.without_near_copies(no_docs).count() == 0
    got = Counter((r[0], r[1]) for r in kept.collect())
    assert set(got.values()) == {1} and set(got) <= {(r[0], r[1]) for r in rows}
    # Near: the base text, without an id and with a word more; the long texts; no words.  In
    # capitals one word in ten differs by a letter beyond A-Z.
    ids = Counter(i for i, _ in got)
    assert ids == Counter([None, None, 2, 6, 8, 9, 10, 11, 12, 12, 2**40])


def test_hot_near_copies_leave_one(spark):
    draw = random.Random(3)
    words = [str(draw.randrange(10**6)) for _ in range(150)]
    rows = [(n, " ".join([*words[: n % 150], f"y{n}", *words[n % 150 + 1 :]])) for n in range(900)]
    rows += [(5000 + n, " ".join(str(draw.randrange(10**6)) for _ in range(80))) for n in range(50)]
    made = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(r.doc_id for r in near_copies.without_near_copies(made).collect())
    assert kept == [0, *range(5000, 5050)]


@pytest.mark.parametrize("rate,least", [(0.0, 1.0), (0.05, 0.95), (0.1, 0.9)])
def test_recall_of_fuzzy_passages(spark, rate, least):
    draw = random.Random(int(100 * rate))
    words = [f"w{i}" for i in range(20_000)]
    filler = lambda n: [draw.choice(words) for _ in range(n)]
    rows, pairs = [], []
    for size in (70, 100, 200):
        for _ in range(30):
            one = filler(size)
            two = [w if draw.random() > rate else draw.choice(words) for w in one]
            pairs.append(frozenset((len(rows), len(rows) + 1)))
            rows.append((len(rows), " ".join(filler(60) + one + filler(40))))
            rows.append((len(rows), " ".join(filler(20) + two + filler(90))))
    made = spark.createDataFrame(rows, "doc_id long, text string")
    got = {frozenset((r.doc_id, r.other_id)) for r in passages.shared_passages(made).collect()}
    assert got <= set(pairs) and len(got) >= least * len(pairs), (len(got), len(pairs))


@pytest.mark.parametrize("others,size", [(2, 55), (10, 55), (40, 70)])
def test_passage_whose_seeds_stand_in_other_documents(spark, others, size):
    """Two documents share a passage; its first words stand in smaller and larger ids as well."""
    draw = random.Random(others)
    word = lambda: f"w{draw.randrange(10**6)}"
    some = lambda n: [word() for _ in range(n)]
    rows, pairs = [], set()
    for k in range(20):
        passage, at = some(size), 1000 * k
        ids = random.Random(k).sample(range(1, 900), others + 2)
        one, two = sorted(ids)[others // 2 : others // 2 + 2]
        pairs.add((at + one, at + two))
        for n in ids:
            shared = passage if n in (one, two) else passage[: size - 10]
            rows.append((at + n, " ".join(some(30) + shared + some(30))))
    made = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.other_id) for r in passages.shared_passages(made).collect()}
    assert pairs <= got if size == 55 else not pairs - linked(got)


def linked(pairs):
    """Pairs within the components of ``pairs``."""
    near, out = {}, set()
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
    for start in near:
        seen, todo = {start}, [start]
        while todo:
            for b in near[todo.pop()] - seen:
                seen.add(b)
                todo.append(b)
        out |= {(start, b) for b in seen}
    return out


@pytest.mark.parametrize("sort", ["equal", "changed", "later"])
def test_passage_whose_every_seed_many_documents_hold(spark, sort):
    """Two documents share a passage, equal or with words changed, of whose pieces 20 others hold
    one each; or in one of them the pieces stand for themselves before it."""
    draw = random.Random(11)
    some = lambda n: [f"w{draw.randrange(10**9)}" for _ in range(n)]
    rows = []
    for k in range(6):
        pieces, at = [some(14) for _ in range(4)], 1000 * k
        if sort == "equal":
            passage = [w for p in pieces for w in p]
            bodies = [passage, passage]
            others = [passage[:40]] * 20 + [passage[-40:]] * 20
        else:
            bodies = [[w for p in pieces for w in p + some(1)] for _ in range(2)]
            others = [p for p in pieces for _ in range(20)]
        if sort == "later":
            bodies[0] = [w for p in pieces for w in p + some(70)] + bodies[0]
        rows += [(at + 500 + n, some(30) + b + some(30)) for n, b in enumerate(bodies)]
        rows += [(at + n + 900 * (n % 2), some(30) + o + some(30)) for n, o in enumerate(others)]
    made = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    got = {(r.doc_id, r.other_id) for r in passages.shared_passages(made).collect()}
    assert {(1000 * k + 500, 1000 * k + 501) for k in range(6)} <= got


def test_close_contexts_equal_a_comparison_of_all():
    draw = np.random.default_rng(5)
    base = draw.integers(1, 2**31, (3, 128), dtype=np.uint32)
    rows = base[draw.integers(0, 3, 120)].copy()
    for row in rows:
        row[: draw.integers(0, 70)] = draw.integers(1, 2**31)
        many = draw.random(128) < draw.choice([0, 0.1, 0.2, 0.3])
        row[many] = draw.integers(1, 2**31, many.sum())
    found = Contexts(np.unique(rows, axis=0))
    for few in (2, 16):
        one, two, classes = found.pairs(few, 50)
        got = {frozenset(x) for x in zip(one.tolist(), two.tolist())}
        count = len(found.words)
        a, b = np.triu_indices(count, 1)
        want = found.close(a, b, 50)
        lead = {c: np.flatnonzero(classes == c)[0] for c in set(classes.tolist()) - {-1}}
        stands = [lead.get(c, i) for i, c in enumerate(classes.tolist())]
        assert want.any() and not want.all()
        for x, y in zip(a[want].tolist(), b[want].tolist()):
            assert {x, y} in got or stands[x] == stands[y] or {stands[x], stands[y]} in got
