"""Merkle manifests, byte-level BPE and spelling variants against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
import public_tokenizers
import tiktoken

from twinlabel.llm import byte_bpe, merkle, spelling
from twinlabel.llm.perfect_hash import PerfectHash

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, text):
    doc_id, _, lang, source, n_chars = row[:5]
    values = [doc_id, source, lang, n_chars, text]
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(hashes):
    """The root, and per leaf its list of (left, right)."""
    steps, spots, nodes = [[] for _ in hashes], list(range(len(hashes))), list(hashes)
    while len(nodes) > 1:
        for k, at in enumerate(spots):
            first = at // 8 * 8
            steps[k].append(("".join(nodes[first:at]), "".join(nodes[at + 1 : first + 8])))
            spots[k] = at // 8
        nodes = [sha("".join(nodes[i : i + 8])) for i in range(0, len(nodes), 8)]
    return nodes[0], steps


def manifest(rows):
    langs = defaultdict(list)
    for row in rows:
        langs[row[2]].append((leaf(row, row[1]), row))
    order = sorted(langs, key=lambda lang: (lang is not None, (lang or "").encode()))
    built = {}
    for lang in order:
        langs[lang].sort(key=lambda r: (r[1][0] is not None, r[1][0] or 0, r[0]))
        built[lang] = tree([h for h, _ in langs[lang]])
    root, tops = tree([built[lang][0] for lang in order])
    out = Counter()
    for lang, top in zip(order, tops):
        for (h, row), steps in zip(langs[lang], built[lang][1]):
            path, own = steps + top, h
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0:
                own = leaf(row, row[1] and row[1].translate(AZ))
            for left, right in path:
                own = sha(left + own + right)
            proof = sha("".join(left + right for left, right in path))
            out[(row[0], h, built[lang][0], root, proof, own, own == root)] += 1
    return out


def test_manifest_of_odd_rows(docs, rows, no_docs):
    got = Counter(tuple(r) for r in merkle.audited(docs).collect())
    assert got == manifest(rows)
    assert any(not r[-1] for r in got) and any(r[-1] for r in got)
    assert merkle.audited(no_docs).count() == 0


def test_manifest_with_more_than_a_block_and_many_trees(spark):
    draw = random.Random(5)
    rows = [(i % 1400 if i % 50 else None, f"Text {i % 700}", "en", "s", i % 3) for i in range(1500)]
    rows += [(7, "same", "en", "s", 1)] * 40
    rows += [(i, f"T{i}", f"x{i % 530}", None, None) for i in range(700)] + [(9, None, None, None, None)]
    draw.shuffle(rows)
    made = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = Counter(tuple(r) for r in merkle.audited(made.repartition(5)).collect())
    assert got == manifest(rows)


@pytest.mark.parametrize("count", [1, 8, 9, 512, 513])
def test_height_of_a_tree(spark, count):
    rows = [(i, f"T{i}", "en", None, None) for i in range(count)]
    made = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert Counter(tuple(r) for r in merkle.audited(made).collect()) == manifest(rows)


@pytest.mark.parametrize("count", [0, 1, 2, 5, 3000])
def test_perfect_hash_is_minimal(count):
    keys = [b"key %d" % i for i in range(count)]
    assert sorted(PerfectHash(keys).slots(keys).tolist()) == list(range(count))
    with pytest.raises(ValueError):
        PerfectHash([b"a", b"a"])


@pytest.fixture(scope="module")
def vocabulary():
    return byte_bpe.Vocabulary(public_tokenizers.path(byte_bpe.RANKS))


@pytest.fixture(scope="module")
def tokenizer(vocabulary):
    ranks = dict(zip(vocabulary.tokens, vocabulary.ids.tolist()))
    made = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )
    return made.encode_ordinary


def packed(ids):
    return b"".join(i.to_bytes(4, "little") for i in ids)


def odd_texts():
    draw = random.Random(2)
    parts = ["a", "B", " ", "  ", "\n", "\t", "'s", "'ll", "é", "ß", "中", "　", "1", "½", "\x1c"]
    parts += ["\x85", "!?", "́", "😀", "xy" * 30, "'", "࢏", "\U0003d000", "\U00012480"]
    return ["".join(draw.choice(parts) for _ in range(draw.randrange(50))) for _ in range(1500)]


def test_encoding_equals_the_tokenizer(vocabulary, tokenizer, monkeypatch):
    encoder = vocabulary.encoder()
    for text in odd_texts():
        assert encoder.encode(text) == packed(tokenizer(text)), text
    # Letters of newer versions count as other characters, even after they were met before.
    assert encoder.encode("a࢏ b") == packed(tokenizer("a࢏ b"))
    monkeypatch.setattr(byte_bpe, "STRETCH", 7)
    monkeypatch.setattr(byte_bpe, "KNOWN", 20)
    for text in [*odd_texts()[:400], "a" * 300, " " * 40 + "x", "ab " * 30]:
        assert encoder.encode(text) == packed(tokenizer(text)), text


def test_round_trip(docs, rows, no_docs, tokenizer):
    want = Counter()
    for row in rows:
        text = row[1] or ""
        ids = tokenizer(text)
        digests = [hashlib.sha256(b).hexdigest() for b in (packed(ids), text.encode())]
        want[(row[0], len(ids), *digests)] += 1
    assert Counter(tuple(r) for r in byte_bpe.round_trip(docs).collect()) == want
    assert byte_bpe.round_trip(no_docs).count() == 0


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def counted(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(AZ)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def grouped(counts):
    """Neighbours by comparing all words, forms and roots by following them one by one."""
    links = {w: [v for v in counts if near(w, v)] for w in counts}
    form = {}
    for w, n in counts.items():
        best = min(links[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= 2 * n else None
    out = set()
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, len(links[w]), form[w] and counts[form[w]]))
    return out


def test_variants_of_odd_rows(spark, docs, rows, no_docs):
    got = spelling.spelling_variants(docs).collect()
    assert {tuple(r) for r in got} == grouped(counted([r[:2] for r in rows])) and len(got) > 5
    assert spelling.spelling_variants(no_docs).count() == 0
    lonely = spark.createDataFrame([(1, "short one", "x")] * 3, "doc_id long, text string, TEXT2 string")
    assert spelling.spelling_variants(lonely).count() <= 1


@pytest.mark.parametrize("letters,sent", [("ab", True), ("abé×", False)])
def test_variants_of_dense_words(spark, monkeypatch, letters, sent):
    """Runs of one letter, words inside words, ties, very long words; edges sent or shuffled."""
    if not sent:
        monkeypatch.setattr(spelling, "_EDGES", 0)
    draw = random.Random(len(letters))
    counts = {}
    for _ in range(250):
        word = "".join(draw.choice(letters) for _ in range(draw.randrange(5, 9)))
        counts[word] = draw.choice([3, 3, 4, 7, 8, 16, 40])
    long = "".join(draw.choice("abcdefg") for _ in range(20_000))
    for word in (long, long[:9000] + "z" + long[9000:], long[:-1], long[1:], long[:50] + "y" + long[51:]):
        counts[word] = 5
    made = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = {tuple(r) for r in spelling.variants(made).collect()}
    assert got == grouped(counts) and any(r[1] for r in got)
