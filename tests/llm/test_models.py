"""Language, toxicity, mixing and the pipeline."""

import itertools
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from twinlabel.llm import language_id, mixing, subwords, toxicity
from twinlabel.llm.common import pick


def test_marginals_equal_a_sum_over_all_paths():
    draw = np.random.default_rng(1)
    emission, transition = draw.normal(size=(2, 4, 3)), draw.normal(size=(3, 3))
    real = np.array([[1, 1, 1, 1], [1, 1, 0, 0]], dtype=bool)
    got, moves = language_id.forward_backward(emission, real, transition)
    total = np.zeros((3, 3))
    for c, length in ((0, 4), (1, 2)):
        chance, pairs, mass = np.zeros((length, 3)), np.zeros((3, 3)), 0
        for path in itertools.product(range(3), repeat=length):
            p = np.exp(sum(emission[c, t, path[t]] for t in range(length)) + sum(transition[a, b] for a, b in zip(path, path[1:])))
            mass += p
            for t in range(length):
                chance[t, path[t]] += p
            for a, b in zip(path, path[1:]):
                pairs[a, b] += p
        assert np.allclose(got[c, :length], chance / mass)
        total += pairs / mass
    assert np.allclose(moves, total)


def test_words_have_letters_only():
    assert subwords.words("Ab1c ½x² ⅷ _é٣z") == ["ab", "c", "x", "é", "z"]
    assert subwords.words(None) == subwords.words("12 ½ !") == []


def test_a_switch_of_language_inside_a_text():
    draw = random.Random(2)
    ends = {"aa": ["ing", "tion", "the"], "bb": ["ung", "lich", "ß"]}
    make = lambda lang, n: " ".join(draw.choice("kmpt") + draw.choice(ends[lang]) for _ in range(n))
    langs = ["aa", "bb"] * 40
    field = language_id.fit([make(lang, 30) for lang in langs], langs)
    text = subwords.words(make("aa", 10) + " " + make("bb", 10))
    chance, _ = language_id.forward_backward(
        field.emissions(text)[None], np.ones((1, 20), bool), field.transition
    )
    assert [field.labels[k] for k in chance[0].argmax(1)] == ["aa"] * 10 + ["bb"] * 10


def is_held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 1


def test_languages_of_odd_rows(docs, rows, no_docs):
    got = language_id.languages(docs).collect()
    assert Counter((r.doc_id, r.held_out) for r in got) == Counter((r[0], is_held_out(r[0])) for r in rows)
    for r in got:
        assert 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (r.doc_id in (4, 5, 9) or r.doc_id is None and r.score == 0)
        assert r.lang_pred in {"en", "de", "fr", "es", "und"}
    assert language_id.languages(no_docs).count() == 0
    kept = language_id.in_some_language(docs)
    assert kept.columns == docs.columns and {4, 5, 9}.isdisjoint({r[0] for r in kept.collect()})
    nothing = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language_id.languages(nothing).collect()} == {"und"}


def test_a_text_in_four_languages_stays(spark):
    draw = random.Random(4)
    ends = {"aa": ["ing", "tion"], "bb": ["ung", "lich"], "cc": ["eaux", "oire"], "dd": ["cion", "ando"]}
    make = lambda lang, n: " ".join(draw.choice("kmpt") + draw.choice(ends[lang]) for _ in range(n))
    rows = [(i, make(lang, 30), lang) for i, lang in enumerate(list(ends) * 60)]
    rows.append((1000, " ".join(make(lang, 40) for lang in ends), None))
    made = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    score = {r.doc_id: r.score for r in language_id.languages(made).collect()}
    assert score[1000] < 0.4
    assert 1000 in {r.doc_id for r in language_id.in_some_language(made).collect()}


@pytest.fixture(scope="module")
def marked(spark):
    draw = random.Random(6)
    clean = [a + b for a in ("ka", "mo", "ti", "re", "su") for b in ("lan", "der", "vis", "pol", "gam")]
    texts, labels = [], []
    for i in range(400):
        found = [draw.choice(clean) for _ in range(draw.randrange(20, 120))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(3):
                found[draw.randrange(len(found))] = "grumbx" + draw.choice(["o", "er", "ish", "y"])
        texts.append((i, " ".join(found)))
        labels.append((i, 1, int(toxic)))
    texts += [(1000, "kalan moder grumbxings tivis " * 3), (1001, None), (1002, ""), (None, "kalan")]
    labels += [(1001, 1, 1), (None, 1, 1), (3, None, None), (4, 1, 7)]
    return (
        spark.createDataFrame(texts, "doc_id long, text string"),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
    )


def test_toxicity_of_held_out_texts_and_unseen_spellings(marked, spark):
    docs, labels = marked
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    assert len(got) == 404 and all(0 <= r.score <= 1 for r in got.values())
    assert all(r.held_out == is_held_out(i) and r.predicted == (r.score >= 0.7) for i, r in got.items())
    right = [got[i].predicted == (i % 5 == 0) for i in range(400) if got[i].held_out]
    assert sum(right) / len(right) > 0.98
    assert got[1000].predicted == 1 and got[1001].predicted == got[1002].predicted == 0
    one_class = toxicity.toxicity(docs, labels.where("toxic = 0")).collect()
    assert len({r.score for r in one_class}) == 1
    assert toxicity.toxicity(docs.limit(0), labels.limit(0)).count() == 0


def test_no_source_is_a_block_off_its_weight():
    draw = random.Random(3)
    for _ in range(60):
        weights = mixing.whole_weights([draw.random() ** 3 for _ in range(draw.randint(1, 30))], draw.choice([10, 100, 1000]))
        slots, seen = sum(weights), Counter()
        for at, (source, block) in enumerate(mixing.period(weights), 1):
            assert block == seen[source]
            seen[source] += 1
            assert all(abs(seen[s] - w * at / slots) < 1 for s, w in enumerate(weights))
        assert seen == Counter(dict(enumerate(weights)))


def test_mixed_rows(spark, docs, rows, no_docs):
    assert Counter((r.doc_id, r.source) for r in mixing.mixed(docs).collect()) == Counter((r[0], r[3]) for r in rows)
    back = mixing.mixed_rows(docs)
    assert back.columns[: len(docs.columns)] == docs.columns and back.count() == len(rows)
    assert mixing.mixed(no_docs).count() == 0
    many = spark.createDataFrame([(i, "big" if i % 3 else f"s{i % 7}") for i in range(3000)], "doc_id long, source string")
    got = mixing.mixed(many, {"big": 0.5} | {f"s{i}": 0.5 / 7 for i in range(7)}, 4).collect()
    assert len({(r.slot, r.place) for r in got}) == 3000
    slots = {}
    for r in got:
        assert slots.setdefault(r.slot, r.source) == r.source
    horizon = max(r.slot for r in got if r.on_target) + 1
    assert all(s in slots for s in range(horizon))
    seen = 0
    for s in range(horizon):
        seen += slots[s] == "big"
        assert abs(seen - 0.5 * (s + 1)) < 1.01


def test_targets_hold_for_many_slots_and_sources(spark):
    equal = spark.range(6000).selectExpr("id doc_id", "'s' || id % 3 source")
    tail = [(i, f"t{i % 1100}") for i in range(2200)] + [(i, "none") for i in range(3000, 3040)]
    many = spark.createDataFrame([(i, "big") for i in range(4000, 5500)] + tail, "doc_id long, source string")
    weights = {"big": 0.5, "none": 0.0} | {f"t{i}": 0.5 / 1100 for i in range(1100)}
    for docs, target, name, share, least in ((equal, None, "s0", 1 / 3, 5990), (many, weights, "big", 0.5, 2900)):
        got = mixing.mixed(docs, target, 1).collect()
        assert len(got) == docs.count()
        assert all((r.slot is None) == (r.source == "none") for r in got)
        order = sorted((r.slot, r.source) for r in got if r.on_target)
        assert len(order) >= least and [slot for slot, _ in order] == list(range(len(order)))
        seen = 0
        for slot, source in order:
            seen += source == name
            assert abs(seen - share * (slot + 1)) < 1.01
        later = [r.slot for r in got if r.slot is not None and not r.on_target]
        assert len(set(later)) == len(later) and min(later, default=len(order)) >= len(order)


def test_pipeline_stages(spark, docs, tmp_path, rows):
    spark.createDataFrame([(1, "nothing like it at all")], "item_id long, text string").write.parquet(
        f"{tmp_path}/benchmark.parquet"
    )
    here, counts = pick(docs, "doc_id", "text", "lang", "source", "n_chars"), [len(rows)]
    for name, stage in corpus_pipeline.STAGES:
        after = corpus_pipeline.written(stage(spark, here, str(tmp_path)), name)
        if name != "source_mixing":
            assert after.columns == here.columns
        counts.append(after.count())
        here = after
    assert counts == sorted(counts, reverse=True) and counts[-1] == counts[-2] > 5
