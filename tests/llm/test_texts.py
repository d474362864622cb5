"""Page repair, packing, mixing and residue on small cases."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sievegrid.llm import mixing, packing, pages, residue, tokens

# ---- pages

SOUND = "\n\n".join(f"The measured sample of the common film was compared with another long-range chunk in section {i}." for i in range(40))
SCAN = """________________________
Annals of Something Studies, vol. 3    12
________________________

The meas-
ured sarnple of the common
f1lm was compared with a long-
range chunk in the sec­

Page 12

________________________
Annals of Something Studies, vol. 3    13
________________________

tion of another sample.

1.2 Results

| a | b |
| --- | --- |
| s4mple | 1 |

Page 13"""


def _rows(spark, *texts):
    return spark.createDataFrame([("t", str(i), x, "clash") for i, x in enumerate(texts)], "record_table string, record_key string, text string, word string").select("record_table", "record_key", "text")


def test_damage_and_repair(spark):
    rows = _rows(spark, SOUND, SCAN, None, "", "   ")
    rows = rows.where("text is not null")
    damage, readings = pages.find_damage(rows)
    damage = pages.materialize(damage, "damage")
    got = {(r.record_key, r.line_no, r.kind) for r in damage.collect()}
    lines = SCAN.split("\n")
    furniture = {i + 1 for i, s in enumerate(lines) if s.startswith(("___", "Annals", "Page"))}
    assert {x for x in got if x[2] == "furniture"} == {("1", i, "furniture") for i in furniture}
    assert {x[1] for x in got if x[2] == "broken_word"} == {5, 8} and {x[1] for x in got if x[2] == "misread"} == {6, 7}
    assert not [x for x in got if x[0] == "0"]
    fixed = {r.record_key: r for r in pages.repair_pages(rows, damage).collect()}
    assert fixed["1"].text.split("\n\n")[0] == "The measured sample of the common film was compared with a long-range chunk in the section of another sample."
    assert "| s4mple | 1 |" in fixed["1"].text and "1.2 Results" in fixed["1"].text and "Page" not in fixed["1"].text
    assert fixed["0"].text == SOUND and fixed["0"].n_damaged == 0 and fixed["3"].text == ""


def test_numbers_alone_on_a_line():
    wrapped = "A long baseline between the two samples indexed every\nxxiii\ntrajectory. The tensor of the batch is transient enough\nto hide it.\n71"
    assert [r == "furniture" for r in pages.classify(wrapped)] == [False, True, False, False, True]
    column = "name\n12\n13\n14\nvalue"
    assert "furniture" not in pages.classify(column)


def test_letters_read_as_one():
    assert pages.misreadings("kemel", "kernel") == 1 and pages.misreadings("partide", "particle") == 1
    assert pages.misreadings("kemel", "kennel") is None


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="cdlmrnehi", min_size=1, max_size=6), min_size=1, max_size=20), st.text(alphabet="cdlmrnehi13", min_size=1, max_size=7))
def test_true_forms_are_all_words_that_misreading_explains(vocabulary, seen):
    want = {(w, n) for w in vocabulary if (n := pages.misreadings(seen, w)) is not None}
    assert set(pages.true_forms(pages.trie_of(vocabulary), seen)) == want


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="cdlmrnehi", min_size=1, max_size=5), st.text(alphabet="cdlmrnehi1305", min_size=1, max_size=6))
def test_no_word_lies_outside_the_shards_of_what_it_may_stand_for(true, seen):
    if pages.misreadings(seen, true) is not None:
        assert true[:2] in pages.true_prefixes(seen)


def test_damage_does_not_depend_on_the_size_of_the_corpus(spark):
    def lines(times):
        texts = [t for i in range(times) for t in (SOUND, SCAN + f"\n\nThe cornrnon sarnple was compared with another sample {i}.")]
        texts += ["A lone narnpli stands in this line of the common film."] * times
        damage, _ = pages.find_damage(_rows(spark, *texts))
        last = {"0": 0, "1": 1, str(2 * times): 2}
        return {(last[r.record_key], r.line_no, r.kind) for r in damage.collect() if r.record_key in last}

    assert lines(1) == lines(12) and (1, 6, "misread") in lines(1)


def test_words_misread_at_several_places(spark):
    sound = "\n".join(f"The membrane was connected to the turnclorn sample, which enhanced section {i}." for i in range(40))
    damage, _ = pages.find_damage(_rows(spark, sound, "The rnernbrane was coririectecl\nto the tumdom sample\nand to m3rnbran3\nand rnembrane."))
    got = {(r.line_no, r.word): r.fixed for r in damage.where("kind = 'misread'").collect()}
    assert got == {(1, "rnernbrane"): ["membrane"], (1, "coririectecl"): ["connected"], (2, "tumdom"): ["turnclorn"], (3, "m3rnbran3"): ["membrane"], (4, "rnembrane"): ["membrane"]}


def test_all_readings_of_a_word_are_kept_for_the_documents_own_words(spark):
    sound = "\n".join(f"The {w} was held beside the sample {i}." for w, n in (("ticins", 12), ("tlcins", 11), ("ticlns", 10), ("tlclns", 9), ("tielns", 8)) for i in range(n))
    rows = _rows(spark, sound, "The tlclns was held here.\nThe t1c1ns was held there.", "The t1c1ns was held there.")
    damage, _ = pages.find_damage(rows)
    damage = pages.materialize(damage, "damage")
    assert {(r.record_key, r.word): r.fixed for r in damage.collect()} == {(k, "t1c1ns"): ["ticins", "tlcins", "ticlns", "tlclns", "tielns"] for k in "12"}
    fixed = {r.record_key: r.text for r in pages.repair_pages(rows, damage).collect()}
    assert fixed["1"] == "The tlclns was held here. The tlclns was held there." and fixed["2"] == "The ticins was held there."


def test_sound_words_held_in_every_task_decide_nothing(spark):
    rows = _rows(spark, SOUND, SCAN, "A lone narnpli stands beside the common fi1m of the s4mple.")
    few, many = (sorted(map(tuple, pages.find_damage(rows, common=n)[0].collect()), key=repr) for n in (1, 50000))
    assert few == many and len(few) > 5


def test_scan_takes_a_term_apart_once_however_often_it_comes(monkeypatch):
    tried = []

    class Counted:
        def fullmatch(self, word):
            tried.append(word)
            return word_pattern.fullmatch(word)

    word_pattern = pages._WORD
    monkeypatch.setattr(pages, "_WORD", Counted())
    monkeypatch.setattr(pages, "map_columns", lambda rows, run, schema: run)
    n = 500
    out = pages._scan(None)({"record_table": ["t"] * n, "record_key": [str(i) for i in range(n)], "text": ["The long-range film, the film\nwas com-\npared `x` again."] * n})
    counts = {w: m for what, w, m in zip(out["what"], out["word"], out["n"]) if what == "word"}
    assert counts == {"the": 2 * n, "film": 2 * n, "long": n, "range": n, "long-range": n, "was": n, "again": n}
    assert out["what"].count("break") == n and len(tried) < 20


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.text(alphabet="cdmrniabot-0.ÄA", min_size=1, max_size=5), max_size=6), max_size=6), st.sets(st.sampled_from(["c", "d", "rn", "cab", "m"])), st.integers(1, 4))
def test_odd_words_are_those_of_every_term_whatever_is_remembered(lines, known, memory):
    odd = pages.OddWords(known, memory)
    for terms in lines + lines:
        assert odd.of(terms) == {w for t in terms for w in pages.line_words(t) if w not in known and pages.may_be_misread(w)}
        assert len(odd.dull) + len(odd.odd) <= memory


def test_misread_words_are_found_where_no_term_of_the_text_is_odd(spark):
    sound = "\n".join(f"The storms of the north are stored in part {i}." for i in range(40))
    damage, _ = pages.find_damage(_rows(spark, sound, "the storr-\nns of the north", "the north `of` the storrns\nof $a + b$ 5torms are stored"))
    got = {(r.record_key, r.line_no, r.kind, r.word): r.fixed for r in damage.collect()}
    assert got == {("1", 1, "misread", "storrns"): ["storms"], ("1", 1, "broken_word", "storr-ns"): ["storrns"], ("2", 1, "misread", "storrns"): ["storms"], ("2", 2, "misread", "5torms"): ["storms"]}


def test_no_pages(spark):
    rows = _rows(spark, "x").where("false")
    damage, _ = pages.find_damage(rows)
    assert damage.count() == 0 and pages.repair_pages(rows, damage).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="abc", min_size=1, max_size=6), min_size=1, max_size=20), st.text(alphabet="abc", max_size=6), st.integers(0, 3))
def test_automaton_finds_all_words_within_k(vocabulary, word, k):
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, before = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(row[-1] + 1, before[j] + 1, before[j - 1] + (x != y)))
        return row[-1]

    want = {(w, distance(w, word)) for w in vocabulary if distance(w, word) <= k}
    assert set(pages.within(pages.trie_of(vocabulary), word, k)) == want


def test_misreadings():
    assert pages.misreadings("svvirnmer", "swimmer") == 2
    assert pages.misreadings("p@siv@", "pasiva") == 2
    assert pages.misreadings("cat", "dog") is None
    assert pages.misreadings("same", "same") == 0


# ---- packing


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 60), min_size=1, max_size=12))
def test_plan_covers_the_histogram_exactly(histogram):
    plan = packing.whole_plan(histogram, 40, rounds=15)
    got = {}
    for config, times in plan:
        assert sum(s * n for s, n in config.items()) <= 40
        for s, n in config.items():
            got[s] = got.get(s, 0) + n * times
    assert got == histogram


def test_knapsack_against_all_choices():
    import itertools

    import numpy as np

    rng = np.random.default_rng(1)
    for _ in range(20):
        sizes, price = rng.integers(1, 9, 4), rng.random(4)
        a = packing.best_configuration(sizes, price, 12)
        best = max((np.dot(c, price) for c in itertools.product(*[range(12 // s + 1) for s in sizes]) if np.dot(c, sizes) <= 12))
        assert np.dot(a, sizes) <= 12 and abs(np.dot(a, price) - best) < 1e-9


def test_pack_rows(spark):
    rng = random.Random(2)
    sizes = [7] * 400 + [rng.randint(1, 100) for _ in range(300)] + [250, 200, 100, 0]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(sizes)] + [(9999, None)], "id long, n_tokens long")
    got = packing.pack(df, 100, part=150, rounds=40).collect()
    by_bin, by_id = {}, {}
    for r in got:
        by_bin.setdefault(r.bin_id, []).append(r)
        by_id.setdefault(r.id, []).append(r)
    assert all(sum(r.n_tokens for r in b) <= 100 for b in by_bin.values())
    assert set(by_id) == {i for i, n in enumerate(sizes) if n} and all(sum(r.n_tokens for r in by_id[i]) == sizes[i] for i in by_id)
    assert all(len(v) == (1 if sizes[i] <= 100 else -(-sizes[i] // 100)) for i, v in by_id.items())
    assert len(by_bin) <= 1.03 * sum(sizes) / 100 + 1
    for b in by_bin.values():
        at = 0
        for r in sorted(b, key=lambda r: r.bin_offset):
            assert r.bin_offset == at
            at += r.n_tokens
    assert packing.pack(df.where("false"), 100).count() == 0


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "Hello world <|endoftext|>", "s"), (2, None, "s"), (3, "", "s"), (None, "x", "s")], "doc_id long, text string, n_tokens string")
    got = {r.id: r.n_tokens for r in tokens.count_tokens(df.withColumnRenamed("n_tokens", "source"), "doc_id", "text", ["source"]).collect()}
    assert got[2] == got[3] == 0 and got[1] > 3 and None not in got


# ---- mixing


def test_pivot_keeps_the_weighted_sum():
    rng = random.Random(3)
    for _ in range(50):
        items = [(rng.random(), rng.randint(1, 50)) for _ in range(rng.randint(1, 30))]
        p, left = mixing.pivot(items, rng)
        assert abs(sum(x * w for x, (_, w) in zip(p, items)) - sum(x * w for x, w in items)) < 1e-6
        assert all(x in (0.0, 1.0) for i, x in enumerate(p) if i != left)


def test_pivot_is_unbiased():
    rng = random.Random(4)
    items = [(0.2, 3), (0.7, 1), (0.5, 2)]
    sums = [0.0] * 3
    for _ in range(4000):
        p, left = mixing.pivot(items, rng)
        if left is not None:
            p[left] = float(rng.random() < p[left])
        sums = [a + b for a, b in zip(sums, p)]
    assert all(abs(s / 4000 - x) < 0.03 for s, (x, _) in zip(sums, items))


def test_shares_and_repeats(spark):
    docs = [(i, "big", 100 + i % 50) for i in range(3000)] + [(10000 + i, "small", 80) for i in range(50)] + [(1, None, 5), (2, "other", 5), (3, "big", None), (4, "big", 0)]
    df = spark.createDataFrame(docs, "id long, source string, n_tokens long")
    t = spark.createDataFrame([("big", 0.8, 1), ("small", 0.15, 3), ("none", 0.05, 2), (None, 0.1, 1), ("big", 0.8, 1)], "source string, target_share double, max_repeats int")
    mixture, report = mixing.mix_sources(df, t, bucket_rows=200, fan=4)
    r = {x.source: x for x in report.collect()}
    assert set(r) == {"big", "small", "none"} and r["none"].n_tokens == 0
    assert r["small"].most_copies == 3 and r["small"].n_tokens == 3 * 50 * 80 and r["big"].most_copies == 1
    assert abs(r["big"].actual_share - 0.8 / 0.95) < 0.003
    assert mixture.groupBy("id").count().where("count > 1").count() == 0
    empty, report = mixing.mix_sources(df.where("false"), t)
    assert empty.count() == 0 and report.count() == 3


# ---- residue

CASES = {
    1: "# Some Title Here Now\n\nPlease enable JavaScript to view this article.\nThis reader needs scripts to be switched on.",
    2: "Title: {{ title }}\nSubmitted by ${author} on [INSERT date]\nThe <<value>> of Foo is given in {% unit %}.",
    3: "Lorem ipsum dolor sit amet consequa. Sagit lacus modum velum rumen talis.",
    4: "404 Not Found\nHome | Search | Help\nReference no. 9f17ee9c3",
    5: "请启用 JavaScript 以查看本文。\n事件编号 9a2cd676c",
    6: "Text text text text. Text text text text.",
}
SOUND_CASES = {
    11: "The crawler logged 'Please enable JavaScript to view this article.' for 941 addresses, and these were left out of the corpus. Our film rests on the common chunk of the sample and on a single kernel.",
    12: "The pressure of the film was measured with care. Repeated measurements gave the same viscosity near the wall.\n\nLoading...",
    13: "[IMAGE: 7473d36b2a97_2_5]",
    14: "The report template takes its values from named slots:\n\n```\n{{title}} - ${date}\n```\n\nThe viscous regime of the colloid stays stable under shear. The membrane was compared with another sample.",
    15: "   ",
    16: None,
    17: "",
}


def test_residue_cases(spark):
    df = spark.createDataFrame([(k, v, 0.5) for k, v in (CASES | SOUND_CASES).items()] + [(1, CASES[1], 0.5)], "doc_id long, text string, coverage double")
    got = residue.residue_scores(df, "doc_id", "text")
    found = {r.id for r in got.where(F.col("coverage") >= 0.4).collect()}
    assert found == set(CASES)
    assert residue.residue_scores(df.where("false"), "doc_id", "text").count() == 0


def test_residue_beside_headings(spark):
    bad = {
        1: "# 线性流程中的Texol语料 您没有访问权限 请返回首页。 事件编号 b7e2829c",
        2: "# 404 Not Found",
        3: "# 403 Forbidden\n\nHome | Search | Help",
        4: "# Threshold two-dimensional Griomite replicate An unexpected error occurred while rendering the article Your session has expired, sign in again If the problem persists, tell the library desk",
        5: "# Phase stable Muarkane film 404 Not Found",
        6: "# Defect charged Bremane score Home | Search | Help Access denied",
    }
    sound = {
        11: "# Forbidden transitions of the film\n\nThe viscous regime of the colloid stays stable under shear.",
        12: "# A film under shear The crawler found that a session has expired for two of the samples, and the viscous regime of the colloid stayed stable under shear for all the others, as the membrane did.",
        13: "# Title of a lone film",
        14: "# 404 Not Found\n\nThe film was kept under shear for an hour. The membrane was compared with another sample of the colloid.",
    }
    df = spark.createDataFrame(list((bad | sound).items()), "doc_id long, text string")
    got = {r.id: r.coverage for r in residue.residue_scores(df, "doc_id", "text").collect()}
    assert {i for i, c in got.items() if c >= 0.4} == set(bad) and set(got) == set(bad | sound), got


def test_residue_on_one_line_without_ends(spark):
    bad = {1: "About > Search > Issues > Contact > Home Acceso denegado Volver al inicio Inténtelo de nuevo más tarde.", 2: "Home Search Help Access denied Go back to the start page or try the search"}
    sound = {11: "The crawler logged 'Access denied' and 'Go back to the start page' for 941 addresses, which were left out, and the viscous regime of the colloid stayed stable under shear for all others."}
    df = spark.createDataFrame(list((bad | sound).items()), "doc_id long, text string")
    got = {r.id: r.coverage for r in residue.residue_scores(df, "doc_id", "text").collect()}
    assert {i for i, c in got.items() if c >= 0.4} == set(bad), got


def test_exemplars_of_a_table(spark):
    df = spark.createDataFrame([(1, "Zorbl wuff grkl."), (2, "Access denied"), (3, "Field one: {{ value }}\nField two: {{ value }}"), (4, "Field one: blue paint\nField two: a long wooden box\nField six: {{ value }}")], "doc_id long, text string")
    ex = spark.createDataFrame([("own", "zorbl wuff grkl"), ("form", "field one: _"), ("form", "field two: _"), ("form", "field six: _"), (None, "access denied"), ("own", None)], "label string, passage string")
    got = {r.id: (r.kind, round(r.coverage, 2)) for r in residue.residue_scores(df, "doc_id", "text", exemplars=ex).collect()}
    assert got[1] == ("own", 1.0) and got[2] == (None, 0.0) and got[3][1] == 1.0 and got[4][1] < 0.4
    with pytest.raises(ValueError):
        residue.residue_scores(df, "doc_id", "text", exemplars=ex, most_exemplars=2)


def test_exemplars_find_themselves():
    index = residue.Exemplars(1000, {}, 4.6)
    for label, passages in residue.EXEMPLARS.items():
        for p in passages:
            w = residue.tokens(p.replace("_", residue.SLOT))
            assert index.best(w, 0.5)[1] is not None, p
