"""Nulls, empty and long texts, repeated rows, clashing columns and empty tables, for each operator."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from runlens.llm import (
    decontamination, language_id, lm_scores, mixing, near_dups, quality_classifier, quality_rules, sharding, substrings, token_counts,
)

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, row string, size long, key int, shard int, bucket string, slot int"
LONG = " ".join(f"word{i % 997}x{i % 89}" for i in range(60_000))
PLAIN = "The quick brown fox jumps over the lazy dog and runs far away from here. " * 2


@pytest.fixture(scope="module")
def odd(spark):
    extra = ("r", 5, 7, 9, "b", 1)
    rows = [
        (1, "a", "en", 3, PLAIN + "one two three"), (1, "a", "en", 3, PLAIN + "one two three"),  # repeated row
        (2, None, None, None, None), (None, "a", "en", 1, PLAIN + "one two three"), (None, None, "en", 0, None),
        (3, "b", "de", 0, ""), (4, "b", "de", 2, " \n\t "), (5, "b", "en", None, LONG), (6, "é", None, 1, "ça été là"), (6, "c", "fr", 1, "x"),
        (7, "c", "fr", 1, "12 34 !!"), (8, "a", "en", 1, LONG),
    ]
    return spark.createDataFrame([r + extra for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, PLAIN), (2, None), (3, "two words"), (None, "")], "item_id long, text string")


VOCABULARY = token_counts.Vocabulary([("<unk>", 0.0), ("▁", -2.0), ("a", -3.0), ("▁the", -1.0)], False)
OPERATORS = {
    "lm": lambda d, i: lm_scores.score_documents(d, order=3),
    "rules": lambda d, i: quality_rules.rate_documents(d),
    "keep": lambda d, i: quality_rules.keep_documents(d),
    "substrings": lambda d, i: substrings.remove_repeats(d, with_text=True),
    "language": lambda d, i: language_id.learn_and_identify(d),
    "flag": lambda d, i: decontamination.flag_documents(d, i),
    "clean": lambda d, i: decontamination.clean_documents(d, i),
    "mix": lambda d, i: mixing.mix_amounts(d),
    "mix_documents": lambda d, i: mixing.mix_documents(d),
    "shard": lambda d, i: sharding.shard_by_bytes(d, 3),
    "near": lambda d, i: near_dups.near_duplicates(d),
    "drop_near": lambda d, i: near_dups.drop_near_duplicates(d),
    "tokens": lambda d, i: token_counts.count_tokens(d, VOCABULARY),
    "classifier": lambda d, i: quality_classifier.learn_and_score(d, d.select("doc_id", F.lit(1).alias("quality"))),
}
FILTERS = {"keep", "clean", "drop_near", "mix_documents"}


@pytest.mark.parametrize("name", list(OPERATORS))
def test_odd_rows(odd, items, name):
    out = OPERATORS[name](odd, items).collect()
    if name in FILTERS:
        assert OPERATORS[name](odd, items).columns == odd.columns
    else:
        assert len(out) == odd.count()


@pytest.mark.parametrize("name", list(OPERATORS))
def test_empty_table(none, items, name):
    assert OPERATORS[name](none, items).collect() == []


def test_defined_results(odd, items):
    lm = {(r.doc_id, r.n_words): r for r in lm_scores.score_documents(odd).collect()}
    assert lm[2, 0].log_score == 0 and lm[2, 0].mean_log_score is None
    rated = {(r.doc_id, r.n_words): r for r in quality_rules.rate_documents(odd).collect()}
    assert rated[2, 0].base_failed and not rated[2, 0].kept
    removed = [r for r in substrings.remove_repeats(odd, window=20).collect()]
    nothing = hashlib.sha256(b"").hexdigest()
    assert {r.n_removed for r in removed if r.n_words == 60_000} == {60_000}
    assert {r.kept_sha256 for r in removed if r.doc_id in (2, 3, 4)} == {nothing}
    assert sum(r.n_removed == r.n_words == 33 for r in removed) == 3
    lang = {r.doc_id: r.lang_pred for r in language_id.learn_and_identify(odd).collect()}
    assert lang[2] == lang[3] == lang[4] == lang[7] == "und"
    near = near_dups.near_duplicates(odd).collect()
    assert {(r.component_id, r.kept) for r in near if r.doc_id is None} == {(1, False), (None, True)}
    assert {(r.doc_id, r.component_id) for r in near if r.n_shingles > 1000} == {(5, 5), (8, 5)}
    left = near_dups.drop_near_duplicates(odd).collect()
    assert sum(r.text == PLAIN + "one two three" for r in left) == 1 and sum(r.text == LONG for r in left) == 1
    flags = decontamination.flag_documents(odd, items).collect()
    assert sum(r.contaminated for r in flags) == 3 and {tuple(r.item_ids) for r in flags} == {(), (1,)}
    assert decontamination.clean_documents(odd, items).count() == odd.count() - 3
    mixed = mixing.mix_amounts(odd).collect()
    assert {r.taken for r in mixed if r.size == 0} == {0}
    assert {r.source_size for r in mixed if r.doc_id == 2} == {0}


def test_hot_bucket_pairs(spark):
    """A chain of near copies: neighbours are linked, the ends are not, and one component is found."""
    base = [f"w{i}" for i in range(200)]
    texts = []
    for k in range(12):
        base = base[:]
        base[k * 15 + 7] = f"new{k}"
        texts.append(" ".join(base))
    rows = [(100 + i, t) for i, t in enumerate(texts)]
    out = near_dups.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), least_percent=90).collect()
    assert {r.component_id for r in out} == {100}


def test_substitutions_in_leaks(spark):
    rng = np.random.default_rng(5)
    item = [f"tok{i}" for i in rng.integers(0, 10_000, 40)]
    leaked = item[:]
    for at in (4, 11, 19, 26, 34):
        leaked[at] = "changed"
    far = [f"other{i}" for i in range(60)]
    docs = spark.createDataFrame([(1, " ".join(far + leaked + far)), (2, " ".join(far + item[:8] + far))], "doc_id long, text string")
    found = {r.doc_id: r for r in decontamination.flag_documents(docs, spark.createDataFrame([(9, " ".join(item))], "item_id long, text string")).collect()}
    assert found[1].contaminated and found[1].item_ids == [9] and found[1].max_match == 35
    assert not found[2].contaminated
    blocks = decontamination.flag_documents(docs, spark.createDataFrame([(9, " ".join(item)), (8, " ".join(far[:20]))], "item_id long, text string"), block_bytes=100)
    assert {r.doc_id: r.item_ids for r in blocks.collect()} == {1: [8, 9], 2: [8]}


def test_substituted_whole_items(spark):
    """Short items with words changed anywhere, against the rule applied to every alignment and every stretch."""
    rng = np.random.default_rng(8)
    items = {k: [f"i{k}w{j}" for j in range(n)] for k, n in enumerate([*range(6, 21), *range(15, 21), 30, 47])}
    items[99] = [f"s{j}" for j in range(30)]
    docs, tried = {}, {}
    for k, item in items.items():
        for _ in range(40):
            leaked, changed = item[:], rng.choice(len(item), rng.integers(0, len(item) // 3 + 1), replace=False)
            for at in changed.tolist():
                leaked[at] = "changed"
            tried[len(docs)] = (k, [w != "changed" for w in leaked])
            docs[len(docs)] = [f"far{j}" for j in range(rng.integers(0, 9))] + leaked + ["far"] * int(rng.integers(0, 9))
    named = {"fifteen": (9, [i not in (2, 11) for i in range(15)]), "scattered": (99, [i not in (11, 12, 13, 14, 22) for i in range(30)])}
    for name, (k, equal) in named.items():
        named[name] = len(docs)
        tried[len(docs)] = (k, equal)
        docs[len(docs)] = [w if e else "changed" for w, e in zip(items[k], equal, strict=True)]

    def longest(equal, least):
        """Equal words of the longest stretch whose ends all sum up to ``least`` or more; 0 if they do not count."""
        steps, most = np.where(equal, 1, -3), 0
        for a in range(len(equal)):
            for b in range(a + 1, len(equal) + 1):
                if np.cumsum(steps[a:b]).min() >= least and np.cumsum(steps[a:b][::-1]).min() >= least:
                    most = max(most, sum(equal[a:b]))
        return most if most >= min(12, len(equal)) else 0

    frame = spark.createDataFrame([(d, " ".join(ws)) for d, ws in docs.items()], "doc_id long, text string")
    out = decontamination.flag_documents(frame, spark.createDataFrame([(k, " ".join(ws)) for k, ws in items.items()], "item_id long, text string"))
    out, whole_items = {r.doc_id: r for r in out.collect()}, 0
    for d, (k, equal) in tried.items():
        n, least = len(equal), max(5, -(-4 * len(equal) // 5))
        if sum(equal) >= least:
            whole_items += 1
            assert (out[d].item_ids, out[d].max_match) == ([k], sum(equal)), (n, equal)
        else:
            assert longest(equal, 1) <= out[d].max_match <= longest(equal, 0), (n, equal)  # ends of sum 0 may count
    assert whole_items > 300 and out[named["fifteen"]].max_match == 13 and out[named["scattered"]].max_match == 25


def test_every_stretch_is_judged():
    equal = np.array([1] * 11 + [0] * 4 + [1] * 7 + [0] + [1] * 7, bool)
    assert decontamination.verified_overlap(equal, 12, 31) == (14, 15)
    assert decontamination.verified_overlap(equal, 15, 31) is None
    assert decontamination.verified_overlap(equal, 12, 24) == (25, 30)


def test_overfull_group_is_cut(spark):
    rows = [(i, "same text for all") for i in range(900)] + [(1000 + i, f"text number {i}") for i in range(900)]
    out = sharding.shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string"), 8, carry=["doc_id"]).toPandas()
    loads = out.groupby("shard")["size"].sum()
    assert len(loads) == 8 and loads.max() < 1.15 * loads.mean()
    assert out.groupby("shard").slot.apply(lambda s: sorted(s) == list(range(len(s)))).all()


def test_capped_targets(spark):
    rows = [(1, "a", "x " * 10), (2, "b", "y " * 10), (3, "c", "z " * 4000), (4, None, "u " * 2000)]
    out = {r.doc_id: r for r in mixing.mix_amounts(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()}
    assert out[1].target == 30 and out[2].target == 30 and out[1].taken == 30 and out[2].taken == 30
    assert abs(out[3].target - 4470) < 1e-6 and abs(out[4].target - 1490) < 1e-6
    assert all(abs(r.taken - r.target) <= 64 for r in out.values())


def test_hot_line_is_dealt_out(spark):
    """A line in many surroundings, lines in many orders, and many rows of one id: no minimiser has many strings; the result is the same."""
    rng = np.random.default_rng(3)
    line, lines = [f"line{i}" for i in range(24)], [[f"l{k}w{i}" for i in range(6)] for k in range(6)]
    lists = []
    for i in range(300):
        around = [f"d{i}w{j}" for j in range(60)]
        lists.append(around[:30] + line + around[30:])
        lists.append([w for k in rng.integers(0, 6, 9) for w in lines[k]])
    lists += [lists[0], ["copy" + str(j) for j in range(40)]]
    rows = [(i, " ".join(ws)) for i, ws in enumerate(lists)]
    rows += [rows[-1]] * 30 + [(None, None)] * 30
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    frequent = substrings.frequent_runs(docs, 35, 20, 1)

    def most(found):
        part = substrings.Slice([" ".join(ws).encode() for ws in lists], substrings.WordHash(), 35, found)
        strings = set(zip(part.least.tolist(), part.strings(35), strict=True))
        return max(np.unique([m for m, _ in strings], return_counts=True)[1])

    assert most(None) >= 250 and most(frequent) < 30
    combined = substrings.combined_copies(docs, 20).collect()
    assert sorted(r.n for r in combined)[-2:] == [30, 31] and len(combined) == len(lists) + 1
    seen, texts = {}, {i: ws for i, ws in enumerate(lists)}
    for i, text in rows:
        for a in range(len((text or "").split()) - 34):
            seen[tuple(texts[i][a : a + 35])] = seen.get(tuple(texts[i][a : a + 35]), 0) + 1
    want = {i: len({a + k for a in range(len(ws) - 34) if seen[tuple(ws[a : a + 35])] > 1 for k in range(35)}) for i, ws in texts.items()}
    out = substrings.remove_repeats(docs, hot=20, drawn=1, copies=20, bucket_bytes=100_000).collect()
    assert sorted((r.doc_id or -1, r.n_removed) for r in out) == sorted((i or -1, want.get(i, 0)) for i, _ in rows)


def test_window_hash_collisions():
    """Different windows of one hash are told apart by their words."""
    original = substrings.window_hashes
    substrings.window_hashes = lambda ids, window: np.zeros(max(0, len(ids) - window + 1), np.uint64)
    try:
        found = substrings.repeated_windows([b"a b c d", b"b c d e", b"x y z"], np.zeros(3, bool), 3)
    finally:
        substrings.window_hashes = original
    assert [f.tolist() for f in found] == [[False, True], [True, False], [False]]


def test_unknown_without_bytes():
    counter = token_counts.Counter(VOCABULARY)
    assert counter.text("")[0] == 0
    assert counter.text("the")[0] == 1  # one piece
    assert counter.text("qq a")[0] == 4  # mark, a run of unknown characters, mark, a


def test_codewords_differ():
    for n in (2, 3, 4, 5, 20):
        code = language_id.codewords(n)
        assert len({tuple(r) for r in code}) == n


def test_prior_of_mixture():
    rng = np.random.default_rng(1)
    positive = rng.normal(2, 1, (3000, 2))
    unlabelled = np.vstack([rng.normal(2, 1, (2100, 2)), rng.normal(-2, 1, (900, 2))])
    model = quality_classifier.fit(positive, unlabelled)
    assert 0.6 < model.prior < 0.8
    assert (model.score(rng.normal(2, 1, (500, 2))) > 0.5).mean() > 0.9 and (model.score(rng.normal(-2, 1, (500, 2))) < 0.5).mean() > 0.9
