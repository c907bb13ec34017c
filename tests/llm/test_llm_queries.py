"""Every query of the subpackage: against its SQL, or against a brute-force version on the smallest tables."""

import collections
import hashlib
import re
import zlib

import pandas as pd
import pytest
from harness import connect

from runlens.llm.queries import QUERIES, SQL

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(sf_dir):
    return pd.read_parquet(f"{sf_dir}/documents.parquet").sort_values("doc_id").reset_index(drop=True)


def in_order(table):
    """By the id of the document, or by all columns where rows are no documents."""
    return table.sort_values("doc_id" if "doc_id" in table else sorted(table)).reset_index(drop=True)


def result(spark, sf_dir, name):
    return in_order(QUERIES[name](spark, sf_dir).toPandas())


def fold(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, sf_dir, name):
    expected = in_order(connect(sf_dir).execute(SQL[name]).df())
    pd.testing.assert_frame_equal(result(spark, sf_dir, name)[list(expected)], expected, rtol=1e-5, check_dtype=False)


def test_quality_rules(spark, sf_dir, docs):
    out = result(spark, sf_dir, "op2_quality_rules")
    for text, row in zip(docs.text, out.itertuples(), strict=True):
        words = WORD.findall(text)
        lines = [x for x in text.split("\n") if WORD.search(x)]
        places = collections.defaultdict(list)
        for i in range(len(words) - 4):
            places[tuple(words[i : i + 5])].append(i)
        covered = {i + k for at in places.values() if len(at) > 1 for i in at for k in range(5)}
        expected = (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == expected
        failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
        assert row.base_failed == failed and not (failed and row.kept)
    labels = pd.read_parquet(f"{sf_dir}/labels.parquet")
    both = out.merge(labels, on="doc_id")
    open_ = both[~both.base_failed]
    assert open_[open_.quality == 1].kept.mean() > 0.97
    assert both[both.quality == 0].kept.mean() < 0.2


def test_substrings(spark, sf_dir, docs):
    out = result(spark, sf_dir, "op3_substring_dedup")
    lists, seen = [WORD.findall(t) for t in docs.text], collections.Counter()
    for ws in lists:
        seen.update(tuple(ws[i : i + 35]) for i in range(len(ws) - 34))
    for ws, row in zip(lists, out.itertuples(), strict=True):
        gone = set()
        for i in range(len(ws) - 34):
            if seen[tuple(ws[i : i + 35])] > 1:
                gone.update(range(i, i + 35))
        kept = " ".join(w for i, w in enumerate(ws) if i not in gone)
        assert (row.n_words, row.n_removed, row.kept_sha256) == (len(ws), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    assert out.n_removed.sum() > 0


def test_language(spark, sf_dir, docs):
    out = result(spark, sf_dir, "op4_language_id")
    assert (out.held_out == docs.doc_id.map(lambda i: fold(i, 3) == 1)).all()
    assert (out.lang_pred == docs.lang)[out.held_out].mean() > 0.95
    assert out.score.between(0, 1).all()


def test_decontaminate(spark, sf_dir, docs):
    out = result(spark, sf_dir, "op5_decontaminate")
    plain = lambda t: [w for w in (x.strip(".,;:!?\"'()[]{}<>|*#$%&-_") for x in WORD.findall(t.lower())) if w]
    items = pd.read_parquet(f"{sf_dir}/benchmark.parquet")
    runs = collections.defaultdict(set)
    for item_id, text in zip(items.item_id, items.text, strict=True):
        words = plain(text)
        for i in range(len(words) - 11):
            runs[tuple(words[i : i + 12])].add(item_id)
    for text, row in zip(docs.text, out.itertuples(), strict=True):
        words = plain(text)
        exact = {x for i in range(len(words) - 11) for x in runs.get(tuple(words[i : i + 12]), ())}
        assert exact <= set(row.item_ids)
        assert row.contaminated == (len(row.item_ids) > 0) == (row.max_match > 0)
        if row.contaminated and not exact:
            assert row.max_match >= 5
    assert 0 < out.contaminated.mean() < 0.2


def targets(sizes):
    """The literal rule: reshare what is above three times a size, by weight, until none is."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(sizes.values()))
    while free:
        share = left / sum(weight[s] for s in free)
        over = {s for s in free if share * weight[s] > 3 * sizes[s]}
        if not over:
            return target | {s: share * weight[s] for s in free}
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        free -= over
    return target


def test_mix(spark, sf_dir, docs):
    out = result(spark, sf_dir, "op6_mix_sources").merge(docs[["doc_id", "source"]], on="doc_id")
    assert len(out) == len(docs)
    assert out["size"].tolist() == [len(WORD.findall(t)) for t in docs.text]
    sizes = out.groupby("source")["size"].sum().to_dict()
    want = targets(sizes)
    assert out.source_size.tolist() == [sizes[s] for s in out.source]
    assert max(abs(t - want[s]) for t, s in zip(out.target, out.source, strict=True)) < 1e-6
    assert (out.taken <= 3 * out["size"]).all() and (out.taken >= 0).all()
    for source, taken in out.groupby("source").taken.sum().items():
        assert abs(taken - want[source]) <= 1.5 * 128  # half a block, and a short last block
    again = result(spark, sf_dir, "op6_mix_sources")
    assert again.taken.tolist() == out.taken.tolist()


def test_shard(spark, sf_dir, docs):
    out = result(spark, sf_dir, "op7_shard")
    assert out["size"].tolist() == [len(t.encode()) + 1 for t in docs.text]
    assert out.text_crc32.tolist() == [zlib.crc32(t.encode()) for t in docs.text]
    loads = out.groupby("shard")["size"].sum()
    assert sorted(loads.index) == list(range(8)) and loads.max() < 1.2 * loads.mean()
    assert (out.groupby("text_crc32").shard.nunique() == 1).all()
    for _, slots in out.groupby("shard").slot:
        assert sorted(slots) == list(range(len(slots)))
    assert set(out.law) == {"bytes"} and out.grown_shard.isna().all()


def linked(sets, percent):
    """Components over all pairs that share a shingle."""
    parent, postings = {i: i for i in sets}, collections.defaultdict(list)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sorted(sets):
        shared = collections.Counter(j for s in sets[i] for j in postings[s])
        for s in sets[i]:
            postings[s].append(i)
        for j, n in shared.items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: root(i) for i in sets}


def shingles(text):
    words = [w.lower() for w in re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())]
    n = min(5, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()


def test_near_duplicates(spark, sf_dir, docs):
    out = result(spark, sf_dir, "op8_near_duplicates")
    sets = {i: shingles(t) for i, t in zip(docs.doc_id, docs.text, strict=True)}
    want = linked(sets, 85)
    assert out.n_shingles.tolist() == [len(sets[i]) for i in out.doc_id]
    assert out.component_id.tolist() == [want[i] for i in out.doc_id]
    assert (out.kept == (out.doc_id == out.component_id)).all() and not out.kept.all()


def test_token_counts(spark, sf_dir, docs):
    from tokenizers import Tokenizer, models, pre_tokenizers

    from runlens.llm.queries import VOCABULARY
    from runlens.llm.token_counts import Vocabulary

    own = Tokenizer(models.Unigram(list(Vocabulary.load(VOCABULARY).pieces), unk_id=0, byte_fallback=True))
    own.pre_tokenizer = pre_tokenizers.Metaspace(prepend_scheme="always", split=True)
    out = result(spark, sf_dir, "op9_token_counts")
    assert out.n_tokens.tolist() == [len(own.encode(t, add_special_tokens=False).ids) for t in docs.text]


def test_quality_classifier(spark, sf_dir, docs):
    out = result(spark, sf_dir, "op10_quality_classifier")
    assert (out.held_out == docs.doc_id.map(lambda i: fold(i, 4) == 2)).all()
    assert (out.predicted == (out.score >= 0.7)).all() and out.score.between(0, 1).all()
    both = out[out.held_out].merge(pd.read_parquet(f"{sf_dir}/labels.parquet"), on="doc_id")
    assert both[both.quality == 1].score.mean() > both[both.quality == 0].score.mean() + 0.2


def test_pipeline(spark, sf_dir, docs):
    """Stage by stage on the rows of the stage before."""
    import corpus_pipeline as pipeline
    from runlens.llm import decontamination, quality_rules
    from runlens.session import materialize

    stages = dict(pipeline.STAGES)
    assert list(stages) == ["rules", "near_dedup", "decontaminate", "mix", "shard"]
    source = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = materialize(stages["rules"](spark, source, sf_dir))
    rated = quality_rules.rate_documents(source).where("kept").toPandas()
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted(rated.doc_id)
    single = materialize(stages["near_dedup"](spark, kept, sf_dir))
    rows = kept.select("doc_id", "text").collect()
    want = linked({r.doc_id: shingles(r.text) for r in rows}, 80)
    assert sorted(r.doc_id for r in single.select("doc_id").collect()) == sorted({want[r.doc_id] for r in rows})
    clean = materialize(stages["decontaminate"](spark, single, sf_dir))
    flagged = decontamination.flag_documents(single, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("not contaminated")
    assert sorted(r.doc_id for r in clean.select("doc_id").collect()) == sorted(r.doc_id for r in flagged.collect())
    mixed = materialize(stages["mix"](spark, clean, sf_dir))
    assert mixed.columns == source.columns
    sizes = collections.Counter()
    for r in clean.collect():
        sizes[r.source] += len(WORD.findall(r.text))
    taken = collections.Counter()
    for r in mixed.collect():
        taken[r.source] += len(WORD.findall(r.text))
    wanted = targets(dict(sizes))
    assert all(abs(taken[s] - wanted[s]) <= 1.5 * 128 for s in wanted)
    out = stages["shard"](spark, mixed, sf_dir).toPandas()
    assert len(out) == mixed.count() and set(source.columns) <= set(out.columns)
    assert len(pipeline.run(spark, sf_dir).toPandas()) == len(out)
