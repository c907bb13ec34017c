"""Answers to chunks must not depend on the order in which a shuffle hands out a chunk's rows."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from runlens.llm import chunks, lm_scores, substrings

USERS = {
    "substrings": (substrings, lambda d: substrings.remove_repeats(d, bucket_bytes=1 << 18)),
    "substrings_hot": (substrings, lambda d: substrings.remove_repeats(d, hot=400, drawn=10, copies=3, bucket_bytes=1 << 18)),
    "lm_scores": (lm_scores, lambda d: lm_scores.score_documents(d, order=3, bucket_bytes=1 << 17)),
}


def shuffled(table, seed):
    return table.take(np.random.default_rng(seed).permutation(len(table)))


def by(table, name):
    keys = table.column(name).to_pylist()
    return {k: table.filter(pa.compute.equal(table.column(name), k)) for k in sorted(set(keys))}


def in_this_process(seed):
    """What ``chunks.ask`` does, with the rows of every group in another order at every reading."""

    def ask(chunked, send, answer, finish, schema):
        send, finish = chunks.steps(send, finish)
        groups = by(chunked.toArrow(), "chunk")
        sent = pa.concat_tables([send(shuffled(g, seed)) for g in groups.values()])
        answers = pa.concat_tables([answer(shuffled(g, seed + 1)) for g in by(sent, "bucket").values()])
        out = [finish(shuffled(g, seed + 2), shuffled(answers.filter(pa.compute.equal(answers.column("chunk"), k)), seed + 3)) for k, g in groups.items()]
        session = chunked.sparkSession
        return session.createDataFrame(pa.concat_tables(out).to_pandas(), schema)

    return ask


@pytest.mark.parametrize("name", list(USERS))
def test_any_order_gives_one_result(spark, sf_dir, monkeypatch, name):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = docs.unionByName(docs.where("doc_id < 5").select(*[F.col(c) for c in docs.columns]))
    module, run = USERS[name]
    monkeypatch.setattr(module, "in_chunks", lambda d, c: chunks.in_chunks(d, c, chunk_bytes=1 << 16))
    expected = sorted(map(tuple, run(docs).collect()), key=str)
    for seed in (1, 2):
        monkeypatch.setattr(module, "ask", in_this_process(seed))
        assert sorted(map(tuple, run(docs).collect()), key=str) == expected
