import hashlib
import random

import numpy as np
import pytest
import tiktoken
import public_tokenizers

import corpus_pipeline
from rasterquarry.llm import bpe
from rasterquarry.llm.queries import BYTE_RANKS, ORACLES, QUERIES

from . import brute
from .conftest import prose, vocabulary


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """A folder of documents and labels, and documents as rows."""
    rng = random.Random(8)
    words = vocabulary(rng, 80)
    texts = [prose(rng, words, rng.randint(5, 80)) for _ in range(50)]
    passage = prose(rng, words, 60)
    texts += [prose(rng, words, 25) + " " + passage for _ in range(4)] + texts[:4] + ["%%% $$$ " * 30, "", None, "same line here\n" * 20]
    rows = [(k, t, "en", "abc"[k % 3] if k % 7 else None, len(t or "")) for k, t in enumerate(texts)]
    folder = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, int(k % 2), 0) for k in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, rows


def test_pipeline_equals_its_plain_version(spark, small):
    folder, rows = small
    verdict = brute.quality([r[1] or "" for r in rows], [r[0] < 40 and r[0] % 2 == 1 for r in rows])
    rows = [r for r, v in zip(rows, verdict) if v[0]]
    rows = [rows[i] for i in sorted(set(brute.components([brute.simhash(r[1]) for r in rows])))]
    left = brute.substrings([(r[0], r[1]) for r in rows])
    rows = [(r[0], t, r[3]) for r, (t, n, cut) in zip(rows, left) if not cut or brute.split(t)]
    taken = brute.mix([(k, s, len(brute.split(t))) for k, t, s in rows])
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(BYTE_RANKS), special_tokens={})
    want = []
    for k, t, s in rows:
        n = len(brute.split(t))
        whole, part = divmod(taken[k], n) if n else (0, 0)
        for text in [t] * whole + [brute.first_words(t, part)] * (part > 0):
            ids = library.encode_ordinary(text)
            want.append((k, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), ids, "en", s))
    got = [tuple(r) for r in corpus_pipeline.run(spark, folder).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and len(want) > 20


def test_stages_keep_the_columns(spark, small):
    folder, _ = small
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    none = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).dtypes == docs.dtypes
        assert stage(spark, none, folder).count() == 0


def test_every_query_is_registered():
    import __spark_entry__

    for n in range(1, 11):
        assert sum(name.startswith(f"op{n}_") for name in QUERIES) == 1
    assert set(QUERIES) | {"pipeline"} <= set(__spark_entry__.queries())
    assert set(ORACLES) <= set(__spark_entry__.oracle_sql()) and ORACLES.keys() <= QUERIES.keys()


def test_stages_take_nulls_and_clashing_names(spark, small):
    folder, _ = small
    schema = "doc_id long, text string, lang string, source string, n_chars long, __kept string, __size long, __hashes int, __id string, skey string, `a b` int"
    text = "one two three four five. six seven eight nine ten, eleven twelve thirteen. fourteen fifteen sixteen seventeen, eighteen nineteen twenty."
    rows = [(None,) * 11, (1, text, None, None, None, "k", 1, 2, "i", "s", 3), (None, text + " more", "en", "a", 9, None, None, None, None, None, None), (1, text, None, None, None, "k", 1, 2, "i", "s", 3), (2, "", None, None, 0, "", 0, 0, "", "", 0), (3, text.upper(), "en", "a", 9, "", 0, 0, "", "", 0)]
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.dtypes == docs.dtypes, name
        got = out.collect()
        assert all(r["__kept"] == "k" and r["a b"] == 3 for r in got if r.doc_id == 1), name
        assert any(r.doc_id == 1 for r in got), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() == len(rows)
