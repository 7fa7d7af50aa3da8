"""The pipeline's stages on a small table against plain Python, and the queries at the smallest scale."""

import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from granary.llm import language, mixing, queries
from granary.llm.common import staged
from tests.llm.test_judgements import WORDS, prose
from tests.llm.test_near_duplicates import brute as near_classes

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(21)
    vocabulary = {lang: [f"{w}{s}" for w in words for s in ("", "a", "en", "er", "ung", "ent")] for lang, words in WORDS.items()}
    rows = []
    for k in range(120):
        lang = ["en", "de", "fr"][k % 3]
        rows.append((k, " ".join(rng.choices(vocabulary[lang], k=rng.choice([60, 150]))), lang, f"s{k % 4}"))
    leak = " ".join(rng.choices(vocabulary["en"], k=14))
    rows += [(200, rows[0][1], "en", "s0"), (201, rows[1][1] + " zusatz", "de", "s1"), (202, prose(rng, "en", 40) + " " + leak, "en", "s2"), (203, None, "en", "s1"), (204, "123 456", "en", "s1")]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), rows, leak


def test_run_against_plain_python(spark, folder):
    path, rows, leak = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    model = language.learn(docs)
    left = [r for r in rows if model.predict(r[1])[2]]
    assert {203, 204} & {r[0] for r in left} == set() and len(left) >= len(rows) - 6
    classes = near_classes([(r[0], r[1]) for r in left])
    left = [r for r in left if classes[r[0]] == r[0]]
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())
    grams = lambda w: {tuple(w[i : i + 10]) for i in range(len(w) - 9)}
    left = [r for r in left if not grams(words(r[1])) & grams(words(leak))]
    assert 202 not in {r[0] for r in left}
    # mixing: cells, raking and the id's share
    topic = lambda t: "short" if len(t) < 600 else "prose"
    cell = {r[0]: (r[3], r[2], topic(r[1])) for r in left}
    tokens: dict = {}
    for r in left:
        tokens[cell[r[0]]] = tokens.get(cell[r[0]], 0) + len(r[1].split())
    cells = sorted(tokens)
    t = np.array([tokens[c] for c in cells], float)
    codes = [np.unique([c[k] for c in cells], return_inverse=True)[1] for k in range(3)]
    ratio = mixing.rake(t, codes, list(mixing.POWERS.values())) / t
    chance = dict(zip(cells, ratio / ratio.max()))
    import hashlib

    share = lambda d: int(hashlib.md5(str(d).encode()).hexdigest()[:8], 16) / 2**32
    left = sorted(r for r in left if share(r[0]) < chance[cell[r[0]]])
    library, want, start = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), [], 0
    for r in left:
        ids = np.array([*library.encode(r[1], add_special_tokens=False).ids, 0], "<u4")
        want.append((r[0], start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = corpus_pipeline.run(spark, path).collect()
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got) == want


def test_stages_keep_the_columns_and_take_nothing(spark, folder):
    path, _, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs.limit(0), path)
        assert out.count() == 0
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
            docs = staged(stage(spark, docs, path), name)
            assert docs.columns == out.columns


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_against_sql(spark, name):
    import glob
    import os

    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    df = queries.QUERIES[name](spark, SF)
    want = con.sql(queries.ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr) == sorted((tuple(r[want.columns.index(c)] for c in columns) for r in want.fetchall()), key=repr)
