"""The pipeline's stages against plain versions of them, on tables of the test's own."""

import hashlib
import random
import re

import numpy as np
import pytest
from fixtures import near_copies, odd_rows
from pyspark.sql import functions as F
from test_dedup_and_join import brute_components
from tokenizers import Tokenizer

import __spark_entry__ as contract
import corpus_pipeline
import public_tokenizers
from estatespark.llm import queries
from estatespark.llm.quality_model import Features, fit_quality

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root, draw = tmp_path_factory.mktemp("corpus"), random.Random(7)
    rows = [(i, t) for i, t in near_copies(4, groups=30, copies=5)]
    rows += [(1000 + i, t) for i, t in rows[::5]]
    rows += [(2000 + i, " ".join(w.upper() + "!!" for w in t.split())) for i, t in rows[::4]]
    docs = [(i, t, draw.choice(["en", "en", "de", None]), draw.choice(["hot", "hot", "hot", "a", "b", None]), len(t)) for i, t in rows]
    docs += [(9000 + i if r[0] is not None else None, *r[1:]) for i, r in enumerate(odd_rows())]
    labels = [(i, int("!!" not in t), 0) for i, t, *_ in docs if i is not None and i % 3 and t]
    spark.createDataFrame(docs, COLUMNS).repartition(3).write.parquet(str(root / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(root / "labels.parquet"))
    return str(root)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def steps(spark, folder, tmp_path_factory):
    """What goes into each stage and what comes out, as lists of rows."""
    docs, found = spark.read.parquet(f"{folder}/documents.parquet"), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(i))
        stage(spark, docs, folder).write.parquet(path)
        following = spark.read.parquet(path)
        found.append((docs, following))
        docs = following
    return found


def test_stages_return_documents(steps):
    for before, after in steps[:-1]:
        assert after.dtypes == before.dtypes and 0 < after.count() <= before.count()
        assert after.exceptAll(before).count() == 0


def test_quality_stage(spark, folder, steps):
    before, after = steps[0]
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when(F.col("quality") == 1, 2)
    model, features = fit_quality(before, spark.read.parquet(f"{folder}/labels.parquet"), grade, 3), Features()
    kept = []
    for row in before.collect():
        codes, values = features(None if row.text is None else row.text.encode())
        if 1 / (1 + np.exp(model.thresholds[0] - model.weights[codes] @ values)) >= queries.QUALITY_FROM:
            kept.append(tuple(row))
    assert rows_of(after) == sorted(kept, key=repr)
    assert not [r for r in kept if r[1] and r[1].count("!!") > 20]


def test_exact_stage(steps):
    before, after = steps[1]
    groups = {}
    for row in before.collect():
        groups.setdefault((row.text or "").encode().lower(), []).append(row)
    kept = {(r.text or "").encode().lower(): r for r in after.collect()}
    assert len(kept) == after.count() and set(kept) == set(groups)
    for key, row in kept.items():
        ids = [r.doc_id for r in groups[key] if r.doc_id is not None]
        assert row.doc_id == (min(ids) if ids else None) and row in groups[key]


def test_near_stage(steps):
    before, after = steps[2]
    own = [(r.doc_id, r.text) for r in before.collect() if r.doc_id is not None]
    expected = {i for (i, _, least) in brute_components(own, 5, 80) if i == least}
    assert {r.doc_id for r in after.collect() if r.doc_id is not None} == expected


def test_mixing_stage(steps):
    before, after = steps[3]
    rows = before.collect()

    def keys(row):
        text = row.text
        form = "prose"
        if text is not None:
            form = "table" if " | " in text else "record" if re.search("[0-9]{4}", text) else "noise" if re.search("[#$%&*]{3}|!!", text) else "prose"
        return row.source, row.lang, form

    tokens, cells = [len(WORDS.findall(r.text or "")) for r in rows], {}
    for row, n in zip(rows, tokens):
        cells[keys(row)] = cells.get(keys(row), 0) + n
    names = list(cells)
    size = np.array([cells[k] for k in names], float)
    weight, total = size.copy(), size.sum()
    for _ in range(300):
        for place, power in enumerate((0.8, 0.9, 1.0)):
            category = np.array([names.index(next(m for m in names if m[place] == k[place])) for k in names])
            seen = {c: size[category == c].sum() for c in set(category)}
            wish = {c: s**power if s else 0.0 for c, s in seen.items()}
            for c in set(category):
                now = weight[category == c].sum()
                if now:
                    weight[category == c] *= wish[c] / sum(wish.values()) * total / now
    ratio, factor = np.divide(weight, size, out=np.zeros_like(size), where=size > 0), 0.0
    for _ in range(100):
        full = ratio * factor >= 1
        factor = max(factor, (corpus_pipeline.MIX_BUDGET * total - size[full].sum()) / weight[~full].sum())
    chance = dict(zip(names, np.where(size > 0, np.minimum(1, ratio * factor), 1.0)))
    kept = []
    for row in rows:
        draw = int(hashlib.md5(f"0:{row.doc_id}".encode() if row.doc_id is not None else b"0").hexdigest()[:13], 16) / 16**13
        if draw < chance[keys(row)]:
            kept.append(tuple(row))
    assert rows_of(after) == sorted(kept, key=repr) and after.count() < before.count()


def test_encoding_stage(steps):
    before, after = steps[4]
    public = Tokenizer.from_file(public_tokenizers.path(queries.TOKENIZER))
    expected = [(r.doc_id, r.lang, r.source, len(ids), ids) for r in before.collect() for ids in [public.encode(r.text or "", add_special_tokens=False).ids]]
    assert rows_of(after) == sorted(expected, key=repr)


def test_whole_run(spark, folder, steps):
    assert rows_of(corpus_pipeline.run(spark, folder)) == rows_of(steps[4][1])
    assert contract.queries()["pipeline"] is corpus_pipeline.run


def test_every_operator_is_registered():
    names = list(contract.queries())
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)] == [1] * 10
    assert {"op2_exact_dedup", "op3_quality_rules", "op5_mixing", "op8_chat_format"} <= set(contract.oracle_sql())
