"""The registered queries against their SQL, and against plain Python where SQL can't express them."""

import hashlib
import re
import zlib

import numpy as np
import pandas as pd
import pytest

from trawl.llm import fingerprint, packing, queries

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs():
    return pd.read_parquet(f"{SMALL}/documents.parquet").sort_values("doc_id").reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(same, name):
    same(queries.QUERIES[name], queries.ORACLES[name])


def luhn(digits):
    doubled = [int(c) * (2 if i % 2 else 1) for i, c in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


KINDS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(re.sub("[^0-9]", "", m)) <= 19 and luhn(re.sub("[^0-9]", "", m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(re.sub("[^0-9]", "", m)) <= 15),
)


def base_spans(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p, fits in KINDS for m in re.finditer(p, text) if fits(m[0])]


def test_op1_base(spark, docs):
    got = {r.doc_id: r for r in queries.QUERIES["op1_pii"](spark, SMALL).collect()}
    assert len(got) == len(docs)
    for i, text in zip(docs.doc_id, docs.text):
        spans = base_spans(text)
        assert got[i].base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert [got[i][f"n_{k[0]}"] for k in KINDS] == [sum(s.startswith(k[0] + ":") for s in spans) for k in KINDS]
        assert got[i].spans.startswith(",".join(spans))


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_op2_held_out_accuracy(spark):
    got = queries.QUERIES["op2_quality"](spark, "/root/testdata/sf0.01").toPandas()
    labels = pd.read_parquet("/root/testdata/sf0.01/labels.parquet")
    assert list(got.held_out) == [held(i) for i in got.doc_id] and got.score.between(0, 1).all()
    assert ((got.score >= 0.7).astype(int) == got.predicted).all()
    test = got[got.held_out].merge(labels, on="doc_id")
    assert (test.predicted == test.quality).mean() >= 0.95


def test_op7_held_out_accuracy(spark):
    got = queries.QUERIES["op7_language_id"](spark, "/root/testdata/sf0.01").toPandas()
    table = pd.read_parquet("/root/testdata/sf0.01/documents.parquet")
    test = got[got.held_out].merge(table, on="doc_id")
    assert (test.lang_pred == test.lang).mean() >= 0.97 and not got.rejected.any()


def test_op5_round_trip(spark, docs):
    from tokenizers import Tokenizer

    got = queries.QUERIES["op5_packing"](spark, SMALL).toPandas()
    model = Tokenizer.from_file(packing.default_tokenizer())
    ids = {i: model.encode(t, add_special_tokens=False).ids + [2] for i, t in zip(docs.doc_id, docs.text)}
    for r in got.itertuples():
        assert zlib.crc32(np.array(ids[r.doc_id][r.start:r.start + r.length], "<u4").tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
    by_doc, by_seq = got.sort_values(["doc_id", "start"]), got.sort_values(["sequence_id", "offset"])
    assert (by_doc.groupby("doc_id").length.cumsum() - by_doc.length == by_doc.start).all() and got.length.sum() == sum(map(len, ids.values()))
    assert (by_seq.groupby("sequence_id").length.cumsum() - by_seq.length == by_seq.offset).all()
    sizes = got.groupby("sequence_id").length.sum()
    assert all(n <= 4096 and n & (n - 1) == 0 for n in sizes)  # nothing is padded


def test_op10_brute_force(spark, docs):
    got = queries.QUERIES["op10_fingerprints"](spark, SMALL).toPandas().sort_values("doc_id")
    texts = list(docs.text)
    assert list(got.doc_id) == list(docs.doc_id)
    for k, r in enumerate(got.itertuples()):
        text, after = texts[k], texts[(k + 1) % len(texts)]
        half = len(text) // 2
        changed = text[:len(text) - half] + after[:half]
        a, b, c = fingerprint.fingerprint(text), fingerprint.fingerprint(changed), fingerprint.fingerprint(after)
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (fingerprint.written_out(a), fingerprint.written_out(b))
        assert r.near_edited == fingerprint.containment(a, b) and r.near_next == fingerprint.containment(a, c)
    assert got.near_edited.mean() > 0.3 > 0.05 > got.near_next.mean()


def test_pipeline(spark, docs):
    import corpus_pipeline
    from trawl.llm import langid, mixing, near_dedup, pii

    frame, tables = spark.read.parquet(f"{SMALL}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        frame = corpus_pipeline.written(stage(spark, frame, SMALL))
        tables.append(frame)
        if name != "packing":
            assert frame.columns == list(corpus_pipeline.COLUMNS)
    lang, dedup, clean, mixed, packed = (t.toPandas() for t in tables)
    assert set(lang.doc_id) == set(docs.doc_id)  # clean documents stay
    groups = near_dedup.near_duplicates(tables[0]).toPandas()
    assert set(dedup.doc_id) == set(groups[groups.kept].doc_id) and len(dedup) < len(lang)
    before = dict(zip(dedup.doc_id, dedup.text))
    assert all(not base_spans(t) for t in clean.text) and all(len(t) == n for t, n in zip(clean.text, clean.n_chars))
    assert all(t == before[i] for i, t in zip(clean.doc_id, clean.text) if not base_spans(before[i])) or pii.disclosing_terms(tables[1]).count()
    copies = mixing.mix(tables[2]).toPandas()
    assert mixed.groupby("doc_id").size().to_dict() == {r.doc_id: r.copies for r in copies.itertuples() if r.copies}
    assert packed.groupby("doc_id").length.sum().sum() == packed.drop_duplicates(["doc_id", "start", "sequence_id", "offset"]).length.sum()
    assert set(packed.doc_id) == set(mixed.doc_id)
    again = corpus_pipeline.run(spark, SMALL).toPandas()
    assert sorted(map(tuple, again.to_numpy())) == sorted(map(tuple, packed.to_numpy()))
    assert not langid.fit(tables[0]).predict("")[2] is False
