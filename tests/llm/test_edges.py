"""Nulls, empty texts, ties, repeated rows, empty tables and clashing columns; and the methods' own parts."""

import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trawl.llm import chat, fingerprint, langid, mixing, near_dedup, packing, pii, quality, secrets, topk

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, key string, score double, bucket long, size long"
LONG = "word " * 30_000 + "a@b.example " + "x" * 50_000


def table(spark, rows):
    """rows: (doc_id, text, lang, source); with columns whose names operators use too."""
    return spark.createDataFrame([(i, t, lang, s, 7, 1, "k", 0.5, 3, 4) for i, t, lang, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    return table(spark, [(1, None, None, None), (2, "", "en", "a"), (3, "   \n\t ", "en", "a"), (4, "one two", "en", None), (4, "one two", "en", None), (5, "ONE two", "en", "b"),
                         (None, "one two three four five six", "de", "b"), (7, LONG, "en", "b"), (8, "mail me a@b.example or +1 (555) 555-0100 ", "en", "b"), (9, "1234567", None, "c")]).coalesce(2)


@pytest.fixture(scope="module")
def none(spark):
    return table(spark, [])


def test_near_dedup_edges(odd, none):
    rows = near_dedup.near_duplicates(odd).collect()
    got = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in rows}
    assert len(rows) == 10
    assert got[(1, 0)] == (1, True) and got[(2, 0)] == (2, True) and got[(3, 0)] == (3, True)
    assert got[(4, 1)] == (4, True) and got[(5, 1)] == (4, False)  # lower case, fewer words than a shingle
    assert got[(None, 2)] == (None, True)
    assert sorted(r[0] or 0 for r in near_dedup.deduplicated(odd).select("doc_id").collect()) == [0, 1, 2, 3, 4, 4, 7, 8, 9]
    assert near_dedup.deduplicated(odd).columns == odd.columns
    assert near_dedup.near_duplicates(none).count() == 0


def test_near_dedup_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(12):
        base = rng.choices(words, k=rng.choice([8, 40, 120]))
        texts.append(" ".join(base))
        for _ in range(6):
            edited = base[:]
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                edited[rng.randrange(len(edited))] = rng.choice(words)
            texts.append(" ".join(edited))
    rng.shuffle(texts)
    sets = [set(near_dedup.shingles(t).tolist()) for t in texts]
    label = list(range(len(texts)))
    for _ in range(len(texts)):
        for a, b in itertools.combinations(range(len(texts)), 2):
            if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                label[a] = label[b] = min(label[a], label[b])
    got = near_dedup.near_duplicates(table(spark, [(i, t, "en", "a") for i, t in enumerate(texts)]))
    assert {r.doc_id: r.component_id for r in got.collect()} == dict(enumerate(label))


def test_near_dedup_star_of_copies(spark):
    """Copies that are near their original but not each other, and a hub that isn't the smallest id."""
    rng = random.Random(1)
    base = [f"b{i}" for i in range(400)]
    texts = []
    for k in range(40):
        edited = base[:]
        for p in rng.sample(range(0, 400, 10), 5):
            edited[p] = f"e{k}_{p}"
        texts.append(" ".join(edited))
    rows = [(i, t, "en", "a") for i, t in enumerate(texts)] + [(99, " ".join(base), "en", "a")]
    got = near_dedup.near_duplicates(table(spark, rows)).collect()
    assert {r.component_id for r in got} == {0}


def test_densification_is_shared():
    few = near_dedup.shingles("one two three four five six seven")
    sig = near_dedup.signature(few)
    assert len(sig) == near_dedup.BINS and set(sig.tolist()) <= set(few.tolist())


def test_pii_edges(spark, odd, none):
    rows = pii.found(odd, pii.disclosing_terms(odd)).collect()
    assert len(rows) == 10 and {r.row.doc_id: [e.kind for e in r.entities] for r in rows}[8] == ["email", "phone"]
    clean = {r.doc_id: r.text for r in pii.sanitised(odd).collect()}
    assert clean[8] == "mail me [email] or [phone] " and clean[1] is None and clean[2] == ""
    assert pii.sanitised(odd).columns == odd.columns and pii.sanitised(none).count() == 0


def test_pii_overlaps_are_one(spark):
    text = "x a@b.1234 5678 9012 3452 y"
    row = pii.sanitised(table(spark, [(1, text, "en", "a")])).first()
    assert "5678" not in row.text and row.text.startswith("x [email]") and row.text.endswith(" y")


def test_pii_disclosure(spark):
    """A name that stands with one address, and only there, gives it away; a common word doesn't."""
    texts = [f"the note of Zyxwname from zed@corp.example about item{i}" for i in range(6)] + [f"the weather about nothing special {w}" for w in "abcdefghijklmnopqrstuvwx"] + ["Zyxwname was there"]
    docs = table(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])
    terms = {r.term: r for r in pii.disclosing_terms(docs).collect()}
    assert "zyxwname" in terms and not {"the", "about"} & set(terms)
    n, held, both, df = 31, 6, 6, 7
    assert terms["zyxwname"].disclosure == pytest.approx(1 - np.log(df / both) / np.log(n / held)) and terms["zyxwname"].kind == "email"
    rows = {r.doc_id: r.text for r in pii.sanitised(docs).collect()}
    assert rows[30] == "[email holder] was there" and "Zyxwname" not in rows[0]


def test_pii_rare_entities(spark):
    """An entity of one document counts: a name beside it, and in one text more, gives it away; words of the corpus don't."""
    n = 400
    texts = ["write the note to Qwertname at one@corp.example today", "Qwertname was there", "two@corp.example wrote the note today", "Asdfname, two@corp.example, wrote", "two@corp.example, Asdfname"]
    texts += ["write wrote the note today was there"] * (n - len(texts))
    docs = table(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])
    terms = {r.term: (r.kind, r.disclosure) for r in pii.disclosing_terms(docs).collect()}
    assert set(terms) == {"qwertname", "asdfname"}
    assert terms["qwertname"] == ("email", pytest.approx(np.log((1 + 1 / n) / (2 + 1) * n) / np.log(n)))
    assert terms["asdfname"] == ("email", pytest.approx(np.log((2 + 3 / n) / (2 + 1) * n / 3) / np.log(n / 3)))
    rows = {r.doc_id: r.text for r in pii.sanitised(docs).collect()}
    assert rows[1] == "[email holder] was there" and rows[0] == "write the note to [email holder] at [email] today"


def test_secret_edges(spark, odd, none):
    assert secrets.found(odd).count() == 10 and secrets.found(none).count() == 0
    more = table(spark, [(1, "token: password: abcdefghijklmnop Secret='AbCdEf0123456789'", "en", "a"), (2, "ghp_" + "Z1" * 20 + " -----BEGIN RSA PRIVATE KEY-----", "en", "a")])
    rows = {r.row.doc_id: [s.kind for s in r.spans] for r in secrets.found(more).collect()}
    assert rows == {1: ["assign"], 2: ["github", "private_key"]}


@pytest.mark.parametrize("pattern,query", [
    ("AKIA[A-Z0-9]+", {("aki", "kia")}), ("[0-9a-f]{16,}", {()}), ("(?i:token|secret)x*", {("ken", "oke", "tok"), ("cre", "ecr", "ret", "sec")}),
    ("ab+cde", {("cde",)}), ("a.c", {()}), ("api_?key", {("_ke", "api", "i_k", "key", "pi_"), ("api", "ike", "key", "pik")}),
])
def test_trigram_queries(pattern, query):
    assert {tuple(sorted(c)) for c in secrets.trigram_query(pattern)} == query


def test_secret_index_loses_nothing(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    indexed = {r.row.doc_id: [tuple(s) for s in r.spans] for r in secrets.found(docs).collect()}
    import re
    for r in docs.collect():
        plain = sorted((m.start(), i, rule.name, m.end()) for i, rule in enumerate(secrets.BASE + secrets.MORE) for m in re.finditer(rule.pattern, r.text) if len(m[rule.of]) >= rule.least)
        assert indexed[r.doc_id] == plain


def test_quality_edges(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 0), (None, 1), (7, None)], "doc_id long, quality int")
    model = quality.fit(odd, labels)
    scores = quality.scored(odd, model).collect()
    assert len(scores) == 10 and all(0 <= r.score <= 1 for r in scores)
    empty = quality.fit(none, labels.where("false"))
    assert quality.scored(odd, empty).first().score == 0.5 and quality.scored(none, model).count() == 0


def test_compiled_rules_equal_numpy(spark):
    docs = quality.with_statistics(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    x = docs.select(*[f"stat_{s}" for s in quality.STATISTICS]).toPandas().to_numpy()
    y = (x[:, 4] > np.median(x[:, 4])).astype(float)
    model = quality.fit_rules(x, y)
    z = model.intercept + sum(w * quality.holds(r, x) for r, w in model.rules)
    assert np.allclose([r[0] for r in docs.select(model.column()).collect()], 1 / (1 + np.exp(-z)))


def test_language_edges(spark, odd, none):
    model = langid.fit(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    got = {r.doc_id: r for r in langid.predict(odd, model).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 9)] == ["und"] * 4 and got[1].rejected and got[1].score == 0
    assert langid.fit(none).predict("some text") == ("und", 0.0, True)
    assert model.predict("Это предложение написано на русском языке")[2] and not model.predict("the of and that with")[2]
    assert langid.predict(none, model).count() == 0 and langid.accepted(odd, model).columns == odd.columns


def test_language_rejects_long_noise(spark):
    rng = random.Random(1)
    model = langid.fit(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))
    for n in (200, 2000, 20_000):
        assert model.predict("".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n)))[2]
    finnish = "Tämä on lyhyt suomenkielinen lause josta pitäisi tunnistaa kieli "
    assert model.predict(finnish * 40)[2] and not model.predict("the of and that with")[2]


def test_grams_ignore_blocks(monkeypatch):
    text = "some words in a row " * 50
    whole = langid.grams(text)
    monkeypatch.setattr(langid, "BLOCK", 64)
    assert np.abs(langid.grams(text) - whole).sum() <= 0.2 * whole.sum()


def test_mixing_edges(spark, odd, none):
    rows = mixing.mix(odd).collect()
    assert len(rows) == 10 and all(r.taken <= 2 * r.size for r in rows) and all(r.source_size is not None for r in rows)
    assert mixing.mix(none).count() == 0
    assert [r.taken for r in mixing.mix(table(spark, [(1, None, "en", "a"), (2, "", "en", None)])).collect()] == [0, 0]


def test_mixing_targets(spark):
    rng = random.Random(3)
    rows = [(i, "w " * rng.randrange(1, 60), "en", rng.choice("aaaabbc")) for i in range(900)]
    got = mixing.mix(table(spark, rows)).toPandas()
    sizes = [len(t.split()) for _, t, _, _ in rows]
    assert got["size"].sum() == sum(sizes)
    by = got.merge(__import__("pandas").DataFrame(rows, columns=["doc_id", "t", "l", "source"]), on="doc_id").groupby("source")
    assert (by.taken.sum() - by.target.first()).abs().max() <= 60
    assert by.target.first().sum() == pytest.approx(1.5 * sum(sizes))
    again = mixing.mix(table(spark, rows[::-1])).toPandas()
    assert dict(zip(got.doc_id, got.taken)) == dict(zip(again.doc_id, again.taken))


def test_packing_edges(odd, none):
    got = packing.pack(odd, packing.default_tokenizer()).toPandas()
    assert len(got[(got.doc_id == 4) & (got.start == 0)]) == 2 and got[got.doc_id == 1].length.tolist() == [1]
    assert packing.pack(none, packing.default_tokenizer()).count() == 0


def test_closest_is_exact():
    rng = random.Random(2)
    for _ in range(60):
        items = [rng.randrange(1, 30) for _ in range(rng.randrange(1, 9))]
        counts = {n: items.count(n) for n in set(items)}
        capacity = rng.randrange(1, 60)
        total, chosen = packing.closest(sorted(counts, reverse=True), counts, capacity)
        sums = {0}
        for n in items:
            sums |= {s + n for s in sums}
        assert total == max(s for s in sums if s <= capacity) == sum(n * c for n, c in chosen.items()) and all(c <= counts[n] for n, c in chosen.items())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("abz.,'!- \n\téÀß½²٣λΣİ中<|endoftext>s019")), max_size=30), max_size=3))
def test_tokenizer_is_the_public_one(texts):
    from tokenizers import Tokenizer

    encode = packing.tokenizer(packing.default_tokenizer())
    model = Tokenizer.from_file(packing.default_tokenizer())
    for t in texts:
        assert np.frombuffer(encode(t), "<u4").tolist() == model.encode(t, add_special_tokens=False).ids


def test_fingerprint_edges(odd, none):
    rows = fingerprint.fingerprints(odd, ranges=5).toPandas()
    assert len(rows) == 10 and rows[rows.doc_id.isna()].n_chars.item() == 27
    assert rows[rows.doc_id == 2].near_edited.tolist() == [1.0] and fingerprint.fingerprints(none).count() == 0
    one = fingerprint.fingerprints(odd.where("doc_id = 8")).first()
    assert one.near_next == 1.0  # a single document follows itself


def test_chunks_resist_shifts():
    rng = random.Random(4)
    data = bytes(rng.choices(b"abcdefgh ", k=8000))
    def digests(d):
        return {d[a:b] for a, b in fingerprint.chunks(d)}
    assert b"".join(data[a:b] for a, b in fingerprint.chunks(data)) == data
    assert all(b - a <= fingerprint.MOST for a, b in fingerprint.chunks(data))
    assert len(digests(data) & digests(b"some words put before it " + data)) > 0.9 * len(digests(data))
    h, want = 0, []
    for byte in data[:100]:
        h = ((h << 1) + int(fingerprint.GEAR[byte])) & 0xFFFFFFFF
        want.append(h)
    assert fingerprint.gear(data[:100]).tolist() == want


def test_top_k_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [nan, 0.0]), (5, [inf, 1.0]), (6, [1.0]), (7, []), (8, [None, 1.0]), (None, [1.0, 1.0]), (50, [1.0, 0.0]), (9, [-1.0, 0.5]), (9, [0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = topk.top_k(df, 3, is_query=F.col("id") % 50 == 0, candidate_block=3).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.id) for r in got] == [(0, 1), (0, 2), (0, 50), (50, 0), (50, 1), (50, 2)]
    assert topk.top_k(df.where("false"), 3, is_query=F.col("id") == 0).count() == 0
    all_of = topk.top_k(df, 9, is_query=F.col("id") == 0).collect()
    assert sorted((r.id, r.score) for r in all_of) == [(1, 65536), (2, 65536), (9, 32768), (50, 65536)]


def test_threshold_algorithm_is_exact():
    rng = np.random.default_rng(0)
    rows = np.floor(256 * rng.normal(size=(500, 8)) * (rng.random((500, 8)) < .5))
    ids, order = np.arange(500), np.ascontiguousarray(np.argsort(rows, axis=0, kind="stable").T)
    for i in range(40):
        found, score = topk.threshold_top_k(ids, rows, i, rows[i], order, 5)
        want = sorted(((-int(rows[j] @ rows[i]), j) for j in range(500) if j != i))[:5]
        assert [(-s, j) for s, j in zip(score.tolist(), found.tolist())] == want


def conversation(spark, rows):
    return spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, prefix long")


def test_chat_edges(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "a"), (3, 0, "user", "a"), (3, 1, "assistant", "b"), (3, 1, "assistant", "b"), (4, 0, "user", None), (5, 0, None, ""),
            (6, None, "user", "<|x"), (None, 0, "user", "z"), (7, 0, "user", "a"), (7, 1, "assistant", "c")]
    got = {r.conv_id: r for r in chat.chat_format(conversation(spark, rows)).collect()}
    assert {i: r.n_copies for i, r in got.items()} == {1: 2, 4: 1, 5: 1, 6: 1, 7: 1}
    assert got[1].rendered == "<|user|>\na\n<|end|>\n<|assistant|>\nb\n<|end|>\n" and got[6].rendered == "<|user|>\n< |x\n<|end|>\n"
    assert chat.chat_format(conversation(spark, rows).where("false")).count() == 0


def test_chat_ties(spark, duck):
    """A log that ends between two rows of one turn number is a prefix of the longer one, as in the SQL."""
    rows = [(1, 0, "user", "x"), (2, 0, "user", "x"), (2, 0, "zed", "y"), (3, 0, "zed", "y"), (4, 0, "user", "x"), (4, 0, "zed", "y"), (4, 1, "user", "z")]
    table = conversation(spark, rows)
    got = chat.chat_format(table)
    assert {r.conv_id: r.n_copies for r in got.collect()} == {3: 1, 4: 1}
    own = duck.cursor()
    own.sql("CREATE TEMP TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    own.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    asked = own.sql(chat.OP3_SQL)
    assert sorted(map(tuple, got.select(asked.columns).collect())) == sorted(asked.fetchall())


def test_chat_long(spark):
    """A conversation of many blocks is one row."""
    rows = [(1, t, "user", str(t)) for t in range(1000)] + [(2, t, "user", str(t)) for t in range(300)]
    got = chat.chat_format(conversation(spark, rows)).collect()
    assert [(r.conv_id, r.n_turns, r.n_copies) for r in got] == [(1, 1000, 1)]
    assert got[0].rendered == "".join(f"<|user|>\n{t}\n<|end|>\n" for t in range(1000))
