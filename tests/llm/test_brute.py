"""Queries that SQL can't express against plain versions of their methods that share no code with them."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
import xxhash

from trawl.llm import fingerprint, langid, near_dedup, packing, pii, quality, queries

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs():
    return pd.read_parquet(f"{SMALL}/documents.parquet").sort_values("doc_id").reset_index(drop=True)


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def chunk_set(text):
    """Byte by byte: a boundary after a byte at which the hash's leading bits are zero, more of them below the usual size."""
    data, out, start, h = text.encode(), {}, 0, 0
    for at, byte in enumerate(data):
        h = ((h << 1) + int(fingerprint.GEAR[byte])) & 0xFFFFFFFF
        size = at + 1 - start
        zero = 32 - h.bit_length()
        end = size >= fingerprint.MOST or at + 1 == len(data)
        if fingerprint.LEAST <= size < fingerprint.USUAL:
            end |= zero >= fingerprint.HARD
        elif size >= fingerprint.USUAL:
            end |= zero >= fingerprint.EASY
        if end:
            out[f"{xxhash.xxh3_64_intdigest(data[start:at + 1]) >> 16:012x}"] = size
            start = at + 1
    return out


def test_op10_byte_by_byte(spark, docs):
    got = queries.QUERIES["op10_fingerprints"](spark, SMALL).toPandas().sort_values("doc_id")
    texts = list(docs.text)
    for k, r in enumerate(got.itertuples()):
        half, after = len(texts[k]) // 2, texts[(k + 1) % len(texts)]
        changed = texts[k][:len(texts[k]) - half] + after[:half]
        a, b = chunk_set(texts[k]), chunk_set(changed)
        assert dict(x.split(":") for x in r.fingerprint.split(",") if x) == {d: str(n) for d, n in a.items()}
        assert r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert r.near_edited == pytest.approx(sum(n for d, n in a.items() if d in b) / sum(a.values()) if a else float(not b))


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([ -]?[0-9])+", "phone": r"\+[0-9][ ().0-9-]+[0-9]"}


def luhn(digits):
    doubled = [int(c) * (2 if i % 2 else 1) for i, c in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def fits(kind, m):
    digits = re.sub("[^0-9]", "", m)
    return {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.split(".")), "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]


def test_op1_terms(spark, docs):
    """Counts in dictionaries, each term looked for by its own expression."""
    word, n = re.compile(r"[^\W\d_]{3,}"), len(docs)
    both, entity_docs, near, df = Counter(), Counter(), Counter(), Counter()
    for text in docs.text:
        df.update(set(word.findall(text.lower())))
        pairs = set()
        for kind, pattern in PATTERNS.items():
            found = list(re.finditer(pattern, text)) if kind != "card" else [m for m in re.finditer(r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}(?![ -]?[0-9])", text)]
            for i, m in enumerate(found):
                if not fits(kind, m[0]):
                    continue
                before = text[found[i - 1].end() if i else 0:m.start()]
                after = text[m.end():found[i + 1].start() if i + 1 < len(found) else len(text)]
                sides = [(" " + before)[-pii.WINDOW - 1:], (after + " ")[:pii.WINDOW + 1]]
                clean = [re.sub(r"\S*[@0-9]\S*", " ", s.lower()) for s in sides]
                terms = [x for x in re.findall(r"(?<=[\W\d_])[^\W\d_]{3,}", clean[0])] + re.findall(r"[^\W\d_]{3,}(?=[\W\d_])", clean[1])
                value = m[0].lower() if kind == "email" else m[0] if kind == "ip" else re.sub("[^0-9]", "", m[0])
                pairs |= {(f"{kind}:{value}", t) for t in terms} | {(f"{kind}:{value}", None)}
        for e, t in pairs:
            if t is None:
                entity_docs[e] += 1
            else:
                both[e, t] += 1
        near.update({t for _, t in pairs if t})
    told = {}
    for (e, t), k in both.items():
        held_by = entity_docs[e]
        if 2 * held_by > n:
            continue
        share = k / df[t] if k >= pii.SUPPORT else (k + pii.PRIOR * held_by / n) / (df[t] + pii.PRIOR)
        score = 1 + math.log(share) / math.log(n / held_by)
        if score >= pii.GENERALISE:
            told.setdefault(t, []).append((-score, e.split(":")[0]))
    want = {t: min(x) for t, x in told.items()}
    got = {r.term: (-r.disclosure, r.kind) for r in pii.disclosing_terms(spark.read.parquet(f"{SMALL}/documents.parquet")).collect()}
    assert set(got) == set(want)
    for t, (score, kind) in want.items():
        assert got[t][0] == pytest.approx(score) and (got[t][1] == kind or len(told[t]) > 1)
    spans = {r.doc_id: r.spans for r in queries.QUERIES["op1_pii"](spark, SMALL).select("doc_id", "spans").collect()}
    for i, text in zip(docs.doc_id, docs.text):
        base = [(m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text) if fits(k, m[0])]
        blank = list(text)
        for a, b in base:
            blank[a:b] = " " * (b - a)
        blank = "".join(blank)
        terms = [f"term:{m.start()}:{m.end()}" for m in word.finditer(blank) if m[0].lower() in want]
        assert [s for s in spans[i].split(",") if s.startswith("term")] == terms


def test_op2_recomputed(spark, docs):
    """Statistics in plain Python, the rules' weights by hand."""
    frame = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = quality.fit(frame, spark.read.parquet(f"{SMALL}/labels.parquet"))
    got = {r.doc_id: r for r in queries.QUERIES["op2_quality"](spark, SMALL).collect()}
    for i, t in zip(docs.doc_id, docs.text):
        words, lines, n = [w for w in re.split(r"[\x20\x09-\x0d]+", t) if w], t.split("\n"), len(t)
        part = lambda p: sum(map(len, re.findall(p, t))) / n if n else 0.0
        upper = sum(c.isupper() for c in t) / n if n else 0.0
        stats = {"chars": math.log1p(n), "words": math.log1p(len(words)), "word_length": n / len(words) if words else 0.0, "upper": upper, "digits": part("[0-9]"),
                 "distinct": len(set(words)) / len(words) if words else 0.0, "wide": (len(t.encode()) - n) / n if n else 0.0, "lines": math.log1p(len(lines) - 1),
                 "distinct_lines": len(set(lines)) / len(lines), "short": sum(len(w) <= 3 for w in words) / len(words) if words else 0.0}
        total, known = model.intercept, True
        for rule, weight in model.rules:
            if any(quality.STATISTICS[k] == "symbols" for k, _, _ in rule):
                known = False  # Unicode classes of the JVM
                break
            total += weight * all((stats[quality.STATISTICS[k]] > x) if above else (stats[quality.STATISTICS[k]] <= x) for k, above, x in rule)
        if known:
            assert got[i].score == pytest.approx(1 / (1 + math.exp(-total)), abs=1e-9)
        assert got[i].held_out == held(i) and got[i].predicted == (got[i].score >= 0.7)


def test_op7_recomputed(spark, docs):
    """n-grams in dictionaries, cosines by loops, of the model's own centroids."""
    model = langid.fit(spark.read.parquet(f"{SMALL}/documents.parquet"))
    got = {r.doc_id: r for r in queries.QUERIES["op7_language_id"](spark, SMALL).collect()}

    def place(gram):
        h = len(gram) * 0x9E3779B1 & 0xFFFFFFFF
        for i, c in enumerate(gram):
            h = ((h ^ ord(c)) * (2654435761, 2246822519, 3266489917)[i]) & 0xFFFFFFFF
            h ^= h >> 15
        return h % langid.PLACES

    for i, text in list(zip(docs.doc_id, docs.text))[::7]:
        plain = "".join(c if c.isalpha() else " " for c in text.lower())
        plain = re.sub(" +", " ", plain)
        plain = (plain if plain.startswith(" ") else " " + plain).rstrip(" ") + " "
        counts = Counter(place(plain[k:k + n]) for n in (1, 2, 3) for k in range(len(plain) - n + 1))
        v = {p: math.log1p(c) * model.idf[p] for p, c in counts.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        cosines = [sum(x / norm * float(c[p]) for p, x in v.items()) for c in model.centroids]
        best = max(cosines)
        assert abs(got[i].score - best) < 0.02 and (got[i].lang_pred == model.languages[cosines.index(best)] or sorted(cosines)[-2] > best - 0.02)


def test_op5_little_is_cut(spark, docs):
    """Nothing is padded, and fewer pieces are cut than there are sequences: a brute count of what is left open."""
    got = packing.pack(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), packing.default_tokenizer()).toPandas()
    sizes = got.groupby("sequence_id").length.sum()
    whole = got.groupby("doc_id").doc_tokens.first()
    least = int((-(-whole // 4096)).sum())  # pieces, if no rest were cut
    short = sizes[sizes < 4096]
    assert all(n & (n - 1) == 0 for n in sizes) and len(short) <= 12 and len(got) - least <= 12 + len(sizes) // 20


def test_op6_recall_by_size(spark):
    """No link of edited documents of 7 to 400 shingles is lost."""
    rng = np.random.default_rng(3)
    rows, sets = [], []
    for size in (7, 12, 20, 40, 100, 400):
        for base in range(12):
            words = [f"v{rng.integers(3000)}" for _ in range(size + 4)]
            for edit in range(4):
                copy = list(words)
                if edit:
                    at = int(rng.integers(len(copy)))
                    copy[-1 - (edit - 1) % 2 if size < 60 else at] = f"e{edit}"
                rows.append((len(rows), " ".join(copy)))
    for _, t in rows:
        w = t.split()
        sets.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)})
    label = list(range(len(rows)))

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    links = 0
    for a in range(len(rows)):
        for b in range(a + 1, min(len(rows), a + 4)):
            if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                label[y], links = x, links + 1
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert links > 100 and got == {i: top(i) for i in range(len(rows))}
