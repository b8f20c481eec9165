import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from stowage.llm import langid, pii, quality, queries
from stowage.session import table


def luhn(d):
    total = 0
    for k, c in enumerate(reversed(d)):
        x = int(c) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def slow_base(t):
    n = lambda m: re.sub("[^0-9]", "", m[0])
    rules = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(n(m)) <= 19 and luhn(n(m))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(n(m)) <= 15),
    }
    return [(kind, m.start(), m.end()) for kind, (p, ok) in rules.items() for m in re.finditer(p, t or "") if ok(m)]


def joined(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


PIECES = ["a@b.c", "x_y@z.co", "1", "12", "4111111111111111", "4111 1111 1111 1111", " ", " ", "-", ".", "@", "+", "(", ")", "x", "é", "🙂", "1.2.3.4", "256.1.1.1", "\n", "+1 (212) 555-1234", "%", "_", "0", "٠", "００"]


def test_base_spans_against_brute_force(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randrange(1, 14))) for _ in range(2000)] + [None, "", "9" * 50_000, "a" * 50_000 + "@", "1 " * 20_000]
    found = pii.extract(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    rows = found.select("doc_id", pii.spelled(F.col("base")).alias("base"), "base", pii.spelled(F.col("spans")).alias("spans")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = slow_base(texts[r.doc_id])
        assert r[1] == joined(want)
        assert set(filter(None, r[1].split(","))) <= set(filter(None, r.spans.split(",")))


def test_op3(spark, sf_dir):
    texts = {r.doc_id: r.text for r in table(spark, sf_dir, "documents").collect()}
    for r in queries.op3_pii(spark, sf_dir).collect():
        want = slow_base(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(joined(want).encode()).hexdigest()
        assert Counter(k for k, _, _ in want) == Counter({k: r[f"n_{k}"] for k in pii.KINDS if r[f"n_{k}"]})


def test_patterns_discover_identifiers(spark):
    """A context that seeds induce finds what no base pattern matches; a context of other things doesn't."""
    rng = random.Random(2)
    rows = [(k, f"Please write to mailbox: user{k}@example.com today") for k in range(20)]
    rows += [(100, "Please write to mailbox: jane1984@intranet today"), (101, "Please write to mailbox: jane1984@intranet soon")]
    rows += [(200 + k, f"order number {rng.randrange(10**7, 10**8)} shipped") for k in range(20)]
    rows += [(300, "cards 4111111111111111 4111111111111111 end"), (301, "ring +1 (212) 555-1234 161.17.88.162 now")]
    found = {r.doc_id: r for r in pii.extract(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", pii.spelled(F.col("base")).alias("b"), pii.spelled(F.col("spans")).alias("s")).collect()}
    text = dict(rows)[100]
    at = text.index("jane")
    assert found[100].b == "" and found[100].s == f"email:{at}:{at + len('jane1984@intranet')}"
    assert all(found[200 + k].s == "" for k in range(20))
    assert found[300].s == "card:6:22,card:23:39" and found[301].s == "ip:23:36,phone:5:22"


def test_odd_rows(odd_docs, no_docs):
    found = pii.extract(odd_docs).collect()
    assert Counter(r.doc_id for r in found) == Counter(r.doc_id for r in odd_docs.collect())
    assert pii.extract(no_docs).collect() == []
    red = pii.redact(odd_docs)
    assert red.schema.names == odd_docs.schema.names and [f.dataType for f in red.schema] == [f.dataType for f in odd_docs.schema]
    texts = Counter((r.doc_id, r.text) for r in red.collect())
    assert texts == Counter((r.doc_id, r.text.replace("me@example.com", "[EMAIL]") if r.text else r.text) for r in odd_docs.collect())
    assert pii.redact(no_docs).collect() == []


def test_redaction_leaves_no_base_span(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in pii.redact(docs).collect():
        assert not slow_base(r.text)
        if not slow_base(texts[r.doc_id]):
            assert r.text.count("[") <= texts[r.doc_id].count("[") + 2


def test_plan_is_native(spark, sf_dir):
    plan = pii.extract(table(spark, sf_dir, "documents"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|ArrowEval", plan)


def test_language_held_out_accuracy(spark):
    rows = queries.op9_language(spark, "/root/testdata/sf0.01").collect()
    truth = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert len(held) > 100 and np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97
    assert np.mean([r.rejected for r in rows]) < 0.01


def test_language_sees_only_the_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = langid.learn(docs)
    a = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs, model).collect()}
    b = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit("yy")), model).collect()}
    assert a == b
    hidden = docs.withColumn("lang", F.when(langid.held_out("doc_id"), "zz").otherwise(F.col("lang")))
    assert "zz" not in langid.learn(hidden).langs


def test_language_odd_rows(odd_docs, no_docs, spark):
    model = langid.learn(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    found = langid.identify(odd_docs, model).collect()
    by = {r.doc_id: r for r in found if r.doc_id is not None}
    assert len(found) == odd_docs.count()
    assert all(by[k].lang_pred == "und" and by[k].score == 0 and by[k].rejected for k in (2, 3, 4, 9))
    assert all(by[k].lang_pred in model.langs for k in (1, 5, 7, 8))
    kept = langid.accepted(odd_docs, model)
    assert kept.schema == odd_docs.schema and {r.doc_id for r in kept.collect()} >= {1, 5}
    assert langid.identify(no_docs, model).collect() == [] and langid.accepted(no_docs, langid.learn(no_docs)).collect() == []
    assert langid.learn(no_docs).langs == []


def test_slabs_agree_with_the_whole(monkeypatch):
    text = "Ein kleiner Text, der länger ist als ein Stück. " * 50
    whole = Counter(np.concatenate(list(langid.buckets(langid.folded(text)))).tolist())
    monkeypatch.setattr(langid, "SLAB", 100)
    assert Counter(np.concatenate(list(langid.buckets(langid.folded(text)))).tolist()) == whole


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(1)
    n, k = 20_000, len(quality.LABELLERS)
    truth = rng.random(n) < 0.8
    strength = np.linspace(0.95, 0.7, k)
    votes = np.where(rng.random((n, k)) < strength, truth[:, None] * 2, 2 - truth[:, None] * 2)
    votes[rng.random((n, k)) < 0.2] = 1
    patterns = (votes * 3 ** np.arange(k)).sum(axis=1)
    model = quality.estimate(Counter(patterns.tolist()))
    assert abs(model.prior - 0.8) < 0.03
    for c, s in zip(model.chance, strength, strict=True):
        assert abs(c[1, 2] / (c[1, 2] + c[1, 0]) - s) < 0.05
    assert np.mean((model.posterior(patterns) > 0.5) == truth) > 0.95


def test_quality_against_labels(spark):
    d = "/root/testdata/sf0.01"
    found = {r.doc_id: r for r in queries.op7_quality(spark, d).collect()}
    labels = spark.read.parquet(f"{d}/labels.parquet").collect()
    assert len(found) == 1000
    right = [found[r.doc_id].keep == bool(r.quality) for r in labels]
    assert np.mean(right) > 0.95
    assert np.mean([found[r.doc_id].keep for r in labels if r.quality]) > 0.99


def test_quality_odd_rows(odd_docs, no_docs):
    found = quality.quality(odd_docs).collect()
    assert Counter(r.doc_id for r in found) == Counter(r.doc_id for r in odd_docs.collect())
    by = {r.doc_id: r for r in found if r.doc_id is not None}
    assert all(not by[k].keep and by[k].score == 0 and by[k].votes == "1" * len(quality.LABELLERS) for k in (2, 3, 4))
    assert quality.quality(no_docs).collect() == []


def test_pattern_is_one_to_one():
    k = len(quality.LABELLERS)
    seen = {quality.pattern([n // 3**j % 3 for j in range(k)]) for n in range(3**k)}
    assert len(seen) == 3**k


def slow_features(text):
    """The scorer's features, trigram by trigram."""
    data, total = text.encode("utf-8", "replace"), {}
    kind = [97 if c >= 128 or chr(c).islower() else 65 if chr(c).isupper() else c for c in data]
    for k, y in enumerate((list(data), kind)):
        for a, b, c in zip(y, y[1:], y[2:], strict=False):
            h = ((a * 0x01000193 & 0xFFFFFFFF) ^ b) * 0x01000193 & 0xFFFFFFFF ^ c
            at = ((h * 0x9E3779B1 + k & 0xFFFFFFFF) >> 16) % quality.BUCKETS
            total[at] = total.get(at, 0) + 1
    return total


def test_features_and_scores_against_a_plain_version(spark, sf_dir):
    import math

    rows = [r for r in table(spark, sf_dir, "documents").collect() if r.text][:60]
    scorer = quality.learn_scorer([(r.text[:2000], k % 2) for k, r in enumerate(rows)], epochs=1)
    for r in rows:
        want = slow_features(r.text)
        at, share = quality.hashed(r.text)
        norm = math.sqrt(sum(want.values()))
        assert {int(a) for a in at} == set(want) and all(abs(math.sqrt(want[int(a)]) / norm - s) < 1e-5 for a, s in zip(at, share, strict=True))
        z = sum(math.sqrt(n) / norm * float(scorer.weights[a]) for a, n in want.items()) + scorer.bias
        assert abs(1 / (1 + math.exp(-z)) - scorer.score(r.text)) < 1e-4
    # expectation-maximisation, step by step over single rows
    rng = np.random.default_rng(3)
    patterns = [int(sum(v * 3**j for j, v in enumerate(rng.choice(3, len(quality.LABELLERS), p=(0.2, 0.6, 0.2))))) for _ in range(300)]
    counts = {p: patterns.count(p) for p in patterns}
    model = quality.estimate(counts, rounds=1)
    votes = [[p // 3**j % 3 for j in range(len(quality.LABELLERS))] for p in patterns]
    good = [0.1 if 0 in v else 0.9 if 2 in v else 0.5 for v in votes]
    assert abs(model.prior - (sum(good) + 1) / (len(good) + 2)) < 1e-9
    for j in range(len(quality.LABELLERS)):
        for truth in (0, 1):
            weight = [g if truth else 1 - g for g in good]
            for x in range(3):
                n = sum(w for w, v in zip(weight, votes, strict=True) if v[j] == x) + 1
                assert abs(model.chance[j][truth][x] - n / (sum(weight) + 3)) < 1e-9


def test_the_language_sample_is_bounded(spark):
    rows = [(k, f"text {k % 7} of language", f"l{k % 40}") for k in range(4000)] + [(None, "the same", "l0")] * 3000
    found = langid.training_sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_lang=50, most_langs=5)
    assert len({lang for _, lang in found}) == 5 and len(found) == len(set(found)) <= 5 * 8


def test_discovery_goes_on_until_nothing_is_added(spark):
    """What only a third round finds: bravo passes by what alpha and omega found, carol by what bravo found."""
    valid = {"alpha": 60, "omega": 60, "bravo": 2, "carol": 8}
    lines = [f"{word} 10.{k}.1.{n}" for k, (word, most) in enumerate(valid.items()) for n in range(most)]
    for step, (words, most) in enumerate(((("alpha", "omega", "bravo"), 20), (("bravo", "carol"), 4), (("carol",), 2))):
        lines += [f"{word} 999.{step}.7.{n}" for word in words for n in range(most)]  # no valid address: known by context only
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    found = {r.doc_id: r.spans for r in pii.extract(df).collect()}
    missed = [t for k, t in enumerate(lines) if not found[k]]
    assert not missed, missed[:5]
