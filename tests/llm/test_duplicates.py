import random
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F

from stowage.llm import decontaminate, queries, shingles, simhash
from stowage.llm.components import connected
from stowage.session import table


def slow_print(text, width=4):
    words = (text or "").encode().lower().split()
    own = [b" ".join(words[k : k + width]) for k in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in own]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(nodes, near):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in near:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def brute(rows, radius=4):
    prints = {t: slow_print(t) for _, t in rows}
    distinct = sorted(set(prints.values()))
    near = [(a, b) for k, a in enumerate(distinct) for b in distinct[k + 1 :] if (a ^ b).bit_count() <= radius]
    root = roots(distinct, near)
    least = {}
    for k, t in rows:
        if k is not None:
            r = root[prints[t]]
            least[r] = min(k, least.get(r, k))
    return Counter((k, f"{prints[t]:016x}", least.get(root[prints[t]])) for k, t in rows)


def test_fingerprints_and_lanes():
    rng = random.Random(1)
    for n in (0, 1, 3, 4, 5, 258, 600):
        text = " ".join(rng.choice("abcdefgh") for _ in range(n))
        assert simhash.fingerprint(text) == slow_print(text)
    h = np.array([rng.getrandbits(64) for _ in range(1000)], np.uint64)
    assert simhash.bit_sums(h).tolist() == [sum(int(x) >> b & 1 for x in h) for b in reversed(range(64))]


def test_ball_hashing_finds_every_group(spark, monkeypatch):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**64, 300, dtype=np.uint64)
    fps = [base]
    for d in range(1, 7):
        own = base[:60].copy()
        for k in range(len(own)):
            for b in rng.choice(64, d, replace=False):
                own[k] ^= np.uint64(1 << int(b))
        fps.append(own)
    fps = np.unique(np.concatenate(fps))
    near = [(int(a), int(b)) for k, a in enumerate(fps) for b in fps[k + 1 :] if int(a ^ b).bit_count() <= 4]
    want = roots(map(int, fps), near) | {}
    for at_once in (simhash.AT_ONCE, 5000):  # one pass, and many
        monkeypatch.setattr(simhash, "AT_ONCE", at_once)
        got = []
        for bucket in range(64):
            own = fps[np.bitwise_count((fps ^ np.uint64(bucket)) & np.uint64(63)) <= 2]
            got += [(int(own[a]), int(own[b])) for a, b in simhash.bucket_forest(own, bucket, 6, 2)]
        assert roots(map(int, fps), got) == want


def test_op5_against_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").collect()]
    assert Counter(tuple(r) for r in queries.op5_simhash(spark, sf_dir).collect()) == brute(rows)


def near_copies(seed=5):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(500)]
    rows, k = [], 0
    for _ in range(12):
        base = [rng.choice(words) for _ in range(300)]
        for edits in (0, 0, 1, 1, 2, 3, 5):
            own = list(base)
            for _ in range(edits):
                own[rng.randrange(len(own))] = rng.choice(words)
            rows.append((k, " ".join(own)))
            k += 1
    return rows


def test_near_copies(spark):
    rows = near_copies()
    found = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    want = brute(rows)
    assert Counter(tuple(r) for r in found.collect()) == want
    assert len({c for _, _, c in want}) < len(rows) - 12


def test_odd_rows(odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert Counter(tuple(r) for r in simhash.near_duplicates(odd_docs).collect()) == brute(rows)
    assert simhash.near_duplicates(no_docs).collect() == []


def jaccard(a, b):
    def shingles(t):
        words = (t or "").encode().lower().split()
        return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()

    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def kept_brute(rows):
    """Keys that stay: the least of each group that similarity of 0.8 links."""
    texts = sorted({t or "" for _, t in rows})
    near = [(a, b) for k, a in enumerate(texts) for b in texts[k + 1 :] if jaccard(a, b) >= 0.8]
    root, least = roots(texts, near), {}
    for k, t in rows:
        if k is not None:
            r = root[t or ""]
            least[r] = min(k, least.get(r, k))
    return set(least.values())


def test_keep_one(odd_docs, no_docs, spark):
    kept = simhash.keep_one(odd_docs)
    assert kept.schema == odd_docs.schema
    rows = kept.collect()
    # 3 and 4 have no words, like 2; 6 and the second 1 are copies of 1
    assert sorted(r.doc_id for r in rows if r.doc_id is not None) == [1, 2, 5, 7, 8, 9]
    assert [r.text for r in rows if r.doc_id is None] == ["a text without a key, mail me@example.com"]
    assert simhash.keep_one(no_docs).collect() == []
    copies = near_copies(6)
    found = simhash.keep_one(spark.createDataFrame(copies, "doc_id long, text string"))
    assert {r.doc_id for r in found.collect()} == kept_brute(copies)


def test_keep_one_over_a_table(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    assert {r.doc_id for r in simhash.keep_one(docs).collect()} == kept_brute([(r.doc_id, r.text) for r in docs.collect()])


def test_failed_proposals_are_proposed_again(spark):
    """The same words in another order: one word set, two groups of copies."""
    rng = random.Random(8)
    words = [f"w{k}" for k in range(120)]
    other = rng.sample(words, len(words))
    rows = [(1, words), (2, other), (3, [*words[:-1], "new"]), (4, [*other[:-1], "new"]), (5, rng.sample(words, len(words)))]
    rows = [(k, " ".join(w)) for k, w in rows]
    assert kept_brute(rows) == {1, 2, 5}
    assert {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {1, 2, 5}


def kept(spark, texts):
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    return {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}, kept_brute(rows)


def scattered(rng, words, most, number=200, length=300):
    """Variants of one text with up to `most` words changed anywhere."""
    base, out = [rng.choice(words) for _ in range(length)], []
    for _ in range(number):
        own = list(base)
        for at in rng.sample(range(length), rng.randint(1, most)):
            own[at] = rng.choice(words)
        out.append(own)
    return out


def test_a_loose_group_keeps_no_linked_copy(spark):
    """Most pairs of the group fail: what fails with some texts must still be compared with all others."""
    rng = random.Random(11)
    words = [f"w{k}" for k in range(4000)]
    texts = scattered(rng, words, 8) + scattered(rng, words, 14)
    got, want = kept(spark, texts)
    assert got == want and 1 < len(want) < len(texts)


def test_groups_larger_than_a_block(spark, monkeypatch):
    """Every two blocks of a bucket meet that aren't both of its largest group, over several rounds."""
    for name, value in (("BLOCK_TEXTS", 16), ("FEW_TEXTS", 16), ("SMALL", 3), ("HOT", 8), ("FIRST", 1), ("FURTHER", 2)):
        monkeypatch.setattr(simhash, name, value)
    rng, words = random.Random(13), [f"w{k}" for k in range(4000)]
    got, want = kept(spark, scattered(rng, words, 12, 120, 200) + scattered(rng, words, 5, 40, 60))
    assert got == want and 1 < len(want) < 160


def test_a_star_in_either_order(spark):
    """Copies that are near the original only: whichever has the smallest key, one stays."""
    rng = random.Random(17)
    base = [f"v{rng.randrange(10**6)}" for _ in range(300)]
    around = []
    for _ in range(200):
        own = list(base)
        for at in rng.sample(range(2, 298, 5), 6):
            own[at] = f"v{rng.randrange(10**6)}"
        around.append(own)
    assert all(jaccard(" ".join(base), " ".join(x)) >= 0.8 for x in around)
    for texts in ([base, *around], [*around, base]):
        got, want = kept(spark, texts)
        assert got == want == {0}


def test_passages_that_many_texts_quote(spark, monkeypatch):
    """Passages too rare for the sample: their shingles leave the prefixes, so that texts that only share one aren't held
    against each other in blocks; copies of such texts, and copies that are little but a passage, are found as before."""
    for name, value in (("SAMPLE", 16), ("HOT", 8), ("WORTH", 1), ("MOST_LATE", 1 << 18)):
        monkeypatch.setattr(simhash, name, value, raising=False)
    rows, dealt = [], simhash.blocks
    monkeypatch.setattr(simhash, "blocks", lambda *a: rows.append((found := dealt(*a)).count()) or found)
    rng, texts = random.Random(23), []
    for k in range(8):
        passage = [f"p{k}-{j}" for j in range(25)]
        for _ in range(30):
            own = [[f"v{rng.randrange(10**6)}" for _ in range(rng.randrange(60, 90))] for _ in range(2)]
            texts.append(own[0] + passage + own[1])
            if rng.random() < 0.2:
                texts.append([*texts[-1][:-12], *(f"u{rng.randrange(10**6)}" for _ in range(12))])
        texts += [[*passage, f"end{j}"] for j in range(12)]
    got, want = kept(spark, rng.sample(texts, len(texts)))
    assert got == want and len(want) == 8 * 31
    assert sum(rows) < len(texts) / 2, rows


def test_a_round_sends_only_buckets_with_new_rows(spark, monkeypatch):
    """Texts of several passages: when one's shingles leave the prefixes another's come, so that there are rounds. A row goes
    out again only where its bucket has a row that hasn't gone out before."""
    for name, value in (("SAMPLE", 16), ("HOT", 8), ("WORTH", 1)):
        monkeypatch.setattr(simhash, name, value)
    rounds, before, propose = [], set(), simhash.proposed

    def proposed(posted, *a):
        sent = {(r.w, r.h) for r in posted.select("w", "h").collect()}
        new = {w for w, _ in sent - before}
        rounds.append((len(sent), sum(w not in new for w, _ in sent)))
        before.update(sent)
        return propose(posted, *a)

    monkeypatch.setattr(simhash, "proposed", proposed)
    rng, texts = random.Random(29), []
    passages = [[f"p{k}-{j}" for j in range(25)] for k in range(12)]
    for _ in range(120):
        own = [[f"v{rng.randrange(10**6)}" for _ in range(20)] for _ in range(2)]
        texts.append([*own[0], *(w for k in rng.sample(range(12), 3) for w in passages[k]), *own[1]])
        if rng.random() < 0.2:
            texts.append([*texts[-1][:-10], *(f"u{rng.randrange(10**6)}" for _ in range(10))])
    got, want = kept(spark, rng.sample(texts, len(texts)))
    assert got == want and len(want) == 120
    assert len(rounds) > 2 and not any(stale for _, stale in rounds), rounds


def test_replaced_tails(spark):
    """A block of a text is replaced, as much as a similarity of 0.8 allows: recall is 1 at every size."""
    rng, texts = random.Random(18), []
    for size in (20, 30, 50, 100, 200, 400):
        for _ in range(40):
            base = [f"v{rng.randrange(10**7)}" for _ in range(size)]
            tail = (size - 4) // 9
            own = base[: size - tail] + [f"u{rng.randrange(10**7)}" for _ in range(tail)]
            texts += [base, own] if rng.random() < 0.5 else [own, base]
    got, want = kept(spark, texts)
    assert got == want and len(want) == 240


def test_keys_of_other_types(spark):
    df = spark.createDataFrame([("b", "a b c d e f"), ("a", "a b c d e f"), (None, "a b c d e f"), (None, "x y z")], "doc_id string, text string")
    assert sorted(tuple(r) for r in simhash.keep_one(df).collect() if r.doc_id) == [("a", "a b c d e f")]


def test_buckets_are_streamed(spark, monkeypatch):
    """Buckets of all sizes over batches of any size: pairs of small ones, members of large ones, nothing else."""
    rng = random.Random(19)
    buckets = {w: rng.sample(range(1, 10**6), rng.choice((1, 2, 3, 8, 9, 40, 300))) for w in range(1, 60)}
    posted = [(w, h, 10) for w, own in buckets.items() for h in own for _ in range(rng.choice((1, 1, 2)))]
    want = {(a, b, False) for own in buckets.values() if len(own) <= 8 for a in own for b in own if a < b}
    want |= {(w, h, True) for w, own in buckets.items() if len(own) > 8 for h in own}
    for most in (1, 7, 100, 1 << 16):
        monkeypatch.setattr(simhash, "gathered", lambda parts, most=most, f=GATHERED: f(parts, most))
        found = simhash.proposed(spark.createDataFrame(posted, "w long, h long, n int").repartition(3)).collect()
        assert {tuple(r) for r in found} == want and len(found) == len(want)


GATHERED = simhash.gathered


def test_a_crowded_bucket_is_dealt_out(spark):
    """10^4 fingerprints that reach the same bucket: its parts meet two by two, and no task holds it all."""
    rng = np.random.default_rng(3)
    fps = np.unique((rng.integers(0, 2**58, 10_000, dtype=np.uint64) << np.uint64(6)) | np.uint64(5))
    close = fps[:300] ^ np.uint64(1 << 20) ^ np.uint64(1 << 33) ^ np.uint64(1 << 50)
    every = np.unique(np.concatenate([fps, close]))
    df = spark.createDataFrame([(int(x),) for x in every.view(np.int64)], "fp long")
    found = simhash.links(df, len(every), crowd=1000)
    got = roots([int(x) for x in every.view(np.int64)], [tuple(r) for r in found.collect()])
    near = [(int(np.int64(a)), int(np.int64(b))) for a, b in zip(fps[:300].view(np.int64), close.view(np.int64), strict=True)]
    alike = lambda f: len({f[a] for a, _ in near}) == len(near) and all(f[a] == f[b] for a, b in near)
    assert alike(got) and len(set(got.values())) == len(every) - 300


def test_partners_are_all_those_that_may_be():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 4000, dtype=np.uint64)
    sets = []
    for size in (30, 33, 300, 330, 1100, 4000):
        for _ in range(12):
            own = base[:size].copy()
            k = rng.integers(0, size // 6 + 1)
            own[rng.choice(size, k, replace=False)] = rng.integers(0, 2**63, k, dtype=np.uint64)
            sets.append(np.unique(own))
    near = {(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if shingles.similar(sets[a], sets[b]) >= 0.8}
    side = {"h": np.arange(len(sets)), "n": np.array([len(s) for s in sets]), "root": np.arange(len(sets)), "out": np.ones(len(sets), bool)}
    bits = [shingles.parities(s) for s in sets]
    got, lo, more = set(), 0, True
    while more:
        pairs, more = shingles.partners(side, side, bits, bits, lo, lo + 5, most=1 << 12)
        got |= set(pairs)
        lo += 5
    assert near <= got and len(got) < 1.3 * len(near)


def test_many_orders_of_the_same_words(spark):
    """Five orders of one word set, each with copies: the word sets say nothing about which texts are copies."""
    rng = random.Random(14)
    words, texts = [f"w{k}" for k in range(150)], []
    for _ in range(5):
        own = rng.sample(words, len(words))
        texts += [own, [*own[:-1], "new"], [*own[:-2], "newer", "newest"]]
    got, want = kept(spark, rng.sample(texts, len(texts)))
    assert got == want and len(want) == 5


def test_added_and_cut_text(spark):
    """A fifth appended or almost a fifth cut off is similar enough: each text loses its copy."""
    rng, texts = random.Random(15), []
    for size in (100, 250, 1000):
        for _ in range(10):
            base = [f"v{rng.randrange(10**6)}" for _ in range(size)]
            more = [f"v{rng.randrange(10**6)}" for _ in range(size // 5)]
            texts += [base, base + more] if rng.random() < 0.5 else [base, base[: size - size * 18 // 100]]
    got, want = kept(spark, texts)
    assert got == want and len(want) == 30


def test_prefixes_meet():
    """Whatever is common, prefixes of sets that are similar enough share a shingle."""
    rng = random.Random(16)
    for _ in range(300):
        base = [rng.getrandbits(64) for _ in range(rng.randrange(1, 60))]
        more = [rng.getrandbits(64) for _ in range(rng.randrange(0, len(base) // 4 + 1))]
        a, b = (np.unique(np.array(x, np.uint64)) for x in (base, base + more))
        w = np.unique(np.array(rng.sample(base, len(base) // 2), np.uint64))
        common = w, np.array([rng.randrange(1, 9) for _ in w], np.int64)
        assert len(base) / len(b) < 0.8 or len(np.intersect1d(shingles.prefix(a, common), shingles.prefix(b, common)))


def test_similarity_of_shingle_sets():
    rng = random.Random(4)
    for _ in range(200):
        a, b = (" ".join(rng.choice("ab c") for _ in range(rng.randrange(30))) for _ in range(2))
        assert abs(shingles.similar(shingles.shingle_set(a), shingles.shingle_set(b)) - jaccard(a, b)) < 1e-12


def test_components(spark):
    rng = random.Random(2)
    for edges in ([(k, k + 1) for k in range(200)], [(0, k) for k in range(1, 300)], [(rng.randrange(300), rng.randrange(300)) for _ in range(250)], [(5, 5), (6, 7), (6, 7)]):
        found = connected(spark.createDataFrame(edges, "a long, b long")).collect()
        nodes = {n for a, b in edges if a != b for n in (a, b)}
        want = roots(nodes, [e for e in edges if e[0] != e[1]])
        assert {r.node for r in found} == nodes and len(found) == len(nodes)
        assert len({(want[r.node], r.root) for r in found}) == len(set(want.values())) == len({r.root for r in found})
    assert connected(spark.createDataFrame([], "a long, b long")).collect() == []


BENCH = "item_id long, text string, extra string"


def slow_matches(docs, items, least=0.8):
    def shingles(words):
        return Counter(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4)))

    out = {}
    for k, t in docs:
        words = decontaminate.word_list((t or "").lower())
        for i, x in items:
            own = decontaminate.word_list((x or "").lower())
            for s in range(max(1, len(words) - len(own) + 1)) if own and words else ():
                v = decontaminate.similarity(shingles(words[s : s + len(own)]), shingles(own))
                if v >= least:
                    out[k, i] = max(v, out.get((k, i), 0))
    return out


def test_decontamination_against_brute_force(spark, sf_dir):
    found = {(r.doc_id, r.item_id): r.similarity for r in queries.op4_decontamination(spark, sf_dir).collect()}
    docs = [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").collect()]
    items = [tuple(r) for r in table(spark, sf_dir, "benchmark").collect()]
    want = slow_matches(docs, items)
    assert found.keys() == want.keys() and want and all(abs(found[k] - v) < 1e-9 for k, v in want.items())


def test_decontamination_with_edits_and_odd_items(spark, odd_docs, no_docs):
    rng = random.Random(9)
    words = [f"w{k}" for k in range(60)]
    items = [(k, " ".join(rng.choice(words) for _ in range(n))) for k, n in enumerate((40, 60, 33, 5, 4, 1, 60))] + [(7, None), (8, ""), (9, "...")]
    items.append((10, items[0][1]))
    docs = []
    for k in range(80):
        own = items[rng.randrange(7)][1].split()
        for _ in range(rng.randrange(4)):
            own[rng.randrange(len(own))] = rng.choice(words)
        docs.append((k, " ".join([f"z{rng.randrange(99)}" for _ in range(rng.randrange(80))] + own + [f"Z{rng.randrange(99)}!" for _ in range(rng.randrange(9))])))
    want = slow_matches(docs, items)
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(*i, "x") for i in items], BENCH)
    for block_bytes in (1 << 20, 300):  # one pass, and several
        found = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.contaminated(df, bench, block_bytes=block_bytes).collect()}
        assert found.keys() == want.keys() and all(abs(found[k] - v) < 1e-9 for k, v in want.items())
        assert {r.doc_id for r in decontaminate.clean(df, bench, block_bytes=block_bytes).collect()} == {k for k, _ in docs} - {k for k, _ in want}
    hello = spark.createDataFrame([(1, "general reader of many small words", "x")], BENCH)
    assert Counter(r.doc_id for r in decontaminate.contaminated(odd_docs, hello).collect()) == Counter([1, 1, 6])
    kept = decontaminate.clean(odd_docs, hello)
    assert kept.schema == odd_docs.schema and kept.count() == odd_docs.count() - 3
    assert decontaminate.contaminated(no_docs, hello).collect() == [] and decontaminate.clean(no_docs, hello).collect() == []
    assert decontaminate.contaminated(odd_docs, hello.limit(0)).collect() == []


def test_index_misses_no_fingerprint_within_the_radius_and_is_selective():
    rng = random.Random(4)
    items = [(k, " ".join(f"w{rng.randrange(4000)}" for _ in range(60))) for k in range(2000)]
    index = decontaminate.Index(items, 5, 16, 0.8)
    proposed = 0
    for _ in range(200):
        f = [rng.getrandbits(64) for _ in range(2)]
        near = rng.randrange(2000)
        f[1] = int(index.prints[near, 1]) ^ sum(1 << b for b in rng.sample(range(64), 16))
        assert set(index.near(f).tolist()) == {k for k, p in enumerate(index.prints.tolist()) if min((x ^ y).bit_count() for x, y in zip(p, f, strict=True)) <= 16}
        proposed += len(np.union1d(*(w.candidates(rng.getrandbits(64)) for w in index.words)))
    assert proposed < 0.01 * 200 * 2000


def test_recall_near_the_threshold(spark):
    """Passages edited down to a similarity of 0.8 to 0.85, in longer and in shorter documents: all are found."""
    rng, items, docs = random.Random(21), [], []
    for k in range(60):
        n = rng.choice((40, 60, 100, 200))
        own = [f"v{rng.randrange(10**6)}" for _ in range(n)]
        items.append((f"item {k}", " ".join(own), "x"))
        for _ in range(8):
            new = list(own)
            while decontaminate.similarity(*(Counter(tuple(x[j : j + 5]) for j in range(n - 4)) for x in (new, own))) > 0.86:
                at = rng.randrange(n)
                new[at] = f"u{rng.randrange(10**6)}"
            around = [[f"z{rng.randrange(10**6)}" for _ in range(rng.randrange(50))] for _ in range(2)]
            docs.append((len(docs), " ".join(around[0] + new + around[1])))
        docs.append((len(docs), " ".join(own[: n - n // 8])))
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string, extra string")
    want = {m: v for k, t in docs for m, v in slow_matches([(k, t)], [items[k // 9][:2]]).items()}  # words of others are others
    assert len(want) > 400 and min(want.values()) < 0.83
    for block_bytes in (1 << 20, 9000):  # one pass, and several
        assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(df, bench, block_bytes=block_bytes).collect()} == want.keys()


def test_several_passes_read_only_what_may_hold_an_item(spark):
    """Texts that quote less than the smallest item, or words in another order, aren't read again; all that hold one are."""
    rng, items, good, bad = random.Random(22), [], [], []
    for k in range(40):
        own = [f"v{rng.randrange(10**4)}" for _ in range(rng.choice((12, 30, 45, 80, 300)))]
        items.append((k, " ".join(own), "x"))
        around = [[f"z{rng.randrange(10**4)}" for _ in range(rng.randrange(300))] for _ in range(2)]
        new = own[: len(own) // 2] + ["other"] * (len(own) > 60) + own[len(own) // 2 + (len(own) > 60) :]
        good += [" ".join(around[0] + new + around[1]), " ".join(own[: len(own) - len(own) // 10])]
        bad += [" ".join(around[0] + own[:8] + around[1]), " ".join(around[0] + rng.sample(own, len(own)))]
    bench = spark.createDataFrame([*items, (98, None, "x"), (99, "", "x")], BENCH)
    test = decontaminate.may_hold(bench, "text", 5, 0.8)
    assert all(map(test, good)) and not any(map(test, bad)) and not test(None) and not test("") and not test("...")
    docs = spark.createDataFrame(list(enumerate(good + bad + [None, ""])), "doc_id long, text string")
    found = [{tuple(r) for r in decontaminate.contaminated(docs, bench, block_bytes=most).collect()} for most in (1 << 20, 1000)]
    assert found[0] == found[1] and len({k for k, _, _ in found[0]}) == len(good)
    left = [sorted(r.doc_id for r in decontaminate.clean(docs, bench, block_bytes=most).collect()) for most in (1 << 20, 1000)]
    assert left[0] == left[1] == list(range(len(good), len(good + bad) + 2))


def test_duplicate_keys_with_other_texts(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "g h i j k l"), (2, "a b c d e f")], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in simhash.keep_one(df).collect()) == [(1, "a b c d e f"), (1, "g h i j k l")]
    assert df.filter(F.col("doc_id") == 9).count() == 0
