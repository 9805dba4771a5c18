"""Secrets, classifiers, packing, joins and the pipeline, against brute force and by hand."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecloom.llm import embedding_dedup, ngram_join, packing, quality, secret_scan, toxicity
from vecloom.llm.components import components

SMALL = "/root/testdata/sf0.001"
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)


def base_spans(text):
    text = text or ""
    found = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


SECRETS = [
    "", None, "nothing", "token=token: abcdefgh", "PassWord: 'abcdef'", 'api_key" = "x.y/z+w=="', "apikey:short", "AKIA" + "A1" * 8, "AKIAAKIA" + "B" * 16 + "x", "é🙂 secret= 0123456789abcdef01234567 é", "0" * 24 + "g" + "f" * 23,
    "passwd==abcdef token:\tabcdefg", "SECRET  :  deadbeefdeadbeefdeadbeef00 " * 700, "a1b2" * 30_000, "xx token=abcdef", "xx token=abcdef",
]


def test_secrets(spark):
    rows = [(i if i != 4 else None, t) for i, t in enumerate(SECRETS)] + [(0, "token=zzzzzz")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit("clash")).withColumn("key", F.lit(1))
    found = secret_scan.find_secrets(df)
    got = found.collect()
    assert len(got) == len(rows)
    for r in got:
        assert [(s["start"], s["rank"], s["end"], s["kind"]) for s in r["spans"]] == base_spans(r["text"])
    for r in found.select("text", secret_scan.redacted(F.col("text"), F.col("spans"), "#").alias("clean")).collect():
        want, at = [], 0
        for start, _, end, _ in base_spans(r["text"]):
            if start >= at:
                want.append(r["text"][at:start] + "#")
            at = max(at, end)
        assert r["clean"] == (None if r["text"] is None else "".join(want) + r["text"][at:])
    assert secret_scan.find_secrets(df.limit(0)).count() == 0
    secret_scan.BROADCAST_ROWS, usual = 0, secret_scan.BROADCAST_ROWS  # the join by a shuffle finds the same
    again = secret_scan.find_secrets(df)
    assert sorted(map(str, again.collect())) == sorted(map(str, got))
    secret_scan.BROADCAST_ROWS = usual


def test_trigram_queries():
    assign, access, hexes = map(secret_scan.trigram_query, secret_scan.BASE_RULES)
    assert frozenset({"tok", "oke", "ken"}) in assign and len(assign) == 6
    assert access == [frozenset({"aki", "kia"})] and hexes == []
    for rule, q in zip(secret_scan.BASE_RULES, (assign, access, hexes), strict=True):
        for text in filter(None, SECRETS):
            if q and re.search(rule.pattern, text, re.I if rule.ignore_case else 0):
                assert any(all(g in text.lower() for g in s) for s in q)


def test_secret_query_digests(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    for r in secret_scan.op2_secret_scans(spark, SMALL).collect():
        spans = base_spans(texts[r["doc_id"]])
        listed = ",".join(f"{k}:{s}:{e}" for s, _, e, k in spans)
        assert (r["spans"], r["base_sha256"]) == (listed, hashlib.sha256(listed.encode()).hexdigest())
        assert [r[f"n_{k}"] for k in ("assign", "access", "hex")] == [sum(s[3] == k for s in spans) for k in ("assign", "access", "hex")]


def labelled(spark, n=600, seed=1):
    """Texts of which every fifth has insults, every seventh is shouted junk."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abdeilnorstu") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    rows = []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(5, 80))]
        toxic, good = int(i % 5 == 0), int(i % 7 != 0)
        if toxic:
            text.insert(rng.randrange(len(text)), rng.choice(["vilepig", "dumbgoat", "vilegoat"]))
        rows.append((i, " ".join(t if good else t.upper() + "!!" for t in text), toxic, good))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int, quality int").cache()
    return df.select("doc_id", "text"), df.select("doc_id", "toxic", "quality")


def odd_rows(docs, spark):
    return docs.unionByName(spark.createDataFrame([(None, "a null id"), (9001, None), (9002, ""), (9003, "word " * 60_000), (9004, "same"), (9004, "same")], docs.schema))


def test_toxicity(spark):
    docs, labels = labelled(spark)
    model = toxicity.fit_toxicity(docs, labels.where("doc_id % 3 <> 0"))
    rows = odd_rows(docs, spark)
    found = toxicity.score_toxicity(rows.withColumn("score", F.lit("clash")), model).collect()
    assert len(found) == rows.count() and all(0 <= r["score"] <= 1 for r in found)
    held = [r for r in found if r["doc_id"] is not None and r["doc_id"] < 9000 and r["doc_id"] % 3 == 0]
    assert np.mean([(r["score"] >= 0.5) == (r["doc_id"] % 5 == 0) for r in held]) > 0.95
    assert all(r["score"] < 0.5 for r in found if r["doc_id"] in (9001, 9002, 9004))
    assert {r["score"] for r in toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels.where("toxic = 0"))).collect()} == {0.0}
    assert toxicity.fit_toxicity(docs.limit(0), labels).weights is None
    assert toxicity.score_toxicity(docs.limit(0), model).count() == 0


def test_toxicity_of_rare_words(spark):
    """Words of few labelled documents count too, though common ones have thousands of n-grams."""
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 10))
    plain, common, rare = [word() for _ in range(300)], [word() for _ in range(400)], [word() for _ in range(200)]
    said = lambda *bad: " ".join([*rng.choice(plain, 6), *bad])
    texts = [(said(w), 1) for w in common for _ in range(12)] + [(said(w), 1) for w in rare for _ in range(3)]
    texts += [(said(), 0) for _ in range(len(texts))]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(texts)], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(docs, labels)
    assert (model.scores([said(w) for w in rare]) >= 0.5).mean() > 0.8
    assert (model.scores([said() for _ in range(200)]) < 0.5).mean() > 0.95


def test_toxicity_fits_on_bounded_buckets(spark, monkeypatch):
    """More buckets than one task may hold: a share of the documents is fitted on, and an end before the loss stands still is told."""
    docs, labels = labelled(spark)
    whole = toxicity.fit_toxicity(docs, labels)
    assert whole.converged
    monkeypatch.setattr(toxicity, "FIT_BUCKETS", 20_000)
    part = toxicity.fit_toxicity(docs, labels)
    assert 0 < (part.weights != 0).sum() < (whole.weights != 0).sum()
    assert not toxicity.minimised(lambda v: (float(v @ v), 2 * v), np.ones(3), rounds=1)[1]


def test_quality(spark):
    docs, labels = labelled(spark)
    stats = quality.document_statistics(odd_rows(docs, spark).withColumn("statistics", F.lit("clash")))
    model = quality.fit_quality(stats, labels.where("doc_id % 3 <> 0"))
    found = quality.score_quality(stats, model).collect()
    assert len(found) == stats.count() and all(0 <= r["score"] <= 1 for r in found)
    held = [r for r in found if r["doc_id"] is not None and r["doc_id"] < 9000 and r["doc_id"] % 3 == 0]
    assert np.mean([(r["score"] >= 0.7) == (r["doc_id"] % 7 != 0) for r in held]) > 0.95
    direct = {r["doc_id"]: r["score"] for r in quality.score_texts(docs, model).collect()}
    assert all(direct[r["doc_id"]] == pytest.approx(r["score"]) for r in held)
    assert quality.fit_quality(stats, labels.where("quality = 1")).base == 1.0
    assert quality.score_quality(stats.limit(0), model).count() == 0


def test_isotonic():
    x, share = quality.isotonic(np.arange(5.0), np.ones(5), np.array([0.0, 1, 0, 1, 1]))
    assert (np.diff(share) > 0).all() and (np.diff(x) > 0).all()
    assert share.tolist() == [0.0, 0.5, 1.0]


@pytest.mark.parametrize("seed", range(8))
def test_bounds_are_optimal(seed):
    rng = random.Random(seed)
    lengths = sorted(rng.sample(range(1, 60), 9))
    histogram = [(x, n := rng.randint(1, 9), n * x) for x in lengths]
    for buckets in (1, 2, 3, 4, 20):
        cost = lambda bounds: sum(n * min(b for b in bounds if b >= x) - t for x, n, t in histogram)  # noqa: B023, E731
        bounds = packing.optimal_bounds(histogram, buckets)
        best = min(cost((*c, lengths[-1])) for k in range(min(buckets, 9)) for c in itertools.combinations(lengths[:-1], k))
        assert len(bounds) <= buckets and bounds == sorted(set(bounds)) and cost(bounds) == best
    assert packing.optimal_bounds([], 4) == []


def least_padding(lengths, buckets):
    """Least padding of sorted lengths in so many buckets, by trying every last bound of every prefix."""
    cells = sorted(set(lengths))
    n, best = [lengths.count(c) for c in cells], [[0, *[None] * len(cells)]]
    for _ in range(buckets):
        row = [0]
        for j in range(1, len(cells) + 1):
            row.append(min(best[-1][i] + sum(n[k] * (cells[j - 1] - cells[k]) for k in range(i, j)) for i in range(j) if best[-1][i] is not None))
        best.append(row)
    return best[-1][-1]


def test_long_lengths_have_their_own_cells(spark):
    """Lengths far over 65,536 that differ by little are told apart, and the padding is the least."""
    rng = random.Random(8)
    lengths = [rng.choice((70_000, 70_010, 70_250, 131_073, 131_200, 131_201, 9_000_000, 9_000_001, 9_030_000)) for _ in range(60)] + [rng.randint(1, 40) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(lengths)), "doc_id long, n_tokens long")
    for buckets in (2, 5, 8):
        found = packing.pack(df, buckets).collect()
        assert sum(r["padded_tokens"] - r["n_tokens"] for r in found) == least_padding(lengths, buckets)


def test_many_equal_rows_are_packed_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(packing, "PIECE", 7)
    df = spark.createDataFrame([(None, 3)] * 100 + [(1, 3)] * 50 + [(2, 4)], "doc_id long, n_tokens long")
    found = packing.pack(df, 1, 40).collect()
    assert sorted(r["batch"] * 10 + r["place"] for r in found) == list(range(151)) and {r["padded_tokens"] for r in found} == {4}
    assert sum(r["doc_id"] is None for r in found) == 100


def test_packing_query(spark):
    import base64

    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {r["doc_id"]: len(library.encode_ordinary(r["text"] or "")) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    found = packing.op5_packing(spark, SMALL).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in found} == want and len(found) == len(want)
    assert sum(r["padded_tokens"] - r["n_tokens"] for r in found) == least_padding(list(want.values()), packing.BUCKETS)
    batches = {}
    for r in found:
        batches.setdefault((r["bucket"], r["padded_tokens"]), {}).setdefault(r["batch"], []).append(r["place"])
    for (_, padded), own in batches.items():
        room = max(1, packing.TOKEN_BUDGET // padded)
        assert sorted(own) == list(range(len(own))) and all(sorted(p) == list(range(len(p))) for p in own.values())
        assert all(len(own[b]) == room for b in sorted(own)[:-1]) and len(own[max(own)]) <= room


def test_packing(spark):
    rng = random.Random(3)
    rows = [(i if i else None, rng.choice([0, 1, 5, 30, 31, 900, None, 70_001, 10**7])) for i in range(500)] + [(7, 5), (7, 5)]
    df = spark.createDataFrame(rows, "doc_id long, n_tokens long").withColumn("bucket", F.lit("clash"))
    found = packing.pack(df, 4, 1000).collect()
    assert len(found) == len(rows)
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in found) == sorted((str(i), n or 0) for i, n in rows)
    seen = {}
    for r in found:
        assert r["n_tokens"] <= r["padded_tokens"]
        seen.setdefault((r["bucket"], r["padded_tokens"], r["batch"]), []).append(r["place"])
    by_bucket = {}
    for (bucket, padded, batch), places in seen.items():
        assert sorted(places) == list(range(len(places))) and len(places) <= max(1, 1000 // max(1, padded))
        by_bucket.setdefault((bucket, padded), {})[batch] = len(places)
    for (_, padded), sizes in by_bucket.items():
        assert sorted(sizes) == list(range(len(sizes)))
        assert all(sizes[b] == max(1, 1000 // max(1, padded)) for b in sorted(sizes)[:-1])
    assert packing.pack(df.limit(0)).count() == 0


def brute_components(texts):
    """n_shingles and smallest linked id, for (id, text) rows."""
    sets = []
    for i, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append((i, {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()))
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(sets)), 2):
        x, y = sets[a][1], sets[b][1]
        if x and y and 100 * len(x & y) >= 80 * len(x | y):
            parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    return sorted((str(i), len(s), str(least.get(root(k), i))) for k, (i, s) in enumerate(sets))


def near_copies(n, seed, changes):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    base = [rng.choice(words) for _ in range(60)]
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(rng.randint(0, changes)):
            own[rng.randrange(len(own))] = rng.choice(words)
        out.append(" ".join(own))
    return out


def test_jaccard_against_brute_force(spark):
    texts = near_copies(120, 1, 3) + near_copies(30, 2, 1) + ["", None, " \t\n", "one two", "One  two", "TWO one", "a b c d e", "a b c d e f", "x " * 50_000, "É b c d e f", "é b c d e f"]
    rng = random.Random(5)
    texts += [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 30))) for _ in range(60)] + [texts[0]] * 40
    rows = [(1000 - i, t) for i, t in enumerate(texts)] + [(None, texts[0]), (None, "alone here"), (1000, texts[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("clash")).withColumn("node", F.lit("clash")).repartition(5)
    found = ngram_join.similar_documents(df).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in found) == brute_components(rows)
    kept = ngram_join.drop_similar(df.where("doc_id IS NOT NULL")).collect()
    groups = {c for i, _, c in brute_components([r for r in rows if r[0] is not None])}
    assert sorted(str(r["doc_id"]) for r in kept) == sorted(groups)
    assert ngram_join.similar_documents(df.limit(0)).count() == 0


def kept_rows(rows):
    """Of each group the first row by id, null last; rows without words all stay."""
    groups = {}
    out = []
    for (i, t), (_, _, c) in zip(rows, brute_in_order(rows), strict=True):
        if (t or "").split():
            groups.setdefault(c, []).append((i is None, i or 0, t))
        else:
            out.append((i, t))
    return out, {g: {(i, t) for _, i, t in members} for g, members in groups.items()}, {g: min(members)[:2] for g, members in groups.items()}


def brute_in_order(rows):
    """As brute_components, a group named by its first row's place, in the rows' order."""
    texts = [(k, t) for k, (_, t) in enumerate(rows)]
    found = {int(i): (n, int(c)) for i, n, c in brute_components(texts)}
    return [(k, *found[k]) for k in range(len(rows))]


def test_rows_are_dropped_one_by_one(spark):
    """Where ids repeat or are null, a row stays or goes by its own text."""
    texts = near_copies(12, 7, 2)
    rows = [(1, texts[0]), (5, texts[1]), (5, "another text of quite other words stays here"), (5, "another text of quite other words stays here"), (7, texts[2]), (7, texts[3])]
    rows += [(None, texts[4]), (None, "only rows without ids have this text at all"), (None, "only rows without ids have this text at all"), (None, ""), (None, None), (9, " "), (9, " ")]
    rows += [(3, "and twelve words that are in two rows of one and the same id"), (3, "and twelve words that are in two rows of one and the same id now")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("digest", F.lit("clash")).withColumn("doc_id_3", F.lit(1)).repartition(3)
    kept = [(r["doc_id"], r["text"]) for r in ngram_join.drop_similar(df).collect()]
    wordless, groups, firsts = kept_rows(rows)
    assert sorted(map(str, [k for k in kept if not (k[1] or "").split()])) == sorted(map(str, wordless))
    worded = [k for k in kept if (k[1] or "").split()]
    assert len(worded) == len(groups)
    for g, members in groups.items():
        own = [(i, t) for i, t in worded if (i or 0, t) in members]
        assert len(own) == 1 and (own[0][0] is None, own[0][0] or 0) == firsts[g]


def test_names_survive_packing():
    rng = np.random.default_rng(1)
    for names in (np.empty(0, np.uint64), np.array([0], np.uint64), np.array([2**64 - 1], np.uint64), np.sort(rng.integers(0, 2**63, 1000).astype(np.uint64)), np.array([5, 5, 7], np.uint64)):
        assert (ngram_join._unpacked(ngram_join._packed(names)) == names).all()


def test_common_shingles_reach_their_bucket_once(spark):
    """A line that all documents have brings a chunk's bucket one entry a shingle, and is still counted whole."""
    line = "we use cookies on this site to make it better for you"
    texts = [f"{line} {' '.join(f'u{i}x{j}' for j in range(12))}" for i in range(400)] + [f"{line} {' '.join(f'u{i}x{j}' for j in range(11))}" for i in range(40)]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).withColumn("digest", F.lit(0).cast("long"))
    cells = ngram_join._scatter(df.select("doc_id", "text", "digest"), 8).where("bucket >= 0").collect()
    assert sum(len(r["docs"]) // 2 for r in cells) < 0.65 * sum(max(0, len(t.split()) - 4) for t in texts)
    assert max(np.bincount(np.frombuffer(b"".join(bytes(r["many"]) for r in cells), np.uint32))[80:]) > 0
    found = ngram_join.similar_documents(df).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in found) == brute_components(rows)


def test_components(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(200, x) for x in range(201, 240)] + [(None, 3), (5, 5)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    found = components(spark.createDataFrame(links, "a long, b long"))
    assert {r["node"]: r["root"] for r in found.collect()} == {x: root(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_vectors(rows, threshold=0.95):
    usable = [(k, np.array(v, float)) for k, (i, v) in enumerate(rows) if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    links, parent = [0] * len(rows), list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, x), (b, y) in itertools.combinations(usable, 2):
        if len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
            links[a] += 1
            links[b] += 1
            parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    return sorted((str(i), links[k], str(least.get(root(k), i))) for k, (i, _) in enumerate(rows))


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(150, 24))
    rows = []
    for c in centers:
        rows += [(c + 0.05 * rng.normal(size=24)).tolist() for _ in range(rng.integers(1, 5))]
    rows += [(centers[0] + 0.15 * rng.normal(size=24)).tolist() for _ in range(250)] + [rows[3]] * 30
    rows += [None, [], [0.0] * 24, [1.0, None] + [0.0] * 22, [float("nan")] * 24, [float("inf")] + [0.0] * 23, [1.0, 2.0], [1.0, 2.0], [2.0, 4.1], [1e300] * 24]
    rows = [(5000 - 3 * i, v) for i, v in enumerate(rows)] + [(None, rows[0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("links", F.lit("clash"))
    embedding_dedup.LEAF_ROWS, embedding_dedup.BLOCK_ROWS, usual = 64, 50, (embedding_dedup.LEAF_ROWS, embedding_dedup.BLOCK_ROWS)
    found = embedding_dedup.similar_vectors(df).collect()
    embedding_dedup.LEAF_ROWS, embedding_dedup.BLOCK_ROWS = usual
    got, want = sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"])) for r in found), brute_vectors(rows)
    assert len(got) == len(want)
    total = sum(w[1] for w in want)
    assert 0.97 * total <= sum(g[1] for g in got) <= total and all(g[1] <= w[1] for g, w in zip(got, want, strict=True))
    assert sum(g[2] == w[2] for g, w in zip(got, want, strict=True)) >= len(want) - 3
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in found if r["vec_id"] is not None)
    assert embedding_dedup.similar_vectors(df.limit(0)).count() == 0


@pytest.mark.parametrize("depth", [0, 4, 8])
def test_links_are_found_at_depth(spark, tmp_path, monkeypatch, depth):
    """The query on a table of 2,000 vectors in groups of near copies, with trees of so many levels, against brute force."""
    rng = np.random.default_rng(depth)
    centers = rng.normal(size=(500, 64)) / 8
    x = np.repeat(centers, 4, axis=0) + 0.02 * rng.normal(size=(2000, 64))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    df.write.parquet(str(tmp_path / "embeddings.parquet"))
    monkeypatch.setattr(embedding_dedup, "LEAF_ROWS", 2000 >> depth or 1)
    found = {r["vec_id"]: r for r in embedding_dedup.op9_embedding_dedup(spark, str(tmp_path)).collect()}
    x = x.astype(np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    want, got = near.sum(axis=1), np.array([found[i]["n_links"] for i in range(2000)])
    assert want.sum() > 1000 and (got <= want).all() and got.sum() >= 0.99 * want.sum()
    least = np.arange(2000)
    while True:
        new = np.minimum(least, np.where(near, least[None], 2000).min(axis=1))
        if (new == least).all():
            break
        least = new
    assert np.mean([found[i]["component_id"] == least[i] for i in range(2000)]) >= 0.99
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in found.values())


def test_forests_grow_with_depth():
    assert embedding_dedup.trees_for(0, 0.95) == embedding_dedup.trees_for(8, 0.95) == embedding_dedup.TREES
    assert embedding_dedup.trees_for(22, 0.95) > 5 and embedding_dedup.trees_for(22, 0.99) <= embedding_dedup.trees_for(22, 0.95)
    x = np.random.default_rng(0).normal(size=(4000, 16))
    forest = embedding_dedup.fit_forest(x / np.linalg.norm(x, axis=1, keepdims=True), 14, 2)
    assert sum(len(b) for t in forest for b in t.bounds) < 2 * 2 * 4000 / embedding_dedup.LEAST_SAMPLE + 2 * 14
    rows, leaves = forest[0].leaves(x[:100])
    assert set(rows) == set(range(100)) and leaves.max() < 1 << 14


def test_pipeline(spark):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    before = docs
    for name, stage in pipeline.STAGES:
        after = stage(spark, before, SMALL).cache()
        if name == "near_duplicates":
            rows = [(r["doc_id"], r["text"]) for r in before.collect()]
            assert {str(i) for i in ids(after)} == {c for _, _, c in brute_components(rows)}
        elif name == "secrets":
            assert ids(after) == ids(before)
            old = {r["doc_id"]: r for r in before.collect()}
            for r in after.collect():
                assert not any(s[3] == "hex" for s in base_spans(r["text"]))
                assert (r["text"] == old[r["doc_id"]]["text"]) == (not base_spans(old[r["doc_id"]]["text"]))
        elif name == "packing":
            assert ids(after) == ids(before) and after.count() == before.count()
            break
        assert ids(after) <= ids(before) and after.columns == docs.columns
        before = after
    assert pipeline.run(spark, SMALL).count() == after.count()
    assert len(pipeline.STAGES) == 5 and pipeline.ORACLE_SQL is None


def test_stages_take_odd_documents(spark):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (90_001, "", "en", "s", 0), (90_002, "word " * 30_000, None, "s", 1), (1, "again", "en", "s", 5)], docs.schema)
    for frame in (docs.limit(0), docs.limit(30).unionByName(odd).withColumn("score", F.lit(1)).withColumn("spans", F.lit(2)).withColumn("__x", F.lit(3))):
        for name, stage in pipeline.STAGES:
            out = stage(spark, frame, SMALL)
            assert out.count() <= frame.count()
            assert name == "packing" or out.columns == frame.columns
