"""Best-fit packing, the filter audit and lexical search against plain code, with nulls, repeats, long texts and clashing columns."""

import math
import re
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vecloom.llm import best_fit, filter_audit, lexical_search, token_count
from vecloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
JSON = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, None, "en", "s", 0),
    (2, "", None, "s", 0),
    (3, "word " * 30, "en", None, 1),
    (4, "word " * 30, "de", "s", 1),
    (5, "A B C D # one two three\tfour\x0bfive six", "", "s", 1),
    (6, " ".join(f"w{i}" for i in range(4000)), "en", "s", 1),
    (6, " ".join(f"w{i}" for i in range(4000)), "en", "s", 1),
    (None, "word " * 30, "fr", "s", 1),
    (7, "<|endoftext|> in the middle<|endoftext|>", "fr", "s", 1),
    (8, " \n\t" * 50, "fr", "s", 1),
    (9, "Ünïcode WÖRDS 漢字 漢字 x-y_z 12.5", "xx", "s", 1),
]


def given(spark, rows=ODD):
    """Odd documents, with columns of the names that the operators use inside."""
    docs = spark.createDataFrame(rows, SCHEMA)
    return docs.withColumns({c: F.lit("mine") for c in ("key", "part", "mask", "digest", "first", "piece", "start", "length", "sequence_id", "number", "rank", "score", "item", "terms", "rows", "__rows")})


def ids_of(tokenizer, text):
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")


def check_pieces(found: pd.DataFrame, docs: list[tuple], capacity=2048):
    tokenizer = Tokenizer.from_file(JSON)
    wanted = Counter()
    for doc_id, text, *_ in docs:
        ids = ids_of(tokenizer, text)
        first = len(ids) - capacity * ((len(ids) - 1) // capacity)
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        for n, (a, b) in enumerate(zip(cuts, cuts[1:])):
            wanted[(doc_id, n, a, b - a, zlib.crc32(ids[a:b].tobytes()))] += 1
    have = Counter((None if pd.isna(r.doc_id) else int(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in found.itertuples())
    assert have == wanted
    for _, own in found.sort_values("offset").groupby("sequence_id"):
        assert own["offset"].tolist() == [0, *own["length"].cumsum().tolist()[:-1]] and own["length"].sum() <= capacity


def test_best_fit_query(spark):
    docs = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()]
    found = QUERIES["op11_best_fit_packing"](spark, SF).toPandas()
    check_pieces(found, docs)
    assert found["sequence_id"].nunique() <= -(-int(found["length"].sum()) // 2048) + 1


def test_odd_pieces(spark):
    found = best_fit.pack_pieces(best_fit.token_pieces(given(spark), JSON)).toPandas()
    assert list(found.columns) == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    check_pieces(found, ODD)
    assert best_fit.pack_pieces(best_fit.token_pieces(given(spark, []), JSON)).count() == 0
    with pytest.raises(Exception, match="lengths are from 1"):
        best_fit.pack_pieces(spark.createDataFrame([(1, 9)], "doc_id long, length long"), capacity=8).collect()


def test_rounds_of_best_fit(spark):
    """Few items a group, so bins meet in four rounds; nothing is lost, and few sequences more than of one group, though a group has 100 items in place of 16,384."""
    rng = np.random.default_rng(3)
    for lengths in (rng.integers(1, 2048, 3000), rng.integers(1100, 2048, 600), rng.integers(1, 60, 3000), np.full(999, 700)):
        pieces = spark.createDataFrame(pd.DataFrame({"doc_id": np.arange(len(lengths)) % 7, "length": lengths}))
        found = best_fit.pack_pieces(pieces, items=100, fan=3).toPandas()
        assert Counter(zip(found["doc_id"], found["length"])) == Counter(zip((np.arange(len(lengths)) % 7).tolist(), lengths.tolist()))
        for _, own in found.sort_values("offset").groupby("sequence_id"):
            assert own["offset"].tolist() == [0, *own["length"].cumsum().tolist()[:-1]] and own["length"].sum() <= 2048
        whole = int(best_fit.best_fit(lengths, 2048).max()) + 1
        assert whole <= found["sequence_id"].nunique() <= 1.05 * whole + 2
        if len(set(lengths.tolist())) == 1:  # each group has a bin left that another's fills
            assert found["sequence_id"].nunique() == whole


def test_best_fit_places_like_plain_code():
    rng = np.random.default_rng(4)
    lengths, room, want = rng.integers(1, 100, 500), [], np.empty(500, int)
    for i in np.argsort(-lengths, kind="stable"):
        fits = [b for b, r in enumerate(room) if r >= lengths[i]]
        least = min((room[b] for b in fits), default=None)
        if least is None:
            room.append(100)
            want[i] = len(room) - 1
        else:
            want[i] = next(b for b in fits if room[b] == least)
        room[want[i]] -= lengths[i]
    got = best_fit.best_fit(lengths, 100)
    assert got.max() + 1 == len(room)
    assert sorted(np.bincount(got, lengths).tolist()) == sorted(np.bincount(want, lengths).tolist())


def test_ids_as_the_library_gives_them():
    tokenizer, encode = Tokenizer.from_file(JSON), token_count.id_encoder(JSON)
    rng = np.random.default_rng(5)
    texts = ["", " ", "a" * 3000, "it's we'll <|endoftext|>x", " \n" * 70_000 + "end", "x" + "\t" * 70_000, "　  漢字 ​ é ", "end " + " " * 1_200_000, "a" + " " * 1_200_000 + "b c"]
    texts += ["".join(chr(c) for c in rng.choice([*range(32, 127), *range(0x3A0, 0x400), 0x1F600, 10, 9, 0x85, 0x2028], 400)) for _ in range(50)]
    for text in texts:
        assert encode(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    word = public_tokenizers.path("word_bpe_49k.json")  # not byte-level, so the library itself encodes
    assert token_count.id_encoder(word)("Some Words").tolist() == Tokenizer.from_file(word).encode("Some Words", add_special_tokens=False).ids


def audited(docs, labels):
    """The audit by walking through every order, document by document."""
    good, toxic = ({i for i, q, t in labels if (q, t)[n] == 1} for n in (0, 1))
    fails = []
    for doc_id, text, lang, *_ in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        copies = [d[0] for d in docs if (d[1] or "") == text and d[0] is not None]
        own = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), "D": bool(re.search(r"[#$%&*|]", text)), "E": doc_id is not None and min(copies) < doc_id}
        fails.append((lang or "", doc_id, {f for f, x in own.items() if x}))
    out = {}
    for part in {p for p, *_ in fails}:
        removed_by = Counter()
        for order in map("".join, permutations("ABCDE")):
            left = [(i, f) for p, i, f in fails if p == part]
            for step, letter in enumerate(order, 1):
                gone = [(i, f) for i, f in left if letter in f]
                left = [(i, f) for i, f in left if letter not in f]
                every = [f for p, _, f in fails if p == part]
                removed_by[letter] += len(gone)
                out[part, order, step] = [len(left), len(gone), sum(letter in f for f in every) - len(gone), sum(f == {letter} for f in every), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
        for (p, order, step), counts in out.items():
            if p == part:
                counts.append(removed_by[order[step - 1]])
    return out


COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


@pytest.mark.parametrize("labels", [[], [(3, 1, 0), (3, 0, 0), (4, None, 1), (6, 1, 1), (None, 1, 1), (99, 1, 1)]])
def test_odd_audit(spark, labels):
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = filter_audit.audit(filter_audit.mask_histogram(given(spark), known)).collect()
    best = [(3, 1, 0), (4, 0, 1), (6, 1, 1)] if labels else []
    assert {(r["part"], r["filter_order"], r["step"]): [r[c] for c in COUNTS] for r in found} == audited(ODD, best)
    assert filter_audit.audit(filter_audit.mask_histogram(given(spark, []), known)).count() == 0


def searched(docs, items, k=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    lists = [(doc_id, Counter(words(text))) for doc_id, text, *_ in docs]
    lists = [(i, c) for i, c in lists if c]
    n_docs, n_terms = len(lists), sum(sum(c.values()) for _, c in lists)
    df = Counter(t for _, c in lists for t in c)
    out = []
    for item, text in items:
        scores = []
        for doc_id, c in lists:
            m = 100 - 90 + 90 * sum(c.values()) * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(words(text)) if c[t])
            if score > 0:
                scores.append((-score, doc_id is None, doc_id or 0))
        out += [(item, rank, None if none else doc_id, -score) for rank, (score, none, doc_id) in enumerate(sorted(scores)[:k], 1)]
    return out


ITEMS = [(1, "word five 漢字"), (1, "W0 w1 w2 w3999"), (2, None), (3, ""), (4, "absent"), (5, "word word WORD!"), (5, "word word WORD!"), (None, "six ünïcode"), (6, " ".join(f"w{i}" for i in range(3000)))]


def test_odd_search(spark, tmp_path):
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumns({c: F.lit("mine") for c in ("key", "rank", "score", "doc_id", "number", "item")})
    index = lexical_search.LexicalIndex.build(given(spark), str(tmp_path / "index"))
    found = [tuple(r) for r in index.search(items).collect()]
    once = list(dict.fromkeys(ITEMS))
    order = lambda rows: sorted(rows, key=str)
    assert order(found) == order(searched(ODD, once))
    assert order(tuple(r) for r in lexical_search.LexicalIndex.open(spark, str(tmp_path / "index")).search(items, k=2).collect()) == order(searched(ODD, once, 2))
    assert index.search(items.limit(0)).count() == 0
    none = lexical_search.LexicalIndex.build(given(spark, [(1, None, "en", "s", 0), (2, "-- !", "en", "s", 0)]), str(tmp_path / "none"))
    assert none.search(items).count() == 0 and (none.n_docs, none.n_terms) == (0, 0)


def test_search_in_many_blocks_and_passes(spark, tmp_path, monkeypatch):
    """Blocks of a few documents, slabs of a few terms and passes of a few items; whole copies tie and go by doc_id."""
    for name, value in (("BLOCK_DOCS", 3), ("SLAB", 4), ("ITEMS", 2)):
        monkeypatch.setattr(lexical_search, name, value)
    rng = np.random.default_rng(6)
    words = [f"t{i}" for i in range(60)]
    docs = [(i, " ".join(rng.choice(words, rng.integers(1, 40))), "en", "s", 1) for i in range(150)] + [(1000 - i, "t1 t2 t3 t4", "en", "s", 1) for i in range(40)]
    items = [(i, " ".join(rng.choice(words, 6))) for i in range(9)]
    index = lexical_search.LexicalIndex.build(given(spark, docs).repartition(5), str(tmp_path / "index"))
    found = index.search(spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(tuple, found.collect())) == sorted(searched(docs, items))


def test_bounds_hold():
    """A byte's steps are never under the impact, and less than one step above it."""
    rng = np.random.default_rng(7)
    tf, n = rng.integers(1, 5000, 10_000), rng.integers(1, 100_000, 10_000)
    exact = lexical_search.impacts(tf, n, 1000, 400_000)
    level = -(-exact // lexical_search.STEP)
    assert (level <= 255).all() and (level * lexical_search.STEP >= exact).all() and ((level - 1) * lexical_search.STEP < exact).all()


def test_clashing_names_in_a_table(spark, tmp_path):
    """The registered queries read tables with more columns."""
    docs = pa.Table.from_pylist([{"doc_id": r[0], "text": r[1], "lang": r[2], "key": "x", "mask": 1, "rank": 2} for r in ODD])
    pq.write_table(docs, tmp_path / "documents.parquet")
    pq.write_table(pa.table({"doc_id": [3, 4], "quality": [1, 0], "toxic": [0, 1], "key": ["a", "b"]}), tmp_path / "labels.parquet")
    pq.write_table(pa.table({"item_id": [1], "text": ["word five"], "doc_id": ["x"]}), tmp_path / "benchmark.parquet")
    for name in ("op11_best_fit_packing", "op12_filter_audit", "op13_lexical_search"):
        assert QUERIES[name](spark, str(tmp_path)).count() > 0
