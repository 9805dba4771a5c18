"""Token operators, media columns and URL verdicts, against the libraries and by hand."""

import base64
import hashlib
import io
import os
import wave
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vecloom.llm import bpe, common, media, token_count, url_filter

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SMALL = "/root/testdata/sf0.001"
TEXTS = ["", None, " ", "a", "The cat's  hat\n\n 12,5 % ", "naïve café — 漢字かな 🙂", "x" * 3000, "ab " * 40_000, "ab" * 700, "<|endoftext|> twice<|endoftext|>", "a" * 20 + " b" * 3, "a" * 20 + " b" * 3]


def docs(spark, texts, **more):
    rows = [(i if i != 3 else None, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("n_tokens", "ids", "media", "spans", "score", "label", "bucket"):
        df = df.withColumn(name, F.lit("clash"))
    return df


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_round_trip(spark, library):
    df = docs(spark, TEXTS)
    found = bpe.decode_bpe(bpe.encode_bpe(df, RANKS, keep=["doc_id", "text"]), RANKS).collect()
    assert len(found) == len(TEXTS)
    for r in found:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert ids == library.encode_ordinary(r["text"] or "") and r["n_tokens"] == len(ids)
        assert bytes(r["decoded"]) == (r["text"] or "").encode()
    assert bpe.encode_bpe(df.limit(0), RANKS).count() == 0
    with pytest.raises(Exception, match="not in the vocabulary"):
        bpe.decode_bpe(spark.createDataFrame([(bytearray(b"\xff\xff\xff\x7f"),)], "ids binary"), RANKS).collect()
    assert bpe.decode_bpe(spark.createDataFrame([(None,)], "ids binary"), RANKS).first()["decoded"] is None


@settings(max_examples=40, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=400), max_size=4))
def test_bpe_any_text(library, texts):
    words = bpe._vocabulary(RANKS, public_tokenizers.PATTERN)
    ids = words.encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in ids] == [library.encode_ordinary(t) for t in texts]
    assert words.decode(ids) == [t.encode() for t in texts]


def test_bpe_forgets_and_goes_on(library, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 10)
    words = bpe.Vocabulary(RANKS, public_tokenizers.PATTERN)
    for t in ("one two three four five six seven eight nine ten eleven twelve " * 2, "abcdefgh" * 60 + " qqqq" * 5, "one two qqqq"):
        assert np.frombuffer(words.encode([t])[0], "<u4").tolist() == library.encode_ordinary(t)


def test_bpe_query(spark, library):
    found = {r["doc_id"]: r for r in bpe.op1_bpe(spark, SMALL).collect()}
    for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect():
        ids = library.encode_ordinary(r["text"])
        own = found[r["doc_id"]]
        assert own["n_tokens"] == len(ids) and own["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert own["decoded_sha256"] == hashlib.sha256(r["text"].encode()).hexdigest()


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model", "byte_bpe_50k.tiktoken"])
def test_token_counts(spark, name):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    path = public_tokenizers.path(name)
    if name.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        length = lambda t: len(model.encode(t))
    elif name.endswith(".tiktoken"):
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
        encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        length = lambda t: len(encoding.encode_ordinary(t))
    else:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        length = lambda t: len(tokenizer.encode(t, add_special_tokens=False).ids)
    found = token_count.count_tokens(docs(spark, TEXTS), path, keep=["doc_id", "text"], piece_chars=100).collect()
    assert len(found) == len(TEXTS)
    for r in found:
        text = r["text"] or ""
        assert (r["n_bytes"], r["n_tokens"]) == (len(text.encode()), length(text)) and r["over_limit"] == (r["n_tokens"] > 512)


def test_texts_are_cut_only_where_counts_add_up():
    from tokenizers import AddedToken, Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    assert token_count._splits(Tokenizer.from_file(path)) and not token_count._splits(Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")))
    for token in (AddedToken("two words"), AddedToken("word"), AddedToken("<x>", lstrip=True)):
        tokenizer = Tokenizer.from_file(path)
        tokenizer.add_tokens([token])
        assert not token_count._splits(tokenizer)


def test_token_count_query(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {}
    for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect():
        n = len(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids)
        want[r["doc_id"]] = (len((r["text"] or "").encode()), n, n > 512)
    found = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_count.op7_token_counts(spark, SMALL).collect()}
    assert found == want and {over for _, _, over in found.values()} == {True, False}


def test_safe_pieces():
    text = "word " * 50 + "x" * 500 + " end of it"
    pieces = token_count.safe_pieces(text, 20)
    assert "".join(pieces) == text and len(pieces) > 5 and all(len(p) >= 20 for p in pieces[:-1])
    assert token_count.safe_pieces("x" * 500, 20) == ["x" * 500]


def test_media(spark):
    stored = media.encode_media(docs(spark, TEXTS), keep=["doc_id", "text"])
    found = media.media_features(stored, keep=["doc_id", "n_bytes", "text"]).collect()
    assert len(found) == len(TEXTS)
    by_text = {}
    for r in found:
        data = (r["text"] or "").encode()
        payload = data + b"\0" * (-len(data) % 64 or (0 if data else 64))
        with wave.open(io.BytesIO(bytes(r["media"]))) as w:
            assert w.readframes(w.getnframes()) == payload
        assert (r["n_bytes"], r["payload_bytes"], r["tail_crc32"]) == (len(data), len(payload), zlib.crc32(payload[-64:]))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest()
        assert len(r["fp_time"]) == len(r["fp_code"]) and r["fp_time"] == sorted(r["fp_time"])
        assert by_text.setdefault(r["text"] or "", (r["fp_time"], r["fp_code"])) == (r["fp_time"], r["fp_code"])
    assert media.media_features(stored.limit(0)).count() == 0
    tone = bytes((128 + 100 * np.sin(2 * np.pi * 20 * np.arange(4096) / media.WINDOW)).astype(np.uint8))
    assert set(media.spectral_peaks(tone)[2:-2, 0]) == {20}
    one_block = media.spectral_peaks(tone * 3)
    media.FRAMES_AT_ONCE, usual = 7, media.FRAMES_AT_ONCE
    assert (media.spectral_peaks(tone * 3) == one_block).all()
    media.FRAMES_AT_ONCE = usual


def test_urls(spark):
    urls = {
        1: "https://A.Example.ORG/en/1x?q", 2: "http://example.org/es/", 3: "http://x.com/fr/a#b", 4: "http://com/de/", 5: "http://notexample.org", 6: None, 7: "no scheme", 8: "x://h?p://z/", 9: "http://b.com/x",
        10: "http://bad.net/1", 11: "http://bad.net/2", 12: "http://example.org/en/1", 13: "ftp://www.site.co.uk:80/a/b?c#d", 14: "http://" + "a." * 5000 + "com/fr/" + "x" * 5000,
    }
    pages = spark.createDataFrame([*urls.items(), (None, "http://b.com/"), (1, urls[1])], "page_id long, url string").withColumn("verdict", F.lit("clash"))
    outcomes = spark.createDataFrame([(10, 1), (11, 1), (11, 0), (9, 0), (None, 1), (2, 0)] + [(i, 1) for i in range(1000, 1040)], "page_id long, outcome int")
    bad = spark.createDataFrame([(i, f"http://bad.net/{i}") for i in range(1000, 1040)], "page_id long, url string").withColumn("verdict", F.lit("clash"))
    found = url_filter.judge_urls(pages.unionByName(bad), outcomes).collect()
    assert len(found) == len(urls) + 2 + 40
    own = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in found}
    assert own[1] == ("a.example.org", "/en/1x", "example.org/en/1", "block")
    assert own[2] == ("example.org", "/es/", "example.org/es/", "block")
    assert own[3] == ("x.com", "/fr/a", "com/fr/", "allow")
    assert own[4] == ("com", "/de/", "com/de/", "block")
    assert own[5][:3] == ("notexample.org", "", None)
    assert own[6][:3] == own[7][:3] == ("", "", None)
    assert own[8][:3] == ("h", "", None)
    assert own[10] == ("bad.net", "/1", None, "block") and own[9][3] == "allow"
    assert own[13][:2] == ("www.site.co.uk:80", "/a/b")
    assert own[14][2] == "com/fr/"
    domain = spark.createDataFrame([("www.site.co.uk:80",), ("a.b.net",), ("",)], "h string").select(*reversed(url_filter.suffix_and_domain(F.col("h")))).collect()
    assert [tuple(r) for r in domain] == [("site.co.uk", "co.uk"), ("b.net", "net"), ("", "")]
    assert url_filter.judge_urls(pages.limit(0), outcomes).count() == 0
    assert url_filter.judge_urls(pages, outcomes.limit(0)).count() == pages.count()
    assert {r["rule"] for r in url_filter.judge_urls(pages, outcomes, rules=()).collect()} == {None}


def test_suffix_rules(spark):
    rules = ["co.uk", "*.ck", "!www.ck", "k12.or.us", "or.us"]
    want = {
        "a.b.example.co.uk": ("co.uk", "example.co.uk"),
        "co.uk": ("co.uk", "co.uk"),
        "shop.some.ck:80": ("some.ck", "shop.some.ck"),
        "a.www.ck": ("ck", "www.ck"),
        "www.ck": ("ck", "www.ck"),
        "ck": ("ck", "ck"),
        "x.school.k12.or.us": ("k12.or.us", "school.k12.or.us"),
        "x.city.or.us": ("or.us", "city.or.us"),
        "a.b.com": ("com", "b.com"),
        "localhost": ("localhost", "localhost"),
        "10.0.0.1:8080": ("10.0.0.1", "10.0.0.1"),
        "[::1]:80": ("[::1]", "[::1]"),
        "": ("", ""),
    }
    suffix, domain = url_filter.suffix_and_domain(F.col("host"), rules)
    found = spark.createDataFrame([(h,) for h in want], "host string").select("host", suffix.alias("s"), domain.alias("d")).collect()
    assert {r["host"]: (r["s"], r["d"]) for r in found} == want


def test_hot_hosts_keep_their_rows(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_KEYS", 3)
    pages = spark.createDataFrame([(i, "http://hot.net/x" if i % 3 else f"http://h{i}.net/") for i in range(60)] + [(None, None), (60, "no url")], "page_id long, url string")
    outcomes = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(60)], "page_id long, outcome int")
    found = url_filter.judge_urls(pages, outcomes).collect()
    assert len(found) == 62 and {r["verdict"] for r in found if r["host"] == "hot.net"} == {"block"}
    assert url_filter.judge_urls(pages.limit(0), outcomes).count() == 0
