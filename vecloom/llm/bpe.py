"""Byte-level BPE encoding and decoding by DuckDB recursive queries inside each partition."""

from __future__ import annotations

import base64
import tempfile
from collections.abc import Iterator, Sequence
from functools import lru_cache

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecloom.llm.common import by_bytes, columns, free_names, others, table

SLICE_BYTES = 4 << 20
SLICE_TOKENS = 1 << 20
#: Words of more bytes go by MANY, which contracts more than one pair a step.
LONG_WORD = 256
#: Steps of one recursive query, whose rows all stay in memory until it ends; longer work goes on in another.
STEPS = 64
#: Words whose ids a Python worker remembers; beyond it forgets the half that it hasn't met for longest.
REMEMBERED = 700_000

#: One pair a step and word: the leftmost of least rank.
ONE = """
SELECT s.word, s.pos, CASE WHEN s.pos = best.pair.pos THEN best.pair.rank ELSE s.tok END AS tok, s.step + 1 AS step
FROM steps s JOIN (SELECT word, min(struct_pack(rank := merged, pos := pos, after := after)) AS pair FROM pairs JOIN merges ON tok = l AND next = r GROUP BY word) best USING (word)
WHERE s.pos <> best.pair.after AND s.step < $steps"""
#: As ONE, but every pair of least rank, of overlapping ones every second, if no pair with the merged token has a
#: lower rank: then the next steps would take just these, from the left.
MANY = """
SELECT s.word, s.pos, coalesce(here.merged, s.tok) AS tok, s.step + 1 AS step
FROM steps s JOIN chosen_words USING (word) LEFT JOIN chosen here ON here.word = s.word AND here.pos = s.pos LEFT JOIN chosen gone ON gone.word = s.word AND gone.after = s.pos
WHERE gone.word IS NULL AND s.step < $steps"""


def _recursive(step: str) -> str:
    many = """,
  least AS (SELECT pairs.*, merged, clean, row_number() OVER (PARTITION BY pairs.word ORDER BY pos) AS n, nth FROM pairs JOIN merges ON tok = l AND next = r QUALIFY merged = min(merged) OVER (PARTITION BY pairs.word)),
  runs AS (SELECT *, row_number() OVER (PARTITION BY word, nth - k ORDER BY pos) AS in_run FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY pos) AS k FROM least)),
  chosen AS (SELECT word, pos, after, merged FROM runs WHERE CASE WHEN clean THEN in_run % 2 = 1 ELSE k = 1 END),
  chosen_words AS (SELECT DISTINCT word FROM chosen)""" if step is MANY else ""
    return f"""
WITH RECURSIVE steps AS (
  SELECT word, pos, tok, 0 AS step FROM start
  UNION ALL
  (WITH pairs AS (SELECT word, pos, tok, lead(tok) OVER w AS next, lead(pos) OVER w AS after, row_number() OVER w AS nth FROM steps WINDOW w AS (PARTITION BY word ORDER BY pos)){many}
  {step}))
SELECT word, pos, tok, step FROM steps QUALIFY step = max(step) OVER (PARTITION BY word) ORDER BY word, pos"""


class Vocabulary:
    """The ranks of a .tiktoken file, and a DuckDB connection that holds them as tables merges and tokens."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.split = regex.compile(pattern).findall
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.size = max(ranks.values()) + 1
        merges = [(ranks[t[:i]], ranks[t[i:]], rank) for t, rank in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        l, r, merged = np.array(merges, np.int32).T
        unclean = set(np.concatenate([l[merged < l], r[merged < r]]).tolist())
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "700MB", "temp_directory": tempfile.gettempdir()})
        given = pa.table({"l": l, "r": r, "merged": merged, "clean": [m not in unclean for m in merged.tolist()]})
        self.db.register("given", given)
        self.db.execute("CREATE TABLE merges AS SELECT * FROM given")
        self.db.unregister("given")
        given = pa.table({"tok": pa.array(ranks.values(), pa.int32()), "hex": [t.hex() for t in ranks]})
        self.db.register("given", given)
        self.db.execute("CREATE TABLE tokens AS SELECT * FROM given")
        self.db.unregister("given")
        self.ranks = ranks
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _contracted(self, step: str, word: np.ndarray, pos: np.ndarray, tok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words and tokens, in order, of which no pair can be merged any more."""
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(word):
            self.db.register("start", pa.table({"word": word, "pos": pos, "tok": tok}))
            found = self.db.execute(_recursive(step).replace("$steps", str(STEPS))).fetchnumpy()
            self.db.unregister("start")
            word, pos, tok, last = (np.asarray(found[k]) for k in ("word", "pos", "tok", "step"))
            open_ = last >= STEPS
            done.append((word[~open_], tok[~open_]))
            word, pos, tok = word[open_], pos[open_], tok[open_]
        words, toks = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(words, kind="stable")
        return words[order], toks[order]

    def learn(self, words: list[str]) -> None:
        """Puts the ids of these words, as bytes of little-endian 32-bit integers, into `known`."""
        encoded = [w.encode() for w in words]
        for step, own in ((ONE, [i for i, b in enumerate(encoded) if len(b) <= LONG_WORD]), (MANY, [i for i, b in enumerate(encoded) if len(b) > LONG_WORD])):
            if not own:
                continue
            lengths = np.array([len(encoded[i]) for i in own])
            word = np.repeat(np.arange(len(own), dtype=np.int32), lengths)
            pos = (np.arange(len(word)) - np.repeat(np.cumsum(lengths) - lengths, lengths)).astype(np.int32)
            word, tok = self._contracted(step, word, pos, self.byte[np.frombuffer(b"".join(encoded[i] for i in own), np.uint8)])
            ids, ends = tok.astype("<u4").tobytes(), (4 * np.cumsum(np.bincount(word, minlength=len(own)))).tolist()
            start = 0
            for i, end in zip(own, ends, strict=True):
                self.known[words[i]] = ids[start:end]
                start = end

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [self.split(t) for t in texts]
        if len(self.known) > REMEMBERED // 2:
            self.known, self.older = {}, self.known
        known, older, new = self.known, self.older, []
        for w in set().union(*split):
            if w not in known:
                if (ids := older.get(w)) is not None:
                    known[w] = ids
                elif (rank := self.ranks.get(w.encode())) is not None:  # a word that is a token is never taken apart
                    known[w] = rank.to_bytes(4, "little")
                else:
                    new.append(w)
        if new:
            self.learn(new)
        return [b"".join(map(known.__getitem__, words)) for words in split]

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """The bytes of each list of ids; ValueError if an id isn't in the vocabulary."""
        owners, toks = np.repeat(np.arange(len(ids), dtype=np.int32), [len(x) // 4 for x in ids]), np.frombuffer(b"".join(ids), "<u4")
        parts: list[list[bytes]] = [[] for _ in ids]
        for a in range(0, len(toks), SLICE_TOKENS):
            tok = toks[a : a + SLICE_TOKENS].astype(np.int64)
            self.db.register("given", pa.table({"doc": owners[a : a + SLICE_TOKENS], "pos": np.arange(len(tok), dtype=np.int32), "tok": tok}))
            found = self.db.execute("SELECT doc, unhex(string_agg(hex, '' ORDER BY pos)), count(*) FROM given JOIN tokens USING (tok) GROUP BY doc").fetchall()
            self.db.unregister("given")
            if sum(n for _, _, n in found) != len(tok):
                raise ValueError("an id is not in the vocabulary")
            for doc, data, _ in found:
                parts[doc].append(data)
        return [b"".join(x) for x in parts]


@lru_cache(maxsize=2)
def _vocabulary(path: str, pattern: str) -> Vocabulary:
    return Vocabulary(path, pattern)


def encode_bpe(docs: DataFrame, ranks: str, pattern: str = public_tokenizers.PATTERN, text: str = "text", keep: Sequence[str] = ("doc_id",), decoded: bool = False) -> DataFrame:
    """keep + n_tokens and ids, the latter as bytes of little-endian 32-bit integers; with `decoded`, also what decode_bpe makes of them.

    Each match of the pattern is a word, encoded apart, without special tokens. In a partition the distinct
    words of a slice of text become rows (word, position, token) of single bytes; a recursive query joins
    neighbours with the merge table and contracts a word's leftmost pair of least rank, until none is left.
    Null and empty texts have no tokens. Words of any length are encoded whole. Repeated rows give repeated
    rows, an empty table an empty one; columns other than `keep` and `text` are not read. Those of `keep` may
    have any names without dots, but one named as a result is replaced by it.
    """
    keep = others(keep, "n_tokens", "ids", *["decoded"] * decoded)
    read = free_names(keep, "__text")[0]
    rows = docs.select(*columns(keep), F.col(text).alias(read))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])
    if decoded:
        schema.add("decoded", T.BinaryType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _vocabulary(ranks, pattern)
        for batch in batches:
            for part in by_bytes(batch, read, SLICE_BYTES):
                ids = words.encode([t or "" for t in part.column(read).to_pylist()])
                made = [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
                if decoded:
                    made.append(pa.array(words.decode(ids), pa.binary()))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), *made], names=schema.names)

    return rows.mapInArrow(run, schema)


def decode_bpe(encoded: DataFrame, ranks: str, pattern: str = public_tokenizers.PATTERN, ids: str = "ids") -> DataFrame:
    """The rows with decoded, the bytes that `ids` stand for, by a join with the tokens and an aggregation in order.

    Null ids: null. No ids: no bytes. An id that isn't in the vocabulary is an error. A column `decoded` is replaced. Repeated
    rows give repeated rows, an empty table an empty one.
    """
    rows = encoded.drop("decoded") if ids != "decoded" else encoded
    schema = T.StructType([*rows.schema.fields, T.StructField("decoded", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _vocabulary(ranks, pattern)
        for batch in batches:
            for part in by_bytes(batch, ids, SLICE_BYTES):
                given = part.column(ids).to_pylist()
                decoded = [None if x is None else y for x, y in zip(given, words.decode([x or b"" for x in given]), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(decoded, pa.binary())], names=[*part.schema.names, "decoded"])

    return rows.mapInArrow(run, schema)


def op1_bpe(spark, sf_dir):
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document; see encode_bpe and decode_bpe for nulls, repeats, long texts and empty tables."""
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = encode_bpe(table(spark, sf_dir, "documents"), ranks, decoded=True)
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
