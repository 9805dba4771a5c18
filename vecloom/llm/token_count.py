"""Token counts by batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

import base64
import json
import os
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecloom.llm.common import by_bytes, columns, free_names, others, table

#: Between a letter and a space that a letter follows, byte-level patterns start a new piece, so both sides can be encoded
#: apart where no added string has a space or a letter at its ends; _counter checks that.
BOUNDARY = regex.compile(r"(?<=\p{L}) (?=\p{L})")
#: Runs of white space that the rank library's matcher has no stack for, if they are a million long.
LONG_SPACE = regex.compile(r"\p{White_Space}{65536,}")


def safe_pieces(text: str, most: int) -> list[str]:
    """The text cut at safe boundaries, each piece at least `most` characters but for the last.

    A stretch without a safe boundary stays whole.
    """
    pieces, start = [], 0
    while len(text) - start > most and (found := BOUNDARY.search(text, start + most)):
        pieces.append(text[start : found.start()])
        start = found.start()
    return [*pieces, text[start:]]


def _splits(tokenizer) -> bool:
    """Is the tokenizer one whose texts may be cut at a boundary: byte-level by the usual pattern, texts as they are, added strings off boundaries?"""
    how = json.loads(tokenizer.pre_tokenizer.__getstate__()) if tokenizer.pre_tokenizer else {}
    usual = how.get("type") == "ByteLevel" and how.get("use_regex", True) and not how.get("add_prefix_space", True) and tokenizer.normalizer is None
    return usual and not any(regex.search(r"\s|^\p{L}|\p{L}$", t.content) or t.lstrip or t.rstrip for t in tokenizer.get_added_tokens_decoder().values())


def encode_ranks(encoding, text: str) -> np.ndarray:
    """The text's ids by a tiktoken encoding with the usual pattern, strings of its special tokens as these.

    A run of white space is one match up to its last character, and the rest begins anew there, so runs for
    which the library's matcher has no stack are encoded apart.
    """
    try:
        return encoding.encode_to_numpy(text, allowed_special="all")
    except ValueError:
        parts, start = [], 0
        for run in LONG_SPACE.finditer(text):
            end = run.end() - (run.end() < len(text))
            parts += [encoding.encode_to_numpy(text[start : run.start()], allowed_special="all"), np.array(encoding._encode_single_piece(text[run.start() : end]), np.uint32)]
            start = end
        if not parts:
            raise
        return np.concatenate([*parts, encoding.encode_to_numpy(text[start:], allowed_special="all")])


def _bytes_of_characters() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the others in order from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=4)
def id_encoder(path: str) -> Callable[[str], np.ndarray]:
    """A function from a text to its ids, without begin or end, as the tokenizers library gives them for a .json file.

    A plain byte-level BPE, whose merges stand in the order of their ids and lead to each of its tokens, is encoded by tiktoken, which
    gives the same ids in a fifth of the time; any other by tokenizers itself.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    with open(path) as file:
        model = json.load(file)["model"]
    own, added = _bytes_of_characters(), tokenizer.get_added_tokens_decoder()
    plain = _splits(tokenizer) and model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    plain = plain and not any(t.single_word or t.normalized for t in added.values())
    vocabulary = {t: i for t, i in model["vocab"].items() if i not in added}
    if plain and all(c in own for t in vocabulary for c in t) and all(len(tokenizer.model.tokenize(t)) == 1 for t in vocabulary):
        merged = [vocabulary.get("".join(m if isinstance(m, list) else m.split(" ")), -1) for m in model["merges"]]
        if merged == sorted(set(merged)) and (not merged or merged[0] >= 256):
            import tiktoken

            ranks = {bytes(own[c] for c in t): i for t, i in vocabulary.items()}
            encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={t.content: i for i, t in added.items()})
            return lambda text: encode_ranks(encoding, text)
    return lambda text: np.array(tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)


def _counter(path: str, pattern: str):
    """A function from a list of texts to their token counts, for a .json, .model or .tiktoken file, and whether texts may be cut at a boundary."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)], False
    if path.endswith(".tiktoken"):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [len(encode_ranks(encoding, t)) for t in texts], pattern == public_tokenizers.PATTERN
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda texts: [len(e) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)], _splits(tokenizer)


def count_tokens(
    docs: DataFrame,
    tokenizer: str,
    text: str = "text",
    keep: Sequence[str] = ("doc_id",),
    limit: int = 512,
    batch_bytes: int = 1 << 20,
    piece_chars: int = 1 << 16,
    pattern: str = public_tokenizers.PATTERN,
) -> DataFrame:
    """keep + n_bytes, n_tokens, over_limit for every row; `pattern` cuts words for a .tiktoken file, which has none of its own.

    Batches hold about `batch_bytes` of text whatever the number of rows. Byte-level texts of
    over `piece_chars` are split where the parts' counts add up to the whole's; other
    tokenizers get whole texts. Null or empty text: 0 bytes, 0 tokens, not over the limit.
    Repeated rows give repeated rows; an empty table an empty one. Columns other than `keep`
    and `text` are not read; those of `keep` may have any names without dots, but one named as a result is replaced by it.
    """
    keep = others(keep, "n_bytes", "n_tokens", "over_limit")
    read = free_names(keep, "__text")[0]
    rows = docs.select(*columns(keep), F.col(text).alias(read))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, splits = _counter(tokenizer, pattern)
        for batch in batches:
            for part in by_bytes(batch, read, batch_bytes):
                owner, pieces = [], []
                for i, t in enumerate(part.column(read).to_pylist()):
                    if t:
                        own = safe_pieces(t, piece_chars) if splits and len(t) > piece_chars else [t]
                        pieces += own
                        owner += [i] * len(own)
                lengths = [0] * part.num_rows
                for i, n in zip(owner, count(pieces) if pieces else [], strict=True):
                    lengths[i] += n
                n_bytes = pc.fill_null(pc.binary_length(part.column(read)), 0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), n_bytes, pa.array(lengths, pa.int64())], names=[*keep, "n_bytes", "n_tokens"])

    return rows.mapInArrow(run, schema).withColumn("over_limit", F.col("n_tokens") > limit)


def op7_token_counts(spark, sf_dir):
    """doc_id, n_bytes, n_tokens and over_limit of every document; see count_tokens for nulls, repeats, long texts and empty tables."""
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
