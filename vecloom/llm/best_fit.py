"""Best-fit packing by residuals: groups pack what they have, and what stays underfull meets in ever fewer groups."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.llm.common import by_bytes, cut, table
from vecloom.llm.token_count import id_encoder

CAPACITY = 2048
#: Pieces that a group of the first round packs, about; groups that meet in one of the next round.
ITEMS, FAN = 16_384, 8
#: A bin with fewer tokens free is nearly full and leaves at once.
NEARLY = 4
SLICE_BYTES = 4 << 20
END = 0


def token_pieces(docs: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """(key, piece, start, length, ids_crc32) of every document's ids and one END, cut only where these are more than `capacity`.

    All pieces but the first are then of the full capacity. Whole texts are encoded; a null or empty text has one piece, END
    alone. ids_crc32 is of the piece's ids as little-endian unsigned 32-bit numbers. Repeated rows give repeated
    rows, an empty table an empty one; null keys stay; other columns are not read.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    fields = ("key", "piece", "start", "length", "ids_crc32")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = id_encoder(tokenizer)
        for batch in batches:
            for part in by_bytes(batch, "text", SLICE_BYTES):
                owner, found = [], []
                for i, t in enumerate(part.column("text").to_pylist()):
                    ids = np.append(encode(t) if t else np.empty(0, np.uint32), np.uint32(END)).astype("<u4")
                    ends = range(len(ids) - capacity * ((len(ids) - 1) // capacity), len(ids) + 1, capacity)
                    found += [(n, max(0, end - capacity), end - max(0, end - capacity), zlib.crc32(ids[max(0, end - capacity) : end].tobytes())) for n, end in enumerate(ends)]
                    owner += [i] * len(ends)
                piece, start, length, crc = zip(*found, strict=True) if found else ((), (), (), ())
                columns = [part.column("key").take(pa.array(owner, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(c, pa.int64()) for c in (start, length, crc))]
                yield pa.RecordBatch.from_arrays(columns, names=fields)

    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, piece int, start long, length long, ids_crc32 long").withColumnRenamed("key", key)


def best_fit(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each item: the longest first, each into the fullest bin that has room for it, or a new one.

    Items of one length are taken in the order given. Bins lie by the room they have, whose numbers are the bits of one whole number.
    """
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms, bins, out = 0, 0, np.empty(len(lengths), np.int64)
    order = np.argsort(-lengths, kind="stable")
    for i, length in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fits = open_rooms >> length
        if fits:
            had = length + (fits & -fits).bit_length() - 1
            own = room[had].pop()
            if not room[had]:
                open_rooms ^= 1 << had
        else:
            had, own, bins = capacity, bins, bins + 1
        out[i] = own
        if had > length:
            room[had - length].append(own)
            open_rooms |= 1 << (had - length)
    return out


def _pack_group(capacity: int, held: int, last: bool):
    """For a group's items: its bins, each with its items' members, and whether it leaves.

    Bins that leave are those nearly full and, of bins equally full, all beyond `held`; of the last group all. Otherwise a bin that is
    at most half full, of which there is one at most, is taken apart: its members are items again.
    """

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks().sort_by([("length", "descending"), ("sequence_id", "ascending")])
        at, own = group.column("group")[0].as_py(), best_fit(group.column("length").to_numpy(), capacity)
        order = np.argsort(own, kind="stable")
        members = group.column("members").combine_chunks().take(pa.array(order))
        ends = np.concatenate([[0], np.cumsum(members.value_lengths().to_numpy())])
        flat, cuts = members.flatten(), np.append(ends[np.flatnonzero(np.diff(own[order], prepend=-1))], ends[-1])
        lengths = flat.field("length").to_numpy()
        small = np.flatnonzero(np.add.reduceat(lengths, cuts[:-1]) <= capacity // 2)
        if len(small) and not last:
            cuts = np.unique(np.concatenate([cuts, *(np.arange(cuts[b], cuts[b + 1]) for b in small)]))
        fill, before = np.add.reduceat(lengths, cuts[:-1]), np.cumsum(lengths) - lengths
        by_fill = np.argsort(fill, kind="stable")
        place = np.empty(len(fill), np.int64)
        place[by_fill] = np.arange(len(fill)) - np.searchsorted(fill[by_fill], fill[by_fill])
        leaves = (capacity - fill < NEARLY) | ((place >= held) & (fill > capacity // 2)) | last
        lists = lambda values: pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), values)
        return pa.table({
            "group": pa.array(np.full(len(fill), at, np.int64)), "sequence_id": flat.field("number").take(pa.array(cuts[:-1])), "length": pa.array(fill), "leaves": pa.array(leaves),
            "offsets": lists(pa.array(before - np.repeat(before[cuts[:-1]], np.diff(cuts)))), "members": lists(flat),
        })

    return run


def pack_pieces(pieces: DataFrame, key: str = "doc_id", capacity: int = CAPACITY, items: int = ITEMS, fan: int = FAN) -> DataFrame:
    """The pieces with sequence_id and offset, packed into few sequences of at most `capacity`.

    Pieces of the full capacity are sequences of their own. The others are dealt by number, so a key or length that very many
    have is dealt like any other, to groups of about `items`, each of which packs by best fit. Nearly full bins leave; underfull
    ones are the items of the next round, where `fan` groups meet in one, until there is one group. Two bins over half full never
    fit together, and a group has one at most that isn't, whose members are items again: these few are all that can fill other bins. So of
    equally full bins `fan` times the rounds go on and the rest leave, and no group grows beyond a bound, however many bins there are.
    Lengths are 1 to `capacity`, else it is an error; null keys are packed like others, repeated rows one by one; an empty table
    gives an empty one.
    """
    fields = [c for c in pieces.columns if c != key]
    checked = F.coalesce(F.assert_true(F.col("length").between(1, capacity), F.lit(f"lengths are from 1 to {capacity}")).cast("long"), "length")
    rows = cut(pieces.withColumnRenamed(key, "key").withColumn("length", checked).withColumn("number", F.nullif(F.monotonically_increasing_id(), F.lit(-1))))
    place = [F.col("key").alias(key), *fields]
    done = [rows.where(F.col("length") == capacity).select(*place, F.col("number").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    rest = rows.where(F.col("length") < capacity)
    groups = max(1, -(-rest.count() // items))
    rounds, left = 1, groups
    while left > 1:
        rounds, left = rounds + 1, -(-left // fan)
    number = F.col("number")
    bins = rest.select(F.pmod(F.xxhash64("number"), F.lit(groups)).alias("group"), number.alias("sequence_id"), "length", F.array(F.struct("key", *fields, "number")).alias("members"))
    for turn in range(rounds):
        kind = f"group long, sequence_id long, length long, leaves boolean, offsets array<long>, members {bins.schema['members'].dataType.simpleString()}"
        packed = cut(bins.groupBy("group").applyInArrow(_pack_group(capacity, fan * rounds, turn == rounds - 1), kind))
        spread = packed.where("leaves").select("sequence_id", F.explode(F.arrays_zip("members", "offsets")).alias("m"))
        done.append(spread.select(F.col("m.members.key").alias(key), *(F.col(f"m.members.{c}").alias(c) for c in fields), "sequence_id", F.col("m.offsets").alias("offset")))
        bins = packed.where("NOT leaves").select(F.floor(F.col("group") / fan).cast("long").alias("group"), "sequence_id", "length", "members")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def op11_best_fit_packing(spark, sf_dir):
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece of every document; see token_pieces and pack_pieces for all cases."""
    return pack_pieces(token_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))
