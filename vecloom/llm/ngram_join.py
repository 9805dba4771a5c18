"""Similarity join on word 5-grams: rare-first prefixes with length, positional and suffix filters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecloom.llm.common import by_bytes, columns, cut, free_names, join_counted, release, shuffle_partitions, table
from vecloom.llm.components import components

N = 5
#: Text of a chunk, whose documents a task orders at once, and of a bucket, whose shingles a task counts at once.
CHUNK_BYTES = 8 << 20
BUCKET_BYTES = 16 << 20
#: Parts of the suffix filter.
PARTS = 32
REMEMBERED = 300_000
#: Buckets at least, a power of two.
LEAST_BUCKETS = 256
#: A shingle of so many documents of a chunk goes to its bucket once, with their number; its documents stay with the chunk.
GROUPED = 3
NO_DOC = 0xFFFF
MIX = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """64-bit hashes of words; forgets them all when they are many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def shingles(text: str | None, hashes: WordHashes) -> np.ndarray:
    """Ascending distinct 64-bit hashes of the text's runs of N words; of the whole run if it has fewer; none without words.

    Words are stretches of other than ASCII white space, A-Z lower-cased.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    size = min(N, len(w))
    h = np.full(len(w) - size + 1, size, np.uint64)
    for i in range(size):
        h = h * MIX + w[i : len(w) - size + 1 + i]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return np.unique(h)


def _packed(names: np.ndarray) -> bytes:
    """Ascending 64-bit names as differences of one width, which the first byte tells."""
    steps = np.diff(names, prepend=np.uint64(0))
    width = max(1, (int(steps.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8, offset=1).reshape(-1, data[0])
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, : data[0]] = raw
    return np.cumsum(wide.view("<u8").ravel(), dtype=np.uint64)


def _scatter(docs: DataFrame, bits: int) -> DataFrame:
    """(bucket, chunk, docs, prints, many): for each chunk a row with its documents and, a bucket each, its shingles.

    A bucket has the shingles of the same first `bits`; prints are their other bits, ascending, docs the numbers of their
    documents in the chunk. A shingle of GROUPED documents or more is there once, as NO_DOC, and its number of documents in
    `many`; these documents are in the chunk's own row, so a shingle that all documents have brings a chunk's bucket one entry. Chunks are
    named by content and place, so a repeated task names them alike, and a task that met other rows doesn't.
    """
    rest = np.uint64(64 - bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, place = WordHashes(), 0
        for batch in batches:
            for part in by_bytes(batch, "text", CHUNK_BYTES):
                sets = [shingles(t, hashes) for t in part.column("text").to_pylist()]
                sizes = np.array([len(s) for s in sets])
                nodes = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                about = pa.ipc.new_stream(sink := pa.BufferOutputStream(), META)
                about.write_batch(pa.record_batch([part.column("doc_id"), part.column("digest"), pa.array(sizes, pa.int32()), pa.array(nodes, pa.binary())], schema=META))
                about.close()
                meta = sink.getvalue().to_pybytes()
                chunk = xxhash.xxh3_64_intdigest(meta, seed=(TaskContext.get().partitionId() << 20) + place) >> 1
                place += 1
                every, owner = np.concatenate(sets), np.repeat(np.arange(len(sets), dtype=np.uint16), sizes)
                order = np.argsort(every, kind="stable")
                every, owner = every[order], owner[order]
                first = np.flatnonzero(np.diff(every, prepend=~every[:1]) != 0)
                runs = np.diff(np.append(first, len(every)))
                together = np.repeat(runs >= GROUPED, runs)
                home = owner[together].tobytes()
                owner[together] = NO_DOC
                listed = ~together
                listed[first] = True
                names, owner, many = every[listed], owner[listed], np.repeat(runs, np.where(runs >= GROUPED, 1, runs)).astype(np.uint32)
                bucket, names = (names >> rest).astype(np.int64), names & np.uint64((1 << int(rest)) - 1)
                begins = np.flatnonzero(np.diff(bucket, prepend=-1))
                cells = list(zip(begins.tolist(), [*begins[1:].tolist(), len(bucket)][: len(begins)], strict=True))  # none without shingles
                yield pa.record_batch(
                    [
                        pa.array([-1 - chunk % (1 << 30), *bucket[begins].tolist()], pa.int32()),
                        pa.array([chunk] * (len(cells) + 1), pa.int64()),
                        pa.array([home, *(owner[a:b].tobytes() for a, b in cells)], pa.binary()),
                        pa.array([meta, *(_packed(names[a:b]) for a, b in cells)], pa.binary()),
                        pa.array([runs[runs >= GROUPED].astype(np.uint32).tobytes(), *(many[a:b][owner[a:b] == NO_DOC].tobytes() for a, b in cells)], pa.binary()),
                    ],
                    names=["bucket", "chunk", "docs", "prints", "many"],
                )

    return docs.mapInArrow(run, "bucket int, chunk long, docs binary, prints binary, many binary")


META = pa.schema([("doc_id", pa.int64()), ("digest", pa.int64()), ("n", pa.int32()), ("node", pa.binary())])


def _count(group: pa.Table) -> pa.Table:
    """For a bucket: of each chunk the shingles that other documents have too, and in how many documents they are, up to 65,535."""
    if group.column("bucket")[0].as_py() < 0:
        return group.append_column("counts", pa.nulls(group.num_rows, pa.binary()))
    docs, names = [np.frombuffer(d, np.uint16) for d in group.column("docs").to_pylist()], [_unpacked(p) for p in group.column("prints").to_pylist()]
    owner, keys = np.concatenate(docs), np.concatenate(names)
    weights = np.ones(len(keys), np.int64)
    weights[owner == NO_DOC] = np.frombuffer(b"".join(group.column("many").to_pylist()), np.uint32)
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    counts = np.empty(len(keys), np.uint16)
    counts[order] = np.repeat(np.minimum(np.add.reduceat(weights[order], first), 65_535), np.diff(np.append(first, len(keys))))
    kept, start = {"docs": [], "prints": [], "counts": []}, 0
    for own, listed in zip(docs, names, strict=True):
        found = counts[start : start + len(own)]
        shared = found > 1
        kept["docs"].append(own[shared].tobytes())
        kept["prints"].append(_packed(listed[shared]))
        kept["counts"].append(found[shared].tobytes())
        start += len(own)
    out = pa.table({"bucket": group.column("bucket"), "chunk": group.column("chunk"), "many": pa.nulls(group.num_rows, pa.binary())} | {k: pa.array(v, pa.binary()) for k, v in kept.items()})
    return out.filter(pc.greater(pc.binary_length(out["docs"]), 0))


def _order(bits: int):
    """For a chunk: its documents, with their shared shingles rarest first if their prefix reaches these."""

    def run(group: pa.Table) -> pa.Table:
        rows = sorted(group.select(["bucket", "docs", "prints", "many", "counts"]).to_pylist(), key=lambda r: r["bucket"])
        if not rows or rows[0]["bucket"] >= 0:
            raise RuntimeError("a chunk was read anew with other rows; the input changed during the run")
        about, cells = pa.ipc.open_stream(rows[0]["prints"]).read_all(), rows[1:]
        joined = lambda parts, t: np.concatenate([*parts, np.empty(0, t)]).astype(t)
        doc = joined([np.frombuffer(r["docs"], np.uint16) for r in cells], np.uint16)
        count = joined([np.frombuffer(r["counts"], np.uint16) for r in cells], np.uint16)
        name = joined([_unpacked(r["prints"]) + np.uint64(r["bucket"] << (64 - bits)) for r in cells], np.uint64)
        together, sizes = doc == NO_DOC, np.frombuffer(rows[0]["many"], np.uint32)
        doc, name, count = (np.concatenate(p) for p in ((doc[~together], np.frombuffer(rows[0]["docs"], np.uint16)), (name[~together], np.repeat(name[together], sizes)), (count[~together], np.repeat(count[together], sizes))))
        n = about["n"].to_numpy()
        order = np.lexsort((name, count, doc))
        doc, name = doc[order], name[order]
        shared = np.bincount(doc, minlength=len(n))
        wanted = (n > 0) & (n - shared < n - (4 * n + 4) // 5 + 1)  # the unshared come first; do they leave room in the prefix?
        kept = wanted[doc] if len(doc) else np.empty(0, bool)
        offsets = np.concatenate([[0], np.cumsum(np.where(wanted, shared, 0))]).astype(np.int32)
        parts = np.zeros((len(n), PARTS), np.int32)
        np.add.at(parts, (doc[kept], (name[kept] >> np.uint64(20)) % np.uint64(PARTS)), 1)
        grams = pa.ListArray.from_arrays(pa.array(offsets), pa.array(name[kept].view(np.int64)))
        return pa.table({
            "doc_id": about["doc_id"], "digest": about["digest"], "n": about["n"], "node": about["node"],
            "grams": pc.if_else(pa.array(~wanted), pa.scalar(None, grams.type), grams),
            "parts": pa.array([p.tolist() if w else None for p, w in zip(parts, wanted, strict=True)], pa.list_(pa.int32())),
        })

    return run


def documents_in_order(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, digest, n, node, grams, parts) for every row: hash of the text, number of shingles, name of the set, shared shingles rarest first.

    node is null without words. grams and parts, the sizes of the suffix filter's parts, are null where the prefix has
    only shingles that no other row has, so no other set can be similar. All shingles are counted, in how many rows
    they are, by buckets of their hashes; their names are whole 64-bit hashes.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("digest"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = (max(LEAST_BUCKETS, 4 * shuffle_partitions(docs.sparkSession), size // BUCKET_BYTES + 1) - 1).bit_length()
    counted = _scatter(rows, bits).groupBy("bucket").applyInArrow(_count, "bucket int, chunk long, many binary, docs binary, prints binary, counts binary")
    return counted.groupBy("chunk").applyInArrow(_order(bits), "doc_id long, digest long, n int, node binary, grams array<long>, parts array<int>")


#: Keys up to which those to drop are broadcast, at 16 bytes each.
BROADCAST_ROWS = 1_000_000
#: Pivots that each list of a prefix shingle is compared with in a round, and rounds.
PIVOTS, STAR_ROUNDS = 8, 2
#: No such round is needed once the lists' pairs of different classes are this many a posting.
PAIRS_A_ROW = 2
#: Lists with more such pairs a posting are compared by first shared shingles.
DENSE = 8


def _similar(overlap: Column, n: Column, m: Column) -> Column:
    """100 * intersection >= 80 * union, for an overlap of sets of n and m shingles."""
    return 9 * overlap >= 4 * (n + m)


def _prefix() -> Column:
    """The shared shingles of a set's prefix, rarest first."""
    return F.slice("grams", F.lit(1), F.greatest(F.lit(0), F.expr("n - (4 * n + 4) DIV 5 + 1").cast("int") - (F.col("n") - F.size("grams"))))


def _postings(sets: DataFrame) -> DataFrame:
    """(gram, node, n, unshared, place) of the shared shingles in each set's prefix; place counts all its shingles, rarest first."""
    unshared = F.col("n") - F.size("grams")
    listed = sets.select("node", "n", unshared.alias("unshared"), F.posexplode(_prefix()).alias("i", "gram"))
    return listed.select("gram", "node", "n", "unshared", (F.col("unshared") + F.col("i")).alias("place"))


def _candidates(left: DataFrame, postings: DataFrame) -> DataFrame:
    """(a, b) of sets of different classes that share a listed shingle and pass the length and positional filters.

    At places p and q of a shared shingle the overlap is at most the shared shingles before on either side, and
    those from there on.
    """
    x = left.select("gram", *(F.col(c).alias(f"a_{c}") for c in ("node", "n", "unshared", "place", "class")))
    before = F.least(F.col("a_place") - F.col("a_unshared"), F.col("place") - F.col("unshared"))
    after = F.least(F.col("a_n") - F.col("a_place"), F.col("n") - F.col("place"))
    near = (F.col("class") != F.col("a_class")) & (4 * F.greatest("n", "a_n") <= 5 * F.least("n", "a_n")) & _similar(before + after, F.col("n"), F.col("a_n"))
    return postings.join(x, "gram").where(near).select(F.least("node", "a_node").alias("a"), F.greatest("node", "a_node").alias("b")).distinct()


def _smaller_parts(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x)


def _first_shared(postings: DataFrame, sets: DataFrame) -> DataFrame:
    """As _candidates, of all pairs in dense lists, but only where the list's shingle is the first that both have.

    Then no shingle before can be in the overlap, so the positional filter is at its strictest; the suffix filter follows
    inside the join, and few pairs leave it.
    """
    rows = postings.join(sets.select("node", "parts", _prefix().alias("prefix")), "node").withColumn("before", F.slice("prefix", F.lit(1), F.col("place") - F.col("unshared"))).drop("prefix")
    x = rows.select("gram", *(F.col(c).alias(f"a_{c}") for c in ("node", "n", "place", "class", "before", "parts")))
    near = (F.col("node") < F.col("a_node")) & (F.col("class") != F.col("a_class")) & (4 * F.greatest("n", "a_n") <= 5 * F.least("n", "a_n"))
    near &= _similar(F.least(F.col("a_n") - F.col("a_place"), F.col("n") - F.col("place")), F.col("n"), F.col("a_n")) & ~F.arrays_overlap("before", "a_before")
    near &= _similar(_smaller_parts("parts", "a_parts"), F.col("n"), F.col("a_n"))
    return rows.join(x, "gram").where(near).select(F.col("node").alias("a"), F.col("a_node").alias("b")).distinct()


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose sets are similar, each verified once, if the suffix filter lets it through.

    Shingles that no other row has can't be in the intersection, so the shared ones tell its size. Of each part of
    these, by hash, the smaller side bounds the overlap.
    """
    side = lambda name: sets.select(F.col("node").alias(name), *(F.col(c).alias(f"{c}_{name}") for c in ("n", "parts", "grams")))
    overlap = F.when(_similar(_smaller_parts("parts_a", "parts_b"), F.col("n_a"), F.col("n_b")), F.size(F.array_intersect("grams_a", "grams_b"))).otherwise(0)
    return pairs.join(side("a"), "a").join(side("b"), "b").where(_similar(overlap, F.col("n_a"), F.col("n_b"))).select("a", "b")


def link_classes(sets: DataFrame) -> DataFrame | None:
    """(node, root) of the sets that are linked with others; None if none are.

    In each of at most STAR_ROUNDS rounds every prefix shingle's list of sets is compared with up to PIVOTS of its members,
    which links most of a large group without its pairs. Then the pairs of sets of different classes that pass the filters are
    verified, all of them, so no class stays apart that a link joins.
    """
    links = None
    for turn in range(STAR_ROUNDS + 1):
        postings = _postings(sets)
        if links is None:
            postings = postings.withColumn("class", F.col("node"))
        else:
            classes = components(links, rounds=2)
            postings = postings.join(classes, "node", "left").withColumn("class", F.coalesce("root", "node")).drop("root")
        sizes = postings.groupBy("gram", "class").agg(F.count("*").alias("k")).groupBy("gram").agg(F.sum("k").alias("m"), F.sum(F.col("k") * F.col("k")).alias("q"), F.count("*").alias("classes"))
        sizes = cut(sizes.where("classes > 1").select("gram", "m", ((F.col("m") * F.col("m") - F.col("q")) / 2).alias("pairs")))
        left = sizes.agg(F.sum("m").alias("rows"), F.sum("pairs").alias("pairs")).first()
        if not left["rows"]:
            break
        last = left["pairs"] <= PAIRS_A_ROW * left["rows"] or turn == STAR_ROUNDS
        postings = cut(postings.join(sizes.select("gram", (F.col("pairs") > DENSE * F.col("m")).alias("dense")), "gram"))
        if last:
            light = postings.where("NOT dense")
            pairs = _candidates(light, light).unionByName(_first_shared(postings.where("dense"), sets)).distinct()
        else:
            slot = F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(PIVOTS))
            pivot = F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("order"), "node", "n", "unshared", "place", "class"))
            pivots = postings.groupBy("gram", slot.alias("slot")).agg(pivot.alias("pivot")).select("gram", *(f"pivot.{c}" for c in ("node", "n", "unshared", "place", "class")))
            pairs = _candidates(pivots, postings)
        found = cut(_verified(cut(pairs), sets))
        links = found if links is None else links.unionByName(found)
        release(sets.sparkSession)
        if last:
            break
    return None if links is None else cut(components(links))


def _judged(docs: DataFrame, text: str, key: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, digest, n, node) of every row, and (node, rows, least, first) of every set: how many rows have it, the smallest id
    that its links reach, null if there is none, and the first row of its group, (no_id, doc_id, digest)."""
    found = cut(documents_in_order(docs, text, key))
    release(docs.sparkSession)
    sets = cut(found.where("grams IS NOT NULL").groupBy("node").agg(*(F.any_value(c).alias(c) for c in ("n", "grams", "parts"))))
    release(docs.sparkSession)
    classes = link_classes(sets)
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "digest")
    nodes = found.where("node IS NOT NULL").groupBy("node").agg(F.count("*").alias("rows"), F.min("doc_id").alias("least"), F.min(first).alias("first"))
    if classes is not None:
        named = cut(nodes.join(classes, "node", "left"))
        linked = named.where("root IS NOT NULL")
        roots = linked.groupBy("root").agg(F.count("*").alias("__sets"), F.min("least").alias("__least"), F.min("first").alias("__first"))
        joined = join_counted(linked, roots, "root", "__sets").select("node", "rows", F.col("__least").alias("least"), F.col("__first").alias("first"))
        nodes = named.where("root IS NULL").drop("root").unionByName(joined)
    return found.select("doc_id", "digest", "n", "node"), cut(nodes)


def similar_documents(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_shingles, component_id) for every row: the size of its set, and the smallest key that links reach from it.

    A document's set has its distinct runs of N words, or its whole run if that is shorter; two link when
    100 * intersection >= 80 * union. Null, empty and wordless texts have no shingles and link with nothing; their
    component_id is their own key. Equal sets, copies among them, are compared as one, and a text of any length takes part
    whole. Shingles are told apart by 64-bit hashes, so all this holds up to their collisions. Keys are whole numbers; others fail. A row with a null key takes part; its component_id is the smallest key that isn't
    null. Shingles in equally many documents are ordered by their hashes, on which no result depends. Repeated rows give repeated
    rows, an empty table an empty one; other columns are not read.
    """
    found, nodes = _judged(docs, text, key)
    joined = join_counted(found, nodes.select("node", "rows", "least"), "node", "rows", how="left")
    return joined.select(F.col("doc_id").alias(key), F.col("n").cast("long").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))


def drop_similar(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The documents less those that links join to an earlier one: of each group the first stays, by key, null last, then by the text's hash.

    Rows are told apart by key and text; of rows alike in both, one stays. Rows without words link with nothing and all stay.
    The rows to drop are broadcast if they are at most BROADCAST_ROWS, else joined by a shuffle. An empty table stays empty, and
    other columns, whatever their names, are handed on.
    """
    found, nodes = _judged(docs, text, key)
    rows = found.where("node IS NOT NULL").groupBy("doc_id", "digest", "node").agg(F.count("*").alias("copies"))
    own = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "digest")
    judged = cut(join_counted(rows, nodes.select("node", "rows", "first"), "node", "rows").select("doc_id", "digest", (own == F.col("first")).alias("stays"), "copies").where("NOT stays OR copies > 1"))
    own_id, own_digest, listed_id, listed_digest = free_names(docs.columns, "__doc_id", "__digest", "__listed_id", "__listed_digest")
    marked = docs.withColumns({own_id: F.col(key).cast("long"), own_digest: F.xxhash64(text)})
    same = F.col(own_id).eqNullSafe(F.col(listed_id)) & (F.col(own_digest) == F.col(listed_digest))

    def picked(which: DataFrame, how: str) -> DataFrame:
        listed = which.select(F.col("doc_id").alias(listed_id), F.col("digest").alias(listed_digest))
        return marked.join(F.broadcast(listed) if listed.count() <= BROADCAST_ROWS else listed, same, how)

    twice = judged.where("stays")
    if not twice.limit(1).count():
        return picked(judged, "left_anti").select(*columns(docs.columns))
    return picked(judged, "left_anti").unionByName(picked(twice, "left_semi").dropDuplicates([own_id, own_digest])).select(*columns(docs.columns))


def op6_ngram_jaccard(spark, sf_dir):
    """doc_id, n_shingles and component_id of every document; see similar_documents for nulls, short and long texts, repeats and empty tables."""
    return similar_documents(table(spark, sf_dir, "documents"))


ORACLE_SQL = """
WITH RECURSIVE texts AS (SELECT doc_id, list_filter(string_split(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), 'abcdefghijklmnopqrstuvwxyz     '), ' '), lambda w: w <> '') AS w FROM documents),
words AS (SELECT doc_id, len(w) AS many, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM texts),
runs AS (SELECT doc_id, many, i, concat_ws(' ', word, lead(word, 1) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o, lead(word, 4) OVER o) AS gram FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
grams AS (SELECT DISTINCT doc_id, gram FROM runs WHERE i <= greatest(1, many - 4)),
sizes AS (SELECT doc_id, count(gram) AS n FROM documents LEFT JOIN grams USING (doc_id) GROUP BY doc_id),
links AS (SELECT x.doc_id AS a, y.doc_id AS b FROM grams x JOIN grams y ON x.gram = y.gram AND x.doc_id <> y.doc_id JOIN sizes n ON n.doc_id = x.doc_id JOIN sizes m ON m.doc_id = y.doc_id GROUP BY x.doc_id, y.doc_id, n.n, m.n HAVING 100 * count(*) >= 80 * (n.n + m.n - count(*))),
reached AS (SELECT doc_id, doc_id AS other FROM sizes UNION SELECT r.doc_id, b FROM reached r JOIN links ON a = other)
SELECT doc_id, n AS n_shingles, least AS component_id FROM sizes JOIN (SELECT doc_id, min(other) AS least FROM reached GROUP BY doc_id) USING (doc_id)
"""
