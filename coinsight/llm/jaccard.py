"""Jaccard join of word-shingle sets with token-combination prefixes.

Shingles are counted over all documents, and each set is put in one global
order, rare before frequent. Two sets of similarity 0.75 share a token of their
first floor(n / 4) + 1 ones. A rare token is an index entry of its own. For
frequent tokens prefixes are extended until two similar sets must share two
tokens of one class, and pairs of tokens of a class are the entries. A shingle
of one document alone links nothing, so only shared ones travel.

Lists whose smallest document is the same overlap nearly always; together they
form one unit, in which each document appears once, with its shared shingles.
There the pairs are verified, and only links that join something new are
written. A unit of many documents is split into pairs of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import pa_schema, stored, tidied

WORDS = 5
PERCENT = 75
FREQUENT = 1024  # documents of a token beyond which pairs of tokens are indexed
BLOCK = 512  # documents of a block, where a unit is split
PARTS = 16  # classes of frequent tokens
SMALL = 32  # sets below this size pair up frequent tokens of all classes
CACHE = 200_000
BATCH_TOKENS, BATCH_DOCS = 1_000_000, 60_000  # dealt at once by a task
HOT = 64  # occurrences among those beyond which only their number is dealt
MARK = 0xFFFF  # stands for the documents of such a token
_MULTIPLIERS = [np.uint64(int(xxhash.xxh3_64_intdigest(f"m{k}")) | 1) for k in range(WORDS)]


class Shingler:
    """Shingle hashes of texts; word hashes are kept between texts."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def _word(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self.known) >= CACHE:
            self.known.clear()
        self.known[word] = value
        return value

    def set(self, text: str | None) -> np.ndarray:
        """Sorted distinct shingle hashes of a text."""
        words = text.encode().lower().split() if text else []
        if not words:
            return np.zeros(0, np.uint64)
        get, word = self.known.get, self._word
        w = np.array([get(x) or word(x) for x in words], np.uint64)
        size = min(WORDS, len(w))
        total = np.zeros(len(w) - size + 1, np.uint64)
        for k in range(size):
            total += w[k : len(w) - size + 1 + k] * _MULTIPLIERS[k]
        return np.unique(_mix(total + np.uint64(size)))


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


class _Places:
    """Which bucket a shingle belongs to, and its number of at most 63 bits."""

    def __init__(self, buckets: int):
        self.bits = max(1, (buckets - 1).bit_length())
        self.low = min(48, 63 - self.bits)

    def spread(self, number: int) -> int:
        """A bucket for any number."""
        return int(_mix(np.array([number + 1], np.uint64))[0]) >> (64 - self.bits)

    def split(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bucket of each shingle, and its number."""
        top = hashes >> np.uint64(64 - self.bits)
        rest = (hashes >> np.uint64(1)) & np.uint64((1 << self.low) - 1)
        return top.astype(np.int64), (top << np.uint64(self.low)) | rest


def _pack(token: np.ndarray) -> bytes:
    """Numbers without the bits of their bucket, six bytes each."""
    low = token & np.uint64((1 << 48) - 1)
    return (low & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes() + (low >> np.uint64(32)).astype(np.uint16).tobytes()


def _unpack(data: bytes, bucket: int, low: int) -> np.ndarray:
    n = len(data) // 6
    rest = np.frombuffer(data, np.uint32, n).astype(np.uint64) | np.frombuffer(data, np.uint16, n, 4 * n).astype(np.uint64) << np.uint64(32)
    return rest & np.uint64((1 << low) - 1) | np.uint64(bucket << low)


_DEALT = "place long, batch long, kind int, a binary, b binary, c binary"


def _deal(docs: DataFrame, places: _Places) -> DataFrame:
    """Shingles of all documents dealt to buckets, and a head for each batch.

    Rows of kind 0 go to a bucket: the batch's shingles there, the documents
    they occur in, and how often. Rows of kind 1 hold ids, sizes and digests of
    the batch's documents, and the documents of shingles that are frequent in
    it. The content of a batch depends on the order of the rows of a partition.
    """
    schema = pa_schema(docs.sparkSession, _DEALT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shingler, number = Shingler(), TaskContext.get().partitionId() << 32
        ids: list[int] = []
        sets: list[np.ndarray] = []
        keys: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal number, size
            n = np.array([len(s) for s in sets], np.int32)
            place, token = places.split(np.concatenate(sets) if sets else np.zeros(0, np.uint64))
            owner = np.repeat(np.arange(len(sets), dtype=np.uint16), n)
            order = np.argsort(token, kind="stable")
            place, token, owner = place[order], token[order], owner[order]
            first = np.flatnonzero(np.r_[True, token[1:] != token[:-1]]) if len(token) else np.zeros(0, np.int64)
            often = np.diff(np.r_[first, len(token)])
            hot = np.repeat(often >= HOT, often)
            hot_at, hot_n = first[often >= HOT], often[often >= HOT]
            rows = [(places.spread(number), number, 1, np.array(ids, np.int64).tobytes() + n.tobytes() + b"".join(keys), token[hot_at].tobytes() + hot_n.astype(np.int64).tobytes(), owner[hot].tobytes())]
            sent_place, sent_token = np.r_[place[~hot], place[hot_at]], np.r_[token[~hot], token[hot_at]]
            sent_owner = np.r_[owner[~hot], np.full(len(hot_at), MARK, np.uint16)]
            times = np.r_[np.ones(int((~hot).sum()), np.int64), hot_n]
            order = np.argsort(sent_place, kind="stable")
            bounds = np.searchsorted(sent_place[order], np.arange((1 << places.bits) + 1))
            for bucket in np.flatnonzero(np.diff(bounds)):
                k = order[bounds[bucket] : bounds[bucket + 1]]
                o = sent_owner[k]
                rows.append((int(bucket), number, 0, _pack(sent_token[k]), o.tobytes(), times[k][o == MARK].tobytes()))
            ids.clear(), sets.clear(), keys.clear()
            number, size = number + 1, 0
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                s = shingler.set(text.as_py())
                ids.append(doc_id)
                sets.append(s)
                keys.append(xxhash.xxh3_128_digest(s.tobytes()))
                size += len(s)
                if size >= BATCH_TOKENS or len(ids) >= BATCH_DOCS:
                    yield flush()
        if ids:
            yield flush()

    return docs.select("doc_id", "text").mapInArrow(tidied(run), _DEALT)


def _settle(dealt: DataFrame, places: _Places) -> DataFrame:
    """The counts of shingles that occur twice or more, returned to batches.

    ``dealt`` comes sorted by place. Heads are passed on.
    """
    schema = pa_schema(dealt.sparkSession, _DEALT)

    def answers(bucket: int, rows: list[tuple]) -> pa.RecordBatch:
        out = [(r[0], r[0], 1, *r[2:]) for r in rows if r[1] == 1]
        asked = [r for r in rows if r[1] == 0]
        if asked:
            token = [_unpack(r[2], bucket, places.low) for r in asked]
            owner = np.concatenate([np.frombuffer(r[3], np.uint16) for r in asked])
            source = np.repeat(np.arange(len(asked), dtype=np.int32), [len(t) for t in token])
            token = np.concatenate(token)
            times = np.ones(len(token), np.int64)
            times[owner == MARK] = np.concatenate([np.frombuffer(r[4], np.int64) for r in asked])
            order = np.argsort(token, kind="stable")
            new = np.r_[True, token[order][1:] != token[order][:-1]]
            group = np.cumsum(new) - 1
            count = np.bincount(group, times[order])[group].astype(np.int64)
            kept, count = order[count > 1], count[count > 1]
            back = np.argsort(source[kept], kind="stable")
            kept, count = kept[back], np.minimum(count[back], 0xFFFFFFFF).astype(np.uint32)
            bounds = np.searchsorted(source[kept], np.arange(len(asked) + 1))
            for k in np.flatnonzero(np.diff(bounds)):
                at = slice(bounds[k], bounds[k + 1])
                out.append((asked[k][0], asked[k][0], 2, owner[kept[at]].tobytes(), token[kept[at]].tobytes(), count[at].tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema) if out else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            for place, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if place != at and held:
                    if (found := answers(at, held)) is not None:
                        yield found
                    held = []
                at = place
                held.append(row)
        if held and (found := answers(at, held)) is not None:
            yield found

    return dealt.mapInArrow(tidied(run), _DEALT)


def _combinations(tokens: np.ndarray, part: np.ndarray, tag: int) -> np.ndarray:
    """A negative number for each pair of tokens of one part."""
    out = []
    for p in np.unique(part):
        t = np.sort(tokens[part == p])
        i, j = np.triu_indices(len(t), 1)
        out.append(_mix(t[i] * _MULTIPLIERS[0] + t[j] * _MULTIPLIERS[1] + np.uint64(tag)) | np.uint64(1 << 63))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def index_entries(n: int, tokens: np.ndarray, rare: int) -> tuple[np.ndarray, int]:
    """Index entries of a set, and how many of the first can start a link.

    ``tokens`` are the set's shared tokens in the global order, ``rare`` of
    them rare; the ``n - len(tokens)`` others come before them. Of two similar
    sets the larger finds the smaller by an entry within floor(n / 7) + 1
    tokens of the smaller; pairs of tokens always count.
    """
    own, first = n - len(tokens), n // 4 + 1
    prefix = max(0, first - own)
    entries = [tokens[: min(prefix, rare)]]
    lead = min(len(entries[0]), max(0, n // 7 + 1 - own))
    if prefix > rare:
        for parts, tag in ((PARTS, 1), (1, 2)):
            # A pair with a set under SMALL meets by way of a single part.
            if parts == 1 and n >= -(-SMALL * 100 // PERCENT) or parts > 1 and n < SMALL:
                continue
            part = (tokens[rare:] % np.uint64(parts)).astype(np.int64)
            seen, length = set(part[: prefix - rare].tolist()), prefix
            while length + own - n // 4 <= len(seen) and length < len(tokens):
                seen.add(int(part[length - rare]))
                length += 1
            entries.append(_combinations(tokens[rare:length], part[: length - rare], tag))
    return np.concatenate(entries), lead


def _gather(settled: DataFrame) -> DataFrame:
    """doc_id, n, key, whether the set may have a partner, and if so its shared
    tokens in the global order, the index entries and their lead.

    Of equal sets of a batch only the one with the smallest id carries these.
    ``settled`` comes sorted by batch.
    """
    ddl = "doc_id long, n long, key binary, linked boolean, tokens array<long>, entries array<long>, lead int"
    schema = pa_schema(settled.sparkSession, ddl)

    def documents(rows: list[tuple]) -> pa.RecordBatch:
        head = next(r for r in rows if r[0] == 1)
        size = len(head[1]) // 28
        ids = np.frombuffer(head[1], np.int64, size)
        n = np.frombuffer(head[1], np.int32, size, 8 * size).astype(np.int64)
        keys = head[1][12 * size :]
        found = [r for r in rows if r[0] == 2]
        owner = np.concatenate([np.frombuffer(r[1], np.uint16) for r in found] or [np.zeros(0, np.uint16)])
        token = np.concatenate([np.frombuffer(r[2], np.uint64) for r in found] or [np.zeros(0, np.uint64)])
        count = np.concatenate([np.frombuffer(r[3], np.uint32) for r in found] or [np.zeros(0, np.uint32)])
        hot = len(head[2]) // 16
        hot_token, hot_n = np.frombuffer(head[2], np.uint64, hot), np.frombuffer(head[2], np.int64, hot, 8 * hot)
        if hot:
            # Answers about frequent shingles hold for all documents that have them.
            told = owner == MARK
            order = np.argsort(token[told], kind="stable")
            spread = np.repeat(count[told][order], hot_n)
            owner = np.r_[owner[~told], np.frombuffer(head[3], np.uint16)]
            token = np.r_[token[~told], np.repeat(hot_token, hot_n)]
            count = np.r_[count[~told], spread]
        order = np.lexsort((token, count, owner))
        owner, token, count = owner[order], token[order], count[order]
        start = np.searchsorted(owner, np.arange(size + 1))
        rare = np.bincount(owner, count <= FREQUENT, size).astype(np.int64)
        shared = np.diff(start)
        tokens, entries, leads = [], [], np.zeros(size, np.int32)
        none = np.zeros(0, np.int64)
        # A partner shares at least three quarters of the set.
        linked = (n > 0) & (n - shared <= n // 4)
        key = [keys[16 * k : 16 * k + 16] for k in range(size)]
        first: dict[bytes, int] = {}
        for d in np.argsort(ids, kind="stable"):
            first.setdefault(key[d], d)
        for d in range(size):
            if linked[d] and first[key[d]] == d:
                own = token[start[d] : start[d + 1]]
                e, leads[d] = index_entries(int(n[d]), own, int(rare[d]))
                tokens.append(own.view(np.int64))
                entries.append(e.view(np.int64))
            else:
                tokens.append(none)
                entries.append(none)
        list_of = lambda x, t: pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(v) for v in x])], pa.int32()), pa.array(np.concatenate(x))).cast(t)
        return pa.RecordBatch.from_arrays(
            [pa.array(ids), pa.array(n), pa.array(key, pa.binary()), pa.array(linked), list_of(tokens, schema.field("tokens").type), list_of(entries, schema.field("entries").type), pa.array(leads)],
            schema=schema,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            for _, number, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if number != at and held:
                    yield documents(held)
                    held = []
                at = number
                held.append(row)
        if held:
            yield documents(held)

    return settled.mapInArrow(tidied(run), ddl)


def shingle_sets(docs: DataFrame) -> DataFrame:
    """The rows of :func:`_gather` for all ``docs`` with an id.

    Two shuffles: shingles to buckets, about eight bytes each, and counts of
    shared ones back. Documents are numbered by their place in a partition, so
    rows that come out of a shuffle are stored first.
    """
    spark = docs.sparkSession
    docs = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if "Exchange" in docs._jdf.queryExecution().executedPlan().toString():
        docs = stored(docs, "shingle-texts")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    places = _Places(parts)
    dealt = _deal(docs, places).repartition(parts, "place").sortWithinPartitions("place")
    return _gather(_settle(dealt, places).repartition(parts, "place").sortWithinPartitions("batch"))


def group_links(ids: np.ndarray, n: np.ndarray, block: np.ndarray, tokens: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that join the similar sets of a unit, ordered by n.

    Sets of two blocks are compared across the blocks only. A pair that other
    links join already is not compared.
    """
    size = len(ids)
    across = block.min() != block.max()
    label, links = np.arange(size), []
    if size <= 4:
        for i in range(size):
            for j in range(i + 1, size):
                if label[i] != label[j] and n[i] * 100 >= n[j] * PERCENT and not (across and block[i] == block[j]):
                    c = len(np.intersect1d(tokens[i], tokens[j], assume_unique=True))
                    if c * 100 >= (n[i] + n[j] - c) * PERCENT:
                        links.append((int(ids[i]), int(ids[j])))
                        label[label == label[j]] = label[i]
        return links
    owner = np.repeat(np.arange(size), [len(t) for t in tokens])
    _, column, often = np.unique(np.concatenate(tokens), return_inverse=True, return_counts=True)
    used = often > 1
    number = np.cumsum(used) - 1
    owner, column = owner[used[column]], number[column[used[column]]]
    width = int(used.sum())
    dense = size * width <= 1 << 26
    if dense:
        flags = np.zeros((size, -(-max(width, 1) // 64) * 64), bool)
        flags[owner, column] = True
        bits = np.packbits(flags, axis=1).view(np.uint64)
        del flags
    else:
        start = np.searchsorted(owner, np.arange(size + 1))
        by = np.argsort(column, kind="stable")
        list_start, listed = np.searchsorted(column[by], np.arange(width + 1)), owner[by]
    last = np.searchsorted(n, n * 100 // PERCENT, side="right")
    for i in range(size):
        near = np.arange(i + 1, last[i])
        near = near[label[near] != label[i]]
        if across:
            near = near[block[near] != block[i]]
        if not len(near):
            continue
        if dense:
            c = np.bitwise_count(bits[near] & bits[i]).sum(1, dtype=np.int64)
        else:
            mine = column[start[i] : start[i + 1]]
            c = np.bincount(np.concatenate([listed[list_start[t] : list_start[t + 1]] for t in mine] or [listed[:0]]), minlength=size)[near]
        for j in near[c * 100 >= (n[i] + n[near] - c) * PERCENT]:
            if label[j] != label[i]:
                links.append((int(ids[i]), int(ids[j])))
                label[label == label[j]] = label[i]
    return links


def _links(groups: DataFrame) -> DataFrame:
    """u and v of the links found in groups.

    ``groups`` comes sorted by group (pivot, unit, part) and n, with block,
    doc_id and tokens.
    """
    schema = pa_schema(groups.sparkSession, "u long, v long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def flush() -> pa.RecordBatch:
            ids, n, block = (np.array([r[k] for r in held]) for k in range(3))
            found = group_links(ids, n, block, [r[3] for r in held]) if len(held) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], schema=schema)

        for batch in batches:
            pivot, unit, part, n, block, doc_id = (batch.column(k).to_pylist() for k in range(6))
            tokens = batch.column(6)
            for k in range(batch.num_rows):
                if (key := (pivot[k], unit[k], part[k])) != at:
                    if held:
                        yield flush()
                    at, held = key, []
                held.append((doc_id[k], n[k], block[k], tokens[k].values.to_numpy()))
        if held:
            yield flush()

    return groups.select("pivot", "unit", "part", "n", "block", "doc_id", "tokens").mapInArrow(tidied(run), "u long, v long")


def _groups(nodes: DataFrame) -> DataFrame:
    """pivot, unit, part, block, doc_id, n and tokens of documents to compare.

    Lists with one smallest document, the pivot, form a unit. A pivot with very
    many documents, each in few of its lists, keeps a unit for each list. A
    unit of many documents is dealt to pairs of blocks.
    """
    entry = nodes.select("doc_id", "lead", F.posexplode("entries").alias("at", "h"))
    entry = entry.select("doc_id", "h", ((F.col("at") < F.col("lead")) | (F.col("h") < 0)).alias("leads"))
    lists = entry.groupBy("h").agg(F.min("doc_id").alias("pivot"), F.count("*").alias("size"), F.max("leads").alias("leads"))
    # A join, not a window: the list of a frequent pair can be split in it.
    members = stored(entry.select("doc_id", "h").join(lists.filter("size > 1 and leads").select("h", "pivot"), "h"), "members")
    of_pivot = members.groupBy("pivot", "doc_id").agg(F.count("*").alias("rows"))
    wide = of_pivot.groupBy("pivot").agg(F.count("*").alias("docs"), F.sum("rows").alias("rows")).filter((F.col("docs") > FREQUENT) & (F.col("rows") < F.col("docs") * F.col("docs") / BLOCK)).select("pivot")
    alone = members.join(wide, "pivot", "left_semi").select("pivot", F.col("h").alias("unit"), "doc_id")
    units = of_pivot.join(wide, "pivot", "left_anti").select("pivot", F.lit(0).cast("long").alias("unit"), "doc_id").unionByName(alone)
    sizes = units.groupBy("pivot", "unit").agg(F.count("*").alias("size"))
    big = sizes.filter(F.col("size") > FREQUENT).select("pivot", "unit", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    placed = units.join(big, ["pivot", "unit"], "left")
    block = F.when(F.col("blocks").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("block", block).withColumn("other", F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))))
    part = F.least("block", "other").cast("long") * (1 << 31) + F.greatest("block", "other")
    return placed.select("pivot", "unit", part.alias("part"), "block", "doc_id").join(nodes.select("doc_id", "n", "tokens"), "doc_id")


def linked_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of each document.

    ``docs`` needs doc_id and text; further columns are ignored. doc_id is
    unique, or its rows repeat each other. Null, empty and white texts have an
    empty set and are linked with nothing; a text of any length is one set.
    Equal sets are one node; only nodes are compared. Null ids are compared
    with nothing and keep a null component. An empty table gives no rows.
    Sets are compared by hashes of 63 bits at most, at least 48 and as many as
    the number of shuffle partitions has.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    sets = stored(shingle_sets(docs), "shingle-sets")
    shared = sets.filter("linked")
    keys = stored(shared.groupBy("key").agg(F.min("doc_id").alias("node")), "set-nodes")
    nodes = sets.filter("size(tokens) > 0").join(keys.select("key", F.col("node").alias("doc_id")), ["key", "doc_id"], "left_semi").dropDuplicates(["doc_id"]).select("doc_id", "n", "tokens", "entries", "lead")
    nodes = stored(nodes, "nodes")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups = _groups(nodes).repartition(parts, "pivot", "unit", "part").sortWithinPartitions("pivot", "unit", "part", "n", "doc_id")
    found = components(_links(groups))
    of_key = keys.join(found, "node", "left").select("key", F.coalesce("component", "node").alias("component_id"))
    linked = shared.select("doc_id", "n", "key").join(of_key, "key", "left").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    lone = sets.filter("not linked").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.unionByName(lone).unionByName(_without_id(docs))


def _without_id(docs: DataFrame) -> DataFrame:
    """The rows of null ids, with the size of their sets."""
    schema = pa_schema(docs.sparkSession, "doc_id long, n_shingles long, component_id long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            n = [len(shingler.set(t.as_py())) for t in batch.column(0)]
            none = pa.nulls(len(n), pa.int64())
            yield pa.RecordBatch.from_arrays([none, pa.array(n, pa.int64()), none], schema=schema)

    return docs.filter("doc_id is null").select("text").mapInArrow(tidied(run), "doc_id long, n_shingles long, component_id long")


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one document, the smallest id, of each linked group.

    Rows without an id are all kept, as are texts without words.
    """
    groups = linked_components(docs)
    gone = groups.filter(F.col("component_id") != F.col("doc_id")).select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


#: The same over ``documents``: every pair that shares a shingle, then closure.
SQL = r"""
WITH RECURSIVE worded AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM worded),
distinct_sets AS (SELECT list_sort(s) AS s, min(doc_id) AS node, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY ALL),
tokens AS MATERIALIZED (SELECT node, n, hash(t) AS t FROM (SELECT node, n, unnest(s) AS t FROM distinct_sets)),
shared AS MATERIALIZED (SELECT * FROM tokens WHERE t IN (SELECT t FROM tokens GROUP BY t HAVING count(*) > 1)),
links AS MATERIALIZED (SELECT a.node AS u, b.node AS v FROM shared a JOIN shared b ON a.t = b.t AND a.node < b.node GROUP BY a.node, b.node, a.n, b.n
  HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
steps AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
reached(a, b) AS (SELECT DISTINCT u, u FROM steps UNION SELECT r.a, s.v FROM reached r JOIN steps s ON s.u = r.b),
components AS (SELECT a AS node, min(b) AS component FROM reached GROUP BY a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, CASE WHEN len(s.s) = 0 THEN s.doc_id ELSE coalesce(component, d.node) END AS component_id
FROM sets s LEFT JOIN distinct_sets d ON list_sort(s.s) = d.s LEFT JOIN components c ON c.node = d.node
"""
