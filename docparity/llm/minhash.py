"""MinHash near-duplicate search by a signature-coordinate inverted join.

Each text gets ``K`` MinHash coordinates over its word shingles. The pair
(coordinate, value) is a token; texts are posted under tokens, and two texts
whose signatures agree in at least ``matches`` coordinates collide under that
many tokens. Texts with one signature are one posting entry, their copies.

* *prefix*: with every text's tokens in one global order, two texts with ``m``
  common tokens have one in common among the first ``K - m + 1`` of each, so
  only those are posted. The order is by the number of texts that have the
  token, so passages that many texts share are hardly posted.
* *skip*: every posting list is first merged against one member, a number of
  pairs linear in the list. A list whose members that has connected needs no
  more; in the others, texts of different components are counted against each other.
* *count*: within a component of linked texts the collisions of all pairs are
  counted, in blocks of bounded size that are tasks of their own. What leaves a
  block is a number for each text (or its pairs, where those are asked for).

Lists and components are rows, never one value; no list is capped, and every
pair above the threshold is counted. The counting takes time with the square of
the different texts of one component, spread over its blocks; shuffles do not.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docparity.llm.common import cut, fresh, slices

K = 64
SHINGLE_WORDS = 2
SIMILARITY = 0.5
#: Members of a block; two blocks are what a task holds at once.
BLOCK = 2048
#: Rows to drop are broadcast up to this many (24 bytes each), joined by shuffle beyond.
BROADCAST_GONE = 500_000

_U32 = np.uint32
_rng = np.random.RandomState(20240229)
_SEEDS = _rng.randint(0, 2**32, size=K, dtype=np.uint64).astype(_U32)
_MULTS = (_rng.randint(0, 2**32, size=K, dtype=np.uint64) | 1).astype(_U32)


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _word_hashes(words: pa.Array) -> np.ndarray:
    """64-bit hash of each distinct word's bytes, the same on every machine; 8 bytes at a time for all words together."""
    raw = words.cast(pa.large_binary())
    offsets = np.frombuffer(raw.buffers()[1], dtype=np.int64)[raw.offset : raw.offset + len(raw) + 1]
    data = np.frombuffer(raw.buffers()[2] or b"", dtype=np.uint8)
    data = np.concatenate([data[offsets[0] : offsets[-1]], np.zeros(8, np.uint8)])
    starts, lengths = (offsets[:-1] - offsets[0]), np.diff(offsets)
    h = _mix(lengths.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    live, at = np.arange(len(lengths)), 0
    while (live := live[lengths[live] > at]).size:
        left = np.minimum(lengths[live] - at, 8)
        chunk = data[(starts[live] + at)[:, None] + np.arange(8)]
        chunk[np.arange(8) >= left[:, None]] = 0
        h[live] = _mix(h[live] ^ chunk.view(np.uint64).ravel())
        at += 8
    return h


def signatures(texts: pa.Array, k: int = K, shingle_words: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """MinHash signatures as a (documents, k) uint32 array, and the number of words of each.

    Words are what white space separates, in lower case. A text with fewer
    words than a shingle is one shingle; one without words has no signature (its row is 0).
    """
    words = pc.utf8_split_whitespace(pc.utf8_lower(pc.fill_null(texts, "")))
    flat = words.flatten()
    keep = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    ends = words.offsets.to_numpy().astype(np.int64) - words.offsets[0].as_py()
    kept = np.concatenate([[0], np.cumsum(keep)])
    bounds = kept[ends]
    out = np.zeros((len(texts), k), _U32)
    n_words = np.diff(bounds)
    if not bounds[-1]:
        return out, n_words
    coded = pc.dictionary_encode(flat.filter(pa.array(keep)))
    h = _word_hashes(coded.dictionary)[coded.indices.to_numpy()]
    rolled = h.copy()
    for i in range(1, shingle_words):  # positions near a document's end run into the next one and are left out below
        rolled[: len(h) - i] = _mix(rolled[: len(h) - i] + h[i:] * np.uint64(2 * i + 1))
    short = (n_words > 0) & (n_words < shingle_words)
    for d in np.flatnonzero(short):
        rolled[bounds[d]] = np.bitwise_xor.reduce(h[bounds[d] : bounds[d + 1]] * np.arange(3, 3 + n_words[d], dtype=np.uint64))
    count = np.where(short, 1, np.maximum(n_words - shingle_words + 1, 0))
    docs = np.flatnonzero(count)
    counts = count[docs]
    first = np.concatenate([[0], np.cumsum(counts)])
    at = np.repeat(bounds[:-1][docs] - first[:-1], counts) + np.arange(first[-1])
    x = (_mix(rolled[at]) >> np.uint64(32)).astype(_U32)
    y = np.empty_like(x)
    for i in range(k):
        np.bitwise_xor(x, _SEEDS[i % K], out=y)
        np.multiply(y, _MULTS[i % K], out=y)
        np.bitwise_xor(y, y >> _U32(16), out=y)
        np.multiply(y, _U32(0x85EBCA6B), out=y)
        out[docs, i] = np.minimum.reduceat(y, first[:-1])
    return out, n_words


def _signature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text", 2 << 20):
            sig, n = signatures(part.column("text"))
            ends = np.concatenate([[0], np.cumsum(np.where(n > 0, 4 * K, 0))]).astype(np.int32)
            valid = np.packbits(n > 0, bitorder="little")
            rows = pa.Array.from_buffers(pa.binary(), len(n), [pa.py_buffer(valid), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(sig[n > 0]))])
            yield pa.RecordBatch.from_arrays([part.column("row"), part.column("doc_id"), part.column("h"), rows], ["row", "doc_id", "h", "sig"])


def _as_matrix(column: pa.Array) -> np.ndarray:
    if not len(column):
        return np.zeros((0, K), _U32)
    start = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset]
    return np.frombuffer(column.buffers()[2], dtype=np.uint8)[start : start + 4 * K * len(column)].view(_U32).reshape(-1, K)


def _tokens(sig: np.ndarray) -> np.ndarray:
    """(coordinate, value) as one positive integer each."""
    return (np.arange(K, dtype=np.int64) << 32)[None, :] | sig.astype(np.int64)


def _token_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 5000):
            part = batch.slice(lo, 5000)
            token = _tokens(_as_matrix(part.column("sig")))
            yield pa.RecordBatch.from_arrays([pa.array(token.ravel()), pa.array(np.repeat(part.column("rep").to_numpy(), K))], ["token", "rep"])


def _matches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = (_as_matrix(batch.column("sig_a")) == _as_matrix(batch.column("sig_b"))).sum(axis=1)
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(n.astype(np.int32))], ["a", "b", "matches"])


def _counted(pairs: DataFrame, reps: DataFrame, least: int) -> DataFrame:
    """The pairs (a, b) whose signatures agree in at least ``least`` coordinates."""
    a = reps.select(F.col("rep").alias("a"), F.col("sig").alias("sig_a"))
    b = reps.select(F.col("rep").alias("b"), F.col("sig").alias("sig_b"))
    both = pairs.join(a, "a").join(b, "b").select("a", "b", "sig_a", "sig_b")
    return both.mapInArrow(_matches, "a long, b long, matches int").where(F.col("matches") >= least)


def _collisions(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many coordinates of each row of ``a`` agree with each row of ``b``."""
    out = np.zeros((len(a), len(b)), np.uint8)
    a, b = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)
    for x, y in zip(a, b):
        out += x[:, None] == y[None, :]
    return out


def _blocked(members: DataFrame, each, schema: str) -> DataFrame:
    """``each`` applied to the members of all pairs of blocks of one ``key``.

    ``members``: ``key``, its number of members ``n``, ``rep``, ``sig`` and one more long, ``x``. A key's
    members fall into blocks of about ``BLOCK``, and a row goes to every pair
    of blocks that its own is in. ``each(own, other)`` gets (rep, sig, x) of both blocks,
    ``other`` being None for the pairs within one block, and gives arrays in the order of ``schema``.
    """
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    dealt = members.withColumn("own", F.pmod(F.xxhash64("rep"), blocks).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.select("key", F.least("own", "with").alias("lo"), F.greatest("own", "with").alias("hi"), "own", "rep", "x", "sig")
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in _groups(batches, ("key", "lo", "hi")):
            rep, x, own, low, high = (t.column(c).to_numpy() for c in ("rep", "x", "own", "lo", "hi"))
            sig = _as_matrix(t.column("sig").combine_chunks())
            done, size = [], 0
            for i, j in zip(starts[:-1].tolist(), starts[1:].tolist()):
                if low[i] == high[i]:
                    sides = (slice(i, j), None)
                else:
                    mine = own[i:j] == low[i]
                    if mine.all() or not mine.any():
                        continue
                    sides = (i + np.flatnonzero(mine), i + np.flatnonzero(~mine))
                if j - i > 1:
                    done.append(each(*(k if k is None else (rep[k], sig[k], x[k]) for k in sides)))
                    size += len(done[-1][0])
                if size > 200_000:
                    yield _columns(done, names)
                    done, size = [], 0
            if done:
                yield _columns(done, names)

    return dealt.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi").mapInArrow(run, schema)


def _columns(parts: list[list[np.ndarray]], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts)], names)


def _groups(batches: Iterator[pa.RecordBatch], by: tuple[str, ...]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole groups of rows sorted by the columns ``by``: tables, and where their groups begin and end."""
    held: list[pa.RecordBatch] = []
    for batch in chain(batches, [None]):
        if batch is not None:
            held.append(batch)
            if not batch.num_rows or all(held[0].column(c)[0] == batch.column(c)[batch.num_rows - 1] for c in by):
                continue
        if not held:
            return
        t = pa.Table.from_batches(held).combine_chunks()
        if not t.num_rows:
            return
        new = np.ones(t.num_rows, bool)
        new[1:] = np.logical_or.reduce([(x := t.column(c).to_numpy())[1:] != x[:-1] for c in by])
        starts = np.append(np.flatnonzero(new), t.num_rows)
        if batch is not None:  # the last group may go on
            starts, held = starts[:-1], t.slice(int(starts[-2])).to_batches()
            t = t.slice(0, int(starts[-1]))
        if len(starts) > 1:
            yield t.combine_chunks(), starts


def _across(least: int):
    """Components (``x``) that a pair of texts with enough collisions connects."""

    def each(own, other):
        (_, sa, xa), (_, sb, xb) = own, other or own
        hit = [(xa[i + r], xb[c]) for i in range(0, len(xa), 512) for r, c in [np.nonzero((_collisions(sa[i : i + 512], sb) >= least) & (xa[i : i + 512, None] != xb[None, :]))]]
        a, b = (np.concatenate(x) for x in zip(*hit))
        return list(np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)) if len(a) else [a, b]

    return each


def _linked(least: int):
    """For each text the number of others with enough collisions, copies (``x``) counted."""

    def each(own, other):
        if other is None:
            rep, sig, x = own
            n = np.concatenate([(_collisions(sig[i : i + 512], sig) >= least) @ x for i in range(0, len(rep), 512)]) - x
            return [rep, n.astype(np.int64)]
        (ra, sa, xa), (rb, sb, xb) = own, other
        na, nb = np.zeros(len(ra), np.int64), np.zeros(len(rb), np.int64)
        for i in range(0, len(ra), 512):
            hit = _collisions(sa[i : i + 512], sb) >= least
            na[i : i + 512] = hit @ xb
            nb += xa[i : i + 512] @ hit
        return [np.concatenate([ra, rb]), np.concatenate([na, nb])]

    return each


def _pairs(least: int):
    """The pairs of texts with enough collisions."""

    def each(own, other):
        (ra, sa, _), (rb, sb, _) = own, other or own
        out = []
        for i in range(0, len(ra), 512):
            n = _collisions(sa[i : i + 512], sb)
            r, c = np.nonzero(n >= least)
            if other is None:
                r, c = r[r + i < c], c[r + i < c]
            out.append((ra[i + r], rb[c], n[r, c].astype(np.int32)))
        return [np.concatenate(x) for x in zip(*out)]

    return each


def components(edges: DataFrame, a: str = "doc_a", b: str = "doc_b") -> DataFrame:
    """(doc_id, group_id) for every document with an edge; ``group_id`` is the least document of its component.

    Alternating large-star and small-star steps until every component is a star: a number
    of rounds that grows with the logarithm of the longest chain, each a
    shuffle of at most as many rows as there are edges. Rounds are checkpointed.
    """
    now = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    while not _stars(now):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        now = cut(small.where("u <> v").distinct())
    return now.select(F.col("u").alias("doc_id"), F.col("v").alias("group_id")).union(now.select(F.col("v").alias("doc_id"), F.col("v").alias("group_id")).distinct())


def _stars(edges: DataFrame) -> bool:
    """Whether every greater end has one edge and is the lesser end of none."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
    return not ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up = 1 and down = 1").limit(1).count()


class _Search:
    """The steps of a search; each is a table in the shared folder or made of such tables."""

    def __init__(self, docs: DataFrame, similarity: float, text: str):
        self.least = int(np.ceil(similarity * K))
        given = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))
        self.rows = cut(given.mapInArrow(_signature_rows, "row long, doc_id long, h long, sig binary"))
        # two hashes of 64 bits stand for a signature where texts are told apart by it
        keys = self.rows.where("sig is not null").select("row", F.xxhash64("sig").alias("k1"), F.xxhash64("sig", F.lit(1)).alias("k2"))
        copies = cut(keys.groupBy("k1", "k2").agg(F.min("row").alias("rep"), F.count("*").alias("copies")))
        self.members = keys.join(copies, ["k1", "k2"]).select("row", "rep", "copies")
        self.reps = cut(self.rows.select(F.col("row").alias("rep"), "sig").join(copies.select("rep", "copies"), "rep"))
        self.groups = self._connected()

    def _connected(self) -> DataFrame:
        """(rep, grp) of every text that has a link to a different one."""
        posted = cut(_postings(self.reps, K - self.least + 1))
        centres = posted.groupBy("token").agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64("rep").alias("o"), "rep")).alias("c")).where("n > 1")
        stars = posted.join(centres, "token").where(F.col("rep") != F.col("c.rep")).select(F.least("rep", "c.rep").alias("a"), F.greatest("rep", "c.rep").alias("b")).distinct()
        first = components(_counted(stars, self.reps, self.least), "a", "b")
        placed = posted.join(first.select(F.col("doc_id").alias("rep"), F.col("group_id").alias("x")), "rep", "left").withColumn("x", F.coalesce("x", "rep"))
        mixed = placed.groupBy("token").agg(F.count("*").alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1")).where("n > 2 and x0 <> x1").select(F.col("token").alias("key"), "n")
        left = placed.join(mixed, F.col("token") == F.col("key")).join(self.reps.select("rep", "sig"), "rep").select("key", "n", "rep", "x", "sig")
        more = _blocked(left, _across(self.least), "a long, b long")
        edges = first.select(F.col("doc_id").alias("a"), F.col("group_id").alias("b")).union(more)
        return components(edges, "a", "b").select(F.col("doc_id").alias("rep"), F.col("group_id").alias("grp"))

    def counted(self, each, schema: str) -> DataFrame:
        """All pairs of different texts within components."""
        sizes = self.groups.groupBy("grp").agg(F.count("*").alias("n"))
        inside = self.groups.join(sizes, "grp").join(self.reps, "rep").select(F.col("grp").alias("key"), "n", "rep", F.col("copies").alias("x"), "sig")
        return _blocked(inside, each(self.least), schema)

    def labelled(self) -> DataFrame:
        """(row, rep, copies, grp) of the rows that have a near-duplicate or copy; ``grp`` is the same for all rows of a group."""
        with_group = self.members.join(self.groups, "rep", "left")
        return with_group.where("grp is not null or copies > 1").select("row", "rep", "copies", F.coalesce("grp", "rep").alias("grp"))

    def kept(self) -> DataFrame:
        """Labelled rows with ``doc_id``, ``h`` and their group's ``first``: the least ``doc_id`` (null comes last), hash and row."""
        named = self.labelled().join(self.rows.select("row", "doc_id", "h"), "row")
        first = named.groupBy("grp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h", "row")).alias("first"))
        return named.join(first, "grp")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, text: str = "text") -> DataFrame:
    """(doc_id, class_id, links): one row for each row of ``docs``.

    Two rows are linked if their signatures agree in at least ``ceil(similarity * 64)``
    of 64 coordinates. ``links`` is the number of other rows linked to this
    one, copies counted one by one; ``class_id`` is the least ``doc_id`` of the rows that links
    connect it with, itself included. A row without links, such as one with an empty, blank
    or null text, has its own ``doc_id`` and 0. Rows without ``doc_id`` take part, their
    ``class_id`` is null if no row of the class has one. Repeated rows are copies
    of each other. Only ``doc_id`` and the text column are read, whatever else
    the table has. An empty table gives an empty result.
    """
    found = _Search(docs, similarity, text)
    links = found.counted(_linked, "rep long, links long").groupBy("rep").agg(F.sum("links").alias("different"))
    classes = found.kept().select("row", "rep", "copies", F.col("first.doc_id").alias("class_id")).join(links, "rep", "left")
    classes = classes.select("row", F.lit(True).alias("linked"), "class_id", (F.coalesce("different", F.lit(0)) + F.col("copies") - 1).alias("links"))
    out = found.rows.select("row", "doc_id").join(classes, "row", "left")
    return out.select("doc_id", F.when(F.col("linked"), F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"), F.coalesce("links", F.lit(0).cast("long")).alias("links"))


def near_duplicate_pairs(docs: DataFrame, similarity: float = SIMILARITY, text: str = "text") -> DataFrame:
    """(doc_a, doc_b, similarity): every linked pair of different texts, each text named by one of its rows, and every copy with that row.

    Links are those of :func:`near_duplicates`. The rows grow with the square of a group's different texts. Of
    texts with one signature the first row stands for all; rows without ``doc_id`` give a null there.
    """
    found = _Search(docs, similarity, text)
    pairs = found.counted(_pairs, "a long, b long, matches int").union(found.members.where("row <> rep").select("rep", "row", F.lit(K)))
    ids = found.rows.select("row", "doc_id")
    named = pairs.join(ids.toDF("a", "id_a"), "a").join(ids.toDF("b", "id_b"), "b")
    return named.select(F.least("id_a", "id_b").alias("doc_a"), F.greatest("id_a", "id_b").alias("doc_b"), (F.col("matches") / F.lit(float(K))).alias("similarity"))


def _postings(reps: DataFrame, prefix: int) -> DataFrame:
    """(token, rep): ``prefix`` tokens of each text, rarest first.

    Tokens of one text only are left out after they are counted as the
    first of its order: they never collide but use up places of the prefix.
    """
    tokens = reps.mapInArrow(_token_rows, "token long, rep long")
    often = tokens.groupBy("token").agg(F.count("*").alias("n")).where("n > 1")
    shared = tokens.join(often, "token").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("n", F.xxhash64("token").alias("h"), "token"))).alias("t"))
    room = F.lit(prefix - K) + F.size("t")  # places left after the tokens no other text has
    return shared.where(room > 0).select("rep", F.explode(F.slice("t", F.lit(1), room)).alias("p")).select("p.token", "rep")


def near_duplicates_dropped(docs: DataFrame, similarity: float = SIMILARITY, text: str = "text") -> DataFrame:
    """``docs`` without the near-duplicates: of each class of :func:`near_duplicates` the row of the least ``doc_id`` stays.

    Columns are those of ``docs``. Rows whose text is null or blank are in no class and
    stay. Of one ``doc_id`` with several texts the one with the least hash
    comes first; rows without ``doc_id`` come last. Rows repeated with ``doc_id`` and text stay or go together.
    """
    kept = _Search(docs, similarity, text).kept().where(~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("h") == F.col("first.h"))))
    own_id, own_h = fresh("__dp_id", docs), fresh("__dp_h", docs)
    gone = cut(kept.select(F.col("doc_id").alias(own_id), F.col("h").alias(own_h)).distinct())
    if gone.limit(BROADCAST_GONE + 1).count() <= BROADCAST_GONE:
        gone = F.broadcast(gone)
    return docs.join(gone, F.col("doc_id").cast("long").eqNullSafe(F.col(own_id)) & (F.xxhash64(text) == F.col(own_h)), "left_anti")


def near_duplicates_sql(table: str = "documents") -> str:
    """DuckDB SQL for :func:`near_duplicates`, signatures by their definition and every pair counted; for tables whose ``doc_id`` is a key."""
    let = lambda value, body: f"list_transform([{value}], lambda {body[0]}: {body[1]})[1]"
    times = lambda x, k: f"(({x})::UHUGEINT * {k}::UHUGEINT % 18446744073709551616::UHUGEINT)::UBIGINT"
    half = lambda x, name: let(x, (name, f"xor({name}, {name} >> 33)"))
    mix = lambda x: half(times(half(times(half(x, "m1"), 0xFF51AFD7ED558CCD), "m2"), 0xC4CEB9FE1A85EC53), "m3")
    plus = lambda a, b: f"((({a})::UHUGEINT + ({b})::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT"
    swapped = "concat(" + ", ".join(f"substr(c, {k}, 2)" for k in range(15, 0, -2)) + ")"
    chunks = f"list_transform(range(0, (octet_length(encode(w)) + 7) // 8), lambda k: {let('rpad(substr(hex(encode(w)), 16 * k + 1, 16), 16, chr(48))', ('c', f"('0x' || {swapped})::UBIGINT"))})"
    start = mix(plus("octet_length(encode(w))", str(0x9E3779B97F4A7C15)))
    coordinates = ", ".join(f"({i}, {a}::UBIGINT, {b}::UBIGINT)" for i, (a, b) in enumerate(zip(_SEEDS.tolist(), _MULTS.tolist())))
    return f"""
    WITH RECURSIVE ws AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\\s+'), lambda x: x <> '') AS l FROM {table}),
    wd AS (SELECT w, list_reduce(list_prepend({start}, {chunks}), lambda h, c: {mix("xor(h, c)")}) AS h FROM (SELECT DISTINCT unnest(l) AS w FROM ws)),
    po AS (SELECT doc_id, unnest(l) AS w, unnest(range(0, len(l))) AS place, len(l) AS n FROM ws),
    hs AS (SELECT doc_id, n, h, lead(h) OVER (PARTITION BY doc_id ORDER BY place) AS h2 FROM po JOIN wd USING (w)),
    ro AS (SELECT doc_id, CASE WHEN n = 1 THEN {times('h', 3)} ELSE {mix(plus('h', times('h2', 3)))} END AS r FROM hs WHERE n = 1 OR h2 IS NOT NULL),
    sh AS (SELECT DISTINCT doc_id, {mix('r')} >> 32 AS x FROM ro),
    y1 AS (SELECT doc_id, i, xor(x, seed) * mult % 4294967296 AS y FROM sh, (VALUES {coordinates}) c(i, seed, mult)),
    sg AS (SELECT doc_id, i, min(xor(y, y >> 16) * 2246822507 % 4294967296) AS v FROM y1 GROUP BY doc_id, i),
    li AS (SELECT a.doc_id AS a, b.doc_id AS b FROM sg a JOIN sg b ON a.i = b.i AND a.v = b.v AND a.doc_id <> b.doc_id GROUP BY ALL HAVING count(*) >= {int(np.ceil(SIMILARITY * K))}),
    re AS (SELECT a, b FROM li UNION SELECT re.a, li.b FROM re JOIN li ON re.b = li.a)
    SELECT doc_id, least(doc_id, (SELECT min(b) FROM re WHERE re.a = doc_id)) AS class_id, (SELECT count(*) FROM li WHERE li.a = doc_id) AS links FROM {table}"""
