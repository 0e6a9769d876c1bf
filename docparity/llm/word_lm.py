"""Language-model scoring with a Kneser-Ney model over words in an Elias-Fano context trie.

A symbol is a word: a run of letters and digits, one character of a script
written without spaces, or one mark. Every word of the corpus is in the
vocabulary, the most frequent first; a word that is not there is the unknown
symbol. Words are told apart by 64 bits of hash.

Every slice of texts sends its n-grams, each with its count, to the part that
their last two context words give, so all counts of orders 3 to 5 are made within
a part; order 2 is summed up over parts by its context word, order 1 over those.
Nothing is pruned. The parts are made in eight rounds over the texts, so that an
eighth of the n-grams is on disk at a time. Bigrams are read off the parts.

A part is a trie of contexts, from the last word to the first, with the words
that follow each context. A node's children are a range of the next level; the
symbols of a level are made monotone by adding to each range the last value of
the range before it. All are Elias-Fano coded. A word that follows a context also
follows the one a word shorter, so from order 4 on its symbol is its place among
the words there. The counts of the words, and what each context's total has above
their number, take two bits, from 3 on a byte more: by a code book, exact where a
level has no more than 256 such values, else by steps of equal ratio. They give
the smoothed probabilities and weights once the discounts of all orders are known;
scoring adds them up from the unigram on.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docparity.llm.common import byte_lengths, cut, new_folder, open_mapped, released, slices, write_whole
from docparity.llm.elias_fano import EliasFano, Plain, Small

ORDER = 5
EDGE, UNKNOWN, FIRST = 0, 1, 2
#: Bits of a symbol where two share a number.
BITS = 31
#: Values of a sequence between two where a search over many begins.
SAMPLE = 64
#: n-grams of a part, about; parts are by hash, so a pair of words is never split.
PART_GRAMS = 2_000_000
#: Parts are of so many groups by the last context word, so that those of a group ask its bigrams only; few, as no word is split here.
GROUPS = 4
#: Rounds over the texts in which the parts are made and read.
ROUNDS = 8
#: Symbols of a file of unigram counts.
BLOCK = 1 << 20
#: Bytes of text a worker takes at once.
SLICE = 8 << 20
#: Bytes of other texts scored at once: the more, the more look-ups of a part come together, and the more memory they take.
SCORED = 8 << 20
#: Bits of the number of a slice within its partition.
SLICES = 12
#: Values that are decoded one after the other in the time of one look-up.
DECODED = 24
_WORD = re.compile(r"[぀-ヿ㐀-鿿]|[^\W぀-ヿ㐀-鿿]+|[^\w\s]")
_WORD_OR_END = re.compile(_WORD.pattern + r"|\n")
_SENT = "part int, blob binary, stats string"
_SPLIT = "slice int, doc_id array<long>, size array<long>, symbols long"
_SUMS = "slice int, sums binary"
_SCORES = "doc_id long, n_symbols long, log10_prob double, perplexity double"


def _words(column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words, the words of all texts as places in them, and how many each text has."""
    split = pc.utf8_split_whitespace(pc.fill_null(column, ""))
    coded = pc.list_flatten(split).dictionary_encode()
    # white space has been split at, so a line end is free to close each entry
    names = _WORD_OR_END.findall("\n".join([*coded.dictionary.to_numpy(zero_copy_only=False), ""]))
    codes, distinct = pd.factorize(np.array(names, dtype=object))
    closed = np.flatnonzero(codes == codes[-1]) if names else np.zeros(0, np.int64)
    k = np.diff(closed, prepend=-1) - 1
    if names:
        end = codes[-1]
        codes, distinct = np.delete(codes, closed), np.delete(distinct, end)
        codes[codes > end] -= 1
    at = coded.indices.to_numpy(zero_copy_only=False)
    times, first = k[at], (np.cumsum(k) - k)[at]
    place = np.repeat(first - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))])
    sums = np.concatenate([[0], np.cumsum(times)])[ends]
    return list(distinct), codes[place], np.diff(sums)


def _hashes(words: list[str]) -> np.ndarray:
    return pd.util.hash_array(np.array(words, dtype=object), categorize=False).view(np.int64) if words else np.zeros(0, np.int64)


def _listed(values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _split_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for every slice of texts: its documents, their symbols (0 for null and empty), the hashes of its distinct words and the texts as places in them."""
    first, k = TaskContext.get().partitionId() << SLICES, 0
    for batch in batches:
        for part in slices(batch, "text", SLICE):
            if k >> SLICES or first >> BITS:
                raise ValueError("too many slices or partitions")
            words, codes, n = _words(part.column("text"))
            size = np.where(byte_lengths(part.column("text")) > 0, n + 1, 0)
            rows = [pa.array([first + k], pa.int32()), _listed(part.column("doc_id")), _listed(pa.array(size, pa.int64())), pa.array([int(size.sum())], pa.int64())]
            yield pa.RecordBatch.from_arrays([*rows, pa.array([_hashes(words).tobytes()]), pa.array([_packed([codes])])], ["slice", "doc_id", "size", "symbols", "h", "codes"])
            k += 1


def _word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for h, codes in zip(batch.column("h").to_pylist(), batch.column("codes").to_pylist()):
            h = np.frombuffer(h, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.bincount(_unpacked([codes], 1, np.int32)[0], minlength=len(h)).astype(np.int64))], ["h", "n"])


class Vocabulary:
    """Files of sorted hashes, each with their ranks; the file of the most frequent words first."""

    def __init__(self, folder: str, files: list[list[int]]):
        self.folder, self.files, self.open = folder, files, {}

    def ids(self, h: np.ndarray) -> np.ndarray:
        out, left, base = np.full(len(h), UNKNOWN, np.int64), np.arange(len(h)), FIRST
        for name, n in self.files:
            if not left.size:
                break
            if name not in self.open:
                data = open_mapped(f"{self.folder}/{name}.words")
                self.open[name] = data[: 8 * n].view(np.int64), data[8 * n :].view(np.uint32)
            known, rank = self.open[name]
            at = np.minimum(np.searchsorted(known, h[left]), n - 1)
            hit = known[at] == h[left]
            out[left[hit]] = base + rank[at[hit]].astype(np.int64)
            left, base = left[~hit], base + n
        return out


def _grams(column: pa.Array, vocabulary: Vocabulary) -> tuple[list[np.ndarray], np.ndarray]:
    """The words of the n-gram that ends at each symbol of each text (the closing edge included), and the symbols of each text; 0 for null and empty."""
    words, codes, n = _words(column)
    size = np.where(byte_lengths(column) > 0, n + 1, 0)
    return _ends(vocabulary.ids(_hashes(words))[codes], size), size


def _ends(ids: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    n = size[size > 0] - 1
    step = n + ORDER
    starts = np.cumsum(step) - step
    padded = np.full(int(step.sum()), EDGE, np.int32)
    at = np.repeat(starts + ORDER - 1 - (np.cumsum(n) - n), n) + np.arange(len(ids))
    padded[at] = ids
    keep = np.ones(len(padded), bool)
    keep[(starts[:, None] + np.arange(ORDER - 1)).ravel()] = False
    keep = np.flatnonzero(keep)
    return [padded[keep - k] for k in range(ORDER - 1, -1, -1)]


def _pair(a: np.ndarray, b: np.ndarray, bits: int = BITS) -> np.ndarray:
    return a.astype(np.int64) << bits | b


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(33)


def _groups(parts: int) -> int:
    return GROUPS if parts % GROUPS == 0 else 1


def _part(context: np.ndarray, key: np.ndarray, parts: int) -> np.ndarray:
    """The last context word gives the group, ``key`` which of its parts."""
    groups = np.uint64(_groups(parts))
    return (_mixed(context ^ BLOCK) % groups + groups * (_mixed(key) % (np.uint64(parts) // groups))).astype(np.int64)


def _round(part: np.ndarray, parts: int, rounds: int) -> np.ndarray:
    """The round in which a part is made and read: each has parts of all groups."""
    return part // _groups(parts) % rounds


def _packed(columns: list[np.ndarray]) -> bytes:
    """Columns byte by byte, so that high bytes, which are mostly zero, take no room."""
    planes = np.ascontiguousarray(np.stack(columns, axis=1).astype("<u4").view(np.uint8).T)
    return len(columns[0]).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unpacked(blobs: list[bytes], k: int, kind: type = np.int64) -> list[np.ndarray]:
    tables = []
    for b in blobs:
        n = int.from_bytes(b[:8], "little")
        raw = pa.decompress(b[8:], decompressed_size=n * k * 4, codec="zstd", asbytes=True)
        tables.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(k * 4, n).T).view("<u4"))
    return [np.concatenate([t[:, i].astype(kind) for t in tables]) for i in range(k)]


def _sent(part: np.ndarray, columns: list[np.ndarray]) -> Iterator[tuple[int, bytes]]:
    if (part[1:] < part[:-1]).any():
        order = np.argsort(part, kind="stable")
        part, columns = part[order], [c[order] for c in columns]
    starts = np.flatnonzero(np.diff(part, prepend=-1))
    for i, j in zip(starts, np.append(starts[1:], len(part))):
        yield int(part[i]), _packed([c[i:j] for c in columns])


def _rows(sent: list[tuple[int, bytes]], stats: dict | None = None) -> list[pa.Array]:
    more = [] if stats is None else [(-1, None)]
    rows = [*sent, *more]
    return [pa.array([p for p, _ in rows], pa.int32()), pa.array([b for _, b in rows], pa.binary()), pa.array([None] * len(sent) + [json.dumps(stats)] * len(more), pa.string())]


def _numbered_rows(folder: str, files: list[list[int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(folder, files)
        for batch in batches:
            for i in range(batch.num_rows):
                row, (h, codes) = batch.slice(i, 1), (batch.column(x)[i].as_py() for x in ("h", "codes"))
                ids = vocabulary.ids(np.frombuffer(h, np.int64))[_unpacked([codes], 1, np.int32)[0]]
                yield pa.RecordBatch.from_arrays([*row.columns[:4], pa.array([_packed([ids])])], ["slice", "doc_id", "size", "symbols", "ids"])

    return run


def _gram_rows(bits: int, parts: int, now: int, rounds: int, own: bool = False):
    """The n-grams of one of the rounds, each once a slice with its count, or (``own``) all with the slice and the document in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                size = batch.column("size")[i].values.to_numpy()
                w = _ends(_unpacked([batch.column("ids")[i].as_py()], 1, np.int32)[0], size)
                part = _part(w[3], _pair(w[3], w[2]), parts)
                mine = np.flatnonzero(_round(part, parts, rounds) == now)
                if not mine.size:
                    continue
                part, w = part[mine], [x[mine] for x in w]
                # by part and near context, and equal n-grams side by side but for rare clashes, which the part adds up
                mixed = (_mixed(_pair(w[1], w[0])) ^ _mixed(w[4])).astype(np.int64)
                order = np.argsort(_folded([(part, parts.bit_length()), (w[3], bits), (w[2], bits), (mixed & 255, 8)]))
                part, w = part[order], [x[order] for x in w]
                if own:
                    doc = np.repeat(np.arange(len(size), dtype=np.int32), size)[mine[order]]
                    columns = [*w, np.full(len(order), batch.column("slice")[i].as_py(), np.int32), doc]
                else:
                    at = _starts(*w)
                    part, columns = part[at[:-1]], [*(x[at[:-1]] for x in w), np.diff(at)]
                yield pa.RecordBatch.from_arrays(_rows(list(_sent(part, columns))), ["part", "blob", "stats"])

    return run


def _bits(files: list[list[int]]) -> int:
    """Bits of a symbol of this vocabulary."""
    return (FIRST + sum(n for _, n in files)).bit_length()


def _folded(keys: list[tuple[np.ndarray, int]]) -> np.ndarray:
    """One number a row in the order of these keys of so many bits; where they take over 63, what comes first is replaced by its ranks."""
    out, used = keys[0][0].astype(np.int64), keys[0][1]
    for key, bits in keys[1:]:
        if used + bits > 63:
            order = np.argsort(out)
            ranks = np.repeat(np.arange(len(at := _starts(out[order])) - 1), np.diff(at))
            out = np.empty(len(order), np.int64)
            out[order], used = ranks, len(at).bit_length()
        out, used = out << bits | key, used + bits
    return out


def _distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, the order of all rows, and where each distinct one begins in it, with the end."""
    order = np.argsort(key)
    at = _starts(ordered := key[order])
    return ordered[at[:-1]], order, at


def _ranked(order: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each row the place of its key among the distinct ones."""
    out = np.empty(len(order), np.int64)
    out[order] = np.repeat(np.arange(len(at) - 1), np.diff(at))
    return out


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where rows of sorted keys differ from those before, and the end."""
    new = np.ones(len(keys[0]) + 1, bool)
    new[1:-1] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


def _monotone(symbol: np.ndarray, starts: np.ndarray) -> np.ndarray:
    base = np.concatenate([[0], np.cumsum(symbol[starts[1:] - 1])[:-1]])
    return symbol + np.repeat(base, np.diff(starts))


def _followers(symbol: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    return [starts, _monotone(symbol, starts)]


def quantised(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A byte for each of these positive numbers, and the 256 values the bytes stand for."""
    exact, place, n = np.unique(values, return_inverse=True, return_counts=True)
    book = np.ones(256)
    if len(exact) <= 256:
        book[: len(exact)] = exact
        return place.astype(np.uint8), book
    log = np.log(exact)
    low, step = log.min(), (log.max() - log.min()) / 255 or 1.0
    code = np.rint((log - low) / step).astype(np.int64)
    weight, total = np.bincount(code, n, 256), np.bincount(code, n * log, 256)
    used = weight > 0
    book[used] = np.exp(total[used] / weight[used])
    return code.astype(np.uint8)[place], book


def _file(sequences: list[np.ndarray], counts: list[tuple[np.ndarray, np.ndarray]]) -> bytes:
    """Sequences, and for each level the counts of its words by the ranges that follow each context."""
    arrays = [EliasFano.build(x.astype(np.int64)) for x in sequences]
    for n, starts in counts:
        arrays += [Small.build(n - 1, quantised), Small.build(np.add.reduceat(n - 1, starts[:-1]), quantised)]
    head = json.dumps([len(a) for a in arrays]).encode()
    head = head.ljust(-(-len(head) // 8) * 8, b" ")
    return len(head).to_bytes(8, "little") + head + b"".join(a.tobytes() for a in arrays)


def _once_and_twice(count: np.ndarray) -> list[int]:
    return [int((count == 1).sum()), int((count == 2).sum())]


def _by_context(w: list[np.ndarray], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of n-grams in a part, and where each distinct one begins in it, with the end."""
    return _distinct(_folded([(w[k], bits) for k in (3, 2, 1, 0, 4)]))[1:]


def _write_tail(folder: str, bits: int):
    """Orders 3 to 5 of a part."""

    def write(key, table):
        *w, n = _unpacked(table.column("blob").to_pylist(), ORDER + 1, np.int32)
        order, at = _by_context(w, bits)
        n5 = np.add.reduceat(n[order].astype(np.int64), at[:-1])
        a, b, c, d, word = (x[order[at[:-1]]] for x in w)
        del w, n
        # contexts of two to four words in order, and which of them a row has
        two, three, four = _starts(d, c), _starts(d, c, b), _starts(d, c, b, a)
        in3, in4 = (np.repeat(np.arange(len(x) - 1), np.diff(x)) for x in (three, four))
        mask, above3, above4 = (1 << BITS) - 1, np.searchsorted(three, two), np.searchsorted(four, three)
        in2 = np.repeat(np.arange(len(two) - 1), np.diff(above3))  # of a context of three
        key4, order, at = _distinct(in3 << BITS | word)
        n4, place4, starts4 = np.diff(at), _ranked(order, at), _starts(key4 >> BITS)
        key3, order, at = _distinct(in2[key4 >> BITS] << BITS | key4 & mask)
        n3, place3, starts3 = np.diff(at), _ranked(order, at), _starts(key3 >> BITS)
        word3 = key3 & mask
        block = _file([
            _pair(d[two[:-1]], c[two[:-1]], bits), *_followers(word3, starts3),
            above3, _monotone(b[three[:-1]], above3), *_followers(place3 - starts3[in2[key4 >> BITS]], starts4),
            above4, _monotone(a[four[:-1]], above4), *_followers(place4 - starts4[in3], four),
        ], [(n3, starts3), (n4, starts4), (n5, four)])
        size = write_whole(f"{folder}/{key[0].as_py()}.tail", iter([block]))
        stats = {"3": _once_and_twice(n3), "4": _once_and_twice(n4), "5": _once_and_twice(n5), "grams": [len(n3), len(n4), len(n5)], "bytes": size, "part": key[0].as_py()}
        return pa.table(_rows([], stats), ["part", "blob", "stats"])

    return write


def _bigram_rows(folder: str, tails: list[int], parts: int, bits: int):
    """The bigrams of parts, read off their third order, with the number of words before each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column("id").to_pylist():
                context, word, _ = Part(open_mapped(f"{folder}/{tails[k]}.tail"), [0.0] * 3).followers(0)
                pairs, n = np.unique(_pair(context >> bits, word), return_counts=True)
                context, word = pairs >> BITS, pairs & (1 << BITS) - 1
                yield pa.RecordBatch.from_arrays(_rows(list(_sent(_part(context, context, parts), [context, word, n]))), ["part", "blob", "stats"])

    return run


def _write_head(folder: str):
    """Order 2 of a part; sends on its unigrams."""

    def write(key, table):
        context, word, n = _unpacked(table.column("blob").to_pylist(), 3)
        pairs, order, at = _distinct(context << BITS | word)
        n = np.add.reduceat(n[order], at[:-1])
        context, word = pairs >> BITS, pairs & (1 << BITS) - 1
        starts = _starts(context)
        size = write_whole(f"{folder}/{key[0].as_py()}.head", iter([_file([context[starts[:-1]], *_followers(word, starts)], [(n, starts)])]))
        words, kinds = np.unique(word, return_counts=True)
        return pa.table(_rows(list(_sent(words // BLOCK, [words, kinds])), {"2": _once_and_twice(n), "grams": [len(n)], "bytes": size, "part": key[0].as_py()}), ["part", "blob", "stats"])

    return write


def _write_unigrams(folder: str):
    def write(key, table):
        block = key[0].as_py()
        word, n = _unpacked(table.column("blob").to_pylist(), 2)
        counts = np.zeros(BLOCK, np.int64)
        np.add.at(counts, word - block * BLOCK, n)
        size = write_whole(f"{folder}/{block}.unigrams", iter([counts[: max(UNKNOWN, int(word.max()) - block * BLOCK) + 1].tobytes()]))
        return pa.table(_rows([], {"1": _once_and_twice(counts), "total": int(counts.sum()), "grams": [int((counts > 0).sum())], "bytes": size, "block": block}), ["part", "blob", "stats"])

    return write


def _write_words(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = np.concatenate([np.zeros(0, np.int64), *(b.column("h").to_numpy() for b in batches)])
        if len(h):
            name, order = TaskContext.get().partitionId(), np.argsort(h)
            write_whole(f"{folder}/{name}.words", iter([h[order].tobytes(), order.astype(np.uint32).tobytes()]))
            yield pa.RecordBatch.from_arrays([pa.array([name], pa.int32()), pa.array([len(h)], pa.int64())], ["name", "n"])

    return run


def _stats(rows: DataFrame) -> list[dict]:
    return [json.loads(r["stats"]) for r in rows.where("part < 0").select("stats").collect()]


def _split(docs: DataFrame, text: str) -> DataFrame:
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    return cut(given.mapInArrow(_split_rows, f"{_SPLIT}, h binary, codes binary"))


def _learnt(docs: DataFrame, text: str) -> tuple[DataFrame, dict]:
    """The texts by slices with their words as numbers, and the model of them."""
    split = _split(docs, text)
    folder = new_folder(docs.sparkSession, "word-lm")
    counted = cut(split.mapInArrow(_word_rows, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")))
    tokens = split.agg(F.sum("symbols")).first()[0] or 0
    files = sorted([r["name"], r["n"]] for r in counted.orderBy(F.desc("n"), "h").select("h").mapInArrow(_write_words(folder), "name int, n long").collect())
    del counted
    symbols = FIRST + sum(n for _, n in files)
    if symbols >= 1 << BITS:
        raise ValueError(f"more than {1 << BITS} distinct words")
    numbered = cut(split.mapInArrow(_numbered_rows(folder, files), f"{_SPLIT}, ids binary"))
    del split
    released(docs.sparkSession)
    parts = -(-tokens // PART_GRAMS) or 1
    if parts >= GROUPS:
        parts = -(-parts // GROUPS) * GROUPS
    meta: dict = {"folder": folder, "files": files, "symbols": symbols, "parts": parts, "d": {}}
    made, rounds = [], min(ROUNDS, parts // _groups(parts))
    meta["rounds"] = rounds
    for now in range(rounds):
        made.append(cut(numbered.mapInArrow(_gram_rows(_bits(files), parts, now, rounds), _SENT).groupBy("part").applyInArrow(_write_tail(folder, _bits(files)), _SENT)))
        released(docs.sparkSession)
    tails = reduce(DataFrame.union, made)
    there = [x["part"] for x in _stats(tails)]
    each = docs.sparkSession.range(0, len(there), 1, max(1, len(there)))
    heads = cut(each.mapInArrow(_bigram_rows(folder, there, parts, _bits(files)), _SENT).groupBy("part").applyInArrow(_write_head(folder), _SENT))
    released(docs.sparkSession)
    blocks = cut(heads.where("part >= 0").groupBy("part").applyInArrow(_write_unigrams(folder), _SENT))
    stats = [_stats(x) for x in (blocks, heads, tails)]
    for n in range(1, ORDER + 1):
        ones, twos = np.sum([s[str(n)] for s in stats[min(n, 3) - 1]] or [[0, 0]], axis=0).tolist()
        meta["d"][str(n)] = ones / (ones + 2 * twos) if ones else 0.5
    meta["grams"] = list(chain.from_iterable(np.sum([s["grams"] for s in x] or [[0]], axis=0).tolist() for x in stats))
    meta["heads"], meta["tails"] = ([s["part"] for s in x] for x in stats[1:])
    meta["total"], meta["blocks"] = sum(s["total"] for s in stats[0]), [s["block"] for s in stats[0]]
    meta["bytes"] = sum(s["bytes"] for x in stats for s in x)
    return numbered, meta


def train(docs: DataFrame, text: str = "text") -> dict:
    """Train on every text of ``docs`` and write the model to a new folder of the shared one; what scoring needs to know of it.

    Null and empty texts add nothing. A corpus without text gives a model of
    the uniform distribution over the edge and the unknown symbol.
    """
    return _learnt(docs.withColumn("doc_id", F.lit(None).cast("long")), text)[1]


class Part:
    """The file of a part: its first contexts, then for each level the words that follow and the contexts one word longer, and the counts. ``d``: the discounts of its levels. A sequence that ``asked`` look-ups take longer to search than to decode is decoded as a whole."""

    def __init__(self, data: np.ndarray, d: list[float], asked: int = 0):
        n = int.from_bytes(data[:8].tobytes(), "little")
        words, at, arrays = data[8 + n :].view(np.uint64), 0, []
        for size in json.loads(data[8 : 8 + n].tobytes()):
            arrays.append(words[at : at + size])
            at += size
        self.d, split = d, len(arrays) - 2 * len(d)
        self.s, self.n = [EliasFano(x) for x in arrays[:split]], [Small(x) for x in arrays[split:]]
        self.s = [Plain(x) if asked * DECODED > len(x) else x for x in self.s]

    @staticmethod
    def _in_range(seq: EliasFano | Plain, lo: np.ndarray, hi: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Places of the symbols in ranges that are not empty, -1 where they are not there."""
        base, first = seq.both(np.maximum(lo - 1, 0)) if len(seq) > 1 else (seq.get(lo), seq.get(lo))
        zero = lo == 0
        key = np.where(zero, 0, base) + symbol
        first = np.where(zero, base, first)
        out = np.where(first == key, lo, -1)
        left = np.flatnonzero((first < key) & (hi - lo > 1))
        if left.size:
            lo, hi, key = lo[left] + 1, hi[left], key[left]
            if isinstance(seq, Plain):
                at = np.minimum(np.searchsorted(seq.v, key), hi - 1)
                out[left] = np.where(seq.v[at] == key, at, -1)
                return out
            wide = np.flatnonzero(hi - lo > SAMPLE)
            if wide.size:  # the whole sequence ascends, so every 64th value bounds the place
                near = np.searchsorted(seq.sampled(), key[wide]) * SAMPLE
                lo[wide], hi[wide] = np.maximum(lo[wide], near - SAMPLE), np.minimum(hi[wide], near + 1)
            out[left] = seq.find(key, lo, hi)
        return out

    def _smoothed(self, level: int, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Range of the words that follow each context, total of their counts and weight left to the context one word shorter."""
        lo, hi = self.s[1 + 4 * level].both(node)
        total = hi - lo + self.n[2 * level + 1].get(node)
        return lo, hi, total, self.d[level] * (hi - lo) / total

    def followers(self, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All words that follow contexts, in order: the place of the context (at the first level itself), the word (its place at the level below), and where each context's begin."""
        starts, value = self.s[1 + 4 * level].all(), self.s[2 + 4 * level].all()
        kinds = np.diff(starts)
        symbol = value - np.repeat(np.concatenate([[0], value[starts[1:-1] - 1]]), kinds)
        return np.repeat(np.arange(len(kinds)) if level else self.s[0].all(), kinds), symbol, starts

    def all(self, p, bits: int) -> np.ndarray:
        """Probabilities of all n-grams of the longest level, in order. ``p`` gives those of words after the last context word."""
        lower = below = parent = None
        for level, d in enumerate(self.d):
            context, symbol, starts = self.followers(level)
            lower = lower[below[parent[context]] + symbol] if level else p(context >> bits, symbol)
            kinds = np.diff(starts)
            total = kinds + self.n[2 * level + 1].get(np.arange(len(kinds)))
            lower = lower * np.repeat(d * kinds / total, kinds)
            lower += (1 + self.n[2 * level].get(np.arange(len(symbol))) - d) / np.repeat(total, kinds)
            if level + 1 < len(self.d):
                below = starts
                parent = np.repeat(np.arange(len(kinds)), np.diff(self.s[3 + 4 * level].all()))
        return lower

    def follow(self, p: np.ndarray, context: np.ndarray, further: list[np.ndarray], word: np.ndarray) -> np.ndarray:
        """``p`` of ``word`` without these contexts, refined by each that is in the model. Equal contexts side by side are looked up once."""
        p, runs = p.copy(), _starts(context)
        first, times = context[runs[:-1]], np.diff(runs)
        zero = np.zeros(len(first), np.int64)
        found = self._in_range(self.s[0], zero, zero + len(self.s[0]), first)
        live, times = np.flatnonzero(np.repeat(found >= 0, times)), times[found >= 0]
        node = found[found >= 0]
        of = [np.repeat(x, times) for x in self._smoothed(0, node)] if live.size else []
        node, symbol = np.repeat(node, times), word[live]
        for level in range(len(further) + 1):
            if not live.size:
                break
            lo, hi, total, weight = of if level == 0 else self._smoothed(level, node)
            there = np.flatnonzero(symbol >= 0)
            at = self._in_range(self.s[2 + 4 * level], lo[there], hi[there], symbol[there])
            p[live] *= weight
            hit = at >= 0
            there, at = there[hit], at[hit]
            p[live[there]] += (1 + self.n[2 * level].get(at) - self.d[level]) / total[there]
            if level < len(further):
                # what does not follow here follows no longer context
                symbol = np.full(len(live), -1, np.int64)
                symbol[there] = at - lo[there]
                node = self._in_range(self.s[4 + 4 * level], *self.s[3 + 4 * level].both(node), further[level][live])
                known = node >= 0
                live, node, symbol = live[known], node[known], symbol[known]
        return p


class Model:
    """The files of a model. They are mapped anew for each lot of texts, as their directories together would grow with the corpus."""

    def __init__(self, meta: dict):
        self.meta = meta
        self.vocabulary = Vocabulary(meta["folder"], meta["files"])
        self.d = meta["d"]["1"]
        self.there = {kind: set(meta[f"{kind}s"]) for kind in ("head", "tail")}

    def _opened(self, name: str, make):
        return make(open_mapped(f"{self.meta['folder']}/{name}"))

    def _unigrams(self, word: np.ndarray) -> np.ndarray:
        count, block = np.zeros(len(word), np.int64), word // BLOCK
        for b in self.meta["blocks"]:
            mine = np.flatnonzero(block == b)
            if mine.size:
                count[mine] = self._opened(f"{b}.unigrams", lambda x: x.view(np.int64))[word[mine] - b * BLOCK]
        uniform, total = 1.0 / self.meta["symbols"], self.meta["total"]
        return np.maximum(count - self.d, 0) / total + self.d * self.meta["grams"][0] / total * uniform if total else np.full(len(word), uniform)

    def probability(self, w: list[np.ndarray]) -> np.ndarray:
        """Of the last word of each n-gram after the others."""
        p = self.after_one(w[3], w[4])
        if not self.meta["total"]:
            return p
        return self._refined("tail", _part(w[3], _pair(w[3], w[2]), self.meta["parts"]), p, [w[3], w[2]], [w[1], w[0]], w[4])

    def after_one(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Of each word after the one before it."""
        bits = _bits(self.meta["files"])
        pairs, at = np.unique(_pair(context, word, bits), return_inverse=True)
        context, word = pairs >> bits, pairs & (1 << bits) - 1
        p = self._unigrams(word)
        if self.meta["total"]:
            p = self._refined("head", _part(context, context, self.meta["parts"]), p, [context], [], word)
        return p[at]

    def part(self, kind: str, k: int, asked: int = 0) -> Part:
        return self._opened(f"{k}.{kind}", lambda x: Part(x, [self.meta["d"][n] for n in {"head": "2", "tail": "345"}[kind]], asked))

    def _refined(self, kind: str, of: np.ndarray, p: np.ndarray, first: list[np.ndarray], further: list[np.ndarray], word: np.ndarray) -> np.ndarray:
        bits = _bits(self.meta["files"])
        order = np.argsort(_folded([(of, self.meta["parts"].bit_length()), *((x, bits) for x in first)]))
        context = _folded([(x, bits) for x in first])
        starts, out = _starts(of[order]), p.copy()
        for i, j in zip(starts, starts[1:]):
            mine = order[i:j]
            if (k := int(of[mine[0]])) in self.there[kind]:
                out[mine] = self.part(kind, k, len(mine)).follow(p[mine], context[mine], [x[mine] for x in further], word[mine])
        return out


@lru_cache(maxsize=1)
def _model(meta: str) -> Model:
    return Model(json.loads(meta))


def _scored(doc_id: pa.Array, size: np.ndarray, log: np.ndarray) -> pa.RecordBatch:
    none = size == 0
    perplexity = 10.0 ** (-log / np.maximum(size, 1))
    return pa.RecordBatch.from_arrays([doc_id, pa.array(size), pa.array(log, mask=none), pa.array(perplexity, mask=none)], ["doc_id", "n_symbols", "log10_prob", "perplexity"])


def _score_rows(meta: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(meta)
        for batch in batches:
            for part in slices(batch, "text", SCORED):
                w, size = _grams(part.column("text"), model.vocabulary)
                each = np.log10(model.probability(w)) if len(w[0]) else np.zeros(0)
                ends = np.concatenate([[0], np.cumsum(size)])
                total = np.concatenate([[0.0], np.cumsum(each)])
                yield _scored(part.column("doc_id"), size, total[ends[1:]] - total[ends[:-1]])

    return run


def score(docs: DataFrame, meta: dict, text: str = "text") -> DataFrame:
    """One row a document: ``doc_id``, ``n_symbols`` (words and the closing edge), ``log10_prob`` of the whole text, ``perplexity`` a symbol.

    Null and empty texts have 0 symbols and null scores; a null ``doc_id`` stays
    null; repeated rows are scored one by one. Other columns are not read. An
    empty table gives an empty result. No shuffle.
    """
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    return given.mapInArrow(_score_rows(json.dumps(meta)), _SCORES)


def _own_part(meta: str):
    """What the n-grams of a part add to each document. They are all of the model, so in order they are those of its file."""

    def run(key, table):
        model = _model(meta)
        bits, k = _bits(model.meta["files"]), key[0].as_py()
        *w, of, doc = _unpacked(table.column("blob").to_pylist(), ORDER + 2, np.int32)
        order, at = _by_context(w, bits)
        where = of[order].astype(np.int64) << 32 | doc[order]
        del w, of, doc, order
        p = np.log10(model.part("tail", k).all(model.after_one, bits))
        return pa.Table.from_batches([_sums(where, np.repeat(p, np.diff(at)))])

    return run


def _sums(key: np.ndarray, p: np.ndarray) -> pa.RecordBatch:
    """The sums of each document, in a row for each slice."""
    key, order, at = _distinct(key)
    p = np.add.reduceat(p[order], at[:-1])
    starts = _starts(key >> 32)
    sums = [(key[i:j] & 0xFFFFFFFF).astype(np.uint32).tobytes() + p[i:j].tobytes() for i, j in zip(starts, starts[1:])]
    return pa.RecordBatch.from_arrays([pa.array(key[starts[:-1]] >> 32, pa.int32()), pa.array(sums, pa.binary())], ["slice", "sums"])


def _read_sums(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    n = [len(b) // 12 for b in blobs]
    doc = [np.frombuffer(b, np.uint32, k) for b, k in zip(blobs, n)]
    return np.concatenate([np.zeros(0, np.int64), *doc]).astype(np.int64), np.concatenate([np.zeros(0), *(np.frombuffer(b, np.float64, k, 4 * k) for b, k in zip(blobs, n))])


def _added(key, table):
    doc, p = _read_sums(table.column("sums").to_pylist())
    return pa.Table.from_batches([_sums(key[0].as_py() << 32 | doc, p)])


def _finished(key, table):
    given = table.filter(pc.is_valid(table.column("size")))
    doc_id, size = (pc.list_flatten(given.column(x)).combine_chunks() for x in ("doc_id", "size"))
    size = size.to_numpy()
    doc, p = _read_sums(table.column("sums").drop_null().to_pylist())
    return pa.Table.from_batches([_scored(doc_id, size, np.bincount(doc, p, len(size)).astype(float))])


def own_scores(docs: DataFrame, text: str = "text") -> DataFrame:
    """What ``score(docs, train(docs))`` gives, without a search: the n-grams of the texts go to the parts once more, each with its document, and in order they are those of the part, whose probabilities are read off.

    Texts are split once. Sums of a document go from the parts to its slice, in
    as many rounds as the parts were made in.
    """
    spark = docs.sparkSession
    numbered, meta = _learnt(docs, text)
    bits, parts, rounds = _bits(meta["files"]), meta["parts"], meta["rounds"]
    told, sums = json.dumps(meta), []
    for now in range(rounds if meta["total"] else 0):
        asked = numbered.mapInArrow(_gram_rows(bits, parts, now, rounds, True), _SENT).groupBy("part")
        sums.append(cut(asked.applyInArrow(_own_part(told), _SUMS).groupBy("slice").applyInArrow(_added, _SUMS)))
        del asked
        released(spark)
    rows = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), [numbered.select("slice", "doc_id", "size"), *sums])
    if not sums:
        rows = rows.withColumn("sums", F.lit(None).cast("binary"))
    return rows.groupBy("slice").applyInArrow(_finished, _SCORES)
