"""Language-model scoring with a Kneser-Ney model in an Elias-Fano n-gram trie.

The model is over bytes, so every text in every script has a score and no word
is unknown. Counts of all n-grams come from the whole corpus: each task counts
what it reads and sends one row per distinct n-gram, Spark adds them up,
derives the lower orders, discounts and interpolates them with joins.

The trie is stored level by level. A node's children are a range of the next
level, and the starts of these ranges are one monotone sequence. The symbols of
a level are made monotone by adding to each range the last value of the range
before it; looking a symbol up under a context is then a successor search for
it, relative to the context's base, within the context's range. Both sequences are
Elias-Fano coded, probabilities and back-off weights are quantised to a byte.
Files lie in the shared folder, one for each range of first symbols, and are mapped by the workers.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docparity.llm.common import byte_lengths, cut, new_folder, open_mapped, slices, write_whole
from docparity.llm.elias_fano import EliasFano

ORDER = 5
BITS = 9
#: The symbol before and after every text; 0 to 255 are bytes.
EDGE = 256
SYMBOLS = 257
#: Nodes of a file of the trie, about; a first symbol is never split.
SHARD_NODES = 4_000_000
#: Scored n-grams a worker remembers; bounds memory, not results.
REMEMBERED = 2_000_000


def _grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the n-gram that ends at each symbol of each text (the closing edge included), and the symbols of each text; 0 for null and empty."""
    n = byte_lengths(column)
    live = np.flatnonzero(n)
    size = np.where(n > 0, n + 1, 0)
    if not live.size:
        return np.zeros(0, np.int64), size
    raw = column.take(pa.array(live)).cast(pa.large_binary())
    offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    data = np.frombuffer(raw.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    step = n[live] + ORDER  # ORDER - 1 edges, the bytes, one edge
    starts = np.cumsum(step) - step
    padded = np.full(int(step.sum()), EDGE, np.int64)
    at = np.repeat(starts + ORDER - 1 - (offsets[:-1] - offsets[0]), n[live]) + np.arange(len(data))
    padded[at] = data
    code = padded.copy()
    for k in range(1, ORDER):
        code[k:] |= padded[:-k] << (BITS * k)
    keep = np.ones(len(padded), bool)
    keep[(starts[:, None] + np.arange(ORDER - 1)).ravel()] = False
    return code[keep], size


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def merged() -> tuple[np.ndarray, np.ndarray]:
        codes, where = np.unique(np.concatenate([c for c, _ in held]), return_inverse=True)
        return codes, np.bincount(where, np.concatenate([n for _, n in held])).astype(np.int64)

    for batch in batches:
        for part in slices(batch, "text", 2 << 20):
            where, codes = pd.factorize(_grams(part.column("text"))[0])
            held.append((codes, np.bincount(where, minlength=len(codes))))
            if len(held) >= 8:
                held = [merged()]
    if held:
        codes, n = merged()
        yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(n)], ["code", "n"])


def _mask(n: int) -> int:
    return (1 << (BITS * n)) - 1


def probabilities(docs: DataFrame, text: str = "text") -> tuple[dict[int, DataFrame], float]:
    """Interpolated Kneser-Ney: for each order (code, p, backoff) of every n-gram and context, and the weight of the uniform distribution.

    ``p`` is null for contexts that are no n-grams themselves, ``backoff`` for n-grams that are no contexts.
    """
    tables = {ORDER: cut(docs.select(F.col(text).alias("text")).mapInArrow(_count_rows, "code long, n long").groupBy("code").agg(F.sum("n").alias("c")))}
    for n in range(ORDER - 1, 0, -1):
        tables[n] = cut(tables[n + 1].groupBy(F.col("code").bitwiseAND(_mask(n)).alias("code")).agg(F.count("*").alias("c")))
    probs: dict[int, DataFrame] = {}
    weights: dict[int, DataFrame] = {}
    uniform = 1.0
    for n in range(1, ORDER + 1):
        ones, twos = tables[n].agg(F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)).first()
        d = ones / (ones + 2 * twos) if ones else 0.5
        context = F.shiftright("code", BITS)
        sums = tables[n].groupBy(context.alias("h")).agg(F.sum("c").alias("total"), F.count("*").alias("kinds"))
        weight = F.lit(d) * F.col("kinds") / F.col("total")
        weights[n - 1] = sums.select(F.col("h").alias("code"), weight.alias("backoff"))
        own = tables[n].withColumn("h", context).join(sums, "h")
        if n == 1:
            uniform = weights[0].agg(F.max("backoff")).first()[0] or 1.0
            lower = own.withColumn("low", F.lit(1.0 / SYMBOLS))
        else:
            below = probs[n - 1].select(F.col("code").alias("suffix"), F.col("p").alias("low"))
            lower = own.withColumn("suffix", F.col("code").bitwiseAND(_mask(n - 1))).join(below, "suffix")
        probs[n] = cut(lower.select("code", (F.greatest(F.col("c") - d, F.lit(0.0)) / F.col("total") + weight * F.col("low")).alias("p")))
    out = {n: probs[n].join(weights[n], "code", "full") for n in range(1, ORDER)}
    out[ORDER] = probs[ORDER].withColumn("backoff", F.lit(None).cast("double"))
    return out, uniform


def build_levels(codes: dict[int, np.ndarray], probs: dict[int, np.ndarray], backoffs: dict[int, np.ndarray]) -> bytes:
    """The trie of sorted n-grams as one block of bytes. codes[n]: of all nodes of level n; every node's parent must be there."""
    arrays: list[np.ndarray] = []
    for n in range(1, ORDER + 1):
        code = codes[n]
        if n == 1:
            symbols = code
        else:
            parent = np.searchsorted(codes[n - 1], code >> BITS)
            symbol = code & 511
            first = np.flatnonzero(np.diff(parent, prepend=-1))
            last = np.append(first[1:], len(code)) - 1 if len(first) else first
            base = np.concatenate([[0], np.cumsum(symbol[last])[:-1]]) if len(first) else first
            symbols = symbol + np.repeat(base, np.diff(np.append(first, len(code)))) if len(first) else symbol
        arrays.append(EliasFano.build(symbols.astype(np.int64)))
        children = np.searchsorted(codes[n + 1] >> BITS, code) if n < ORDER else np.zeros(0, np.int64)
        arrays.append(EliasFano.build(np.append(children, len(codes[n + 1])).astype(np.int64) if n < ORDER else children))
        for q in (probs[n], backoffs[n]):
            arrays.append(np.frombuffer(q.astype(np.uint8).tobytes().ljust(-(-len(q) // 8) * 8, b"\0"), np.uint64))
    head = json.dumps([[int(n) for n in (len(codes[k]) for k in range(1, ORDER + 1))], [len(a) for a in arrays]]).encode()
    head = head.ljust(-(-len(head) // 8) * 8, b" ")
    return len(head).to_bytes(8, "little") + head + b"".join(a.tobytes() for a in arrays)


class Trie:
    """One file of the trie."""

    def __init__(self, data: np.ndarray):
        n = int.from_bytes(data[:8].tobytes(), "little")
        self.nodes, sizes = json.loads(data[8 : 8 + n].tobytes())
        words = data[8 + n :].view(np.uint64)
        self.symbols: dict[int, EliasFano] = {}
        self.children: dict[int, EliasFano] = {}
        self.p: dict[int, np.ndarray] = {}
        self.backoff: dict[int, np.ndarray] = {}
        at = 0
        for i, size in enumerate(sizes):
            level, part, kind = i // 4 + 1, words[at : at + size], i % 4
            at += size
            if kind < 2:
                (self.symbols, self.children)[kind][level] = EliasFano(part)
            else:
                (self.p, self.backoff)[kind - 2][level] = part.view(np.uint8)

    def find(self, code: np.ndarray, n: int) -> np.ndarray:
        """Place of each n-gram in level n, -1 if it is not there."""
        roots = self.symbols[1]
        symbol = code >> (BITS * (n - 1))
        zero = np.zeros(len(code), np.int64)
        at = roots.successor(symbol, zero, zero + len(roots))
        at[(at == len(roots)) | (roots.get(np.minimum(at, len(roots) - 1)) != symbol)] = -1
        for level in range(2, n + 1):
            live = np.flatnonzero(at >= 0)
            seq, where = self.symbols[level], at[live]
            at[live] = -1
            lo, hi = self.children[level - 1].get(where), self.children[level - 1].get(where + 1)
            some = lo < hi
            live, lo, hi = live[some], lo[some], hi[some]
            if not live.size:
                break
            base = np.where(lo > 0, seq.get(np.maximum(lo - 1, 0)), 0)
            key = base + ((code[live] >> (BITS * (n - level))) & 511)
            found = seq.successor(key, lo, hi)
            hit = found < hi
            hit[hit] = seq.get(found[hit]) == key[hit]
            at[live[hit]] = found[hit]
        return at


class Model:
    """The files of a model, opened when first asked for, with what was scored lately."""

    def __init__(self, meta: dict):
        self.meta = meta
        self.shard_of = np.array(meta["shard_of"])
        self.tries: dict[int, Trie] = {}
        self.known = np.zeros(0, np.int64)
        self.logs = np.zeros(0)

    def _trie(self, shard: int) -> Trie:
        if shard not in self.tries:
            self.tries[shard] = Trie(open_mapped(f"{self.meta['folder']}/{shard}.trie"))
        return self.tries[shard]

    def _value(self, kind: str, level: int, q: np.ndarray) -> np.ndarray:
        low, step = self.meta[kind][str(level)]
        return low + step * q

    def _look(self, code: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether each n-gram is in the model, its log10 probability and the log10 weight it has as a context."""
        found, p, weight = np.zeros(len(code), bool), np.zeros(len(code)), np.zeros(len(code))
        shard = self.shard_of[code >> (BITS * (n - 1))]
        for s in np.unique(shard[shard >= 0]):
            mine = np.flatnonzero(shard == s)
            at = self._trie(int(s)).find(code[mine], n)
            mine, at = mine[at >= 0], at[at >= 0]
            found[mine] = True
            p[mine] = self._value("p", n, self.tries[int(s)].p[n][at])
            if n < ORDER:
                weight[mine] = self._value("backoff", n, self.tries[int(s)].backoff[n][at])
        return found, p, weight

    def log10(self, code: np.ndarray) -> np.ndarray:
        """log10 of the probability of each n-gram's last symbol after the others: the longest n-gram in the model, times back-off weights."""
        out = np.zeros(len(code))
        left = np.arange(len(code))
        for n in range(ORDER, 0, -1):
            gram = code[left] & _mask(n)
            found, p, _ = self._look(gram, n)
            out[left[found]] += p[found]
            left = left[~found]
            if not left.size:
                return out
            if n > 1:
                out[left] += self._look(gram[~found] >> BITS, n - 1)[2]
        out[left] += np.log10(self.meta["uniform"] / SYMBOLS)
        return out

    def scored(self, code: np.ndarray) -> np.ndarray:
        """The same for distinct n-grams, remembered for the next call."""
        if len(self.known):
            at = np.minimum(np.searchsorted(self.known, code), len(self.known) - 1)
            hit = self.known[at] == code
        else:
            at, hit = np.zeros(len(code), np.int64), np.zeros(len(code), bool)
        out = np.empty(len(code))
        out[hit] = self.logs[at[hit]]
        if not hit.all():
            out[~hit] = new = self.log10(code[~hit])
            if len(self.known) < REMEMBERED:
                codes, logs = np.concatenate([self.known, code[~hit]]), np.concatenate([self.logs, new])
                order = np.argsort(codes)
                self.known, self.logs = codes[order], logs[order]
        return out


@lru_cache(maxsize=1)
def _model(meta: str) -> Model:
    return Model(json.loads(meta))


def _quantised(column: str, low: float, step: float):
    return F.round((F.coalesce(F.log10(column), F.lit(0.0)) - low) / (step or 1.0)).cast("int")


def train(docs: DataFrame, text: str = "text") -> dict:
    """Train on every text of ``docs`` and write the trie to a new folder of the shared one; what scoring needs to know of it.

    Null and empty texts add nothing. A corpus without text gives a model of
    the uniform distribution.
    """
    tables, uniform = probabilities(docs, text)
    folder = new_folder(docs.sparkSession, "ngram-lm")
    meta: dict = {"folder": folder, "uniform": uniform, "p": {}, "backoff": {}}
    nodes = None
    for n, table in tables.items():
        log = lambda c: F.coalesce(F.log10(c), F.lit(0.0))
        low_p, high_p, low_b, high_b = table.agg(F.min(log("p")), F.max(log("p")), F.min(log("backoff")), F.max(log("backoff"))).first()
        meta["p"][str(n)] = [low_p or 0.0, ((high_p or 0.0) - (low_p or 0.0)) / 255]
        meta["backoff"][str(n)] = [low_b or 0.0, ((high_b or 0.0) - (low_b or 0.0)) / 255]
        rows = table.select(
            F.lit(n).alias("level"), "code", _quantised("p", *meta["p"][str(n)]).alias("p"), _quantised("backoff", *meta["backoff"][str(n)]).alias("backoff"),
            F.shiftright("code", BITS * (n - 1)).cast("int").alias("first"),
        )
        nodes = rows if nodes is None else nodes.unionByName(rows)
    nodes = cut(nodes)
    per_symbol = dict(map(tuple, nodes.groupBy("first").count().collect()))
    shard_of, shard, size = [-1] * SYMBOLS, 0, 0
    for symbol in sorted(per_symbol):
        if size and size + per_symbol[symbol] > SHARD_NODES:
            shard, size = shard + 1, 0
        shard_of[symbol] = shard
        size += per_symbol[symbol]
    meta["shard_of"] = shard_of
    placed = nodes.withColumn("shard", F.element_at(F.array(*[F.lit(s) for s in shard_of]), F.col("first") + 1)).drop("first")

    def write(key, table):
        level, code, p, backoff = (table.column(c).to_numpy() for c in ("level", "code", "p", "backoff"))
        parts = {n: (c := code[(m := level == n)], np.argsort(c), m) for n in range(1, ORDER + 1)}
        block = build_levels(
            {n: c[o] for n, (c, o, _) in parts.items()}, {n: p[m][o] for n, (_, o, m) in parts.items()}, {n: backoff[m][o] for n, (_, o, m) in parts.items()}
        )
        size = write_whole(f"{folder}/{key[0].as_py()}.trie", iter([block]))
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "bytes": pa.array([size], pa.int64()), "nodes": pa.array([len(code)], pa.int64())})

    written = placed.groupBy("shard").applyInArrow(write, "shard int, bytes long, nodes long").collect()
    meta["bytes"], meta["nodes"] = sum(r["bytes"] for r in written), sum(r["nodes"] for r in written)
    return meta


def _score_rows(meta: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(meta)
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                code, size = _grams(part.column("text"))
                where, codes = pd.factorize(code)
                each = model.scored(codes)[where] if len(codes) else np.zeros(0)
                ends = np.concatenate([[0], np.cumsum(size)])
                total = np.concatenate([[0.0], np.cumsum(each)])
                log = total[ends[1:]] - total[ends[:-1]]
                none = size == 0
                perplexity = 10.0 ** (-log / np.maximum(size, 1))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(size), pa.array(log, mask=none), pa.array(perplexity, mask=none)], ["doc_id", "n_symbols", "log10_prob", "perplexity"]
                )

    return run


def score(docs: DataFrame, meta: dict, text: str = "text") -> DataFrame:
    """One row a document: ``doc_id``, ``n_symbols`` (bytes and the closing edge), ``log10_prob`` of the whole text, ``perplexity`` a symbol.

    Null and empty texts have 0 symbols and null scores; a null ``doc_id`` stays
    null; repeated rows are scored one by one. Other columns are not read. An
    empty table gives an empty result. No shuffle.
    """
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    return given.mapInArrow(_score_rows(json.dumps(meta)), "doc_id long, n_symbols long, log10_prob double, perplexity double")
