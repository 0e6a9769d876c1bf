"""SentencePiece encoding and decoding by a forward pass shared over common prefixes.

White space is marked and the text falls into marked words, which no piece
crosses. The distinct words of a slice of the corpus are sorted, which lists a
trie depth-first: going from one word to the next keeps the forward states of
their common prefix and computes those of the rest. A forward state holds

* for a unigram model the best score of a segmentation of the prefix and its last piece,
* for a BPE model the last piece of the prefix's encoding. The scores of such a
  model are merge priorities and the segmentation with the best sum is not the
  model's; but the encoding of a prefix is that of a shorter prefix and one
  more piece, and that piece is the one which stays apart from its left
  neighbour when the two are merged by priority. So the same pass over the
  same states gives the model's own ids.

Words fall apart further at places that no piece covers, between a letter and a
mark that are neighbours in none. Such fragments are looked up once found;
occurrences are told apart and gathered with arrays.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docparity.llm.common import slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Bytes of text a worker encodes at once.
SLICE = 4 << 20
#: Distinct fragments of words a worker remembers; bounds memory, not results.
REMEMBERED = 300_000
#: Pairs of pieces of which a worker remembers whether they stay apart; the same.
APART = 400_000
_LETTER = "[A-Za-zÀ-ÖØ-öø-ɏ]"
_NORMAL, _UNKNOWN, _USER, _BYTE = 1, 2, 4, 6
#: Bits of a symbol in a pair: ids, then letters.
_BITS = 22
UNIGRAM, BPE = 1, 2


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of each field of a protobuf message: int, 4 or 8 raw bytes, or bytes."""
    i = 0

    def varint() -> int:
        nonlocal i
        value = shift = 0
        while True:
            b = data[i]
            i += 1
            value |= (b & 0x7F) << shift
            shift += 7
            if b < 0x80:
                return value

    while i < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind) or varint()
        yield key >> 3, data[i : i + size]
        i += size


class Model:
    """Pieces and settings of a model file, with the shared-prefix encoder."""

    def __init__(self, data: bytes):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.types: list[int] = []
        trainer, normalizer = {}, {}
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece.get(1, b"").decode())
                self.scores.append(float(np.frombuffer(piece.get(2, b"\0" * 4), "<f4")[0]))
                self.types.append(piece.get(3, _NORMAL))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normalizer = dict(_fields(value))
        self.kind = trainer.get(3, UNIGRAM)
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models have segmentations to search")
        self.user = {p: i for i, (p, t) in enumerate(zip(self.pieces, self.types)) if t == _USER}
        if self.user and (self.kind != BPE or any(" " in p or MARK in p for p in self.user)):
            raise ValueError("user-defined pieces are supported in BPE models only, and without white space")
        if normalizer.get(2) or trainer.get(24):
            raise ValueError("models with a normalization table or marks at word ends are not supported")
        self.dummy_prefix = bool(normalizer.get(3, 1))
        self.squeeze = bool(normalizer.get(4, 1))
        self.byte_fallback = bool(trainer.get(35, 0))
        self.ids = {p: i for i, (p, t) in enumerate(zip(self.pieces, self.types)) if t == _NORMAL}
        self.bytes = {int(p[3:5], 16): i for i, (p, t) in enumerate(zip(self.pieces, self.types)) if t == _BYTE}
        self.unknown = self.types.index(_UNKNOWN)
        self.longest = max(map(len, self.ids))
        self.unknown_score = min(self.scores[i] for i in self.ids.values()) - 10.0
        letters = {c for p in self.ids for c in p}
        self.alphabet = letters
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("pieces go across words")
        # a line end in no piece stands alone, so lines can be cut there as well, unless unknown letters next to it were one with it
        self.splitter = re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n" if "\n" not in letters and self.byte_fallback else f"{MARK}+[^{MARK}]*|[^{MARK}]+")
        # user-defined pieces stand alone, the longest first; a letter and a mark that are neighbours in no piece are never merged
        self._user = re.compile("(" + "|".join(map(re.escape, sorted(self.user, key=len, reverse=True))) + ")") if self.user else None
        spans = {p[i + 1] for p in self.ids for i in range(len(p) - 1) if re.match(_LETTER, p[i])}
        apart = "".join(sorted(c for c in letters if c.isascii() and not c.isalnum() and not c.isspace() and c not in spans))
        self.cut = f"({_LETTER})([{re.escape(apart)}])" if apart else None
        # no two pieces but runs of marks may have one score: then merges have one order
        seen: dict[float, str] = {}
        self.ties = {s for s in (self.scores[i] for p, i in self.ids.items() if len(p) > 1) if s in seen or seen.setdefault(s, "x") is None}
        self._rank = {p: self.scores[i] for p, i in self.ids.items()}
        self._apart: dict[int, bool] = {}
        # lengths, longest first, of the pieces that end in given three letters, or in given two where no longer one ends so
        ending: dict[str, set[int]] = {}
        for p in self.ids:
            ending.setdefault(p[-3:], set()).add(len(p))
        for e, x in ending.items():
            x |= {n for n in (1, 2) if e[-n:] in self.ids}
        self._ending = {e: sorted(x, reverse=True) for e, x in ending.items()}
        self._length = [len(p) for p in self.pieces]
        self._raw: list[bytes] = []
        for p, t in zip(self.pieces, self.types):
            self._raw.append(bytes([int(p[3:5], 16)]) if t == _BYTE else b"" if t == 3 else " ⁇ ".encode() if t == _UNKNOWN else p.replace(MARK, " ").encode())

    # --- merging by priority: the definition of BPE, used to tell whether two pieces stay apart ---

    def merged(self, word: str) -> list[str]:
        """Symbols of a word after all merges, best score first, the leftmost of equal ones."""
        if len(word) <= 40:
            return self._merged_short(list(word))
        parts: list[str | None] = list(word)
        after = list(range(1, len(parts) + 1))
        before = list(range(-1, len(parts) - 1))
        heap: list[tuple[float, int, int, str]] = []

        def offer(i: int, j: int) -> None:
            if 0 <= i and j < len(parts):
                both = parts[i] + parts[j]
                if (k := self.ids.get(both)) is not None:
                    heapq.heappush(heap, (-self.scores[k], i, j, both))

        for i in range(len(parts) - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, both = heapq.heappop(heap)
            if parts[i] is None or parts[j] is None or after[i] != j or parts[i] + parts[j] != both:
                continue
            parts[i], parts[j] = both, None
            after[i] = after[j]
            if after[i] < len(parts):
                before[after[i]] = i
            offer(before[i], i)
            offer(i, after[i])
        return [p for p in parts if p is not None]

    def _merged_short(self, parts: list[str]) -> list[str]:
        """The same by looking for the best pair again after each merge; quicker for a few symbols."""
        rank = self._rank
        ranks = [rank.get(a + b) for a, b in zip(parts, parts[1:])]
        while True:
            best, at = None, -1
            for i, r in enumerate(ranks):
                if r is not None and (best is None or r > best):
                    best, at = r, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del ranks[at]
            if at < len(ranks):
                ranks[at] = rank.get(parts[at] + parts[at + 1])
            if at:
                ranks[at - 1] = rank.get(parts[at - 1] + parts[at])

    def _stay_apart(self, left: int, right: int) -> bool:
        """Whether the merges of the text of two symbols end in these two; ``left`` is -1 where nothing stands there."""
        if len(self._apart) > APART:
            self._apart.clear()
        a, b = self._text(left), self._text(right)
        found = self._apart[left << _BITS | right] = self.merged(a + b) == ([a, b] if a else [b])
        return found

    def _text(self, symbol: int) -> str:
        return "" if symbol < 0 else self.pieces[symbol] if symbol < len(self.pieces) else chr(symbol - len(self.pieces))

    # --- the forward pass ---

    def _bpe_extend(self, word: str, last: list[int]) -> None:
        """Append the last symbol of the encoding of each prefix of ``word`` that is longer than those in ``last``: a piece's id, or a letter that is no piece behind all ids."""
        apart, ids, ending = self._apart.get, self.ids.get, self._ending.get
        for i in range(len(last), len(word) + 1):
            lengths = ending(word[i - 3 : i]) if i > 2 else None
            for n in lengths or ending(word[i - 2 : i] if i > 1 else word[:i]) or ending(word[i - 1 : i], ()):
                start = i - n
                if start >= 0 and (k := ids(word[start:i])) is not None:
                    left = last[start]
                    ok = apart(left << _BITS | k)
                    if ok or ok is None and self._stay_apart(left, k):
                        last.append(k)
                        break
            else:
                last.append(len(self.pieces) + ord(word[i - 1]))

    def _unigram_step(self, word: str, i: int, state: list[tuple[float, int]]) -> tuple[float, int]:
        """Best score of a segmentation of ``word[:i]`` and the start of its last piece; of equal scores the longest piece."""
        best, at = -np.inf, i - 1
        for start in range(max(0, i - self.longest), i):
            k = self.ids.get(word[start:i])
            if k is not None and (s := state[start][0] + self.scores[k]) > best:
                best, at = s, start
        if word[i - 1 : i] not in self.ids and (s := state[i - 1][0] + self.unknown_score) > best:
            best, at = s, i - 1
        return best, at

    def segmented(self, words: list[str]) -> dict[str, list[str]]:
        """Pieces of each word. Sorting lists the trie of the words depth-first; states of common prefixes are kept."""
        out: dict[str, list[str]] = {}
        bpe, lengths, n_pieces = self.kind == BPE, self._length, len(self.pieces)
        before, state = "", [-1 if bpe else (0.0, 0)]
        for word in sorted(words):
            if word in self.user:
                out[word] = [word]
                continue
            if bpe and word[:2] == MARK * 2:  # runs of marks share one score: their merges depend on the order
                out[word] = self.merged(word)
                continue
            same = 0
            for a, b in zip(before, word):
                if a != b:
                    break
                same += 1
            del state[same + 1 :]
            if bpe:
                self._bpe_extend(word, state)
            else:
                for i in range(same + 1, len(word) + 1):
                    state.append(self._unigram_step(word, i, state))
            before = word
            found, i = [], len(word)
            while i:
                start = state[i][1] if not bpe else i - lengths[k] if (k := state[i]) < n_pieces else i - 1
                found.append(word[start:i])
                i = start
            out[word] = found[::-1]
        return out

    def piece_ids(self, pieces: list[str]) -> list[int]:
        try:
            return [self.ids[p] for p in pieces]
        except KeyError:
            pass
        out: list[int] = []
        was_unknown = False
        for p in pieces:
            k = self.ids.get(p, self.user.get(p))
            if k is not None:
                out.append(k)
            elif self.byte_fallback:
                out += [self.bytes[b] for b in p.encode()]
            elif not was_unknown:
                out.append(self.unknown)
            was_unknown = k is None
        return out

    def words(self, text: str) -> list[str]:
        """Marked words of a text. A mark in the text itself counts as a space, as it does in the model's own library."""
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return []
        return self.split((MARK + text if self.dummy_prefix else text).replace(" ", MARK))

    def split(self, marked: str) -> list[str]:
        """Marked words and user-defined pieces of marked text."""
        if self._user is None or not self._user.search(marked):
            return self.splitter.findall(marked)
        return [w for x in self._user.split(marked) if x for w in ([x] if x in self.user else self.splitter.findall(x))]

    def decode(self, ids: list[int] | np.ndarray) -> str:
        """Text of a sequence of ids; bytes that are no UTF-8 become U+FFFD, one each as the model's own library does."""
        raw = self._raw
        out = b"".join([raw[i] for i in ids])
        text = out.decode("utf-8", "replace")
        return text[1:] if self.dummy_prefix and text[:1] == " " else text


class Decoder:
    """Texts of whole columns of ids: the pieces' bytes are taken one after the other into one buffer."""

    def __init__(self, model: Model):
        self.model = model
        raw = model._raw
        # a second set for the first piece of a text, without the space the model puts there
        first = [r[1:] if model.dummy_prefix and r[:1] == b" " else r for r in raw]
        self.raw = pa.array(raw + first, pa.large_binary())
        self.empty = np.array([not r for r in raw])

    def decode(self, column: pa.ListArray) -> pa.Array:
        offsets = column.offsets.to_numpy().astype(np.int64)
        ids = column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]].astype(np.int64)
        offsets = offsets - offsets[0]
        starts = offsets[:-1][np.diff(offsets) > 0]
        if not column.null_count and not self.empty[ids[starts]].any():
            ids[starts] += len(self.empty)
            out = self.raw.take(pa.array(ids))
            ends = np.frombuffer(out.buffers()[1], np.int64)[out.offset : out.offset + len(out) + 1][offsets]
            text = pa.Array.from_buffers(pa.large_string(), len(column), [None, pa.py_buffer(ends), out.buffers()[2] or pa.py_buffer(b"")])
            try:
                text.validate(full=True)
                return text.cast(pa.string())
            except pa.ArrowInvalid:  # bytes that are no UTF-8
                pass
        return pa.array([None if x is None else self.model.decode(x) for x in column.to_pylist()], pa.string())


@lru_cache(maxsize=4)
def load(path: str) -> Model:
    with open(path, "rb") as f:
        return Model(f.read())


def _gathered(flat: np.ndarray, size: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of the entries ``code`` of a list of lists one after the other, and where each entry's begin and the last ends."""
    start, n = np.cumsum(size) - size, size[code]
    ends = np.concatenate([[0], np.cumsum(n)])
    return flat[np.repeat(start[code] - ends[:-1], n) + np.arange(ends[-1])], ends


class Encoder:
    """Ids of whole columns; remembers the fragments of words it has met."""

    def __init__(self, model: Model):
        self.model = model
        self.place: dict[str, int] = {}
        self.flat = np.zeros(0, np.int32)
        self.size = np.zeros(0, np.int64)

    def _learn(self, fragments: list[str]) -> None:
        pieces = self.model.segmented(fragments)
        ids = [self.model.piece_ids(pieces[f]) for f in fragments]
        self.place.update(zip(fragments, range(len(self.place), len(self.place) + len(fragments))))
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(ids), np.int32)])
        self.size = np.concatenate([self.size, np.array([len(x) for x in ids], np.int64)])

    def _units(self, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct fragments; those of distinct units as places in them, and how many each unit has; the units of all texts as places, and how many each text has.

        A text with single spaces falls into units at these; they fall into fragments at line ends and
        where :attr:`Model.cut` says. In other texts each word the model's expression finds is a unit and a fragment.
        """
        model = self.model
        if model.dummy_prefix and not model.user:
            odd = pc.fill_null(pc.match_substring_regex(column, f"^$|^ |  | $|{MARK}|\\x00"), True).to_numpy(zero_copy_only=False)
        else:
            odd = np.ones(len(column), bool)
        split = pc.split_pattern(column.filter(pa.array(~odd)), " ")
        coded = pc.list_flatten(split).dictionary_encode()
        code, n = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.zeros(len(column), np.int64)
        n[~odd] = pc.list_value_length(split).to_numpy(zero_copy_only=False)
        units = pc.binary_join_element_wise(MARK, coded.dictionary, "")
        if model.byte_fallback and "\n" not in model.alphabet:
            units = pc.replace_substring(units, "\n", "\0\n\0")
        if model.cut:
            units = pc.replace_substring_regex(units, model.cut, "\\1\0\\2")
        split = pc.split_pattern(units, "\0")
        flat = pc.list_flatten(split)
        there = pc.greater(pc.binary_length(flat), 0)
        coded = flat.filter(there).dictionary_encode()
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))])
        size = np.diff(np.concatenate([[0], np.cumsum(there.to_numpy(zero_copy_only=False))])[ends])
        names, part = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        if odd.any():
            words = [model.words(t) if t else [] for t in column.filter(pa.array(odd)).to_pylist()]
            own: dict[str, int] = {}
            more = np.fromiter((own.setdefault(w, len(own)) for x in words for w in x), np.int64) + len(size)
            n[odd] = [len(x) for x in words]
            both, where = np.empty(len(code) + len(more), np.int64), np.repeat(odd, n)
            both[where], both[~where] = more, code
            code, size, part = both, np.concatenate([size, np.ones(len(own), np.int64)]), np.concatenate([part, len(names) + np.arange(len(own))])
            names += own
        return names, part, size, code, n

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array, and the number for each text; none for null."""
        names, part, n_parts, code, n_units = self._units(column)
        new = list(dict.fromkeys(f for f in names if f not in self.place))
        known, flat_known = len(self.place), len(self.flat)
        self._learn(new)
        place = np.fromiter(map(self.place.__getitem__, names), np.int64, len(names))
        flat, ends = _gathered(self.flat, self.size, place[part])
        flat, ends = _gathered(flat, np.diff(ends[np.concatenate([[0], np.cumsum(n_parts)])]), code)
        if len(self.place) > REMEMBERED:  # what is full forgets the latest words, as rare ones come late
            for f in new:
                del self.place[f]
            self.flat, self.size = self.flat[:flat_known], self.size[:known]
        return flat, np.diff(ends[np.concatenate([[0], np.cumsum(n_units)])])


@lru_cache(maxsize=1)
def _encoder(path: str) -> Encoder:
    """One for each worker process, whatever number of tasks it runs."""
    return Encoder(load(path))


def _encode_rows(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                flat, sizes = encoder.encode(part.column("text"))
                ends = np.concatenate([[0], np.cumsum(sizes)])
                gone = pc.is_null(part.column("text")).to_numpy(zero_copy_only=False)
                offsets = pa.array(ends.astype(np.int32), mask=np.append(gone, False))
                ids = pa.ListArray.from_arrays(offsets, pa.array(flat))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids], ["doc_id", "ids"])

    return run


def _decode_rows(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(load(path))
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                part = batch.slice(lo, 200)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("ids"), decoder.decode(part.column("ids"))], ["doc_id", "ids", "decoded"])

    return run


def encode(docs: DataFrame, model: str = MODEL, text: str = "text") -> DataFrame:
    """(doc_id, ids): the model's piece ids of each whole text.

    A null text gives null, an empty one []. A null ``doc_id`` stays null;
    repeated rows are encoded one by one. Only ``doc_id`` and the text are read.
    An empty table gives an empty result. No shuffle.
    """
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    return given.mapInArrow(_encode_rows(model), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """``encoded`` (doc_id, ids) with ``decoded``, the text of the ids; null for null, "" for []."""
    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(_decode_rows(model), "doc_id long, ids array<int>, decoded string")
