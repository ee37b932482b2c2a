"""Best-fit packing after Martello and Toth's dominance reduction.

Only lengths matter to a packing, and there are at most ``capacity`` of them:
the driver gets the number of pieces of each length, whatever the corpus, and
solves the packing over those counts.

1. Reduction.  For the longest piece left, a set of at most three pieces that
   contains it and dominates every other such set is fixed as a sequence for
   good: it alone if nothing fits beside it; with the longest piece that fits,
   if that fills the sequence or no third piece could ever fit; or with the
   best two if no fourth could fit and they dominate.  A rule that holds for
   one piece holds for all of its length, so it is applied as often as the
   counts allow, and repeated until nothing more can be fixed.
2. Best fit, longest first, for the remainder, on counts as well: sequences
   with equal room are kept as ranges.

The result is a list of runs: pieces of one length, of ranks a to a+m, go to
sequences q to q+m at one offset.  Pieces are ranked within their length in
hash buckets, so no task ever holds all pieces of a length.

Token ids come from a public tokenizer.  White space always separates its
tokens, so a worker remembers the ids of words and puts texts together from
them.

Defined results: a null or empty text is one piece with the end id alone;
repeated rows are packed each; an empty table gives no pieces; further columns
are ignored.
"""

from __future__ import annotations

import bisect
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .cluster import pick, settle

#: Tokens in a sequence, the id that ends a document, and the tokenizer's file.
CAPACITY, END, TOKENIZER = 4096, 1, "word_bpe_49k.json"
#: Parts into which the pieces of a length are split for ranking.
BUCKETS = 4096
#: Distinct words, and pieces of words, that a worker remembers, the longest of them, and characters handled at once.
REMEMBERED, LONGEST, BLOCK = 300_000, 64, 1 << 20

_RARE_BLANKS = re.compile("[\x1c-\x1f]")


#: Characters of the common part of the Latin script: below it lower case and composition are per character.
_LATIN = 0x180


def _class(test) -> str:
    return "".join(re.escape(chr(c)) for c in range(_LATIN) if test(chr(c)))


# The pieces into which this tokenizer cuts a word in lower case.
_PIECE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_class(str.isalpha)}]+|[{_class(str.isnumeric)}]|[^{_class(str.isalnum)}]+")
_PLAIN = re.compile(f"[^\x00-\u0129\u0131-{chr(_LATIN - 1)}]")


class Tokens(dict):
    """Token ids of whole texts as little-endian 32-bit bytes; as a dict, those of each word that it remembers.

    White space and pieces of words never share a token, so a word not seen
    before is cut into pieces, and only a piece not seen before meets the
    model's merges.  A word with rarer letters, or with one of the tokenizer's
    special tokens in it, is left to the tokenizer whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.special = re.compile("|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()) or r"(?!)")
        self.model = self.tokenizer.model
        self.as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.old: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.old_pieces: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        ids = self.pieces.get(piece)
        if ids is not None:
            return ids
        ids = self.old_pieces.get(piece)
        if ids is None:
            said = piece if piece.isascii() and piece.isprintable() else self.as_bytes.pre_tokenize_str(piece)[0][0]
            ids = b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(said)])
        if len(self.pieces) >= REMEMBERED:
            self.old_pieces, self.pieces = self.pieces, {}
        self.pieces[piece] = ids
        return ids

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = self._whole(word) if _PLAIN.search(word) or self.special.search(word) else b"".join(map(self._piece, _PIECE.findall(word.lower())))
        if len(word) <= LONGEST:
            if len(self) >= REMEMBERED:  # words in use come back from the old ones
                self.old = dict(self)
                self.clear()
            self[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if _RARE_BLANKS.search(text):  # blanks to Python, not to the tokenizer
            return self._whole(text)
        if len(text) <= BLOCK:
            return b"".join(map(self.__getitem__, text.split()))
        parts, at = [], 0
        while at < len(text):
            end = min(len(text), at + BLOCK)
            while end < len(text) and not text[end].isspace():
                end += 1
            parts.append(b"".join(map(self.__getitem__, text[at:end].split())))
            at = end
        return b"".join(parts)


_tokens: dict[str, Tokens] = {}


def tokens(path: str) -> Tokens:
    """One for each worker, so that later tasks know the words of earlier ones."""
    if path not in _tokens:
        _tokens[path] = Tokens(path)
    return _tokens[path]


def pieces(documents: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: every document's ids and the end id, cut only where it is longer than a sequence."""
    end = np.array([END], dtype="<u4").tobytes()

    def run(batches):
        encode = tokens(path).encode
        for batch in W.slices(batches, 1):
            out, rows = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                ids = encode(text or "") + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    rows.append(i)
                    out.append((k, at // 4, len(own) // 4, zlib.crc32(own)))
            columns = [batch.column(0).take(pa.array(rows, pa.int64()))] + [pa.array([x[j] for x in out], t) for j, t in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])

    docs = pick(documents, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


class Packing:
    """Runs of pieces in sequences, for given counts of each length."""

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY):
        self.capacity = capacity
        self.left = {s: n for s, n in counts.items() if n}
        self.sizes = sorted(self.left)
        self.rank: dict[int, int] = defaultdict(int)
        self.sequences = 0
        self.fixed = 0
        self.runs: list[tuple[int, int, int, int, int]] = []  # length, first rank, how many, first sequence, offset
        self._reduce()
        self._best_fit()

    def _take(self, size: int, n: int) -> int:
        first = self.rank[size]
        self.rank[size] += n
        self.left[size] -= n
        if not self.left[size]:
            del self.left[size]
            self.sizes.pop(bisect.bisect_left(self.sizes, size))
        return first

    def _open(self, chosen: list[int], n: int) -> int:
        """n new sequences, each with these pieces in this order."""
        first, self.sequences, offset = self.sequences, self.sequences + n, 0
        for size in chosen:
            self.runs.append((size, self._take(size, n), n, first, offset))
            offset += size
        return first

    # -- reduction

    def _count(self, size: int, used: list[int]) -> int:
        return self.left.get(size, 0) - used.count(size)

    def _smallest(self, used: list[int], how_many: int) -> list[int]:
        out: list[int] = []
        for s in self.sizes:
            out += [s] * min(self._count(s, used), how_many - len(out))
            if len(out) == how_many:
                break
        return out

    def _largest(self, room: int, used: list[int]) -> int | None:
        i = bisect.bisect_right(self.sizes, room) - 1
        while i >= 0 and self._count(self.sizes[i], used) <= 0:
            i -= 1
        return self.sizes[i] if i >= 0 else None

    def _best_pair(self, room: int, used: list[int]) -> tuple[int, int] | None:
        """The two pieces that together fill most of the room, larger first; of equal pairs the one with the largest piece."""
        best, found, low = -1, None, 0
        for a in reversed(self.sizes[: bisect.bisect_right(self.sizes, room)]):
            if self._count(a, used) <= 0:
                continue
            b = self._largest(min(room - a, a), [*used, a])
            if b is not None and a + b > best:
                best, found = a + b, (a, b)
            if 2 * a <= best:
                break
        return found

    def _dominating(self, j: int) -> list[int] | None:
        """A set with one piece of length j that dominates every other, if one is known."""
        room = self.capacity - j
        small = self._smallest([j], 3)
        if not small or small[0] > room:
            return [j]
        top = self._largest(room, [j])
        if top == room or len(small) < 2 or small[0] + small[1] > room:
            return [j, top]
        if len(small) < 3 or sum(small) > room:
            a, b = self._best_pair(room, [j])
            if top >= a + b:
                return [j, top]
            if top == a:
                between: list[int] = []
                for s in self.sizes[bisect.bisect_right(self.sizes, b) :]:
                    between += [s] * min(self._count(s, [j, a]), 2 - len(between))
                    if len(between) == 2:
                        break
                if len(between) < 2 or sum(between) > room:
                    return [j, a, b]
        return None

    def _reduce(self) -> None:
        changed = True
        while changed:
            changed = False
            for j in sorted(self.left, reverse=True):
                while self.left.get(j, 0) and (chosen := self._dominating(j)):
                    n = min(self.left[s] // chosen.count(s) for s in chosen)
                    self._open(chosen, n)
                    self.fixed += n
                    changed = True

    # -- best fit

    def _best_fit(self) -> None:
        rooms: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room: ranges of sequences
        keys: list[int] = []

        def put(room: int, first: int, n: int) -> None:
            if room and n:
                if not rooms[room]:
                    bisect.insort(keys, room)
                rooms[room].append((first, n))

        for size in sorted(self.left, reverse=True):
            while self.left.get(size, 0):
                i = bisect.bisect_left(keys, size)
                if i < len(keys):
                    room = keys[i]
                    first, n = rooms[room].pop()
                    if not rooms[room]:
                        keys.pop(i)
                    take = min(n, self.left[size])
                    self.runs.append((size, self._take(size, take), take, first, self.capacity - room))
                    put(room, first + take, n - take)
                    put(room - size, first, take)
                    continue
                each = min(self.capacity // size, self.left[size])
                n = self.left[size] // each
                put(self.capacity - each * size, self._open([size] * each, n), n)


def pack(documents: DataFrame, path: str, capacity: int = CAPACITY, buckets: int = BUCKETS) -> DataFrame:
    """Every piece and its place: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    cut = settle(pieces(documents, path, capacity).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int")))
    by_bucket = cut.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["length"]: r["n"] for r in by_bucket.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # one row for each length
    runs = sorted(Packing(counts, capacity).runs)
    sent = cut.sparkSession.sparkContext.broadcast(np.array(runs, dtype=np.int64).reshape(-1, 5))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = by_bucket.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    own = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = cut.withColumn("place", F.row_number().over(own) - 1).join(before, ["length", "bucket"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("place")).alias("rank"))

    def run(batches):
        table = sent.value
        keys = (table[:, 0] << 44) + table[:, 1]
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            at = np.searchsorted(keys, (length << 44) + rank, side="right") - 1
            columns = [batch.column(i) for i in range(5)] + [pa.array(table[at, 3] + rank - table[at, 1]), pa.array(table[at, 4])]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
