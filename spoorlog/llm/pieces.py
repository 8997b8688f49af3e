"""SentencePiece encoding with seeded merge-dropout, and decoding.

The model's vocabulary and scores come from its file, whose path is a parameter;
nothing is trained. A text is cut into units, a run of spaces with the word
behind it, which no piece crosses. In each unit the best-scored neighbours merge
first, leftmost on ties. A candidate merge that comes to the front is skipped if
a hash of seed, document, copy, place, unit and the two spans falls below
``dropout``; a skipped candidate never returns. So each occurrence of a unit, in
each copy of a document, has draws of its own. The model's own segmentation of a
unit is found once a block and serves the occurrences whose draws skip none of
its merges; the others merge for themselves. Dropout 0 gives the model's own
segmentation.

Nothing is normalised: characters outside the vocabulary, and the space mark
itself, become byte pieces, and a space put before the text goes again, so
decoding returns every text exactly. Short units merge side by side as arrays,
one candidate of each unit a round; long ones through a heap. Both give the same
pieces. Null and empty texts have no pieces. Rows are independent.
"""

from __future__ import annotations

import hashlib
import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spoorlog.llm.words import TABLE, blocks, documents, mix, span_hashes

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
SHORT = 48
NEVER = np.int64(1) << np.int64(62)
BYTE = -1
WORD = (1 << 64) - 1


class Vocabulary:
    """Pieces, merges in order of score, and byte pieces of a model file."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        normal = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        ids = {model.id_to_piece(i): i for i in normal}
        if any(a != MARK and b == MARK for p in ids for a, b in zip(p, p[1:], strict=False)):
            raise ValueError("pieces across words are not supported")
        self.size = n
        self.bytes = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        self.single = np.full(TABLE, BYTE, np.int32)
        self.far = {}
        for piece, i in ids.items():
            if len(piece) == 1:
                if ord(piece) < TABLE:
                    self.single[ord(piece)] = i
                else:
                    self.far[ord(piece)] = i
        self.single[ord(" ")], self.single[ord(MARK)] = ids[MARK], BYTE
        by_score = sorted((i for p, i in ids.items() if len(p) > 1), key=lambda i: (-model.get_score(i), i))
        place = {i: k for k, i in enumerate(by_score)}
        self.piece_of = np.array(by_score, np.int32)  # by place
        merges = {}
        for piece, i in ids.items():
            for cut in range(1, len(piece)):
                left, right = ids.get(piece[:cut]), ids.get(piece[cut:])
                if left is not None and right is not None:
                    merges[left * n + right] = place[i]
        self.merges = merges
        self.keys = np.array(sorted(merges), np.int64)
        self.places = np.array([merges[k] for k in self.keys.tolist()], np.int64)
        spelled = [b""] * n
        for piece, i in ids.items():
            spelled[i] = piece.replace(MARK, " ").encode()
        for b, i in enumerate(self.bytes.tolist()):
            spelled[i] = bytes([b])
        self.spelled = np.frombuffer(b"".join(spelled), np.uint8)
        self.spell_at = np.concatenate(([0], np.cumsum([len(s) for s in spelled])))

    def symbols(self, codes: np.ndarray) -> np.ndarray:
        """The piece of each code point, BYTE if none."""
        out = self.single[np.minimum(codes, TABLE - 1)]
        beyond = np.flatnonzero(codes >= TABLE - 1)
        out[beyond] = [self.far.get(int(c), BYTE) for c in codes[beyond]]
        return out

    def place(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Place in the order of merges of each pair, NEVER if they do not merge."""
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.places[at], NEVER)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def dropped(key: np.ndarray, left: np.ndarray, middle: np.ndarray, right: np.ndarray, dropout: float) -> np.ndarray:
    """Whether the merge of [left, middle) and [middle, right) of a unit is skipped."""
    spans = left.astype(np.uint64) | (middle.astype(np.uint64) << np.uint64(21)) | (right.astype(np.uint64) << np.uint64(42))
    return (mix(key ^ mix(spans)) >> np.uint64(11)).astype(np.float64) < dropout * float(1 << 53)


def skipped(key: int, left: int, middle: int, right: int, dropout: float) -> bool:
    """``dropped`` for one merge."""
    x = left | middle << 21 | right << 42
    for _ in range(2):  # mix, twice
        x &= WORD
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & WORD
        x = (x ^ x >> 27) * 0x94D049BB133111EB & WORD
        x = x ^ x >> 31 ^ key
    return (x ^ key) >> 11 < dropout * float(1 << 53)


def agenda(vocab: Vocabulary, symbols: np.ndarray, key: np.uint64, dropout: float, log: list | None = None) -> tuple[list[int], list[int]]:
    """Piece and start of each symbol left in one unit, merging through a heap; ``log`` takes the merges' spans."""
    n, key = len(symbols), int(key)
    piece, after, before = symbols.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
    alive, heap = [True] * n, []

    def push(i: int) -> None:
        j = after[i]
        if i >= 0 and j < n and piece[i] >= 0 and piece[j] >= 0:
            place = vocab.merges.get(piece[i] * vocab.size + piece[j])
            if place is not None:
                heapq.heappush(heap, (place, i, j, after[j]))

    for i in range(n - 1):
        push(i)
    while heap:
        place, i, j, end = heapq.heappop(heap)
        if not (alive[i] and j < n and alive[j] and after[i] == j and after[j] == end):
            continue
        if dropout and skipped(key, i, j, end, dropout):
            continue
        if log is not None:
            log.append((i, j, end))
        piece[i], after[i], alive[j] = int(vocab.piece_of[place]), end, False
        if end < n:
            before[end] = i
        if before[i] >= 0:
            push(before[i])
        push(i)
    left = [i for i in range(n) if alive[i]]
    return [piece[i] for i in left], left


def merge_all(vocab: Vocabulary, symbols: np.ndarray, starts: np.ndarray, keys: np.ndarray, dropout: float,
              log: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Merge many short units at once; gives pieces by place and which places are left.

    ``symbols`` holds the units one after another, ``starts`` where each begins;
    ``log`` takes arrays of (unit, left, middle, right) of the merges.
    """
    n = len(symbols)
    sizes = np.diff(np.append(starts, n))
    unit = np.repeat(np.arange(len(starts)), sizes)
    piece, alive = symbols.copy(), np.ones(n, bool)
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    first, end = starts[unit], (starts + sizes)[unit]
    before[starts] = -1
    rank = np.full(n, NEVER)

    def refresh(i: np.ndarray) -> None:
        j = after[i]
        ok = j < end[i]
        i, j = i[ok], j[ok]
        place = vocab.place(piece[i], piece[j])
        live = np.flatnonzero(place < NEVER)
        if dropout and len(live):
            a, b = i[live], j[live]
            base = first[a]
            skip = dropped(keys[unit[a]], a - base, b - base, after[b] - base, dropout)
            place[live[skip]] = NEVER
        rank[i] = np.where(place < NEVER, (place << np.int64(32)) | i, NEVER)

    refresh(np.arange(n))
    active_starts = starts
    while n:
        best = np.minimum.reduceat(rank, active_starts)
        best = best[best < NEVER]
        if not len(best):
            break
        i = best & np.int64(0xFFFFFFFF)
        j = after[i]
        if log is not None:
            log.append(np.stack((unit[i], i - first[i], j - first[i], after[j] - first[i])))
        piece[i] = vocab.piece_of[best >> np.int64(32)]
        after[i] = after[j]
        alive[j] = False
        rank[j] = NEVER
        rank[i] = NEVER
        inner = after[i] < end[i]
        before[after[i][inner]] = i[inner]
        left = before[i]
        left = left[left >= 0]
        rank[left] = NEVER
        refresh(np.concatenate((i, left)))
    return piece, alive


class Encoder:
    """Texts to pieces and back; the same arguments always give the same pieces."""

    def __init__(self, path: str = DEFAULT_MODEL, dropout: float = 0.1, seed: int = 0) -> None:
        self.path, self.dropout, self.seed = path, dropout, seed

    def encode(self, texts: list[str], names: np.ndarray, limit: int = 1 << 21, copies: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """Blocks of (pieces, cuts): text i of a block has pieces[cuts[i]:cuts[i + 1]].

        ``names`` number the documents, ``copies`` the copies of each.
        """
        own = mix(names.astype(np.uint64) ^ np.uint64(self.seed + 1))
        if copies is not None:
            own = mix(own + copies.astype(np.uint64))
        return [self._block(block.codes, block.text_at, own[first : first + block.n]) for first, block in blocks(texts, limit)]

    def _block(self, codes: np.ndarray, text_at: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        vocab = vocabulary(self.path)
        n_text = len(names)
        sizes = np.diff(text_at) - 1
        # a space before each text that has characters, and no line feed behind it
        place = np.arange(n_text)[sizes > 0]
        keep = np.ones(len(codes), bool)
        keep[text_at[1:] - 1] = False
        own = np.repeat(np.arange(n_text), np.diff(text_at))[keep]
        x = np.insert(codes[keep], np.searchsorted(own, place), 32)
        own = np.insert(own, np.searchsorted(own, place), place)
        if not len(x):
            return np.zeros(0, np.int32), np.zeros(n_text + 1, np.int64)
        space = x == 32
        begin = np.concatenate(([True], (space[1:] & ~space[:-1]) | (own[1:] != own[:-1])))
        starts = np.flatnonzero(begin)
        ends = np.append(starts[1:], len(x))
        text = own[starts]
        first_unit = np.searchsorted(text, np.arange(n_text))
        seat = np.arange(len(starts)) - first_unit[text]
        units = span_hashes(x, starts, ends)
        unique, example, which = np.unique(units, return_index=True, return_inverse=True)
        log: list[np.ndarray] | None = [] if self.dropout else None
        pieces, cuts = self._units(vocab, x, starts[example], ends[example], unique, 0.0, log)
        begin, count = cuts[which], np.diff(cuts)[which]
        if log:
            keys = mix(units + mix(names[text] + seat.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(self.seed))
            again = self._skipping(np.concatenate(log, axis=1), len(unique), which, keys)
            more, at = self._units(vocab, x, starts[again], ends[again], keys[again], self.dropout)
            begin[again], count[again] = len(pieces) + at[:-1], np.diff(at)
            pieces = np.concatenate((pieces, more))
        total = np.concatenate(([0], np.cumsum(count)))
        flat = np.arange(total[-1]) + np.repeat(begin - total[:-1], count)
        return pieces[flat], total[np.append(first_unit, len(starts))]

    def _skipping(self, merges: np.ndarray, n: int, which: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """The occurrences whose draws skip a merge (unit, left, middle, right) of their unit's own segmentation."""
        merges = merges[:, np.argsort(merges[0], kind="stable")]
        number = np.bincount(merges[0], minlength=n)
        times = number[which]
        total = np.concatenate(([0], np.cumsum(times)))
        one = np.repeat(np.arange(len(which)), times)
        at = np.arange(total[-1]) + np.repeat((np.cumsum(number) - number)[which] - total[:-1], times)
        return np.unique(one[dropped(keys[one], *merges[1:, at], self.dropout)])

    def _units(self, vocab: Vocabulary, x: np.ndarray, starts: np.ndarray, ends: np.ndarray, keys: np.ndarray, dropout: float,
               log: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of each unit, one after another, and where each unit's begin; ``log`` takes their merges."""
        size = ends - starts
        total = np.concatenate(([0], np.cumsum(size)))
        flat = np.arange(total[-1]) + np.repeat(starts - total[:-1], size)
        codes = x[flat]
        symbols = vocab.symbols(codes)
        unit = np.repeat(np.arange(len(starts)), size)
        piece, alive = symbols.copy(), np.ones(len(codes), bool)
        for u in np.flatnonzero(size > SHORT):
            a, b = total[u], total[u + 1]
            spans = None if log is None else []
            own, left = agenda(vocab, symbols[a:b], keys[u], dropout, spans)
            if spans:
                log.append(np.vstack((np.full(len(spans), u), np.array(spans).T)))
            alive[a:b] = False
            alive[a + np.array(left)] = True
            piece[a + np.array(left)] = own
        short = size <= SHORT
        mine = short[unit]
        if mine.any():
            rounds = None if log is None else []
            piece[mine], alive[mine] = merge_all(
                vocab, symbols[mine], np.concatenate(([0], np.cumsum(size[short])))[:-1], keys[short], dropout, rounds)
            number = np.flatnonzero(short)
            for spans in rounds or []:
                spans[0] = number[spans[0]]
                log.append(spans)
        left = np.flatnonzero(alive)
        piece, unit = piece[left], unit[left]
        unknown = np.flatnonzero(piece == BYTE)
        if len(unknown):
            spelled = [chr(c).encode("utf-8", "surrogatepass") for c in codes[left[unknown]]]
            times = np.ones(len(piece), np.int64)
            times[unknown] = [len(s) for s in spelled]
            at = np.cumsum(times)[unknown] - times[unknown]
            piece, unit = np.repeat(piece, times), np.repeat(unit, times)
            for a, s in zip(at, spelled, strict=True):
                piece[a : a + len(s)] = vocab.bytes[list(s)]
        return piece.astype(np.int32), np.searchsorted(unit, np.arange(len(starts) + 1))

    def decode(self, pieces: np.ndarray, cuts: np.ndarray) -> list[str]:
        """The texts of pieces[cuts[i]:cuts[i + 1]]."""
        vocab = vocabulary(self.path)
        size = np.diff(vocab.spell_at)[pieces]
        total = np.concatenate(([0], np.cumsum(size)))
        raw = vocab.spelled[np.arange(total[-1]) + np.repeat(vocab.spell_at[pieces] - total[:-1], size)].tobytes()
        at = total[cuts].tolist()
        return [raw[a + 1 : b].decode("utf-8", "surrogatepass") if b > a else "" for a, b in zip(at, at[1:], strict=False)]


def encode_documents(df: DataFrame, encoder: Encoder, copies: bool = False) -> DataFrame:
    """doc_id, n_chars, n_pieces, ids, and whether decoding them gives the text again; one row per input row.

    With ``copies``, rows of equal doc_id and text are numbered, so each copy has draws of its own.
    """

    def run(batches):
        for batch in batches:
            names = batch.column(0).fill_null(-1).to_numpy(zero_copy_only=False)
            texts = [t or "" for t in batch.column(1).to_pylist()]
            number = batch.column(2).to_numpy(zero_copy_only=False) if copies else None
            first = 0
            for pieces, cuts in encoder.encode(texts, names, copies=number):
                own = texts[first : first + len(cuts) - 1]
                back = encoder.decode(pieces, cuts)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column(0).slice(first, len(own)),
                    "n_chars": pa.array([len(t) for t in own], pa.int64()),
                    "n_pieces": pa.array(np.diff(cuts), pa.int64()),
                    "ids": pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(pieces, pa.int32())),
                    "lossless": pa.array([a == b for a, b in zip(own, back, strict=True)], pa.bool_()),
                    "decoded_sha256": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in back],
                })
                first += len(own)

    rows = documents(df)
    if copies:
        equal = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy("doc_id")
        rows = rows.withColumn("copy", F.row_number().over(equal).cast("bigint"))
    return rows.select("doc_id", "text", *(["copy"] if copies else [])).mapInArrow(
        run, "doc_id bigint, n_chars bigint, n_pieces bigint, ids array<int>, lossless boolean, decoded_sha256 string")


def decode_documents(df: DataFrame, encoder: Encoder) -> DataFrame:
    """doc_id and text from rows of doc_id and ids; null ids are no pieces."""

    def run(batches):
        for batch in batches:
            lists = [x or [] for x in batch.column(1).to_pylist()]
            cuts = np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int64)
            flat = np.array([i for x in lists for i in x], np.int32)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "text": pa.array(encoder.decode(flat, cuts), pa.string())})

    return df.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")
