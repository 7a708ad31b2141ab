"""Operator 10: SentencePiece encoding and decoding with batched numpy dynamic programming.

Text is cut where no piece can span (before each run of blanks that follows a non-blank), and only distinct words are
encoded. Words of equal length advance together, one end position at a time: substring hashes are looked up among the sorted
hashes of all pieces, every start position gives a candidate, and the maximum over the candidates' scores is stored with its
start as a backpointer. Words over ALONE characters go through the same programme one by one.

Which maximum: for a unigram model the scores are sums of piece scores (Viterbi). The public model at hand is a BPE model, whose
result isn't the path of the largest sum. Its last piece at a position is the one that BPE leaves next to the last piece of
the position where it starts; so a candidate's score is its length if BPE of the two pieces' text gives just these two, and
none otherwise. Pairs are judged by merging them, once each. Where a position has not exactly one such candidate, the word is
merged step by step instead, so ids equal those of the library in all cases.

Cases: null and empty texts have no ids and decode to the empty text; a character without a piece becomes the pieces of its UTF-8
bytes; U+2581 in a text decodes as a blank, as the format has it; very long texts and words are encoded whole; repeated rows
get equal results; of equal scores the longest piece's stays; an empty table gives an empty result; columns other than those named are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.llm.common import table, thrifty

BLANK = "▁"
WORD = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")
#: Words longer than this are rare, so few are of equal length: each is advanced by itself, with its substrings looked up all at once.
ALONE = 48
#: Beyond so many judged pairs of pieces an encoder forgets them.
PAIRS = 1_000_000
#: Beyond so many distinct words a worker forgets those that it hasn't met since it last did so.
REMEMBERED = 400_000
#: Ends of one batch of words of a length.
BATCH = 20_000
_MUL, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
MODEL_FILE = "piece_bpe_32k.model"


def model_path() -> str:
    """The public model's file on this machine; the operators take any other path."""
    import public_tokenizers

    return public_tokenizers.path(MODEL_FILE)


class Pieces:
    """A piece model's tables: texts and scores by id, byte pieces, and the sorted hashes of the pieces."""

    def __init__(self, names: list[str], scores: list[float], byte_ids: list[int], bpe: bool, normal: list[bool]) -> None:
        self.names, self.scores, self.bpe = names, np.array(scores), bpe
        self.byte_ids = byte_ids
        self.ids = {t: i for i, (t, ok) in enumerate(zip(names, normal)) if ok}
        self.byte_of = {i: b for b, i in enumerate(byte_ids)}
        self.longest = max(map(len, self.ids), default=1)
        found = sorted((int(self.hashes(np.array([[ord(c) for c in t]], np.uint64))[0]), i) for t, i in self.ids.items())
        self.keys, self.key_ids = np.array([k for k, _ in found], np.uint64), np.array([i for _, i in found], np.int64)
        self.numbers = list(range(len(names)))  # one object per id, however often it is remembered
        self.prefixes = np.zeros(1 << 21, bool)
        self.prefixes[self.keys >> np.uint64(43)] = True
        if len(np.unique(self.keys)) < len(self.keys):
            raise ValueError("two pieces share a hash")
        self.decoded = [t.replace(BLANK, " ").encode() if i not in self.byte_of else bytes([self.byte_of[i]]) for i, t in enumerate(names)]
        if bpe:
            self.merge_tables()

    def merge_tables(self) -> None:
        """Each piece's rank (-1: never merged, as single characters), its two halves, and its hash before mixing.

        A piece whose half has a later rank than itself, or shares its score with others, or doesn't come out of merging its
        own text, is odd: pairs with it are judged by merging.
        """
        n = len(self.names)
        self.rank, self.left, self.right = np.full(n, -1, np.int64), np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        self.raw, self.size, self.odd = np.zeros(n, np.uint64), np.ones(n, np.int64), np.zeros(n, bool)
        order = sorted(self.ids.values(), key=lambda i: (-self.scores[i], i))
        place = {i: k for k, i in enumerate(order)}
        shared = {x for x, c in zip(*np.unique(self.scores[order], return_counts=True)) if c > 1}
        for t, i in self.ids.items():
            self.raw[i], self.size[i] = self.raw_hash(t), len(t)
        for t, i in sorted(self.ids.items(), key=lambda x: len(x[0])):
            if len(t) == 1:
                continue
            self.rank[i] = place[i]
            last = self.merged(t, whole=True)
            if last is None or self.scores[i] in shared:
                self.odd[i] = True
                continue
            pair = [self.ids.get(x) for x in last]
            # a character without a piece can't be a half of one here: it would need an id
            if None in pair or max(self.rank[pair[0]], self.rank[pair[1]]) > self.rank[i] or self.odd[pair].any():
                self.odd[i] = True
                continue
            self.left[i], self.right[i] = pair
        self.powers = np.ones(2 * self.longest + 2, np.uint64)
        for k in range(1, len(self.powers)):
            self.powers[k] = (self.powers[k - 1 : k] * _MUL)[0]

    @staticmethod
    def raw_hash(t: str) -> np.uint64:
        h = np.zeros(1, np.uint64)
        for c in reversed(t):
            h = (h + np.uint64(ord(c) + 1)) * _MUL
        return h[0]

    def side_by_side(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging leaves these two pieces next to each other, for arrays of ids of pieces that aren't odd.

        Goes back in time from the two pieces to the characters where they meet: at each step the later merge is undone, and
        the two have kept apart if the pieces that met then make no piece of an earlier rank.
        """
        out = np.ones(len(a), bool)
        at, limit = np.arange(len(a)), np.full(len(a), len(self.names) + 1, np.int64)
        while len(at):
            h = self.raw[a] + self.powers[self.size[a]] * self.raw[b]
            both = self.lookup(h ^ (h >> np.uint64(31)) * _MIX)
            clash = (both >= 0) & (self.rank[both] < limit)
            ra, rb = self.rank[a], self.rank[b]
            out[at[clash]] = False
            go = np.flatnonzero(~clash & ((ra >= 0) | (rb >= 0)))
            at, a, b, ra, rb = at[go], a[go], b[go], ra[go], rb[go]
            undo = ra > rb
            limit = np.where(undo, ra, rb + 1)
            a, b = np.where(undo, self.right[a], a), np.where(undo, b, self.left[b])
        return out

    @classmethod
    def load(cls, path: str) -> Pieces:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = range(sp.get_piece_size())
        names = [sp.id_to_piece(i) for i in n]
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i) for i in n]
        # a unigram model's merges give other pieces than its best path; the two kinds differ in how they cut a few pieces' texts
        at = {t: i for i, t in enumerate(names)}
        ranks = [sp.get_score(i) for i in n if not special[i]]
        bpe = all(float(x).is_integer() for x in ranks)
        return cls(names, [sp.get_score(i) for i in n], [at[f"<0x{b:02X}>"] for b in range(256)] if "<0x00>" in at else [], bpe, [not x for x in special])

    @staticmethod
    def hashes(codes: np.ndarray) -> np.ndarray:
        """A hash of each row of codes: the same polynomial that the encoder extends by one character at a time."""
        h = np.zeros(len(codes), np.uint64)
        for k in range(codes.shape[1] - 1, -1, -1):
            h = (h + codes[:, k] + np.uint64(1)) * _MUL
        return h ^ (h >> np.uint64(31)) * _MIX

    def lookup(self, hashed: np.ndarray) -> np.ndarray:
        """Ids by hash, -1 where no piece has it. Most substrings are no pieces: a table of hash prefixes tells these first."""
        out = np.full(len(hashed), -1, np.int64)
        maybe = np.flatnonzero(self.prefixes[hashed >> np.uint64(43)])
        if len(maybe):
            wanted = hashed[maybe]
            at = np.searchsorted(self.keys, wanted)
            at[at == len(self.keys)] = 0
            hit = self.keys[at] == wanted
            out[maybe[hit]] = self.key_ids[at[hit]]
        return out

    def merged(self, word: str, whole: bool = False) -> list[str] | None:
        """The word's pieces and characters by merging the best pair first, the left one of equals.

        whole: instead the two parts of the merge that makes the word, None if it isn't made.
        """
        parts = list(word)
        rank = {}
        while len(parts) > 1:
            best = None
            for k in range(len(parts) - 1):
                t = parts[k] + parts[k + 1]
                if t not in rank:
                    rank[t] = self.scores[self.ids[t]] if t in self.ids else None
                if rank[t] is not None and (best is None or rank[t] > best[0]):
                    best = (rank[t], k)
            if best is None:
                break
            k = best[1]
            if whole and len(parts) == 2:
                return parts
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return None if whole else parts

    def of_parts(self, parts: Iterable[str]) -> list[int]:
        out: list[int] = []
        for t in parts:
            if t in self.ids:
                out.append(self.ids[t])
            else:
                out += [self.byte_ids[b] for b in t.encode("utf-8", "surrogatepass")] if self.byte_ids else [0]
        return out

    def decode(self, ids: Iterable[int]) -> str:
        text = b"".join(map(self.decoded.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


class Encoder:
    """Encodes texts with a memory of words; one per worker."""

    def __init__(self, pieces: Pieces, remembered: int = REMEMBERED) -> None:
        self.p, self.remembered = pieces, remembered
        self.words: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.alone_pairs: dict[tuple[int, int], bool] = {}

    def fits(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether BPE leaves these two side by side; ids from 0, and -2 - code for a character without a piece."""
        p = self.p
        out = np.ones(len(left), bool)  # nothing merges with a character without a piece
        known = (left >= 0) & (right >= 0)
        strange = known & (p.odd[left] | p.odd[right])
        plain = np.flatnonzero(known & ~strange)
        out[plain] = p.side_by_side(left[plain], right[plain])
        for k in np.flatnonzero(strange).tolist():
            a, b = int(left[k]), int(right[k])
            if (a, b) not in self.pairs:
                self.pairs[a, b] = p.merged(p.names[a] + p.names[b]) == [p.names[a], p.names[b]]
            out[k] = self.pairs[a, b]
        return out

    def equal_length(self, words: list[str], length: int) -> None:
        p, n = self.p, len(words)
        # one row per position, so that a position of all words lies together
        codes = np.ascontiguousarray(np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(n, length).T).astype(np.int64)
        grown = codes.astype(np.uint64) + np.uint64(1)
        best = np.full((length + 1, n), -np.inf)
        best[0] = 0
        piece, start = np.full((length + 1, n), -1, np.int64), np.zeros((length + 1, n), np.int64)
        for e in range(1, length + 1):
            h = np.zeros(n, np.uint64)
            ends = []  # for each start the words that have a piece there
            for s in range(e - 1, max(0, e - p.longest) - 1, -1):
                h = (h + grown[s]) * _MUL
                found = p.lookup(h ^ (h >> np.uint64(31)) * _MIX)
                if s == e - 1:
                    found = np.where(found < 0, -2 - codes[s], found)
                at = np.flatnonzero(found != -1)
                if len(at):
                    ends.append((s, at, found[at]))
            open_ = np.ones(n, bool)
            for s, at, got in reversed(ends):  # the longest first: most often it is the one
                if p.bpe:  # no word has two that fit
                    left = open_[at]
                    at, got = at[left], got[left]
                    if s:
                        ok = self.fits(piece[s][at], got) & (best[s][at] > -np.inf)
                        at, got = at[ok], got[ok]
                    best[e, at], piece[e, at], start[e, at], open_[at] = e, got, s, False
                else:
                    score = best[s][at] + np.where(got >= 0, p.scores[np.maximum(got, 0)], p.scores.min() - 10)
                    better = score > best[e][at]
                    at = at[better]
                    best[e, at], piece[e, at], start[e, at] = score[better], got[better], s
        odd = np.isinf(best[length]).tolist()
        at, rows, back = np.full(n, length), np.arange(n), []
        while (live := at > 0).any():
            back.append(np.where(live, piece[at, rows], -1))
            at = np.where(live, start[at, rows], 0)
        number = p.numbers
        for word, path, other in zip(words, np.array(back)[::-1].T.tolist(), odd):
            if other:
                self.words[word] = tuple(p.of_parts(p.merged(word)))
            elif min(path) >= -1:
                self.words[word] = tuple([number[i] for i in path if i >= 0])
            else:
                self.words[word] = tuple([k for i in path if i != -1 for k in ([i] if i >= 0 else p.of_parts([chr(-2 - i)]))])

    def side_by_side(self, left: int, right: int) -> bool:
        """fits() of one pair, remembered."""
        if (known := self.alone_pairs.get((left, right))) is None:
            if len(self.alone_pairs) >= PAIRS:
                self.alone_pairs.clear()
            known = self.alone_pairs[left, right] = bool(self.fits(np.array([left]), np.array([right]))[0])
        return known

    def alone(self, word: str) -> tuple[int, ...]:
        """The ids of one word: the substrings of each length are looked up at all places at once, then the ends are gone through."""
        p, n = self.p, len(word)
        codes = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        grown, h = codes.astype(np.uint64) + np.uint64(1), np.zeros(n + 1, np.uint64)
        ends, sizes, found = [], [], []
        for size in range(1, min(p.longest, n) + 1):
            h = (h[1:] + grown[: n - size + 1]) * _MUL
            got = p.lookup(h ^ (h >> np.uint64(31)) * _MIX)
            if size == 1:
                got = np.where(got < 0, -2 - codes, got)
            at = np.flatnonzero(got != -1)
            ends.append(at + size)
            sizes.append(np.full(len(at), size))
            found.append(got[at])
        end, size, got = map(np.concatenate, (ends, sizes, found))
        order = np.lexsort((-size, end))  # at an end the longest first, as for words of equal length
        piece, start, best = [-1] * (n + 1), [-1] * (n + 1), [-np.inf] * (n + 1)
        best[0] = 0.0
        low = float(p.scores.min()) - 10
        for e, k, i in zip(end[order].tolist(), size[order].tolist(), got[order].tolist()):
            s = e - k
            if best[s] == -np.inf or p.bpe and best[e] > -np.inf:
                continue
            score = float(e) if p.bpe else best[s] + (float(p.scores[i]) if i >= 0 else low)
            if score > best[e] and (not p.bpe or not s or self.side_by_side(piece[s], i)):
                best[e], piece[e], start[e] = score, i, s
        if best[n] == -np.inf:
            return tuple(p.of_parts(self.long_merged(word)))
        path, e = [], n
        while e:
            path.append(piece[e])
            e = start[e]
        return tuple(k for i in reversed(path) for k in ([p.numbers[i]] if i >= 0 else p.of_parts([chr(-2 - i)])))

    def learn(self, words: Iterable[str]) -> None:
        by_length: dict[int, list[str]] = {}
        for w in words:
            if len(w) > ALONE:
                self.words[w] = self.alone(w)
            else:
                by_length.setdefault(len(w), []).append(w)
        for length, same in by_length.items():
            step = max(1, BATCH * 8 // max(8, length))
            for at in range(0, len(same), step):
                self.equal_length(same[at : at + step], length)

    def long_merged(self, word: str) -> list[str]:
        """merged() with a heap, for words of any length."""
        import heapq

        p = self.p
        text, after, before = list(word), list(range(1, len(word) + 1)), list(range(-1, len(word) - 1))
        alive, heap = [True] * len(word), []

        def offer(i: int) -> None:
            j = after[i]
            if j < len(text) and (t := text[i] + text[j]) in p.ids:
                heapq.heappush(heap, (-p.scores[p.ids[t]], i, j, t))

        for i in range(len(text)):
            offer(i)
        while heap:
            _, i, j, t = heapq.heappop(heap)
            if not alive[i] or j >= len(text) or not alive[j] or after[i] != j or text[i] + text[j] != t:
                continue
            text[i], alive[j], after[i] = t, False, after[j]
            if after[i] < len(text):
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [t for t, a in zip(text, alive) if a]

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        if len(self.words) > self.remembered:
            self.words, self.older = {}, self.words
        cut = [WORD.findall(BLANK + t.replace(" ", BLANK)) if t else [] for t in texts]
        new = set().union(*cut) - self.words.keys()
        for w in new & self.older.keys():
            self.words[w] = self.older[w]
        if new := new - self.words.keys():
            self.learn(new)
        known = self.words.__getitem__
        return [list(chain.from_iterable(map(known, words))) for words in cut]


_ENCODERS: dict[int, Encoder] = {}


def encoder_for(pieces: Pieces, key: int, remembered: int) -> Encoder:
    """The worker's encoder of a broadcast model: words stay known from task to task."""
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(pieces, remembered)
    return _ENCODERS[key]


#: Characters that are encoded at once: bounds the memory beside the batch itself.
AT_ONCE = 6_000_000


def blocks(column: pa.Array, at_once: int = AT_ONCE, rows: int = 256) -> Iterator[list[str | None]]:
    """A column's texts, some at a time."""
    block, size = [], 0
    for at in range(0, len(column), rows):
        block += column.slice(at, rows).to_pylist()
        size = sum(len(t or "") for t in block)
        if size > at_once:
            yield block
            block = []
    if block:
        yield block


def encoded(docs: DataFrame, pieces: Pieces, doc_id: str = "doc_id", text: str = "text", check: bool = True, remembered: int = REMEMBERED, at_once: int = AT_ONCE) -> DataFrame:
    """doc_id, ids, n_ids and, with check, what the ids decode to: its SHA-256 and whether it is the text.

    remembered (words) and at_once (characters) bound a worker's memory; smaller ones cost time, not results.
    """
    kind = dict(docs.dtypes)[doc_id]
    shipped = docs.sparkSession.sparkContext.broadcast(pieces)
    names = ["doc_id", "ids", "n_ids", *["decoded_sha256", "round_trip"] * check]

    @thrifty
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder_for(shipped.value, id(shipped.value), remembered)
        for b in batches:
            at = 0
            for block in blocks(b.column(1), at_once):
                ids = own.encode(block)
                flat = np.fromiter(chain.from_iterable(ids), np.int32, sum(map(len, ids)))
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                cols = [b.column(0).slice(at, len(block)), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array(np.diff(ends).astype(np.int64))]
                if check:
                    back = [own.p.decode(x) for x in ids]
                    cols.append(pa.array([hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in back], pa.string()))
                    cols.append(pa.array([x == (t or "") for x, t in zip(back, block)], pa.bool_()))
                at += len(block)
                yield pa.RecordBatch.from_arrays(cols, names)

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(encode, f"doc_id {kind}, ids array<int>, n_ids long" + ", decoded_sha256 string, round_trip boolean" * check)


def decoded(rows: DataFrame, pieces: Pieces, ids: str = "ids") -> DataFrame:
    """rows with their ids' text in a column named decoded_text."""
    shipped = rows.sparkSession.sparkContext.broadcast(pieces)

    @F.arrow_udf("string")
    def decode(column: pa.Array) -> pa.Array:
        return pa.array([shipped.value.decode(x or []) for x in column.to_pylist()], pa.string())

    return rows.withColumn("decoded_text", decode(F.col(ids)))


def op10_pieces(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Every document's ids, and what they decode to."""
    return encoded(table(spark, sf_dir, "documents"), Pieces.load(path or model_path()))
