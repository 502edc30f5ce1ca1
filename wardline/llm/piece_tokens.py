"""Subword encoding by suffix-array matching, and decoding.

A BPE model encodes a text as SentencePiece does: of all adjacent symbols that
together are a piece, those with the best score are joined, the leftmost of
equals first, until none are left.  The scores of other models are log chances: there
a text is the sequence of pieces with the largest total score.

The stretches of a batch's texts from one space to the next are concatenated,
each different one once, as no piece goes on after a space.  Their suffixes
are sorted by as many characters as the longest piece has.  Binary search finds the
range of suffixes that start with a piece, for every piece; these ranges
are the edges of the segmentation graph.  In a BPE model an edge is a join that may
be made; every stretch makes its best one at a time, all stretches at once (those
of more than ``LONG`` characters with a heap each).  In others edges are sorted by
position and relaxed from left to right, all stretches at once.  Of equally good paths the one with the
longer last piece wins, and so on backwards.

A character that no piece covers becomes its UTF-8 bytes, at a score below any
piece.  A space sign that the text itself has becomes bytes too, unlike in
SentencePiece, which would make it a space.  Decoding joins pieces and bytes and takes away the space put before a text.

Nulls and edge cases: a null or empty text has no ids.  Any other text, however
long, gives itself again when decoded.  Repeated rows are encoded once each.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SPACE = "▁"
# Stands for the space sign where a text itself has it: no text can hold this half of a pair.
LITERAL = "\udfff"
STRETCHES = 300_000
LONG = 64
TOGETHER = 1 << 20

_vocabularies: dict[str, Vocabulary] = {}


class Vocabulary:
    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor
        from sentencepiece.sentencepiece_model_pb2 import ModelProto

        model = SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        self.bytes_of = [model.id_to_piece(i).replace(SPACE, " ").encode() for i in ids]
        self.byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        for b, i in enumerate(self.byte_ids):
            self.bytes_of[i] = bytes([b])
        whole = [i for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        for i in set(ids).difference(whole, self.byte_ids):
            self.bytes_of[i] = b""
        self.pieces = [model.id_to_piece(i) for i in whole]
        if any(SPACE in p.lstrip(SPACE) for p in self.pieces):
            raise ValueError("pieces that go on after a space are not supported")
        self.ids = np.array(whole, np.int64)
        self.scores = np.array([model.get_score(i) for i in whole], np.float64)
        self.lengths = np.array([len(p) for p in self.pieces], np.int64)
        self.longest = int(self.lengths.max())
        self.codes = np.zeros((len(whole), self.longest), np.uint32)
        for row, piece in zip(self.codes, self.pieces, strict=True):
            row[: len(piece)] = [ord(c) for c in piece]
        self.below = float(self.scores.min()) - 10
        trained = ModelProto.FromString(model.serialized_model_proto()).trainer_spec
        self.bpe = trained.model_type == trained.BPE
        # Place of each piece by score, the best first.
        self.rank = np.unique(-self.scores, return_inverse=True)[1]
        self.numbers = {p: i for i, p in enumerate(self.pieces)}
        self.known: dict[str, bytes] = {}
        self.joined: dict[str, bytes] = {}

    def tokens(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text, in the manner of the model."""
        return self._encode(texts, self.joined, self._join) if self.bpe else self.encode(texts)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of the best sum of scores of each text."""
        return self._encode(texts, self.known, self._segment)

    def _encode(self, texts: list[str], known: dict[str, bytes], found: Callable) -> list[bytes]:
        split = [_stretches(t) for t in texts]
        new = sorted(set().union(*split).difference(known))
        known = known if len(known) + len(new) <= STRETCHES else dict(known)
        if new:
            known.update(zip(new, found(new), strict=True))
        return [b"".join([known[s] for s in stretches]) for stretches in split]

    def decode(self, ids: np.ndarray) -> str:
        return b"".join([self.bytes_of[i] for i in ids.tolist()]).decode("utf-8", "replace")[1:]

    def _join(self, stretches: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(stretches)
        lengths = np.array([len(s) for s in stretches])
        short = np.flatnonzero(lengths <= LONG)
        for k in np.flatnonzero(lengths > LONG):
            out[k] = self._join_long(stretches[k])
        if len(short):
            for k, ids in zip(short, self._join_short([stretches[k] for k in short]), strict=True):
                out[k] = ids
        return out

    def _join_short(self, stretches: list[str]) -> list[bytes]:
        lengths = np.array([len(s) for s in stretches], np.int64)
        ends = np.cumsum(lengths + 1) - 1
        text = np.frombuffer(("\0".join(stretches) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)
        start, length, piece = self._edges(text)
        keys = start * (self.longest + 1) + length
        order = np.argsort(keys)
        keys, piece = keys[order], piece[order]

        def pieces(begin, size):
            """The piece of each place, or -1."""
            if not len(keys):
                return np.full(len(begin), -1)
            wanted = begin * (self.longest + 1) + size
            at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            return np.where((size <= self.longest) & (keys[at] == wanted), piece[at], -1)

        none = np.iinfo(np.int64).max
        owner = np.repeat(np.arange(len(stretches)), lengths)
        begin = np.arange(len(owner)) + owner  # a stop character follows each stretch
        size = np.ones(len(owner), np.int64)

        def ranks(at):
            """Rank of the join of each symbol with the next one."""
            after = np.minimum(at + 1, len(owner) - 1)
            found = pieces(begin[at], size[at] + size[after])
            return np.where((after > at) & (owner[after] == owner[at]) & (found >= 0), self.rank[found], none)

        rank, done = ranks(np.arange(len(owner))), []
        while len(owner):
            first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            least = np.minimum.reduceat(rank, first)
            each = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(owner))))
            over = least[each] == none
            best = np.flatnonzero((rank == least[each]) & ~over)
            best = best[np.append(True, each[best[1:]] != each[best[:-1]])[: len(best)]]
            done.append((owner[over], begin[over], size[over]))
            size[best] += size[best + 1]
            keep = ~over
            keep[best + 1] = False
            place = np.cumsum(keep) - 1
            owner, begin, size, rank = owner[keep], begin[keep], size[keep], rank[keep]
            best = place[best]
            changed = np.unique(np.concatenate((best, np.maximum(best - 1, 0))))
            if len(changed):
                rank[changed] = ranks(changed)
        owner, begin, size = (np.concatenate(x) for x in zip(*done, strict=True))
        found = pieces(begin, size)
        found = np.where(found >= 0, self.ids[found], -1 - begin)
        return self._written(stretches, ends - lengths, owner, found)

    def _join_long(self, stretch: str) -> bytes:
        size = [1] * len(stretch)
        before, after = list(range(-1, len(stretch) - 1)), list(range(1, len(stretch) + 1))
        heap: list[tuple[int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < len(stretch):
                end = j + size[j]
                number = self.numbers.get(stretch[i:end]) if end - i <= self.longest else None
                if number is not None:
                    heapq.heappush(heap, (int(self.rank[number]), i, end))

        for i in range(len(stretch)):
            offer(i)
        while heap:
            _, i, end = heapq.heappop(heap)
            j = after[i]
            if not size[i] or j >= len(stretch) or j + size[j] != end:
                continue
            size[i], size[j] = end - i, 0
            after[i] = after[j]
            if after[i] < len(stretch):
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        at = np.array([i for i, n in enumerate(size) if n], np.int64)
        found = [self.numbers.get(stretch[i : i + size[i]], -1) for i in at.tolist()]
        ids = np.array([self.ids[n] if n >= 0 else -1 - i for n, i in zip(found, at.tolist(), strict=True)], np.int64)
        return self._written([stretch], np.zeros(1, np.int64), np.zeros(len(ids), np.int64), ids)[0]

    def _segment(self, stretches: list[str]) -> list[bytes]:
        lengths = np.array([len(s) for s in stretches], np.int64)
        ends = np.cumsum(lengths + 1) - 1  # a stop character follows each stretch
        text = np.frombuffer(("\0".join(stretches) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)
        start, length, piece = self._edges(text)
        # Characters without a piece of their own: an edge to their bytes.
        alone = np.ones(len(text), bool)
        alone[start[length == 1]] = False
        alone[ends] = False
        lone = np.flatnonzero(alone)
        widths = 1 + (text[lone] > 0x7F) + (text[lone] > 0x7FF) + (text[lone] > 0xFFFF).astype(np.int64)
        score = np.concatenate((self.scores[piece], self.below * widths))
        start, length = np.concatenate((start, lone)), np.concatenate((length, np.ones(len(lone), np.int64)))
        piece = np.concatenate((self.ids[piece], np.full(len(lone), -1)))
        # Relax by place within the stretch: the edges of one place lead to different nodes.
        stretch = np.repeat(np.arange(len(stretches)), lengths + 1)
        place = np.arange(len(text)) - (ends - lengths)[stretch]
        order = np.argsort(place[start], kind="stable")
        start, length, piece, score = start[order], length[order], piece[order], score[order]
        levels = np.searchsorted(place[start], np.arange(int(lengths.max()) + 1))
        best = np.where(place == 0, 0.0, -np.inf)
        back = np.full(len(text), -1)
        for low, high in zip(levels, levels[1:], strict=False):
            for size in np.unique(length[low:high]):
                edges = low + np.flatnonzero(length[low:high] == size)
                target = start[edges] + size
                found = best[start[edges]] + score[edges]
                better = found > best[target]
                best[target[better]] = found[better]
                back[target[better]] = edges[better]
        return self._paths(stretches, ends, ends - lengths, start, piece, back)

    def _paths(self, stretches, ends, begins, start, piece, back) -> list[bytes]:
        owners, ids, at, live = [], [], ends.copy(), np.arange(len(ends))
        while len(live):
            edge = back[at[live]]
            owners.append(live)
            ids.append(np.where(piece[edge] >= 0, piece[edge], -1 - start[edge]))
            at[live] = start[edge]
            live = live[at[live] > begins[live]]
        return self._written(stretches, begins, np.concatenate(owners[::-1]), np.concatenate(ids[::-1]))

    def _written(self, stretches: list[str], begins: np.ndarray, owner: np.ndarray, found: np.ndarray) -> list[bytes]:
        """The ids of each stretch; a negative one is -1 - the place of a character that becomes its bytes."""
        order = np.argsort(owner, kind="stable")
        found, edges = found[order], np.searchsorted(owner[order], np.arange(len(stretches) + 1))
        data, cuts = found.astype("<u4").tobytes(), (edges * 4).tolist()
        out = [data[a:z] for a, z in zip(cuts, cuts[1:], strict=False)]
        for k in np.unique(owner[order][found < 0]):
            ids = []
            for i in found[edges[k] : edges[k + 1]].tolist():
                char = "" if i >= 0 else stretches[k][-1 - i - int(begins[k])]
                ids += [i] if i >= 0 else [self.byte_ids[b] for b in char.replace(LITERAL, SPACE).encode()]
            out[k] = np.array(ids, "<u4").tobytes()
        return out

    def _edges(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, length and piece of every occurrence of a piece, from a suffix array."""
        alphabet, coded = np.unique(text, return_inverse=True)
        bits = max(1, int(len(alphabet)).bit_length())
        per = 63 // bits
        words = -(-self.longest // per)
        padded = np.concatenate((coded.astype(np.uint64), np.zeros(per * words, np.uint64)))
        keys = np.zeros((words, len(text)), np.uint64)
        for i in range(words * per):
            keys[i // per] = keys[i // per] << np.uint64(bits) | padded[i : i + len(text)]
        suffixes = np.lexsort(keys[::-1])
        keys = keys[:, suffixes]
        # Pieces in the text's alphabet; those with another character do not occur.
        spot = np.minimum(np.searchsorted(alphabet, self.codes), len(alphabet) - 1)
        inside = np.arange(self.longest) < self.lengths[:, None]
        usable = np.flatnonzero(((alphabet[spot] == self.codes) | ~inside).all(axis=1))
        spot, inside = np.where(inside, spot, 0)[usable].astype(np.uint64), inside[usable]
        top = np.uint64((1 << bits) - 1)
        low, high = np.zeros((words, len(usable)), np.uint64), np.zeros((words, len(usable)), np.uint64)
        for i in range(words * per):
            held = i < self.longest
            low[i // per] = low[i // per] << np.uint64(bits) | (spot[:, i] if held else np.uint64(0))
            high[i // per] = high[i // per] << np.uint64(bits) | (np.where(inside[:, i], spot[:, i], top) if held else top)
        first = np.searchsorted(keys[0], low[0], side="left")
        last = np.searchsorted(keys[0], high[0], side="right")
        for k in np.flatnonzero((self.lengths[usable] > per) & (last > first)):
            a, z = first[k], last[k]
            for w in range(1, words):
                a, z = a + np.searchsorted(keys[w][a:z], low[w][k], side="left"), a + np.searchsorted(keys[w][a:z], high[w][k], side="right")
            first[k], last[k] = a, z
        count = last - first
        within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        start = suffixes[np.repeat(first, count) + within]
        piece = np.repeat(usable, count)
        return start, self.lengths[piece], piece


def _stretches(text: str) -> list[str]:
    """Cut before each space that follows another character, of the text with a space before it."""
    if not text:
        return []
    parts = text.replace(SPACE, LITERAL).split(" ")
    if "" not in parts:
        return [SPACE + p for p in parts]
    out, spaces = [], ""
    for part in parts:
        spaces += SPACE
        if part:
            out.append(spaces + part)
            spaces = ""
    return [*out, spaces] if spaces else out


def vocabulary(path: str) -> Vocabulary:
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]


def _encoded(path: str, keep_ids: bool) -> Callable:
    def work(batches):
        words = vocabulary(path)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            at = 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end]) <= TOGETHER):
                    size += len(texts[end])
                    end += 1
                found = words.tokens(texts[at:end])
                whole = [words.decode(np.frombuffer(x, "<u4")) == t for x, t in zip(found, texts[at:end], strict=True)]
                columns = [
                    batch.column("doc_id").slice(at, end - at),
                    pa.array([len(x) // 4 for x in found], pa.int64()),
                    pa.array([zlib.crc32(x) for x in found], pa.int64()),
                    pa.array(whole, pa.bool_()),
                    pa.array([np.frombuffer(x, "<i4") if keep_ids else None for x in found], pa.list_(pa.int32())),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_ids", "ids_crc32", "round_trip", "ids"])
                at = end

    return work


def encode(docs: DataFrame, model_path: str, keep_ids: bool = True) -> DataFrame:
    """(doc_id, n_ids, ids_crc32, round_trip, ids) of every row; round_trip: decoding gives the text again."""
    schema = "doc_id long, n_ids long, ids_crc32 long, round_trip boolean, ids array<int>"
    return docs.select("doc_id", "text").mapInArrow(_encoded(model_path, keep_ids), schema)


def _decoded(path: str) -> Callable:
    def work(batches):
        words = vocabulary(path)
        for batch in batches:
            texts = [words.decode(np.array(ids or [], np.int64)) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return work


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, text) of every row of (doc_id, ids); null ids are an empty text."""
    return encoded.select("doc_id", "ids").mapInArrow(_decoded(model_path), "doc_id long, text string")
