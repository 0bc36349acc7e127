"""Exact encoding and decoding with a merge-type piece model, by backtracking over longest matches.

A list of pieces is what merging makes of a text exactly if each adjacent pair is what merging makes of the two
pieces' text. So pieces are chosen greedily from the longest matches of an Aho-Corasick automaton; a piece that
does not agree with the one before it is replaced by the next shorter one, and if none is left the piece before it
is taken back and the position is marked as failed.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

SPACE = "▁"  # stands for a blank inside pieces
SLICE = 128
MEMO_WORDS = 400_000  # words remembered by a Python worker and those of one more text, and as many older ones
MEMO_LENGTH = 40
MEMO_PAIRS = 800_000


class PieceCodec:
    """Encoder and decoder over the pieces, scores and settings of a model file's bytes."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2 as schema

        read = sentencepiece.SentencePieceProcessor(model_proto=model)
        spec = schema.ModelProto()
        spec.ParseFromString(model)
        rules = spec.normalizer_spec
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.escape_whitespaces or not rules.add_dummy_prefix:
            raise ValueError("only models without text normalisation and with a blank in front are supported")
        if spec.trainer_spec.model_type != schema.TrainerSpec.BPE or not spec.trainer_spec.byte_fallback:
            raise ValueError("only merge-type models with byte fallback are supported")
        kind = schema.ModelProto.SentencePiece.Type
        special = (kind.Value("UNKNOWN"), kind.Value("CONTROL"), kind.Value("BYTE"))
        if any(p.type not in (*special, kind.Value("NORMAL")) for p in spec.pieces):
            raise ValueError("models with user-defined or unused pieces are not supported")
        self.pieces = [p.piece for p in spec.pieces]
        self.ids = {p.piece: i for i, p in enumerate(spec.pieces) if p.type == kind.Value("NORMAL")}
        self.rank = {p.piece: -p.score for p in spec.pieces if p.type == kind.Value("NORMAL")}  # the least is merged first
        self.byte_ids = [read.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.byte_of = {i: b for b, i in enumerate(self.byte_ids)}
        self.controls = {i for i, p in enumerate(spec.pieces) if p.type == kind.Value("CONTROL")}
        self.end = read.eos_id()
        # Pieces never go on after a blank inside them or over a line break, so texts can be cut there.
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in self.ids):
            raise ValueError("only models whose pieces end before a blank or a line break are supported")
        often: dict[float, int] = {}
        for s in self.rank.values():
            often[s] = often.get(s, 0) + 1
        # Between pieces of one score the place decides, which pairs alone do not show: runs with two of them are merged.
        self.tied = {self.ids[p] for p, s in self.rank.items() if often[s] > 1}
        self.found = ahocorasick.Automaton()
        for piece, number in self.ids.items():
            self.found.add_word(piece, (number, len(piece)))
        self.found.make_automaton()
        # Pieces by number; characters that no piece stands for get the numbers behind the model's as they are met.
        self.number = dict(self.ids)
        self.name = list(self.pieces)
        self.decimal = [str(i) for i in range(len(self.pieces))]
        self.plain = [p.replace(SPACE, " ") for p in self.pieces]
        self.words: dict[str, str] = {}  # decimal ids of a segment
        self.texts: dict[str, str] = {}  # what they decode to
        self.older: tuple[dict[str, str], dict[str, str]] = {}, {}
        self.pairs: dict[int, bool] = {}
        self.edges: dict[str, tuple[list, list] | None] = {}
        self.shorter: dict[int, int] = {}
        apart = "".join(map(re.escape, sorted(self._apart())))
        runs = f" *[{apart}]+|" if apart else ""
        self.cut = re.compile(f"\n|{runs} *[^ \n{apart}]+| +")

    def _apart(self) -> set[str]:
        """Marks, digits and the like that stand in pieces with one another and behind blanks alone, so that no piece goes
        over the border between them and other characters."""
        apart = {c for p in self.ids for c in p if c <= "\uffff" and not c.isalpha()} - {" ", "\n", SPACE}
        inner = [p.lstrip(SPACE) for p in self.ids]
        while True:
            mixed = {c for p in inner if not apart.isdisjoint(p) and not apart.issuperset(p) for c in p}
            if apart.isdisjoint(mixed):
                return apart
            apart -= mixed

    def merge(self, text: str, trace: dict[str, tuple[str, str]] | None = None) -> list[str]:
        """Merging by definition: the adjacent pair with the best score first, the leftmost of equals.

        ``trace`` is filled with the two parts of each merged piece.
        """
        rank = self.rank
        part: list[str | None] = list(text)
        before, after = list(range(-1, len(part) - 1)), [*range(1, len(part)), -1]
        queue: list[tuple[float, int, int, str]] = []

        def offer(left: int, right: int) -> None:
            if left >= 0 and right >= 0 and (both := part[left] + part[right]) in rank:
                heapq.heappush(queue, (rank[both], left, right, both))

        for i in range(len(part) - 1):
            offer(i, i + 1)
        while queue:
            _, left, right, both = heapq.heappop(queue)
            if part[left] is None or part[right] is None or after[left] != right or part[left] + part[right] != both:
                continue
            if trace is not None:
                trace[both] = (part[left], part[right])
            part[left], part[right] = both, None
            after[left] = after[right]
            if after[left] >= 0:
                before[after[left]] = left
            offer(before[left], left)
            offer(left, after[left])
        return [p for p in part if p is not None]

    def _edges(self, piece: str) -> tuple[list, list] | None:
        """What stands at the left and at the right edge of a piece while it is merged: (part, rank of the merge that
        takes the part up), the whole piece first. None if merging does not make the piece of its own text."""
        if piece not in self.edges:
            trace: dict[str, tuple[str, str]] = {}
            if len(piece) > 1 and self.merge(piece, trace) != [piece]:
                self.edges[piece] = None
            else:
                sides = []
                for side in (0, 1):
                    part, taken, chain = piece, math.inf, []
                    while True:
                        chain.append((part, taken))
                        if len(part) == 1:
                            break
                        taken = self.rank[part]
                        part = trace[part][side]
                    sides.append(chain)
                self.edges[piece] = tuple(sides)
        return self.edges[piece]

    def _agree(self, left: int, right: int) -> bool:
        """Whether merging the two pieces' text gives the two pieces: both are merged again side by side, in the
        order of the ranks, and no merge over the boundary may come first (of equal ranks the leftmost does)."""
        key = left << 32 | right
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= MEMO_PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self._merge_again(self.name[left], self.name[right])
        return known

    def _merge_again(self, left: str, right: str) -> bool:
        one, two = self._edges(left), self._edges(right)
        if one is None or two is None:
            return False
        ends, starts = one[1], two[0]
        i, j = len(ends) - 1, len(starts) - 1
        while True:
            (a, a_taken), (b, b_taken) = ends[i], starts[j]
            over = self.rank.get(a + b)
            if over is not None and over < a_taken and over <= b_taken:
                return False
            if i == j == 0:
                return True
            if a_taken <= b_taken:
                i -= 1
            else:
                j -= 1

    def _numbered(self, char: str) -> int:
        """The number of a character; one without a piece is spelled in bytes."""
        number = self.number.get(char)
        if number is None:
            octets = [self.byte_ids[b] for b in char.encode("utf-8")]
            number = self.number[char] = len(self.name)
            self.name.append(char)
            self.decimal.append(" ".join(map(str, octets)))
            self.plain.append(self._text(octets))
        return number

    def _shorter(self, number: int) -> int:
        """The longest piece in front of this one, or a character of its own that no piece stands for; -1: none."""
        known = self.shorter.get(number)
        if known is None:
            piece = self.name[number]
            front = next((piece[:n] for n in range(len(piece) - 1, 1, -1) if piece[:n] in self.ids), piece[0] if len(piece) > 1 else None)
            known = self.shorter[number] = -1 if front is None else self._numbered(front)
        return known

    def split(self, text: str) -> list[str]:
        """The pieces of an escaped text."""
        return [self.name[n] for n in self.numbers(text)]

    def numbers(self, text: str) -> list[int]:
        """The numbers of the pieces of an escaped text.

        The longest matches are taken one behind the other until a piece does not agree with the one before it; only
        from there on are the longest matches at all positions looked up and positions marked as failed.
        """
        out: list[int] = []
        at, agreed = 0, self.pairs.get
        for last, (number, length) in self.found.iter_long(text):
            begin = last + 1 - length
            while at < begin:  # characters without a piece agree with any neighbour that merging makes
                other = self._numbered(text[at])
                if out and not self._agree(out[-1], other):
                    return self._backtracked(text, at, out)
                out.append(other)
                at += 1
            if out:
                known = agreed(out[-1] << 32 | number)
                if known is None:
                    known = self._agree(out[-1], number)
                if not known:
                    return self._backtracked(text, at, out)
            out.append(number)
            at = last + 1
        while at < len(text):
            other = self._numbered(text[at])
            if out and not self._agree(out[-1], other):
                return self._backtracked(text, at, out)
            out.append(other)
            at += 1
        return self._settled(text, out)

    def _backtracked(self, text: str, at: int, out: list[int]) -> list[int]:
        """The pieces of the text, of which ``out`` are the ones in front of ``at`` that agree so far."""
        size, name, pairs, shorter = len(text), self.name, self.pairs, self.shorter
        longest: list[int] = [-1] * size
        for last, (number, length) in self.found.iter(text):
            longest[last + 1 - length] = number  # ends come in order, so the longest comes last
        for i, number in enumerate(longest):
            if number < 0:
                longest[i] = self._numbered(text[i])
        failed = bytearray(size + 1)
        number = longest[at]
        while at < size:
            end = at + len(name[number])
            if not failed[end]:
                known = True
                if out:
                    known = pairs.get(out[-1] << 32 | number)
                    if known is None:
                        known = self._agree(out[-1], number)
                if known:
                    out.append(number)
                    at = end
                    if at < size:
                        number = longest[at]
                    continue
            less = shorter.get(number)
            if less is None:
                less = self._shorter(number)
            if less < 0:
                failed[at] = 1
                if not out:  # no agreeing list: cannot happen with distinct scores
                    return [self._numbered(p) for p in self.merge(text)]
                less = out.pop()  # is refused at once, as it ends at a failed position
                at -= len(name[less])
            number = less
        return self._settled(text, out)

    def _settled(self, text: str, out: list[int]) -> list[int]:
        if not self.tied.isdisjoint(out) and sum(n in self.tied for n in out) > 1:
            return [self._numbered(p) for p in self.merge(text)]
        return out

    def ids_of(self, pieces: list[str]) -> list[int]:
        ids: list[int] = []
        for piece in pieces:
            known = self.ids.get(piece)
            if known is None:
                ids += [self.byte_ids[b] for b in piece.encode("utf-8")]
            else:
                ids.append(known)
        return ids

    def segments(self, text: str) -> list[str]:
        """The text, a blank in front, cut where no piece goes on; what stands for a blank is one. Segments are escaped
        where they are split, for most are ASCII without that."""
        return self.cut.findall(" " + text.replace(SPACE, " ")) if text else []

    def encode(self, text: str) -> list[int]:
        """All ids, the end id last."""
        return [i for s in self.segments(text) for i in self.ids_of(self.split(s.replace(" ", SPACE)))] + [self.end]

    def decode(self, ids: list[int]) -> str:
        """The text of ids: bytes in a row as UTF-8 (what is no UTF-8 becomes U+FFFD), the blank in front dropped."""
        return self._text(ids).removeprefix(" ")

    def _text(self, ids: list[int]) -> str:
        out: list[str] = []
        octets = bytearray()
        for i in ids:
            if i in self.byte_of:
                octets.append(self.byte_of[i])
                continue
            if octets:
                out.append(octets.decode("utf-8", "replace"))
                octets = bytearray()
            if i not in self.controls:
                out.append(self.pieces[i].replace(SPACE, " "))
        if octets:
            out.append(octets.decode("utf-8", "replace"))
        return "".join(out)

    def _word(self, segment: str) -> None:
        """Keep a segment's decimal ids and what they decode to. Segments are whole characters, so byte runs never need
        their neighbours."""
        ids, texts = self.older
        if segment in ids:
            self.words[segment], self.texts[segment] = ids[segment], texts[segment]
            return
        numbers = self.numbers(segment.replace(" ", SPACE))
        decimal, plain = self.decimal, self.plain
        text = "".join([plain[n] for n in numbers])
        self.words[segment] = " ".join([decimal[n] for n in numbers])
        self.texts[segment] = segment if text == segment else text  # one string is kept of two equal ones

    def joined(self, text: str | None) -> tuple[int, str, str]:
        """Number of ids (end id included), the ids joined by a blank, and the text they decode to."""
        segments = self.segments(text or "")
        if not segments:
            return 1, str(self.end), ""
        if len(self.words) >= MEMO_WORDS:  # the older half goes
            self.older, self.words, self.texts = (self.words, self.texts), {}, {}
        words, long = self.words, []
        for segment in set(segments).difference(words):
            self._word(segment)
            if len(segment) > MEMO_LENGTH:
                long.append(segment)
        ids = " ".join(map(words.__getitem__, segments))
        decoded = "".join(map(self.texts.__getitem__, segments))
        for segment in long:
            del words[segment], self.texts[segment]
        return ids.count(" ") + 2, f"{ids} {self.end}", decoded.removeprefix(" ")

    @staticmethod
    def hashed(row: tuple[int, str, str]) -> tuple[int, str, str]:
        return row[0], hashlib.sha256(row[1].encode()).hexdigest(), hashlib.sha256(row[2].encode("utf-8", "surrogatepass")).hexdigest()

    def digest(self, text: str | None) -> tuple[int, str, str]:
        """Number of ids (end id included), SHA-256 of the ids and SHA-256 of the decoded text."""
        return self.hashed(self.joined(text))


_codecs: dict[bytes, PieceCodec] = {}


def codec(model: bytes) -> PieceCodec:
    """One codec for each model and Python worker."""
    key = hashlib.sha256(model).digest()
    if key not in _codecs:
        _codecs[key] = PieceCodec(model)
    return _codecs[key]


def model_bytes(path: str) -> bytes:
    """The model file, read where the job starts: half a megabyte that is broadcast to the workers."""
    with open(path, "rb") as file:
        return file.read()


def token_digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every whole text; null text as empty, which is the end id alone."""
    model = docs.sparkSession.sparkContext.broadcast(model_bytes(path))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = codec(model.value).digest
        for batch in batches:
            rows = [digest(t) for begin in range(0, batch.num_rows, SLICE) for t in batch["text"].slice(begin, SLICE).to_pylist()]
            n, ids, decoded = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"].cast(pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select("doc_id", "text").mapInArrow(encode, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def tokens(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256, decoded_sha256): the same with the ids themselves, for writing token files."""
    model = docs.sparkSession.sparkContext.broadcast(model_bytes(path))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = codec(model.value)
        for batch in batches:
            for begin in range(0, batch.num_rows, SLICE):
                part = batch.slice(begin, SLICE)
                rows = [one.joined(t) for t in part["text"].to_pylist()]
                ids = pa.array([np.array(r[1].split(" "), np.int32) for r in rows], pa.list_(pa.int32()))
                digests = [one.hashed(r) for r in rows]
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"].cast(pa.int64()), pa.array([r[0] for r in rows], pa.int64()), ids]
                    + [pa.array([d[k] for d in digests], pa.string()) for k in (1, 2)],
                    ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"],
                )

    return docs.select("doc_id", "text").mapInArrow(encode, "doc_id long, n_tokens long, ids array<int>, ids_sha256 string, decoded_sha256 string")
