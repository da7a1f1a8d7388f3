"""SentencePiece encoding and decoding by shared-prefix Viterbi.

A text is a row of marked words: a dummy blank in front, every blank written as the mark, a word starting at each run of
marks.  The distinct words of a batch are sorted, which lays out their trie in depth-first order: from one word to the next
the forward states up to the common prefix stay, and only the positions below it are computed.

What a forward state is depends on how the pieces were made:

* ``merges`` (files trained by merging pairs): the state at a position is the last piece of the encoding of the prefix.  A
  piece may follow another if the two, merged from their characters, stay those two; exactly one piece that ends at a
  position can follow the state at its start, so the result is that of merging, without merging any word.
* ``sums`` (unigram files): the state is the best sum of piece scores up to a position.

Characters without a piece become byte pieces.

Edge rules: null and empty texts have no pieces and decode to the empty text; texts and words of any length are coded
whole; the mark itself in a text counts as a blank; equal sums go to the longer last piece; repeated rows are coded each;
other columns pass through, and results take the names asked for.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from sentencepiece import SentencePieceProcessor

MARK = "▁"
WORD = re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n+")
PART_BYTES = 2_000_000  # text or ids that are held as Python objects at a time
WORDS = 300_000  # words remembered from batch to batch
MISSING = object()
PAIRS = 250_000  # remembered answers to whether a piece may follow another


class Pieces:
    """The pieces of a model file with their scores, prefixes, and bytes."""

    def __init__(self, path: str, rule: str = "merges"):
        model = SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        self.scores, self.ids, self.byte_ids, self.bytes = {}, {}, {}, []
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.bytes.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.bytes.append(b"")
            else:
                if piece.lstrip(MARK).find(MARK) >= 0:
                    raise ValueError(f"piece {piece!r} reaches over words")
                self.scores[piece], self.ids[piece] = model.get_score(i), i
                self.bytes.append(piece.replace(MARK, " ").encode())
        self.unknown_id, self.unknown_score = model.unk_id(), min(self.scores.values(), default=0.0) - 10
        self.rule, self.pairs, self.coded, self.known, self.piece_bytes = rule, {}, {}, {}, {}
        self.prefixes = {p[:k] for p in self.scores for k in range(1, len(p) + 1)}
        # marked words are cut at line ends as well, which is right as long as no piece holds one
        if any("\n" in p for p in self.scores):
            raise ValueError("a piece reaches over a line end")

    def codes(self, piece: str) -> list[int]:
        if piece in self.ids:
            return [self.ids[piece]]
        if len(self.byte_ids) == 256:
            return [self.byte_ids[b] for b in piece.encode("utf-8", "surrogatepass")]
        return [self.unknown_id]

    def stays(self, before: str, piece: str) -> bool:
        """Whether merging the characters of ``before`` and ``piece``, always the best-scored pair of neighbours and the leftmost
        of equals, gives these two.  It cannot once the best pair lies across their border."""
        parts, border = [*before, *piece], len(before)
        score = self.scores.get
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                return parts == ([before, piece] if before else [piece])
            if at + 1 == border:
                return False
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            border -= at + 1 < border

    def segmented(self, words: list[str]) -> dict[str, bytes]:
        """Ids of each distinct word as little-endian bytes."""
        return self.by_sums(words) if self.rule == "sums" else self.by_merges(words)

    def by_merges(self, words: list[str]) -> dict[str, bytes]:
        if not self.known:  # True for a piece, False for a mere prefix of pieces
            self.known = {p: p in self.scores for p in self.prefixes}
        known, pairs, as_bytes = self.known.get, self.pairs, self.as_bytes
        # per position: where the last piece of the prefix starts, that piece, and the starts that pieces run on from
        back, last, starts, before, out = [0], [""], [()], "", {}
        for word in sorted(words):
            keep = len(os.path.commonprefix((before, word)))
            del back[keep + 1 :], last[keep + 1 :], starts[keep + 1 :]
            before = word
            for end in range(keep + 1, len(word) + 1):
                origin, piece, alive = end - 1, word[end - 1], []
                open_still = True
                for start in (*starts[end - 1], end - 1):
                    part = word[start:end]
                    is_piece = known(part)
                    if is_piece is None:
                        continue
                    alive.append(start)
                    if is_piece and open_still:
                        pair = last[start], part
                        fits = pairs.get(pair)
                        if fits is None:
                            if len(pairs) >= PAIRS:
                                pairs.clear()
                            fits = pairs[pair] = self.stays(*pair)
                        if fits:
                            origin, piece, open_still = start, part, False
                back.append(origin)
                last.append(piece)
                starts.append(alive)
            codes, end = [], len(word)
            while end:
                codes.append(as_bytes(last[end]))
                end = back[end]
            codes.reverse()
            out[word] = b"".join(codes)
        return out

    def as_bytes(self, piece: str) -> bytes:
        made = self.piece_bytes.get(piece)
        if made is None:
            made = np.array(self.codes(piece), "<i4").tobytes()
            if len(self.piece_bytes) < PAIRS:
                self.piece_bytes[piece] = made
        return made

    def by_sums(self, words: list[str]) -> dict[str, bytes]:
        scores = self.scores
        known = {p: scores.get(p) for p in self.prefixes}  # pieces have a score, mere prefixes None
        # per position: the best sum up to it, where its last piece starts, and the starts that pieces run on from
        best, back, starts, before, out = [0.0], [0], [[]], "", {}
        for word in sorted(words):
            keep = len(os.path.commonprefix((before, word)))
            del best[keep + 1 :], back[keep + 1 :], starts[keep + 1 :]
            before = word
            for end in range(keep + 1, len(word) + 1):
                alive, top, origin = [], None, end - 1
                for start in [*starts[end - 1], end - 1]:
                    score = known.get(word[start:end], MISSING)
                    if score is MISSING:
                        continue
                    alive.append(start)
                    if score is not None and (top is None or best[start] + score > top):
                        top, origin = best[start] + score, start
                unknown = best[end - 1] + self.unknown_score
                if word[end - 1] not in scores and (top is None or unknown > top):
                    top, origin = unknown, end - 1
                best.append(top or 0.0)
                back.append(origin)
                starts.append(alive)
            codes, end = [], len(word)
            while end:
                codes.append(self.codes(word[back[end] : end]))
                end = back[end]
            out[word] = np.array([c for piece in reversed(codes) for c in piece], "<i4").tobytes()
        return out


LOADED: dict[tuple[str, str], Pieces] = {}  # by path and rule, kept while the worker process lives


def pieces_of(path: str, rule: str = "merges") -> Pieces:
    if (path, rule) not in LOADED:
        LOADED[path, rule] = Pieces(path, rule)
    return LOADED[path, rule]


def marked_words(text: str) -> list[str]:
    return WORD.findall(MARK + text.replace(" ", MARK)) if text else []


def encode_batch(pieces: Pieces, texts: list[str | None]) -> list[bytes]:
    rows = [marked_words(t or "") for t in texts]
    words = {w for row in rows for w in row}
    new = words - pieces.coded.keys()
    if len(pieces.coded) + len(new) > WORDS:  # words that this part has too stay
        pieces.coded = {w: pieces.coded[w] for w in words - new}
    coded = pieces.coded
    coded.update(pieces.segmented(list(new)))
    return [b"".join(map(coded.__getitem__, row)) for row in rows]


def decode_ids(pieces: Pieces, ids: list[int]) -> str:
    text = b"".join(map(pieces.bytes.__getitem__, ids)).decode("utf-8", "replace")
    return text[1:] if text.startswith(" ") else text


def parts(batch: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose values in column ``at`` have about ``PART_BYTES`` bytes or ids."""
    column = batch.column(at)
    sizes = pc.list_value_length(column) if pa.types.is_list(column.type) else pc.binary_length(column)
    begin, held = 0, 0
    for i, size in enumerate(sizes.to_pylist()):
        held += size or 0
        if held >= PART_BYTES:
            yield batch.slice(begin, i + 1 - begin)
            begin, held = i + 1, 0
    if begin < batch.num_rows:
        yield batch.slice(begin)


def encode(docs: DataFrame, model_path: str, text: str = "text", out: str = "ids", rule: str = "merges") -> DataFrame:
    """Every row with the ids of its text in a new column ``out``."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(model_path, rule)
        for batch in (p for b in batches for p in parts(b, at)):
            coded = encode_batch(pieces, batch.column(at).to_pylist())
            ends = np.cumsum([0] + [len(c) // 4 for c in coded], dtype=np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(coded), "<i4")))
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], names=[*batch.schema.names, out])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType()))]))


def decode(coded: DataFrame, model_path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Every row with the text of its ids in a new column ``out``; null ids give the empty text."""
    at = coded.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(model_path)
        for batch in (p for b in batches for p in parts(b, at)):
            column = batch.column(at)
            values, ends = column.values.to_numpy(), column.offsets.to_numpy()
            texts = [decode_ids(pieces, values[a:b].tolist()) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, out])

    return coded.mapInArrow(run, T.StructType([*coded.schema.fields, T.StructField(out, T.StringType())]))
