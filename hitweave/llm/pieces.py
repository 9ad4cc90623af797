"""SentencePiece encoding and decoding: Aho-Corasick over the pieces drives a single-pass Viterbi (operator 8).

A text gets a leading space and its spaces become the space mark. The automaton reads it once; at each position the output links name
every piece that ends there, and each relaxes the best score of that position. A character that no piece covers alone falls back to
the pieces of its UTF-8 bytes (to the unknown piece where the vocabulary has none), at the least piece score less ten.
Scores of a merge-ranked vocabulary are its ranks, so the best path is the one of least total rank.

No piece has a space mark after another character, nor a character that no longer piece holds; the best path therefore splits at these
places, and equal stretches between them are encoded once and remembered (the store is emptied when it is full). Results are those of
one pass over the whole text.

Defined cases: null texts count as empty and have no pieces; ties go to the longer last piece; a space mark in the text itself comes
back as a space, all other texts come back as they were; repeated rows get equal pieces; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SPACE = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"  # a default: `Vocabulary.load` takes any path that driver and executors can read
#: Characters of stretches that a worker remembers; a longer stretch is encoded anew each time.
REMEMBERED, LONGEST = 4_000_000, 200
UNKNOWN_PENALTY = 10.0


@dataclass
class Vocabulary:
    """pieces with scores by id; ordinary: the ids that may be found in text; bytes: id by byte value; unknown: its id."""

    pieces: list[str]
    scores: list[float]
    ordinary: list[int]
    bytes: dict[int, int]
    unknown: int
    prefix: bool = True
    _encoder: "Encoder | None" = field(default=None, repr=False, compare=False)
    _spelled: "list[bytes] | None" = field(default=None, repr=False, compare=False)

    @staticmethod
    def load(path: str = MODEL) -> "Vocabulary":
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=path)
        n = p.get_piece_size()
        pieces = [p.id_to_piece(i) for i in range(n)]
        special = [p.is_control(i) or p.is_unknown(i) or p.is_unused(i) or p.is_byte(i) for i in range(n)]
        return Vocabulary(pieces, [p.get_score(i) for i in range(n)], [i for i in range(n) if not special[i]], {int(pieces[i][3:5], 16): i for i in range(n) if p.is_byte(i)}, p.unk_id())

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("_encoder", "_spelled")} | {"_encoder": None, "_spelled": None}

    def encoder(self) -> "Encoder":
        if self._encoder is None:
            self._encoder = Encoder(self)
        return self._encoder

    def decode(self, ids) -> str:
        """The text of a sequence of ids."""
        if self._spelled is None:
            byte = {i: b for b, i in self.bytes.items()}
            self._spelled = [bytes([byte[i]]) if i in byte else (" ⁇ " if i == self.unknown else p).encode() for i, p in enumerate(self.pieces)]
        out = b"".join(map(self._spelled.__getitem__, np.asarray(ids, np.int64).tolist()))
        text = out.decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if self.prefix and text.startswith(" ") else text


class Encoder(dict):
    """Ids (32-bit, as bytes) of stretches of text; a stretch that isn't known yet is encoded."""

    def __init__(self, v: Vocabulary):
        super().__init__()
        self.v, self.held = v, 0
        self.automaton = ahocorasick.Automaton()
        self.single: set[str] = set()
        longer: set[str] = set()
        for i in v.ordinary:
            piece = v.pieces[i]
            self.automaton.add_word(piece, (i, len(piece), v.scores[i]))
            if len(piece) == 1:
                self.single.add(piece)
            else:
                longer.update(piece)
                if SPACE in piece.lstrip(SPACE):
                    raise ValueError(f"a piece has a space mark inside: {piece!r}")
        self.automaton.make_automaton()
        self.lost = min((v.scores[i] for i in v.ordinary), default=0.0) - UNKNOWN_PENALTY
        inner = "".join(map(re.escape, sorted(longer - {SPACE})))
        self.stretches = re.compile(f"{SPACE}*[{inner}]+|{SPACE}+|." if inner else f"{SPACE}+|.", re.S)

    def viterbi(self, s: str) -> list[int]:
        """Ids of the best path over a string of space marks and characters."""
        n = len(s)
        best, via = [0.0] + [float("-inf")] * n, [None] * (n + 1)
        matches = self.automaton.iter(s)
        after = next(matches, None)
        for end in range(n):
            while after is not None and after[0] == end:
                i, size, score = after[1]
                total = best[end + 1 - size] + score
                if total > best[end + 1]:
                    best[end + 1], via[end + 1] = total, (i, size)
                after = next(matches, None)
            if s[end] not in self.single and best[end] + self.lost > best[end + 1]:
                best[end + 1], via[end + 1] = best[end] + self.lost, None
        out, at = [], n
        while at:
            if via[at] is None:
                code = s[at - 1].encode("utf-8", "replace")
                out += [self.v.bytes[b] for b in reversed(code)] if self.v.bytes else [self.v.unknown]
                at -= 1
            else:
                out.append(via[at][0])
                at -= via[at][1]
        return out[::-1]

    def __missing__(self, s: str) -> bytes:
        got = np.array(self.viterbi(s), np.int32).tobytes()
        if len(s) <= LONGEST:
            if self.held > REMEMBERED:
                self.clear()
                self.held = 0
            self[s] = got
            self.held += len(s)
        return got

    def marked(self, text: str) -> str:
        return (SPACE if self.v.prefix else "") + text.replace(" ", SPACE) if text else ""

    def ids(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.stretches.findall(self.marked(text))))


def encode(docs: DataFrame, vocabulary: Vocabulary | None = None, batch_ids: int = 1_000_000, decoded: bool = False) -> DataFrame:
    """doc_id, n_pieces, ids of every row; results leave in batches of about `batch_ids` ids.

    With `decoded` the ids are decoded as well: the SHA-256 of the text that they give, and whether it is the text that went in.
    """
    vocabulary = vocabulary or Vocabulary.load()
    schema = pa.schema([("doc_id", pa.int64()), ("n_pieces", pa.int64()), ("ids", pa.list_(pa.int32()))] + [("decoded_sha256", pa.string()), ("same", pa.bool_())] * decoded)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = vocabulary.encoder()

        def packed(keys: list, parts: list[bytes], back: list[tuple[str, bool]]) -> pa.RecordBatch:
            sizes = np.array([len(p) // 4 for p in parts], np.int64)
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(parts), np.int32), pa.int32()))
            columns = [pa.array([b[0] for b in back], pa.string()), pa.array([b[1] for b in back], pa.bool_())] if decoded else []
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), ids, *columns], schema=schema)

        for batch in batches:
            keys, parts, back, held = [], [], [], 0
            for key, given in zip(batch.column(0), batch.column(1)):
                text = given.as_py() or ""
                keys.append(key.as_py())
                parts.append(encoder.ids(text))
                if decoded:
                    got = vocabulary.decode(np.frombuffer(parts[-1], np.int32))
                    back.append((hashlib.sha256(got.encode("utf-8", "replace")).hexdigest(), got == text))
                held += len(parts[-1]) // 4
                if held >= batch_ids:
                    yield packed(keys, parts, back)
                    keys, parts, back, held = [], [], [], 0
            yield packed(keys, parts, back)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_pieces long, ids array<int>" + ", decoded_sha256 string, same boolean" * decoded)


def decode(encoded: DataFrame, vocabulary: Vocabulary | None = None) -> DataFrame:
    """doc_id, text of every row of (doc_id, ids); null ids give an empty text."""
    from hitweave.llm.common import arrow_map

    vocabulary = vocabulary or Vocabulary.load()
    return arrow_map(encoded, lambda keys, ids: {"doc_id": keys, "text": [vocabulary.decode(x or []) for x in ids]}, "doc_id long, text string", "doc_id", "ids")
