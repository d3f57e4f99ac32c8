"""SentencePiece encoding by Viterbi over a trie of distinct words, and decoding.

A text is normalised by the model and cut before every run of word marks; where no piece
holds a mark behind another character (checked when the model is loaded) no piece crosses
such a cut, so words are segmented on their own. A task collects the distinct marked words
it has not met, sorts them and walks them as a trie depth-first: neighbours in sorted order
share a prefix, and the forward scores of that prefix (best score and back pointer per
position) are kept from the word before, so each trie edge is scored once.

The best path is the one with the highest sum of the model file's piece scores; ties take
the longer last piece's earlier start, a character without a piece scores the least score
minus 10 and is written as its bytes where the model has byte pieces, else as unknown
(neighbouring unknowns become one). For unigram models these are the library's own ids,
but for paths of equal score that its single-precision sums order otherwise.
The scores in a BPE model file are merge ranks, not log-probabilities; there a piece of
rank r gets -ln(r + RANK_OFFSET) (Zipf's law), and the path is the most probable one under
that, which is not always what replaying the merges gives.

Defined cases: a null text is empty and has no pieces; equal words, repeated documents and
very long words need no special case; an empty table gives an empty result; extra columns
pass through.
"""
from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import free_name, slices

MARK = "▁"
UNKNOWN_PENALTY = 10.0
RANK_OFFSET = 100
MEMO_WORDS = 200_000

_WORDS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


class PieceModel:
    """Pieces and scores of a SentencePiece model, read through the library."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        self.unknown = sp.unk_id()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.bytes_at = {int(self.pieces[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        usable = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unused(i) or i == self.unknown)]
        self.ids = {self.pieces[i]: i for i in usable}
        scores = [sp.get_score(i) for i in usable]
        if len(set(scores)) > 1 and all(s <= 0 and s == int(s) for s in scores):
            scores = [-math.log(RANK_OFFSET - s) for s in scores]
        self.scores = {self.pieces[i]: s for i, s in zip(usable, scores)}
        self.trie: dict = {}  # character -> deeper dict; "" -> (score, id) where a piece ends
        for piece, i in self.ids.items():
            node = self.trie
            for char in piece:
                node = node.setdefault(char, {})
            node[""] = (self.scores[piece], i)
        self.unknown_score = min(self.scores.values(), default=0.0) - UNKNOWN_PENALTY
        self.by_word = not any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids)
        self.dummy_prefix = sp.normalize("a").startswith(MARK)
        self.shown = [p.replace(MARK, " ").encode() for p in self.pieces]
        for byte, i in self.bytes_at.items():
            self.shown[i] = bytes([byte])

    def words(self, text: str) -> list[str]:
        marked = self.sp.normalize(text)
        return _WORDS.findall(marked) if self.by_word else [marked] if marked else []

    def segment(self, words: list[str]) -> list[list[int]]:
        """Ids of each of the sorted distinct ``words``. The stacks hold, per position of the
        current word, the best score, its last step (start, id; id None: no piece) and the
        places in the piece trie that pieces begun earlier have reached; what belongs to the
        prefix shared with the word before stays on them."""
        root, unknown, last, out = self.trie, self.unknown_score, "", []
        best, step, open_ = [0.0], [None], [[]]
        for word in words:
            shared, limit = 0, min(len(word), len(last))
            while shared < limit and word[shared] == last[shared]:
                shared += 1
            del best[shared + 1:], step[shared + 1:], open_[shared + 1:]
            for at in range(shared, len(word)):
                char, top, origin, reached = word[at], -math.inf, None, []
                for start, node in open_[at]:
                    node = node.get(char)
                    if node is not None:
                        reached.append((start, node))
                        piece = node.get("")
                        if piece is not None and best[start] + piece[0] > top:
                            top, origin = best[start] + piece[0], (start, piece[1])
                node, piece = root.get(char), None
                if node is not None:
                    reached.append((at, node))
                    piece = node.get("")
                score, end_id = piece or (unknown, None)
                if best[at] + score > top:
                    top, origin = best[at] + score, (at, end_id)
                best.append(top)
                step.append(origin)
                open_.append(reached)
            out.append(self._path(word, step))
            last = word
        return out

    def _path(self, word: str, step: list) -> list[int]:
        taken, end = [], len(word)
        while end:
            taken.append((*step[end], end))
            end = step[end][0]
        ids: list[int] = []
        for start, piece, end in reversed(taken):
            if piece is not None:
                ids.append(piece)
            elif self.bytes_at:
                ids.extend(self.bytes_at[b] for b in word[start:end].encode())
            elif not ids or ids[-1] != self.unknown:
                ids.append(self.unknown)
        return ids

    def plain(self, text: str) -> str:
        """The normalised text with its marks as blanks: what decoding must give."""
        marked = self.sp.normalize(text).replace(MARK, " ")
        return marked[1:] if self.dummy_prefix and marked.startswith(" ") else marked

    def decode(self, ids) -> str:
        """Text of the pieces: marks become blanks, byte pieces their bytes, the dummy prefix goes."""
        text = b"".join(map(self.shown.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text


def load_model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, model: bytes, text: str = "text", check: bool = False) -> DataFrame:
    """``docs`` with ``ids`` (array of piece ids) in place of a column of that name. ``check`` also
    decodes every document and adds ``decoded_ok``: whether that gives the normalised text back.
    Columns that differ from these in case only stay; the new ones then end in an underscore."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    wanted = {"ids": T.ArrayType(T.IntegerType())} | ({"decoded_ok": T.BooleanType()} if check else {})
    keep = [c for c in docs.columns if c not in wanted]
    added = [T.StructField(free_name(keep, c), kind) for c, kind in wanted.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, memo = PieceModel(shared.value), {}
        for batch in slices(batches):
            texts = [t or "" for t in batch.column(batch.schema.names.index(text)).to_pylist()]
            words = [pieces.words(t) for t in texts]
            if len(memo) > MEMO_WORDS:
                memo.clear()
            new = sorted(set().union(*words) - memo.keys())
            memo.update(zip(new, (array("i", x).tobytes() for x in pieces.segment(new))))
            coded = [np.frombuffer(b"".join(map(memo.__getitem__, w)), "<i4") for w in words]
            offsets = np.concatenate([[0], np.cumsum([len(c) for c in coded])]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*coded, np.empty(0, "<i4")])))
            columns = [batch.column(batch.schema.names.index(c)) for c in keep] + [ids]
            if check:
                columns.append(pa.array([pieces.decode(c.tolist()) == pieces.plain(t) for c, t in zip(coded, texts)], pa.bool_()))
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, *(f.name for f in added)])

    return docs.mapInArrow(run, T.StructType([docs.schema[c] for c in keep] + added))


def decode(coded: DataFrame, model: bytes, ids: str = "ids", column: str = "decoded") -> DataFrame:
    """``coded`` with the text of its piece ids (null ids: null), named as ``encode`` names its columns."""
    shared = coded.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in coded.columns if c != column]
    column = free_name(keep, column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = PieceModel(shared.value)
        for batch in slices(batches):
            texts = [None if x is None else pieces.decode(x) for x in batch.column(batch.schema.names.index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.names.index(c)) for c in keep), pa.array(texts, pa.string())], names=[*keep, column])

    return coded.mapInArrow(run, T.StructType([coded.schema[c] for c in keep] + [T.StructField(column, T.StringType())]))
