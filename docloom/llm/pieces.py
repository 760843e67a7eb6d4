"""SentencePiece ids of whole texts, for merge-type (BPE) vocabularies, and texts of ids.

Encoding is a score-ordered agenda: all adjacent symbol pairs that form a piece
stand in a heap, best score first and leftmost of equals; the first is merged,
its neighbours form new pairs, until none is left. A symbol that is no piece
becomes the pieces of its bytes.

No merge crosses two characters that stand side by side in no piece, so texts
are cut there and each different stretch goes through the agenda once a worker;
cuts and lookups are numpy over an Arrow batch. Whatever the agenda says of a
new stretch is compared with the sentencepiece library in the same batch; a
difference raises. ``tests/llm`` compares whole texts.

A null text is encoded as an empty one: the end id alone (nothing without it).
U+2581 in a text is the vocabulary's blank, as in the library. Rows stay as they
are, repeats and null ids included; other columns aren't read. A very long text
is one row's memory, a multiple of its bytes. An empty table gives an empty one.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textarrays as ta
from .bpe import Units

BLANK = "▁"
#: Sets a checked stretch apart from the blank that the library puts before a text; it is in no piece.
_APART = "\n"
#: Characters whose pairs are looked up in a table; others' are searched for.
_NEAR = 1024


class Vocabulary(Units):
    """``ids(column)``: all ids of the rows on end, and where each row starts, without end ids."""

    def __init__(self, path: str, check: bool = True):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        with open(path, "rb") as f:
            model = proto.ModelProto.FromString(f.read())
        kind, norm, spec = proto.ModelProto.SentencePiece, model.normalizer_spec, model.trainer_spec
        wants = {
            "model_type is BPE": spec.model_type == spec.BPE, "byte_fallback is on": spec.byte_fallback, "whitespace stands before words": not spec.treat_whitespace_as_suffix,
            "text isn't normalised": not norm.precompiled_charsmap and not norm.remove_extra_whitespaces, "a blank is put first": norm.add_dummy_prefix and norm.escape_whitespaces,
            "pieces are normal, bytes or control": {p.type for p in model.pieces} <= {kind.NORMAL, kind.BYTE, kind.CONTROL, kind.UNKNOWN},
        }
        if missing := [k for k, held in wants.items() if not held]:
            raise ValueError(f"not a vocabulary of this kind: {', '.join(missing)}")
        self.check = check
        self.lib = sentencepiece.SentencePieceProcessor(model_file=path)
        self.id = {p.piece: k for k, p in enumerate(model.pieces) if p.type == kind.NORMAL}
        self.cost = {p.piece: -p.score for p in model.pieces if p.type == kind.NORMAL and len(p.piece) > 1}
        self.byte = [self.lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.end = self.lib.eos_id()
        if any(_APART in p for p in self.id):
            raise ValueError("a piece holds a line end")
        pairs = {(ord(a), ord(b)) for p in self.id for a, b in zip(p, p[1:])}
        self.near = np.zeros((_NEAR, _NEAR), bool)
        for a, b in pairs:
            if max(a, b) < _NEAR:
                self.near[a, b] = True
        blank = ord(BLANK)
        for c in range(_NEAR):  # a blank of the text is the vocabulary's
            self.near[32, c] = (blank, c) in pairs
            self.near[c, 32] = (c, blank) in pairs
        self.near[32, 32] = (blank, blank) in pairs
        every = {(32 if a == blank else a, 32 if b == blank else b) for a, b in pairs}
        self.far = np.array(sorted(a << 32 | b for a, b in every if max(a, b) >= _NEAR), np.int64)
        super().__init__()

    def agenda(self, text: str) -> list[str]:
        """The pieces and left-over characters of a stretch, blanks as U+2581."""
        sym = list(text)
        n = len(sym)
        cost = self.cost
        heap = [(c, i, p) for i in range(n - 1) if (c := cost.get(p := sym[i] + sym[i + 1])) is not None]
        heapq.heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            _, i, piece = heapq.heappop(heap)
            j = after[i]
            if j >= n or not sym[i] or sym[i] + sym[j] != piece:
                continue  # one of the two has been merged since
            sym[i], sym[j] = piece, ""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (c := cost.get(p := piece + sym[k])) is not None:
                    heapq.heappush(heap, (c, i, p))
            h = before[i]
            if h >= 0 and (c := cost.get(p := sym[h] + piece)) is not None:
                heapq.heappush(heap, (c, h, p))
        return [s for s in sym if s]

    def encode_units(self, units: list[bytes]) -> list[list[int]]:
        known, byte, out = self.id, self.byte, []
        texts = [u.decode() for u in units]
        for t in texts:
            ids: list[int] = []
            for s in self.agenda(t.replace(" ", BLANK)):
                k = known.get(s)
                ids += [k] if k is not None else [byte[b] for b in s.encode()]
            out.append(ids)
        if self.check:
            lead = len(self.lib.encode(_APART))
            for t, mine, theirs in zip(texts, out, self.lib.encode([_APART + t for t in texts], num_threads=1), strict=True):
                if theirs[lead:] != mine:
                    raise AssertionError(f"{t!r}: the agenda gives {mine}, sentencepiece {theirs[lead:]}")
        return out

    def ids(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        buf, offs = ta.raw(col)
        if not len(buf):
            return np.zeros(0, np.uint32), np.zeros(len(offs), np.int64)
        if (marked := np.flatnonzero((buf[:-2] == 0xE2) & (buf[1:-1] == 0x96) & (buf[2:] == 0x81))).size:
            keep = np.ones(len(buf), bool)
            keep[marked + 1] = keep[marked + 2] = False
            buf = buf.copy()
            buf[marked] = 32
            offs = np.concatenate([[0], np.cumsum(keep)])[offs]
            buf = buf[keep]
        full = offs[:-1] < offs[1:]
        buf = np.insert(buf, offs[:-1][full], np.uint8(32))  # the blank before each text
        offs = offs + np.concatenate([[0], np.cumsum(full)])
        at = np.flatnonzero((buf & 0xC0) != 0x80)
        code = ta.code_points(buf, at)
        a, b = code[:-1], code[1:]
        joined = np.zeros(len(a), bool)
        near = (a < _NEAR) & (b < _NEAR)
        joined[near] = self.near[a[near], b[near]]
        if len(self.far) and not near.all():
            key = (a[~near] << 32) | b[~near]
            slot = np.minimum(np.searchsorted(self.far, key), len(self.far) - 1)
            joined[~near] = self.far[slot] == key
        cut = np.zeros(len(buf), bool)
        cut[at[1:][~joined]] = True
        cut[offs[:-1][full]] = True
        return self.look_up(buf, offs, cut)


_vocabularies: dict[tuple[str, bool], Vocabulary] = {}


def vocabulary(path: str, check: bool = True) -> Vocabulary:
    """One for each worker process and file, with what it has learned so far."""
    if (path, check) not in _vocabularies:
        _vocabularies[path, check] = Vocabulary(path, check)
    return _vocabularies[path, check]


def encode(docs: DataFrame, path: str, end: bool = True, check: bool = True, decoded: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids) of docs (doc_id, text), and with ``decoded`` the text that the library makes of the ids again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = vocabulary(path, check)
        for whole in batches:
            for b in ta.slices(whole, "text"):
                ids, at = voc.ids(ta.column(b, "text"))
                if end:
                    ids, at = np.insert(ids, at[1:], np.uint32(voc.end)), at + np.arange(len(at))
                cols = [b.column(0), pa.array(np.diff(at), pa.int64()), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.view(np.int32)))]
                if decoded:
                    flat = ids.tolist()
                    cols.append(pa.array(voc.lib.decode([flat[x:y] for x, y in zip(at[:-1], at[1:], strict=True)]), pa.string()))
                yield pa.RecordBatch.from_arrays(cols, names)

    names = ["doc_id", "n_tokens", "ids", *["decoded"] * decoded]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(ta.lean(run), "doc_id long, n_tokens long, ids array<int>" + ", decoded string" * decoded)


def decode(rows: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids), by the library; null ids give a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lib = vocabulary(path).lib
        for b in batches:
            said = [None if x is None else lib.decode(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(said, pa.string())], ["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(ta.lean(run), "doc_id long, text string")
