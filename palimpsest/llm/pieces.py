"""SentencePiece encoding and decoding by a streaming Viterbi pass.

The model is of the BPE sort: its segmentation is what greedy merging by score
gives, not the path of highest summed score. It still has a Viterbi form. A
sequence of pieces is the merge result exactly if every two neighbours are
*compatible*: merging their joined text gives these two again. So every
position has one last piece, whose predecessor (the last piece at its start) is
compatible with it; a backpointer leads there. The pass keeps backpointers for
a window bounded by the longest piece and commits ids as soon as the paths from
all positions of the window meet on one boundary. Characters that no piece
holds become bytes.

Texts part into units, runs of white space with what follows, that no piece
crosses; a bounded memory of units' ids spares most of them the pass.

Defined cases: a null text gives null ids and a null decoded text, an empty one
no id; ties of scores go to the leftmost merge; very long texts take time in
proportion to their length and memory for their ids; repeated rows give repeated
rows; an empty table gives an empty result; other columns are ignored. A model of
another sort, or one that changes the text first, is refused (``check_sort``).
"""

from __future__ import annotations

import hashlib
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from palimpsest.llm.common import long_lists, memory, slices

SPACE = "▁"
_UNIT = re.compile("▁+[^▁]*")
_MEMORY = 250_000


def _fields(data: bytes):
    """(number, value) of the fields of a protocol-buffer message: whole numbers and byte strings."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 2:
            n = varint()
            yield key >> 3, data[at : at + n]
            at += n
        else:
            n = 8 if kind == 1 else 4
            yield key >> 3, data[at : at + n]
            at += n


def check_sort(serialized: bytes) -> None:
    """Raises ValueError for a model file that this encoder would read wrongly.

    It must be of the BPE sort, put a blank before the text, keep repeated blanks and change no character.
    """
    # The fields of the format (trainer 2: sort 3, 2 is BPE; normaliser 3: rules 2, leading blank 3, single blanks 4, marks blanks 5).
    message = dict(_fields(serialized))
    trainer, rules = dict(_fields(message.get(2, b""))), dict(_fields(message.get(3, b"")))
    faults = []
    if trainer.get(3, 1) != 2:
        faults.append("not of the BPE sort")
    if rules.get(2):
        faults.append("has rules that change characters")
    if not rules.get(3, 1):
        faults.append("puts no blank before the text")
    if rules.get(4, 1):
        faults.append("makes repeated blanks one")
    if not rules.get(5, 1):
        faults.append("doesn't mark blanks")
    if faults:
        raise ValueError("piece model " + ", ".join(faults))


class PieceModel:
    """Pieces, scores and merges of a SentencePiece model file of the BPE sort with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        check_sort(sp.serialized_model_proto())
        self.names = [sp.id_to_piece(i) for i in range(sp.vocab_size())]
        self.bytes = {i: int(self.names[i][3:5], 16) for i in range(len(self.names)) if sp.is_byte(i)}
        self.byte_ids = {b: i for i, b in self.bytes.items()}
        special = {i for i in range(len(self.names)) if sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)}
        self.silent = {i for i in special if i not in self.bytes}
        self.ids = {p: i for i, p in enumerate(self.names) if i not in special}
        self.scores = {p: sp.get_score(i) for p, i in self.ids.items()}
        self.longest = max(map(len, self.ids))
        # No piece but runs of spaces has a space after another character: then units are independent.
        self.parts = all(SPACE not in p.lstrip(SPACE) for p in self.ids)
        lone = [c for p in self.ids for c in p if c not in self.ids]
        if lone:
            raise ValueError(f"pieces hold characters that are no pieces: {lone[:5]}")
        self.length = list(map(len, self.names))
        # A tree by character over the pieces that merging their own text gives back; a node is (id or -1, children).
        self.tree: dict[str, tuple] = {}
        for p, i in self.ids.items():
            if self.merge(p) == [p]:
                node = self.tree
                for c in p[:-1]:
                    node = node.setdefault(c, (-1, {}))[1]
                node[p[-1]] = (i, node[p[-1]][1] if p[-1] in node else {})
        # Neighbouring characters of some piece; between any others no piece and no merge reaches.
        self.inner = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        self._pair: dict[int, bool] = {}
        self._units: dict[str, tuple[int, ...]] = {}
        self._older: dict[str, tuple[int, ...]] = {}

    def merge(self, text: str) -> list[str]:
        """Greedy merging by score, the leftmost first of equal ones. For short strings only."""
        score, lowest = self.scores, float("-inf")
        s = list(text)
        x = [score.get(s[k] + s[k + 1], lowest) for k in range(len(s) - 1)]
        while x and (best := max(x)) > lowest:
            at = x.index(best)
            s[at : at + 2] = [s[at] + s[at + 1]]
            del x[at]
            if at < len(x):
                x[at] = score.get(s[at] + s[at + 1], lowest)
            if at:
                x[at - 1] = score.get(s[at - 1] + s[at], lowest)
        return s

    def compatible(self, a: int, b: int) -> bool:
        if len(self._pair) > 2 * _MEMORY:
            self._pair.clear()
        left, right = self.names[a], self.names[b]
        found = self._pair[a << 20 | b] = self.merge(left + right) == [left, right]
        return found

    def viterbi(self, text: str) -> tuple[list[int], int]:
        """(ids, the most positions held at once) of a text with spaces already marked."""
        tree, pair, length, longest = self.tree, self._pair, self.length, self.longest
        n, out, widest = len(text), [], 0
        low, before = 0, None  # all up to low is committed; before is the last committed piece
        back: list = [None] * (min(n, 3 * longest) + 1)  # back[k]: last piece of text[: low + k]; below -1: a character as bytes
        check = 2 * longest
        for start in range(n):
            previous = back[start - low] if start > low else before
            if start == check:
                # Live positions: those that a later piece can start at. Where do their paths meet?
                live = {start - k for k in range(longest) if start - k > low and back[start - k - low] is not None}
                while len(live) > 1 and min(live) > low:
                    top = max(live)
                    live.remove(top)
                    i = back[top - low]
                    live.add(top - (length[i] if i >= 0 else 1))
                if (meet := min(live, default=low)) > low:
                    out += self._path(text, back, low, meet)
                    before = back[meet - low]
                    widest, back, low = max(widest, start - low), back[meet - low :], meet
                    back[0] = None
                check = start + longest
                back += [None] * (2 * longest + start - low + 1 - len(back))
            if previous is None and start > 0:
                continue
            kids, at = tree, start - low
            for c in text[start : start + longest]:
                at += 1
                node = kids.get(c)
                if node is None:
                    if at == start - low + 1:
                        back[at] = -2 - ord(c)
                    break
                i, kids = node
                if i >= 0 and back[at] is None:
                    if previous is None or previous < 0:
                        back[at] = i
                    else:
                        fits = pair.get(previous << 20 | i)
                        if self.compatible(previous, i) if fits is None else fits:
                            back[at] = i
        if n > low:
            out += self._path(text, back, low, n)
        return out, max(widest, n - low)

    def _path(self, text: str, back: list, low: int, at: int) -> list[int]:
        """Ids of the path that leads from ``low`` to ``at``."""
        ids: list[int] = []
        while at > low:
            i = back[at - low]
            if i >= 0:
                ids.append(i)
                at -= self.length[i]
            else:
                at -= 1
                ids += [self.byte_ids[b] for b in reversed(text[at].encode("utf-8", "surrogatepass"))]
        return ids[::-1]

    def _unit(self, unit: str) -> tuple[int, ...]:
        """Ids of a unit that is not in the newer memory; parts that no merge links are looked up apart."""
        got = self._older.get(unit)
        if got is None:
            inner, at, parts = self.inner, 0, []
            for k in range(1, len(unit)):
                if unit[k - 1 : k + 1] not in inner:
                    parts.append(unit[at:k])
                    at = k
            if parts:
                parts.append(unit[at:])
                got = tuple(chain.from_iterable(self._units.get(x) or self._unit(x) for x in parts))
            else:
                got = tuple(self.viterbi(unit)[0])
        if len(unit) <= 64:
            if len(self._units) >= _MEMORY:
                self._older, self._units = self._units, {}
            self._units[unit] = got
        return got

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text."""
        if not text:
            return np.zeros(0, dtype=np.int32)
        marked = SPACE + text.replace(" ", SPACE)
        if not self.parts:
            return np.array(self.viterbi(marked)[0], dtype=np.int32)
        found = [self._units.get(u) or self._unit(u) for u in _UNIT.findall(marked)]
        return np.fromiter(chain.from_iterable(found), dtype=np.int32)

    def decode(self, ids) -> str:
        """The text of ids; runs of byte pieces are read as UTF-8."""
        names, of, out, held = self.names, self.bytes, [], bytearray()
        for i in ids:
            if i in of:
                held.append(of[i])
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held = bytearray()
            if i not in self.silent:
                out.append(names[i])
        if held:
            out.append(held.decode("utf-8", "replace"))
        text = "".join(out).replace(SPACE, " ")
        return text[1:] if text.startswith(" ") else text


def piece_model(path: str) -> PieceModel:
    """The model, loaded once in each worker that encodes."""
    return memory((PieceModel, path), lambda: PieceModel(path))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids, decoded_sha256, round_trip.

    ``decoded_sha256`` is of the text that the ids decode to; ``round_trip`` says
    whether that is the text (a text that has the mark U+2581 itself decodes to blanks there).
    """

    def run(batches):
        model = piece_model(path)
        for b in slices(batches, 128):
            ids, digests, same = [], [], []
            for text in b.column("text").to_pylist():
                found = model.encode(text or "")
                back = None if text is None else model.decode(found.tolist())
                ids.append(found)
                digests.append(None if text is None else hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest())
                same.append(None if text is None else back == text)
            lists = long_lists(ids, pa.int32())
            if any(t is None for t in same):
                lists = pa.array([None if t is None else i for i, t in zip(lists.to_pylist(), same)], pa.list_(pa.int32()))
            yield pa.record_batch(
                [b.column("doc_id"), pa.array([None if t is None else len(i) for i, t in zip(ids, same)], pa.int64()), lists, pa.array(digests, pa.string()), pa.array(same, pa.bool_())],
                names=["doc_id", "n_tokens", "ids", "decoded_sha256", "round_trip"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, decoded_sha256 string, round_trip boolean")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of rows with doc_id and ids; null ids give a null text."""

    def run(batches):
        model = piece_model(path)
        for b in slices(batches, 128):
            texts = [None if i is None else model.decode(i) for i in b.column("ids").to_pylist()]
            yield pa.record_batch([b.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
