"""SentencePiece encoding and decoding by a streaming Viterbi search.

For a BPE vocabulary the best segmentation is the one that the merges produce. It has a local form:
a sequence of pieces is the merge result of its text exactly if each two neighbours are, together,
the merge result of their own text; and each prefix of a text ends in exactly one piece of its
merge result. So the search keeps, per position, the pieces whose pairing with the piece before is
stable (its score is that of the merges, others are ruled out), with a backpointer each.

Only positions within the longest piece's length of the read position can still be extended; they
form the window. As soon as the backpointer paths of all of them meet in one boundary, the ids up to
that boundary are committed and forgotten, so that a text of any length needs a window only.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tracewell.llm.common import append_columns, read_table

SPACE = "▁"
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")
_SLICE = 1 << 16  # characters of a text that are cut into stretches at a time


class PieceModel:
    """The pieces of a .model file of kind BPE with byte fallback and without text normalisation."""

    def __init__(self, path: str, most_cached: int = 150_000):
        from sentencepiece import SentencePieceProcessor
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        spec = proto.normalizer_spec
        if proto.trainer_spec.model_type != proto.trainer_spec.BPE or not proto.trainer_spec.byte_fallback:
            raise ValueError(f"{path}: not a BPE model with byte fallback")
        if spec.name != "identity" or spec.remove_extra_whitespaces or not spec.escape_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError(f"{path}: a model that normalises its texts")
        library = SentencePieceProcessor(model_file=path)
        self.prefix = SPACE if spec.add_dummy_prefix else ""
        self.ids: dict[str, int] = {}
        self.rank: dict[str, float] = {}
        self.bytes_of: list[bytes] = []
        self.byte_ids = [0] * 256
        for i, p in enumerate(proto.pieces):
            if library.is_byte(i):
                value = int(_BYTE.fullmatch(p.piece)[1], 16)
                self.byte_ids[value] = i
                self.bytes_of.append(bytes([value]))
            elif library.is_control(i) or library.is_unknown(i):
                self.bytes_of.append(b"")
            elif p.type not in (0, pb.ModelProto.SentencePiece.NORMAL):
                raise ValueError(f"{path}: piece {i} is user-defined or unused; only plain pieces are searched for")
            else:
                self.ids[p.piece] = i
                self.rank[p.piece] = p.score
                self.bytes_of.append(p.piece.replace(SPACE, " ").encode())
        self.longest = max(map(len, self.ids))
        self.widest = 0  # characters that the window has held at most
        self.trie: dict[str, tuple] = {}  # character -> (the trie below it, [the piece that ends there])
        for p in self.ids:
            below = self.trie
            for c in p:
                below, ends = below.setdefault(c, ({}, [None]))
            ends[0] = p
        self.trie = self._frozen(self.trie)
        self.stable_after: dict[str, dict[str, bool]] = {}  # by the piece before
        # no piece holds a space mark after another character: every path has a boundary there
        self.word_bound = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self.chunk = self._bounds() if self.word_bound else re.compile("(?s).+")
        self.stable: dict[tuple[str, str], bool] = {}
        self.known: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}  # known before; what is used again moves up
        self.most_cached = most_cached

    def _frozen(self, below: dict) -> dict:
        return {c: (self._frozen(more), ends[0]) for c, (more, ends) in below.items()}

    def _bounds(self) -> re.Pattern:
        """Stretches between boundaries that every path has: two characters that stand side by side in
        no piece always fall to two pieces. Used where words meet spaces, line ends and marks."""
        beside = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        marks = [c for c in ".,;:!?%&#$*|)\"'" if not any(b[1] == c and re.match(r"\w", b[0]) for b in beside)]
        m = "".join(map(re.escape, marks))
        line = not any("\n" in p for p in self.ids)
        n = "\n" if line else ""
        return re.compile(rf"{SPACE}*(?:\w+(?=[{SPACE}{n}{m}]|\Z)|[^{SPACE}{n}]+)|{SPACE}+" + (r"|\n" if line else ""))

    @staticmethod
    def load(path: str) -> PieceModel:
        """One model per worker process and file, kept with the interpreter: functions that travel by
        value bring new globals with each task, and what the model has learned should outlive them."""
        loaded = sys.__dict__.setdefault("_tracewell_pieces", {})
        if path not in loaded:
            loaded[path] = PieceModel(path)
        return loaded[path]

    def merged(self, text: str) -> list[str]:
        """The merge result of a short text, straight from the definition; used for pairs of pieces."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.rank.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def pair(self, left: str, right: str) -> bool:
        key = (left, right)
        found = self.stable.get(key)
        if found is None:
            found = self.merged(left + right) == [left, right]
            if len(self.stable) >= self.most_cached:
                self.stable.clear()
            self.stable[key] = found
        return found

    def ids_of(self, piece: str) -> list[int]:
        i = self.ids.get(piece)
        return [i] if i is not None else [self.byte_ids[b] for b in piece.encode("utf-8", "surrogatepass")]

    def viterbi(self, blocks: Iterable[str]) -> Iterator[list[str]]:
        """The pieces of a text that comes in blocks of characters, some at a time, as soon as all surviving paths share them.

        The window holds the characters from the last commit on. A position is extended once the
        characters of the longest piece from there are read. When twice that many are extended, the
        backpointer paths of all positions that can still be extended are followed to the boundary that
        they share; what lies before it is committed and leaves the window.
        """
        longest, root, stable = self.longest, self.trie, self.stable_after
        source = iter(blocks)
        window, i, due, ended = "", 0, 2 * longest, False
        last: list[str | None] = [""]  # the piece that ends at a position of the window; for its start, the piece before it
        while True:
            while not ended and len(window) - i < longest:
                block = next(source, None)
                if block is None:
                    ended = True
                else:
                    window += block
                    last += [None] * len(block)
                    self.widest = max(self.widest, len(window))
            n = len(window)
            if i == n:
                break
            for i in range(i, min(n if ended else n - longest + 1, due)):  # noqa: B020
                before = last[i]
                if before is None:
                    continue
                after = stable.get(before)
                if after is None:
                    after = stable[before] = {}
                node = root.get(window[i])
                if node is None or node[1] is None:
                    last[i + 1] = window[i]  # a character outside the vocabulary stands alone
                    if node is None:
                        continue
                j = i + 1
                while True:
                    below, t = node
                    if t is not None:
                        good = after.get(t)
                        if good is None:
                            good = after[t] = not before or self.pair(before, t)
                        if good:
                            last[j] = t
                    if j == n:
                        break
                    node = below.get(window[j])
                    if node is None:
                        break
                    j += 1
            i += 1
            if i >= due:
                cut = self._shared(last, i)
                if cut:
                    yield self._path(last, cut)
                    window, last, i = window[cut:], last[cut:], i - cut
                due = max(i, longest) + longest
        yield self._path(last, i)

    @staticmethod
    def _path(last: list[str | None], end: int) -> list[str]:
        out = []
        while end:
            out.append(last[end])
            end -= len(out[-1])
        return out[::-1]

    @staticmethod
    def _shared(last: list[str | None], upto: int) -> int:
        """The last boundary, `upto` or before, that the paths of all positions from `upto` on have in common; 0: none yet."""
        ends: list[int] | None = None
        for end in range(upto, len(last)):
            if last[end] is None:
                continue
            while end > upto:
                end -= len(last[end])
            if ends is None:
                ends = [end]
                while ends[-1]:
                    ends.append(ends[-1] - len(last[ends[-1]]))
                shared = 0  # place in the ends, which falls towards the start
            while shared < len(ends) and ends[shared] != end:
                if ends[shared] > end:
                    shared += 1
                else:
                    end -= len(last[end])
        return ends[shared] if ends else 0

    def search(self, text: str) -> tuple[int, ...]:
        """Ids of a stretch of any length by the streaming search."""
        step, ids = 4 * self.longest, self.ids
        out: list[int] = []
        for pieces in self.viterbi(text[k : k + step] for k in range(0, len(text), step)):
            found = [ids.get(p) for p in pieces]
            out += chain.from_iterable(map(self.ids_of, pieces)) if None in found else found
        if len(self.stable_after) > 20_000:
            self.stable_after.clear()
        return tuple(out)

    def stretches(self, text: str) -> Iterator[list[str]]:
        """The text's stretches between forced boundaries, some at a time.

        They are cut from slices of the text; the last one of a slice may go on and begins the next.
        """
        at, size = 0, _SLICE
        while at < len(text):
            found = self.chunk.findall(text, at, at + size)
            if at + size < len(text):
                last = found.pop()
                if not found:  # one stretch fills the slice
                    size *= 2
                    continue
                at += size - len(last)
            else:
                at = len(text)
            size = _SLICE
            yield found

    def encode(self, text: str | None) -> list[int]:
        """Ids of a whole text. Where the vocabulary forces a boundary, all paths meet: the stretches between
        such places are taken from the text one after the other and searched, short ones that were met before looked up."""
        if not text:
            return []
        text = (self.prefix + text).replace(" ", SPACE)
        out: list[int] = []
        known, search, short = self.known, self.search, 4 * self.longest
        for some in self.stretches(text):
            for w in some:
                ids = known.get(w)
                if ids is None:
                    ids = self.older.get(w) or search(w)
                    if len(w) <= short:
                        known[w] = ids
                out += ids
        if len(known) >= self.most_cached:
            self.older, self.known = known, {}
        return out

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids; bytes that are no UTF-8 become replacement characters."""
        text = b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


def with_pieces(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """`docs` with `ids`, `n_ids` and `round_trip` (decoding gives the text back); no shuffle.

    The mark U+2581 in a text counts as a space, as the format has it, so it comes back as one. Null
    and empty texts have no ids. The model file has to lie at `path` on the executors. Rows are
    encoded one by one, in batches; columns of the same names give way; an empty table gives no rows.
    """
    at = docs.columns.index(text)

    def batches(it: Iterator[pa.RecordBatch]):
        model = PieceModel.load(path)
        for whole in it:
            for lo in range(0, whole.num_rows, 256):
                batch = whole.slice(lo, 256)
                ids, same = [], []
                for x in batch.column(at).to_pylist():
                    found = model.encode(x)
                    same.append(model.decode(found) == (x or "").replace(SPACE, " "))
                    ids.append(np.array(found, np.int32))
                sizes = np.array([len(x) for x in ids], np.int64)
                ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
                flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
                yield batch, [pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array(sizes), pa.array(same)]

    fields = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_ids", T.LongType()), T.StructField("round_trip", T.BooleanType())]
    return append_columns(docs, fields, batches)


def decode_pieces(encoded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """`encoded` with `decoded`, the text of its ids; a null list gives a null text."""
    at = encoded.columns.index(ids)

    def batches(it: Iterator[pa.RecordBatch]):
        model = PieceModel.load(path)
        for batch in it:
            yield batch, [pa.array([None if x is None else model.decode(x) for x in batch.column(at).to_pylist()], pa.string())]

    return append_columns(encoded, [T.StructField("decoded", T.StringType())], batches)


def model_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return with_pieces(docs, model_path()).select("doc_id", "n_ids", "ids", "round_trip")
