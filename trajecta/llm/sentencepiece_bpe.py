"""SentencePiece BPE: exact encoding by backtracking, and decoding.

A segment's candidates come from an Aho-Corasick automaton over the vocabulary. The encoder takes the longest match at
each place that is compatible with the token before it: two tokens are compatible if merging their joined text again
gives just these two. Where no match fits, the place is marked in a bitfield of failed positions and the token before it
is shortened. Since the valid tokens of a prefix are unique, a failed position fails whatever led to it.

No piece holds a space mark after another character, nor a line feed beside another, so a text splits exactly into runs
of marks with the word that follows, and line feeds, and likewise between a letter and a mark that no piece holds after a letter;
segments are encoded alone and their results kept in a bounded memo.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from hashlib import sha256

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from trajecta.llm.common import map_batches, table, with_outputs

MARK = "▁"
MEMO, FITS = 120_000, 200_000  # segments in each of two generations, and pairs of tokens; a task's end empties both
PUNCTUATION = "!\"#$%&()*+,-./:;<=>?@[]^_{|}~'"
NEVER = float("-inf")


def _varint(b: bytes, i: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = b[i]
        i, value, shift = i + 1, value | (byte & 127) << shift, shift + 7
        if byte < 128:
            return value, i


def _fields(b: bytes) -> Iterable[tuple[int, object]]:
    """The (number, value) pairs of a protocol buffer."""
    i = 0
    while i < len(b):
        key, i = _varint(b, i)
        if key & 7 == 0:
            value, i = _varint(b, i)
        else:
            n, i = _varint(b, i) if key & 7 == 2 else ({5: 4, 1: 8}[key & 7], i)
            value, i = b[i : i + n], i + n
        yield key >> 3, value


class PieceBPE:
    """A BPE model of the sentencepiece library: identity normalisation, byte fallback, no user-defined pieces."""

    def __init__(self, proto: bytes) -> None:
        import struct

        pieces, normal = [], {}
        for number, value in _fields(proto):
            if number == 1:
                f = dict(_fields(value))
                pieces.append((f[1].decode(), struct.unpack("<f", f.get(2, b"\0\0\0\0"))[0], f.get(3, 1)))
            elif number == 3:
                normal = dict(_fields(value))
        if normal.get(2) or normal.get(4, 1) or not normal.get(5, 1) or any(kind in (4, 5) for _, _, kind in pieces):
            raise ValueError("only identity normalisation without user-defined or unused pieces is supported")
        self.prefix = bool(normal.get(3, 1))
        self.ids = {p: i for i, (p, _, kind) in enumerate(pieces) if kind == 1}
        self.scores = {p: score for p, score, kind in pieces if kind == 1}
        self.pieces = {i: p for p, i in self.ids.items()}
        self.bytes = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == 6}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        if len(self.bytes) != 256 or any(MARK in p.lstrip(MARK) or ("\n" in p and p != "\n") for p in self.ids):
            raise ValueError("the vocabulary has no byte fallback, or pieces that cross words or lines")
        self.fits: dict[tuple[str, str], bool] = {}
        self.traces: dict[str, tuple[list[str], list[float], list[str], list[str]]] = {}
        after_letter = {b for p in self.ids for a, b in zip(p, p[1:], strict=False) if a.isalpha()}
        free = "".join(re.escape(c) for c in PUNCTUATION if c not in after_letter)  # no piece holds one of these after a letter
        word_end = f"|{MARK}*+[^\\W\\d_]++(?=[{free}])" if free else ""
        self.segment = re.compile(f"\n{word_end}|{MARK}+[^{MARK}\n]*|[^{MARK}\n]+")
        self.automaton = ahocorasick.Automaton()
        found = {p for p in self.ids if self.merge(p) == [p]}  # others can never come out of merging
        for p in found:
            self.automaton.add_word(p, (len(p), p))
        self.automaton.make_automaton()
        self.prefixes = {p: q for p in found if (q := next((p[:n] for n in range(len(p) - 1, 0, -1) if p[:n] in found), None))}
        self.memo: dict[str, str | tuple[str, str]] = {}
        self.older: dict[str, str | tuple[str, str]] = {}

    def trace(self, text: str) -> tuple[list[str], list[float], list[str], list[str]]:
        """Merge adjacent symbols, best score first, the leftmost of equals (quadratic, for short texts).

        Returns what is left, the score of each merge in order, and the first and last symbol before each merge and at the end.
        """
        parts, done, first, last = list(text), [], [text[:1]], [text[-1:]]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            done.append(best)
            first.append(parts[0])
            last.append(parts[-1])
        return parts, done, first, last

    def merge(self, text: str) -> list[str]:
        return self.trace(text)[0]

    def compatible(self, a: str, b: str) -> bool:
        """Whether merging a + b again gives [a, b].

        The merges within a and within b are replayed in the order that merging the joined text would take; they are
        incompatible as soon as a merge across the border would come before the next one on either side.
        """
        key = (a, b)
        if (known := self.fits.get(key)) is not None:
            return known
        traces = self.traces
        if len(self.fits) >= FITS:
            self.fits.clear()
            traces.clear()
        _, left, _, edge_a = traces.get(a) or traces.setdefault(a, self.trace(a))
        _, right, edge_b, _ = traces.get(b) or traces.setdefault(b, self.trace(b))
        i, j, fits = 0, 0, True
        while True:
            next_a = left[i] if i < len(left) else NEVER
            next_b = right[j] if j < len(right) else NEVER
            across = self.scores.get(edge_a[i] + edge_b[j], NEVER)
            if across > next_a and across >= next_b:
                fits = False
                break
            if next_a == next_b == NEVER:
                break
            if next_a >= next_b:
                i += 1
            else:
                j += 1
        self.fits[key] = fits
        return fits

    def _shorter(self, piece: str) -> str | None:
        """The next shorter candidate at the same place."""
        if (p := self.prefixes.get(piece)) is not None:
            return p
        return piece[0] if len(piece) > 1 else None

    def tokens(self, text: str) -> list[str]:
        """The pieces of a segment; a character without a piece stands alone."""
        n = len(text)
        longest = {end - size: piece for end, (size, piece) in self.automaton.iter(text)}  # by start - 1; of one start, later matches are longer
        failed = bytearray(n // 8 + 1)
        out: list[str] = []
        fits = self.fits
        at, last = 0, None
        piece = longest.get(-1) or text[:1]
        while at < n:
            while piece is not None:
                end = at + len(piece)
                if not failed[end >> 3] >> (end & 7) & 1 and (last is None or (fits[last, piece] if (last, piece) in fits else self.compatible(last, piece))):
                    break
                piece = self._shorter(piece)
            if piece is not None:
                out.append(piece)
                at, last = end, piece
                piece = longest.get(at - 1) or text[at : at + 1]
            elif not out:
                raise ValueError("no valid encoding")
            else:
                failed[at >> 3] |= 1 << (at & 7)
                gone = out.pop()
                at -= len(gone)
                piece, last = self._shorter(gone), out[-1] if out else None
        return out

    def segment_ids(self, text: str) -> list[int]:
        out = []
        for p in self.tokens(text):
            if (i := self.ids.get(p)) is not None:
                out.append(i)
            else:
                out += [self.bytes[b] for b in p.encode("utf-8")]
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD."""
        text = self._joined(ids)
        return text[1:] if self.prefix and text[:1] == " " else text

    def _joined(self, ids: list[int]) -> str:
        pieces = self.pieces
        try:
            return "".join([pieces[i] for i in ids]).replace(MARK, " ")
        except KeyError:
            pass
        out, run = [], bytearray()
        for i in ids:
            if (b := self.byte_of.get(i)) is not None:
                run.append(b)
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run = bytearray()
            out.append(pieces[i].replace(MARK, " "))
        out.append(run.decode("utf-8", "replace"))
        return "".join(out)

    def _segment(self, s: str) -> str | tuple[str, str]:
        """The ids of a segment, joined by commas, with what they decode to if that is not the segment itself; kept in a memo of two generations."""
        got = self.older.get(s)
        if got is None:
            ids = self.segment_ids(s)
            got, decoded = ",".join(map(str, ids)), self._joined(ids)
            if decoded != s.replace(MARK, " "):
                got = got, decoded
        if len(s) <= 64:
            if len(self.memo) >= MEMO:
                self.older = self.memo
                self.memo = {}
            self.memo[s] = got
        return got

    def forget(self) -> None:
        for known in (self.memo, self.older, self.fits, self.traces):
            known.clear()

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, the ids joined by commas, and the decoded text."""
        if not text:
            return 0, "", ""
        memo, text = self.memo, text.replace(" ", MARK)
        segments = self.segment.findall(MARK + text if self.prefix else text)
        parts = [memo.get(s) or self._segment(s) for s in segments]
        odd = [k for k, p in enumerate(parts) if type(p) is tuple]
        if odd:
            segments = [s.replace(MARK, " ") for s in segments]
            for k in odd:
                parts[k], segments[k] = parts[k]
        ids, decoded = ",".join(parts), "".join(segments).replace(MARK, " ") if not odd else "".join(segments)
        return ids.count(",") + 1, ids, decoded[1:] if self.prefix and decoded[:1] == " " else decoded

    def encode(self, text: str) -> list[int]:
        ids = self.digest(text)[1]
        return [int(i) for i in ids.split(",")] if ids else []


_models: dict[bytes, PieceBPE] = {}


def model_of(proto: bytes) -> PieceBPE:
    """One model for each Python worker and file."""
    key = sha256(proto).digest()
    if key not in _models:
        _models[key] = PieceBPE(proto)
    return _models[key]


def read_model(spark: SparkSession, path: str) -> bytes:
    """The model file, read once on the driver and sent along with the tasks (it is half a megabyte)."""
    try:
        with open(path, "rb") as f:
            return f.read()
    except OSError:
        return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])


def encode_pieces(df: DataFrame, proto: bytes, text: str = "text", digests: bool = True) -> DataFrame:
    """df without its text, with n_tokens and either ids_sha256 and decoded_sha256 or (digests false) ids and decoded.

    Whole texts are encoded; null counts as empty: no ids, and both digests those of the empty string. Repeated rows are
    encoded like any other; input columns with the names of outputs are replaced.
    """
    names = ["n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["n_tokens", "ids", "decoded"]
    kept = with_outputs(df, names)
    fields = [f for f in kept.schema.fields if f.name != text]
    kept = kept.select(*[f"`{f.name}`" for f in fields], f"`{text}`")
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["n_tokens long"] + (["ids_sha256 string", "decoded_sha256 string"] if digests else ["ids array<int>", "decoded string"]))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        model = model_of(proto)
        rows = []
        for t in b.column(b.num_columns - 1):
            n, ids, decoded = model.digest(t.as_py() or "")
            rows.append((n, sha256(ids.encode()).hexdigest(), sha256(decoded.encode()).hexdigest()) if digests else (n, [int(i) for i in ids.split(",")] if ids else [], decoded))
        new = [pa.array([r[0] for r in rows], pa.int64())]
        new += [pa.array([r[k] for r in rows], pa.string() if digests or k == 2 else pa.list_(pa.int32())) for k in (1, 2)]
        return pa.RecordBatch.from_arrays([*b.columns[:-1], *new], [f.name for f in fields] + names)

    def forget() -> None:
        model_of(proto).forget()

    return map_batches(kept, run, schema, forget)


def default_model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_pieces(docs, read_model(spark, default_model_path()))
