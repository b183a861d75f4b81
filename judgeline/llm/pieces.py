"""SentencePiece BPE encoding and decoding by backtracking.

A text is cut where no piece of the model can reach across: before a space that follows another character, around line
ends, and between any two characters that stand side by side in no piece. Each part is encoded by itself. Aho-Corasick gives the pieces that start at each position. The longest that
is compatible with its left neighbour is taken; two pieces are compatible when merging their joined characters anew
gives just these two. A position from which no piece leads on is marked in a bitfield and the search steps back. The
encoding whose neighbours are all compatible is the one that merging the whole part would give.

The model's file is read from ``model_path`` on every executor; it is a parameter and holds all vocabulary.

Defined cases: a null text equals the empty one and has no ids. Characters without a piece become byte pieces. U+2581
stands for a space, so it decodes to one. Repeated rows are encoded alike, null ids pass through.
"""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from judgeline.llm.common import map_texts, texts

SPACE = "▁"
#: Parts kept with their ids per worker, and pairs kept with their verdict; both are emptied when full.
PARTS, PAIRS = 250_000, 300_000
#: Texts encoded at a time; ids and decoded text are several times as long.
TEXT_BYTES = 1 << 20
#: Longer parts are not kept.
LONGEST_KEPT = 48


class PieceCodec:
    """Encoder and decoder of one BPE model with byte fallback, dummy prefix and no other normalisation."""

    def __init__(self, model_path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        if model.encode(" a  b\n") and model.decode(model.encode(" Ａ  ½\n")) != " Ａ  ½\n":
            raise ValueError("only models without normalisation are supported")
        self.ids, self.scores, self.surface, self.bytes, self.byte_ids = {}, {}, {}, {}, {}
        self.finder = ahocorasick.Automaton()
        for i in range(model.vocab_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes[i] = int(piece[3:5], 16)
                self.byte_ids[self.bytes[i]] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.ids[piece], self.scores[piece], self.surface[i] = i, model.get_score(i), piece.replace(SPACE, " ")
                self.finder.add_word(piece, len(piece))
        self.finder.make_automaton()
        crossing = [p for p in self.ids if SPACE in p.lstrip(SPACE) or ("\n" in p and p != "\n")]
        self.parts = re.compile("(?s).+" if crossing else f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+")
        self.beside: dict[str, set[str]] = {}
        for piece in self.ids:
            for a, b in zip(piece, piece[1:]):
                self.beside.setdefault(a, set()).add(b)
        self.odd: dict[str, str] = {}
        self.most = max(map(len, self.ids))
        self.prefix: dict[str, str] = {}
        self.fits: dict[tuple[str, str], bool] = {}
        self.kept = _Kept(self)

    def merged(self, chars: str) -> list[str]:
        """Merges by score, leftmost first among equals, until nothing more can be merged."""
        parts, score = list(chars), self.scores.get
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, left: str, right: str) -> bool:
        key = (left, right)
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) >= PAIRS:
                self.fits.clear()
            known = self.fits[key] = self.merged(left + right) == ([left, right] if left else [right])
        return known

    def longest(self, rest: str) -> str:
        """The longest piece that ``rest`` starts with; its first character if there is none."""
        piece = rest[:self.finder.longest_prefix(rest)]
        while piece not in self.ids and len(piece) > 1:
            piece = piece[:-1]
        return piece or rest[0]

    def shorter(self, piece: str) -> str:
        """The longest proper prefix that is a piece (one character always is); empty if there is none."""
        known = self.prefix.get(piece)
        if known is None:
            known = piece[:-1]
            while len(known) > 1 and known not in self.ids:
                known = known[:-1]
            if piece in self.ids:
                self.prefix[piece] = known
        return known

    def split(self, part: str) -> list[str]:
        """The pieces of a part: longest first, back from dead ends."""
        n, failed = len(part), bytearray(len(part) + 1)
        path: list[str] = []
        at, left, piece = 0, "", self.longest(part)
        while at < n:
            while piece and (failed[at + len(piece)] or not self.compatible(left, piece)):
                piece = self.shorter(piece)
            if piece:
                path.append(piece)
                at += len(piece)
                left = piece
                if at < n:
                    piece = self.longest(part[at:at + self.most])
            else:
                failed[at] = 1
                last = path.pop()
                at -= len(last)
                left = path[-1] if path else ""
                piece = self.shorter(last)
        return path

    def part_ids(self, part: str) -> list[int]:
        out: list[int] = []
        for piece in self.split(part):
            i = self.ids.get(piece)
            if i is None:
                out += [self.byte_ids[b] for b in piece.encode()]
            else:
                out.append(i)
        return out

    def encode(self, text: str) -> list[int]:
        return [int(i) for part in self._parts(text) for i in self.kept[part].split(",")]

    def _parts(self, text: str) -> list[str]:
        return self.parts.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def encode_joined(self, text: str) -> tuple[int, str, str]:
        """(number of ids, ids joined by commas, decoded text).

        Every part's ids are decoded when it is first encoded; parts that do not come back as they were are kept apart.
        """
        parts = self._parts(text)
        if not parts:
            return 0, "", ""
        ids = ",".join(map(self.kept.__getitem__, parts))
        if self.odd:
            parts = [self.odd.get(part, part) for part in parts]
        return ids.count(",") + 1, ids, "".join(parts).replace(SPACE, " ")[1:]

    def decode(self, ids: list[int]) -> str:
        text = self._plain(ids)
        return text[1:] if text.startswith(" ") else text

    def _plain(self, ids: list[int]) -> str:
        try:
            return "".join([self.surface[i] for i in ids])
        except KeyError:  # byte pieces, or ids without a surface
            pass
        out, run = [], bytearray()
        for i in ids:
            if i in self.bytes:
                run.append(self.bytes[i])
                continue
            if run:
                out.append(run.decode(errors="replace"))
                run = bytearray()
            out.append(self.surface.get(i, ""))
        return "".join(out) + run.decode(errors="replace")


class _Kept(dict):
    """Part -> ids joined by commas, of bounded size.

    When full, the parts are put aside as the older half; those that are met again come back, the rest is forgotten.
    """

    def __init__(self, codec: PieceCodec):
        super().__init__()
        self.codec, self.older = codec, {}

    def __missing__(self, part: str) -> str:
        value = self.older.get(part)
        if value is None:
            beside, none = self.codec.beside, ()
            cuts = [] if part.lstrip(SPACE).isalpha() else [  # a word is rarely cut, and need not be
                i for i in range(1, len(part)) if part[i] not in beside.get(part[i - 1], none)]
            if cuts:
                subs = [part[i:j] for i, j in zip([0, *cuts], [*cuts, len(part)])]
                value = ",".join([self[sub] for sub in subs])
                if self.codec.odd.keys() & set(subs):
                    self.codec.odd[part] = "".join([self.codec.odd.get(sub, sub) for sub in subs])
            else:
                ids = self.codec.part_ids(part)
                value = ",".join(map(str, ids))
                back = self.codec._plain(ids)
                if back != part.replace(SPACE, " "):
                    self.codec.odd[part] = back
        if len(part) <= LONGEST_KEPT:
            if len(self) >= PARTS:
                self.older = dict(self)
                self.clear()
            self[part] = value
        return value


@lru_cache(maxsize=2)
def codec(model_path: str) -> PieceCodec:
    """One codec per worker process and model."""
    return PieceCodec(model_path)


def encode_decode(
    docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``doc_id, n_tokens, ids, decoded`` for every row; ``ids`` are decimal, joined by commas (see ``id_array``)."""
    def make():
        tool = codec(model_path)

        def work(batch: pa.RecordBatch) -> dict:
            found = [tool.encode_joined(t.decode("utf-8", "replace")) for t in batch.column("text").to_pylist()]
            return {
                "doc_id": batch.column("doc_id"), "n_tokens": [f[0] for f in found], "ids": [f[1] for f in found],
                "decoded": [f[2] for f in found]}

        return work

    return map_texts(
        texts(docs, id_col, text_col), make, "doc_id long, n_tokens long, ids string, decoded string",
        TEXT_BYTES)


def id_array(ids: Column) -> Column:
    return F.when(ids == "", F.array().cast("array<int>")).otherwise(F.split(ids, ",").cast("array<int>"))
