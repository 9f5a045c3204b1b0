"""SentencePiece (BPE) encoding by a table of last tokens per prefix.

Every prefix of a text has exactly one last token in its merged form. An
Aho-Corasick automaton over the vocabulary lists the tokens that end at a
position; the one that is compatible with the last token of the prefix before
it is the entry of the table. Ids are then read backwards from the end. Two
adjacent tokens are compatible when undoing their merges, latest first, never
meets a pair across the border that would have been merged earlier.

Texts are cut first where no piece can reach across: before a space mark that
follows another character, and around characters outside the vocabulary,
which become byte pieces. Runs of space marks, whose pieces share one score,
are merged by the agenda rule instead (best score, then leftmost).
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from . import shared

SPACE = "▁"
CACHE_ENTRIES = 150_000  # of each cache; keys and ids take a few hundred bytes
CACHE_CHARS = 32
STRETCH = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
TAIL = re.compile(r".*\w([^\w▁]+)", re.DOTALL)


class PieceTable:
    """Encoder and decoder of one SentencePiece BPE model with byte fallback."""

    def __init__(self, model_path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.end = model.eos_id()
        size = model.get_piece_size()
        self.byte_id = {}
        self.text_of = {}
        score = {}
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_id[int(piece[1:-1], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.text_of[i] = piece
                score[i] = model.get_score(i)
        self.id_of = {p: i for i, p in self.text_of.items()}
        self.score = score
        # Space runs have one shared score, so their order depends on position.
        self.plain = {p: i for p, i in self.id_of.items() if not p.startswith(SPACE * 2)}
        if any(SPACE in p[1:] for p in self.plain):
            raise ValueError("a piece holds a space mark inside; texts cannot be cut at spaces")
        ordered = sorted((i for p, i in self.plain.items() if len(p) > 1), key=lambda i: -score[i])
        self.rank = {i: -1 for p, i in self.plain.items() if len(p) == 1}
        self.rank.update((i, r) for r, i in enumerate(ordered))
        self.chars = frozenset(p for p in self.plain if len(p) == 1)
        self.pair_rank = {}
        for i in ordered:
            p = self.text_of[i]
            for k in range(1, len(p)):
                a, b = self.plain.get(p[:k]), self.plain.get(p[k:])
                if a is not None and b is not None:
                    self.pair_rank[a << 20 | b] = self.rank[i]
        self.left, self.right = {}, {}
        self.automaton = ahocorasick.Automaton()
        for p, i in self.plain.items():
            merged = self._agenda(p)
            if merged == [i]:
                self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        self._compatible: dict[int, bool] = {}
        self._words: dict[str, str] = {}
        self._bare: dict[str, str] = {}
        self.inside = {p[k : k + 2] for p in self.id_of for k in range(len(p) - 1)}
        # Bytes beyond ASCII stand as the escapes that surrogateescape undoes.
        self.shown = {str(i): "" for i in range(size)}
        self.shown.update((str(i), p.replace(SPACE, " ")) for i, p in self.text_of.items())
        self.shown.update((str(i), b.decode("ascii", "surrogateescape")) for b, i in ((bytes([b]), i) for b, i in self.byte_id.items()))

    def forget(self) -> None:
        """Let go of the stretches met so far."""
        self._compatible.clear(), self._words.clear(), self._bare.clear()

    def _agenda(self, text: str) -> list[int]:
        """Merge by score, then leftmost; the parts of each merge are noted."""
        ids: list[int | None] = [self.id_of[c] for c in text]
        after = list(range(1, len(ids) + 1))
        before = list(range(-1, len(ids) - 1))
        heap: list[tuple[float, int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i] if i >= 0 else len(ids)
            if i < 0 or j >= len(ids):
                return
            new = self.id_of.get(self.text_of[ids[i]] + self.text_of[ids[j]])
            if new is not None:
                heapq.heappush(heap, (-self.score[new], i, ids[i], ids[j], new))

        for i in range(len(ids) - 1):
            offer(i)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= len(ids) or ids[j] != b:
                continue
            if len(self.text_of[new]) == len(text):
                self.left[new], self.right[new] = a, b
            ids[i], ids[j] = new, None
            after[i] = after[j]
            if after[j] < len(ids):
                before[after[j]] = i
            offer(before[i])
            offer(i)
        return [x for x in ids if x is not None]

    def compatible(self, first: int, second: int) -> bool:
        """Whether the two tokens stay apart when their joint text is merged."""
        key = first << 20 | second
        if (known := self._compatible.get(key)) is not None:
            return known
        rank, pair_rank, limit, a, b = self.rank, self.pair_rank, 1 << 40, first, second
        while True:
            across = pair_rank.get(a << 20 | b)
            if across is not None and across < limit:
                good = False
                break
            if rank[a] > rank[b]:
                limit = rank[a]
                a = self.right[a]
            elif rank[b] >= 0:
                limit = rank[b] + 1
                b = self.left[b]
            else:
                good = True
                break
        if len(self._compatible) >= CACHE_ENTRIES:
            self._compatible.clear()
        self._compatible[key] = good
        return good

    def _by_table(self, text: str) -> list[int]:
        """Ids of a text of known characters without runs of space marks."""
        last: list[int] = [-1] * (len(text) + 1)
        known, compatible = self._compatible, self.compatible
        for at, (token, length) in self.automaton.iter(text):
            if last[at + 1] >= 0:
                continue
            start = at + 1 - length
            if start == 0:
                last[at + 1] = token
            elif (before := last[start]) >= 0:
                good = known.get(before << 20 | token)
                if good or good is None and compatible(before, token):
                    last[at + 1] = token
        ids, at = [], len(text)
        while at:
            ids.append(last[at])
            at -= len(self.text_of[last[at]])
        return ids[::-1]

    def _segment(self, text: str) -> list[int]:
        """Ids of a stretch that no piece reaches out of."""
        if self.chars.issuperset(text):
            return self._agenda(text) if text.startswith(SPACE * 2) else self._by_table(text)
        ids, known = [], ""
        for c in text:
            if c in self.chars:
                known += c
                continue
            if known:
                ids += self._segment(known)
                known = ""
            ids += [self.byte_id[x] for x in c.encode()]
        return ids + (self._segment(known) if known else [])

    def _remember(self, into: dict[str, str], key: str, text: str) -> str:
        """Ids of a stretch as text, kept for the next time it is met."""
        if (cut := TAIL.fullmatch(key)) and key[cut.start(1) - 1 : cut.start(1) + 1] not in self.inside:
            head, tail = key[: cut.start(1)], cut[1]
            first = into.get(head) or self._remember(into, head, text[: len(text) - len(tail)])
            return first + " " + (self._bare.get(tail) or self._remember(self._bare, tail, tail))
        ids = " ".join(map(str, self._segment(text)))
        if len(key) <= CACHE_CHARS:
            if len(into) >= CACHE_ENTRIES:
                into.clear()
            into[key] = ids
        return ids

    def ids_text(self, text: str | None) -> str:
        """All ids of a text in decimal, joined by one space, the end id last."""
        out, words, bare, remember = [], self._words, self._bare, self._remember
        for k, line in enumerate(text.split("\n")) if text else ():
            if k:
                out.append(bare.get("\n") or remember(bare, "\n", "\n"))
            if "  " in line or line[-1:] == " " or line[:1] == " " or SPACE in line:
                line = (SPACE if k == 0 else "") + line.replace(" ", SPACE)
                out += [bare.get(x) or remember(bare, x, x) for x in STRETCH.findall(line)]
                continue
            parts = line.split(" ") if line else []
            if k and parts:
                first = parts.pop(0)
                out.append(bare.get(first) or remember(bare, first, first))
            elif not k and not parts:
                out.append(bare.get(SPACE) or remember(bare, SPACE, SPACE))
            out += [words.get(x) or remember(words, x, SPACE + x) for x in parts]
        out.append(str(self.end))
        return " ".join(out)

    def encode(self, text: str | None) -> list[int]:
        """All ids of a text, the end id last. None counts as an empty text."""
        return [int(i) for i in self.ids_text(text).split(" ")]

    def decode_bytes(self, ids: str) -> bytes:
        """UTF-8 of the text that ids (decimal, joined by a space) stand for."""
        text = "".join(map(self.shown.__getitem__, ids.split(" ")))
        text = text[1:] if text.startswith(" ") else text
        try:
            return text.encode()
        except UnicodeEncodeError:  # byte pieces beyond ASCII stand as escapes
            return text.encode("utf-8", "surrogateescape").decode("utf-8", "replace").encode()

    def decode(self, ids: list[int]) -> str:
        """Text of ids; the mark added before the first word is taken off."""
        return self.decode_bytes(" ".join(map(str, ids))).decode() if ids else ""


@cache
def piece_table(model_path: str) -> PieceTable:
    """The table of a model, built once per Python process."""
    return PieceTable(model_path)


def encode(docs: DataFrame, model_path: str, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """Every column of ``docs`` and the ids of each whole text (array<int>).

    Null and empty texts get the end id only. Rows are kept as they are,
    repeated ones too; a column named like ``ids`` is replaced.
    """

    def work(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = piece_table(model_path)
        for texts in batches:
            found = [np.array(table.ids_text(t.as_py()).split(" "), np.int32) for t in texts]
            ends = np.cumsum([0, *map(len, found)])
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(found) if found else np.zeros(0, np.int32)))

    run = shared.tidied(work, lambda: piece_table(model_path).forget())

    @F.arrow_udf(ArrayType(IntegerType()))
    def encoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return run(batches)

    return docs.withColumn(ids, encoded(F.col(text)))


def digests(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each document.

    Null and empty texts have the end id only and decode to an empty text; long
    texts are encoded whole. Repeated rows are kept, other columns left out; an
    empty table gives no rows. Encoding knows no ties: of merges with one score
    the leftmost comes first.
    """

    def make():
        work = piece_table(model_path)

        def batch(doc_ids, texts):
            counts, id_hash, text_hash = [], [], []
            for text in texts:
                ids = work.ids_text(text)
                counts.append(ids.count(" ") + 1)
                id_hash.append(hashlib.sha256(ids.encode()).hexdigest())
                text_hash.append(hashlib.sha256(work.decode_bytes(ids)).hexdigest())
            return doc_ids, counts, id_hash, text_hash

        return batch

    return shared.map_rows(docs, ["doc_id", "text"], "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", make)
