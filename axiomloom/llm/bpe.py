"""Byte-level BPE by longest matches and backtracking.

Bytes stand as the Latin-1 characters of the same value, so that an Aho-Corasick automaton
over the vocabulary finds tokens in them. A sequence of tokens is the one that the merges
make exactly if every two neighbours are compatible, that is, if the merges of the two
tokens' bytes give these two tokens again. So a piece is covered from the left with the
longest token that ends at a place not yet known to be a dead end and is compatible with
the token before it; where none is left, the last token is taken back and its end marked
as dead. Each place is given up at most once, and compatibility of two tokens is looked
up after its first use, which makes the whole linear in the piece's length.
"""

from __future__ import annotations

import base64
from array import array
from itertools import accumulate

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pieces and token pairs held in each worker's memos before they start afresh, and the longest piece held.
MEMO_PIECES, MEMO_PAIRS, MEMO_BYTES = 400_000, 500_000, 64
_OUT_TOKENS = 1 << 19


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a vocabulary file: lines of a base64 token and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (x.split() for x in lines if x.strip())}


class BytePairs:
    """Encoder and decoder over one vocabulary; holds its memo, so one object serves many texts."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.tokens = ranks, {r: t for t, r in ranks.items()}
        self.find = regex.compile(pattern).findall
        self._trie = None
        self.sizes = {r: len(t) for r, t in self.tokens.items()}
        self.shorter: dict[int, int] = {}
        #: By the two tokens in one number; -1 stands for the start of a piece.
        self.compatible: dict[int, bool] = {}
        self.edges: dict[tuple[int, int], tuple[int, ...]] = {}
        #: Pieces and their tokens as int32 bytes.
        self.memo: dict[str, bytes] = {}

    @property
    def trie(self) -> ahocorasick.Automaton:
        """The automaton over the vocabulary; made on first use, as decoding needs none."""
        if self._trie is None:
            self._trie = ahocorasick.Automaton()
            for token, rank in self.ranks.items():
                self._trie.add_word(token.decode("latin-1"), rank)
            self._trie.make_automaton()
        return self._trie

    def merged(self, data: bytes, stop: int = 1) -> list[int]:
        """The merges carried out one by one, lowest rank first, until ``stop`` parts are left: for short strings only."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > stop:
            rank, i = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def edge(self, token: int, side: int) -> tuple[int, ...]:
        """``token`` and what stood at its end (``side`` -1) or start (0) before each merge that made it, down to a byte."""
        known = self.edges.get((token, side))
        if known is None:
            known, data = (token,), self.tokens[token]
            if len(data) > 1:
                known += self.edge(self.merged(data, 2)[side], side)
            self.edges[token, side] = known
        return known

    def fits(self, before: int, token: int) -> bool:
        """Whether ``token`` can follow ``before`` (-1: start a piece): whether no merge would have joined them.

        The merges of both are taken back from the latest. What stands at the border in
        between must not make a token that would have been merged sooner; of equal ranks
        the leftmost merge comes first, so there the border goes before a merge to its right.
        """
        key = before << 24 | token
        known = self.compatible.get(key)
        if known is None:
            if before < 0:
                known = self.merged(self.tokens[token]) == [token]
            else:
                known = self.fits(-1, token) and self._apart(before, token)
            if len(self.compatible) >= MEMO_PAIRS:
                self.compatible.clear()
            self.compatible[key] = known
        return known

    def _apart(self, before: int, token: int) -> bool:
        left, right, i, j, until = self.edge(before, -1), self.edge(token, 0), 0, 0, 1 << 60
        while True:
            a, b = left[i], right[j]
            if self.ranks.get(self.tokens[a] + self.tokens[b], 1 << 60) < until:
                return False
            if i + 1 < len(left) and (j + 1 == len(right) or a > b):
                i, until = i + 1, a
            elif j + 1 < len(right):
                j, until = j + 1, b + 1
            else:
                return True

    def prefix(self, token: int) -> int:
        """The longest other token that ``token``'s bytes begin with; -1 if there is none."""
        known = self.shorter.get(token)
        if known is None:
            data = self.tokens[token]
            known = self.shorter[token] = next((self.ranks[data[:k]] for k in range(len(data) - 1, 0, -1) if data[:k] in self.ranks), -1)
        return known

    def piece(self, data: bytes) -> list[int]:
        """The tokens of one piece."""
        rank = self.ranks.get(data)
        if rank is not None:
            return [rank]
        n, sizes, compatible = len(data), self.sizes, self.compatible
        longest = [-1] * n
        for end, token in self.trie.iter(data.decode("latin-1")):
            longest[end - sizes[token] + 1] = token  # of a start, the longest comes last
        dead, tokens, at, before, token = bytearray(n + 1), [], 0, -1, longest[0]
        while True:
            while token >= 0:
                if not dead[at + sizes[token]]:
                    known = compatible.get(before << 24 | token)
                    if self.fits(before, token) if known is None else known:
                        break
                token = self.prefix(token)
            if token >= 0:
                tokens.append(token)
                at += sizes[token]
                if at == n:
                    return tokens
                before, token = token, longest[at]
            elif tokens:
                dead[at] = 1
                token = tokens.pop()
                at -= sizes[token]
                before = tokens[-1] if tokens else -1
            else:
                raise ValueError("the vocabulary can't make this piece; single bytes are missing")

    def _new(self, piece: str) -> bytes:
        data = piece.encode("utf-8", "surrogatepass")
        got = array("i", self.piece(data)).tobytes()
        if len(data) <= MEMO_BYTES:
            if len(self.memo) >= MEMO_PIECES:
                self.memo.clear()
            self.memo[piece] = got
        return got

    def encode_raw(self, text: str) -> bytes:
        """The tokens of ``text`` as int32 bytes: each match of the pattern by itself; no special tokens."""
        known, new = self.memo.get, self._new
        return b"".join([known(p) or new(p) for p in self.find(text)])

    def encode(self, text: str) -> list[int]:
        """The tokens of ``text``."""
        return array("i", self.encode_raw(text)).tolist()

    def decode(self, ids) -> bytes:
        """The bytes of ``ids``; an unknown id is a KeyError."""
        return b"".join(map(self.tokens.__getitem__, ids))


class Vocabulary:
    """A broadcast vocabulary and the name under which a worker keeps its coder."""

    def __init__(self, held, name: str):
        self.held, self.name = held, name


def vocabulary(spark, path: str, pattern: str) -> Vocabulary:
    """The vocabulary of ``path`` for the operators below. Its size is fixed by the file (here under 1 MB), so it is broadcast."""
    ranks = read_ranks(path)
    return Vocabulary(spark.sparkContext.broadcast((ranks, pattern)), f"{path} {len(ranks)} {pattern}")


def encode_texts(docs: DataFrame, vocab: Vocabulary, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), decoded: str = "", exact: str = "") -> DataFrame:
    """``(doc_id, *keep, ids)`` for each row: the tokens of the whole text. Null texts are empty, which have no tokens.

    ``decoded`` and ``exact`` name further columns: what the tokens decode to (binary), and
    whether that is the text. They are made in the same pass, as a second one would
    double the number of Python workers.
    """

    def run(batches):
        coder = _worker_coder(vocab)
        for batch in batches:
            names = [n for n in batch.schema.names if n != "__text"]
            texts, raw, back, same, start, held = batch.column(1), [], [], [], 0, 0
            for k in range(batch.num_rows):
                text = texts[k].as_py() or ""
                raw.append(coder.encode_raw(text))
                held += len(raw[-1]) // 4
                if decoded or exact:
                    data = coder.decode(array("i", raw[-1]))
                    if decoded:
                        back.append(data)
                    if exact:
                        same.append(data == text.encode("utf-8", "surrogatepass"))
                if held >= _OUT_TOKENS or k == batch.num_rows - 1:
                    own = batch.slice(start, k + 1 - start)
                    ends = pa.array([0, *accumulate(len(r) // 4 for r in raw)], pa.int32())
                    ids = pa.ListArray.from_arrays(ends, pa.Array.from_buffers(pa.int32(), held, [None, pa.py_buffer(b"".join(raw))]))
                    more = [(decoded, pa.array(back, pa.binary()))] * bool(decoded) + [(exact, pa.array(same, pa.bool_()))] * bool(exact)
                    yield pa.RecordBatch.from_arrays([*(own.column(n) for n in names), ids, *(c for _, c in more)], names=[*names, "ids", *(n for n, _ in more)])
                    raw, back, same, start, held = [], [], [], k + 1, 0

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("__text"), *keep)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "__text")
    return rows.mapInArrow(run, f"{kinds}, ids array<int>" + f", `{decoded}` binary" * bool(decoded) + f", `{exact}` boolean" * bool(exact))


def decode_tokens(encoded: DataFrame, vocab: Vocabulary, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``encoded`` with the column ``out`` (binary): the bytes that the tokens of ``ids_col`` stand for; null for null."""

    def run(batches):
        coder = _worker_coder(vocab)
        for batch in batches:
            at = batch.schema.names.index(ids_col)
            for start in range(0, batch.num_rows, 256):
                own = batch.slice(start, 256)
                lists = own.column(at)
                ends, there = lists.offsets.to_pylist(), lists.is_valid().to_pylist()
                first = ends[0]
                ids = lists.values.slice(first, ends[-1] - first).to_numpy().tolist()  # values holds those outside of the slice too
                data = [coder.decode(ids[a - first : b - first]) if ok else None for a, b, ok in zip(ends, ends[1:], there, strict=False)]
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(data, pa.binary())], names=[*own.schema.names, out])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(run, f"{kinds}, `{out}` binary")


_CODERS: dict[str, BytePairs] = {}


def _worker_coder(vocab: Vocabulary) -> BytePairs:
    """This worker's coder for a broadcast vocabulary; made once, so that its memo serves later tasks too."""
    if vocab.name not in _CODERS:
        _CODERS.clear()
        _CODERS[vocab.name] = BytePairs(*vocab.held.value)
    return _CODERS[vocab.name]
