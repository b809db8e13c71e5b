"""Byte-level BPE from a rank file, by backtracking over longest matches.

Bytes are mapped to Latin-1 characters so that an Aho-Corasick automaton finds every token
that starts at every byte of a piece in one pass. Encoding walks from the left with the
longest token and backs off to shorter ones; a token may follow another only if merging the
two tokens' bytes by rank gives exactly those two back. A sequence whose neighbours are all
compatible in this sense is the one that greedy merging gives, and a position that failed is
never tried again, so the work is linear in the piece. Compatibility is memoised by pair and
pieces by text, both in bounded tables of the Python worker.

Defined cases: a null text is empty and has no ids; a piece that is itself a token is that
token; bytes that are no token are an error of the rank file, not of the text; ties cannot
occur; rows that repeat give equal rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame

from basketry.llm.splitting import splitter
from basketry.llm.workspace import map_rows

#: Pieces and pairs that a Python worker remembers before it starts afresh.
MEMO = 300_000
#: Above every rank.
NEVER = 1 << 40


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Encoder:
    def __init__(self, ranks: dict[bytes, int]):
        import ahocorasick

        self.ranks, self.bytes_of = ranks, {r: b for b, r in ranks.items()}
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (len(token), rank))
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.grown: dict[int, tuple[list[tuple[int, bytes]], list[tuple[int, bytes]]]] = {}

    def edges(self, token: int) -> tuple[list[tuple[int, bytes]], list[tuple[int, bytes]]]:
        """How a token's first and its last part grow while its bytes are merged, lowest rank first: (rank, part) by step.

        Both are empty for a token that merging its own bytes does not give.
        """
        known = self.grown.get(token)
        if known is None:
            whole = self.bytes_of[token]
            parts = [whole[i : i + 1] for i in range(len(whole))]
            first, last = [(-1, parts[0])], [(-1, parts[-1])]
            while len(parts) > 1:
                rank, i = min((self.ranks.get(parts[i] + parts[i + 1], NEVER), i) for i in range(len(parts) - 1))
                if rank == NEVER:
                    first, last = [], []
                    break
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
                if i == 0:
                    first.append((rank, parts[0]))
                if i == len(parts) - 1:
                    last.append((rank, parts[-1]))
            known = self.grown[token] = (first, last)
        return known

    def compatible(self, a: int, b: int) -> bool:
        """Merging the bytes of both tokens gives both: at no step does the pair across the border come first.

        Merges come by rank, of equal ranks the leftmost; so the border waits for the left token's step of its own rank
        and goes before the right token's.
        """
        known = self.pairs.get(key := a << 32 | b)
        if known is None:
            if len(self.pairs) >= MEMO:
                self.pairs.clear()
            left, right, i, j = self.edges(a)[1], self.edges(b)[0], 0, 0
            known = bool(left and right)
            while known:
                across = self.ranks.get(left[i][1] + right[j][1], NEVER)
                next_left = left[i + 1][0] if i + 1 < len(left) else NEVER
                next_right = right[j + 1][0] if j + 1 < len(right) else NEVER
                if across < next_left and across <= next_right:
                    known = False
                elif next_left == next_right == NEVER:
                    break
                elif next_left <= next_right:
                    i += 1
                else:
                    j += 1
            self.pairs[key] = known
        return known

    def piece(self, piece: bytes) -> list[int]:
        """Ids of one piece."""
        whole = self.ranks.get(piece)
        if whole is not None or not piece:
            return [whole] if piece else []
        starts: list[list[tuple[int, int]]] = [[] for _ in piece]  # tokens from each byte, shortest first
        for end, (n, rank) in self.automaton.iter(piece.decode("latin-1")):
            starts[end - n + 1].append((n, rank))
        path: list[tuple[int, int, int]] = []  # start, id, choices of that start not yet tried
        dead = bytearray(len(piece) + 1)
        at, left = 0, len(starts[0])
        while at < len(piece):
            options = starts[at]
            while left:
                left -= 1
                n, rank = options[left]
                if not dead[at + n] and (not path or self.compatible(path[-1][1], rank)):
                    path.append((at, rank, left))
                    at += n
                    left = len(starts[at]) if at < len(piece) else 0
                    break
            else:
                # what follows depends on the token before, and of the tokens that end here only one can be right
                dead[at] = 1
                if not path:
                    raise ValueError("a byte of the piece is no token")
                at, _, left = path.pop()
        return [rank for _, rank, _ in path]


class TextEncoder:
    """Whole texts: pieces by the pattern; each one's ids are remembered as text, which is compact and joins fast."""

    def __init__(self, rank_file: str, pattern: str):
        self.encoder = Encoder(load_ranks(rank_file))
        self.split = splitter(pattern)
        self.memo: dict[str, str] = {}
        self.bytes_of_text = {str(r): b for r, b in self.encoder.bytes_of.items()}

    def joined(self, text: str) -> str:
        """Decimal ids, one space between."""
        memo, out = self.memo, []
        for p in self.split(text):
            ids = memo.get(p)
            if ids is None:
                if len(memo) >= MEMO:
                    memo.clear()
                ids = memo[p] = " ".join(map(str, self.encoder.piece(p.encode())))
            out.append(ids)
        return " ".join(out)

    def encode(self, text: str) -> list[int]:
        return [int(i) for i in self.joined(text).split()]

    def decode_joined(self, ids: str) -> bytes:
        return b"".join(map(self.bytes_of_text.__getitem__, ids.split()))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.encoder.bytes_of.__getitem__, ids))


@lru_cache(maxsize=1)
def text_encoder(rank_file: str, pattern: str) -> TextEncoder:
    """One for a Python worker, however many tasks it runs."""
    return TextEncoder(rank_file, pattern)


def encode_documents(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """doc_id and ids (array of int) of every document."""

    def start():
        encode = text_encoder(rank_file, pattern).encode
        return lambda b: pd.DataFrame({"ids": [encode(t or "") for t in b["text"]]})

    return map_rows(docs, "doc_id", ["text"], start, "ids array<int>")


def digests(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (decimal ids joined by one space), decoded_sha256 (the ids decoded again)."""

    def start():
        encoder = text_encoder(rank_file, pattern)

        def one(text: str | None) -> tuple[int, str, str]:
            ids = encoder.joined(text or "")
            n = ids.count(" ") + 1 if ids else 0
            return n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(encoder.decode_joined(ids)).hexdigest()

        return lambda b: pd.DataFrame([one(t) for t in b["text"]], columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return map_rows(docs, "doc_id", ["text"], start, "n_tokens long, ids_sha256 string, decoded_sha256 string")
