"""Token counts by a linear longest-match automaton."""

from __future__ import annotations

import base64
import hashlib
import re
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


#: A piece of text that no token crosses: a word with the one space before it, or a single other space.
PIECE = re.compile(rb" ?[^\x20\x09-\x0D]+|[\x20\x09-\x0D]")
#: Distinct pieces whose counts a worker remembers, and the longest piece it remembers.
MEMO_PIECES, MEMO_BYTES = 800_000, 64

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def read_vocabulary(path: str) -> list[bytes]:
    """The tokens of a rank file: a line has a token in base64 and its rank."""
    with open(path, "rb") as f:
        return [base64.b64decode(line.split()[0]) for line in f if line.strip()]


class LongestMatch:
    """Counts the tokens of greedy longest matching in one pass over the bytes.

    A trie of the vocabulary, where each node also has
    * `fail`: the node of what remains of its string after the longest tokens that can be split off its
      front, or -1 if the rest can't be walked, and
    * `popped`: how many tokens those are.
    When a byte can't be followed, the popped count is added and matching goes on at `fail`; no token's
    string is ever built. Bytes that are no token count as one unknown token each.
    """

    def __init__(self, tokens: Iterable[bytes]):
        self.child: list[dict[int, int]] = [{}]
        ends = [False]
        parent = [(0, 0)]
        known = {t for t in tokens if t} | {bytes([b]) for b in range(256)}
        for token in known:
            at = 0
            for b in token:
                if (to := self.child[at].get(b)) is None:
                    to = self.child[at][b] = len(ends)
                    self.child.append({})
                    ends.append(False)
                    parent.append((at, b))
                at = to
            ends[at] = True
        self.fail, self.popped = [-1] * len(ends), [0] * len(ends)
        queue = deque(self.child[0].values())
        while queue:
            v = queue.popleft()
            queue.extend(self.child[v].values())
            if ends[v]:
                self.fail[v], self.popped[v] = 0, 1
                continue
            up, b = parent[v]
            n, z = self.popped[up], self.fail[up]
            while z >= 0 and b not in self.child[z]:
                n += self.popped[z]
                z = self.fail[z]
            if z >= 0:
                self.fail[v], self.popped[v] = self.child[z][b], n

    def count(self, piece: bytes) -> int:
        child, fail, popped = self.child, self.fail, self.popped
        at = n = 0
        for b in piece:
            while (to := child[at].get(b)) is None:
                n += popped[at]
                at = fail[at]
            at = to
        while at:
            n += popped[at]
            at = fail[at]
        return n


class _Memo(dict):
    def __init__(self, automaton: LongestMatch):
        super().__init__()
        self.count = automaton.count

    def __missing__(self, piece: bytes) -> int:
        n = self.count(piece)
        if len(self) < MEMO_PIECES and len(piece) <= MEMO_BYTES:
            self[piece] = n
        return n


_MEMOS: dict[str, _Memo] = {}


def token_counts(docs: DataFrame, tokens: list[bytes]) -> DataFrame:
    """doc_id, n_bytes, n_pieces, n_tokens for each row of docs, over its whole text.

    The text's UTF-8 is cut into pieces: words, each with the one space before it, and single other
    spaces. Each piece is split greedily into the longest tokens of the vocabulary; all single bytes are
    tokens, so every text can be split. `tokens` goes to the executors once; its size is the vocabulary's.

    * Null text counts as empty: zeros. Null doc_id and repeated rows: a row each, as given.
    * An empty table gives an empty result. Other columns of docs are left out.
    """
    sent = docs.sparkSession.sparkContext.broadcast(tokens)
    name = hashlib.sha256(b"\0".join(tokens)).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _MEMOS.get(name)
        if memo is None:
            memo = _MEMOS[name] = _Memo(LongestMatch(sent.value))
        get = memo.__getitem__
        for batch in batches:
            n_bytes, n_pieces, n_tokens = [], [], []
            for text in batch.column(1):
                raw = (text.as_py() or "").encode()
                pieces = PIECE.findall(raw)
                n_bytes.append(len(raw))
                n_pieces.append(len(pieces))
                n_tokens.append(sum(map(get, pieces)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (n_bytes, n_pieces, n_tokens))], ["doc_id", "n_bytes", "n_pieces", "n_tokens"])

    return docs.select(docs.doc_id.cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_bytes long, n_pieces long, n_tokens long")
