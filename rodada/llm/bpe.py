"""Operator 9: BPE encoding as a bounded-lookahead streaming transducer, and incremental decoding.

Encoding. A token sequence is the BPE encoding of its bytes exactly if each two adjacent tokens are stable, i.e. the
encoding of the two tokens' bytes is just these two. So each prefix of the input has one last token: the longest token
that ends there and is stable after the last token of the shorter prefix. Whatever bytes follow, the final encoding has
a token boundary among the last L positions, L being the longest token's length in bytes; the tokens that the paths
from all those positions share can't change any more. That L is the merge list's sufficient lookahead: the transducer
holds the positions after the last emitted token, and emits a token as soon as the paths from the last L positions
agree on it. Memory is constant: it doesn't grow with the text.

Decoding. Ids map to bytes; an incremental UTF-8 state machine turns bytes into text, replacing what is invalid.

What a piece of text encodes to is memoised in a bounded cache, see chunks.py.

Defined results: null text is the empty text; empty tables give no rows; repeated rows give a row each; added special
tokens inside a text are recognised like the library does; other columns are ignored.
"""

from __future__ import annotations

import codecs
import hashlib
import json
from array import array
from collections.abc import Iterator, Sequence
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rodada.llm.chunks import PieceCache, byte_letters, lines, pieces
from rodada.llm.common import kept, texts


class MergeList:
    """The merges of a byte-level BPE file, with tokens numbered by rank: 0..255 the bytes, 256+i what merge i makes."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        letters = byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        vocab = spec["model"]["vocab"]
        self.bytes: list[bytes] = [bytes([b]) for b in range(256)]
        self.rank: dict[bytes, int] = {t: k for k, t in enumerate(self.bytes)}
        self.halves: list[tuple[int, int]] = [(b, b) for b in range(256)]
        self.merged: dict[tuple[int, int], int] = {}
        for m in spec["model"]["merges"]:
            a, b = (bytes(map(byte_of.__getitem__, x)) for x in (m if isinstance(m, list) else m.split(" ")))
            if a + b in self.rank:
                raise ValueError("two merges make the same token; the transducer needs a list without that")
            pair = (self.rank[a], self.rank[b])
            self.rank[a + b] = self.merged[pair] = len(self.bytes)
            self.halves.append(pair)
            self.bytes.append(a + b)
        self.ids = [vocab["".join(letters[x] for x in t)] for t in self.bytes]
        # an automaton over the tokens: node * 256 + byte -> 256 * next node, for the trie's edges; other steps are found by step()
        self.edge: dict[int, int] = {}
        ends, parent = [-1], [(0, 0)]  # of each node: the token that it spells, or -1; (256 * parent, byte)
        for token, t in enumerate(self.bytes):
            node = 0
            for b in t:
                nxt = self.edge.get(node + b)
                if nxt is None:
                    nxt = self.edge[node + b] = len(ends) << 8
                    ends.append(-1)
                    parent.append((node, b))
                node = nxt
            ends[node >> 8] = token
        self.found: dict[int, int] = {}
        self.fail = [0] * len(ends)  # 256 * the node of the longest proper suffix
        self.longest = [-1] * len(ends)  # the longest token that is a suffix of what the node spells
        depth = [0] * len(ends)
        for k in range(1, len(ends)):
            depth[k] = depth[parent[k][0] >> 8] + 1
        for k in sorted(range(1, len(ends)), key=depth.__getitem__):
            up, b = parent[k]
            if up:
                self.fail[k] = self.step(self.fail[up >> 8], b)
            self.longest[k] = ends[k] if ends[k] >= 0 else self.longest[self.fail[k] >> 8]
        self.size = [len(t) for t in self.bytes]
        self.shorter = [-1] * len(self.bytes)  # the longest token that is a proper suffix of the token
        for k in range(1, len(ends)):
            if ends[k] >= 0:
                self.shorter[ends[k]] = self.longest[self.fail[k] >> 8]
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of_id = {i: t for i, t in zip(self.ids, self.bytes, strict=True)} | {i: s.encode() for s, i in self.added.items()}

    def step(self, node: int, byte: int) -> int:
        """The node after a byte that leaves the trie's edges; steps that were found are kept, 1,000,000 at most."""
        at = node
        while (nxt := self.edge.get(at + byte)) is None and at:
            at = self.fail[at >> 8]
        if len(self.found) >= 1_000_000:
            self.found.clear()
        self.found[node + byte] = nxt = nxt or 0
        return nxt

    @cached_property
    def lookahead(self) -> int:
        """Bytes that must follow a place before no later byte can change the boundaries before it: see above."""
        return max(self.size)


class StreamEncoder:
    """Feeds bytes of one pre-token, yields ranks of tokens as they become stable."""

    def __init__(self, merges: MergeList):
        self.m = merges
        self.stable: dict[int, bool] = {}
        self.reset()

    def reset(self) -> None:
        self.last: list[int] = []  # of each prefix after the last emitted token, its last token
        self.node = 0  # the automaton's, after all bytes so far
        self.before = -1  # the token emitted last

    def _stable(self, a: int, b: int) -> bool:
        """Whether tokens a, b stay as they are when their bytes are encoded together.

        Undo merges across the seam, the latest first: some merge that joins the two sides, ranked before the merge
        that was undone last, would have happened instead.
        """
        key = a << 32 | b
        if (known := self.stable.get(key)) is not None:
            return known
        merged, halves, bound, ok = self.m.merged.get, self.m.halves, 1 << 60, True
        while True:
            joined = merged((a, b))
            if joined is not None and joined < bound:
                ok = False
                break
            if a < 256 and b < 256:
                break
            if a > b:  # the left token was made later: before that, its right half stood at the seam
                bound, a = a, halves[a][1]
            else:  # of merges of one rank the leftmost comes first, and the seam lies left of what made b
                bound, b = b + 1, halves[b][0]
        if len(self.stable) > 1_000_000:
            self.stable.clear()
        self.stable[key] = ok
        return ok

    def push(self, data: bytes) -> None:
        last, before, node, n = self.last, self.before, self.node, len(self.last)
        m, known, check, add = self.m, self.stable.get, self._stable, self.last.append
        edge, found, longest, shorter, size = m.edge.get, m.found.get, m.longest, m.shorter, m.size
        for byte in data:
            nxt = edge(node + byte)
            if nxt is None and (nxt := found(node + byte)) is None:
                nxt = m.step(node, byte)
            node, n = nxt, n + 1
            token = longest[node >> 8]
            while True:  # the longest token first
                start = n - size[token]
                if start >= 0:
                    left = last[start - 1] if start else before
                    if left < 0 or (ok := known(left << 32 | token)) or (ok is None and check(left, token)):
                        break
                token = shorter[token]
                if token < 0:
                    raise ValueError("no token of the merge list ends here")
            add(token)
        self.node = node

    def _cut(self, end: int) -> list[int]:
        """The tokens of the prefix of that length."""
        out = []
        while end:
            out.append(self.last[end - 1])
            end -= len(self.m.bytes[out[-1]])
        return out[::-1]

    def settled(self) -> list[int]:
        """Tokens that no further byte can change; they leave the buffer."""
        n = len(self.last)
        open_ = set(range(max(0, n - self.m.lookahead + 1), n + 1))
        while len(open_) > 1:
            end = max(open_)
            open_.remove(end)
            open_.add(end - len(self.m.bytes[self.last[end - 1]]))
        (end,) = open_
        out = self._cut(end)
        if out:
            self.last, self.before = self.last[end:], out[-1]
        return out

    def finish(self) -> list[int]:
        out = self._cut(len(self.last))
        self.reset()
        return out

    def encode(self, stream: bytes, step: int = 1024) -> Iterator[int]:
        for at in range(0, len(stream), step):
            self.push(stream[at : at + step])
            if len(stream) > step:
                yield from self.settled()
        yield from self.finish()

    def word(self, stream: bytes, step: int = 1024) -> list[int]:
        """All tokens of a pre-token."""
        if len(stream) > step:
            return list(self.encode(stream, step))
        self.push(stream)
        return self.finish()


class Bpe:
    """Whole-text encoding and decoding with the transducer; pre-tokens are found by the byte-level pattern."""

    #: Fixed value: the byte-level pre-token pattern of the tokenizers library.
    PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

    def __init__(self, path: str, cache: int = 300_000):
        import regex

        self.m = MergeList(path)
        self.code = "H" if max(self.m.bytes_of_id) < 1 << 16 else "I"
        self.stream, self.find = StreamEncoder(self.m), regex.compile(self.PATTERN).finditer
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.m.added, key=len, reverse=True)))) if self.m.added else None
        self.token = PieceCache(self._pretoken, cache // 8, "", glue=False)
        self.head = PieceCache(self._piece, cache // 4, "")
        self.tail = PieceCache(self._piece, cache)
        self.line_end = self._pretoken("\n")

    def _pretoken(self, s: str) -> bytes:
        return array(self.code, map(self.m.ids.__getitem__, self.stream.word(s.encode()))).tobytes()

    def _piece(self, s: str) -> bytes:
        if s.isalpha() or (s[:1] == " " and s[1:].isalpha()):
            return self._pretoken(s)
        return b"".join([self.token[p[0]] for p in self.find(s)])

    def _plain(self, text: str) -> bytes:
        return self.line_end.join([self._line(x) for x in lines(text)])

    def _line(self, line: str) -> bytes:
        first, *rest = pieces(line)
        return self.head[first] + b"".join(map(self.tail.__getitem__, rest))

    def encode(self, text: str) -> array:
        """The ids of a whole text."""
        runs, at = [], 0
        for hit in self.special.finditer(text) if self.special else ():
            runs += [self._plain(text[at : hit.start()]), array(self.code, [self.m.added[hit[0]]]).tobytes()]
            at = hit.end()
        return array(self.code, b"".join([*runs, self._plain(text[at:] if at else text)]))

    def decode(self, ids: Sequence[int], block: int = 1 << 16) -> Iterator[str]:
        """Text of the ids, a block at a time; ids without a token are left out."""
        state, of = codecs.getincrementaldecoder("utf-8")("replace"), self.m.bytes_of_id
        for at in range(0, len(ids), block):
            yield state.decode(b"".join([of.get(i, b"") for i in ids[at : at + block]]))
        yield state.decode(b"", True)


def round_trip(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids with with_ids; ids, decoded with with_text) of each document."""
    with_ids |= with_text
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids + ", decoded string" * with_text

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = kept(Bpe, tokenizer_path)
        decimal = [b"%d" % i for i in range(1 + max(bpe.m.bytes_of_id))]
        for batch in batches:
            for rows, strings in texts(batch, "text", 64):
                out: list[tuple] = []
                for s in strings:
                    ids = bpe.encode(s or "").tolist()
                    text, whole = hashlib.sha256(), []
                    for part in bpe.decode(ids):
                        text.update(part.encode())
                        if with_text:
                            whole.append(part)
                    digest = hashlib.sha256(b",".join(map(decimal.__getitem__, ids))).hexdigest()
                    out.append((len(ids), digest, text.hexdigest()) + ((ids,) if with_ids else ()) + (("".join(whole),) if with_text else ()))
                kinds = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()]
                names = ["n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: 3 + with_ids + with_text]
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *(pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=False))], names=["doc_id", *names])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(code, schema)
