"""Byte-pair encoding by backtracking over longest token matches, and decoding by an offset table.

encode: an Aho-Corasick automaton, run once over all pieces of a call, names the longest token that starts at each
position. A token may follow another only if the pair-compatibility table allows it: the
two tokens' own merges must not be overtaken by a merge over their border. Where none may follow, the longest
match is shortened to its next prefix token or the last token is taken back; a bit for each position keeps any
position from being tried twice, so the work is linear. The sequence found is the one that merging in rank order gives.

Null text counts as empty and gives no ids. Repeated rows are encoded each for itself; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import arrow_map, documents
from .tokens import ChunkEncoder, encoder, vocabulary

FILE = "byte_bpe_50k.json"
#: The split pattern of this vocabulary and the white space it means.
_SPACE = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
#: Pairs whose compatibility a worker remembers; beyond, the table is filled anew.
PAIRS = 300_000


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabulary files, by the public rule."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(rest)}


class BacktrackingBPE:
    """Encoder and decoder of one byte-level vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        letter = byte_letters()
        raw = lambda s: bytes(letter[c] for c in s)
        vocab = file["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes: list[bytes] = [b""] * size
        for s, i in vocab.items():
            self.bytes[i] = raw(s) if s not in self.special else s.encode()
        for s, i in self.special.items():
            self.bytes[i] = s.encode()
        self.ids = {raw(s): i for s, i in vocab.items() if s not in self.special}
        merges = [m if isinstance(m, list) else m.split(" ") for m in file["model"]["merges"]]
        self.rank: dict[tuple[int, int], int] = {}  # rank of the merge of two tokens
        self.parts: dict[int, tuple[int, int]] = {}  # the two tokens a token is merged from
        self.made: dict[int, int] = {}  # rank of the merge that makes a token; single bytes have none
        for n, (a, b) in enumerate(merges):
            pair = vocab[a], vocab[b]
            self.rank.setdefault(pair, n)
            whole = vocab[a + b]
            if whole not in self.parts:
                self.parts[whole], self.made[whole] = pair, n
        self.fits: dict[tuple[int, int], bool] = {}  # the pair-compatibility table, filled as pairs are met
        self.stable: dict[int, bool] = {}  # whether a token's own bytes merge to it
        self.reached = {text: i for text, i in self.ids.items() if self._stable(i)}  # tokens that merging can give
        self.shorter: dict[int, int] = {}  # the longest of them that is a proper prefix of a token
        for text, i in self.reached.items():
            self.shorter[i] = next((self.reached[text[:n]] for n in range(len(text) - 1, 0, -1) if text[:n] in self.reached), -1)
        # the automaton reads backwards: the longest token ending at a place of reversed bytes is the longest that starts there
        self.automaton = ahocorasick.Automaton()
        self.single = np.full(256, -1, np.int64)  # tokens of one byte match everywhere and need no automaton
        for text, i in self.reached.items():
            if len(text) > 1:
                self.automaton.add_word(text[::-1].decode("latin-1"), i)
            else:
                self.single[text[0]] = i
        self.automaton.make_automaton()
        #: offset table for decoding
        self.starts = np.zeros(size + 1, np.int64)
        np.cumsum([len(b) for b in self.bytes], out=self.starts[1:])
        self.pool = np.frombuffer(b"".join(self.bytes), np.uint8)

    def compatible(self, left: int, right: int) -> bool:
        """Whether left and right stay apart when their joined bytes are merged in rank order."""
        key = left, right
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) > PAIRS:
                self.fits.clear()
            known = self.fits[key] = self._compatible(left, right)
        return known

    def _compatible(self, left: int, right: int) -> bool:
        # Undo the merges of both sides from the last one on. At each moment the tokens at the border could merge
        # with each other; if that merge comes before the one just undone, the two would not have stayed apart.
        until = len(self.rank)
        while True:
            across = self.rank.get((left, right))
            if across is not None and across < until:
                return False
            a, b = self.made.get(left, -1), self.made.get(right, -1)
            if a < 0 and b < 0:
                return True
            # equal ranks: the leftmost is merged first, so the right one is undone first, and a merge across the
            # border (which lies left of it) has to be no later
            if a > b:
                left, until = self.parts[left][1], a
            else:
                right, until = self.parts[right][0], b + 1

    def longest(self, pieces: list[bytes]) -> np.ndarray:
        """The longest token at each byte of the pieces, which stand one after the other with one place between them."""
        joint = "\u0100".join([p.decode("latin-1") for p in pieces])  # no token holds this letter
        best = self.single[np.frombuffer(b"\0".join(pieces), np.uint8)]
        found = np.fromiter(chain.from_iterable(self.automaton.iter(joint[::-1])), np.int64).reshape(-1, 2)[::-1]
        best[len(joint) - 1 - found[:, 0]] = found[:, 1]  # at each place the longest came first and is written last
        return best

    def encode_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        """ids of each piece of the split."""
        best, at, out = self.longest(pieces).tolist(), 0, []
        for p in pieces:
            out.append(self._walk(best, at, len(p)))
            at += len(p) + 1
        return out

    def _walk(self, best: list[int], base: int, n: int) -> list[int]:
        """ids of the piece of n bytes whose longest matches begin at base."""
        length, shorter, compatible = self.bytes, self.shorter, self.compatible
        token = best[base]
        if len(length[token]) == n:
            return [token]
        free = bytearray(b"\x01") * (n + 1)
        out: list[int] = []
        at = 0
        while True:
            end = at + len(length[token])
            if free[end] and (not out or compatible(out[-1], token)):
                out.append(token)
                at = end
                if at == n:
                    return out
                token = best[base + at]
                continue
            token = shorter[token]
            while token < 0:
                free[at] = 0
                token = out.pop()
                at -= len(length[token])
                token = shorter[token]

    def _stable(self, token: int) -> bool:
        """Whether a token's bytes merge to that token."""
        known = self.stable.get(token)
        if known is None:
            pair = self.parts.get(token)
            known = self.stable[token] = pair is None or (self._stable(pair[0]) and self._stable(pair[1]) and self.compatible_until(pair[0], pair[1], self.made[token]))
        return known

    def compatible_until(self, left: int, right: int, rank: int) -> bool:
        """As compatible, for two tokens whose own merge has this rank: no earlier merge may cross their border."""
        key = left, right, rank
        if key not in self.fits:
            until, good = rank, True
            a_side, b_side = left, right
            while good:
                a, b = self.made.get(a_side, -1), self.made.get(b_side, -1)
                if a < 0 and b < 0:
                    break
                if a > b:
                    a_side, until = self.parts[a_side][1], a
                else:
                    b_side, until = self.parts[b_side][0], b + 1
                across = self.rank.get((a_side, b_side))
                good = across is None or across >= until
            self.fits[key] = good
        return self.fits[key]

    def encode(self, text: str) -> list[int]:
        """ids of a whole text; strings of special tokens become their ids, as the library has it."""
        if self.special and any(s in text for s in self.special):
            out: list[int] = []
            for part in regex.split("(" + "|".join(map(regex.escape, self.special)) + ")", text):
                out += [self.special[part]] if part in self.special else self._ordinary(part)
            return out
        return self._ordinary(text)

    def _ordinary(self, text: str) -> list[int]:
        return list(chain.from_iterable(self.encode_pieces([p.encode("utf-8") for p in PATTERN.findall(text)])))

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """Bytes of ids, gathered from the pool of token bytes by the offset table."""
        first = self.starts[ids]
        size = self.starts[ids + 1] - first
        total = int(size.sum())
        ends = np.cumsum(size)
        where = np.arange(total, dtype=np.int64) + np.repeat(first - (ends - size), size)
        return self.pool[where].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_bytes(ids).decode("utf-8", errors="replace")


class BacktrackingChunks(ChunkEncoder):
    """Chunks as in ChunkEncoder, encoded by BacktrackingBPE and not by the library."""

    def __init__(self, path: str, keep_space: bool):
        self.own = BacktrackingBPE(path)
        self.keep_space = keep_space
        self.forget()

    def fresh(self, chunks: list[str]) -> list[np.ndarray]:
        pieces = [PATTERN.findall(c) for c in chunks]
        ids = self.own.encode_pieces([p.encode("utf-8") for some in pieces for p in some])
        out, at = [], 0
        for some in pieces:
            out.append(np.array(list(chain.from_iterable(ids[at : at + len(some)])), np.uint32))
            at += len(some)
        return out

    def whole(self, text: str) -> bytes:
        return np.array(self.own.encode(text), "<u4").tobytes()


def bpe_round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per row: doc_id, ids (array<int>), decoded text."""
    return _mapped(docs, path, lambda raw, text: (raw, text), "doc_id long, ids array<int>, decoded string", digest=False)


def bpe_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per row: doc_id, n_tokens, SHA-256 of the ids and of the decoded text."""
    return _mapped(docs, path, None, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", digest=True)


def _mapped(docs: DataFrame, path: str | None, _pick, schema: str, digest: bool) -> DataFrame:
    path = path or vocabulary(FILE)

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        own = encoder(path, True, BacktrackingChunks)
        raws = own.encode(b.column("text").to_pylist())
        ids = [np.frombuffer(r, "<u4") for r in raws]
        texts = [own.own.decode(i.astype(np.int64)) for i in ids]
        if not digest:
            return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([i.astype(np.int32) for i in ids], pa.list_(pa.int32())), pa.array(texts)], ["doc_id", "ids", "decoded"])
        return pa.RecordBatch.from_arrays(
            [b.column("doc_id"), pa.array([len(r) // 4 for r in raws], pa.int64()), pa.array([hashlib.sha256(r).hexdigest() for r in raws]), pa.array([hashlib.sha256(t.encode("utf-8")).hexdigest() for t in texts])],
            ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    return arrow_map(documents(docs), one, schema, keep=True)
