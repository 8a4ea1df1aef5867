"""Byte-level BPE as a bounded-lookahead streaming transducer, and its incremental inverse.

All texts of a task pass one `Transducer` in blocks of at most BLOCK characters, so many short texts share a block and a
long one goes over many. It needs only bounded buffers:

1. a pre-tokeniser cuts it into pieces (letters, digits, other signs, white space; a single space joins what follows). A
   boundary is certain once three more characters are read; what stands before the last certain one is merged and leaves;
2. inside a longer piece, what stands `lookahead` bytes or more before the end of what is certain cannot change any more,
   so its tokens are emitted and forgotten;
3. decoding maps ids to bytes and bytes to text through an incremental UTF-8 state machine that gets the ids as they come.

**Lookahead.** Let a boundary at position p be removed by merge r = (u, v) with v to its right. That happens only if v
stands there whole, and only a merge of higher priority that starts with v, or with a token on v's right spine before
that spine token joined its parent, can prevent it. Such chains have strictly falling ranks, so the farthest byte that
can influence p is found by one pass over the merges in priority order (`sufficient_lookahead`).

Once a boundary is certain, no merge crosses it, so the bytes after it can be merged on their own; memory stays at a block
and a few lookaheads whatever the length of the text or of a piece. Distinct pieces of a block are merged once, in step.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import unicodedata
from bisect import bisect_left
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import batches_of, code_points, distinct_spans, expand, map_arrow, only

#: Characters of text in the transducer at once.
BLOCK = 1 << 19
#: Distinct pieces of at most 64 bytes that a worker remembers; it forgets them once fewer than 0.3 of a chunk's are known.
MEMO_PIECES = 150_000
#: Pieces of up to so many bytes are merged in step with others of their length; longer ones one by one.
WIDE = 48
_NEVER = np.iinfo(np.int32).max
_LETTER, _DIGIT, _SPACE, _OTHER = range(4)


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in character of each byte in byte-level vocabularies."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@lru_cache(1)
def _classes() -> np.ndarray:
    out = np.full(0x110000, _OTHER, np.uint8)
    for i in range(0x110000):
        k = unicodedata.category(chr(i))[0]
        if k in "LN":
            out[i] = _LETTER if k == "L" else _DIGIT
    out[[*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = _SPACE
    return out


def piece_starts(points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the pre-tokeniser's pieces start in a code-point array; pieces never cross the given text offsets."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = _classes()[points]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    first = first[:n]
    run = first.copy()
    run[1:] |= kind[1:] != kind[:-1]
    space = kind == _SPACE
    start = run.copy()
    # the last of several blanks stands alone or joins the next run
    last_blank = np.zeros(n, bool)
    last_blank[:-1] = space[:-1] & ~space[1:] & ~first[1:]
    start |= last_blank
    joined = np.zeros(n, bool)
    joined[1:] = last_blank[:-1] & (points[:-1] == 32)
    start &= ~joined
    # 's 't 're 've 'm 'll 'd right after a piece's end
    quote = np.flatnonzero(start & (points == 39))
    if len(quote):
        pad = np.concatenate([points, np.zeros(3, np.uint32)])
        fresh = np.concatenate([first, np.ones(3, bool)])
        a, b = np.where(fresh[quote + 1], 0, pad[quote + 1]), pad[quote + 2]
        b = np.where(fresh[quote + 2], 0, b)
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        size = np.where(one, 2, np.where(two, 3, 0))
        at, size = quote[size > 0], size[size > 0]
        start[at + 1] = False
        end = at + size
        start[end[end < n]] = True
    return np.flatnonzero(start)


class ByteBpe:
    """One tokenizer file: vocabulary, merges, added tokens, and the lookahead that its merge list needs."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        as_bytes = lambda s: bytes(alphabet[c] for c in s)
        self.added = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.ids = {as_bytes(k): v for k, v in spec["model"]["vocab"].items() if k not in self.added}
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        pairs = [(as_bytes(a), as_bytes(b)) for a, b in merges]
        self.single = [self.ids[bytes([b])] for b in range(256)]
        self.rank = {(self.ids[a], self.ids[b]): (r, self.ids[a + b]) for r, (a, b) in reversed([*enumerate(pairs)])}
        self.lookahead = sufficient_lookahead(pairs)
        size = max([*self.ids.values(), *self.added.values()]) + 1
        self.bytes_of = [b""] * size
        for k, v in self.ids.items():
            self.bytes_of[v] = k
        for k, v in self.added.items():
            self.bytes_of[v] = k.encode()
        self.token_length = np.array([len(x) for x in self.bytes_of], np.int64)
        self.token_start = np.cumsum(self.token_length) - self.token_length
        self.token_data = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self._memo: dict[str, np.ndarray] | None = None
        self._span = size
        self._single = np.array(self.single, np.int32)
        order = sorted((a * size + b, r, m) for (a, b), (r, m) in self.rank.items())
        self._pair_keys = np.array([x[0] for x in order] + [np.iinfo(np.int64).max], np.int64)
        self._pair_rank = np.array([x[1] for x in order] + [_NEVER], np.int32)
        self._made = np.zeros(len(pairs) + 1, np.int32)
        for _, r, m in order:
            self._made[r] = m

    # --- encoding -------------------------------------------------------------------------------------------------

    def merge(self, data: bytes) -> list[int]:
        """All merges of a short byte string, best rank and leftmost first."""
        parts = [self.single[b] for b in data]
        if len(parts) > 48:
            return self._merge_long(parts)
        rank = self.rank
        while len(parts) > 1:
            best = None
            for i, pair in enumerate(zip(parts, parts[1:], strict=False)):
                if (r := rank.get(pair)) is not None and (best is None or r[0] < best[0]):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [best[1]]
        return parts

    def _merge_long(self, parts: list[int]) -> list[int]:
        """The same with a heap over a linked list."""
        n, rank = len(parts), self.rank
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        alive = [True] * n
        heap = [(r[0], i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := rank.get((parts[i], parts[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if alive[i] else -1
            if j < 0 or parts[i] != a or parts[j] != b:
                continue
            parts[i] = rank[a, b][1]
            alive[j] = False
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
                if r := rank.get((parts[i], parts[after[i]])):
                    heapq.heappush(heap, (r[0], i, parts[i], parts[after[i]]))
            if (k := before[i]) >= 0 and (r := rank.get((parts[k], parts[i]))):
                heapq.heappush(heap, (r[0], k, parts[k], parts[i]))
        return [x for x, live in zip(parts, alive, strict=True) if live]

    def settle(self, buffer: bytes, last: bool) -> tuple[list[int], bytes]:
        """Tokens at the start of a piece under way that no further byte can change, and the bytes still open."""
        out, step = [], 4 * self.lookahead
        while len(buffer) >= self.lookahead + step:
            done = 0
            for token in self.merge(buffer[: self.lookahead + step]):
                if done + len(self.bytes_of[token]) > step:
                    break
                done += len(self.bytes_of[token])
                out.append(token)
            buffer = buffer[done:]
        return (out + self.merge(buffer), b"") if last else (out, buffer)

    def _pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) * self._span + right
        at = np.searchsorted(self._pair_keys, key)
        return np.where(self._pair_keys[at] == key, self._pair_rank[at], np.int32(_NEVER))

    def merge_rows(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """merge() for many byte spans in step: each round makes the best merge of every span. Flat ids, and sizes."""
        sizes = np.zeros(len(starts), np.int64)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        for n in np.unique(lengths).tolist():
            rows = np.flatnonzero(lengths == n)
            if n > WIDE:
                for i in rows.tolist():
                    raw = data[starts[i] : starts[i] + n].tobytes()
                    done.append((np.array([i]), np.array([self.settle(raw, True)[0]], np.int64)))
                continue
            ids = self._single[data[starts[rows][:, None] + np.arange(n)]]
            ranks = self._pair_ranks(ids[:, :-1], ids[:, 1:])
            while ids.shape[1] > 1:
                at = ranks.argmin(axis=1)
                best = ranks[np.arange(len(at)), at]
                if (ended := best == _NEVER).any():
                    done.append((rows[ended], ids[ended]))
                    rows, ids, ranks, at, best = (x[~ended] for x in (rows, ids, ranks, at, best))
                    if not len(rows):
                        break
                k, each = ids.shape[1], np.arange(len(at))
                ids[each, at] = self._made[best]
                ids = ids[np.arange(k) != (at + 1)[:, None]].reshape(len(at), k - 1)
                ranks = ranks[np.arange(k - 1) != at[:, None]].reshape(len(at), k - 2)
                if (lefts := at > 0).any():
                    r, c = each[lefts], at[lefts]
                    ranks[r, c - 1] = self._pair_ranks(ids[r, c - 1], ids[r, c])
                if (rights := at < k - 2).any():
                    r, c = each[rights], at[rights]
                    ranks[r, c] = self._pair_ranks(ids[r, c], ids[r, c + 1])
            if len(rows):
                done.append((rows, ids))
        for rows, ids in done:
            sizes[rows] = ids.shape[1]
        first = np.cumsum(sizes) - sizes
        flat = np.zeros(int(sizes.sum()), np.uint32)
        for rows, ids in done:
            flat[first[rows][:, None] + np.arange(ids.shape[1])] = ids
        return flat, sizes

    def merge_known(self, hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """merge_rows, taking what earlier chunks have merged from the memo; each hit is compared byte by byte."""
        m = self._memo
        known = np.zeros(len(starts), bool)
        if m is not None:
            slot = np.minimum(np.searchsorted(m["hash"], hashes), len(m["hash"]) - 1)
            known = (m["hash"][slot] == hashes) & (m["bytes"][slot] == lengths)
            hit = np.flatnonzero(known)
            there, here = m["data"][expand(m["at"][slot[hit]], lengths[hit])], data[expand(starts[hit], lengths[hit])]
            if not np.array_equal(there, here):
                known[:] = False
            if known.mean() < 0.3:
                self._memo = m = None
                known[:] = False
        new = np.flatnonzero(~known)
        made, made_sizes = self.merge_rows(data, starts[new], lengths[new])
        sizes = np.zeros(len(starts), np.int64)
        source = np.zeros(len(starts), np.int64)
        sizes[new] = made_sizes
        source[new] = np.cumsum(made_sizes) - made_sizes
        pool = made
        if known.any():
            sizes[hit], source[hit] = m["size"][slot[hit]], m["first"][slot[hit]] + len(made)
            pool = np.concatenate([made, m["flat"]])
        out = pool[expand(source, sizes)]
        if m is None or len(m["hash"]) < MEMO_PIECES:
            keep = new[lengths[new] <= 64]
            old = m or {k: np.zeros(0, t) for k, t in (("hash", np.uint64), ("bytes", np.int64), ("at", np.int64), ("data", np.uint8), ("size", np.int64), ("first", np.int64), ("flat", np.uint32))}
            raw, ids = data[expand(starts[keep], lengths[keep])], made[expand(source[keep], sizes[keep])]
            grown = {
                "hash": np.concatenate([old["hash"], hashes[keep]]),
                "bytes": np.concatenate([old["bytes"], lengths[keep]]),
                "at": np.concatenate([old["at"], len(old["data"]) + np.cumsum(lengths[keep]) - lengths[keep]]),
                "size": np.concatenate([old["size"], sizes[keep]]),
                "first": np.concatenate([old["first"], len(old["flat"]) + np.cumsum(sizes[keep]) - sizes[keep]]),
            }
            order = np.argsort(grown["hash"], kind="stable")
            self._memo = {k: v[order] for k, v in grown.items()} | {"data": np.concatenate([old["data"], raw]), "flat": np.concatenate([old["flat"], ids])}
            if not len(order):
                self._memo = None
        return out, sizes

    def pieces(self, points: np.ndarray, texts: Sequence[str], starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of whole pieces [start, end) of the joined texts' code points, and each piece's number of ids."""
        chosen, kind, hashes = distinct_spans(points, starts, ends)
        data = np.frombuffer("".join(texts).encode("utf-8", "replace"), np.uint8)
        at = np.zeros(len(points) + 1, np.int64)
        np.cumsum(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF), out=at[1:])
        flat, sizes = self.merge_known(hashes, data, at[starts[chosen]], at[ends[chosen]] - at[starts[chosen]])
        first = np.cumsum(sizes) - sizes
        per_piece = sizes[kind]
        return flat[expand(first[kind], per_piece)], per_piece

    def _segments(self, text: str) -> list[str | int]:
        """The text cut at added tokens, which stand as their ids."""
        parts: list[str | int] = [text]
        for content, token in self.added.items():
            if content in text:
                parts = [z for y in parts for z in ([x for k, w in enumerate(y.split(content)) for x in ([token, w] if k else [w])] if isinstance(y, str) else [y])]
        return parts

    def stream(self, texts: Iterable[str], block: int = BLOCK) -> Iterator[Block]:
        """All texts through one transducer, in blocks of at most `block` characters; a text may go over several."""
        machine, items, size = Transducer(self), [], 0
        for row, text in enumerate(texts):
            segments = self._segments(text)
            for k, x in enumerate(segments):
                last = k + 1 == len(segments)
                if isinstance(x, int):
                    items.append((row, x, last))
                    continue
                done = 0
                while True:
                    part = x[done : done + block - size]
                    done, size = done + len(part), size + len(part)
                    items.append((row, part, last and done == len(x)))
                    if size >= block:
                        yield machine.block(items, done < len(x))
                        items, size = [], 0
                    if done == len(x):
                        break
        if items:
            yield machine.block(items, False)

    def encode(self, texts: Sequence[str], block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and each text's offset in it."""
        found, sizes = [np.zeros(0, np.uint32)], np.zeros(len(texts), np.int64)
        for b in self.stream(texts, block):
            found.append(b.ids)
            np.add.at(sizes, b.rows, np.diff(b.offsets))
        return np.concatenate(found), np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])

    # --- decoding -------------------------------------------------------------------------------------------------

    def bytes_for(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Bytes of all ids, and the byte offset of each id."""
        lengths = self.token_length[ids]
        return self.token_data[expand(self.token_start[ids], lengths)].tobytes(), np.concatenate([np.zeros(1, np.int64), np.cumsum(lengths)])

    def decode(self, ids: np.ndarray) -> str:
        return Decoder(self).feed(ids, True)


class Block(NamedTuple):
    """Tokens that a block of parts has made certain."""

    rows: np.ndarray  # the text of each part
    ids: np.ndarray
    offsets: np.ndarray  # of each part's ids
    ends: np.ndarray  # whether a text ends with the part

    def parts(self) -> Iterator[tuple[int, np.ndarray, bool]]:
        """Row, ids, and whether the row ends, of each part."""
        cuts = self.offsets.tolist()
        for row, a, b, end in zip(self.rows.tolist(), cuts, cuts[1:], self.ends.tolist(), strict=False):
            yield row, self.ids[a:b], end


class Transducer:
    """Text in parts of any size to tokens, each of which leaves as soon as nothing that follows can change it.

    Between two feeds stay: the characters from the last certain piece boundary on (a boundary is certain once OPEN more
    characters are read), or, inside a piece longer than `keep`, those OPEN characters and the bytes within a few
    lookaheads before them. Nothing grows with the text.
    """

    #: Characters after a boundary that can still move it: a contraction looks at two, and a text's last run may go on.
    OPEN = 3

    def __init__(self, bpe: ByteBpe, keep: int | None = None) -> None:
        self.bpe, self.keep = bpe, keep or 8 * bpe.lookahead
        self.raw, self.held, self.context = b"", "", ""  # open bytes, open characters, two characters before them inside a piece

    def feed(self, parts: Sequence[str], more: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Ids that are certain, and their offsets by part. The first part goes on with the text under way, every other is
        a text of its own; `more` says that the last one goes on."""
        known = len(self.context)
        texts = [self.context + self.held + parts[0], *parts[1:]]
        points, offsets = code_points(texts)
        starts = piece_starts(points, offsets)
        end, inside, raw = len(points), bool(known), self.raw
        self.raw, self.held, self.context = b"", "", ""
        prefix: list[int] = []
        if more:
            own = int(offsets[-2])
            at = np.searchsorted(starts, end - self.OPEN, "right") - 1
            cut = int(starts[at]) if at >= 0 and starts[at] >= own else own
            last = texts[-1]
            if end - cut - self.OPEN > self.keep or inside and cut == 0:
                settled = max(end - self.OPEN, known if own == 0 else own)
                self.held, self.context = last[settled - own :], last[max(settled - own - 2, 0) : settled - own]
                fresh = last[(known if inside and cut == 0 else cut - own) : settled - own].encode("utf-8", "replace")
                if inside and cut == 0:
                    prefix, self.raw = self.bpe.settle(raw + fresh, False)
                    return np.array(prefix, np.uint32), np.array([0, len(prefix)], np.int64)
                opened, self.raw = self.bpe.settle(fresh, False)
            else:
                self.held, opened = last[cut - own :], []
            starts, end = starts[starts < cut], cut
        else:
            opened = []
        ends = np.append(starts[1:], end)
        if inside:  # the piece under way ends here
            closing = int(ends[0]) if len(ends) else end
            prefix, _ = self.bpe.settle(raw + texts[0][known:closing].encode("utf-8", "replace"), True)
            starts, ends = starts[1:], ends[1:]
        ids, sizes = self.bpe.pieces(points, texts, starts, ends) if len(starts) else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        upto = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])[np.searchsorted(starts, offsets)] + len(prefix)
        upto[0] = 0
        upto[-1] += len(opened)
        return np.concatenate([np.array(prefix, np.uint32), ids, np.array(opened, np.uint32)]), upto

    def block(self, items: list[tuple[int, str | int, bool]], more: bool) -> Block:
        """feed() for parts (row, text or added token's id, whether the row ends)."""
        ids, offsets = self.feed([x if isinstance(x, str) else "" for _, x, _ in items], more)
        special = [i for i, (_, x, _) in enumerate(items) if isinstance(x, int)]
        if special:
            ids = np.insert(ids, offsets[special], [items[i][1] for i in special]).astype(np.uint32)
            extra = np.zeros(len(offsets), np.int64)
            extra[np.array(special) + 1] = 1
            offsets = offsets + np.cumsum(extra)
        return Block(np.array([r for r, _, _ in items]), ids, offsets, np.array([e for _, _, e in items]))


class ByteToText:
    """Incremental UTF-8 state machine: at most three bytes wait for the rest of their character; bytes that cannot
    belong to one become U+FFFD, once per maximal part."""

    def __init__(self) -> None:
        self._machine = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, data: bytes) -> str:
        return self._machine.decode(data)

    def end(self) -> str:
        return self._machine.decode(b"", True)


class Decoder:
    """Ids in parts to text; a character leaves with the id that completes it."""

    def __init__(self, bpe: ByteBpe) -> None:
        self.bpe, self.machine = bpe, ByteToText()

    def feed(self, ids: np.ndarray, last: bool) -> str:
        text = self.machine.feed(self.bpe.bytes_for(ids)[0])
        return text + self.machine.end() if last else text


def sufficient_lookahead(pairs: list[tuple[bytes, bytes]]) -> int:
    """Bytes after a boundary beyond which nothing can influence it; see the module's text."""
    made: dict[bytes, tuple[int, bytes]] = {}
    reach: dict[bytes, tuple[list[int], list[int]]] = {}  # by left token: ranks, running maximum of their reach
    most = 1
    for r, (u, v) in enumerate(pairs):
        token, limit, best = v, r, 0
        while True:
            if token in reach:
                ranks, tops = reach[token]
                if k := bisect_left(ranks, limit):
                    best = max(best, tops[k - 1])
            if token not in made:
                break
            limit, token = made[token]
        own = len(v) + best
        ranks, tops = reach.setdefault(u, ([], []))
        ranks.append(r)
        tops.append(max(own, tops[-1] if tops else 0))
        most = max(most, own)
        made.setdefault(u + v, (r, v))
    return most


@lru_cache(4)
def tokenizer(path: str) -> ByteBpe:
    return ByteBpe(path)


def encode_decode(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text and decode it again.

    Returns one row per input row: id, ids (array<int>), decoded text. Null text counts as empty and gives no ids.
    Repeated rows give repeated results; an empty table gives an empty result; other columns are ignored, also those whose
    names clash.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        bpe = tokenizer(path)
        for batch in batches:
            for first, texts in batches_of(batch, "text"):
                ids: list[list[np.ndarray]] = [[] for _ in texts]
                decoded = [Decoder(bpe) for _ in texts]
                strings: list[list[str]] = [[] for _ in texts]
                for b in bpe.stream(texts):
                    for row, own, end in b.parts():
                        ids[row].append(own)
                        strings[row].append(decoded[row].feed(own, end))
                sizes = [sum(map(len, x)) for x in ids]
                yield {
                    "id": batch.column(0).slice(first, len(texts)),
                    "ids": pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]).astype(np.int32)), pa.array(np.concatenate([np.zeros(0, np.uint32), *(y for x in ids for y in x)]).astype(np.int32))),
                    "decoded": pa.array(["".join(x) for x in strings], pa.string()),
                }

    rows = only(docs, id=id_col, text=text_col)
    return map_arrow(rows, run, f"id {dict(rows.dtypes)['id']}, ids array<int>, decoded string").withColumnRenamed("id", id_col)


def digests(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """encode_decode reduced to digests while the tokens pass, so that neither ids nor decoded texts are ever held whole.

    Columns: id, n_tokens, ids_sha256 (of little-endian 32-bit ids), decoded_sha256 (of the UTF-8 text). Null text counts as
    empty, repeated rows give repeated results, an empty table gives an empty result, other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        bpe = tokenizer(path)
        for batch in batches:
            for first, texts in batches_of(batch, "text"):
                n = np.zeros(len(texts), np.int64)
                shas: list[tuple[str, str]] = [("", "")] * len(texts)
                under_way = None  # of the one text that a block may leave unfinished
                for b in bpe.stream(texts):
                    for row, own, end in b.parts():
                        of_ids, of_text, decoder = under_way or (hashlib.sha256(), hashlib.sha256(), Decoder(bpe))
                        n[row] += len(own)
                        of_ids.update(own.astype("<u4").tobytes())
                        of_text.update(decoder.feed(own, end).encode())
                        under_way = None if end else (of_ids, of_text, decoder)
                        if end:
                            shas[row] = of_ids.hexdigest(), of_text.hexdigest()
                yield {"id": batch.column(0).slice(first, len(texts)), "n_tokens": n, "ids_sha256": [x for x, _ in shas], "decoded_sha256": [x for _, x in shas]}

    rows = only(docs, id=id_col, text=text_col)
    return map_arrow(rows, run, f"id {dict(rows.dtypes)['id']}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
