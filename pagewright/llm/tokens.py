"""Encoding of whole texts with a public byte-level BPE vocabulary, as a bounded-lookahead transducer.

Two layers, both of constant memory:

* Text is cut into pieces by the vocabulary's split pattern. The pattern looks at most three code
  points ahead of a cut except inside a run of white space, so cuts of a whole batch are found with a
  few numpy passes over code points; a text longer than a block is fed in parts that end where a
  piece is certain to end, and a piece that is longer than a block by itself.
* A piece is turned into tokens from left to right. A sequence of tokens is the merge list's result
  exactly if no neighbouring pair would have been merged across its border (``MergeList.fits``), so
  each prefix has one last token, found among the tokens that end there. How many bytes must follow a
  token until no continuation can change it is computed once from the merge list
  (``MergeList.lookahead``, 320 bytes for the vocabulary used here); tokens are emitted as soon as that
  many bytes have come.

Why the lookahead suffices: merges run by rank. Take two continuations of the same bytes. At each rank
both have the same symbols up to a common border, at first the end of those bytes. The border only moves
where a merge (l, r) crosses it in one of the two, and then to the beginning of l. The next merge that
crosses it, (l', r'), has a higher rank, since l appeared or stayed behind by then, and its right part
begins with l. So the border never moves farther than the heaviest chain of merges of rising ranks, each
right part of which begins with the left part before, weighed by the bytes of the left parts.

Short pieces recur, so their tokens are kept in a table of bounded size.
"""

from __future__ import annotations

import codecs
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from pagewright.llm import kernel
from pagewright.session import spread, table

#: Where the public vocabularies lie, and the one that ``p8_ids`` uses.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: Pieces kept with their tokens; the table is emptied when it is full.
KEPT = 200_000
#: Longer pieces, in characters, are not kept.
KEPT_LENGTH = 64
#: Bytes that a transducer takes at a time.
STRIDE = 1024


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for the 256 bytes: printable Latin-1 bytes
    stand for themselves, the rest are numbered from U+0100."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class MergeList:
    """The merges of a vocabulary file, and what follows from them about neighbouring tokens. As in every
    trained list, a merge needs only earlier ones, and each token's own bytes merge to the token."""

    def __init__(self, path: str) -> None:
        import ahocorasick

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters = byte_letters()
        vocab: dict[str, int] = model["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        made = {a + b for a, b in pairs}
        self.bytes: dict[int, bytes] = {}
        for name, i in vocab.items():
            if name in made or len(name) == 1 and name in letters:
                self.bytes[i] = bytes(letters[c] for c in name)
        #: (left, right) -> (rank, made token), and each made token's own rank and halves.
        self.merge: dict[tuple[int, int], int] = {}
        rank: dict[int, int] = {}
        half: dict[int, tuple[int, int]] = {}
        for r, (a, b) in enumerate(pairs):
            left, right, both = vocab[a], vocab[b], vocab[a + b]
            self.merge[left, right] = r
            rank.setdefault(both, r)
            half.setdefault(both, (left, right))
        never = len(pairs)

        def spine(token: int, side: int) -> list[tuple[int, int]]:
            """The parts of a token at its border, each with the rank of the merge that ended it."""
            out, until = [(token, never)], token
            while until in half:
                out.append((half[until][side], rank[until]))
                until = half[until][side]
            return out

        self.right_spine = {t: spine(t, 1) for t in self.bytes}
        self.left_spine = {t: spine(t, 0) for t in self.bytes}
        self.longest = max(map(len, self.bytes.values()))
        self.known: dict[tuple[int, int], bool] = {}
        self.lookahead = self._sufficient_lookahead([(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs])
        self.automaton = ahocorasick.Automaton()
        for t, b in self.bytes.items():
            self.automaton.add_word(b.decode("latin-1"), (t, len(b)))
        self.automaton.make_automaton()

    def _sufficient_lookahead(self, rules: list[tuple[int, int, int]]) -> int:
        """The heaviest chain of merges of rising ranks in which each right part begins with the left part
        before, in bytes of the left parts. Rules are taken from the last to the first, so the heaviest
        chain that goes on from a token is known when a rule needs it."""
        made = {both: r for r, (_, _, both) in enumerate(rules)}
        onward: dict[int, int] = {}  # token -> weight of the heaviest chain whose first right part begins with it
        most = 0
        for r in range(len(rules) - 1, -1, -1):
            left, right, _ = rules[r]
            if made.get(left, -1) >= r or made.get(right, -1) >= r:
                raise ValueError("a merge comes before one that it needs")
            weight = len(self.bytes[left]) + onward.get(left, 0)
            most = max(most, weight)
            for part, _ in self.left_spine[right]:
                if onward.get(part, 0) < weight:
                    onward[part] = weight
        return most

    def fits(self, left: int, right: int) -> bool:
        """Whether the two tokens stay apart when they stand side by side.

        At some time each part x at the left token's end stood beside each part y at the right
        token's start. Their merge would have come first if its rank is before the merge that
        ended x (that one lies further left, so it wins a tie) and not after the one that ended y.
        """
        key = (left, right)
        got = self.known.get(key)
        if got is None:
            got = True
            find = self.merge.get
            for x, x_until in self.right_spine[left]:
                for y, y_until in self.left_spine[right]:
                    r = find((x, y))
                    if r is not None and r < x_until and r <= y_until:
                        got = False
                        break
                if not got:
                    break
            if len(self.known) > 4 * KEPT:
                self.known.clear()
            self.known[key] = got
        return got


class Transducer:
    """Bytes in, tokens out. ``stream`` gives tokens that no later byte can change; ``held`` is the most
    bytes that it kept."""

    def __init__(self, merges: MergeList) -> None:
        self.merges, self.held = merges, 0
        self.lookahead = merges.lookahead

    def encode(self, data: bytes) -> list[int]:
        """Tokens of a whole piece."""
        return [t for part in self.stream(data[i : i + STRIDE] for i in range(0, len(data), STRIDE)) for t in part]

    def stream(self, parts: Iterable[bytes]) -> Iterator[list[int]]:
        """Tokens of a piece that arrives in parts, in as many lists. What is kept are the lookahead, a token
        and a part, however long the piece is."""
        fits, size, wait, iter_ = self.merges.fits, self.merges.bytes, self.merges.lookahead, self.merges.automaton.iter
        before, tail = -1, b""  # the last token given away; the bytes behind it
        last: list[int | None] = [-1]  # of the prefixes of tail; none where no chain ends
        for part in parts:
            tail += part
            n = len(tail)
            self.held = max(self.held, n)
            last = [before] + [None] * n
            for end, (token, length) in iter_(tail.decode("latin-1")):
                left = last[end + 1 - length]
                if last[end + 1] is None and left is not None and (left < 0 or fits(left, token)):
                    last[end + 1] = token
            if n <= wait:
                continue
            out, place = [], n
            while place > 0:
                token = last[place]
                if place <= n - wait:
                    out.append(token)
                place -= len(size[token])
            if out:
                out.reverse()
                done = sum(len(size[t]) for t in out)
                before, tail = out[-1], tail[done:]
                last = last[done:]
                yield out
        if tail:
            out, place = [], len(tail)
            while place > 0:
                out.append(last[place])
                place -= len(size[last[place]])
            yield out[::-1]


@lru_cache(maxsize=4)
def merge_list(path: str) -> MergeList:
    return MergeList(path)


# Split pattern of the vocabulary (fixed by it): 's|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+
_PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
OTHER, LETTER, NUMBER, SPACE = range(4)
_kinds: list[np.ndarray] = []


def kinds() -> np.ndarray:
    if not _kinds:
        import unicodedata

        out = np.zeros(0x110000, np.uint8)
        for c in range(0x110000):
            k = unicodedata.category(chr(c))[0]
            if k == "L":
                out[c] = LETTER
            elif k == "N":
                out[c] = NUMBER
        # Unicode's White_Space property
        out[[*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = SPACE
        _kinds.append(out)
    return _kinds[0]


def piece_starts(joined: str, bounds: np.ndarray) -> np.ndarray:
    """Where the pieces of all texts begin; text i takes the places bounds[i] to bounds[i+1]."""
    n = len(joined)
    if not n:
        return np.empty(0, np.int64)
    cps = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    kind = np.append(kinds()[cps], 255)
    new = np.zeros(n + 1, bool)
    new[bounds] = True  # also the end of the last text
    fresh = new.copy()
    new[1:n] |= kind[1:n] != kind[: n - 1]
    new[n] = True
    run = np.flatnonzero(new)
    start, end = run[:-1], run[1:]
    k = kind[start]
    after_blank = np.zeros(len(start), bool)
    after_blank[1:] = cps[start[1:] - 1] == 0x20
    after_blank &= ~fresh[start]
    cut = np.zeros(n + 1, bool)
    cut[start[(k == SPACE) | ~after_blank]] = True
    inner = (k == SPACE) & ~fresh[end]
    cut[end[inner] - 1] = True
    # Contractions: a lone apostrophe that begins a piece, and the letters right behind it.
    lone = np.flatnonzero((k == OTHER) & (end - start == 1) & ~after_blank & ~fresh[end])
    lone = lone[cps[start[lone]] == 0x27]
    lone = lone[kind[end[lone]] == LETTER]
    if len(lone):
        at, stop = end[lone], end[lone + 1]
        one = np.isin(cps[at], [ord(c) for c in "stmd"])
        nxt = np.where(at + 1 < stop, cps[np.minimum(at + 1, n - 1)], 0)
        two = ((cps[at] == ord("r")) | (cps[at] == ord("v"))) & (nxt == ord("e")) | (cps[at] == ord("l")) & (nxt == ord("l"))
        cut[at[one | two]] = False
        rest = at + np.where(one, 1, 2)
        rest = rest[(one | two) & (rest < stop)]
        cut[rest] = True
    return np.flatnonzero(cut[:n])


class Encoder:
    """Batches of texts to batches of token lists."""

    def __init__(self, path: str) -> None:
        self.transducer = Transducer(merge_list(path))
        self.kept: dict[str, tuple[int, ...]] = {}

    def _piece(self, piece: str) -> tuple[int, ...]:
        return tuple(self.transducer.encode(piece.encode("utf-8", "surrogatepass")))

    def _block(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        joined = "".join(texts)
        bounds = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) for t in texts], out=bounds[1:])
        starts = piece_starts(joined, bounds)
        ends = [*starts[1:].tolist(), len(joined)]
        pieces = [joined[a:b] for a, b in zip(starts.tolist(), ends, strict=False)] if len(starts) else []
        kept = self.kept
        if len(kept) > KEPT:
            kept.clear()
        once = []
        for p in set(pieces).difference(kept):
            kept[p] = self._piece(p)
            if len(p) > KEPT_LENGTH:
                once.append(p)
        got = [*map(kept.__getitem__, pieces)]
        for p in once:
            del kept[p]
        sizes = np.fromiter(map(len, got), np.int64, len(got))
        upto = np.zeros(len(got) + 1, np.int64)
        np.cumsum(sizes, out=upto[1:])
        flat = np.fromiter(chain.from_iterable(got), np.int32, int(upto[-1]))
        return flat, np.diff(upto[np.searchsorted(starts, bounds)])

    def encode(self, texts: list[str | None]) -> pa.ListArray:
        """Ids of each text; a null text has none, as an empty one has."""
        flats, counts = [], []
        for _, block in kernel.blocks(texts):
            count = np.zeros(len(block), np.int64)
            parts: list[str] = []
            owner: list[int] = []

            def flush() -> None:
                if parts:
                    flat, sizes = self._block(parts)
                    flats.append(flat)
                    count[:] += np.bincount(owner, sizes, len(block)).astype(np.int64)  # noqa: B023
                    parts.clear()
                    owner.clear()

            for i, t in enumerate(block):
                for part, whole in stable_parts(t or ""):
                    if whole:  # one piece, longer than a block
                        flush()
                        coded = (part[k : k + STRIDE].encode("utf-8", "surrogatepass") for k in range(0, len(part), STRIDE))
                        for out in self.transducer.stream(coded):
                            flats.append(np.array(out, np.int32))
                            count[i] += len(out)
                    else:
                        parts.append(part)
                        owner.append(i)
            flush()
            counts.append(count)
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(counts))]) if counts else np.zeros(1)
        values = np.concatenate(flats) if flats else np.empty(0, np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))


def stable_parts(text: str, size: int = kernel.BLOCK) -> Iterator[tuple[str, bool]]:
    """A text in parts of at most about ``size`` that end where a piece ends whatever follows, and pieces
    that are longer than that by themselves (marked true).

    A piece certainly ends between a letter and a number and before a white space behind something else.
    """
    start, n = 0, len(text)
    while n - start > size:
        kind = kinds()[np.frombuffer(text[start : start + size].encode("utf-32-le", "surrogatepass"), "<u4")]
        a, b = kind[:-1], kind[1:]
        sure = (a != b) & ((b == SPACE) | (a == LETTER) & (b == NUMBER) | (a == NUMBER) & (b == LETTER))
        places = np.flatnonzero(sure)
        if len(places):
            cut = start + int(places[-1]) + 1
            yield text[start:cut], False
            start = cut
            continue
        # no such place in the block: the pieces one by one
        end = start
        for m in _PIECE.finditer(text, start):
            if m.end() - m.start() > size // 2:
                if end > start:
                    yield text[start:end], False
                yield m[0], True
                end = m.end()
                break
            end = m.end()
            if end - start > size // 2:
                yield text[start:end], False
                break
        start = end
    if start < n:
        yield text[start:], False


_encoders: dict[str, Encoder] = {}


def encode_texts(df: DataFrame, id_column: str, text_column: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, ids): one row for each row of ``df``, in one pass without a shuffle.

    A null text and an empty one have an empty list; other columns of ``df`` play no part, an id
    may be null or repeated. Ids never hold special tokens: their spellings are ordinary text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoders.setdefault(vocabulary, Encoder(vocabulary))
        for b in batches:
            ids = encoder.encode(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), ids], names=[id_column, "ids"])

    kind = df.schema[id_column].dataType.simpleString()
    return spread(df.select(id_column, text_column)).mapInArrow(run, f"`{id_column}` {kind}, ids array<int>")


class Decoder:
    """Tokens to text, as they come: bytes wait only while a character is incomplete. Bytes that
    are no UTF-8 become U+FFFD."""

    def __init__(self, path: str) -> None:
        self.bytes = merge_list(path).bytes
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        return self.machine.decode(b"".join(self.bytes[i] for i in ids))

    def finish(self) -> str:
        out = self.machine.decode(b"", True)
        self.machine.reset()
        return out


def decode_ids(df: DataFrame, id_column: str, ids_column: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, text) of token lists; a null list gives a null text. An unknown id is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Decoder(vocabulary)
        for b in batches:
            texts = [None if ids is None else machine.feed(ids) + machine.finish() for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=[id_column, "text"])

    kind = df.schema[id_column].dataType.simpleString()
    return df.select(id_column, ids_column).mapInArrow(run, f"`{id_column}` {kind}, text string")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return encode_texts(table(spark, sf_dir, "documents"), "doc_id", "text")


def p8_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_chars, same): the length of the text that decoding the ids gives, and whether it is the
    document's (a null text is an empty one)."""
    from pyspark.sql import functions as F

    docs = table(spark, sf_dir, "documents")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoders.setdefault(VOCABULARY, Encoder(VOCABULARY))
        machine = Decoder(VOCABULARY)
        for b in batches:
            texts = b.column(1).to_pylist()
            back = [machine.feed(i) + machine.finish() for i in encoder.encode(texts).to_pylist()]
            same = [x == (t or "") for x, t in zip(back, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in back], pa.int64()), pa.array(same, pa.bool_())], names=["doc_id", "n_chars", "same"])

    return spread(docs.select("doc_id", F.col("text"))).mapInArrow(run, "doc_id long, n_chars long, same boolean")


SQL = {"p8_roundtrip": "select doc_id, coalesce(length(text), 0)::bigint n_chars, true same from documents"}
