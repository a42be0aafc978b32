"""Byte-level BPE encoding with character offsets, and decoding."""

from __future__ import annotations

import base64
import os
from array import array
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fdrspark.llm.common import sha256_hex, slices, table, texts, trimmed

DEFAULT_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: Most bytes, with an entry's overhead each, of the pieces that one worker keeps the ids of; beyond it the memo starts anew.
MEMO_BYTES, ENTRY_BYTES = 40 << 20, 190
#: Bytes of text that one call of the encoder gets; a longer text is a call of its own.
CALL_BYTES = 1 << 20


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself where it prints, else one from 256 up."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b if b in prints else next(free)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def rank_merge(piece: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """Join the leftmost neighbours of least rank until no neighbours have one."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best = min(((ranks[p], i) for i in range(len(parts) - 1) if (p := parts[i] + parts[i + 1]) in ranks), default=None)
        if best is None:
            break
        i = best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


class ByteBPE:
    """A tokenizers model made from a rank file, and a memo of what it gave.

    Every split of a token into two tokens is a merge with that token's rank. A
    rank file leaves ties between equal tokens to the leftmost; merges rank every
    split apart, which differs only where x + y = y + z are one token and xyz
    stands in the text. Stretches with such a place go through ``rank_merge``.
    """

    def __init__(self, path: str, pattern: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import ahocorasick
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        ranks = self.ranks = read_ranks(path)
        chars = byte_characters()
        shown = {t: "".join(chars[b] for b in t) for t in ranks}
        self.tied = ahocorasick.Automaton()
        merges = []
        for t in sorted(ranks, key=ranks.get):
            for i in range(1, len(t)):
                x, y = t[:i], t[i:]
                if x in ranks and y in ranks:
                    merges.append((shown[x], shown[y]))
                    z = t[len(y) :]
                    if z != y and t.startswith(y) and z in ranks:
                        self.tied.add_word((x + t).decode("latin-1"), 1)
                        self.tied.add_word((t + z).decode("latin-1"), 1)
        if len(self.tied):
            self.tied.make_automaton()
        self.tokenizer = Tokenizer(models.BPE(vocab={shown[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
        split = pre_tokenizers.Split(Regex(pattern), "isolated")
        if pattern == public_tokenizers.PATTERN:  # which the byte level pre-tokenizer has built in
            self.tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
        else:
            self.tokenizer.pre_tokenizer = pre_tokenizers.Sequence([split, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.pattern = regex.compile(pattern)
        self.units = regex.compile(r"\s*\S+|\s+")
        self.rough = regex.compile(r" \s|\s ")
        self.length = np.zeros(max(ranks.values()) + 1, np.int64)
        for t, i in ranks.items():
            self.length[i] = len(t)
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.ids, self.starts, self.ends = array("i"), array("i"), array("i")  # of each known unit, back to back
        self.first, self.chars = array("i", [0]), array("i")
        self.held = 0

    def _exact(self, text: str) -> list[int]:
        """Ids by the rank file's own rule."""
        out = []
        for w in self.pattern.findall(text):
            data = w.encode("utf-8", "surrogatepass")
            out += [self.ranks[p] for p in ([data] if data in self.ranks else rank_merge(data, self.ranks))]
        return out

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _learn(self, units: list[str]) -> None:
        """Ids and offsets of units that aren't known yet.

        Units with a space before and no white space behind are encoded end to
        end, for the pattern parts them again; others one by one.
        """
        apart = [u for u in units if u[0] != " " or u[-1].isspace()]
        joint = [u for u in units if u[0] == " " and not u[-1].isspace()]
        tied = set()
        if joint and len(self.tied):
            data = "".join(joint).encode("utf-8", "surrogatepass").decode("latin-1")
            hits = np.array([i for i, _ in self.tied.iter(data)], np.int64)
            if len(hits):
                stops = np.cumsum([len(u.encode("utf-8", "surrogatepass")) for u in joint])
                tied = set(np.searchsorted(stops, hits, side="right").tolist())
        apart += [joint[i] for i in sorted(tied)]
        joint = [u for i, u in enumerate(joint) if i not in tied]
        for lo in range(0, len(joint), 4096):
            part = joint[lo : lo + 4096]
            self._keep(part, np.array(self._ids("".join(part)), np.int64))
        for u in apart:
            raw = u.encode("utf-8", "surrogatepass").decode("latin-1")
            odd = len(self.tied) and next(self.tied.iter(raw), None) is not None
            self._keep([u], np.array(self._exact(u) if odd else self._ids(u), np.int64))

    def _keep(self, units: list[str], ids: np.ndarray) -> None:
        """Note the tokens of units that were encoded end to end: bytes tell which are whose, and their places in characters."""
        data = np.frombuffer("".join(units).encode("utf-8", "surrogatepass"), np.uint8)
        char = np.cumsum((data & 0xC0) != 0x80) - 1  # of each byte
        stop = np.cumsum(self.length[ids])
        if (stop[-1] if len(stop) else 0) != len(data):
            raise ValueError("the tokens' bytes aren't the text's")
        start = stop - self.length[ids]
        sizes = np.array([len(u) for u in units])
        begin = np.cumsum(sizes) - sizes
        tokens = np.searchsorted(char[start], begin) if len(ids) else np.zeros(len(units), np.int64)
        n = np.diff(np.append(tokens, len(ids)))
        shift = np.repeat(begin, n)
        base = len(self.ids)
        for to, values in ((self.ids, ids), (self.starts, char[start] - shift), (self.ends, char[stop - 1] + 1 - shift), (self.first, base + np.cumsum(n)), (self.chars, sizes)):
            to.frombytes(np.asarray(values, np.intc).tobytes())
        at = len(self.index)
        self.index.update(zip(units, range(at, at + len(units)), strict=True))
        self.held += len(data) + ENTRY_BYTES * len(units)

    def _units(self, text: str) -> list[str]:
        """Stretches that the pattern treats apart: words with the white space before them."""
        if not text:
            return []
        if self.rough.search(text):
            return self.units.findall(text)
        head, *rest = text.split(" ")
        return [head, *[" " + w for w in rest]] if head else [" " + w for w in rest]

    def encode(self, batch: list[str]):
        """(ids, starts, ends) back to back, and the number of tokens before each text and after the last."""
        if self.held > MEMO_BYTES:
            self.forget()
        units = [self._units(t) for t in batch]
        index = self.index
        new = [u for u in {u for us in units for u in us} if u not in index]
        if new:
            self._learn(new)
        which = np.fromiter((i for us in units for i in map(index.__getitem__, us)), dtype=np.int64, count=sum(map(len, units)))
        # Views: gone before the memo grows again.
        ids, starts, ends, first, chars = (np.frombuffer(x, np.intc) if len(x) else np.zeros(0, np.intc) for x in (self.ids, self.starts, self.ends, self.first, self.chars))
        n = first[which + 1] - first[which]
        stop = np.cumsum(n, dtype=np.int64)
        place = np.arange(stop[-1] if len(stop) else 0) - np.repeat(stop - n, n) + np.repeat(first[which].astype(np.int64), n)
        per = np.fromiter(map(len, units), dtype=np.int64, count=len(units))
        edge = np.concatenate([[0], np.cumsum(per)])
        size = chars[which].astype(np.int64)
        begun = np.cumsum(size) - size
        if len(which):
            begun -= np.repeat(begun[np.minimum(edge[:-1], len(begun) - 1)], per)
        shift = np.repeat(begun, n)
        bounds = np.concatenate([[0], stop])[edge]
        return ids[place], (starts[place] + shift).astype(np.int32), (ends[place] + shift).astype(np.int32), bounds


class ByteTable:
    """Decoding: tokens as strings of byte characters, which the reversed table turns back into bytes. No tokenizer."""

    def __init__(self, ranks: dict[bytes, int]):
        chars = byte_characters()
        self.shown = [""] * (max(ranks.values(), default=-1) + 1)
        for t, r in ranks.items():
            self.shown[r] = "".join(chars[b] for b in t)
        self.byte_of = np.zeros(512, np.uint8)
        for b, c in enumerate(chars):
            self.byte_of[ord(c)] = b

    def decode(self, ids) -> bytes:
        """The bytes of all ids together, so that a character split over tokens is whole again."""
        if any(not 0 <= i < len(self.shown) or not self.shown[i] for i in set(ids)):
            raise ValueError("an id that the ranks lack")
        shown = "".join(map(self.shown.__getitem__, ids))
        return self.byte_of[np.frombuffer(shown.encode("utf-16-le"), np.uint16)].tobytes()


@lru_cache(maxsize=2)
def coder(path: str, pattern: str) -> ByteBPE:
    return ByteBPE(path, pattern)


@lru_cache(maxsize=2)
def byte_table(path: str) -> ByteTable:
    return ByteTable(read_ranks(path))


def _lists(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, pa.int32()))


def encode(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", ranks: str = DEFAULT_RANKS, pattern: str = public_tokenizers.PATTERN, offsets: bool = True) -> DataFrame:
    """id, ids array<int>, and with offsets starts and ends array<int>, one row per row of docs.

    The ids are those of the rank file, each match of the pattern apart, without
    special tokens. starts and ends are code points of the text; tokens that hold
    parts of one character all have that character's place. Null counts as empty
    and has no ids. Rows stand alone: repeated rows repeat their results, an empty
    table gives none, other columns, whatever their names, are not read, and a
    text of any length is encoded whole.
    """

    def run(batches):
        b = coder(ranks, pattern)
        for batch in batches:
            for part in slices(batch, 1, CALL_BYTES):
                ids, starts, ends, bounds = b.encode(texts(part, 1))
                out = [part.column(0), _lists(ids, bounds)]
                names = [batch.schema.field(0).name, "ids"]
                if offsets:
                    out += [_lists(starts, bounds), _lists(ends, bounds)]
                    names += ["starts", "ends"]
                yield pa.RecordBatch.from_arrays(out, names=names)
        b.forget()

    d = docs.select(F.col(id_col), F.col(text_col))
    return d.mapInArrow(trimmed(run), f"`{id_col}` {d.schema[0].dataType.simpleString()}, ids array<int>" + ", starts array<int>, ends array<int>" * offsets)


def decode(tokens: DataFrame, *, id_col: str = "doc_id", ids_col: str = "ids", ranks: str = DEFAULT_RANKS, rows: int = 128) -> DataFrame:
    """id, ids and the bytes that they stand for, and these as text.

    Tokens are strings of byte characters; the reversed byte table turns them into
    bytes. Bytes of one character may lie in several tokens, so all are joined
    before they are read as UTF-8; what is no UTF-8 then shows as U+FFFD in
    ``text`` while ``bytes`` stays exact. Null ids count as none; an id that the
    rank file lacks is an error. Repeated rows repeat their results, an empty table
    gives none, and other columns are not read.
    """

    def run(batches):
        b = byte_table(ranks)
        for batch in batches:
            for lo in range(0, batch.num_rows, rows):
                part = batch.slice(lo, rows)
                out = [b.decode(x or ()) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out, pa.binary()), pa.array([x.decode("utf-8", "replace") for x in out], pa.string())], names=[batch.schema.field(0).name, "ids", "bytes", "text"])

    d = tokens.select(F.col(id_col), F.col(ids_col).alias("ids"))
    return d.mapInArrow(trimmed(run), f"`{id_col}` {d.schema[0].dataType.simpleString()}, ids array<int>, bytes binary, text string")


def round_trip(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", ranks: str = DEFAULT_RANKS, pattern: str = public_tokenizers.PATTERN, keep_ids: bool = False) -> DataFrame:
    """id, n_tokens, ids_sha256, offsets_sha256, decoded_sha256, and ids if asked for, one row per row of docs.

    Texts are encoded and their ids decoded in one worker, so that neither ids nor
    bytes travel but where they are wanted. The digests are those of the ids in
    decimal, joined by commas; of the starts, then the ends of all tokens in code
    points, as 32-bit little-endian numbers; and of the decoded bytes. Nulls, ties,
    repeated rows, empty tables and other columns as in ``encode``.
    """

    def run(batches):
        b, back = coder(ranks, pattern), byte_table(ranks)
        said = [str(i) for i in range(len(back.shown))]
        for batch in batches:
            for part in slices(batch, 1, CALL_BYTES):
                ids, starts, ends, bounds = b.encode(texts(part, 1))
                n, digests = np.diff(bounds), ([], [], [])
                for lo, hi in zip(bounds.tolist(), bounds[1:].tolist(), strict=False):
                    own = ids[lo:hi].tolist()
                    digests[0].append(sha256_hex(",".join(map(said.__getitem__, own)).encode()))
                    digests[1].append(sha256_hex(starts[lo:hi].tobytes() + ends[lo:hi].tobytes()))
                    digests[2].append(sha256_hex(back.decode(own)))
                out = [part.column(0), pa.array(n, pa.int64()), *[pa.array(x, pa.string()) for x in digests]]
                yield pa.RecordBatch.from_arrays([*out, _lists(ids, bounds)] if keep_ids else out, names=names)
        b.forget()

    d = docs.select(F.col(id_col), F.col(text_col))
    names = [id_col, "n_tokens", "ids_sha256", "offsets_sha256", "decoded_sha256", *(["ids"] if keep_ids else [])]
    return d.mapInArrow(trimmed(run), f"`{id_col}` {d.schema[0].dataType.simpleString()}, n_tokens long, ids_sha256 string, offsets_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids)


def op2_byte_bpe(spark, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))
